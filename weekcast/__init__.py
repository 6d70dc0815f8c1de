"""weekcast: weekly retail panel analytics and forecasting as Spark DataFrame jobs.

Every operator is a function ``DataFrame -> DataFrame`` (or a few DataFrames in,
one out) built from Catalyst expressions, window functions, joins and Spark ML.
Subpackages:

* ``sources``   - typed scans of CSV/Parquet, the adapter from the test tables, sinks
* ``functions`` - column expressions (calendar, text/JSON, forecast intervals)
* ``operators`` - feature engineering, quality checks, metrics, forecasts,
                  exploration aggregates, anomaly / inventory / report summaries, model
* ``plans``     - join strategy helpers and the registered query catalog
* ``streaming`` - incremental ingest of new weekly sales with Structured Streaming
"""

from weekcast.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
