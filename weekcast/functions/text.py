"""Text and JSON column expressions (all Catalyst built-ins, no Python UDF).

* ``format_currency``   ``$1,234.50`` (X2)
* ``format_pct``        ``+1.2%`` (X2)
* ``categorize_feature`` feature name -> category, first match wins (X7)
* ``sanitize_markdown`` escape ``$``; headings ``# `` -> ``### ``, then ``## `` -> ``#### `` (X9)
* ``format_context``    ``CONTEXT:`` + ``- key: value`` lines from a map column (X10)
* ``scope_label``       "Store x, Department y, Service Level: 95%" (X11)
* ``parse_params`` / ``parse_importance`` JSON text -> map / array of structs (X12)
* ``importance_json``   rows -> JSON array text, sorted (X13)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Category rules for feature names, checked in this order.
CATEGORY_RULES = [
    ("Lag Features", ["lag"]),
    ("Rolling Statistics", ["rolling"]),
    ("Temporal Features", ["week", "month", "quarter"]),
    ("Economic Indicators", ["temperature", "fuel", "cpi", "unemployment"]),
    ("Markdown Features", ["markdown"]),
    ("Store Features", ["store"]),
]
OTHER_CATEGORY = "Other"

IMPORTANCE_SCHEMA = "array<struct<feature:string,importance:double>>"
PARAMS_SCHEMA = "map<string,string>"


def format_currency(x: Column, digits: int = 2) -> Column:
    """``$`` + thousands separators + fixed decimals; negative as ``$-1,234.50`` like Python f-strings."""
    return F.concat(F.lit("$"), F.format_number(x, digits))


def format_pct(x: Column, digits: int = 1) -> Column:
    """Signed percentage such as ``+1.2%``; ties go to the even digit, as Python formats them."""
    places = "0." + "0" * digits if digits else "0"
    return F.concat(_formatted(x, f"+{places};-{places}"), F.lit("%"))


def format_fixed(x: Column, digits: int = 1) -> Column:
    """Fixed decimals without separators; ties go to the even digit."""
    return _formatted(x, "0." + "0" * digits if digits else "0")


def _formatted(x: Column, pattern: str) -> Column:
    return F.call_function("format_number", x.cast("double"), F.lit(pattern))


def categorize_feature(name: Column) -> Column:
    expr = None
    for category, needles in CATEGORY_RULES:
        cond = None
        for n in needles:
            c = name.contains(n)
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(category)) if expr is None else expr.when(cond, F.lit(category))
    return expr.otherwise(F.lit(OTHER_CATEGORY))


def sanitize_markdown(text: Column) -> Column:
    """Escape dollar signs, then demote headings at line starts: ``# `` -> ``### ``, ``## `` -> ``#### ``.

    ``(?d)`` makes ``^`` treat only ``\\n`` as a line end, as Python's ``re.M`` does.
    """
    t = F.replace(text, F.lit("$"), F.lit("\\$"))
    t = F.regexp_replace(t, r"(?dm)^# ", "### ")
    return F.regexp_replace(t, r"(?dm)^## ", "#### ")


def format_context(kv: Column) -> Column:
    """``CONTEXT:`` followed by one ``- key: value`` line per map entry (map order)."""
    lines = F.transform(F.map_entries(kv), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"]))
    return F.concat_ws("\n", F.lit("CONTEXT:"), F.array_join(lines, "\n"))


def scope_label(store: Column, dept: Column, service_level: Column | None = None) -> Column:
    parts = [
        F.when(store.isNotNull(), F.concat(F.lit("Store "), store.cast("string"))),
        F.when(dept.isNotNull(), F.concat(F.lit("Department "), dept.cast("string"))),
    ]
    if service_level is not None:
        parts.append(F.when(service_level.isNotNull(),
                            F.concat(F.lit("Service Level: "), F.format_number(service_level * 100, 0),
                                     F.lit("%"))))
    label = F.concat_ws(", ", *parts)
    return F.when(label == "", F.lit("All stores and departments")).otherwise(label)


def parse_params(js: Column) -> Column:
    return F.from_json(js, PARAMS_SCHEMA)


def parse_importance(js: Column) -> Column:
    return F.from_json(js, IMPORTANCE_SCHEMA)


def importance_json(df: DataFrame, feature: str = "feature", importance: str = "importance") -> DataFrame:
    """One row with the (feature, importance) rows as JSON text, importance descending.

    ``collect_list`` order is not deterministic, so the array is sorted explicitly.
    """
    arr = F.collect_list(F.struct(F.col(importance).alias("importance"), F.col(feature).alias("feature")))
    srt = F.reverse(F.array_sort(arr))
    return df.agg(
        F.to_json(F.transform(srt, lambda s: F.struct(s["feature"].alias("feature"),
                                                      s["importance"].alias("importance"))))
        .alias("feature_importance")
    )
