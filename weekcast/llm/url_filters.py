"""URL filters: host-suffix and path-prefix expressions matched by short hash prefixes.

Every URL is expanded into the expressions host suffix x path prefix that some rule could have
(only label counts and path lengths that occur among the rules), each expression is hashed, the
first bytes of the digest are joined with those of the rules, full digests confirm a match and the
longest rule decides.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from
there up to ``?``, ``#`` or the end. A rule fits its host and all subdomains if the path starts
with the rule's path.

Defined cases: a null url or one without ``://`` has empty host and path, fits no rule and gets the
default verdict; of rules of one length the one with the longer host wins, then block before allow;
a repeated rule counts once; rules with a null part are ignored; with no rules every url gets the
default; rows are answered one by one (repeated and null ids pass through); other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Hex digits of the digest that the join uses; the full digest confirms.
PREFIX_DIGITS = 8
DEFAULT_VERDICT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), 256)


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule`` and ``verdict`` for every row of ``urls``.

    ``rules`` has ``action`` (allow or block), ``host`` and ``path``. The numbers of labels and the
    path lengths of the rules are gathered to bound the expansion (distinct small integers).
    """
    known = (
        rules.select(F.col("action").alias("action"), F.lower("host").alias("rule_host"), F.col("path").alias("rule_path"))
        .dropna()
        .withColumns({"digest": _digest(F.col("rule_host"), F.col("rule_path")), "rule": F.concat("rule_host", "rule_path")})
        .groupBy("digest", "rule", "rule_host")
        .agg(F.max("action").alias("action"))  # block before allow
        .withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    )
    shape = rules.dropna(subset=["action", "host", "path"]).agg(
        F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")
    ).first()
    host, path = host_and_path(F.col("url"))
    rows = urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    if not shape["labels"]:
        none = rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(DEFAULT_VERDICT)})
        return none.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict")
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in sorted(shape["labels"])]))
    prefixes = F.filter(
        F.array_distinct(F.array(*[F.when(F.length("path") >= n, F.col("path").substr(F.lit(1), F.lit(n))) for n in sorted(shape["lengths"])])),
        lambda p: p.isNotNull(),
    )
    expressions = (
        rows.select("host", "path").distinct()
        .withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
        .select("host", "path", _digest(F.col("suffix"), F.col("prefix")).alias("digest"))
        .withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    )
    found = expressions.join(known, "short").where(expressions["digest"] == known["digest"])
    best = found.groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("size"), F.length("rule_host").alias("host_size"), F.col("action"), F.col("rule"))).alias("best")
    )
    return rows.join(best, ["host", "path"], "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(DEFAULT_VERDICT)).alias("verdict"),
    )
