"""URL filters (operator 3): prefix rules as intervals, joined by a sorted sweep.

A rule (host, path) fits its host and all subdomains where the URL's path starts with the
rule's. In keys of reversed host labels and path, a rule is a prefix, so it is the interval
of the keys that it begins; intervals of prefixes nest or are disjoint. A URL has one key
for each of its host suffixes of as many labels as rules have; longer ones, and more of the
path than the longest rule has, can't tell rules apart. Keys and rules are sorted together, the last rule before a
key carries the stack of the rules that it lies in, and the innermost of that stack which
still holds the key fits it. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Verdict where no rule fits.
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(after, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    # A host has no slash, so the first one ends it: com/ is no prefix of com.example/.
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("/"), path)


def nested_rules(rules: DataFrame) -> DataFrame:
    """(key, stack): each distinct key with all rules whose key begins it, shortest first.

    rules: host, path, verdict; null host or path counts as empty, hosts are lower-cased.
    Of rules with one host and path block wins.
    """
    rules = (
        rules.select(F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("host", "path").agg(F.max(F.col("verdict") == "block").alias("blocks"))
        .select(
            _key(F.split("host", r"\."), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), F.char_length("host").alias("host_size"),
            F.when(F.col("blocks"), "block").otherwise("allow").alias("verdict"))
    )
    begins = rules.select("key", F.explode(F.sequence(F.lit(1), F.char_length("key"))).alias("n")).select("key", F.expr("left(key, n)").alias("outer"))
    outer = rules.select(F.col("key").alias("outer"), "rule", "host_size", "verdict")
    entry = F.struct(F.char_length("outer").alias("size"), F.col("outer").alias("key"), "rule", "host_size", "verdict")
    return begins.join(outer, "outer").groupBy("key").agg(F.array_sort(F.collect_list(entry)).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT, salts: int | None = None) -> DataFrame:
    """(id, host, path, rule, verdict), one row for each input row.

    The longest fitting rule (host and path together, then the longer host) judges; where
    none fits, rule is null and the verdict the default. A null URL or one without :// has
    an empty host and path. Hosts and URLs may be very long: keys are only as deep and as
    long as the rules. Repeated rows and null ids stay rows of their own; other
    columns are ignored. Rows are dealt by a hash of their number, so a host with very many
    URLs is spread; the rules, and only they, are repeated for each of the ``salts`` sweeps
    (as many as shuffle partitions, if not given).
    """
    # One row about the rules: how many labels and how much of a path a key needs.
    shape = rules.agg(
        F.coalesce(F.max(F.size(F.split(F.coalesce("host", F.lit("")), r"\."))), F.lit(1)).alias("labels"),
        F.coalesce(F.max(F.char_length(F.coalesce("path", F.lit("")))), F.lit(0)).alias("path")).first()
    salts = salts or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pages = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url")).withColumn("_row", F.monotonically_increasing_id())
    # The row number only groups what was one row; it is taken once, before the only shuffle.
    urls = pages.select("_id", "_row", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path")).withColumn("labels", F.split("host", r"\."))
    keys = urls.select(
        F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int").alias("sweep"), "_id", "_row", "host", "path",
        F.explode(F.transform(
            F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(shape["labels"]))), lambda n: _key(F.slice("labels", -n, n), F.left("path", F.lit(shape["path"]))))).alias("key"),
        F.lit(1).alias("kind"),
    )
    nested = nested_rules(rules)
    starts = nested.withColumn("sweep", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(
        "sweep", F.lit(None).cast(pages.schema["_id"].dataType).alias("_id"), F.lit(None).cast("long").alias("_row"), F.lit(None).cast("string").alias("host"),
        F.lit(None).cast("string").alias("path"), "key", F.lit(0).alias("kind"), "stack")
    keys = keys.withColumn("stack", F.lit(None).cast(starts.schema["stack"].dataType))
    order = Window.partitionBy("sweep").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = keys.unionByName(starts).withColumn("open", F.last("stack", ignorenulls=True).over(order)).where("kind = 1")
    holding = F.filter("open", lambda r: F.startswith(F.col("key"), r["key"]))
    inner = F.element_at(holding, -1)
    best = F.max(F.when(F.size(holding) > 0, F.struct(F.char_length(inner["rule"]).alias("size"), inner["host_size"].alias("host_size"), inner["rule"].alias("rule"), inner["verdict"].alias("verdict"))))
    judged = swept.groupBy("_row", "_id", "host", "path").agg(best.alias("best"))
    return judged.select(
        F.col("_id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
