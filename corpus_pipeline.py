"""A corpus clean-up of five stages over ``documents``; counted as part of tramline.llm.

Each stage takes (spark, docs, sf_dir) and returns what it kept, with the columns of
documents; the last one returns token ids instead.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import bpe, decontaminate, line_dedup, ngram_join, toxicity
from tramline.llm.common import cut, emptied, table, unused, written
from tramline.llm.queries import VOCABULARY


def _identity() -> Column:
    """128 bits of id and text; a null differs from all values."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return F.md5(F.concat(part("doc_id"), F.lit("\0"), part("text")))


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    """docs with a long for each pair of id and text. Different pairs with one hash (the few that a very large table has) get others, by all 128 bits."""
    number, again = F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(key), _identity())
    hashed = docs.select(number.alias("key"), _identity().alias("identity"))
    clash = hashed.groupBy("key").agg(F.min("identity").alias("a"), F.max("identity").alias("b")).where("a <> b").select("key")
    known = [r["key"] for r in clash.collect()]
    return docs.withColumn(key, F.when(number.isin(known), again).otherwise(number) if known else number)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go; it is fitted on the labelled ones."""
    model = toxicity.fit(docs, toxicity.grades_of(table(spark, sf_dir, "labels")))
    return docs.where(~toxicity.rejects(model, toxicity.probabilities(model, F.col("text"))))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines and of single lines with text go, and documents of which nothing is left with them."""
    # By number, so that no column is called like a result of the operator.
    names = [f"c{k}" for k in range(len(docs.columns))]
    own = {n: names[docs.columns.index(n)] for n in ("doc_id", "text", "n_chars")}
    found = line_dedup.deduplicate(docs.toDF(*names), own["doc_id"], own["text"], lone_words=line_dedup.LONE_WORDS)
    kept = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    changed = F.when(F.col("n_removed") > 0, F.char_length(own["text"]).cast("long")).otherwise(F.col(own["n_chars"]))
    return kept.withColumn(own["n_chars"], changed).select(*names).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links connect, the one of the least id stays; null ids come last.

    Documents are judged by id and text, so each text of an id that several have is judged by
    itself, and so is one without an id. Rows of one id and text are one document, of which
    one row stays.
    """
    key = unused(docs, "key")
    # The join takes repeated rows as one; texts are shuffled once more for what stays.
    keyed = _keyed(docs, key)
    joined = ngram_join.similarity_join(keyed, id_col=key)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", F.col(key).alias("kept")))
    stays = keyed.select(key, "doc_id").distinct().join(joined.select(key, "class_id"), key).groupBy("class_id").agg(first.alias("first")).select(F.col("first.kept").alias(key))
    return keyed.dropDuplicates([key]).join(stays, key, "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    # By id and text, so that rows without an id or with a repeated one are judged by their own text.
    key = unused(docs, "key")
    keyed = _keyed(docs, key)
    found = decontaminate.scan(keyed, table(spark, sf_dir, "benchmark"), id_col=key)
    hit = cut(found.where("n_hit > 0").select(key).distinct())
    return keyed.join(hit, key, "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digest of what they decode to."""
    return bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: SQL cannot express the model and the tokeniser; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage keeps. Each stage's rows are written once, so that the next one may read them as often as it needs."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            emptied(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
