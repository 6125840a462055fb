"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def _shared_folder(session: SparkSession) -> str:
    """The checkpoint folder of the session: its ``spark.checkpoint.dir``, a folder of this machine only on a local master."""
    context = session.sparkContext
    if context.getCheckpointDir() is None:
        set_to = session.conf.get("spark.checkpoint.dir", None)
        if set_to is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(set_to or tempfile.mkdtemp(prefix="tramline-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    Call it after a shuffle: Spark computes the last stage twice, what lies before the
    shuffle once. Spark removes checkpoints that nothing refers to where the session sets
    ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    _shared_folder(session_of(df))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; every stage is computed once.

    For stages that end no shuffle. The tables stay until the folder is emptied, or ``emptied``
    is called.
    """
    path = f"{_shared_folder(session_of(df))}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return session_of(df).read.schema(df.schema).parquet(path)


def emptied(table: DataFrame) -> None:
    """Overwrite a table of ``written`` with no rows, once all that was made from it is written itself."""
    folders = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
    for folder in folders:
        session_of(table).createDataFrame([], table.schema).coalesce(1).write.mode("overwrite").parquet(folder)


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of the table is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def lookup(rows: DataFrame, unique: DataFrame, key: str, salt: str, how: str = "inner", salts: int = 8) -> DataFrame:
    """Join rows with a table that has one row per key, where a key may hold a third of the rows.

    Both sides are dealt by (key, salt): the rows by the hash of ``salt``, the table once
    for each salt. Both sides get an exchange of their own, so that adaptive execution can
    split what is still skewed.
    """
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    unique = unique.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.join(unique, [key, "_salt"], how).drop("_salt")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (src, dst): rows (node, comp), comp the least node.

    Least labels travel along the edges and through their own label (pointer jumping);
    each round ends in a checkpoint. All of it are joins and minima, nothing is collected.
    """
    # Labels are looked up, not grouped, so a node with very many edges is no hot group.
    both = cut(
        edges.select("src", "dst")
        .union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        .where(F.col("src") != F.col("dst"))
        .distinct()
    )
    labels = cut(
        both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low"))
        .select("node", F.least("node", "low").alias("comp"))
    )
    for _ in range(max_rounds):
        near = (
            lookup(both, labels.select(F.col("node").alias("dst"), "comp"), "dst", "src")
            .groupBy(F.col("src").alias("node")).agg(F.min("comp").alias("near"))
        )
        low = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("low"))
        root = labels.select(F.col("node").alias("low"), F.col("comp").alias("jump"))
        new = cut(
            lookup(low, root, "low", "node", "left")
            .select("node", F.least("low", "jump").alias("comp"), (F.least("low", "jump") < F.col("comp")).alias("moved"))
        )
        labels = new.select("node", "comp")
        if new.where("moved").isEmpty():
            return labels
    raise RuntimeError(f"components: not settled after {max_rounds} rounds")
