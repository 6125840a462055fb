r"""Chat formatting (operator 5): reply trees into one text for each chosen branch.

Paths from root to leaf come from self-joins that double the reach of a parent pointer, so
their number is the logarithm of the deepest tree. Branches of a tree are ranked by score.

A turn is written as ``### role: text</turn>`` and a newline. Inside roles and texts a
backslash goes before each backslash, #, < and :, so no control string can occur there and
reading back is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.llm.common import cut

ASSISTANT = "assistant"
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.)*+)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"([\\#<:])", r"\\$1")


def formatted_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("### "), escaped(role), F.lit(": "), escaped(text), F.lit("</turn>\n"))


def read_back(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end enclose the escaped text in the formatted one."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if found is None:
            raise ValueError(f"no turn at {at}")
        turns.append((_ESCAPED.sub(r"\1", found[1]), _ESCAPED.sub(r"\1", found[2]), *found.span(2)))
        at = found.end()
    return turns


def branches(nodes: DataFrame, tree: str = "tree_id", node: str = "node_id", parent: str = "parent_id", score: str = "score", top: int | None = None) -> DataFrame:
    """(tree, leaf, branch, branch_score, node, depth): the nodes of each chosen root-to-leaf path, root at depth 0.

    nodes: one row for each (tree, node); of repeated ones one stands for them. A node whose
    parent is null or absent is a root. branch_score is the mean score of the path (a null
    score counts as 0); branch is its rank in the tree, ties by the lesser leaf; the first
    ``top`` branches are kept, or all. Nodes whose parents run in a circle belong to no
    path. Null trees or nodes are left out.
    """
    rows = nodes.where(F.col(tree).isNotNull() & F.col(node).isNotNull()).groupBy(F.col(tree).alias("tree"), F.col(node).alias("node")).agg(
        F.min(F.struct(F.col(parent).alias("parent"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score"))).alias("s")).select("tree", "node", "s.parent", "s.score")
    known = rows.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    rows = cut(rows.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("parent"), "score"))
    deepest = rows.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    # up[k] has the ancestor 2**k above; paths then gain all that lie less than 2**(k+1) above.
    up = [rows.select("tree", "node", "parent").where("parent is not null")]
    while 1 << len(up) < deepest and not up[-1].isEmpty():
        last = up[-1]
        up.append(cut(last.alias("a").join(last.select("tree", F.col("node").alias("parent"), F.col("parent").alias("over")), ["tree", "parent"]).select("tree", "node", F.col("over").alias("parent"))))
    parents = rows.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    paths = rows.join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("above"))
    for k in reversed(range(len(up))):
        # Both halves read the paths so far; without the cut the plan would double in each round.
        paths = cut(paths.union(paths.join(up[k], ["tree", "node"]).select("tree", "leaf", F.col("parent").alias("node"), F.col("above") + (1 << k))))
    paths = paths.join(rows, ["tree", "node"])
    whole = paths.groupBy("tree", "leaf").agg(F.avg("score").alias("branch_score"), F.max("above").alias("length"), F.max(F.col("parent").isNull()).alias("rooted")).where("rooted")
    order = Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")
    ranked = whole.withColumn("branch", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("branch") <= top)
    return paths.select("tree", "leaf", "node", "above").join(ranked, ["tree", "leaf"]).select(
        "tree", "leaf", "branch", "branch_score", "node", (F.col("length") - F.col("above")).alias("depth"))


def format_branches(nodes: DataFrame, chosen: DataFrame, tree: str = "tree_id", node: str = "node_id", role: str = "role", text: str = "text") -> DataFrame:
    """(tree, branch, formatted): one conversation for each chosen path; null roles and texts are empty."""
    turns = nodes.groupBy(F.col(tree).alias("tree"), F.col(node).alias("node")).agg(F.min(F.struct(F.col(role).alias("role"), F.col(text).alias("text"))).alias("t"))
    turns = turns.select("tree", "node", formatted_turn(F.col("t.role"), F.col("t.text")).alias("turn"))
    ordered = F.array_sort(F.collect_list(F.struct("depth", "turn")))
    return chosen.join(turns, ["tree", "node"]).groupBy("tree", "branch").agg(F.array_join(F.transform(ordered, lambda t: t["turn"]), "").alias("formatted"))


def reply_chains(conversations: DataFrame) -> DataFrame:
    """Nodes (tree_id, node_id, parent_id, role, text, score) of rows (conv_id, turn, role, text): each turn answers the one before.

    Turns are ordered by number, null first, then users before assistants, then by text;
    equal and repeated rows stay turns of their own. Rows of a null conversation are left
    out; a null role is an empty one. The score of a turn is 1.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", F.desc("role"), "text")
    numbered = conversations.where("conv_id is not null").select("conv_id", "role", "text", F.row_number().over(order).alias("node_id"))
    return numbered.select(
        F.col("conv_id").alias("tree_id"), "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(1.0).alias("score"))


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from (tree, formatted): turns and the text under the loss mask (assistant turns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py()
                turns = read_back(text)
                said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t, *_ in turns).encode("utf-8", "surrogatepass")).hexdigest()
                loss = "".join(_ESCAPED.sub(r"\1", text[a:b]) for r, _, a, b in turns if r == ASSISTANT)
                rows.append((len(turns), said, len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["tree"].dataType.simpleString()
    return formatted.select("tree", "formatted").mapInArrow(
        run, f"tree {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
