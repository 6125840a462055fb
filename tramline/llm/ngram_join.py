"""N-gram Jaccard join (operator 2): MinHash banding, then exact verification.

Texts with the same set of n-grams form one copy class, of which only the least id goes
on. Its signature is cut into bands; classes that share a band are candidates. Candidates
are verified on their full n-gram sets. A connected component of up to BLOCK classes is one
group of rows. A larger one is dealt into pairs of blocks, or, where that sends less, by
bands: each of its band buckets into pairs of blocks, where a pair counts in the first band
that it shares. So chains of texts that share no band don't meet, no task holds more than
two blocks, and no row is written for a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import components, cut, lookup
from tramline.llm.streams import groups_of

#: Words of one n-gram and the least similarity of a link.
WORDS = 5
THRESHOLD = 0.8
#: Least probability that a pair of just THRESHOLD shares a band.
RECALL = 0.995
ROWS = 8
BLOCK = 512

_MIX1, _MIX2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """Bands of so many rows that a pair at the threshold shares one with that probability."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Grams:
    """Sets of word n-grams as sorted 64-bit hashes. Words are runs of no white space."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def of(self, text: str | None) -> np.ndarray:
        """Fewer words than an n-gram, but not none, are one n-gram."""
        import xxhash

        found, known = (text or "").split(), self.known
        if not found:
            return np.zeros(0, np.uint64)
        if len(known) > 500_000:
            known.clear()
        for w in set(found).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        ids = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        size = min(self.words, len(ids))
        total = np.zeros(len(ids) - size + 1, np.uint64)
        for k in range(size):
            total = _mixed(total * _BASE + ids[k : len(ids) - size + 1 + k] + np.uint64(k))
        return np.unique(total)


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.factor = draw.integers(1, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.shift = draw.integers(0, 2**32, bands * rows, dtype=np.uint32)

    def keys(self, grams: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band; the number of the band goes into it."""
        low = np.full(len(self.factor), 0xFFFFFFFF, np.uint32)
        short = (grams >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(short), 128):
            np.minimum(low, (short[at : at + 128, None] * self.factor + self.shift).min(axis=0), out=low)
        key = np.arange(self.bands, dtype=np.uint64) + _BASE
        for part in low.reshape(self.bands, self.rows).T:
            key = _mixed(key * _BASE + part)
        return key.view(np.int64)


def sketches(docs: DataFrame, words: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(_id, digest, keys): digest of the n-gram set, null without words; one row for each id.

    Of several texts of an id the one of the least digest stands for it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, minhash = Grams(words), MinHash(bands, rows)
        for batch in batches:
            digests, keys = [], []
            for text in batch.column(1):
                found = grams.of(text.as_py())
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                keys.append(minhash.keys(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["_id", "digest", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
        .mapInArrow(run, f"_id {kind}, digest binary, keys array<long>")
        .groupBy("_id").agg(F.min(F.struct("digest", "keys")).alias("s")).select("_id", "s.digest", "s.keys")
    )


def _verify(words: int, threshold: float, kind: str):
    """Links inside each (component, band key or 0, block, block): rows sorted by these four."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (_, band, a, b), rows in groups_of(batches, 4):
            unique = {r[4]: r for r in rows}
            ids = sorted(unique)
            copies = np.array([unique[i][5] for i in ids], np.int64)
            block = np.array([unique[i][6] for i in ids])
            keys = np.array([unique[i][7] for i in ids], np.int64).reshape(len(ids), -1)
            sets = [np.frombuffer(unique[i][8], np.uint64) for i in ids]
            size = np.array([len(s) for s in sets])
            near = np.zeros((len(ids), len(ids)), bool)
            for column in keys.T:
                if band and column[0] == band:
                    near = ~near
                    break
                near |= column[:, None] == column[None, :]
            near &= np.minimum(size[:, None], size[None, :]) >= threshold * np.maximum(size[:, None], size[None, :])
            near &= (block[:, None] != block[None, :]) | (a == b)
            x, y = np.nonzero(np.triu(near, 1))
            common = _common(sets, x, y)
            linked = common >= threshold * (size[x] + size[y] - common) - 1e-9
            x, y = x[linked], y[linked]
            links = np.bincount(x, copies[y], len(ids)) + np.bincount(y, copies[x], len(ids))
            root = list(range(len(ids)))

            def find(i: int) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for i, j in zip(x.tolist(), y.tolist()):
                i, j = find(i), find(j)
                root[max(i, j)] = min(i, j)
            out += [(i, int(n), ids[find(k)]) for k, (i, n) in enumerate(zip(ids, links))]
            if len(out) > 5000:
                yield _links(out, kind)
                out = []
        yield _links(out, kind)

    return run


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _links(rows: list[tuple], kind: str) -> pa.RecordBatch:
    ids, links, roots = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(ids, _ARROW[kind]), pa.array(links, pa.int64()), pa.array(roots, _ARROW[kind])], ["rep", "links", "root"])


def _common(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (x, y)."""
    if len(x) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(x, y)], np.int64)
    # Many pairs: products of slices of the membership matrix.
    names, at = np.unique(np.concatenate(sets), return_inverse=True)
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(at, kind="stable")
    at, who = at[order], who[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, len(names), 8192):
        here = slice(*np.searchsorted(at, (lo, lo + 8192)))
        member = np.zeros((len(sets), 8192), np.float32)
        member[who[here], at[here] - lo] = 1
        total += member @ member.T
    return total[x, y].astype(np.int64)


def similarity_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD,
                    recall: float = RECALL, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(id, class_id, copy_id, n_links), one row for each id.

    n_links counts the other documents whose n-gram sets are at least threshold similar,
    exact copies among them; class_id is the least id of the documents that links connect,
    copy_id the least id with the same n-gram set. Null, empty and wordless texts have no
    n-grams: they link to nothing and form classes of their own. Rows with a null id are
    left out; repeated rows are one document, and of several texts of an id one stands for
    it. Other columns are ignored. Ids are long, int or string.
    """
    bands = bands_for(threshold, recall, rows)
    kind = docs.schema[id_col].dataType.simpleString()
    known = cut(sketches(docs, words, bands, rows, id_col, text_col))
    full = known.where("digest is not null")
    classes = full.groupBy("digest").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    members = cut(lookup(full, classes, "digest", "_id").select("_id", "digest", "rep", "copies", F.when(F.col("_id") == F.col("rep"), F.col("keys")).alias("keys")))
    reps = members.where("_id = rep")

    keyed = reps.select("rep", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("tail")).where("head != tail").select("key", "head")
    edges = lookup(keyed, shared, "key", "rep").where("rep != head").select(F.col("head").alias("src"), F.col("rep").alias("dst"))
    comps = components(edges)
    blocks = lambda n: F.ceil(n / F.lit(float(block))).cast("int")
    sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).withColumn("n_blocks", blocks(F.col("n")))
    placed = lookup(comps, sizes, "comp", "node").select(F.col("node").alias("rep"), "comp", "n", "n_blocks")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("band"), "n_blocks"))
    if sizes.where("n_blocks > 1").isEmpty():
        placed = placed.select("rep", "comp", whole.alias("deals"))
    else:
        # Which of the two ways sends fewer sets: all pairs of blocks, or those of each band bucket.
        banded = keyed.join(placed.where("n_blocks > 1").select("rep", "comp"), "rep")
        buckets = cut(banded.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("in_band")).where("in_band > 1").withColumn("n_blocks", blocks(F.col("in_band"))))
        costs = buckets.groupBy("comp").agg(F.sum(F.col("in_band") * F.col("n_blocks")).alias("cost"))
        cheaper = cut(costs.join(sizes, "comp").where(F.col("cost") < F.col("n") * F.col("n_blocks")).select("comp", F.lit(True).alias("by_band")))
        parts = lookup(banded, buckets.join(cheaper, "comp").select("key", "n_blocks"), "key", "rep")
        deals = parts.groupBy("rep").agg(F.collect_list(F.struct(F.col("key").alias("band"), "n_blocks")).alias("band_deals"))
        placed = lookup(placed, cheaper, "comp", "rep", "left").join(deals, "rep", "left").select(
            "rep", "comp", F.when(F.col("by_band"), F.coalesce("band_deals", F.array())).otherwise(whole).alias("deals"))
    placed = placed.join(reps.select("rep", "copies", "keys", "digest"), "rep")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Grams(words)
        for batch in batches:
            packed = []
            for text, digest in zip(batch.column(0), batch.column(1)):
                raw = make.of(text.as_py()).tobytes()
                packed.append(raw if hashlib.blake2b(raw, digest_size=16).digest() == digest.as_py() else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(packed, pa.binary())], ["comp", "deals", "rep", "copies", "keys", "grams"])

    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).cast("string").alias("_text"))
    full_sets = (
        texts.join(placed, "rep").select("_text", "digest", "comp", "deals", "rep", "copies", "keys")
        .mapInArrow(grams, f"comp {kind}, deals array<struct<band: long, n_blocks: int>>, rep {kind}, copies long, keys array<long>, grams binary").where("grams is not null")
    )
    dealt = full_sets.withColumn("deal", F.explode("deals")).withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("deal.n_blocks")).cast("int"))
    dealt = (
        dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("deal.n_blocks") - 1)))
        .select("comp", "deal.band", F.least("blk", "other").alias("a"), F.greatest("blk", "other").alias("b"), "rep", "copies", "blk", "keys", "grams")
        .repartition("comp", "band", "a", "b").sortWithinPartitions("comp", "band", "a", "b")
    )
    verified = cut(
        dealt.mapInArrow(_verify(words, threshold, kind), f"rep {kind}, links long, root {kind}")
        .groupBy("rep", "root").agg(F.sum("links").alias("links"))
    )
    links = verified.groupBy("rep").agg(F.sum("links").alias("links"), F.count(F.lit(1)).alias("n"), F.min("root").alias("root"))
    # A class in several block pairs may have several roots there; these are then connected.
    if not links.where("n > 1").isEmpty():
        merged = components(verified.where("rep != root").select(F.col("root").alias("src"), F.col("rep").alias("dst")))
        links = links.join(merged.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "links", F.coalesce("comp", "rep").alias("root"))
    found = lookup(members.select("_id", "rep", "copies"), links.select("rep", "links", "root"), "rep", "_id", "left")
    return found.select(
        F.col("_id").alias(id_col), F.coalesce("root", "rep").alias("class_id"), F.col("rep").alias("copy_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    ).union(known.where("digest is null").select("_id", "_id", "_id", F.lit(0).cast("long")))
