"""Source divergence audit (operator 13): which sources of a language differ, and by which terms.

The count column of a term is its sparse vector of counts by source. Terms of one language
with equal vectors count alike for every pair of sources, so each distinct vector is
evaluated once for each pair and multiplied by the number of its terms; the terms
themselves are only ranked within their sources. Shares are integers, so all of it is exact.

Vectors are dealt in blocks of about BLOCK_ENTRIES counts, and the sources, where a language has many, in
blocks of about BLOCK_SOURCES; a task holds the vectors of one block, restricted to two blocks of
sources. A term that none of these sources has is not there: a pair's value begins with what
it would be if all terms were absent, and each vector adds how much it differs from that.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.llm.common import lookup, session_of, written
from tramline.llm.streams import rows_of

LEAST_DOCS, TOP = 10, 10
UNIT, PRIOR = 1_000_000_000, 2
#: Bytes of a text that are terms at a time; distinct terms that a task holds before it passes them on.
STEP, HOLD = 1 << 22, 1 << 19
BLOCK_ENTRIES, BLOCK_SOURCES = 250_000, 512
#: Cells of the matrix of shares that a task fills at a time.
CELLS = 1 << 20
#: Salts of the look-up of a source's totals, which a third of the rows may share.
SALTS = 16

_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> Iterator[list[bytes]]:
    """Runs of letters A-Z (lower-cased) and of characters beyond ASCII, some MB at a time."""
    text, lo = (text or b"").translate(_PLAIN), 0
    while lo < len(text):
        hi = text.find(b" ", lo + STEP)
        hi = len(text) if hi < 0 else hi
        yield text[lo:hi].split()
        lo = hi


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of rows (lang, source, text); the empty term stands for the group itself."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    rows = 0

    def passed_on():
        lang, source, term, n, docs = [], [], [], [], []
        for group, (found, within) in counts.items():
            lang += [group[0]] * len(within)
            source += [group[1]] * len(within)
            term += within
            n += map(found.__getitem__, within)
            docs += within.values()
        arrays = [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])

    for lang, source, text in rows_of(batches):
        if (lang, source) not in counts:
            counts[lang, source] = Counter(), Counter([b""])
        found, within = counts[lang, source]
        distinct: set[bytes] = set()
        for terms in terms_of(text):
            found.update(terms)
            distinct.update(terms)
        within.update(distinct)
        rows += 1
        if (rows % 256 == 0 or len(distinct) > HOLD) and sum(len(d) for _, d in counts.values()) > HOLD:
            yield passed_on()
            counts = {}
    yield passed_on()


def _share(n: str, size: str) -> str:
    """SQL of 1 + floor(UNIT * (n + PRIOR) / size), exact where the product passes 64 bits."""
    return (
        f"1 + CASE WHEN {n} < 9000000000 THEN (({n} + {PRIOR}) * {UNIT}L) div {size} "
        f"ELSE cast((cast({n} + {PRIOR} as decimal(20)) * {UNIT}BD) div cast({size} as decimal(20)) as long) END"
    )


def shares(n: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The same of arrays, for sizes up to 9 * 10**15: three figures at a time, so nothing passes 64 bits."""
    out, rest = np.divmod(n + PRIOR, size)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // size, rest % size
    return out + 1


def _differ(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _pair_sums(key: tuple, vectors: pa.Table, groups: pa.Table) -> pa.Table:
    """(lang, left, right, value): what the vectors of a block add to each pair of the sources of two blocks."""
    lang, low, high, block = (k.as_py() for k in key)
    names, of = groups["source"].to_pylist(), np.array(groups["in"].to_pylist(), np.int64)
    kept = groups["kept"][0].as_py()
    size = groups["size"].to_numpy().astype(np.int64) + 2 * kept
    left = np.flatnonzero(of == low)
    pairs = [(i, np.flatnonzero(of == high) if low != high else left[k + 1 :]) for k, i in enumerate(left)]
    zero = shares(np.zeros(len(names), np.int64), size) if kept else np.ones(len(names), np.int64)
    sums = [_differ(zero[i], zero[j]) * (kept if block == 0 else 0) for i, j in pairs]
    if vectors.num_rows:
        column = {s: k for k, s in enumerate(names)}
        entries = vectors["entries"].combine_chunks()
        at, flat = entries.offsets.to_numpy(), entries.values
        source, n = flat.field("source").dictionary_encode(), flat.field("n").to_numpy()
        source = np.array([column[s] for s in source.dictionary.to_pylist()], np.int64)[source.indices.to_numpy()]
        share, terms = shares(n, size[source]), vectors["terms"].to_numpy()
        step = max(1, CELLS // len(names))
        for lo in range(0, len(terms), step):
            hi = min(lo + step, len(terms))
            filled = np.tile(zero, (hi - lo, 1))
            part = slice(at[lo], at[hi])
            filled[np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1])), source[part]] = share[part]
            for k, (i, j) in enumerate(pairs):
                sums[k] = sums[k] + terms[lo:hi] @ (_differ(filled[:, i : i + 1], filled[:, j]) - _differ(zero[i], zero[j]))
    left = [names[i] for i, j in pairs for _ in j]
    right = [names[k] for _, j in pairs for k in j]
    value = np.concatenate([*sums, np.zeros(0, np.int64)])
    return pa.table({"lang": pa.array([lang] * len(left), pa.string()), "left": pa.array(left, pa.string()), "right": pa.array(right, pa.string()), "value": pa.array(value, pa.int64())})


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, term, vector array<struct<source, n>>, n) of terms in at least ``least_docs`` documents of their language.

    The empty term is there for each language, with all its sources.
    """
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    texts = docs.select(none(lang_col).alias("lang"), none(source_col).alias("source"), F.col(text_col).cast("string").cast("binary").alias("text"))
    counted = texts.mapInArrow(_term_counts, "lang string, source string, term string, n long, docs long").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector"))
    return by_term.where((F.col("docs") >= least_docs) | (F.col("term") == "")).select("lang", "term", "vector", "n")


def _totals(terms: DataFrame) -> DataFrame:
    """(lang, source, size, lang_size, kept): kept terms of the language, and how often they occur in the source and in the language."""
    groups = terms.where("term = ''").select("lang", F.explode("vector.source").alias("source"))
    real = terms.where("term <> ''")
    sizes = real.select("lang", F.explode("vector").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("size"))
    langs = real.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_size"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", none("size"), none("lang_size"), none("kept"))


def pair_values(terms: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, left, right, value) for each two sources of a language, once."""
    vectors = written(terms.where("term <> ''").groupBy("lang", "vector").agg(F.count("*").alias("terms")))
    entries = vectors.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("n")).first().n
    sources = totals.groupBy("lang").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("n")).first().n
    n_blocks, n_parts = -(-entries // BLOCK_ENTRIES) or 1, -(-sources // BLOCK_SOURCES) or 1
    part = lambda source: F.pmod(F.xxhash64(source), F.lit(n_parts)).cast("int")
    every = F.sequence(F.lit(0), F.lit(n_parts - 1))
    two = lambda own: F.array_distinct(F.flatten(F.transform(own, lambda a: F.transform(every, lambda b: F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))))))
    blocks = F.sequence(F.lit(0), F.lit(n_blocks - 1))
    left = (
        vectors.select("lang", "terms", "vector", F.pmod(F.xxhash64("vector"), F.lit(n_blocks)).cast("int").alias("block"), F.explode(two(F.array_distinct(F.transform("vector", lambda e: part(e["source"]))))).alias("two"))
        .select("lang", "two.low", "two.high", "block", "terms", F.filter("vector", lambda e: part(e["source"]).isin(F.col("two.low"), F.col("two.high"))).alias("entries"))
    )
    right = (
        totals.select("lang", "source", "size", "kept", part(F.col("source")).alias("in"))
        .select("*", F.explode(two(F.array("in"))).alias("two")).select("lang", "two.low", "two.high", F.explode(blocks).alias("block"), "source", "in", "size", "kept")
    )
    keys = ["lang", "low", "high", "block"]
    sums = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_pair_sums, "lang string, left string, right string, value long")
    return sums.groupBy("lang", "left", "right").agg(F.sum("value").alias("value"))


def term_values(terms: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, term, value) of the kept terms that a source has oftener than its language."""
    own = terms.where("term <> ''").select("lang", "term", F.col("n").alias("lang_n"), F.explode("vector").alias("e")).select(F.struct("lang", "e.source").alias("group"), "term", "lang_n", F.col("e.n").alias("n"))
    known = totals.select(F.struct("lang", "source").alias("group"), (F.col("size") + 2 * F.col("kept")).alias("size"), (F.col("lang_size") + 2 * F.col("kept")).alias("lang_size"))
    shared = lookup(own, known, "group", "term", salts=SALTS).select("group", "term", F.expr(_share("n", "size")).alias("p"), F.expr(_share("lang_n", "lang_size")).alias("q")).where("p > q")
    return shared.select("group.lang", "group.source", "term", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))


def _ranked(values: DataFrame, top: int | None, deal: int) -> DataFrame:
    order = F.desc("value"), F.asc("item")
    if top is not None:
        # First the best of parts of a source, so that no task sees all of its terms.
        parts = Window.partitionBy("lang", "source", F.pmod(F.xxhash64("item"), F.lit(deal))).orderBy(*order)
        values = values.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= top)
    ranked = values.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair``: each other source of the language, by how far the shares of all kept terms
    differ from those of this source; all ranks. Part ``term``: the ``top`` terms that the source has, and oftener
    than its language. A share is p = 1 + floor(UNIT * (n + PRIOR) / (size + 2 * kept)), two shares differ by floor((p - q)**2 /
    (p + q)). Ranks go by falling value, then by the bytes of the item. Null text, language and
    source are empty; a source without terms has pairs too; of a language without kept terms all values are 0. Rows
    alike are documents each; other columns are ignored; an empty table gives no row.
    """
    spread = int(session_of(docs).conf.get("spark.sql.shuffle.partitions"))
    terms = written(kept_terms(docs, least_docs, lang_col, source_col, text_col))
    totals = written(_totals(terms))
    once = written(pair_values(terms, totals))
    pairs = once.select("lang", F.col("left").alias("source"), F.col("right").alias("item"), "value").union(once.select("lang", "right", "left", "value"))
    best = _ranked(term_values(terms, totals).withColumnRenamed("term", "item"), top, spread)
    told = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return told(_ranked(pairs, None, spread), "pair").unionByName(told(best, "term"))

