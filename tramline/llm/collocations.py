"""Phrase collocation mining (operator 12): Suffix-sigma.

Each word starts a suffix of at most MAX_WORDS words of its piece. Suffixes are dealt by
language and first word, sorted in reverse, and one stack of open prefixes counts them all:
a prefix is closed, and told if it is frequent, once a suffix comes that doesn't begin
with it. Two things keep this small. Words that are rare in their language end a suffix,
since no frequent phrase holds them (a bitmap of bounded size knows the frequent ones), and
equal suffixes of a task are one row. A prefix that holds a large share of all words is
dealt on by its next word; its own count then comes in parts, which are added up, and all
longer ones are whole again. The parts of the frequent phrases are joined afterwards.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.llm.common import session_of, written
from tramline.llm.streams import rows_of

MAX_WORDS, LEAST, COVER, TOP = 4, 30, 80, 2000
#: A phrase is scored by SCALE * a / (l + r).
SCALE = 2_000_000
#: Bytes of a text that are words at a time; words and suffixes that a task holds before it passes them on.
STEP, HOLD = 1 << 22, 1 << 20
#: The bitmap of frequent words has 16 bits for each, but no more than this (8 MB); what it can't tell apart stays.
MAX_BITS = 1 << 26
#: One position in so many tells which prefixes are hot; this only decides where rows go.
STRIDE = 512

_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"." * 9)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def words_of(text: bytes | None) -> Iterator[list[bytes]]:
    """Words of a text, lower-cased, some MB at a time; ``.`` stands where a piece ends."""
    text, lo = (text or b"").translate(_PLAIN), 0
    while lo < len(text):
        hi = text.find(b" ", lo + STEP)
        hi = len(text) if hi < 0 else hi
        yield text[lo:hi].replace(b".", b" . ").split()
        lo = hi


def _head(lang: str) -> bytes:
    """Begins the keys of a language; holds no blank and no tab of its own."""
    return quote(lang, safe="").encode() + b"\t"


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n, sampled): counts of words, and of the prefixes at some positions, of rows (lang, text)."""
    counts: dict[str, Counter] = {}
    sample: Counter = Counter()
    seen = 0

    def passed_on():
        keys, n, sampled = [], [], []
        for lang, words in counts.items():
            words.pop(b".", None)
            head = _head(lang)
            keys += [head + w + b" " for w in words]
            n += words.values()
            sampled += [False] * len(words)
        keys += sample
        n += sample.values()
        sampled += [True] * len(sample)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(sampled, pa.bool_())], ["key", "n", "sampled"])

    for lang, text in rows_of(batches):
        for words in words_of(text):
            counts.setdefault(lang, Counter()).update(words)
            for i in range(-seen % STRIDE, len(words), STRIDE):
                suffix = words[i : i + MAX_WORDS - 1]
                suffix = suffix[: suffix.index(b".")] if b"." in suffix else suffix
                sample.update(_head(lang) + b"".join(w + b" " for w in suffix[:m]) for m in range(1, len(suffix) + 1))
            seen += len(words)
        if sum(map(len, counts.values())) > HOLD:
            yield passed_on()
            counts, sample = {}, Counter()
    yield passed_on()


def _frequent_words(words: DataFrame, least: int) -> tuple[np.ndarray, int]:
    """Bitmap, and its size less one, of the hashes of words that occur often enough; not more than MAX_BITS."""
    often = words.where(F.col("n") >= least)
    bits = 1 << 16
    while bits < min(16 * often.count(), MAX_BITS):
        bits *= 2
    place = F.xxhash64("key").bitwiseAND(F.lit(bits - 1))
    slots = often.select(F.shiftright(place, 6).alias("slot"), F.expr("shiftleft(1L, cast(xxhash64(key) & 63 as int))").alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    found, bitmap = slots.toArrow(), np.zeros(bits // 64, np.int64)
    bitmap[found["slot"].to_numpy()] = found["bits"].to_numpy()
    return bitmap.view(np.uint64), bits - 1


class _Suffixes:
    """Words of one language as numbers; 0 stands for the end of a piece and for rare words."""

    def __init__(self, lang: str, bitmap: np.ndarray, mask: int, hot: list[list[bytes]]):
        self.head, self.bitmap, self.mask, self.hot = _head(lang), bitmap, mask, hot
        self.parts: list[np.ndarray] = []
        self.size = 0
        self._forget()

    def _forget(self):
        self.number: dict[bytes, int] = {b".": 0}
        self.names: list[bytes | None] = [None]
        self.hashes = [0]

    def add(self, words: list[bytes]):
        import xxhash

        for w in set(words).difference(self.number):
            h = xxhash.xxh64_intdigest(self.head + w + b" ", 42)
            if int(self.bitmap[(h & self.mask) >> 6]) >> (h & 63) & 1:
                self.number[w] = len(self.names)
                self.names.append(w + b" ")
                self.hashes.append(h)
            else:
                self.number[w] = 0
        self.parts.append(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))
        self.size += len(words)

    def _deal(self, word: list[np.ndarray]) -> np.ndarray:
        """A number for each suffix, the same for those that share its longest hot prefix and one word more."""
        hashes = np.array(self.hashes, np.uint64)
        deal = _mixed(hashes[word[0]])
        packed, rows = word[0], np.arange(len(word[0]))
        for size in range(1, MAX_WORDS):
            hot = [[self.number.get(w, 0) for w in p] for p in self.hot if len(p) == size]
            hot = [sum(x << 21 * k for k, x in enumerate(reversed(p))) for p in hot if all(p)]
            rows = rows[np.isin(packed[rows], hot)] if hot else rows[:0]
            deal[rows] = _mixed(deal[rows] + hashes[word[size][rows]])
            packed = (packed << 21) | word[size] if size < MAX_WORDS - 1 else packed
        return (deal & np.uint64(0x7FFF)).astype(np.int32)

    def passed_on(self, last: bool) -> pa.RecordBatch:
        """(deal, key, n) of the suffixes so far; those that may go on with words to come are kept back, unless it is the last time."""
        ids = np.concatenate((*self.parts, np.zeros(MAX_WORDS - 1 if last else 0, np.int64)))
        n = max(len(ids) - MAX_WORDS + 1, 0)
        rest, word = ids[n:], [ids[:n]]
        for k in range(1, MAX_WORDS):
            word.append(np.where(word[-1] == 0, 0, ids[k : n + k]))
        begun = np.flatnonzero(word[0])
        word = [w[begun] for w in word]
        low, high = (word[0] << 32) | word[1], (word[2] << 32) | word[3]
        order = np.lexsort((high, low))
        low, high = low[order], high[order]
        first = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])))) if len(order) else order
        counts = np.diff(np.append(first, len(order)))
        word = [w[order[first]] for w in word]
        names = pa.array(self.names, pa.large_binary())
        columns = [names.take(pa.array(w)) for w in word]
        keys = pc.binary_join_element_wise(pa.scalar(self.head, pa.large_binary()), *columns, pa.scalar(b"", pa.large_binary()), null_handling="skip")
        out = pa.RecordBatch.from_arrays([pa.array(self._deal(word)), keys.cast(pa.large_string()).cast(pa.string()), pa.array(counts)], ["deal", "key", "n"])
        held = [self.names[i] for i in rest]
        if len(self.number) > HOLD // 2:
            self._forget()
        self.parts, self.size = [], 0
        self.add([b"." if w is None else w[:-1] for w in held])
        return out


def _suffixes(batches: Iterator[pa.RecordBatch], frequent, hot) -> Iterator[pa.RecordBatch]:
    """Counted suffixes of rows (lang, text), each distinct one once for some MB of text."""
    bitmap, mask = frequent.value
    langs: dict[str, _Suffixes] = {}
    for lang, text in rows_of(batches):
        if lang not in langs:
            langs[lang] = _Suffixes(lang, bitmap, mask, hot.value.get(_head(lang), []))
        of = langs[lang]
        for words in words_of(text):
            of.add(words)
            if of.size > HOLD:
                yield of.passed_on(False)
        of.add([b"."])
        if sum(x.size for x in langs.values()) > 2 * HOLD:
            for x in langs.values():
                yield x.passed_on(True)
            langs = {}
    for x in langs.values():
        yield x.passed_on(True)


class _Stack:
    """Open prefixes and their counts so far, over rows (key, n) sorted by key."""

    def __init__(self, least: int, hot: list[bytes]):
        self.least, self.last = least, None
        self.hot: list[list[list[str]]] = [[p.decode().split(" ")[:-1] for p in hot if p.count(b" ") == m] for m in range(1, MAX_WORDS)] + [[]]
        self.sums = [0] * MAX_WORDS

    def closed(self, keys: pa.Array, n: np.ndarray, end: bool) -> Iterator[pa.RecordBatch]:
        # The last key of the rows before comes first, without a count, so that its prefixes are open.
        if self.last is not None:
            keys, n = pa.concat_arrays([pa.array([self.last]), keys]), np.concatenate(([0], n))
        if not len(keys):
            return
        parts = pc.split_pattern(keys, " ")
        at, values = parts.offsets.to_numpy(), parts.values.dictionary_encode()
        codes, size = values.indices.to_numpy().astype(np.int64), np.diff(at) - 1
        number = {w: i for i, w in enumerate(values.dictionary.to_pylist())}
        changed, packed = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        changed[0] = True
        for m in range(MAX_WORDS):
            word = np.where(m < size, codes[np.minimum(at[:-1] + m, len(codes) - 1)], -1)
            changed[1:] |= word[1:] != word[:-1]
            first = np.flatnonzero(changed)
            sums = np.add.reduceat(n, first)
            sums[0] += self.sums[m]
            self.sums[m] = 0 if end else int(sums[-1])
            there = word[first] >= 0
            if not end:
                there[-1] = False
            packed = (packed << 21) | (word & 0x1FFFFF) if m < MAX_WORDS - 1 else packed
            hot = [[number.get(w, -1) for w in p] for p in self.hot[m]]
            hot = [sum(x << 21 * k for k, x in enumerate(reversed(p))) for p in hot if min(p) >= 0]
            is_hot = np.isin(packed[first], hot) if hot else np.zeros(len(first), bool)
            told = np.flatnonzero(there & ((sums >= self.least) | is_hot))
            names = [" ".join(p[: m + 1]) for p in parts.take(pa.array(first[told])).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([m + 1] * len(names), pa.int32()), pa.array(sums[told], pa.int64()), pa.array(is_hot[told])], ["key", "m", "n", "part"])
        self.last = keys[-1].as_py()


def _prefixes(batches: Iterator[pa.RecordBatch], least: int, hot) -> Iterator[pa.RecordBatch]:
    stack = _Stack(least, [head + b"".join(w + b" " for w in p) for head, ps in hot.value.items() for p in ps])
    for batch in batches:
        yield from stack.closed(batch.column(0), batch.column(1).to_numpy(), False)
    yield from stack.closed(pa.array([], pa.string()), np.zeros(0, np.int64), True)


def count_phrases(docs: DataFrame, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((key, m, n), (head, total)): phrases of up to MAX_WORDS words that occur at least ``least`` times, and all words of each language.

    A key is the language in percent code, a tab and the words joined by blanks; a head is the
    language in percent code alone.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text"))
    context = session_of(docs).sparkContext
    told = written(texts.mapInArrow(_word_counts, "key string, n long, sampled boolean").groupBy("sampled", "key").agg(F.sum("n").alias("n")))
    words, sample = told.where("not sampled"), told.where("sampled")
    frequent = context.broadcast(_frequent_words(words, least))
    # A prefix is hot from a quarter of an even share of a partition on: at most 12 for each partition.
    spread = 4 * int(session_of(docs).conf.get("spark.sql.shuffle.partitions"))
    positions = sample.where(F.regexp_count("key", F.lit(" ")) == 1).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    found = sample.where(F.col("n") >= max(8, positions / spread)).select("key").collect()
    by_head: dict[bytes, list[list[bytes]]] = {}
    for row in found:
        head, _, rest = row.key.encode().partition(b"\t")
        by_head.setdefault(head + b"\t", []).append(rest.split(b" ")[:-1])
    hot = context.broadcast(by_head)
    suffixes = texts.mapInArrow(lambda b: _suffixes(b, frequent, hot), "deal int, key string, n long")
    dealt = suffixes.repartition("deal").select("key", "n").sortWithinPartitions(F.desc("key"))
    counted = written(dealt.mapInArrow(lambda b: _prefixes(b, least, hot), "key string, m int, n long, part boolean"))
    # Only hot prefixes come in parts.
    added = counted.where("part").groupBy("key", "m").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    totals = words.groupBy(F.substring_index("key", "\t", 1).alias("head")).agg(F.sum("n").alias("total"))
    return counted.where("not part").select("key", "m", "n").unionByName(added), totals


def mine(docs: DataFrame, least: int = LEAST, cover: int = COVER, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score), the ``top`` phrases of each language.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends and into words at
    blanks and tabs. A phrase of 2 to MAX_WORDS words that occurs a >= ``least`` times in a language is
    scored by floor(SCALE * a / (l + r)), l and r being the counts of the two parts of the cut
    that gives the lowest score (of equal ones the first); a phrase of which a longer frequent
    one holds ``cover`` hundredths of the occurrences is left out. Order: score, a (both falling),
    phrase by bytes. A null language is ``und``, a null text empty; rows alike count each;
    other columns are ignored; an empty table gives no row. Words and texts may be of any length.
    """
    phrases, totals = count_phrases(docs, least, lang_col, text_col)
    words = F.split(F.substring_index("key", "\t", -1), " ")
    head = F.substring_index("key", "\t", 1)
    part = lambda lo, size: F.concat("head", F.lit("\t"), F.array_join(F.slice("words", lo, size), " "))
    spelled = phrases.where("m > 1").select("key", "m", "n", head.alias("head"), words.alias("words"))
    inner = F.when(F.col("m") == 3, F.array(part(1, 2), part(2, 2)))
    inner = inner.when(F.col("m") == 4, F.array(part(1, 2), part(2, 2), part(3, 2), part(1, 3), part(2, 3)))
    held = spelled.where("m > 2").select(F.explode(inner).alias("key"), F.col("n").alias("longer"))
    own = spelled.select("key", F.col("n").alias("a"), F.lit(None).cast("long").alias("longer"))
    kept = (
        own.unionByName(held.select("key", F.lit(None).cast("long").alias("a"), "longer")).groupBy("key").agg(F.max("a").alias("a"), F.max("longer").alias("longer"))
        .where(F.col("a").isNotNull() & (F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * cover)))
        .select("key", "a", head.alias("head"), words.alias("words"))
    )
    size = F.size("words")
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.array(F.struct(k.alias("k"), F.lit("l").alias("side"), part(F.lit(1), k).alias("part")), F.struct(k.alias("k"), F.lit("r").alias("side"), part(k + 1, size).alias("part")))))
    sides = kept.select("key", "a", F.explode(cuts).alias("cut")).select("key", "a", "cut.k", "cut.side", "cut.part")
    counts = phrases.select(F.col("key").alias("part"), F.col("n").alias("f"))
    side = lambda s, k: F.max(F.when((F.col("side") == s) & (F.col("k") == k), F.col("f"))).alias(f"{s}{k}")
    found = sides.join(counts, "part").groupBy("key", "a").agg(*(side(s, k) for k in range(1, MAX_WORDS) for s in "lr"))
    score = lambda k: F.expr(f"cast((cast(a as decimal(20)) * {SCALE}BD) div (cast(l{k} as decimal(20)) + cast(r{k} as decimal(20))) as long)")
    options = F.array(*(F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, MAX_WORDS)))
    scored = found.select("key", "a", F.array_min(options).alias("best")).select(head.alias("head"), F.substring_index("key", "\t", -1).alias("phrase"), "a", "best.l", "best.r", "best.score")
    # First the best of parts of a language, so that no task sees all of its phrases.
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    spread = int(session_of(docs).conf.get("spark.sql.shuffle.partitions"))
    scored = scored.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(spread)))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("head", "deal").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("head").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "head").select(F.url_decode("head").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
