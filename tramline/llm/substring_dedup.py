"""Substring dedup (operator 8): suffix automata of reference shards, streamed with matching statistics.

Every window of WINDOW words holds an anchor, the least hash among its runs of ANCHOR words;
equal windows hold equal anchors. So the corpus is dealt by anchors: what lies around the
occurrences of one anchor that at least two documents share is a reference shard. Equal
contexts of an anchor are one (of the least document); each shard of distinct contexts
becomes a suffix automaton whose states know the least document they occur in, and all
contexts of that anchor are streamed through it: where a match is at least a window long,
the state tells whether an earlier document has that window. Shards of more than SHARD
contexts are split, and the contexts go through each part, dealt over several tasks
that each build the part's automaton; contexts that are no references are never held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import emptied, lookup, written
from tramline.llm.streams import groups_of

WINDOW, ANCHOR = 50, 25
#: Contexts (of up to 2 * WINDOW - ANCHOR words) that one automaton holds.
SHARD = 2000
#: A split anchor's contexts are streamed through each shard in one part for every SPREAD shards.
SPREAD = 8

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
NONE = (1 << 63) - 1
#: Words of more bytes are hashed one by one; texts of about PART bytes are hashed together.
LONG_WORD, PART = 256, 1 << 20
#: The bytes between words, and the first 0 to 8 bytes of a number.
SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of other characters than space, tab, newline, vertical tab, form feed and carriage return, in UTF-8."""
    return (text or b"").split()


def hashes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after the other, and the number of words of each text.

    A word's length and its first eight bytes are mixed, then eight more at a time at a mixed joint; a word of more than LONG_WORD bytes is hashed by xxh3.
    """
    import xxhash

    raw = b" ".join((b"", *texts, bytes(8)))
    data = np.frombuffer(raw, np.uint8)
    apart = SPACE[data]
    apart[-8:] = True
    edge = np.flatnonzero(apart[1:] != apart[:-1]) + 1
    start, size = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    out = _mixed(_mixed(size.astype(np.uint64) * _BASE) + (eight[start] & _FIRST[np.minimum(size, 8)]))
    some, at = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(some):
        out[some] = _mixed(out[some] * _BASE + (eight[start[some] + at] & _FIRST[np.minimum(size[some] - at, 8)]))
        at += 8
        some = some[size[some] > at]
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] = xxhash.xxh3_64_intdigest(raw[start[k] : start[k] + size[k]], 8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return out, np.diff(np.searchsorted(start, ends + 1), prepend=0)


def _parts(batch: pa.RecordBatch, texts: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows, with about PART bytes of text or a single row."""
    at, ends = 0, np.cumsum(pc.binary_length(batch.column(texts)).to_numpy(zero_copy_only=False))
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, "right"))
        to = min(max(to, at + 1), at + rows)
        yield batch.slice(at, to - at)
        at = to


def run_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words: those of 1, 2, 4, ... words, put together by the bits of the size.

    Each joint is mixed, so no sums of words cancel out as they may in a polynomial modulo 2**64.
    """
    total, width, power, at = None, 0, ids, 1
    while True:
        if size & at:
            n = len(ids) - width - at + 1
            total = power[:n] if total is None else _mixed(total[:n] * _BASE + power[width : width + n])
            width += at
        if width == size:
            return total
        power, at = _mixed(power[: len(power) - at] * _BASE + power[at:]), 2 * at


def _sliding(x: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    """np.minimum or np.maximum of each ``size`` neighbours, by doubling."""
    width = 1
    while 2 * width <= size:
        x, width = best(x[: len(x) - width], x[width:]), 2 * width
    rest = size - width
    return best(x[: len(x) - rest], x[rest:]) if rest else x


def anchors_of(ids: np.ndarray, sizes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the texts, positions in them, hashes and context hashes of the anchors of all windows; ids of texts of so many words."""
    n = len(ids)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    grams = run_hashes(ids, anchor)
    size = window - anchor + 1
    least = _sliding(grams, size, np.minimum)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    # A window over the end of its text is none.
    least[text[: n - window + 1] != text[window - 1 :]] = 0
    # A run is an anchor if it is the least of a window that it lies in; equal least ones all are.
    pad = np.zeros(size - 1, np.uint64)
    pos = np.flatnonzero(_sliding(np.concatenate((pad, least, pad)), size, np.maximum) == grams)
    pos = pos[(text[pos] == text[pos + anchor - 1]) & (sizes[text[pos]] >= window)]
    text, begin, stop = text[pos], (ends - sizes)[text[pos]], ends[text[pos]]
    start, end = np.maximum(pos - (window - anchor), begin), np.minimum(pos + window, stop)
    shape = (pos - start).astype(np.uint64) * np.uint64(1 << 20) + (end - start).astype(np.uint64)
    # The runs at the start, at the anchor and at the end leave no word of the context out.
    around = _mixed(_mixed(grams[start] + shape) * _BASE + grams[end - anchor])
    return text, pos - begin, grams[pos], _mixed(around ^ grams[pos])


class SuffixAutomaton:
    """Of several word sequences; each state knows the least document that any of its words runs occurs in."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [NONE]

    def _state(self, length: int, link: int, edges: dict[int, int], least: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.least.append(least)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """The state of the longest run that ends p + word; q itself, or a copy of it that is shorter."""
        if self.length[p] + 1 == self.length[q]:
            return q
        short = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), NONE)
        self.link[q] = short
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = short
            p = self.link[p]
        return short

    def add(self, words: list[int], document: int) -> None:
        edges, link, length, least, last = self.next, self.link, self.length, self.least, 0
        for word in words:
            if (q := edges[last].get(word)) is not None:
                last = q if length[last] + 1 == length[q] else self._split(last, q, word)
                if document < least[last]:
                    least[last] = document
                continue
            new, p = len(edges), last
            edges.append({})
            link.append(0)
            length.append(length[last] + 1)
            least.append(document)
            while p >= 0 and word not in edges[p]:
                edges[p][word] = new
                p = link[p]
            if p >= 0:
                link[new] = self._split(p, edges[p][word], word)
            last = new

    def close(self) -> None:
        """Hand the least documents down the suffix links, from long runs to short ones."""
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up = self.link[v]
            if up > 0 and self.least[v] < self.least[up]:
                self.least[up] = self.least[v]

    def least_documents(self, words: list[int], window: int) -> list[int]:
        """For each window of the words the least document that has it, or NONE: matching statistics, cut to a window."""
        out, v, size = [], 0, 0
        link, length, least, edges = self.link, self.length, self.least, self.next
        for k, word in enumerate(words, 1):
            while (to := edges[v].get(word)) is None and v:
                v = link[v]
                size = length[v]
            if to is not None:
                v = to
                size += 1
            while size >= window and length[link[v]] >= window:
                v = link[v]
                size = length[v]
            if k >= window:
                out.append(least[v] if size >= window else NONE)
        return out


def _find_anchors(window: int, anchor: int, no_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 2, 512):
                doc, t = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                text, pos, h, c = anchors_of(*hashes_of([x.as_py() if i != no_id else b"" for i, x in zip(doc, part.column(2))]), window, anchor)
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc[text], pa.int64()), pa.array(t[text], pa.int32()),
                    pa.array(pos.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(c.view(np.int64))], ["_id", "_t", "pos", "h", "c"])

    return run


def _contexts(window: int, anchor: int):
    """Rows (_id, _text, wanted array of (h, c, pos, n_shards)) to the words of each wanted context, without those of the anchor.

    Before the words stands how many of them lie left of the anchor, which is the same in all contexts of h. One row for each other shard than its own, in the context's part of it, of kind 2; in
    all parts of its own shard it is a reference: of kind 1 in its own part, of kind 0 in the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 1, 64):
                docs, texts, all_wanted = (x.to_pylist() for x in part.columns)
                hashes, sizes = hashes_of(texts)
                out = []
                for doc, ids, wanted in zip(docs, np.split(hashes, np.cumsum(sizes)[:-1]), all_wanted):
                    for w in wanted:
                        pos = w["pos"]
                        left = ids[max(pos - (window - anchor), 0) : pos]
                        context = np.uint64(len(left)).tobytes() + left.tobytes() + ids[pos + anchor : pos + window].tobytes()
                        own = (w["c"] >> 7) % w["n_shards"]
                        parts = -(-w["n_shards"] // SPREAD)
                        part_of = (w["c"] >> 27) % parts
                        out += [(w["h"], k * parts + part_of, doc, w["c"], 1 if k == own else 2, context) for k in range(w["n_shards"])]
                        out += [(w["h"], own * parts + k, doc, w["c"], 0, context) for k in range(parts) if k != part_of]
                columns = list(zip(*out)) if out else [()] * 6
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["h", "shard", "_id", "c", "kind", "words"])

    return run


def _stream(window: int, anchor: int = ANCHOR):
    """Rows (h, shard, _id, c, kind, words) sorted by h, shard and kind to (a, c, least document of each window), a being the upper half of h.

    References come first. Only they (about SHARD at most), their automaton and 2000 results
    are held, however many contexts a group has. The words of the anchor are numbers from
    2**64 on: all contexts of a group have the same ones. Windows that are equal with the
    anchor at another place hold it twice, and are found by the context of the other place.
    """
    middle = [(1 << 64) + k for k in range(anchor)]

    def ids_of(words: bytes) -> list[int]:
        at, *ids = np.frombuffer(words, np.uint64).tolist()
        return [*ids[:at], *middle, *ids[at:]]

    def batch_of(out: list[tuple[int, int, list[int]]]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["a", "c", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (h, _), rows in groups_of(batches, 2):
            a = h >> 32
            automaton, own, closed = SuffixAutomaton(), [], False
            for _, _, doc, c, kind, words in rows:
                ids = ids_of(words)
                if kind < 2:
                    automaton.add(ids, doc)
                    own += [(c, words)] if kind == 1 else []
                    continue
                if not closed:
                    automaton.close()
                    closed = True
                out.append((a, c, automaton.least_documents(ids, window)))
                if len(out) >= 2000:
                    yield batch_of(out)
                    out = []
            if not closed:
                automaton.close()
            out += [(a, c, automaton.least_documents(ids_of(words), window)) for c, words in own]
            if len(out) >= 2000:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    return run


def _remove(window: int, keep_text: bool):
    """Rows (_id, _text, spans): spans are first and last start of covered windows, packed in a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2)
            flat, ends = spans.values.to_numpy(zero_copy_only=False), spans.offsets.to_numpy()
            sizes, gone, digests, texts = [], [], [], []
            for k, text in enumerate(batch.column(1)):
                words = words_of(text.as_py())
                own = flat[ends[k] : ends[k + 1]] if ends[k] < ends[k + 1] else ()
                kept = words
                if len(own):
                    # A window that would reach over the end of the text is none.
                    first, last = own >> 32, np.minimum(own & 0xFFFFFFFF, len(words) - window)
                    change = np.zeros(len(words) + 1, np.int64)
                    some = first <= last
                    np.add.at(change, first[some], 1)
                    np.add.at(change, last[some] + window, -1)
                    left = np.flatnonzero(np.cumsum(change[:-1]) == 0)
                    kept = [words[i] for i in left.tolist()]
                joined = b" ".join(kept)
                sizes.append(len(words))
                gone.append(len(words) - len(kept))
                digests.append(hashlib.sha256(joined).hexdigest())
                texts.append(joined.decode("utf-8", "surrogatepass") if keep_text else None)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                ["_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR,
                shard: int = SHARD, keep_text: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept_text), one row for each input row; ids are long.

    Words that a window of ``window`` consecutive words covers go if the same window occurs
    in a document of a smaller id; windows are those of the input. Kept words are joined by
    single spaces. Null texts have no words. Rows of one id never count as earlier than
    each other; a row with a null id stays whole and is no reference (and -2**63 is no id). Other columns are
    ignored. Words and runs are compared by 64-bit hashes, contexts by 96 bits; words and runs are hashed by
    mixing at each joint, of eight bytes or two runs (words of over LONG_WORD bytes by xxh3).
    """
    if window > 2 * anchor or anchor > window:
        raise ValueError("an anchor has at least half of the words of a window, and at most all of them")
    # No column is nullable, so that both joins below read one and the same exchange of the texts.
    no_id = -(1 << 63)
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(no_id)).alias("_id"), F.coalesce(F.pmod(F.xxhash64(F.col(text_col).cast("string")), F.lit(1 << 31)).cast("int"), F.lit(0)).alias("_t"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_text"))
    # Written, because the texts would be hashed again for each of the two ways on.
    anchors = written(rows.mapInArrow(_find_anchors(window, anchor, no_id), "_id long, _t int, pos int, h long, c long"))
    repeated = anchors.select("h", "_id").groupBy("h").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi")).where("lo < hi").select("h")
    found = written(lookup(anchors, repeated, "h", "_id"))
    emptied(anchors)

    left = window - anchor
    begin = F.greatest(F.col("pos") - left, F.lit(0)).cast("long")
    span = lambda lo, hi: F.shiftleft(lo.cast("long"), 32) + hi.cast("long")
    contexts = found.groupBy("h", "c").agg(F.min(F.struct("_id", "_t", "pos")).alias("first"))
    counts = contexts.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(shard))).cast("int").alias("n_shards"))
    wanted = lookup(contexts, counts, "h", "c").groupBy(F.col("first._id").alias("_id"), F.col("first._t").alias("_t")).agg(
        F.collect_list(F.struct("h", "c", F.col("first.pos").alias("pos"), "n_shards")).alias("wanted"))
    # Only the first of rows with the same id and text gives its words.
    parts = rows.join(wanted, ["_id", "_t"]).select("_id", "_text", "wanted").mapInArrow(
        _contexts(window, anchor), "h long, shard int, _id long, c long, kind int, words binary")
    least = parts.repartition("h", "shard").sortWithinPartitions("h", "shard", "kind").mapInArrow(_stream(window, anchor), "a int, c long, least array<long>")
    least = least.groupBy("a", "c", "least").agg(F.lit(1).alias("_one")).select("a", "c", "least")
    starts = F.filter(F.transform("least", lambda x, k: F.when(x < F.col("_id"), begin + k)), lambda x: x.isNotNull())
    ends = (F.array_min("s"), F.array_max("s"))
    # Mostly the covered windows follow each other and are one span.
    packed = F.when(ends[1] - ends[0] + 1 == F.size("s"), F.array(span(*ends))).otherwise(F.transform("s", lambda x: span(x, x)))
    # A context is one by its hash and half of its anchor's, 96 bits; that the other half differs would be one more chance in 2**32.
    # The half goes along with the text's number in one long, as rows of these are the most that is dealt here.
    low = F.lit((1 << 32) - 1)
    placed = found.select("_id", "pos", "c", F.shiftleft(F.col("_t").cast("long"), 32).bitwiseOR(F.shiftright("h", 32).bitwiseAND(low)).alias("_ta"))
    covered = lookup(placed, least, "c", "_id").where(F.col("_ta").bitwiseAND(low) == F.col("a").cast("long").bitwiseAND(low))
    covered = covered.select("_id", F.shiftright("_ta", 32).cast("int").alias("_t"), starts.alias("s")).where("size(s) > 0").select("_id", "_t", F.explode(packed).alias("span"))

    spans = covered.groupBy("_id", "_t").agg(F.collect_list("span").alias("spans"))
    return rows.join(spans, ["_id", "_t"], "left").select("_id", "_text", "spans").mapInArrow(
        _remove(window, keep_text), "_id long, n_words long, n_removed long, kept_sha256 string, kept_text string").select(
        F.nullif("_id", F.lit(no_id)).alias(id_col), "n_words", "n_removed", "kept_sha256", "kept_text")
