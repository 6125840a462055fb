"""Benchmark decontamination (operator 9).

The windows of all benchmark items are the patterns of one Aho-Corasick automaton; each
document's text is normalised to words between single spaces, scanned once, and the hits
are mapped back to offsets in the original text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import written

#: Words of one window.
WINDOW = 10
#: Bytes of the windows (about ten times the text) that one automaton may hold. A larger
#: benchmark is dealt to several automata; the documents are then scanned once for each,
#: one after the other.
MAX_AUTOMATON_BYTES = 8 << 20
#: An item is dealt in pieces of so many words, which share all but one words of a window.
PIECE_WORDS = 2000

#: Bytes that are no part of a word become spaces, A-Z become a-z, all bytes of non-ASCII characters stay.
_NORMAL = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def normal_words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def windows(words: list[bytes], size: int) -> set[bytes]:
    """Each window as words between single spaces; fewer words than a window, but not none, are one."""
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def _pieces(size: int):
    """Rows (item, text) to its pieces of normal words in UTF-8, with the bytes of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = normal_words(text)
                for lo in range(0, max(1, len(words) - size + 1), PIECE_WORDS):
                    piece = words[lo : lo + PIECE_WORDS + size - 1]
                    out.append((item, b" ".join(piece), sum(map(len, windows(piece, size)))))
            items, pieces, sizes = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(pieces, pa.binary()), pa.array(sizes, pa.int64())], ["item", "words", "n_bytes"])

    return run


def _automaton(items: list[tuple[str, bytes]], size: int):
    """Automaton with (index of the pattern, its words), and for each pattern its items, of (item, words)."""
    import ahocorasick

    owners: dict[bytes, list[int]] = {}
    for k, (_, words) in enumerate(items):
        for w in windows(words.split(), size):
            owners.setdefault(w, []).append(k)
    found = ahocorasick.Automaton()
    for i, w in enumerate(owners):
        found.add_word(f" {w.decode('latin-1')} ", (i, w.count(b" ") + 1))
    if owners:
        found.make_automaton()
    return found if owners else None, list(owners.values())


_BUILT: dict[object, tuple] = {}


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         item_id: str = "item_id", item_text: str = "text", spans: bool = False) -> DataFrame:
    """(id, n_words, n_hit, item_ids sorted as strings, and spans if asked for), one row for each input row.

    A span is a struct (start, end) of code points in the original text that covers hit
    words that follow one another. Null or wordless texts have no words and no hits; rows
    with the same id stay rows of their own; repeated items count once for each item id;
    items without words or with a null id are left out; an empty benchmark hits nothing.
    Other columns are ignored. Documents are scanned in the map stage of the read and are
    never shuffled. The benchmark is dealt into parts of about MAX_AUTOMATON_BYTES,
    measured before anything is sent; each part costs one scan, and a written table of what
    was found so far, so that only one automaton is in memory at a time.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null").distinct()
    pieces = items.mapInArrow(_pieces(window), "item string, words binary, n_bytes long")
    n_bytes = pieces.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-n_bytes // MAX_AUTOMATON_BYTES))
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    out = out.withColumn("_hit", F.lit(None).cast("binary")).withColumn("_items", F.array().cast("array<string>"))
    for part in range(parts):
        rows = pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == part).select("item", "words").collect()
        shared = docs.sparkSession.sparkContext.broadcast([(r["item"], bytes(r["words"])) for r in rows])
        if part < parts - 1:
            out = written(out.mapInArrow(_scanner(shared, window), f"_id {kind}, _text string, _hit binary, _items array<string>"))
            shared.unpersist()
    fields = f"_id {kind}, n_words long, n_hit long, item_ids array<string>" + ", spans array<struct<start: int, end: int>>" * spans
    last, finish = _scanner(shared, window), _finisher(spans)
    return out.mapInArrow(lambda batches: finish(last(batches)), fields).withColumnRenamed("_id", id_col)


def _scanner(shared, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        # One automaton for each broadcast in a worker that serves many tasks.
        key = (shared.id if hasattr(shared, "id") else id(shared), window)
        items = shared.value
        if _BUILT.get("key") != (key, items):
            _BUILT.clear()
            _BUILT.update(key=(key, items), built=_automaton(items, window))
        automaton, owners = _BUILT["built"]
        for batch in batches:
            hits, names = [], []
            for text, before, known in zip(batch.column(1), batch.column(2), batch.column(3)):
                before, known = before.as_py(), known.as_py() or []
                found = set()
                if automaton is not None and (words := normal_words(text.as_py())):
                    flat = b" " + b" ".join(words) + b" "
                    matches = list(automaton.iter(flat.decode("latin-1")))
                    if matches:
                        spaces = np.flatnonzero(np.frombuffer(flat, np.uint8) == 0x20)
                        flags = np.zeros(len(words) + 1, np.int64)
                        ends = np.searchsorted(spaces, np.fromiter((end for end, _ in matches), np.int64, len(matches)))
                        sizes = np.fromiter((n for _, (_, n) in matches), np.int64, len(matches))
                        np.add.at(flags, ends - sizes, 1)
                        np.add.at(flags, ends, -1)
                        bits = np.cumsum(flags[:-1]) > 0
                        if before is not None:
                            bits |= np.frombuffer(before, np.uint8).astype(bool)
                        before = bits.astype(np.uint8).tobytes()
                        found = {k for i in {i for _, (i, _) in matches} for k in owners[i]}
                hits.append(before)
                names.append(known + [items[k][0] for k in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(hits, pa.binary()), pa.array(names, pa.list_(pa.string()))], ["_id", "_text", "_hit", "_items"])

    return run


def _finisher(spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, names, where = [], [], [], []
            for text, hit, known in zip(batch.column(1), batch.column(2), batch.column(3)):
                raw, bits = (text.as_py() or "").encode("utf-8", "surrogatepass"), hit.as_py()
                n_words.append(len(raw.translate(_NORMAL).split()))
                n_hit.append(sum(bits) if bits else 0)
                names.append(sorted(set(known.as_py() or [])))
                where.append(original_spans(raw, bits) if spans and bits else [])
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string()))]
            if spans:
                columns.append(pa.array(where, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(columns, ["_id", "n_words", "n_hit", "item_ids", "spans"][: len(columns)])

    return run


def original_spans(raw: bytes, bits: bytes) -> list[dict[str, int]]:
    """Code point spans of runs of hit words; bits has one byte for each word of the UTF-8 text."""
    import numpy as np

    inside = np.frombuffer(raw.translate(_NORMAL), np.uint8) != 0x20
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    run = np.diff(np.concatenate(([0], np.frombuffer(bits, np.uint8).astype(np.int8), [0])))
    return [{"start": int(chars[starts[a]]), "end": int(chars[ends[b - 1]])} for a, b in zip(np.flatnonzero(run == 1), np.flatnonzero(run == -1))]


def digest_items(names) -> F.Column:
    """Lowercase hex SHA-256 of the ids, comma-joined."""
    return F.sha2(F.array_join(names, ","), 256)


def item_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
