"""Byte-level BPE encoding and decoding (operator 10).

Text is cut by a pre-tokenising pattern; each piece is encoded by backtracking over
longest matches: from each position the longest vocabulary entry is tried first, then
its shorter prefixes, and an entry is taken only if it may stand right of the one before
it, that is, if merging by rank would not have joined across their border. That test
depends on the two entries alone and is memoised, which makes the walk linear. The
entries that start at each position come from one Aho-Corasick automaton over the
reversed entries (bytes as Latin-1 characters), run over the reversed piece.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A vocabulary file above this size is refused: it is sent to every executor.
MAX_VOCABULARY_BYTES = 64 << 20
#: Encoded pieces that a Python worker remembers; those of more characters than LONG_PIECE are encoded anew.
MAX_PIECES, LONG_PIECE = 400_000, 128


class ByteBpe:
    """Encoder and decoder for ranks in the tiktoken file format (base64 entry, rank)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.entry = {rank: token for token, rank in ranks.items()}
        self.rank = ranks
        self.split = regex.compile(pattern).findall
        self.starts = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.starts.add_word(token[::-1].decode("latin-1"), (rank, len(token)))
        self.starts.make_automaton()
        self.shorter: dict[int, int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        # Ranks ascend, so the halves of an entry are known before the entry.
        for rank in sorted(self.entry):
            token = self.entry[rank]
            for end in range(len(token) - 1, 0, -1):
                if (left := ranks.get(token[:end])) is not None:
                    self.shorter.setdefault(rank, left)
                    right = ranks.get(token[end:])
                    if right is not None and left < rank and right < rank and self._fit(left, right):
                        self.merged[left, right] = rank
                        self.halves[rank] = (left, right)
                        break
        self.fits.clear()
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}

    def _fit(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves the border between the two entries alone.

        The merges are undone from the latest on, on both sides of the border; the border
        holds unless two parts that touch it merge earlier than the part they were in.
        """
        before = 1 << 62
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and joined < before:
                return False
            inner_left, inner_right = self.halves.get(left), self.halves.get(right)
            if left > right and inner_left or not inner_right:
                if not inner_left:
                    return True
                before, left = left, inner_left[1]
            else:
                before, right = right + 1, inner_right[0]

    def _may_follow(self, left: int, right: int) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > 4 * MAX_PIECES:
                self.fits.clear()
            known = self.fits[left, right] = self._fit(left, right)
        return known

    def piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece of the pattern."""
        raw = piece.encode("utf-8", "surrogatepass")
        if (whole := self.rank.get(raw)) is not None:
            return (whole,)
        n = len(raw)
        longest: list[tuple[int, int] | None] = [None] * n
        for end, (rank, size) in self.starts.iter(raw[::-1].decode("latin-1")):
            at = n - 1 - end
            if longest[at] is None or size > longest[at][1]:
                longest[at] = (rank, size)
        out: list[int] = []
        dead = bytearray(n + 1)
        at, rank = 0, longest[0][0]
        entry, shorter = self.entry, self.shorter
        while at < n:
            end = at + len(entry[rank])
            if not dead[end] and (not out or self._may_follow(out[-1], rank)):
                out.append(rank)
                at = end
                if at < n:
                    rank = longest[at][0]
            elif rank in shorter:
                rank = shorter[rank]
            else:
                dead[at] = 1
                rank = out.pop()
                at -= len(entry[rank])
        return tuple(out)

    def _remembered(self, known: dict[str, tuple[int, ...]], texts: list[str], encode: Callable[[str], tuple[int, ...]]) -> list[int]:
        """Ids of the texts one after the other; short ones are encoded once and remembered."""
        if len(known) > MAX_PIECES:
            known.clear()
        new = set(texts).difference(known)
        for t in new:
            known[t] = encode(t)
        out = list(chain.from_iterable(map(known.__getitem__, texts)))
        for t in new:
            if len(t) > LONG_PIECE:
                del known[t]
        return out

    def _pieces(self, text: str) -> list[int]:
        return self._remembered(self.pieces, self.split(text), self.piece)

    def encode(self, text: str) -> list[int]:
        """Ids of a text.

        No piece of the pattern goes on over a space between two characters that are no
        white space. So what lies between such spaces is encoded once and remembered; a
        text with other white space beside a space goes through the pattern as a whole.
        """
        first, *rest = text.split(" ")
        if not rest:
            return self._pieces(text)
        *rest, last = rest
        if first[-1:].isspace() or last[:1].isspace() or not last or any(not c or c[0].isspace() or c[-1].isspace() for c in set(rest).difference(self.chunks)):
            return self._pieces(text)
        return [*self._pieces(first), *self._remembered(self.chunks, rest, lambda c: tuple(self._pieces(" " + c))), *self._pieces(" " + last)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.entry.__getitem__, ids))


_CODECS: dict[tuple[str, str], ByteBpe] = {}


def codec(vocabulary: bytes, pattern: str) -> ByteBpe:
    """One codec for each vocabulary in a Python process."""
    key = (hashlib.sha256(vocabulary).hexdigest(), pattern)
    if key not in _CODECS:
        rows = (line.split() for line in vocabulary.splitlines() if line.strip())
        _CODECS[key] = ByteBpe({base64.b64decode(token): int(rank) for token, rank in rows}, pattern)
    return _CODECS[key]


def _vocabulary(path: str) -> bytes:
    """The vocabulary file, whole, or an error if it is too large to send."""
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary of more than {MAX_VOCABULARY_BYTES} bytes")
    return raw


def encode_documents(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                     keep_ids: bool = True) -> DataFrame:
    """(id, n_tokens, token_ids, ids_sha256, decoded_sha256), one row for each input row.

    Null text counts as empty: no tokens. Rows with the same id stay rows of their own, a
    null id stays null, other columns are ignored. Texts are taken whole, one at a time,
    in the map stage of the scan; nothing is shuffled. The vocabulary is read on the
    driver, is refused above MAX_VOCABULARY_BYTES, and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bpe = codec(shared.value, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                counts, all_ids, digests, decoded = [], [], [], []
                for text in part.column(1):
                    ids = bpe.encode(text.as_py() or "")
                    packed = np.array(ids, dtype="<u4")
                    counts.append(len(ids))
                    all_ids.append(packed.astype(np.int32) if keep_ids else None)
                    digests.append(hashlib.sha256(packed.tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                names = ["_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * keep_ids
    return (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
        .mapInArrow(run, schema)
        .withColumnRenamed("_id", id_col)
    )


def decode_documents(encoded: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(id, decoded binary) of token ids; a null list decodes to no bytes. An unknown id and a vocabulary above MAX_VOCABULARY_BYTES raise."""
    shared = encoded.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(shared.value, pattern)
        for batch in batches:
            out = [bpe.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["_id", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return (
        encoded.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"))
        .mapInArrow(run, f"_id {kind}, decoded binary").withColumnRenamed("_id", id_col)
    )
