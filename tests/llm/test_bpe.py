import base64
import hashlib
import random
import struct

import public_tokenizers as vocabularies
import pytest
import tiktoken

from tramline.llm import bpe, queries

PATH = vocabularies.path(queries.VOCABULARY)


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return bpe.codec(f.read(), vocabularies.PATTERN)


EDGES = ["", " ", "  a", "a  b", "a \n b", "\n\n", "a" * 3000, "ab" * 2000, " " * 400, "12345 678", "日本語 テスト", "'s'll''re", "x\t \ty", "a b c", " lead", "trail ", "é" * 999]


def test_edge_texts_equal_the_reference(codec, reference):
    for text in EDGES:
        ids = codec.encode(text)
        assert ids == reference.encode_ordinary(text), text[:40]
        assert codec.decode(ids) == text.encode()


def test_random_texts_equal_the_reference(codec, reference):
    draw = random.Random(3)
    parts = ["a", "e", "th", "the", " ", "  ", "\n", "É", "ß", "1", "'s", "!", "漢", "ing", "tion", " ", "　"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 30)))
        assert codec.encode(text) == reference.encode_ordinary(text)


def test_rows_and_round_trip(spark, reference):
    rows = [(1, None, "x"), (1, "twice the id", "y"), (1, "twice the id", "y"), (None, "no id", "z"), (2, "", "w"), (3, "long " * 20000, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.encode_documents(docs, PATH, vocabularies.PATTERN)
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()), key=repr)
    want = []
    for i, text, _ in rows:
        ids = reference.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    back = bpe.decode_documents(out, PATH, vocabularies.PATTERN)
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted((t or "").encode() for _, t, _ in rows)


def test_empty_table(spark):
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string"), PATH, vocabularies.PATTERN).count() == 0


def test_a_vocabulary_above_the_cap_is_refused(spark, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_VOCABULARY_BYTES", 1000)
    docs = spark.createDataFrame([(1, "a", [1])], "doc_id long, text string, token_ids array<int>")
    for call in (bpe.encode_documents, bpe.decode_documents):
        with pytest.raises(ValueError):
            call(docs, PATH, vocabularies.PATTERN)


def test_long_pieces_are_not_remembered(codec, reference):
    text = "start " + "x" * 5000 + " " + "y" * 4000 + " end"
    assert codec.encode(text) == reference.encode_ordinary(text)
    assert max(map(len, [*codec.pieces, *codec.chunks])) <= bpe.LONG_PIECE


def test_query_against_the_reference(spark, sf_dir, reference):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = {}
    for d in docs:
        ids = reference.encode_ordinary(d.text or "")
        want[d.doc_id] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op10_byte_bpe(spark, sf_dir).collect()} == want
