import hashlib
import random
import re

from tramline.llm import substring_dedup as sd


def brute(docs, window):
    first, words = {}, {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def rows(frame, **options):
    return {r[0]: tuple(r)[1:] for r in sd.deduplicate(frame, **options).collect()}


def test_small_alphabet_against_brute_force(spark):
    draw = random.Random(5)
    docs = [(i, " ".join(draw.choice("abc") for _ in range(draw.randint(0, 60)))) for i in range(120)] + [(500, None), (501, " \t\n"), (502, "a " * 300)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, h int")
    assert rows(frame, window=6, anchor=3, shard=7) == brute(docs, 6)
    assert rows(frame, window=6, anchor=3) == brute(docs, 6)


def test_passages_against_brute_force(spark):
    draw = random.Random(6)
    words = [f"w{k}é" for k in range(900)]
    passage = [[draw.choice(words) for _ in range(draw.randint(45, 90))] for _ in range(6)]
    docs = []
    for i in range(80):
        text = [draw.choice(words) for _ in range(draw.randint(0, 120))]
        for _ in range(draw.randint(0, 2)):
            at, copy = draw.randint(0, len(text)), list(draw.choice(passage))
            if draw.random() < 0.3:
                copy[draw.randrange(len(copy))] = "changed"
            text[at:at] = copy
        docs.append((i * 3, " ".join(text)))
    assert rows(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs, 50)


def test_repeated_ids_null_ids_empty_table(spark):
    text = " ".join(map(str, range(60)))
    frame = spark.createDataFrame([(1, text), (1, text), (1, "x " + text), (None, text), (2, text)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in sd.deduplicate(frame).collect()), key=repr)
    assert got == sorted([(1, 60, 0), (1, 60, 0), (1, 61, 0), (None, 60, 0), (2, 60, 60)], key=repr)
    assert sd.deduplicate(frame.limit(0)).count() == 0


def test_contexts_of_one_group_are_streamed_not_held():
    import numpy as np
    import pyarrow as pa

    read, n = [], 40
    words = np.arange(6, dtype=np.uint64).tobytes()

    def batches():
        for b in range(n):
            read.append(b)
            kinds = [1 if b == 0 else 2] * 500
            rows = [[7] * 500, [0] * 500, range(b * 500, b * 500 + 500), range(b * 500, b * 500 + 500), kinds, [words] * 500]
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, types)], ["h", "shard", "_id", "c", "kind", "words"])

    out = sd._stream(6)(batches())
    got = next(out)
    assert got.num_rows == 2000 and len(read) < 8
    assert got.num_rows + sum(b.num_rows for b in out) == n * 500


def test_streamed_contexts_of_a_split_anchor_are_dealt_over_parts():
    import numpy as np
    import pyarrow as pa

    draw = random.Random(8)
    wanted = [[{"h": 5, "c": draw.getrandbits(62), "pos": 0, "n_shards": 32}] for _ in range(640)]
    kind = pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64()), ("pos", pa.int32()), ("n_shards", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(640), pa.int64()), pa.array([b"a b c d e f"] * 640, pa.binary()), pa.array(wanted, kind)], ["_id", "_text", "wanted"])
    rows = [r for b in sd._contexts(6, 3)([batch]) for r in zip(*(b.column(k).to_pylist() for k in (1, 3, 4)))]
    assert len(rows) == 640 * (32 + 3)  # each other shard once, its own four parts
    assert sorted(c for _, c, k in rows if k == 1) == sorted(w[0]["c"] for w in wanted)
    assert np.bincount([s for s, _, _ in rows]).max() < 640 / 2


def thue_morse(n, a, b):
    text = a
    other = b
    while len(text) < n:
        text, other = text + other, other + text
    return text[:n]


def test_structured_words_and_runs_do_not_collide(spark):
    words = [f"v{k}" for k in range(59)]
    a, b = (thue_morse(1024, *x) for x in ("ab", "ba"))
    c, d = (" ".join(thue_morse(2048, *x)) for x in ("xy", "yx"))
    docs = [(1, " ".join([*words[:30], a, *words[30:]])), (2, " ".join([*words[:30], b, *words[30:]])), (3, c), (4, d), (5, "é" * 400 + " " + " ".join(words)), (6, "ç" * 400 + " " + " ".join(words))]
    assert rows(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs, 50)


def test_run_hashes_tell_orders_apart():
    import numpy as np

    draw = np.random.default_rng(3)
    ids = draw.integers(0, 1 << 64, 40, dtype=np.uint64)
    for size in (1, 2, 3, 5, 25, 40):
        found = sd.run_hashes(ids, size)
        assert len(found) == 41 - size
        for k in range(len(found)):
            assert sd.run_hashes(ids[k : k + size], size)[0] == found[k]
    assert sd.run_hashes(ids[::-1], 40)[0] != sd.run_hashes(ids, 40)[0]


def test_hashes_tell_words_of_all_lengths_apart():
    words = [b"a", b"a\0", b"abcdefgh", b"abcdefgh\0", b"abcdefghi", b"abcdefghij", b"ijabcdefgh", *(b"x" * k for k in (8, 9, 16, 17, 256, 257, 600)), b"x" * 256 + b"y", "é\u00a0è\u2028".encode()]
    texts = [b"", b" \t\n", b"\v".join(words), b"\r\n" + b" \f ".join(reversed(words)) + b" ", b"abcdefgh", b"\0"]
    found, sizes = sd.hashes_of(texts)
    split = [t.split() for t in texts]
    assert sizes.tolist() == list(map(len, split)) == [0, 0, len(words), len(words), 1, 1]
    known = dict(zip((w for t in split for w in t), found.tolist()))
    assert [known[w] for t in split for w in t] == found.tolist() and len(set(known.values())) == len(known)
    assert all(sd.hashes_of([w])[0].tolist() == [h] for w, h in known.items())
    assert [len(x) for x in sd.hashes_of([])] == [0, 0]


def test_texts_of_a_batch_are_hashed_together(monkeypatch):
    import pyarrow as pa

    draw = random.Random(9)
    texts = [" ".join(draw.choice("ab") for _ in range(draw.randint(0, 30))).encode() for _ in range(400)]

    def anchors(k, texts):
        kinds = (pa.int64(), pa.int32(), pa.binary())
        batch = pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip((range(k, k + len(texts)), [0] * len(texts), texts), kinds)], ["_id", "_t", "_text"])
        return [r for b in sd._find_anchors(6, 3, -1)(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns))]

    alone = [r for k, t in enumerate(texts) for r in anchors(k, [t])]
    calls, hashes_of = [], sd.hashes_of
    monkeypatch.setattr(sd, "hashes_of", lambda x: calls.append(len(x)) or hashes_of(x))
    # No run and no window reaches from one text into the next.
    assert anchors(0, texts) == alone and calls == [400]
    monkeypatch.setattr(sd, "PART", 100)
    assert anchors(0, texts) == alone and len(calls) > 50


def test_very_long_text_and_many_contexts_of_one_passage(spark):
    draw = random.Random(12)
    passage = [f"p{k}" for k in range(60)]
    docs = [(i, " ".join([f"a{draw.randrange(10**6)}", *passage, f"b{draw.randrange(10**6)}"])) for i in range(3000)]
    long = [f"w{draw.randrange(50)}" for _ in range(200_000)]
    docs += [(5000, " ".join(long)), (5001, " ".join(long[70_000:90_000])), (5002, "x" * 200_000 + " " + " ".join(passage))]
    assert rows(spark.createDataFrame(docs, "doc_id long, text string"), shard=500) == brute(docs, 50)


def test_results_say_which_anchor_they_are_of():
    import numpy as np
    import pyarrow as pa

    words = np.arange(7, dtype=np.uint64).tobytes()
    rows = [[(3 << 32) + 9, (3 << 32) + 9, -(5 << 32) + 9, -(5 << 32) + 9], [0] * 4, [1, 2, 3, 4], [77] * 4, [1, 2, 1, 2], [words] * 4]
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    out = [r for b in sd._stream(6, 3)(iter([pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, types)], ["h", "shard", "_id", "c", "kind", "words"])])) for r in b.to_pylist()]
    # One context hash, two anchors: each has the documents of its own.
    assert [(r["a"], r["c"], min(r["least"])) for r in out] == [(3, 77, 1), (3, 77, 1), (-5, 77, 3), (-5, 77, 3)]


def test_query(spark, sf_dir):
    from tramline.llm import queries

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert {r[0]: tuple(r)[1:] for r in queries.op8_substring_dedup(spark, sf_dir).collect()} == {i: w[:3] for i, w in brute([tuple(d) for d in docs], 50).items()}
