import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from tramline.llm import fingerprint as fp


def edited(docs):
    rows, out = sorted(docs, key=lambda r: (r[0] is not None, r[0])), {}
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        out[i] = (len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest())
    return out


DOCS = [(0, "ab\ncd ef"), (1, None), (63, "héllo wörld"), (64, ""), (65, "x"), (1 << 20, "one two three four"), (1 << 41, "𝄞 clef 𝄞"), (-9, "minus " * 400), (None, "no id at all")]


def test_edited_texts(spark):
    frame = spark.createDataFrame([(i, t, 1, "q") for i, t in DOCS], "doc_id long, text string, bucket int, n_chars string")
    rows = fp.edited_documents(frame).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == edited(DOCS) and len(rows) == len(DOCS)
    assert all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))
    one = fp.edited_documents(frame.where("doc_id = 65")).first()
    assert one.near_next == 1 and one.n_chars == 1


def test_equal_texts_have_equal_fingerprints_and_rows_stay(spark):
    rows = fp.edited_documents(spark.createDataFrame([(1, "a b\nc"), (1, "a b\nc"), (2, "a b\nc"), (3, "a b c")], "doc_id long, text string")).collect()
    assert len(rows) == 4 and len({r.fingerprint for r in rows}) == 2


def test_sum_of_paragraphs(spark):
    texts = spark.createDataFrame([("all", "a b\nc d e\nf"), ("turned", "f\na b\nc d e"), ("two", "a b\nf"), ("one", "c d e")], "k string, t string")
    lanes = {r.k: r.lanes for r in fp.fingerprints(texts, ["k"], "t").collect()}
    assert lanes["all"] == lanes["turned"] != lanes["two"]
    both = spark.createDataFrame([(lanes["two"], lanes["one"], lanes["all"])], "a array<long>, b array<long>, c array<long>")
    row = both.select(fp.merged(F.col("a"), F.col("b")).alias("sum"), fp.merged(F.col("c"), F.col("b"), -1).alias("rest"), fp.likeness(F.col("a"), F.col("c")).alias("near")).first()
    assert row["sum"] == lanes["all"] and row["rest"] == lanes["two"] and 0 < row["near"] < 1


def test_empty_table(spark):
    assert fp.edited_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def elements(text):
    """The multiset that a fingerprint sums: word pairs of each paragraph, and the paragraphs."""
    found = Counter()
    for p in text.split("\n"):
        words = p.split(" ")
        found.update(zip(words, [*words[1:], None]))
        found[None, p] += 1
    return found


def squares(x):
    return sum(v * v for v in x.values())


def true_likeness(a, b):
    a, b = elements(a), elements(b)
    apart = {k: a[k] - b[k] for k in a | b}
    return max(0.0, 1 - squares(apart) / (squares(a) + squares(b)))


def prose(draw, n_paragraphs):
    words = [f"w{k}" for k in range(2000)]
    return "\n".join(" ".join(draw.choice(words) for _ in range(draw.randint(1, 60))) for _ in range(n_paragraphs))


def test_edited_fingerprint_and_likeness_against_plain_ones(spark):
    draw = random.Random(3)
    docs = [(i, prose(draw, draw.randint(1, 9))) for i in range(260)] + [(300, ""), (301, "one line"), (302, "\n\n"), (303, "a\n"), (304, "\nb c")]
    edits, texts = {}, dict(docs)
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        edits[i] = (text[: len(text) - half] + after[:half], after)
    rows = {r.doc_id: r for r in fp.edited_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    plain = spark.createDataFrame([(i, t) for i, t in docs] + [(i + 1000, e) for i, (e, _) in edits.items()], "k long, t string")
    alone = {r.k: r.f for r in fp.fingerprints(plain, ["k"], "t").select("k", fp.text_of(F.col("lanes")).alias("f")).collect()}
    errors = []
    for i, r in rows.items():
        assert r.fingerprint == alone[i] and r.edited_fingerprint == alone[i + 1000], i
        errors += [r.near_edited - true_likeness(texts[i], edits[i][0]), r.near_next - true_likeness(texts[i], edits[i][1])]
    assert len(rows) == len(docs) and len(rows[0].fingerprint) == 4 * fp.LANES
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.05


def test_crowded_ids_give_the_same_rows(spark, monkeypatch):
    draw = random.Random(4)
    docs = [(None, prose(draw, 2)) for _ in range(30)] + [(7, prose(draw, 2)) for _ in range(30)] + [(k, prose(draw, 1)) for k in range(6, 200, 3)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    plain = sorted(map(tuple, fp.edited_documents(frame).collect()), key=repr)
    monkeypatch.setattr(fp, "CROWD", 8)
    assert sorted(map(tuple, fp.edited_documents(frame).collect()), key=repr) == plain and len(plain) == len(docs)


def test_many_equal_rows_are_counted_before_they_are_dealt(spark):
    """Rows alike are one row until the end, and each has its result."""
    from pyspark.sql import functions as F

    n = 10_000
    alike = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same text\nof all").alias("text"))
    docs = alike.union(spark.createDataFrame([(3, "other"), (3, "other"), (3, None), (9, "last one")], "doc_id long, text string"))
    linked = fp.with_next(docs)
    assert linked.count() < 12 and linked.agg(F.sum("times")).first()[0] == n + 4
    out = fp.edited_documents(docs)
    counts = {(r.doc_id, r.n_chars, r.near_next == 1.0): r.n for r in out.groupBy("doc_id", "n_chars", "near_next").agg(F.count("*").alias("n")).collect()}
    # All but one of the equal rows are followed by their like.
    assert counts[None, 16, True] == n - 1 and counts[None, 16, False] == 1 and counts[3, 5, True] == 1 and sum(counts.values()) == n + 4
    assert out.where("doc_id is null").select("fingerprint").distinct().count() == 1


def test_very_long_text(spark):
    rows = fp.edited_documents(spark.createDataFrame([(1, "word and " * 150_000), (2, "x" * 1_000_000)], "doc_id long, text string")).collect()
    assert {r.n_chars for r in rows} == {9 * 150_000, 1_000_000}


def test_query_against_plain_fingerprints(spark, sf_dir):
    from tramline.llm import queries

    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op1_fingerprint(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == edited(docs)
    frame = spark.createDataFrame([(i, t or "") for i, t in docs], "k long, t string")
    alone = {r.k: r.f for r in fp.fingerprints(frame, ["k"], "t").select("k", fp.text_of(F.col("lanes")).alias("f")).collect()}
    assert {r.doc_id: r.fingerprint for r in rows} == alone
    same = {}
    for i, t in docs:
        same.setdefault(t or "", set()).add(alone[i])
    assert all(len(x) == 1 for x in same.values()) and len(set(alone.values())) == len({tuple(sorted(elements(t).items(), key=repr)) for t in same})
