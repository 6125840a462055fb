"""The pipeline over made documents, stage by stage, against plain Python."""

import random
import sys

import public_tokenizers as vocabularies
import pytest

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
import corpus_pipeline  # noqa: E402
from tramline.llm import queries  # noqa: E402

TOXIC = ("vile", "nasty", "grumm")


def corpus():
    draw = random.Random(9)
    words = [f"{a}{b}" for a in ("lor", "ips", "dol", "sit", "ame", "con", "tur", "eli") for b in ("em", "um", "or", "et", "ctu", "adi", "sed", "iam")]
    item = "the quick onyx goblin jumps over the lazy dwarf and then sleeps"
    texts, labels = [], []

    def lines(n):
        return [" ".join(draw.choice(words) for _ in range(12)) + "." for _ in range(n)]

    shared = lines(3)
    originals = []
    for i in range(240):
        body = lines(draw.randint(2, 6))
        if i % 5 == 0:
            body[0] += " " + " ".join(draw.choice(TOXIC) for _ in range(3))
        elif i % 17 == 1:
            body[1:1] = shared
        elif i % 19 == 2:
            body = [" ".join(lines(8))]  # one line: an original
            originals.append((i, body[0]))
        elif i % 23 == 3:
            body.append("so " + item.upper().replace(" ", ", ") + " indeed")
        elif originals and i % 7 == 4:
            copy = originals[-1][1].split()
            copy[3] = "changed"
            body = [" ".join(copy)]
        texts.append((i, "\n".join(body), "en", f"src{i % 3}", len("\n".join(body))))
        labels.append((i, 1, int(i % 5 == 0)))
    last = texts[-1][0]
    texts += [(last + 1, None, None, None, None), (last + 2, "", "en", "src0", 0), (last + 3, texts[3][1], "en", "src1", texts[3][4])]
    return texts, labels, [(1, item), (2, None)]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    texts, labels, items = corpus()
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, labels, items


def brute(texts, labels, items):
    from test_decontaminate import brute as leaks
    from test_line_dedup import brute_lone
    from test_ngram_join import brute as near

    toxic = {i for i, _, t in labels if t}
    stages = []
    docs = {i: t for i, t, *_ in texts if i not in toxic}
    stages.append(dict(docs))
    edited = brute_lone(docs.items(), 2)
    docs = {i: t for i, (n, gone, t) in edited.items() if gone < n}
    stages.append(dict(docs))
    classes = near(docs.items())
    docs = {i: t for i, t in docs.items() if classes[i][0] == i}
    stages.append(dict(docs))
    hit = {i for i, _, n, _ in leaks(list(docs.items()), items) if n}
    stages.append({i: t for i, t in docs.items() if i not in hit})
    return stages


def test_each_stage(spark, made, tmp_path):
    import base64

    import tiktoken

    folder, texts, labels, items = made
    sys.path.insert(0, __file__.rsplit("/", 1)[0])
    want = brute(texts, labels, items)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if k < 4:
            assert docs.columns == columns
            rows = docs.collect()
            assert {r.doc_id: r.text for r in rows} == want[k], name
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    with open(vocabularies.path(queries.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    assert {r.doc_id: list(r.token_ids) for r in docs.collect()} == {i: encode(t or "") for i, t in want[3].items()}
    assert len(want[0]) > len(want[1]) > len(want[2]) > len(want[3]) > 100
    assert corpus_pipeline.run(spark, folder).count() == len(want[3])


def test_empty_documents(spark, made, tmp_path):
    folder, *_ = made
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


def test_contaminated_rows_without_an_id_or_with_a_repeated_one(spark, made):
    folder, _, _, items = made
    rows = [(None, "so " + items[0][1], "en", "s", 1), (None, "clean text", "en", "s", 1), (5, items[0][1], "en", "s", 1), (5, "clean as well", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_contaminated(spark, docs, folder)
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == ["clean as well", "clean text"]


def small(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long{extra}")


LONG = "one two three four five six seven eight nine ten eleven twelve"
OTHER = "some other words that nobody else has written down so far today"


def test_near_copies_by_id_and_text(spark, made):
    rows = [(3, LONG, "en", "s", 1), (5, LONG, "en", "s", 1), (5, OTHER, "en", "s", 1), (7, OTHER + " at all", "en", "s", 1), (7, OTHER + " at all", "en", "s", 1), (None, LONG, "en", "s", 1), (None, "x y", "en", "s", 1), (None, "x y", "en", "s", 1),
            (8, None, "en", "s", 1), (9, None, None, None, None), (9, None, None, None, None), (10, "", "en", "s", 0), (11, "", "en", "s", 0)]
    kept = corpus_pipeline.drop_near_copies(spark, small(spark, rows), made[0])
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert got == sorted([(3, LONG), (5, OTHER), (None, "x y"), (8, None), (9, None), (10, ""), (11, "")], key=repr)


def test_columns_of_any_name_pass_every_stage(spark, made):
    rows = [(1, LONG + "\n" + OTHER, "en", "s", 1, "k", "a", 3, "st", 7), (2, "a b c d e\n" + LONG + "\nf g", "en", "s", 1, "k", "b", 4, "st", 8)]
    docs = small(spark, rows, ", key string, _above string, _h int, _starts string, n_lines int")
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, made[0])
        assert out.columns == docs.columns
        kept = {r.doc_id: tuple(r)[5:] for r in out.collect()}
        assert kept == {r[0]: r[5:] for r in rows}
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_repeated_lines(spark, docs, made[0]).collect()}
    assert got == {1: (rows[0][1], 1), 2: ("a b c d e\nf g", 13)}


def test_each_stage_runs_once(spark, made, monkeypatch):
    """Rows that leave each stage are made once, whatever the next ones do with them."""
    seen = [spark.sparkContext.accumulator(0) for _ in corpus_pipeline.STAGES]

    def counted(k, stage):
        def run(spark, docs, sf_dir):
            out, left = stage(spark, docs, sf_dir), seen[k]

            def count(batches):
                for batch in batches:
                    left.add(batch.num_rows)
                    yield batch

            return out.mapInArrow(count, out.schema)

        return run

    folder, *rest = made
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, counted(k, stage)) for k, (name, stage) in enumerate(corpus_pipeline.STAGES)])
    corpus_pipeline.run(spark, folder).write.format("noop").mode("overwrite").save()
    assert [x.value for x in seen] == [*map(len, brute(*rest)), len(brute(*rest)[-1])]


def test_documents_of_equal_hashes_are_told_apart(spark, made):
    rows = [(i, t, "en", "s", 1) for i, t in ((None, None), (None, "-"), (None, "="), (0, None), (0, ""), (1, "0"))]
    kept = corpus_pipeline.drop_near_copies(spark, small(spark, rows), made[0])
    assert kept.count() == len(rows)


def test_clashing_hashes_are_told_apart(spark, made, monkeypatch):
    """With a hash of two values nearly all documents clash, and keep their own fates."""
    from pyspark.sql import functions as F

    rows = [(k, f"{LONG} {k % 5}" if k < 20 else f"{OTHER} {'x ' * k}", "en", "s", 1) for k in range(40)]
    want = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, small(spark, rows), made[0]).collect()}
    plain = F.xxhash64

    def poor(*columns):
        return F.pmod(plain(*columns), F.lit(2)) if all(isinstance(c, str) for c in columns) else plain(*columns)

    monkeypatch.setattr(corpus_pipeline.F, "xxhash64", poor)
    keyed = corpus_pipeline._keyed(small(spark, rows), "key")
    monkeypatch.setattr(corpus_pipeline.F, "xxhash64", plain)
    assert keyed.select("key").distinct().count() == 40
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, small(spark, rows), made[0]).collect()} == want
