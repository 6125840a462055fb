import random
from collections import Counter, defaultdict

from tramline.llm import ngram_join as nj


def brute(docs, threshold=0.8):
    sets = {}
    for i, text in docs:
        words = (text or "").split()
        n = min(5, len(words))
        sets[i] = frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if words else frozenset()
    owners, links, root = defaultdict(list), Counter(), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, grams in sets.items():
        common = Counter(j for g in grams for j in owners[g])
        for j, n in common.items():
            if n >= threshold * (len(grams) + len(sets[j]) - n) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in grams:
            owners[g].append(i)
    return {i: (find(i), links[i]) for i in sets}


def documents():
    draw = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    base = [[draw.choice(words) for _ in range(draw.randint(60, 160))] for _ in range(12)]
    docs, n = [], 0
    for text in base:
        for _ in range(draw.randint(1, 25)):
            copy = list(text)
            for _ in range(draw.choice((0, 0, 1, 1, 2, 6))):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            docs.append((n, " ".join(copy)))
            n += 1
    return [*docs, (900, None), (901, ""), (902, "a b"), (903, "a  b"), (904, "a b c"), (905, " \n"), (906, "x " * 3000)]


def test_against_brute_force(spark):
    docs = documents()
    frame = spark.createDataFrame([(i, t, "q") for i, t in docs], "doc_id long, text string, rep string")
    want = brute(docs)
    for block in (256, 4):  # the second one deals components into pairs of blocks
        got = {r.doc_id: (r.class_id, r.n_links) for r in nj.similarity_join(frame, block=block, recall=0.9999).collect()}
        assert got == want


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, "z")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in nj.similarity_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0)}


def test_empty_table_and_string_ids(spark):
    assert nj.similarity_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    named = spark.createDataFrame([("b", "one two three"), ("a", "one two three")], "doc_id string, text string")
    assert {tuple(r)[:2] for r in nj.similarity_join(named).collect()} == {("a", "a"), ("b", "a")}


def test_bands_meet_the_recall():
    bands = nj.bands_for(0.8, 0.995, 8)
    assert 1 - (1 - 0.8**8) ** bands >= 0.995


def test_a_chain_is_dealt_by_bands(spark):
    draw = random.Random(7)
    words = [f"w{draw.randrange(10**6)}" for _ in range(2500)]
    docs = [(i, " ".join(words[12 * i : 12 * i + 130])) for i in range(190)] + documents()
    frame = spark.createDataFrame([(i + 10_000 * (k >= 190), t) for k, (i, t) in enumerate(docs)], "doc_id long, text string")
    want = brute([(r.doc_id, r.text) for r in frame.collect()])
    assert max(Counter(c for c, _ in want.values()).values()) > 150
    got = {r.doc_id: (r.class_id, r.n_links) for r in nj.similarity_join(frame, block=4, recall=0.9999).collect()}
    assert got == want


def test_recall_of_the_shipped_settings(spark):
    """Pairs that are just as similar as they have to be."""
    draw = random.Random(11)
    docs = []
    for k in range(900):
        text = [f"w{draw.randrange(10**7)}" for _ in range(104)]
        copy = list(text)
        for at in draw.sample((10, 30, 50, 70, 90), 2):
            copy[at] = "changed"
        docs += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(copy))]
    want = brute(docs)
    linked = {i for i, (_, n) in want.items() if n}
    assert len(linked) == 1800  # each pair has 90 of 110 n-grams in common
    got = {r.doc_id for r in nj.similarity_join(spark.createDataFrame(docs, "doc_id long, text string")).where("n_links > 0").collect()}
    assert got <= linked and len(got) >= 0.99 * len(linked)


def test_query_against_brute_force(spark, sf_dir):
    from tramline.llm import queries

    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: (r.class_id, r.n_links) for r in queries.op2_ngram_jaccard(spark, sf_dir).collect()} == brute(docs)


def test_very_long_text(spark):
    draw = random.Random(2)
    long = " ".join(f"w{draw.randrange(5000)}" for _ in range(300_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "x" * 1_000_000)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in nj.similarity_join(docs).collect()} == {1: 1, 2: 1, 3: 3}
