import random
from collections import Counter

import pytest

from tramline.llm import line_dedup as ld


def brute(docs, size=2):
    seen, out = set(), {}
    for i, text in sorted(docs):
        lines, gone = (text or "").split("\n"), set()
        for k in range(len(lines) - size + 1):
            run = tuple(lines[k : k + size])
            if run in seen:
                gone |= set(range(k, k + size))
            seen.add(run)
        out[i] = (len(lines), len(gone), text if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


DOCS = [
    (1, "a\nb\nc"), (2, "x\na\nb\nc\ny"), (3, None), (4, ""), (5, "a\na\na\na\na"), (6, "\n\n\n"), (7, "\n\n\n"), (8, "b\nc"), (9, "c\nb\na"), (10, "only one line"), (11, "only one line"),
    (12, "\n".join(f"line {k}" for k in range(300))), (13, "\n".join(f"line {k}" for k in range(150, 400))),
]


def test_against_brute_force(spark):
    frame = spark.createDataFrame([(i, t, 5, "r") for i, t in DOCS], "doc_id long, text string, size int, run string")
    for size in (1, 2, 4):
        got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in ld.deduplicate(frame, min_lines=size).collect()}
        assert got == brute(DOCS, size), size


def test_longest_run_other_columns_and_null_ids(spark):
    frame = spark.createDataFrame([(1, "a\nb\nc\nd\ne", "k1"), (2, "a\nb\nc\nd\nz", "k2"), (None, "a\nb", "k3"), (2, "a\nb\nc\nd\nz", "k2")], "doc_id long, text string, size string")
    rows = ld.deduplicate(frame).collect()
    assert sorted(((r.doc_id, r.size, r.longest_run, r.text) for r in rows), key=repr) == sorted(
        [(1, "k1", 0, "a\nb\nc\nd\ne"), (2, "k2", 4, "z"), (2, "k2", 4, "z"), (None, "k3", 0, "a\nb")], key=repr)


def test_empty_table(spark):
    assert ld.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_lone(docs, words, size=2):
    """The brute force above, and later copies of single lines that hold so many words with a letter or digit."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        lines, gone = (text or "").split("\n"), set()
        for n in (1, size):
            for k in range(len(lines) - n + 1):
                run = tuple(lines[k : k + n])
                if run in seen and (n == size or sum(any(c.isalnum() for c in w) for w in lines[k].split()) >= words):
                    gone |= set(range(k, k + n))
                seen.add(run)
        gone = gone if text is not None else set()
        out[i] = (len(lines), len(gone), text if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_lone_lines_against_brute_force(spark):
    docs = DOCS + [(20, "one\nAll rights reserved.\ntwo"), (21, "three\nAll rights reserved.\nfour"), (22, "five\n}\n\n- - -\nsix"), (23, "seven\n}\neight\n\nnine\n- - -\nten"), (24, "All rights reserved."), (25, "Les."), (26, "Les.")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for words in (1, 2, 3):
        got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in ld.deduplicate(frame, lone_words=words).collect()}
        assert got == brute_lone(docs, words), words
    assert got[11] == (1, 1, "") and got[21][2] == "three\nfour" and got[23][1] == 0 and got[26][1] == 0


def test_query_deletes_lone_lines(spark, sf_dir):
    import hashlib

    from tramline.llm import queries

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {i: (n, gone, hashlib.sha256(t.encode()).hexdigest()) for i, (n, gone, t) in brute_lone(docs, 2).items()}
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in queries.op7_line_dedup(spark, sf_dir).collect()} == want


def brute_longest(docs, size=2):
    """Most lines in a row of each document that occur at an earlier position."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        lines, most = (text or "").split("\n"), 0
        for k in range(len(lines)):
            n = 1
            while k + n <= len(lines):
                run = tuple(lines[k : k + n])
                if run in seen and n >= size:
                    most = max(most, n)
                seen.add(run)
                n += 1
        out[i] = most
    return out


def test_longest_run_is_exact(spark):
    import random

    draw = random.Random(4)
    docs = [(i, t) for i, t in DOCS if i < 12] + [(12, "\n".join(f"line {k}" for k in range(60))), (13, "\n".join(f"line {k}" for k in range(15, 80)))]
    docs += [(20, "p\nq\nr\ns"), (21, "0\np\nq\nr\n1"), (22, "\n".join("tuvwxyz")), (23, "\n".join("2tuvwxyz3")), (24, "\n".join("4tuvw5"))]
    docs += [(100 + i, "\n".join(draw.choice("ABC") for _ in range(draw.randint(1, 40)))) for i in range(60)]
    passages = [[f"{p}-{k}" for k in range(30)] for p in range(4)]
    for i in range(60):
        p, a = draw.choice(passages), draw.randrange(25)
        docs.append((300 + i, "\n".join([f"own {i}", *p[a : a + draw.randint(1, 20)], f"end {i}"])))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.longest_run for r in ld.deduplicate(frame).collect()}
    assert got == brute_longest(docs)
    assert got[21] == 3 and got[23] == 7


@pytest.fixture
def dealt(spark):
    """Many partitions of a few rows, so that groups and runs cross their borders; other tests have them put together."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def brute_runs(docs):
    """For each line the most lines from it on that also start at an earlier place."""
    rows = [(i, (t or "").split("\n")) for i, t in sorted(docs)]
    places = {}
    for i, lines in rows:
        for k, line in enumerate(lines):
            places.setdefault(line, []).append((i, k))
    texts, out = dict(rows), {}
    for i, lines in rows:
        for k, line in enumerate(lines):
            best = 0
            for j, m in places[line]:
                if (j, m) < (i, k):
                    n = 0
                    while k + n < len(lines) and m + n < len(texts[j]) and lines[k + n] == texts[j][m + n]:
                        n += 1
                    best = max(best, n)
            if best:
                out[i, k] = best
    return out


def random_docs(seed):
    draw = random.Random(seed)
    docs = [(i, "\n".join(draw.choice("ABC") for _ in range(draw.randint(1, 30)))) for i in range(50)]
    passages = [[f"{p}-{k}" for k in range(40)] for p in range(3)]
    for i in range(40):
        p, a = draw.choice(passages), draw.randrange(30)
        docs.append((300 + i, "\n".join([f"own {i}", *p[a : a + draw.randint(1, 30)], f"end {i}", *draw.choice(passages)[:3]])))
    return docs + [(600 + i, "same\n\nsame\nlines") for i in range(25)] + [(700, "\n".join(["again"] * 90)), (701, None), (702, "")]


def test_maximal_runs_against_brute_force(spark, dealt):
    for seed in (1, 2):
        docs = random_docs(seed)
        frame = spark.createDataFrame([(i, 7, t) for i, t in docs], "_id long, _h long, _text string")
        got = {(r._id, r.pos): r.run for r in ld.repeated_runs(frame).collect()}
        assert got == brute_runs(docs)


def test_suffix_array_is_sorted_and_complete(spark, dealt):
    docs = [(i, t or "") for i, t in random_docs(3)]
    array, _ = ld.suffix_array(spark.createDataFrame([(i, 7, t) for i, t in docs], "_id long, _h long, _text string"))
    rows = sorted(array.collect(), key=lambda r: (r.part, r.id, r.off, r._id, r._h, r.pos))
    texts, counts = {i: t.split("\n") for i, t in docs}, Counter(line for _, t in docs for line in t.split("\n"))
    suffixes = [texts[r._id][r.pos :] for r in rows]
    assert sorted((r._id, r.pos) for r in rows) == sorted((i, k) for i, lines in texts.items() for k, line in enumerate(lines) if counts[line] > 1)
    ids, ranks = {}, {}
    for r, s in zip(rows, suffixes):
        assert ids.setdefault(s[0], r.id) == r.id and ranks.setdefault(tuple(s), (r.id, r.off)) == (r.id, r.off)
    assert len(set(ranks.values())) == len(ranks)
    for r, a, b in zip(rows[1:], suffixes, suffixes[1:]):
        common = 0
        while common < min(len(a), len(b)) and a[common] == b[common]:
            common += 1
        assert r.lcp == common


def test_sweep_in_pieces_equals_the_whole():
    draw = random.Random(6)
    for _ in range(200):
        n = draw.randint(1, 40)
        prefixes, places = [0] + [draw.choice((0, 1, 1, 2, 3, 5)) for _ in range(n - 1)], [(p,) for p in draw.sample(range(100), n)]
        want = []
        for k in range(n):
            best = 0
            for side in (range(k - 1, -1, -1), range(k + 1, n)):
                least = 1 << 40
                for j in side:
                    least = min(least, prefixes[j + 1] if j < k else prefixes[j])
                    if places[j] < places[k]:
                        best = max(best, least)
            want.append(best)
        cuts = [0, *sorted(draw.sample(range(1, n), min(n - 1, draw.randint(0, 5)))), n]
        told = {}
        for q, (a, b) in enumerate(zip(cuts, cuts[1:])):
            left, right = [], []
            ld.sweep(prefixes[a:b], places[a:b], left)
            ld.sweep([*prefixes[a + 1 : b], 0][::-1], places[a:b][::-1], right)
            told[q] = (prefixes[a], min(prefixes[a + 1 : b], default=1 << 40), left, right)
        got = []
        for q, (a, b) in enumerate(zip(cuts, cuts[1:])):
            left, right, following = ld._stack_carries(told)[q]
            one = ld.sweep(prefixes[a:b], places[a:b], list(left))
            other = ld.sweep([*prefixes[a + 1 : b], following][::-1], places[a:b][::-1], list(right))[::-1]
            got += map(max, one, other)
        assert got == want


def test_columns_of_any_name_and_very_long_texts(spark):
    rows = [(2, "a\nb\nc", 1, "s", "x", "y", 9, 8), (1, "a\nb\nd", 2, "t", "x", "y", 9, 8), (1, "a\nb\nd", 3, "t", "x", "y", 9, 8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _h int, _starts string, _id string, c0 string, pos int, n_lines int")
    got = sorted((r.doc_id, r.text, r._h, r._starts, r._id, r.c0, r.pos, r.n_lines, r.n_removed) for r in ld.deduplicate(frame).collect())
    assert got == [(1, "a\nb\nd", 2, "t", "x", "y", 9, 3, 0), (1, "a\nb\nd", 3, "t", "x", "y", 9, 3, 0), (2, "c", 1, "s", "x", "y", 9, 3, 2)]
    long = [f"line {k}" for k in range(3000)]
    docs = [(1, "\n".join(long)), (2, "\n".join(["x", *long[500:2700], "y"])), (3, "z" * 300_000 + "\nline 3"), (4, "z" * 300_000 + "\nline 3")]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.longest_run) for r in ld.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (3000, 0, 0), 2: (2202, 2200, 2200), 3: (2, 0, 0), 4: (2, 2, 2)}


def test_string_ids_and_any_least_run(spark):
    docs = [("b", "p\nq\nr\ns"), ("a", "p\nq\nr\nt"), ("c", "q\nr\ns\nv")]
    frame = spark.createDataFrame(docs, "doc_id string, text string")
    assert {r.doc_id: r.text for r in ld.deduplicate(frame, min_lines=3).collect()} == {"a": "p\nq\nr\nt", "b": "s", "c": "v"}
