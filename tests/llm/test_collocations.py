import random
import re
from collections import Counter, defaultdict

from tramline.llm import collocations as col


def brute(rows, least=col.LEAST, top=col.TOP, cover=col.COVER):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda c: c[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, 5):
                    if i + m <= len(w):
                        f[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, c in f.items():
        often = {p: a for p, a in c.items() if a >= least and len(p) > 1}
        gone = {p[i : i + m] for p, a in often.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= cover * c[p[i : i + m]]}
        scored = []
        for p, a in often.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def made(seed, n=300, vocabulary=30, langs=("en", None, "d e", "f\tr%+é", "")):
    draw = random.Random(seed)
    words = ["the", "of"] * 6 + [f"w{k}" for k in range(vocabulary)] + ["É", "é", "x\x01", "x", "a b", "😀", "New", "YORK"]
    text = lambda: "".join(draw.choice(words) + draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\r\n", " !", "\x0b"]) for _ in range(draw.randint(0, 120)))
    return [(draw.choice(langs), text()) for _ in range(n)]


def test_against_brute_force(spark):
    rows = made(1) + [("en", "big apple " * 40 + "new york city hall, " * 50)] * 2 + [("en", None), ("en", "")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n int, key string").repartition(5)
    assert rows_of(col.mine(frame)) == brute(rows)
    assert rows_of(col.mine(frame, top=7, least=5)) == brute(rows, top=7, least=5)


def test_hot_words_pairs_and_triples(spark, monkeypatch):
    # A third of all words goes on from one word, pair or triple; each is dealt on by its next word.
    monkeypatch.setattr(col, "STRIDE", 3)
    draw = random.Random(3)
    rows = [("en", " ".join(f"hot very {draw.choice(['much', 'old'])} u{draw.randint(0, 300)}" for _ in range(60))) for _ in range(60)] + made(4, 100)
    assert rows_of(col.mine(spark.createDataFrame(rows, "lang string, text string").repartition(7))) == brute(rows)


def test_passed_on_in_small_parts(spark, monkeypatch):
    from tramline.llm import collocations

    def small(batches, make):
        collocations.HOLD, collocations.STEP = 50, 40
        return make(batches)

    bitmap = type("Held", (), {"value": (__import__("numpy").full(1024, 2**64 - 1, "uint64"), 65535)})
    none = type("Held", (), {"value": {b"en\t": [[b"the"], [b"the", b"of"]]}})
    import pyarrow as pa

    rows = [(lang or "und", t) for lang, t in made(5, 80)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1].encode() for r in rows])], ["lang", "text"])
    monkeypatch.setattr(collocations, "HOLD", 50)
    monkeypatch.setattr(collocations, "STEP", 40)
    counted = Counter()
    for out in collocations._suffixes(iter([batch]), bitmap, none):
        for d, k, n in zip(*(c.to_pylist() for c in out.columns)):
            counted[k] += n
    keys = sorted(counted, reverse=True)
    got = Counter()
    parts = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 7]), pa.array([counted[k] for k in keys[i : i + 7]])], ["key", "n"]) for i in range(0, len(keys), 7)]
    for out in collocations._prefixes(iter(parts), 1, none):
        for k, m, n, _ in zip(*(c.to_pylist() for c in out.columns)):
            assert k not in got and m == len(k.split("\t")[-1].split(" "))
            got[k] += n
    want = Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda c: c[0].lower(), text)):
            w = re.findall("[^\x20\x09]+", piece)
            want.update(collocations._head(lang).decode() + " ".join(w[i : i + m]) for i in range(len(w)) for m in range(1, 5) if i + m <= len(w))
    assert got == want


def test_very_long_text_and_words(spark):
    rows = [("en", "a b c. " * 700_000), ("en", "z" * 3_000_000 + " a b"), ("de", "!" * 100_000)]
    assert rows_of(col.mine(spark.createDataFrame(rows, "lang string, text string"))) == [("en", 1, "a b c", 700_000, 700_001, 700_000, 2_100_003, 2_000_000 * 700_000 // 1_400_001)]


def test_empty_table(spark):
    assert col.mine(spark.createDataFrame([], "lang string, text string")).count() == 0
