import random
import re
from collections import Counter, defaultdict

import numpy as np

from tramline.llm import divergence as dv


def brute(rows, least_docs=dv.LEAST_DOCS, top=dv.TOP):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        of = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(of[s][t] for s in sources) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p, q = {s: share(of[s]) for s in sources}, share(whole)
        differ = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(differ(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            best = [(-differ(p[s][t], q[t]), t.encode()) for t in kept if of[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(best)[:top])):
                out += [(lang, s, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(found, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def made(seed, n=400, sources=6):
    draw = random.Random(seed)
    terms = [f"w{'abcdefghij'[k % 10]}{'klmno'[k // 10]}" for k in range(50)] + ["É", "ß", "A", "a", "x_y", "1", "😀", "Zed"]
    text = lambda: "".join(draw.choice(terms) + draw.choice([" ", "-", "\n", "2", ""]) for _ in range(draw.randint(0, 25)))
    return [(draw.choice(["en", "en", None, "", "rare"] if k % 40 else ["lone"]), draw.choice([None, *(f"s{j}" for j in range(sources))]), draw.choice([text(), text(), text(), None])) for k in range(n)]


def test_against_brute_force(spark):
    rows = made(1) + [("en", "empty", None), ("few", "a", "x"), ("few", "b", "y")]
    frame = spark.createDataFrame([(*r, 1, "v") for r in rows], "lang string, source string, text string, n int, vector string").repartition(5)
    assert rows_of(dv.audit(frame)) == brute(rows)
    assert rows_of(dv.audit(frame, least_docs=2, top=3)) == brute(rows, 2, 3)


def test_blocks_of_vectors_and_sources(spark, monkeypatch):
    monkeypatch.setattr(dv, "BLOCK_ENTRIES", 20)
    monkeypatch.setattr(dv, "BLOCK_SOURCES", 3)
    rows = made(3, 300, 11)
    assert rows_of(dv.audit(spark.createDataFrame(rows, "lang string, source string, text string"))) == brute(rows)


def test_shares_are_exact(spark):
    draw = random.Random(4)
    n = [0, 1, 8_999_999_999, 9_000_000_000, 10**12, 9 * 10**15 - 1] + [draw.randrange(10 ** draw.randint(1, 15)) for _ in range(200)]
    size = [x + 2 + draw.randrange(10 ** draw.randint(1, 15)) for x in n[:5]] + [9 * 10**15 + 1] + [x + 2 + draw.randrange(10 ** draw.randint(1, 15)) for x in n[6:]]
    want = [1 + 10**9 * (a + 2) // b for a, b in zip(n, size)]
    assert dv.shares(np.array(n), np.array(size)).tolist() == want
    frame = spark.createDataFrame(list(zip(n, size)), "n long, size long")
    assert [r.p for r in frame.selectExpr(dv._share("n", "size") + " AS p").collect()] == want


def test_very_long_text_one_source_and_empty_table(spark):
    rows = [("en", "a", "big small " * 600_000 + "z" * 2_000_000)] * 11 + [("en", "b", "small Big big")]
    frame = spark.createDataFrame(rows, "lang string, source string, text string")
    assert rows_of(dv.audit(frame)) == brute(rows)
    assert rows_of(dv.audit(frame.where("source = 'a'"))) == brute(rows[:11])
    assert dv.audit(frame.limit(0)).count() == 0
