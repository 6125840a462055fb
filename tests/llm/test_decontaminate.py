import re

from tramline.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, size=10):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    windows = {}
    for item, text in items:
        words = WORD.findall(low(text))
        for k in range(max(1, len(words) - size + 1)) if words else ():
            windows.setdefault(tuple(words[k : k + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        words, hit, names = WORD.findall(low(text)), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if found := windows.get(tuple(words[k : k + n])):
                    hit.update(range(k, k + n))
                    names |= found
        out.append((doc, len(words), len(hit), tuple(sorted(names))))
    return sorted(out, key=repr)


DOCS = [
    (1, "One two THREE four five six seven, eight nine ten eleven!"), (1, "One two THREE four five six seven, eight nine ten eleven!"), (2, None), (3, ""),
    (4, "a Short-item b"), (None, "short item"), (5, "über straße kurz über straße"), (6, "nothing here"), (7, "x " * 5000 + "short item"), (8, "short\nitem short item"), (9, "...!!"),
]
ITEMS = [(1, "one two three four five six seven eight nine ten"), (10, "Short item"), (2, "ÜBER straße"), (3, "straße kurz"), (4, None), (5, "--"), (2, "ÜBER straße"), (None, "nothing")]


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in DOCS], "doc_id long, text string, n_hit int, item_id string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute(DOCS, [x for x in set(ITEMS) if x[0] is not None])
    for limit in (1 << 25, 20):
        before, dc.MAX_AUTOMATON_BYTES = dc.MAX_AUTOMATON_BYTES, limit  # the second one needs several automata
        try:
            got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in dc.scan(docs, items).collect()), key=repr)
        finally:
            dc.MAX_AUTOMATON_BYTES = before
        assert got == want


def test_spans_lie_in_the_original(spark):
    docs = spark.createDataFrame([(1, "Über: «Short», ITEM! end")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "short item")], "item_id long, text string")
    row = dc.scan(docs, items, spans=True).first()
    # « and » are no ASCII, so they belong to words and the item doesn't occur.
    assert row.spans == []
    docs = spark.createDataFrame([(1, "Über: Short, ITEM! end")], "doc_id long, text string")
    row = dc.scan(docs, items, spans=True).first()
    assert "Über: Short, ITEM! end"[row.spans[0].start : row.spans[0].end] == "Short, ITEM"


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert dc.scan(none, items).count() == 0
    assert [tuple(r)[:3] for r in dc.scan(docs, items).collect()] == [(1, 2, 0)]


def test_long_items_in_pieces_and_very_long_texts(spark, monkeypatch):
    import random

    monkeypatch.setattr(dc, "PIECE_WORDS", 7)
    draw = random.Random(4)
    words = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(draw.choice(words) for _ in range(draw.randint(1, 60)))) for k in range(20)]
    docs = [(k, " ".join(draw.choice(words) for _ in range(draw.randint(0, 30))) + " " + " ".join(items[k % 20][1].split()[3:21])) for k in range(40)] + [(99, "x " * 300_000 + items[0][1])]
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in dc.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()), key=repr)
    assert got == brute(docs, items)


def test_query_against_brute_force(spark, sf_dir):
    import hashlib

    from tramline.llm import queries

    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c).collect()] for t, c in (("documents", ("doc_id", "text")), ("benchmark", ("item_id", "text"))))
    want = {i: (n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0) for i, n, hit, names in brute(docs, items)}
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op9_decontamination(spark, sf_dir).collect()} == want
