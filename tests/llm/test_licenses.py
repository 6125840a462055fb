from tramline.llm import licenses as lc


def test_alignment_against_brute_force():
    import random

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for k, y in enumerate(b, 1):
                before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
        return row[-1]

    draw = random.Random(1)
    for _ in range(300):
        a = [draw.choice("abcdefghij") for _ in range(draw.randint(0, 12))]
        b = [draw.choice("abcdefghij") for _ in range(draw.randint(0, 12))]
        pairs = lc.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:]))
        assert len(pairs) <= lcs(a, b)
        unique = [f"u{k}" for k in range(9)]
        kept = [w for w in unique if draw.random() < 0.7]
        assert len(lc.align(kept, unique)) == len(kept)


def test_rows(spark):
    apache = lc.TEMPLATES["Apache-2.0-header"]
    rows = [
        (1, "text before. Licensed under the Apache License, Version 2.0. And after"), (2, apache.replace("software distributed", "all of this software that is distributed")), (3, None), (4, ""), (5, "no notice here"),
        (6, "Released under the MIT License.\n" + "words and more words " * 3000 + "\nAll rights reserved."), (None, "RELEASED UNDER THE MIT LICENSE"), (7, "the license of a version"), (1, "Released under the MIT License"),
    ]
    out = lc.scan(spark.createDataFrame([(i, t, "l", 2) for i, t in rows], "doc_id long, text string, license string, hits int")).collect()
    got = sorted(((r.doc_id, r.license, r.n_hits) for r in out), key=repr)
    assert got == sorted([(1, "Apache-2.0", 1), (2, "Apache-2.0-header", 1), (3, None, 0), (4, None, 0), (5, None, 0), (6, "MIT", 2), (None, "MIT", 1), (7, None, 0), (1, "MIT", 1)], key=repr)
    hit = next(r for r in out if r.doc_id == 1 and r.license == "Apache-2.0").hits[0]
    assert rows[0][1][hit.start : hit.end] == "Licensed under the Apache License, Version 2.0" and hit.coverage == 1


def test_empty_table(spark):
    assert lc.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def words_edited(draw, text, changed, added, deciding=()):
    """The text with so many words replaced and so many put in; deciding words stay, and stay together."""
    words, kept = text.split(), set()
    for phrase in deciding:
        size = len(phrase.split())
        kept |= next(set(range(k, k + size)) for k in range(len(words)) if lc.words_of(" ".join(words[k : k + size]))[0] == lc.words_of(phrase)[0])
    out = list(words)
    for k in draw.sample(sorted(set(range(len(words))) - kept), changed):
        out[k] = f"zz{draw.randrange(999)}"
    for k in sorted((draw.choice([k for k in range(len(words)) if not {k - 1, k} <= kept]) for _ in range(added)), reverse=True):
        out.insert(k, f"yy{draw.randrange(999)}")
    return " ".join(out)


def test_every_copy_is_found():
    import random

    draw = random.Random(8)
    scanner = lc.Scanner(lc.TEMPLATES)
    for name in ("MIT-header", "MIT-full", "GPL-3.0-header", "Apache-2.0-header", "BSD-3-Clause-full", "BSD-3-Clause", "ISC-full", "Zlib", "Unlicense", "MPL-2.0-header", "all-rights-reserved", "Apache-2.0"):
        text = lc.TEMPLATES[name]
        for n in (1, 2, 3, 7):
            for between in ("\n", "\n// file\n", "\n" + "other words stand here " * 30):
                found = scanner.scan("start " + between.join([text] * n) + " end")
                assert [h["license"] for h in found] == [name] * n, (name, n, between)
                assert all(h["coverage"] == 1 for h in found)


def test_edited_copies_against_a_full_alignment():
    """Copies of which at least the least share of words is left, among prose; their places are known."""
    import random

    draw = random.Random(9)
    scanner = lc.Scanner(lc.TEMPLATES)
    prose = [f"w{k}" for k in range(300)] + "the of this software and to in code notice copyright free license".split()
    for name in ("MIT-full", "GPL-3.0-header", "Apache-2.0-header", "ISC-full", "Zlib", "BSL-1.0"):
        size = len(lc.words_of(lc.TEMPLATES[name])[0])
        for _ in range(20):
            parts, places, at = [], [], 0
            for _ in range(draw.randint(1, 4)):
                gap = " ".join(draw.choice(prose) for _ in range(draw.randint(0, 60))) + " "
                copy = words_edited(draw, lc.TEMPLATES[name], draw.randint(0, size // 12), draw.randint(0, 6), lc.DECIDING.get(name, ()))
                parts += [gap, copy, " "]
                places.append((at + len(gap), at + len(gap) + len(copy)))
                at += len(gap) + len(copy) + 1
            found = [h for h in scanner.scan("".join(parts)) if h["end"] - h["start"] > 200 or size < 40]
            assert len(found) == len(places), (name, found, places)
            for h, (a, b) in zip(found, places):
                assert min(h["end"], b) - max(h["start"], a) > 0.8 * (b - a) and h["license"].split("-")[0] == name.split("-")[0]


def test_no_hit_below_the_least_coverage_and_very_long_texts():
    import random

    draw = random.Random(10)
    scanner = lc.Scanner(lc.TEMPLATES)
    words = lc.TEMPLATES["GPL-3.0-header"].split()
    shuffled = list(words)
    draw.shuffle(shuffled)
    assert scanner.scan(" ".join(words[: len(words) // 2])) == [] and scanner.scan(" ".join(shuffled)) == []
    long = " license software conditions" * 100_000 + " " + lc.TEMPLATES["MIT-full"] + " all rights" * 50_000
    assert [h["license"] for h in scanner.scan(long)] == ["MIT-full"]
    assert len(scanner.scan("All rights reserved. " * 5000)) == 5000


def test_ties_go_to_the_name(spark):
    same = {"b": "alpha beta gamma delta", "a": "alpha beta gamma delta"}
    frame = spark.createDataFrame([(1, "so alpha beta gamma delta then"), (1, "so alpha beta gamma delta then")], "doc_id long, text string")
    assert [(r.license, r.n_hits) for r in lc.scan(frame, same).collect()] == [("a", 1)] * 2
    assert [r.n_hits for r in lc.scan(frame, {}).collect()] == [0, 0]


GPL = lc.TEMPLATES["GPL-2.0-header"]
NEAR_MISSES = [
    "Released under the BSD License", "Released under the zlib License", "Released under the Artistic License", "The film was released under the title License", "Licensed under CC BY-ND 4.0", "Licensed under CC BY 3.0",
    "This work is licensed under the GNU General Public License, version 2", "This work is licensed under the GNU Lesser General Public License, version 3", "This work is licensed under the GNU Affero General Public License, version 3",
    "Licensed under the Apache License, Version 1.1", "Licensed under the Mozilla License, Version 2.0", "Licensed under the Academic Free License, version 2.0", GPL.replace("version 2", "version 1"),
    GPL.replace("GNU General", "Affero General"), lc.TEMPLATES["LGPL-3.0-header"].replace("version 3", "version 2.1"), lc.TEMPLATES["Apache-2.0-header"].replace("Version 2.0", "Version 1.1"),
    lc.TEMPLATES["MPL-2.0-header"].replace("v. 2.0.", "v. 1.1."), lc.TEMPLATES["AGPL-3.0-header"].replace("GNU Affero", "GNU Free"), "All rights are reserved", "Licensed under CC BY-NC-SA 4.0", "Licensed, under some CC BY 4.0", "Released yesterday under the MIT License",
]


def test_near_misses_have_no_name():
    scanner = lc.Scanner(lc.TEMPLATES)
    for text in NEAR_MISSES:
        assert scanner.scan(text) == [] and scanner.scan(f"before it {text}, and after it") == [], text


def test_each_template_and_no_other():
    scanner = lc.Scanner(lc.TEMPLATES)
    for name, text in lc.TEMPLATES.items():
        assert [(h["license"], h["coverage"]) for h in scanner.scan(f"so, {text} so.")] == [(name, 1.0)], name


def test_deciding_words_stand_together():
    scanner = lc.Scanner(lc.TEMPLATES)
    for name, phrases in lc.DECIDING.items():
        for phrase in phrases:
            for k, w in enumerate(phrase.split()):
                changed = " ".join([*phrase.split()[:k], "zzz", *phrase.split()[k + 1 :]])
                put_in = phrase.replace(w, f"zzz {w}", 1) if k else phrase
                for other in {changed, put_in} - {phrase}:
                    found = scanner.scan(lc.TEMPLATES[name].replace(phrase, other, 1))
                    assert name not in [h["license"] for h in found], (name, other)


def test_words_scattered_over_foreign_text():
    words = lc.TEMPLATES["ISC-full"].split()
    assert lc.Scanner(lc.TEMPLATES).scan(" ".join(f"{w} qq rr" for w in words)) == []


def test_many_texts_of_one_template_in_bounded_time():
    import time

    began = time.perf_counter()
    found = lc.Scanner(lc.TEMPLATES).scan("\n".join([lc.TEMPLATES["MIT-full"]] * 500))
    assert [h["license"] for h in found] == ["MIT-full"] * 500 and time.perf_counter() - began < 30


def test_query_against_plain_scan(spark, sf_dir):
    from tramline.llm import queries

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    plain = {name: " " + " ".join(lc.words_of(t)[0]) + " " for name, t in lc.TEMPLATES.items()}
    got = {r.doc_id: r for r in queries.op4_license_scan(spark, sf_dir).collect()}
    assert set(got) == {d.doc_id for d in docs} and any(r.n_hits for r in got.values())
    for d in docs:
        # Notices word for word must be found under their name; names that are found must stand there, unless edited.
        text = " " + " ".join(lc.words_of(d.text or "")[0]) + " "
        names = {h.license for h in got[d.doc_id].hits}
        there = {name for name, t in plain.items() if t in text}
        there -= {a for a in there for b in there if a != b and plain[a].strip() in plain[b]}
        assert there <= names, d.doc_id
        assert all(h.coverage < 1 for h in got[d.doc_id].hits if h.license not in there), d.doc_id
