import hashlib
import random
import re

import pytest

from tramline.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b(?:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:[ -]?[0-9A-Z]){{{n - 4}}}" for n, c in pii.IBAN_LENGTHS.items()) + r")\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "local_phone": r"\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}\b|\b[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}\b",
}


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def fits(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "iban":
        m = re.sub("[ -]", "", m)
        return int("".join(str(int(c, 36)) for c in m[4:] + m[:4])) % 97 == 1
    if kind == "ssn":
        return not re.search("^(000|666|9)|-00-|-0000$", m)
    return True


def brute(text):
    spans, text = [], text or ""
    phones = [m.span() for m in re.finditer(PLAIN["phone"], text)]
    for k in pii.KINDS:
        if k.name == "local_phone":
            for a, b in phones:
                text = text[:a] + "+" * (b - a) + text[b:]
        found = list(re.finditer(PLAIN[k.name], text, re.ASCII))
        for i, m in enumerate(found):
            left = text[max(0, m.start() - pii.AROUND, found[i - 1].end() if i else 0) : m.start()]
            right = text[m.end() : min(m.end() + pii.AROUND, found[i + 1].start() if i + 1 < len(found) else len(text))]
            near = re.sub("[A-Z]", lambda c: c[0].lower(), f"{left} {right}")
            has = lambda words: any(re.search(rf"\b{w}\b", near, re.ASCII) for w in words)
            score = k.score + k.gain * has(k.near) - k.loss * has(k.against)
            if fits(k.name, m[0]) and (k in pii.BASE or score >= pii.LEAST_SCORE):
                spans.append((k.name, m.start(), m.end(), m[0], score))
    return spans


def row_of(text):
    spans = brute(text)
    say = lambda xs: ",".join(f"{x[0]}:{x[1]}:{x[2]}" for x in xs)
    base = [x for x in spans if x[0] in {k.name for k in pii.BASE}]
    return (*(sum(x[0] == k.name for x in spans) for k in pii.BASE), hashlib.sha256(say(base).encode()).hexdigest(), say(spans))


TEXTS = [
    "mail me: a.b+c@x-y.example.org_d@e.f and a@b@c.de", "server 10.0.0.1, 256.1.1.1, 001.02.3.255.4.5.6.7, version 1.2.3.4", "card 4111 1111 1111 1111, 4111-1111-1111-1112, 4111111111111111 1", "4012888888881881  4012888888881881",
    "call +1 (626) 555-5759 or (626) 555-5759 or phone 626-555-5759.", "tel 626.555.5759", "626 555 5759", "+1.2.3.4.5.6.7.8 +(", "IBAN DE89 3704 0044 0532 0130 00, GB82-WEST-1234-5698-7654-32 FR1420041010050500013M02606 DE88370400440532013000",
    "SSN 078-05-1120; 078-05-1120, 000-12-3456 ssn", "é😀 ü@x.de 😀a@b.cd 😀 4111 1111 1111 1111 😀+49 30 12345678😀 10.1.2.3", "", None, "\x00a@b.c\n10.0.0.1", "１２３.0.0.1.2", "xDE89370400440532013000 _DE89370400440532013000", "+12345678-+12345678", "+1234567", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
]


def rows(spark, texts):
    frame = spark.createDataFrame([(k, t, "e", 1.0) for k, t in enumerate(texts)], "doc_id long, text string, spans string, _id double")
    got = {r[0]: tuple(r)[1:] for r in pii.digests(pii.find(frame)).collect()}
    return [got[k] for k in range(len(texts))]


def test_against_brute_force(spark):
    draw = random.Random(5)
    bits = ["4111 1111 1111 1111", "1", "2", "25", "5", ".", ".", "-", " ", " ", "+", "@", "a", "b.c", "(", ")", "é", "😀", "DE89370400440532013000", "078-05-1120", "ssn", "call", "626-555-5759", "10.0.0.1", "\n", "Card "]
    texts = TEXTS + ["".join(draw.choices(bits, k=draw.randint(0, 60))) for _ in range(400)]
    assert rows(spark, texts) == [row_of(t) for t in texts]


def test_texts_and_scores(spark):
    got = pii.find(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))
    assert {r.doc_id: [(s.kind, s.start, s.end, s.text, round(100 * s.score)) for s in r.spans] for r in got.collect()} == {k: brute(t) for k, t in enumerate(TEXTS)}


def long_texts(n):
    return ["1" * n, "1 " * n, "a" * n + "@x", "a@" * n, "1." * n, "+1(" * n, "a." * n + "@b" + ".c" * n, "AB12" * n, "+" + "1 " * n, "10.0.0.1 a@b.cd " * (n // 100)]


def test_long_texts(spark):
    assert rows(spark, long_texts(2_000)) == [row_of(t) for t in long_texts(2_000)]


def test_very_long_texts(spark):
    # The plain patterns would take the square of these lengths.
    got = rows(spark, long_texts(200_000))
    assert [r[:4] for r in got] == [(0, 0, 0, 0)] * 4 + [(0, 50_000, 0, 0), (0, 0, 0, 0), (1, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0), (2_000, 2_000, 0, 0)]
    assert got[6][5] == "email:0:800002" and got[4][5].endswith(",ip:399992:399999")
    assert got[9][5].split(",")[1_999::2_000] == [f"email:{16 * 1_999 + 9}:{16 * 1_999 + 15}", f"ip:{16 * 1_999}:{16 * 1_999 + 8}"]


def test_repeated_rows_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, TEXTS[0]), (1, TEXTS[0]), (None, TEXTS[0]), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, len(r.spans)) for r in pii.find(frame).collect()) == [(0, 0), (0, 3), (1, 3), (1, 3)]
    assert pii.digests(pii.find(frame.limit(0))).count() == 0


@pytest.mark.parametrize("account, good", [("DE89370400440532013000", True), ("GB82WEST12345698765432", True), ("GB82WEST12345698765433", False)])
def test_mod97(spark, account, good):
    from pyspark.sql import functions as F

    assert spark.range(1).select(pii.passes_mod97(F.lit(account)).alias("x")).first().x is good
