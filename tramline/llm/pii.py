"""Personal data (operator 11): patterns propose spans, checksums confirm them, words nearby adjust the score.

Each kind is one pattern, searched from left to right without overlap; a match that its
check (parts of an address, number of digits, Luhn, mod-97) refuses is dropped and not tried again in part.
Spans of different kinds may overlap. All of it is a map over the documents in built-in
functions: no shuffle, no Python. The patterns never go back over a run that they took, so
their time is linear in the text and the matcher's stack doesn't grow with it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Kind(NamedTuple):
    """score: of a confirmed span, in hundredths; ``near`` words around it add ``gain``, ``against`` words take ``loss``."""

    name: str
    pattern: str
    score: int
    near: tuple[str, ...] = ()
    gain: int = 0
    against: tuple[str, ...] = ()
    loss: int = 0


# Lengths of international bank account numbers (ISO 13616) and the countries that have them.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS", 23: "AE GI IL TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ CY DO GT HU LB PL", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT SC",
}
_IBAN = "|".join(f"(?:{'|'.join(codes.split())})[0-9]{{2}}(?:[ -]?[0-9A-Z]){{{size - 4}}}" for size, codes in IBAN_LENGTHS.items())
_BEGIN, _END = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"

#: Spans of these are always found; the patterns say what the plain ones in the comment do, without going back.
BASE = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 90, ("mail", "email", "contact", "write"), 10),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++", 60, ("ip", "address", "host", "server", "login"), 30, ("version", "release", "section", "chapter"), 40),
    # [0-9]([\x20-]?[0-9])+, of which only runs of 16 to 19 digits can stay
    Kind("card", r"[0-9](?<![0-9][ -]?[0-9])(?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])", 70, ("card", "visa", "mastercard", "credit", "debit", "payment"), 30, ("order", "tracking", "serial", "isbn"), 30),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", 70, ("phone", "call", "tel", "mobile", "fax", "whatsapp"), 30),
)
#: Spans of these are found where their score reaches the least one.
MORE = (
    Kind("iban", f"{_BEGIN}(?:{_IBAN}){_END}", 90, ("iban", "account", "bank", "konto", "cuenta", "compte"), 10),
    Kind("ssn", rf"{_BEGIN}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_END}", 30, ("ssn", "social", "security", "taxpayer"), 50),
    Kind("local_phone", rf"\([0-9]{{3}}\) ?[0-9]{{3}}[ .-][0-9]{{4}}{_END}|{_BEGIN}[0-9]{{3}}[ .-][0-9]{{3}}[ .-][0-9]{{4}}{_END}", 40, ("phone", "call", "tel", "mobile", "fax", "whatsapp"), 40),
)
KINDS = BASE + MORE
LEAST_SCORE = 50
#: Code points on each side of a span in which words count, up to the next span of its kind.
AROUND = 40
#: Running sums are taken within blocks of so many matches and then over the blocks.
BLOCK = 256

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digits_of(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Whether the sum of digits, every second one from the right doubled, ends in 0."""
    figures = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)))
    return F.aggregate(figures, F.lit(0), lambda total, d: total + d) % 10 == 0


def passes_mod97(account: Column) -> Column:
    """Whether the number, its first four characters at the end and letters as 10 to 35, leaves 1 when divided by 97."""
    turned = F.concat(F.substring(account, 5, 40), F.left(account, F.lit(4)))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: (r * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97)
    return rest == 1


def confirmed(kind: str, span: Column) -> Column:
    """Whether a match of the kind's pattern is one."""
    if kind == "ip":
        return span.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        return passes_luhn(digits_of(span))
    if kind == "phone":
        return F.char_length(digits_of(span)).between(8, 15)
    if kind == "iban":
        return passes_mod97(F.translate(span, " -", ""))
    if kind == "ssn":
        # No office gives these out.
        return ~span.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _running(sizes: Column) -> Column:
    """Sums of the first 1, 2, ... entries of a filled array of longs."""
    block = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda b: F.slice(sizes, b * BLOCK + 1, BLOCK))
    grow = lambda sums, s: F.concat(sums, F.array(F.element_at(sums, -1) + s))
    zero = F.array(F.lit(0).cast("long"))
    before = F.aggregate(F.transform(block, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda x, y: x + y)), zero, grow)
    within = F.zip_with(block, F.slice(before, 1, F.size(block)), lambda b, o: F.slice(F.aggregate(b, F.array(o), grow), 2, F.size(b)))
    return F.flatten(within)


def _words(words: tuple[str, ...]) -> str:
    return f"{_BEGIN}(?:{'|'.join(words)}){_END}"


def _spans(kind: Kind, found: Column, pieces: Column) -> Column:
    """array<struct<kind, start, end, text, score>> of the confirmed matches; offsets in code points, end exclusive."""
    ends = _running(F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: (F.char_length(p) + F.char_length(m)).cast("long")))
    placed = F.filter(F.arrays_zip(found.alias("m"), ends.alias("e"), F.slice(pieces, 1, F.size(found)).alias("l"), F.slice(pieces, 2, F.size(found)).alias("r")), lambda x: confirmed(kind.name, x["m"]))

    def span(x: Column) -> Column:
        about = F.translate(F.concat(F.right(x["l"], F.lit(AROUND)), F.lit(" "), F.left(x["r"], F.lit(AROUND))), _UPPER, _LOWER)
        score = F.lit(kind.score)
        if kind.near:
            score = score + F.when(about.rlike(_words(kind.near)), kind.gain).otherwise(0)
        if kind.against:
            score = score - F.when(about.rlike(_words(kind.against)), kind.loss).otherwise(0)
        return F.struct(F.lit(kind.name).alias("kind"), (x["e"] - F.char_length(x["m"])).alias("start"), x["e"].alias("end"), x["m"].alias("text"), (score / 100).alias("score"))

    return F.transform(placed, span)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_score: int = LEAST_SCORE) -> DataFrame:
    """(id, spans), one row for each input row: spans by kind as in KINDS, then by start.

    Spans of BASE are all there, whatever their score, so that a reader may set a bar of
    its own; those of MORE from ``least_score`` hundredths on. Words nearby count up to the next match
    of the kind, at most AROUND code points away. A local phone number isn't looked for
    inside a match of ``phone``. A null or empty text has no spans; repeated rows and null ids
    stay rows of their own; other columns are ignored, whatever they are called. A text of
    any length is one row; its matches are counted off in blocks.
    """
    found = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    marks = {"email": "@", "phone": "+"}
    for k in KINDS:
        text = F.col("_text")
        if k.name == "local_phone":
            # What phone took is covered, so that offsets stay.
            covered = F.zip_with("_p_phone", "_m_phone", lambda p, m: F.concat(p, F.repeat(F.lit("+"), F.coalesce(F.char_length(m), F.lit(0)))))
            text = F.when(F.size("_m_phone") > 0, F.array_join(covered, "")).otherwise(text)
            found = found.withColumn("_text", text)
            text = F.col("_text")
        matches = F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))
        none = F.array().cast("array<string>")
        if k.name in marks:
            matches = F.when(F.contains(text, F.lit(marks[k.name])), matches).otherwise(none)
        # Most texts have no match: their pieces aren't cut.
        found = found.withColumn(f"_m_{k.name}", matches).withColumn(f"_p_{k.name}", F.when(F.size(f"_m_{k.name}") > 0, F.split(text, k.pattern, -1)).otherwise(none))
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,text:string,score:double>>")
    for k in KINDS:
        spans = F.when(F.size(f"_m_{k.name}") > 0, _spans(k, F.col(f"_m_{k.name}"), F.col(f"_p_{k.name}"))).otherwise(empty)
        if k in MORE:
            spans = F.filter(spans, lambda x: x["score"] * 100 >= least_score)
        found = found.withColumn(f"_s_{k.name}", spans)
    return found.select(F.col("_id").alias(id_col), F.concat(*(F.col(f"_s_{k.name}") for k in KINDS)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of rows of ``find``."""
    names = [k.name for k in BASE]
    count = lambda name: F.size(F.filter("spans", lambda x: x["kind"] == name)).cast("long").alias(f"n_{name}")
    base = joined(F.filter("spans", lambda x: x["kind"].isin(names)))
    return found.select(id_col, *map(count, names), F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
