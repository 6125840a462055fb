"""Document fingerprints (operator 1): a homomorphic multiset hash of paragraphs.

Each paragraph (line) is hashed to a wide vector, the sum of the sign vectors of its word
pairs and of itself as a whole; the fingerprint of a text is the sum of its paragraphs'
vectors modulo 2**16 in every lane. So it doesn't depend on the order of paragraphs, and
those of single paragraphs can be added or taken away: the fingerprint of an edited text is
made of that of the whole one and those of the paragraphs that change. The lanes are signs
from several independent hashes, so the squared difference of two fingerprints estimates how
many elements the texts don't share. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hashes of an element; each bit of each of them is the sign of one lane.
SEEDS = (1, 2, 3, 4)
LANES, MODULUS = 64 * len(SEEDS), 1 << 16
#: Two bits of a 64-bit hash, 32 places apart, summed in one long: no overflow below 2**31 elements.
_PAIR = (1 << 32) + 1
#: Bits of an id below the bucket of documents whose texts are sorted together.
BUCKET_BITS = 6
#: If any bucket has more rows than this, all are split by single ids and text hashes.
CROWD = 4096


def _around_zero(x: Column) -> Column:
    return (F.pmod(x + MODULUS // 2, F.lit(MODULUS)) - MODULUS // 2).cast("smallint")


def fingerprints(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys and ``lanes`` (LANES small integers from -2**15), for rows (keys, text), one for each distinct key.

    Rows of equal keys are paragraphs of one multiset. The text isn't null.
    """
    paragraphs = texts.select(*keys, F.explode(F.split(text_col, "\n")).alias("_p"))
    # The words are a column of their own, so that they are split once.
    words = paragraphs.select(*keys, "_p", F.split("_p", " ").alias("_w"))
    pairs = F.arrays_zip(F.col("_w").alias("a"), F.slice("_w", F.lit(2), F.greatest(F.size("_w"), F.lit(1))).alias("b"))
    # No word holds a newline, so a paragraph is no word pair.
    elements = words.select(*keys, F.explode(F.concat(pairs, F.array(F.struct(F.lit("\n").alias("a"), F.col("_p").alias("b"))))).alias("_e"))
    rows = elements.select(*keys, *(F.xxhash64(F.lit(s), F.col("_e.a"), F.col("_e.b")).alias(f"_e{s}") for s in SEEDS))
    ones = [F.sum(F.shiftrightunsigned(f"_e{s}", k).bitwiseAND(F.lit(_PAIR))).alias(f"_{s}_{k}") for s in SEEDS for k in range(32)]
    summed = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *ones)

    def lane(bits: Column) -> Column:  # each bit counts as -1 or 1
        return _around_zero(2 * bits - F.col("_n"))

    low = [lane(F.col(f"_{s}_{k}").bitwiseAND(F.lit((1 << 32) - 1))) for s in SEEDS for k in range(32)]
    high = [lane(F.shiftright(f"_{s}_{k}", 32)) for s in SEEDS for k in range(32)]
    return summed.select(*keys, F.array(*low, *high).alias("lanes"))


def merged(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes with the paragraphs of b added (sign 1) or taken away (-1)."""
    return F.zip_with(a, b, lambda x, y: _around_zero(x.cast("long") + sign * y.cast("long")))


def text_of(lanes: Column) -> Column:
    """Four hex digits for each lane."""
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(F.pmod(x.cast("long"), F.lit(MODULUS)))), 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, about 0 for texts that share nothing: 1 - |a - b|**2 / (|a|**2 + |b|**2), at least 0."""
    def squares(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, y: s + y.cast("double") * y)

    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.try_divide(squares(merged(a, b, -1)), squares(a) + squares(b))))


def _next_number(numbers: DataFrame) -> DataFrame:
    """(hi, following): the next larger one of distinct numbers; after the last the first.

    By levels of 2**16 children, so that no task sees more than these; the level on top has
    at most 2**10 rows.
    """
    level = numbers.select(F.col("hi").alias("node"), F.col("hi").alias("first"), F.col("hi").alias("last"))
    links = None
    for bits in (16, 32, 48, None):
        up = F.shiftright("first", bits) if bits else F.lit(0).cast("long")
        level = level.withColumn("up", up)
        following = F.lead("first").over(Window.partitionBy("up").orderBy("first"))
        found = level.select(F.col("last").alias("hi"), following.alias("following")).where("following is not null")
        links = found if links is None else links.union(found)
        level = level.groupBy(F.col("up").alias("node")).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return links.union(level.select(F.col("last").alias("hi"), F.col("first").alias("following")))


def _next_bucket(buckets: DataFrame) -> DataFrame:
    """(hi, lo, next_hi, next_lo): the next one of distinct buckets; a hi has at most 2**30 of them."""
    inner = buckets.select("hi", "lo", F.col("hi").alias("next_hi"), F.lead("lo").over(Window.partitionBy("hi").orderBy("lo")).alias("next_lo"))
    ends = buckets.groupBy("hi").agg(F.min("lo").alias("least"), F.max("lo").alias("most"))
    across = ends.join(_next_number(ends.select("hi")), "hi").join(ends.select(F.col("hi").alias("following"), F.col("least").alias("next_lo")), "following")
    return inner.where("next_lo is not null").union(across.select("hi", F.col("most").alias("lo"), F.col("following").alias("next_hi"), "next_lo"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, hi, lo, place, times, _text, next_text, across): each text with that of the next larger id, after the last the first.

    (hi, lo, place) numbers the rows; across tells that the next row has another (hi, lo). A
    null id comes before all others; rows of one id
    follow each other by their text hash. Null texts are empty. Each text is dealt once,
    with the few of its bucket of 64 ids; only the first one of each bucket is dealt again.
    Where ids crowd (null or repeated ones), buckets are those of one id and 24 bits of the
    text hash, and equal rows are counted before they are dealt: all but the last of them are followed
    by their like, and stand for ``times`` rows.
    """
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    hi = F.shiftright(ids, BUCKET_BITS)
    crowded = not docs.groupBy(hi.alias("hi")).count().where(F.col("count") > CROWD).isEmpty()
    rows = docs.select(F.col(id_col).alias("_id"), ids.alias("_order"), hi.alias("hi"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    by_id = F.shiftleft(F.col("_order").bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)), 24) + F.shiftright(F.xxhash64("_text"), 40) + (1 << 23)
    rows = rows.withColumn("lo", by_id if crowded else F.lit(0).cast("long"))
    order = Window.partitionBy("hi", "lo").orderBy("_order", F.xxhash64("_text"))
    if crowded:
        rows = rows.groupBy("_id", "_order", "hi", "lo", "_text").agg(F.count(F.lit(1)).alias("times"))
    else:
        rows = rows.withColumn("times", F.lit(1).cast("long"))
    placed = rows.select("_id", "hi", "lo", F.row_number().over(order).alias("place"), "times", "_text", F.lead("_text").over(order).alias("next_text"))
    heads = placed.where("place = 1").select(F.col("hi").alias("next_hi"), F.col("lo").alias("next_lo"), F.col("_text").alias("head_text"))
    following = _next_bucket(rows.select("hi", "lo").distinct()).join(heads, ["next_hi", "next_lo"]).select("hi", "lo", "head_text")
    across = F.col("next_text").isNull()
    linked = placed.join(following, ["hi", "lo"]).select("_id", "hi", "lo", "place", "times", "_text", F.coalesce("next_text", "head_text").alias("next_text"), across.alias("across"))
    if not crowded:
        return linked
    like = F.struct((2 * F.col("place")).alias("place"), (F.col("times") - 1).alias("times"), F.col("_text").alias("next_text"), F.lit(False).alias("across"))
    last = F.struct((2 * F.col("place") + 1).alias("place"), F.lit(1).cast("long").alias("times"), "next_text", "across")
    each = linked.select("_id", "hi", "lo", "_text", F.explode(F.filter(F.array(like, last), lambda x: x["times"] > 0)).alias("x"))
    return each.select("_id", "hi", "lo", "x.place", "x.times", "_text", "x.next_text", "x.across")


def edited_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row for each input row.

    The edited text has the last half of its code points (rounded down) replaced by as many
    of the first ones of the next document, or by all if that has fewer. Its fingerprint is
    that of the text, without the paragraphs from the cut on, with those that take their
    place. Null and empty texts are one empty paragraph. For order, ties and null ids see
    with_next; other columns are ignored. A text has to fit a row, as all of its words do.
    """
    pairs = with_next(docs, id_col, text_col).withColumn("n_chars", F.char_length("_text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    pairs = pairs.withColumn("kept", F.left("_text", F.col("n_chars").cast("int") - half)).withColumn("taken", F.left("next_text", half))
    # The paragraph of the cut is the last one of the kept part; those before it stay.
    pairs = pairs.withColumn("cut", F.substring_index("kept", "\n", -1)).withColumn("whole", F.char_length("kept") - F.char_length("cut"))
    variants = F.array(
        F.struct(F.lit(0).alias("variant"), F.when(F.col("whole") > 0, F.left("kept", F.col("whole") - 1)).alias("part")),
        F.struct(F.lit(1).alias("variant"), F.substring("_text", F.col("whole") + 1, F.char_length("_text")).alias("part")),
        F.struct(F.lit(2).alias("variant"), F.concat("cut", "taken").alias("part")),
        F.struct(F.lit(3).alias("variant"), F.when(F.col("across"), F.col("next_text")).alias("part")))
    own = ["_id", "hi", "lo", "place", "times", "n_chars", "edited_sha256"]
    parts = pairs.withColumn("edited_sha256", F.sha2(F.concat("kept", "taken"), 256)).select(
        *own, F.explode(F.filter(variants, lambda v: v["part"].isNotNull())).alias("v")).select(*own, "v.variant", F.col("v.part").alias("_part"))
    lanes = fingerprints(parts, [*own, "variant"], "_part")
    each = lanes.groupBy(*own).agg(*(F.first(F.when(F.col("variant") == k, F.col("lanes")), ignorenulls=True).alias(f"f{k}") for k in range(4)))
    stays = lambda x: F.when(F.col("f0").isNull(), F.col(x)).otherwise(merged(F.col("f0"), F.col(x)))
    whole = each.select(*own, stays("f1").alias("text_lanes"), "f1", "f2", "f3")
    edited = merged(merged(F.col("text_lanes"), F.col("f1"), -1), F.col("f2"))
    order = Window.partitionBy("hi", "lo").orderBy("place")
    done = whole.select(*own, "text_lanes", edited.alias("edited_lanes"), F.coalesce("f3", F.lead("text_lanes").over(order)).alias("next_lanes"))
    done = done.withColumn("_one", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return done.select(
        F.col("_id").alias(id_col), "n_chars", "edited_sha256", text_of(F.col("text_lanes")).alias("fingerprint"), text_of(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("text_lanes"), F.col("edited_lanes")).alias("near_edited"), likeness(F.col("text_lanes"), F.col("next_lanes")).alias("near_next"))
