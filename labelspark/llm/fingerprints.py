"""Document fingerprints by a homomorphic multiset hash, in DataFrame operations.

A text is a multiset of paragraphs. Each paragraph is hashed into a wide vector
and the vectors are summed, each lane modulo a power of two, so that the order
of paragraphs does not matter and a paragraph can be added or taken away later.

Vector layout (array of bigint): WORDS words of two lanes, 31 bits apart, that
count how often each hash bit is set (modulo 2**30, so that a sum of two lanes
never runs into the next or into the sign), then the number of paragraphs and three
wide sums, modulo 2**60. Likeness holds for texts of less than 2**30 paragraphs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelspark.session import settle

# A paragraph ends with its line; the sentences of a line count as paragraphs of
# their own, as many documents are one line.
PARAGRAPH = r"\n+|(?<=[.!?])[ \t]+"
WORDS = 30
LANES = 2  # in a word
APART = 31  # bits between lanes
BIT = sum(1 << APART * k for k in range(LANES))
LANE = (1 << 30) - 1
KEEP = LANE * BIT
WIDE = (1 << 60) - 1
# Documents in order are cut into blocks of this many ids; a window holds one.
BLOCK_BITS = 13


def _once(value: Column, function) -> Column:
    """``function(value)`` with ``value`` evaluated a single time."""
    return F.element_at(F.transform(F.array(value), function), 1)


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, PARAGRAPH), lambda p: p != "")


def vector(text: Column) -> Column:
    """The vector of a text; null and empty texts have the zero vector."""
    first = F.transform(paragraphs(F.coalesce(text, F.lit(""))), lambda p: F.struct(
        F.xxhash64(p).alias("a"), F.xxhash64(F.lit("wide"), p).alias("b")))

    def summed(hashes: Column) -> Column:
        zero = F.lit(0).cast("bigint")

        def total(value, mask: int) -> Column:
            return F.aggregate(hashes, zero, lambda sum_, h: (sum_ + value(h)).bitwiseAND(F.lit(mask)))

        lanes = [
            total(lambda h, j=j: F.shiftrightunsigned(h["a"], j).bitwiseAND(F.lit(BIT)), KEEP) for j in range(WORDS)
        ]
        wide = [
            F.size(hashes).cast("bigint"),
            total(lambda h: h["a"].bitwiseAND(F.lit(WIDE)), WIDE),
            total(lambda h: h["b"].bitwiseAND(F.lit(WIDE)), WIDE),
            total(lambda h: F.xxhash64(h["b"], h["a"]).bitwiseAND(F.lit(WIDE)), WIDE),
        ]
        return F.array(*lanes, *wide)

    return _once(first, summed)


def combined(a: Column, b: Column) -> Column:
    """The vector of both multisets together, lane by lane."""
    lanes = F.zip_with(F.slice(a, 1, WORDS), F.slice(b, 1, WORDS), lambda x, y: (x + y).bitwiseAND(F.lit(KEEP)))
    wide = F.zip_with(F.slice(a, WORDS + 1, 4), F.slice(b, WORDS + 1, 4), lambda x, y: (x + y).bitwiseAND(F.lit(WIDE)))
    return F.concat(lanes, wide)


def inverse(vec: Column) -> Column:
    """The vector that takes paragraphs away: ``combined(v, inverse(v))`` is zero."""
    lanes = F.transform(F.slice(vec, 1, WORDS), lambda x: (F.lit(KEEP) - x + F.lit(BIT)).bitwiseAND(F.lit(KEEP)))
    wide = F.transform(F.slice(vec, WORDS + 1, 4), lambda x: (F.lit(WIDE) - x + 1).bitwiseAND(F.lit(WIDE)))
    return F.concat(lanes, wide)


def as_text(vec: Column) -> Column:
    """Lowercase hex, 16 digits per element."""
    return F.lower(F.array_join(F.transform(vec, lambda v: F.lpad(F.hex(v), 16, "0")), ""))


def _balance(vec: Column) -> Column:
    """Per lane: set minus unset bits, as a number around zero (modulo 2**31)."""
    count = F.element_at(vec, WORDS + 1)

    def lane(word: Column, k: int) -> Column:
        set_ = F.shiftrightunsigned(word, APART * k).bitwiseAND(F.lit(LANE))
        return (F.pmod(set_ * 2 - count + (LANE + 1), F.lit(2 * LANE + 2)) - (LANE + 1)).cast("double")

    def of(word: Column) -> Column:
        return F.array(*[lane(word, k) for k in range(LANES)])

    return F.flatten(F.transform(F.slice(vec, 1, WORDS), of))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: an estimate of the shared weight of two multisets.

    The lanes of a difference have mean square equal to the squared size of the
    symmetric difference; equal vectors give exactly 1.
    """

    def of(pair: Column) -> Column:
        square = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x * x)
        apart = square(F.zip_with(pair["a"], pair["b"], lambda x, y: x - y))
        return F.greatest(F.lit(0.0), 1 - apart / F.greatest(square(pair["a"]) + square(pair["b"]), F.lit(1.0)))

    return F.when(a == b, 1.0).otherwise(_once(F.struct(_balance(a).alias("a"), _balance(b).alias("b")), of))


def with_next(docs: DataFrame, value: Column, block_bits: int = BLOCK_BITS) -> DataFrame:
    """(doc_id, own, next): ``value`` of each document and of the one after it.

    The order is by doc_id, after the last comes the first; equal ids follow
    each other by a hash of the value. A null id has no place in the order and
    is its own next. The documents are shuffled once, by blocks of ids; a copy
    of each block's first document closes the block before it. No window holds
    more than one block of distinct ids.
    """
    known = docs.filter(F.col("doc_id").isNotNull())
    block = F.shiftright(F.col("doc_id"), block_bits)
    firsts = known.groupBy(block.alias("_block")).agg(F.min("doc_id").alias("_first"))
    firsts = firsts.withColumn("_region", F.shiftright("_block", block_bits))
    regions = firsts.groupBy("_region").agg(F.max("_block").alias("_last"))
    everything = W.orderBy("_region")  # one row per 2**26 ids
    regions = regions.select(
        "_region", F.coalesce(F.lag("_last").over(everything), F.max("_last").over(W.partitionBy())).alias("_before")
    )
    inside = F.lag("_block").over(W.partitionBy("_region").orderBy("_block"))
    # stored, so that Spark knows its size before it plans the join with the texts
    guards = settle(
        firsts.withColumn("_inside", inside).join(regions, "_region").select(
            F.col("_first").alias("doc_id"), F.coalesce("_inside", "_before").alias("_block")
        ),
        "guards",
    )
    own = known.select("doc_id", value.alias("own"), F.lit(0).alias("_guard"), block.alias("_block"))
    closing = known.join(guards, "doc_id").select("doc_id", value.alias("own"), F.lit(1).alias("_guard"), "_block")
    order = W.partitionBy("_block").orderBy("_guard", "doc_id", F.xxhash64("own"))
    linked = own.unionByName(closing).withColumn("next", F.lead("own").over(order)).filter(F.col("_guard") == 0)
    alone = docs.filter(F.col("doc_id").isNull()).select("doc_id", value.alias("own")).withColumn("next", F.col("own"))
    return linked.select("doc_id", "own", "next").unionByName(alone)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of the text with its second half replaced
    by the start of the next document; see ``with_next`` for the order.

    A null text counts as empty; an empty or one-character text is not changed.
    Other columns are not read. No rows give no rows.
    """
    text = F.coalesce("text", F.lit(""))
    pairs = with_next(docs.select("doc_id", "text"), F.struct(text.alias("text"), vector(F.col("text")).alias("vec")))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substring("own.text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next.text", F.lit(1), half)
    )
    made = (
        pairs.withColumn("n_chars", F.char_length("own.text").cast("bigint"))
        .withColumn("_edited", edited)
        .select("doc_id", "n_chars", "own.vec", F.col("next.vec").alias("next_vec"), F.sha2("_edited", 256).alias("edited_sha256"),
                vector(F.col("_edited")).alias("edited_vec"))
    )
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("vec")).alias("fingerprint"),
        as_text(F.col("edited_vec")).alias("edited_fingerprint"),
        likeness(F.col("vec"), F.col("edited_vec")).alias("near_edited"),
        likeness(F.col("vec"), F.col("next_vec")).alias("near_next"),
    )
