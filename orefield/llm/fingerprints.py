"""Document fingerprints by winnowing.

A text's words ([^\\x20\\x09-\\x0D]+, longer runs in pieces of 32 code points) become symbols, each run of K_GRAM symbols a
polynomial rolling hash modulo 2^31 - 1. Of every WINDOW adjacent hashes the least is chosen, of equal ones the rightmost.
So any two texts that share K_GRAM + WINDOW - 1 words in a row share a fingerprint there. A choice is kept as (hash,
position): a 64-bit hash of its symbols and the number of the word where it begins. A text of fewer words is one k-gram;
one without words has no fingerprint. Equal texts have equal fingerprints.

Rolling and sliding minimum are built by doubling (hashes of 1, 2, 4 words; minima of 1, 2, 4, 8 hashes), which gives what
a loop gives, from built-in functions only. Arrays are worked off in blocks of BLOCK windows; what a task keeps whole is
one text and a long for each of its words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, positions

K_GRAM = 5
#: A power of two.
WINDOW = 8
BLOCK = 4096
PRIME, BASE = (1 << 31) - 1, 1_000_003
LOW = (1 << 32) - 1
WORDS = r"'[^\\x20\\x09-\\x0D]{1,32}'"
#: Bytes of text in a slot of neighbours; cuts on either of the two levels that deal rows into slots.
SLOT_BYTES, CUTS = 2 << 20, 512
#: Partitions at most; beyond that each holds several slots.
MOST_PARTITIONS = 16_384


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is evaluated once however often body names it."""
    return F.transform(F.array(value), body)[0]


def _joined(left: Column, right: Column, by: int, join: Callable[[Column, Column], Column]) -> Column:
    """join of left[i] and right[i + by], as far as right goes."""
    return F.zip_with(F.slice(left, 1, F.greatest(F.size(right) - by, F.lit(0))), F.slice(right, by + 1, F.size(right)), join)


def _filled(values: Column, n: int, filler: int) -> Column:
    """values with fillers at the end up to n, if there is any value."""
    return _once(values, lambda a: F.when(F.size(a).between(1, n - 1), F.concat(a, F.array_repeat(F.lit(filler).cast("long"), n - F.size(a)))).otherwise(a))


def rolling_hashes(symbols: Column, k: int) -> Column:
    """Of each k adjacent symbols the sum of symbol[j] * BASE^(k - 1 - j), modulo PRIME."""

    def appended(width: int) -> Callable[[Column, Column], Column]:
        return lambda left, right: (left * pow(BASE, width, PRIME) + right) % PRIME

    def hashes(s: Column, width: int) -> Column:
        if width == 1:
            return s
        if width % 2:
            return _joined(hashes(s, width - 1), s, width - 1, appended(1))
        return _once(hashes(s, width // 2), lambda h: _joined(h, h, width // 2, appended(width // 2)))

    return _once(F.transform(symbols, lambda x: F.pmod(x, F.lit(PRIME))), lambda s: hashes(s, k))


def sliding_least(values: Column, window: int) -> Column:
    """The least of each window adjacent values."""
    width = 1
    while width < window:
        values, width = _once(values, lambda v: _joined(v, v, width, lambda a, b: F.least(a, b))), 2 * width
    return values


def _chosen(symbols: Column, begin: Column) -> Column:
    """hash * 2^32 + 2^32 - 1 - position of the choices among a block's windows: the least is the rightmost of the least hashes."""
    hashes = rolling_hashes(_filled(symbols, K_GRAM, 0), K_GRAM)
    placed = F.transform(hashes, lambda h, i: h * (LOW + 1) + (F.lit(LOW) - begin - i))
    return F.array_distinct(sliding_least(_filled(placed, WINDOW, (1 << 63) - 1), WINDOW))


def winnowed(text: Column) -> Column:
    """array<struct<hash long, position int>> in order of the positions; null counts as empty."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.expr(WORDS), F.lit(0))
    windows = lambda s: F.greatest(F.size(s) - (K_GRAM + WINDOW - 2), F.lit(1))

    def of(s: Column) -> Column:
        begins = F.sequence(F.lit(0), windows(s) - 1, F.lit(BLOCK))
        blocks = F.transform(begins, lambda b: _chosen(F.slice(s, b + 1, F.lit(BLOCK + K_GRAM + WINDOW - 2)), b.cast("long")))
        at = F.transform(F.array_distinct(F.flatten(blocks)), lambda v: (F.lit(LOW) - v.bitwiseAND(F.lit(LOW))).cast("int"))
        return F.transform(at, lambda p: F.struct(F.xxhash64(F.slice(s, p + 1, F.lit(K_GRAM))).alias("hash"), p.alias("position")))

    return _once(F.transform(words, lambda w: F.xxhash64(w)), of)


def likeness(one: Column, other: Column) -> Column:
    """Jaccard similarity of the hashes of two fingerprints; two without any are alike."""
    a, b = F.transform(one, lambda x: x["hash"]), F.transform(other, lambda x: x["hash"])
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def as_text(fingerprint: Column) -> Column:
    """hash:position, hash in 16 hex digits, joined by blanks."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat(F.lpad(F.lower(F.hex(x["hash"])), 16, "0"), F.lit(":"), x["position"].cast("string"))), " ")


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, fingerprint, next_text, next_fingerprint of each row; the next one follows by key, after the last comes the first.

    Keys of any type that has an order; null is the least. Rows of one key follow by a hash of their texts; equal rows
    follow each other. Null texts count as empty. A table of one row is its own neighbour.

    Keys and hashes alone are ordered over all rows; every so many of them is a cut. Rows are dealt by the cuts, at most
    CUTS * CUTS of them, into slots of even size, and the row at each cut goes to the slot before it as well. So texts are
    shuffled once.
    """
    scratch = Scratch(df.sparkSession, "fingerprints")
    rows = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("at", F.struct("doc_id", F.xxhash64("text").alias("h")))
    keys = scratch.written(rows.groupBy("at").agg(F.sum(F.octet_length("text")).alias("bytes")), "keys")
    n, size = keys.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    each = max(1, -(-n // min(CUTS * CUTS, size // SLOT_BYTES + 1)))
    slots = max(1, -(-n // each))
    ordered = positions(keys.select("at"), F.col("at"), scratch).filter(F.col("position") % each == 0)
    cuts = scratch.written(ordered.select("at", F.expr(f"position div {each}").alias("i")), "cuts")
    upper = cuts.filter(F.col("i") % CUTS == 0).agg(F.sort_array(F.collect_list("at")).alias("upper"))
    lower = cuts.groupBy(F.expr(f"i div {CUTS}").alias("level")).agg(F.sort_array(F.collect_list("at")).alias("lower"))

    def place(cuts: Column) -> Column:
        return (F.size(F.filter(cuts, lambda c: c <= F.col("at"))) - 1).cast("long")

    dealt = rows.crossJoin(F.broadcast(upper)).withColumn("level", place(F.col("upper"))).join(F.broadcast(lower), "level").withColumn("slot", F.col("level") * CUTS + place(F.col("lower")))
    own, border = F.struct("slot", F.lit(0).alias("border")), F.struct(F.pmod(F.col("slot") - 1, F.lit(slots)).alias("slot"), F.lit(1).alias("border"))
    sent = dealt.select("at", "text", F.explode(F.when(F.array_contains("lower", F.col("at")), F.array(own, border)).otherwise(F.array(own))).alias("to")).select("at", "text", "to.*")
    here = sent.repartition(min(slots, MOST_PARTITIONS), "slot").withColumn("fingerprint", winnowed(F.col("text")))
    order = Window.partitionBy("slot").orderBy("border", "at")
    both = here.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", "fingerprint")}).filter("border = 0")
    return both.select("at.doc_id", "text", "fingerprint", "next_text", "next_fingerprint")


def edited_fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """with_next, and edited: the text with its last quarter (in code points, rounded down) replaced by as many of the next one's first, or all it has, and its fingerprint."""
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    out = with_next(df, key, text).withColumn("edited", F.concat(F.left(F.col("text"), n - quarter), F.left(F.col("next_text"), quarter)))
    return out.withColumn("edited_fingerprint", winnowed(F.col("edited")))
