"""Reproducible shuffle into shards: a Feistel permutation over global row numbers.

Rows are numbered by (doc_id, checksum, size); the number goes through a keyed
permutation of 0..N-1 and the result says shard (remainder) and slot (quotient). Any
row's place can be computed from its number, and a number's row from its place
(the rounds run backwards); counts of shards differ by one at most (law ``rows``).

DataFrame functions only. The permutation works on a grid of a x b >= N cells with
a, b near the square root of N; a result outside 0..N-1 walks on along its cycle.

Defined cases: null texts have size 1 and checksum 0; null doc_ids come first; equal
rows are numbered one after the other; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import stash

ROUNDS = 6
_PARTITION_BITS = 33


def _feistel(x: Column, a: int, b: int, seed: int, rounds: int) -> Column:
    """One pass of the permutation of 0..a*b-1; the halves change sides (and sizes) every round."""

    def turn(halves: Column, k: Column) -> Column:
        size = F.when(k % 2 == 0, F.lit(a)).otherwise(F.lit(b)).cast("long")  # of the left half in this round
        noise = F.pmod(F.xxhash64(F.lit(seed), k, halves["right"]), size)
        return F.struct(halves["right"].alias("left"), F.pmod(halves["left"] + noise, size).alias("right"))

    def joined(halves: Column) -> Column:
        high, low = (halves["left"], halves["right"]) if rounds % 2 == 0 else (halves["right"], halves["left"])
        return high * F.lit(b).cast("long") + low

    start = F.struct(F.floor(x / F.lit(b)).cast("long").alias("left"), F.pmod(x, F.lit(b).cast("long")).alias("right"))
    return F.aggregate(F.array(*map(F.lit, range(rounds))), start, turn, joined)


def grid(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permuted(df: DataFrame, number: str, n: int, seed: int = 17, rounds: int = ROUNDS, out: str = "position") -> DataFrame:
    """Add the permuted position of a row number in 0..n-1.

    Fewer than a of the a*b cells lie outside, so nearly every walk ends at once; should
    a row still be outside after ``steps``, the walk is made longer (it ends at the latest
    after as many steps as there are cells outside).
    """
    a, b = grid(n)
    outside, steps = a * b - n, 8

    def walk(steps: int) -> Column:
        first = _feistel(F.col(number).cast("long"), a, b, seed, rounds)
        if not outside:
            return first
        on = lambda p, _: F.when(p >= F.lit(n), _feistel(p, a, b, seed, rounds)).otherwise(p)
        return F.aggregate(F.sequence(F.lit(1), F.lit(min(steps, outside))), first, on)

    while steps < outside and not df.select(walk(steps).alias(out)).filter(F.col(out) >= F.lit(n)).isEmpty():
        steps *= 4
    return df.withColumn(out, walk(steps))


def numbered(df: DataFrame, keys: list[str], out: str = "number") -> DataFrame:
    """Global row numbers from 0 in the order of ``keys``; equal rows are told apart by their place in the input.

    Sorted in ranges; a row's number is its place in its range plus the rows of the
    ranges before. The rows are written once, so the ranges stay fixed.
    """
    ranged = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie").withColumn("_place", F.monotonically_increasing_id())
    ranged = stash(ranged.drop("_tie"), "ranges")
    part = F.shiftrightunsigned(F.col("_place"), _PARTITION_BITS)
    counts = ranged.groupBy(part.alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per range: a list as long as the number of tasks.
    counts = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.col("_place").bitwiseAND(F.lit((1 << _PARTITION_BITS) - 1))
    return ranged.withColumn("_range", part).join(counts, "_range").withColumn(out, F.col("_before") + place).drop("_range", "_before", "_place")


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """Shard and slot of every document, with size and checksum of its text."""
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    rows = numbered(rows, ["doc_id", "text_crc32", "size"])
    placed = permuted(rows, "number", rows.count(), seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.pmod("position", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("position") / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("number").alias("row_number"),
    )
