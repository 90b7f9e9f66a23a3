"""Exact deduplication by block naming.

Each normalised text is cut into fixed-size blocks. Distinct blocks are sorted and
get integer names; then the names of adjacent blocks are paired, the distinct pairs
get names of their own, and so on until every document has one name. Two texts have
the same (level, name) exactly when they are equal: nothing rests on a hash that
could collide.

Blocks travel to their names as a pair of 64-bit hashes. That the pair tells all
distinct blocks apart is checked on every run over all blocks, and on a clash the
naming starts again with other seeds.

Defined cases: a null text counts as empty; equal rows are separate members of a
group; of equal doc_ids one row stays; null doc_ids come last; an empty table gives
no rows; other columns are ignored (``drop_duplicates`` keeps them).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import stash
from tidegrid.llm.near_dedup import numbered

BLOCK_BYTES = 4096


def normalised(text: Column) -> Column:
    """Every run of white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _blocks(data: Column, size: int) -> Column:
    count = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / F.lit(size)).cast("int"))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(data, i * F.lit(size) + 1, F.lit(size)))


def _hashes(block: Column, seed: int) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(2 * seed), block), F.xxhash64(F.lit(2 * seed + 1), block)


def _named(distinct: DataFrame, order: list[str]) -> DataFrame:
    """Sorted within tasks and numbered: the task in the high bits, the place in the low ones."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def document_names(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hashes: Callable = _hashes, attempts: int = 8) -> DataFrame:
    """Rows (row, doc_id, text_sha256, level, name), one per document; equal texts share (level, name)."""
    data = F.encode(normalised(F.col("text")), "UTF-8")
    source = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", data.alias("data"))
    for seed in range(attempts):
        h1, h2 = hashes(F.col("block"), seed)
        blocks = source.select(F.explode(_blocks(F.col("data"), block_bytes)).alias("block"))
        # One row per distinct block: equal blocks meet before the shuffle.
        names = stash(_named(blocks.select(h1.alias("h1"), h2.alias("h2"), "block").groupBy("h1", "h2", "block").agg(F.lit(1).alias("one")), ["block"]).select("h1", "h2", "name"), "names")
        if names.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            break
    else:
        raise RuntimeError("no seed tells the blocks apart")

    def keys(b: Column) -> Column:
        one, two = hashes(b, seed)
        return F.struct(one.alias("h1"), two.alias("h2"))

    heads = stash(source.select("row", "doc_id", F.sha2("data", 256).alias("text_sha256"), F.transform(_blocks(F.col("data"), block_bytes), keys).alias("keys")), "heads")
    placed = heads.select("row", F.size("keys").alias("blocks"), F.posexplode("keys").alias("at", "key"))
    current = stash(placed.select("row", "blocks", "at", "key.h1", "key.h2").join(names, ["h1", "h2"]).select("row", "blocks", "at", "name"), "level")
    level, done = 0, None
    while True:
        ended = current.filter("blocks = 1").select("row", F.lit(level).alias("level"), "name")
        done = ended if done is None else done.unionByName(ended)
        current = current.filter("blocks > 1")
        if current.isEmpty():
            break
        level += 1
        pairs = current.groupBy("row", "blocks", F.expr("at div 2").cast("int").alias("at")).agg(
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("first"),
            F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("second"),
        )
        pairs = stash(pairs.withColumn("blocks", F.expr("(blocks + 1) div 2").cast("int")), "pairs")
        named = _named(pairs.select("first", "second").distinct(), ["first", "second"])
        current = stash(pairs.join(named, ["first", "second"]).select("row", "blocks", "at", "name"), "level")
    return heads.select("row", "doc_id", "text_sha256").join(done, "row")


def duplicate_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every document."""
    names = stash(document_names(docs, block_bytes), "identities")
    low = names.groupBy("level", "name").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # The row that stays: the first of those with the smallest doc_id.
    first = names.join(low, ["level", "name"]).filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("level", "name").agg(F.min("row").alias("keep_row"))
    groups = low.join(first, ["level", "name"])
    return names.join(groups, ["level", "name"]).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that stay, all columns as they were: of equal texts the first row with the smallest doc_id.

    Rows are numbered once and judged by number, so a doc_id may repeat. Only the numbers
    of the rows that go meet the texts again. A null doc_id comes after all others.
    """
    given = {c: f"given_{i}" if c == "row" else c for i, c in enumerate(docs.columns)}
    rows = numbered(docs.withColumnsRenamed(given))
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = duplicate_groups(rows.select(who.alias("doc_id"), "text"), block_bytes)
    gone = stash(groups.filter(~F.col("kept")).select(F.col("doc_id")["row"].alias("row")), "gone")
    return rows.join(gone, "row", "left_anti").select(*(F.col(f"`{now}`").alias(c) for c, now in given.items()))
