"""Near-duplicate detection by MinHash with tensored banding.

A document is the set of its distinct word shingles. Documents are linked when the
intersection of their sets has at least ``percent`` hundredths of the union.

* Two collections of ``m`` half keys, each of ``a`` min-hashes, are computed. Table
  (i, j) has the key (A_i, B_j): m*m tables out of 2*m*a min-hashes.
* Documents with equal sets are one node from here on. Half keys that no other node
  has are dropped before tables are formed.
* Round 1 compares each member of a bucket with the bucket's centre, the member whose
  half keys are the most common ones, and finds the components of the confirmed links.
* Round 2 takes the buckets that still hold several components, and compares their
  members across components. A pair inside one component needs no comparison: it
  cannot change which documents are connected. So every pair that shares a key is
  either connected already or compared, and no bucket is cut off.
* For round 2 the shingles of a node are put in one common order, the rarest first. Two
  sets can only reach the limit if they share a shingle early in this order, and the
  shingles before the first shared one are lost to the intersection. So much changed
  copies of one text, which are close to none of the others, are not paired with them.
* A pair is compared by two bits of each min-hash first (a pair at the limit fails this
  by chance less than once in 10^7), then confirmed on the full sets of 64-bit shingle
  hashes.

A pair at the limit shares a key with probability 0.9999 at least, more similar pairs with
more: m = 14 and a = 3 from 0.8 on, and numbers made for the limit below it (``plan_for``).
The lower the limit, the more keys a document has.

Defined cases: null, empty and white-space texts have no shingles and no links; texts
with fewer words than a shingle are one shingle; rows with equal doc_ids are separate
rows; null doc_ids are ignored in the smallest id of a component unless it has no other
(the row is kept then if it is alone); empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.common import small_batches, stash, texts_of, words_of
from tidegrid.llm.sharding import numbered as in_order

HALF_KEYS = 14
HALF_KEY_HASHES = 3
SHINGLE_WORDS = 5
PERCENT = 80
#: Probability with which a pair at the limit may share no key.
MISSED = 1e-4
#: Bound of the word memo in one task.
MEMO_WORDS = 400_000


class _WordHashes(dict):
    """64-bit hash of each word."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def plan_for(percent: int) -> tuple[int, int]:
    """Half keys and hashes of each for a limit: the longest half keys that need no more than 24, or single hashes."""
    if not 0 < percent <= 100:
        raise ValueError(f"percent is {percent}, not 1 to 100")
    if percent >= PERCENT:
        return HALF_KEYS, HALF_KEY_HASHES
    for a in (3, 2, 1):
        # Both collections have to agree somewhere: (1 - miss) ** 2 >= 1 - MISSED.
        m = math.ceil(math.log(1 - math.sqrt(1 - MISSED)) / math.log(1 - (percent / 100) ** a))
        if m <= 24 or a == 1:
            return m, a


def sign_limit(percent: int, hashes: int) -> int:
    """Bits (of two for each min-hash) in which a pair may differ to be compared in full: six
    standard deviations above the mean at the limit (at 0.8 for limits above). Two bits of
    min-hashes that differ have one difference on average, and its square is 1.5."""
    differ = 1 - min(percent, PERCENT) / 100
    return math.ceil(hashes * differ + 6 * math.sqrt(hashes * (1.5 * differ - differ**2)))


def shingle_hashes(words: list[bytes], width: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a word list."""
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(width, len(ids))
    n = len(ids) - width + 1
    mixed = np.full(n, width, np.uint64)
    for k in range(width):
        mixed = (mixed ^ ids[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def min_hashes(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[at : at + 2048, None] * factors + shifts).min(axis=0), out=least)
    return least


def sketches(docs: DataFrame, width: int, m: int, a: int, seed: int = 5) -> DataFrame:
    """From (row, doc_id, text): row, doc_id, n_shingles, d1, d2 (digest of the set), halves (2*m longs), signs (longs of two bits per min-hash)."""
    longs = T.ArrayType(T.LongType())
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("n_shingles", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()),
            T.StructField("halves", longs), T.StructField("signs", longs),
        ]
    )
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 2**63, 2 * m * a, np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 2**63, 2 * m * a, np.uint64)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known = _WordHashes()
        for batch in small_batches(batches):
            count, one, two, halves, signs = [], [], [], [], []
            for text in texts_of(batch):
                shingles = shingle_hashes(words_of(text), width, known)
                count.append(len(shingles))
                if not len(shingles):
                    one.append(0), two.append(0), halves.append(None), signs.append(None)
                    continue
                digest = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64)
                one.append(int(digest[0])), two.append(int(digest[1]))
                least = min_hashes(shingles, factors, shifts)
                groups = least.reshape(2 * m, a)
                key = np.full(2 * m, 7, np.uint64)
                for k in range(a):
                    key = (key ^ groups[:, k]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(31)
                halves.append(key.view(np.int64))
                bits = np.concatenate([least & np.uint64(1), (least >> np.uint64(1)) & np.uint64(1)]).astype(bool)
                padded = np.zeros(-(-len(bits) // 64) * 64, bool)
                padded[: len(bits)] = bits
                signs.append(np.packbits(padded).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (count, one, two)),
                    *(pa.array(x, pa.list_(pa.int64())) for x in (halves, signs)),
                ],
                names=schema.names,
            )

    return docs.select("row", "doc_id", "text").mapInArrow(sketch, schema)


def numbered(docs: DataFrame) -> DataFrame:
    """The documents written once with a number ``row`` for each row (a column of that name is replaced)."""
    return stash(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")


def shingle_sets(nodes: DataFrame, width: int) -> DataFrame:
    """node and its full sorted set of shingle hashes, from (node, text)."""
    schema = "node long, shingles array<long>"

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in small_batches(batches):
            found = [shingle_hashes(words_of(t), width, known).view(np.int64) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "shingles"])

    return nodes.select("node", "text").mapInArrow(sets, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge (one, two); root is the smallest node connected.

    Each round ties every node's larger neighbours to its smallest neighbour, then its
    smaller ones (large star, small star); rounds end when nothing moves. A node with
    very many edges is aggregated before its shuffle and joined back to one row.
    """
    pair = [F.least("one", "two").alias("low"), F.greatest("one", "two").alias("high")]
    current = stash(edges.filter("one <> two").select(*pair).distinct(), "edges")
    mark = None
    while True:
        both = current.select(F.col("low").alias("node"), F.col("high").alias("other")).unionByName(current.select(F.col("high").alias("node"), F.col("low").alias("other")))
        least = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = both.filter("other > node").join(least, "node").select(F.col("m").alias("low"), F.col("other").alias("high"))
        large = large.filter("low <> high").distinct()
        small_least = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(small_least, "high").select(F.col("m").alias("a"), F.col("low").alias("b"), "high")
        moved = small.select(F.col("a").alias("low"), F.explode(F.array("b", "high")).alias("high")).filter("low <> high").distinct()
        current = stash(moved, "edges")
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if now == mark:
            return current.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(current.select("low").distinct().select(F.col("low").alias("node"), F.col("low").alias("root")))
        mark = now


def _alike(x: str, y: str, percent: int, signs: int, limit: int) -> Column:
    """Sizes and sign bits allow the similarity."""
    apart = reduce(lambda s, k: s + F.bit_count(F.col(f"{x}.signs")[k].bitwiseXOR(F.col(f"{y}.signs")[k])), range(signs), F.lit(0))
    n, o = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
    return (F.least(n, o) * 100 >= F.greatest(n, o) * percent) & (apart <= limit)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (one, two) whose full sets reach the similarity."""
    left, right = sets.select(F.col("node").alias("one"), F.col("shingles").alias("s1")), sets.select(F.col("node").alias("two"), F.col("shingles").alias("s2"))
    shared = F.size(F.array_intersect("s1", "s2")).cast("long")
    full = pairs.join(left, "one").join(right, "two").withColumn("shared", shared)
    return full.filter(F.col("shared") * 100 >= (F.size("s1") + F.size("s2") - F.col("shared")) * percent).select("one", "two")


def _early_shingles(sets: DataFrame, chosen: DataFrame, percent: int) -> DataFrame:
    """key (a shingle), node, root, n_shingles, at (its place in the common order), short: the early shingles.

    A partner of at least the own size shares all but ``short`` - 1 of the n shingles at
    the limit, a smaller one all but n - n * percent / 100; later shingles can't be the first shared.
    """
    listed = sets.join(chosen, "node").select("node", "root", F.size("shingles").cast("long").alias("n_shingles"), F.explode("shingles").alias("key"))
    often = listed.groupBy("key").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    listed = listed.join(often, "key", "left").withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("often", F.lit(1)), "key")))
    n = F.col("n_shingles")
    least = lambda top, down: F.floor((n * top + down - 1) / F.lit(down)).cast("long")
    listed = listed.withColumn("short", n - least(2 * percent, 100 + percent) + 1).filter((F.col("at") <= n - least(percent, 100) + 1) & (F.col("often") > 1))
    return listed.select("key", "node", "root", "n_shingles", "at", "short")


def _mixed(members: DataFrame) -> DataFrame:
    """Members (key, root, ...) of the buckets that hold several roots."""
    several = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    return members.join(several.select("key"), "key", "left_semi")


def near_groups(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = PERCENT, m: int | None = None, a: int | None = None) -> DataFrame:
    """doc_id, n_shingles, set_id (rows with equal sets), component_id, kept for every document.

    ``m`` half keys of ``a`` min-hashes in each collection; both follow the limit unless given.
    """
    return groups_of_numbered(numbered(docs.select("doc_id", F.col("text").cast("string").alias("text"))), width, percent, m, a).drop("row")


def groups_of_numbered(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = PERCENT, m: int | None = None, a: int | None = None) -> DataFrame:
    """As ``near_groups``, with ``row``, for a stored table that has the columns row, doc_id and text."""
    planned = plan_for(percent)
    m, a = m or planned[0], a or planned[1]
    signs, limit = -(-2 * 2 * m * a // 64), sign_limit(percent, 2 * m * a)
    known = stash(sketches(docs, width, m, a), "sketches")
    sets_of = known.filter("n_shingles > 0").groupBy("d1", "d2").agg(F.min("row").alias("node"))
    rows = stash(known.select("row", "doc_id", "n_shingles", "d1", "d2").join(sets_of, ["d1", "d2"], "left").select("row", "doc_id", "n_shingles", "node"), "rows")
    nodes = known.join(sets_of.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "n_shingles", "halves", "signs")

    halves = stash(nodes.select("node", F.posexplode("halves").alias("side", "half")), "halves")
    shared = halves.groupBy("side", "half").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    held = halves.join(shared, ["side", "half"]).groupBy("node").agg(F.collect_list(F.struct("side", "half")).alias("h"), F.sum("n").alias("common"))  # 2*m at most
    held = stash(held.filter(F.exists("h", lambda x: x["side"] < m) & F.exists("h", lambda x: x["side"] >= m)), "held")
    # From here on a node goes by its place: the smallest place has the most common half keys.
    places = stash(in_order(held.select("node", (-F.col("common")).alias("rare")), ["rare", "node"], "place").select("node", "place"), "places")
    first, second = F.filter("h", lambda x: x["side"] < m), F.filter("h", lambda x: x["side"] >= m)
    keys = F.flatten(F.transform(first, lambda x: F.transform(second, lambda y: F.xxhash64(x["side"], y["side"], x["half"], y["half"]))))
    members = stash(held.join(places, "node").select("place", F.explode(keys).alias("key")), "members")
    buckets = members.groupBy("key").agg(F.min("place").alias("centre"), F.max("place").alias("last")).filter("centre < last").select("key", "centre")
    members = stash(members.join(buckets, "key"), "buckets")

    inside = members.select("place").distinct().join(places, "place")
    sketch = stash(nodes.join(inside, "node").select("place", "n_shingles", "signs"), "signs")
    sets = stash(shingle_sets(docs.select(F.col("row").alias("node"), "text").join(inside, "node").select(F.col("place").alias("node"), "text"), width), "sets")
    stars = members.filter("place <> centre").select(F.col("centre").alias("one"), F.col("place").alias("two")).distinct()
    stars = stars.join(sketch.select(F.col("place").alias("one"), F.struct("n_shingles", "signs").alias("x")), "one")
    stars = stars.join(sketch.select(F.col("place").alias("two"), F.struct("n_shingles", "signs").alias("y")), "two")
    stars = stash(stars.filter(_alike("x", "y", percent, signs, limit)).select("one", "two"), "stars")
    roots = stash(components(_confirmed(stars, sets, percent)), "roots")

    labelled = members.join(roots.select(F.col("node").alias("place"), "root"), "place", "left").select("key", "place", F.coalesce("root", "place").alias("root"))
    across = stash(_mixed(labelled), "mixed")
    early = stash(_early_shingles(sets, across.select(F.col("place").alias("node"), "root").distinct(), percent), "early")
    full = sketch.select(F.col("place").alias("node"), "signs")
    early = _mixed(early).join(full, "node")
    x, y = early.filter("at <= short").alias("x"), early.alias("y")
    order = (F.col("x.n_shingles") < F.col("y.n_shingles")) | ((F.col("x.n_shingles") == F.col("y.n_shingles")) & (F.col("x.node") < F.col("y.node")))
    most = F.least(F.col("x.n_shingles") - F.col("x.at"), F.col("y.n_shingles") - F.col("y.at")) + 1
    enough = most * (100 + percent) >= (F.col("x.n_shingles") + F.col("y.n_shingles")) * percent
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & order & enough & _alike("x", "y", percent, signs, limit))
    met = met.select(F.least("x.node", "y.node").alias("one"), F.greatest("x.node", "y.node").alias("two")).distinct()
    met = stash(met.join(stars, ["one", "two"], "left_anti"), "met")
    if not met.isEmpty():
        links = _confirmed(met, sets, percent)
        of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        lifted = links.join(of("one"), "one", "left").join(of("two"), "two", "left")
        joined = components(lifted.select(F.coalesce("root_one", "one").alias("one"), F.coalesce("root_two", "two").alias("two")))
        joined = joined.select(F.col("node").alias("old"), F.col("root").alias("new"))
        every = roots.unionByName(joined.select(F.col("old").alias("node"), F.col("old").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
        roots = stash(every.join(joined, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root")), "roots")

    roots = places.join(roots.select(F.col("node").alias("place"), "root"), "place").select("node", "root")
    placed = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", -F.coalesce("node", "row") - 1))
    placed = stash(placed, "placed")
    low = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return placed.join(low, "root").select("row", "doc_id", "n_shingles", F.col("node").alias("set_id"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One document of each group, all columns as they were: the first row with the smallest doc_id.

    Texts without words are in no group; all of them stay.
    """
    given = {c: f"given_{i}" if c == "row" else c for i, c in enumerate(docs.columns)}
    rows = numbered(docs.withColumnsRenamed(given).withColumn("text", F.col("text").cast("string")))
    groups = groups_of_numbered(rows, **options).filter("kept")
    alone = F.when(F.col("n_shingles") == 0, F.col("row"))
    kept = groups.groupBy("doc_id", "component_id", alone).agg(F.min("row").alias("row"))
    return rows.join(kept.select("row"), "row", "left_semi").select(*(F.col(f"`{now}`").alias(c) for c, now in given.items()))
