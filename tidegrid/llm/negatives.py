"""Hard negatives by inner product, searched in STR-packed R-trees.

Rows are cut into slabs along their first component (the first sort-tile step, done by a
range exchange); a slab's tree is packed in its task by sorting and tiling the other
components in turn, and the boxes of each level are packed the same way. The box of a
node gives an interval for every component and so, with an anchor's signs, an interval
for the inner product. A queue opens the node of the highest upper end first; a node is
dropped if its interval misses an anchor's score window or lies strictly below the
kth score found so far. Scores are whole numbers and compared exactly.

Anchors come in blocks as large as the slabs: each (slab, anchor block) is one task's
work, rows are copied once per anchor block and anchors once per slab. No key is grouped
by its label, so a label with a third of all rows is spread like any other.

Defined cases: rows without an id or label, with a null or empty vector, or with null or
non-finite components take no part, nor do those with a whole component of 2**28 or more;
rows that repeat an anchor's id are no partners of it; repeated rows are candidates (and
anchors) one by one; ties go to smaller ids; vectors of different length never meet;
a positive of score 0 takes negatives of score 0, one below 0 takes none; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import stash

SLAB_ROWS = 16_384
ANCHOR_ROWS = 16_384
LEAF = 256
FAN = 16
_BOUND = float(1 << 28)


def tiles(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Sort-tile-recursive: row numbers of ``points`` in tiles of at most ``size``."""
    out: list[np.ndarray] = []
    work = [(np.arange(len(points)), 0)]
    dims = points.shape[1]
    while work:
        rows, dim = work.pop()
        pages = -(-len(rows) // size)
        if pages <= 1:
            out.append(rows)
            continue
        rows = rows[np.argsort(points[rows, dim], kind="stable")]
        if dim == dims - 1:
            out += [rows[at : at + size] for at in range(0, len(rows), size)]
            continue
        slabs = int(np.ceil(pages ** (1 / (dims - dim)) - 1e-9))
        width = -(-pages // slabs) * size
        work += [(rows[at : at + width], dim + 1) for at in range(0, len(rows), width)]
    return out


class RTree:
    """Boxes over rows (id, label, values); nodes are numbered leaves first, the root last."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        self.ids, self.labels, self.values = ids, labels, values
        self.children: list[np.ndarray] = tiles(values, leaf)  # of a leaf: rows; else: nodes
        self.leaves = len(self.children)
        low = [values[rows].min(axis=0) for rows in self.children]
        high = [values[rows].max(axis=0) for rows in self.children]
        level = np.arange(self.leaves)
        while len(level) > 1:
            centres = np.array([low[i] + high[i] for i in level])
            above = [level[part] for part in tiles(centres, fan)]
            first = len(self.children)
            self.children += above
            low += [np.min([low[i] for i in part], axis=0) for part in above]
            high += [np.max([high[i] for i in part], axis=0) for part in above]
            level = np.arange(first, first + len(above))
        self.low, self.high = np.array(low), np.array(high)
        self._leaf_rows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest possible inner product of each query with each node's rows."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T

    def rows_of(self, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if leaf not in self._leaf_rows:
            rows = self.children[leaf]
            self._leaf_rows[leaf] = self.ids[rows], self.labels[rows], self.values[rows]
        return self._leaf_rows[leaf]


class Best:
    """The k best rows whose score lies in [low, high]; ties go to smaller ids."""

    def __init__(self, k: int, low: float, high: float):
        self.k, self.bar, self.high = k, low, high
        self.ids = self.scores = np.empty(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        fits = (scores >= self.bar) & (scores <= self.high)
        if not fits.any():
            return
        self.ids = np.concatenate([self.ids, ids[fits]])
        self.scores = np.concatenate([self.scores, scores[fits].astype(np.int64)])
        if len(self.ids) >= self.k:
            order = np.lexsort((self.ids, -self.scores))[: self.k]
            self.ids, self.scores = self.ids[order], self.scores[order]
            self.bar = max(self.bar, int(self.scores[-1]))


def search(tree: RTree, query: np.ndarray, own_id: int, lows: np.ndarray, highs: np.ndarray, windows: list[Best], but_label: int | None) -> int:
    """Best-first search for all windows of one query; returns the number of leaves opened."""
    root = len(tree.children) - 1
    queue = [(-highs[root], root)]
    opened = 0
    while queue:
        upper, node = heappop(queue)
        upper = -upper
        if all(upper < w.bar for w in windows):
            break  # so are all nodes that are left
        wanted = [w for w in windows if upper >= w.bar and lows[node] <= w.high]
        if not wanted:
            continue
        if node >= tree.leaves:
            for child in tree.children[node].tolist():
                heappush(queue, (-highs[child], child))
            continue
        opened += 1
        ids, labels, values = tree.rows_of(node)
        scores = values @ query
        fit = ids != own_id
        if but_label is not None:
            fit &= labels != but_label
        if not fit.all():
            ids, scores = ids[fit], scores[fit]
        for w in wanted:
            w.add(ids, scores)
    return opened


def labelled(vectors: DataFrame, factor: int = 256, column: str = "embedding", label: str | Column = "label") -> DataFrame:
    """vec_id, label and whole components floor(factor * x) of the rows that take part."""
    x = F.col(column)
    label = F.col(label) if isinstance(label, str) else label
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) * factor < _BOUND))
    kept = vectors.filter(F.col("vec_id").isNotNull() & label.isNotNull() & x.isNotNull() & (F.size(x) > 0)).filter(good)
    values = F.transform(x, lambda v: F.floor(F.lit(factor) * v.cast("double")).cast("int"))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), values.alias("values"))


def in_slabs(rows: DataFrame, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """Rows with a number of their own and the slab (along the first component) they lie in.

    Equal components are told apart by id and place, so copies of one vector fill several slabs.
    """
    rows = stash(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    slabs = max(1, -(-rows.count() // slab_rows))
    return stash(rows.repartitionByRange(slabs, F.col("values")[0], "vec_id", "row").withColumn("slab", F.spark_partition_id()), "slabs")


def _side_by_side(rows: DataFrame, anchors: DataFrame, extra: str, anchor_rows: int):
    """Groups (slab, block of anchors) of rows and anchors; ``extra`` is a column of the anchors."""
    slabs = rows.agg(F.max("slab")).first()[0]
    blocks = max(1, -(-anchors.count() // anchor_rows))
    kind = anchors.schema[extra].dataType
    held = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn(extra, F.lit(None).cast(kind)).withColumn("anchor", F.lit(False))
    asked = anchors.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs or 0)))).withColumn("anchor", F.lit(True))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    columns = ["slab", "block", "anchor", "row", "vec_id", "label", "values", extra]
    return held.select(columns).unionByName(asked.select(columns)).groupBy("slab", "block")


def _by_length(group: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, pd.DataFrame, np.ndarray]]:
    """Rows and anchors of equal length with their components, as floats where that is exact."""
    for length, same in group.groupby(group["values"].str.len()):
        held, asked = same[~same["anchor"]], same[same["anchor"]]
        if held.empty or asked.empty:
            continue
        a, b = (np.stack(part["values"].to_numpy()).astype(np.int64) for part in (held, asked))
        exact = int(np.abs(a).max()) * int(np.abs(b).max()) * int(length) < 1 << 53
        yield held, a.astype(float) if exact else a, asked, b.astype(float) if exact else b


def positives(rows: DataFrame, anchors: DataFrame, k: int = 5, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """row, anchor_id, positive_id, positive_score, place: the k best other rows of an anchor's label."""

    def best(group: pd.DataFrame) -> pd.DataFrame:
        found = []
        for held, values, asked, queries in _by_length(group):
            by_label = asked.assign(at=np.arange(len(asked))).groupby("label")["at"]
            labels = held["label"].to_numpy(np.int64)
            ids = held["vec_id"].to_numpy(np.int64)
            for label, at in by_label:
                of = np.flatnonzero(labels == label)
                if not len(of):
                    continue
                tree = RTree(ids[of], labels[of], values[of])
                lows, highs = tree.bounds(queries[at.to_numpy()])
                for i, n in enumerate(at.tolist()):
                    own = asked.iloc[n]
                    window = Best(k, -np.inf, np.inf)
                    search(tree, queries[n], own["vec_id"], lows[i], highs[i], [window], None)
                    found.append(pd.DataFrame({"row": own["row"], "anchor_id": own["vec_id"], "positive_id": window.ids, "positive_score": window.scores}))
        names = ["row", "anchor_id", "positive_id", "positive_score"]
        return pd.concat(found)[names] if found else pd.DataFrame({n: [] for n in names}).astype("int64")

    groups = _side_by_side(rows, anchors.withColumn("none", F.lit(None).cast("long")), "none", anchor_rows)
    found = groups.applyInPandas(best, "row long, anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, positive_rows: DataFrame, k: int = 10, least: int = 30, most: int = 90, anchor_rows: int = ANCHOR_ROWS
) -> DataFrame:
    """For each anchor and positive the k best rows of other labels whose score is ``least`` to
    ``most`` percent of the positive's."""
    wanted = positive_rows.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("wanted"))
    asked = stash(anchors.join(wanted, "row"), "anchors")

    def best(group: pd.DataFrame) -> pd.DataFrame:
        found = []
        for held, values, asked, queries in _by_length(group):
            tree = RTree(held["vec_id"].to_numpy(np.int64), held["label"].to_numpy(np.int64), values)
            lows, highs = tree.bounds(queries)
            for n, own in enumerate(asked.to_dict("records")):
                scores = [int(p["positive_score"]) for p in own["wanted"]]
                windows = [Best(k, -(-least * s // 100), most * s // 100) for s in scores]
                open_windows = [w for w in windows if w.bar <= w.high]
                if open_windows:
                    search(tree, queries[n], own["vec_id"], lows[n], highs[n], open_windows, own["label"])
                for p, w in zip(own["wanted"], windows):
                    if len(w.ids):
                        found.append(pd.DataFrame({
                            "row": own["row"], "anchor_id": own["vec_id"], "place": p["place"], "positive_id": p["positive_id"],
                            "positive_score": p["positive_score"], "negative_id": w.ids, "negative_score": w.scores,
                        }))
        names = ["row", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"]
        return pd.concat(found)[names] if found else pd.DataFrame({n: [] for n in names}).astype("int64")

    groups = _side_by_side(rows, asked, "wanted", anchor_rows)
    found = groups.applyInPandas(
        best, "row long, anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long"
    )
    order = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine_negatives(
    rows: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 10, least: int = 30, most: int = 90,
    slab_rows: int = SLAB_ROWS, anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """Negatives of every row whose id is divisible by ``every``, against all rows (vec_id, label, values)."""
    rows = in_slabs(rows, slab_rows)
    anchors = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).drop("slab")
    near = stash(positives(rows, anchors, n_positives, anchor_rows), "positives")
    return hard_negatives(rows, anchors, near, n_negatives, least, most, anchor_rows)


def shifted_label(every: int = 7, labels: int = 10) -> Column:
    """The label, moved on by one where the id is divisible by ``every``."""
    moved = F.pmod(F.col("label").cast("long") + 1, F.lit(labels))
    return F.when(F.pmod("vec_id", F.lit(every)) == 0, moved).otherwise(F.col("label").cast("long"))
