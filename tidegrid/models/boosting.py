"""Boosted regression trees with penalties, fitted from histograms of gradients.

Features are cut into quantile bins once; the rows are kept in blocks that hold the bins
of each feature one after the other as bytes. For every
level of a tree each task adds up gradients and row counts per (node, feature, bin) of
its rows; Spark sums these partial histograms, accumulates them along the bins and picks
the best split of every node. The driver sees one row per node. Leaves are shrunk by an
L1 and an L2 penalty, and a node is only split for a gain.

Three ways to grow: ``level`` splits every node that gains, ``leaf`` always the one that
gains most until there are ``max_leaves``, ``symmetric`` uses one split for a whole level.

With ``val_size`` the last rows of every series are held out; their error after every
tree is read off the next tree's first pass, and once ``patience`` trees brought nothing
the best number of trees stays. Rows are sampled per tree by a hash, features by a
seeded draw. Gradients are rounded to 2**-16, so sums do not depend on their order.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.config import DEFAULT
from tidegrid.operators.splits import hold_out
from tidegrid.session import small_batches, stored

_STATE = "y binary, is_val binary, u binary, margin binary, bins binary"
_KINDS = (np.float64, np.bool_, np.uint64, np.float64, np.uint8)
_BLOCK_ROWS = 32_768
# Cut points come from summaries of so many rows, of so many points; so many are held before they are merged.
_SUMMARY_ROWS = 131_072
_POINTS = 4_096
_SUMMARIES = 8
# The points of so many tasks are merged into one list, thinned to fewer points beyond a limit, before the lists meet.
_TASKS = 64
_MERGED = 4 * _POINTS
_MERGE_LIMIT = 16 * _POINTS
_HIST = "node int, feature int, bin int, g double, h double"
_NODES_PER_PASS = 256
_ROUNDING = 65_536.0


@dataclass
class Tree:
    """Nodes in arrays; ``feature`` is -1 in a leaf. Rows with bin <= ``cut`` (value <= ``threshold``) go left."""

    feature: np.ndarray
    cut: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    rows: np.ndarray
    depth: int

    def leaves(self, columns: Sequence[np.ndarray], limits: np.ndarray) -> np.ndarray:
        """Number of the leaf of every row of ``columns``, one array per feature (bins with
        ``cut``, or values with ``threshold``)."""
        if len(self.feature) <= 256:
            return self._leaves_by_node(columns, limits)
        at = np.zeros(len(columns[0]), np.int64)
        for _ in range(self.depth):
            after = at.copy()
            for node in np.unique(at).tolist():
                if self.feature[node] >= 0:
                    here = np.flatnonzero(at == node)
                    right = columns[self.feature[node]][here] > limits[node]  # a missing value is never greater
                    after[here] = np.where(right, self.right[node], self.left[node])
            at = after
        return at

    def _leaves_by_node(self, columns: Sequence[np.ndarray], limits: np.ndarray) -> np.ndarray:
        """Every inner node picks between the leaves of its sides; leaf numbers are single bytes."""
        found: dict[int, np.ndarray | np.uint8] = {}
        for node in range(len(self.feature) - 1, -1, -1):  # children come after their parent
            if self.feature[node] < 0:
                found[node] = np.uint8(node)
                continue
            right = (columns[self.feature[node]] > limits[node]).view(np.uint8)  # a missing value is never greater
            near, far = found.pop(int(self.left[node])), found.pop(int(self.right[node]))
            picked = np.negative(right)
            picked &= near ^ far
            picked ^= near
            found[node] = picked
        leaf = found[0]
        return leaf if isinstance(leaf, np.ndarray) else np.zeros(len(columns[0]), np.uint8)


@dataclass
class _Node:
    """A node while its tree grows."""

    depth: int
    g: float = 0.0
    h: float = 0.0
    known: bool = False
    split: tuple[int, int, float] | None = None  # feature, bin, gain
    children: tuple["_Node", "_Node"] | None = None


def _frozen(root: _Node, inner: set[int], value, cuts: list[list[float]]) -> tuple[Tree, list[_Node]]:
    """Arrays of a tree whose inner nodes are those in ``inner`` (by identity), and its nodes in that order."""
    nodes, order, depth = [root], {}, 0
    for node in nodes:
        order[id(node)] = len(order)
        depth = max(depth, node.depth - root.depth)
        if id(node) in inner:
            nodes += node.children
    splits = [n.split if id(n) in inner else None for n in nodes]
    bound = lambda s: -np.inf if s[1] == 0 else cuts[s[0]][s[1] - 1]
    child = lambda n, s, i: order[id(n.children[i])] if s else 0
    tree = Tree(
        np.array([s[0] if s else -1 for s in splits]), np.array([s[1] if s else 0 for s in splits]),
        np.array([bound(s) if s else 0.0 for s in splits]),
        np.array([child(n, s, 0) for n, s in zip(nodes, splits)]), np.array([child(n, s, 1) for n, s in zip(nodes, splits)]),
        np.array([0.0 if s else value(n) for n, s in zip(nodes, splits)]), np.array([s[2] if s else 0.0 for s in splits]),
        np.array([n.h for n in nodes]), depth,
    )
    return tree, nodes


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[np.ndarray]]:
    """y, is_val, u, margin and bins (feature by feature) of every block, read only."""
    for batch in batches:
        for i in range(batch.num_rows):
            block = [np.frombuffer(column[i].as_buffer(), kind) for column, kind in zip(batch.columns, _KINDS)]
            block[4] = block[4].reshape(width, -1)
            yield block


def _as_block(parts: Sequence[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(p, kind).tobytes()], pa.binary()) for p, kind in zip(parts, _KINDS)], names=["y", "is_val", "u", "margin", "bins"])


def _thinned(parts: Sequence[tuple[np.ndarray, np.ndarray]], points: int = _POINTS, limit: int = _POINTS) -> tuple[np.ndarray, np.ndarray]:
    """Weighted points as one sorted list, of at most ``points`` if there are more than ``limit`` distinct values.

    What goes is counted at the next greater point that stays, so a rank moves by less than 1 in ``points``.
    """
    values, place = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    weights = np.zeros(len(values), np.int64)
    np.add.at(weights, place, np.concatenate([w for _, w in parts]))
    if len(values) <= limit:
        return values, weights
    upto = np.cumsum(weights)
    kept = np.unique(np.searchsorted(upto, np.arange(1, points + 1) * (upto[-1] / points)).clip(max=len(upto) - 1))
    return values[kept], np.diff(upto[kept], prepend=0)


def _sampled(u: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """True for a share of the rows, by a hash of the row and the tree."""
    if share >= 1:
        return np.ones(len(u), bool)
    z = u.astype(np.uint64) + np.uint64((tree * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(float) < share * 2.0**53


@dataclass(frozen=True)
class BoostedTrees:
    """Parameters of a boosted model; ``cuts`` fixes the cut points of features instead of quantiles."""

    features: tuple[str, ...]
    target: str = DEFAULT.target
    name: str = "boosted_deep"
    growth: str = "level"
    iterations: int = 1000
    max_depth: int = 8
    max_leaves: int | None = None
    step: float = 0.05
    subsample: float = 0.8
    feature_fraction: float = 0.8
    l1: float = 0.0
    l2: float = 1.0
    min_instances: int = 1
    min_gain: float = 0.0
    max_bins: int = 64
    val_size: int = 28
    patience: int = 50
    key: str = DEFAULT.key
    time: str = DEFAULT.time
    seed: int = 42
    cuts: dict[str, tuple[float, ...]] | None = None
    trees_per_cache: int = 4

    def with_params(self, **changes) -> "BoostedTrees":
        return replace(self, **changes)

    # --- preparation ---

    def _cut_points(self, rows: DataFrame) -> tuple[list[list[float]], float]:
        """At most ``max_bins`` - 1 cut points per feature (a table of features x bins), and the mean target."""
        if not 2 <= self.max_bins <= 255:
            raise ValueError("max_bins must lie between 2 and 255")
        given = self.cuts or {}
        open_ones = [f for f in self.features if f not in given]
        width, shares = len(open_ones), np.arange(1, self.max_bins) / self.max_bins

        def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Weighted points of every feature of a task, and the sum of its targets as feature -1."""
            total, n_rows, waiting, size = 0.0, 0, [], 0
            held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(width)]

            def take_in() -> None:
                for i in range(width):
                    v = np.concatenate([w[i] for w in waiting])
                    held[i].append(_thinned([np.unique(v[~np.isnan(v)], return_counts=True)]))
                    if len(held[i]) == _SUMMARIES:
                        held[i] = [_thinned(held[i])]

            for batch in batches:
                columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
                total, n_rows = total + float(columns[0].sum()), n_rows + batch.num_rows
                waiting.append(columns[1:])
                size += batch.num_rows
                if size >= _SUMMARY_ROWS:
                    take_in()
                    waiting, size = [], 0
            if waiting:
                take_in()
            points = [(np.array([total]), np.array([n_rows])), *(_thinned(h) for h in held if h)]
            group = TaskContext.get().partitionId() // _TASKS
            yield pa.RecordBatch.from_arrays(
                [pa.array([group] * len(points), pa.int32()), pa.array(range(-1, len(points) - 1), pa.int32()), *(pa.array([np.asarray(p[i], kind).tobytes() for p in points], pa.binary()) for i, kind in enumerate((np.float64, np.int64)))],
                names=["tasks", "feature", "points", "weights"],
            )

        def lists(parts: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            values, weights = (np.concatenate([np.frombuffer(x, kind) for x in parts[c]]) for c, kind in (("points", np.float64), ("weights", np.int64)))
            return values, weights

        def gather(parts: pd.DataFrame) -> pd.DataFrame:
            """The summaries of a group of tasks as one."""
            values, weights = lists(parts)
            feature = int(parts["feature"].iloc[0])
            if feature >= 0:
                values, weights = _thinned([(values, weights)], _MERGED, _MERGE_LIMIT)
            return pd.DataFrame({"feature": [feature], "points": [values.tobytes()], "weights": [weights.tobytes()]})

        def merge(parts: pd.DataFrame) -> pd.DataFrame:
            values, weights = lists(parts)
            feature = int(parts["feature"].iloc[0])
            if feature < 0:
                found = [float(values.sum() / weights.sum())] if weights.sum() else []
            else:
                order = np.argsort(values, kind="stable")
                upto = np.cumsum(weights[order])
                found = values[order][np.searchsorted(upto, np.ceil(shares * upto[-1]))].tolist() if len(upto) else []
            return pd.DataFrame({"feature": [feature], "found": [found]})

        inputs = [F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(open_ones)]
        flat = rows.select(F.col(self.target).cast("double").alias("y"), *inputs)
        parts = flat.mapInArrow(summarise, "tasks int, feature int, points binary, weights binary")
        parts = parts.groupBy("tasks", "feature").applyInPandas(gather, "feature int, points binary, weights binary")
        found = {r["feature"]: r["found"] for r in parts.groupBy("feature").applyInPandas(merge, "feature int, found array<double>").collect()}
        cuts = {f: list(c) for f, c in given.items()} | {f: found.get(i, []) for i, f in enumerate(open_ones)}
        return [sorted(set(cuts[f])) for f in self.features], (found.get(-1) or [0.0])[0]

    def _binned(self, rows: DataFrame, cuts: list[list[float]], base: float) -> DataFrame:
        limits = [np.array(c) for c in cuts]

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: list[list[np.ndarray]] = []
            size = 0

            def out() -> pa.RecordBatch:
                return _as_block([np.concatenate([p[i] for p in parts], axis=-1) for i in range(5)])

            for batch in batches:
                if not batch.num_rows:
                    continue
                bins = np.empty((len(limits), batch.num_rows), np.uint8)
                for i, limit in enumerate(limits):
                    v = batch.column(3 + i).to_numpy(zero_copy_only=False).astype(float)
                    bins[i] = np.where(np.isnan(v), 0, np.searchsorted(limit, v, side="left") + 1)
                y, held, u = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                parts.append([y.astype(float), held.astype(bool), u.astype(np.uint64), np.full(len(y), base), bins])
                size += batch.num_rows
                if size >= _BLOCK_ROWS:
                    yield out()
                    parts, size = [], 0
            if parts:
                yield out()

        held = F.col("is_val") if "is_val" in rows.columns else F.lit(False)
        inputs = [F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(self.features)]
        flat = rows.select(F.col(self.target).cast("double").alias("y"), held.alias("is_val"), F.xxhash64(self.key, self.time).alias("u"), *inputs)
        return stored(flat.mapInArrow(pack, _STATE), "binned")

    # --- one pass over the rows ---

    def _histograms(self, state: DataFrame, added: list[Tree], tree: Tree, slots: np.ndarray, chosen: list[int], number: int, bins: list[int], loss: bool) -> DataFrame:
        """Partial sums per task: node slot, feature, bin, gradient, rows; node -1 has the squared error of the hold-out.

        ``slots`` maps the leaves of ``tree`` to open nodes (-1: not asked for).
        """
        width, size, n_open = len(self.features), max(bins), int(slots.max()) + 1
        dense, share, seed = self.growth == "symmetric", self.subsample, self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g_sum, h_sum = np.zeros((len(chosen), n_open * size)), np.zeros((len(chosen), n_open * size))
            error, held_rows, starts = 0.0, 0, np.maximum(slots, 0) * size
            every = bool((slots[tree.feature < 0] >= 0).all())
            for y, held, u, margin, x in _blocks(batches, width):
                for t in added:
                    margin = margin + t.value[t.leaves(x, t.cut)]
                if loss:
                    error += float(np.square(margin[held] - y[held]).sum())
                    held_rows += int(held.sum())
                take = ~held & _sampled(u, number, seed, share)
                leaf = tree.leaves(x, tree.cut)
                rows = np.flatnonzero(take if every else take & (slots >= 0)[leaf])
                if not len(rows):
                    continue
                whole = len(rows) == len(y)
                g = np.rint((margin - y)[rows] * _ROUNDING) / _ROUNDING
                start = starts[leaf[rows]]
                for i, f in enumerate(chosen):
                    at = start + (x[f] if whole else x[f].take(rows))
                    g_sum[i] += np.bincount(at, g, n_open * size)
                    h_sum[i] += np.bincount(at, minlength=n_open * size)
            for i, f in enumerate(chosen):
                found = np.flatnonzero(h_sum[i]) if not dense else np.flatnonzero(np.arange(n_open * size) % size < bins[f])
                columns = found // size, np.full(len(found), f), found % size
                yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns), pa.array(g_sum[i][found]), pa.array(h_sum[i][found])], names=["node", "feature", "bin", "g", "h"])
            if loss:
                mark = pa.array([-1], pa.int32())
                yield pa.RecordBatch.from_arrays([mark, mark, mark, pa.array([error]), pa.array([float(held_rows)])], names=["node", "feature", "bin", "g", "h"])

        # Tasks have summed up already; one exchange serves the sums and the running totals.
        return state.mapInArrow(run, _HIST).repartition("node", "feature").groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))

    def _candidates(self, hist: DataFrame) -> DataFrame:
        """Every cut of every node: rows and gradients to its left, totals, gain (NULL if not allowed)."""
        of = "over (partition by node, feature"
        up_to = f"{of} order by bin rows between unbounded preceding and current row)"
        score = lambda g, h: f"coalesce(try_divide(pow(greatest(abs({g}) - {float(self.l1)!r}D, 0D), 2), {h} + {float(self.l2)!r}D), 0D)"
        gain = f"{score('gl', 'hl')} + {score('(gt - gl)', '(ht - hl)')} - {score('gt', 'ht')}"
        least = float(max(self.min_instances, 1))
        cuts = hist.selectExpr("*", f"sum(g) {up_to} as gl", f"sum(h) {up_to} as hl", f"sum(g) {of}) as gt", f"sum(h) {of}) as ht").selectExpr("*", f"{gain} as raw")
        # Equal gains go to the first feature and cut; the sixth digit is what counts.
        allowed = f"node >= 0 and hl >= {least!r}D and ht - hl >= {least!r}D and raw > {max(self.min_gain, 1e-9)!r}D"
        return cuts.selectExpr("node", "feature", "bin", "gl", "hl", "gt", "ht", f"if({allowed}, rint(raw * 1e6D) / 1e6D, null) as gain")

    def best_splits(self, hist: DataFrame) -> DataFrame:
        """node, gt, ht and the best split (feature, bin, gain, gl, hl; NULL without one)."""
        cuts = self._candidates(hist)
        first = "struct(gain, -feature, -bin)"
        if self.growth != "symmetric":
            best = f"max_by(struct(feature, bin, gain, gl, hl), if(gain is null, null, {first})) as s"
            return cuts.groupBy("node").agg(F.expr("max(gt) as gt"), F.expr("max(ht) as ht"), F.expr(best)).select("node", "gt", "ht", "s.*")
        total = cuts.groupBy("feature", "bin").agg(
            F.expr("sum(coalesce(gain, 0D)) as gain"),
            F.expr("collect_list(struct(node, gt, ht, feature, bin, coalesce(gain, 0D) as gain, gl, hl)) as nodes"),
        )
        split = total.filter("gain > 0 and feature >= 0").agg(F.expr(f"max_by(nodes, {first}) as nodes")).selectExpr("inline(nodes)")
        loss = cuts.filter("node < 0").selectExpr("node", "gt", "ht", "null as feature", "null as bin", "null as gain", "null as gl", "null as hl")
        return split.unionByName(loss)

    # --- growing ---

    def _picked(self, root: _Node) -> list[_Node]:
        """Nodes that are split, best gain first, as far as they are known."""
        limit = (self.max_leaves or 2**30) - 1
        queue, picked, ticket = [], [], 0
        if root.split:
            queue.append((-root.split[2], ticket, root))
        while queue and len(picked) < limit:
            node = heapq.heappop(queue)[2]
            picked.append(node)
            for child in node.children:
                if child.split:
                    ticket += 1
                    heapq.heappush(queue, (-child.split[2], ticket, child))
        return picked

    def _leaf_value(self, node: _Node) -> float:
        pulled = max(abs(node.g) - self.l1, 0.0)
        weight = node.h + self.l2
        return 0.0 if not weight else -float(np.sign(node.g)) * pulled / weight * self.step

    def _evaluate(self, state: DataFrame, added: list[Tree], root: _Node, asked: list[_Node], chosen: list[int], number: int, cuts: list[list[float]], loss: bool) -> tuple[float, float]:
        """Find the best split of the asked nodes in one pass; returns (squared error, rows) of the hold-out."""
        inner: set[int] = set()
        work = [root]
        for node in work:
            if node.children:
                inner.add(id(node))
                work += node.children
        tree, nodes = _frozen(root, inner, self._leaf_value, cuts)
        place = {id(n): i for i, n in enumerate(asked)}
        slots = np.array([place.get(id(n), -1) for n in nodes])
        hist = self._histograms(state, added, tree, slots, chosen, number, [len(c) + 2 for c in cuts], loss)
        held = (0.0, 0.0)
        for row in self.best_splits(hist).collect():  # one row per open node
            if row["node"] < 0:
                held = row["gt"], row["ht"]
                continue
            node = asked[row["node"]]
            node.g, node.h = row["gt"], row["ht"]
            if row["feature"] is not None:
                node.split = row["feature"], row["bin"], row["gain"]
                left, right = _Node(node.depth + 1, row["gl"], row["hl"]), _Node(node.depth + 1, row["gt"] - row["gl"], row["ht"] - row["hl"])
                node.children = left, right
        for node in asked:
            node.known = True
        return held

    def preparation(self) -> str:
        """Equal for models that ``prepare`` makes the same blocks for."""
        return repr((self.features, self.target, self.key, self.time, self.val_size, self.max_bins, self.cuts))

    def prepare(self, train: DataFrame) -> "PreparedRows":
        """The hold-out, the cuts and the bins of ``train``, which several fits may share; store it first if its plan is long."""
        needed = [self.key, self.time, self.target, *self.features]
        rows = train.select(*dict.fromkeys(needed)).filter(F.col(self.target).isNotNull())
        if self.val_size:
            rows = hold_out(rows, [self.key], self.time, self.val_size)
        past = rows.filter(~F.col("is_val")) if self.val_size else rows
        with small_batches(train.sparkSession):
            cuts, base = self._cut_points(past)
            return PreparedRows(cuts, base, self._binned(rows, cuts, base).persist())

    def fit(self, train: DataFrame, prepared: "PreparedRows | None" = None) -> "FittedBoosting":
        """``prepared`` holds the rows of ``train`` if a model of the same ``preparation`` has made them; the caller releases it."""
        if self.growth not in ("level", "leaf", "symmetric"):
            raise ValueError(f"unknown growth {self.growth!r}")
        ready = prepared or self.prepare(train)
        try:
            with small_batches(train.sparkSession):
                return self._grown(ready)
        finally:
            if prepared is None:
                ready.release()

    def _grown(self, ready: "PreparedRows") -> "FittedBoosting":
        cuts, base, state = ready.cuts, ready.base, ready.state
        draws = np.random.default_rng(self.seed)
        width = len(self.features)
        trees: list[Tree] = []
        flushed, errors, best = 0, [], 0
        try:
            for number in range(self.iterations + 1):
                last = number == self.iterations
                if last and not self.val_size:
                    break
                n_chosen = max(1, round(self.feature_fraction * width))
                chosen = sorted(draws.choice(width, n_chosen, replace=False).tolist()) if n_chosen < width else list(range(width))
                root = _Node(0)
                error, held = self._evaluate(state, trees[flushed:], root, [root], chosen, number, cuts, bool(self.val_size))
                if held:
                    errors.append(float(np.sqrt(error / held)))
                    best = number if errors[-1] < errors[best] - 1e-12 else best
                    if last or number - best >= self.patience:
                        break
                if last:
                    break
                while True:
                    picked = self._picked(root)
                    asked = [c for n in picked for c in n.children if not c.known and c.depth < self.max_depth and c.h >= 2 * max(self.min_instances, 1)]
                    if not asked:
                        break
                    per_pass = len(asked) if self.growth == "symmetric" else _NODES_PER_PASS
                    for at in range(0, len(asked), per_pass):
                        self._evaluate(state, trees[flushed:], root, asked[at : at + per_pass], chosen, number, cuts, False)
                tree, _ = _frozen(root, {id(n) for n in picked}, self._leaf_value, cuts)
                trees.append(tree)
                if not picked and self.subsample >= 1 and self.feature_fraction >= 1:
                    break  # no later tree would differ
                if len(trees) - flushed >= self.trees_per_cache:
                    before, state, flushed = state, self._with_margins(state, trees[flushed:]), len(trees)
                    if before is not ready.state:
                        before.unpersist()
        finally:
            if state is not ready.state:
                state.unpersist()
        kept = trees[:best] if errors else trees
        return FittedBoosting(self, base, kept, errors)

    def _with_margins(self, state: DataFrame, added: list[Tree]) -> DataFrame:
        """The rows with the trees added to their margin, kept by the executors (lost parts are made again from the rows before)."""
        width = len(self.features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for y, held, u, margin, x in _blocks(batches, width):
                for t in added:
                    margin = margin + t.value[t.leaves(x, t.cut)]
                yield _as_block([y, held, u, margin, x])

        after = state.mapInArrow(run, _STATE).persist()
        after.count()
        return after


@dataclass
class PreparedRows:
    """Rows in blocks, with their cut points and the mean target."""

    cuts: list[list[float]]
    base: float
    state: DataFrame

    def release(self) -> None:
        self.state.unpersist()


def boosting_presets(features: Sequence[str], **changes) -> list[BoostedTrees]:
    """Level-wise trees, best-leaf-first trees and symmetric trees."""
    base = BoostedTrees(tuple(features), **changes)
    leaves = base.max_leaves or 31
    return [
        base.with_params(max_leaves=None),
        base.with_params(name="boosted_leafwise", growth="leaf", max_leaves=leaves, max_depth=base.max_depth + 4),
        base.with_params(name="boosted_symmetric", growth="symmetric", max_leaves=None, l2=3.0),
    ]


@dataclass
class FittedBoosting:
    spec: BoostedTrees
    base: float
    trees: list[Tree] = field(repr=False)
    errors: list[float] = field(repr=False)  # RMSE of the hold-out before each tree, and after the last

    @property
    def name(self) -> str:
        return self.spec.name

    def _inputs(self) -> Column:
        return F.struct(*(F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(self.spec.features)))

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with a ``prediction`` column."""
        base, trees = self.base, self.trees

        @F.pandas_udf("double")
        def value(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for part in parts:
                x = [part.iloc[:, i].to_numpy(float) for i in range(part.shape[1])]
                out = np.full(len(part), base)
                for t in trees:
                    out += t.value[t.leaves(x, t.threshold)]
                yield pd.Series(out)

        return df.withColumn("prediction", value(self._inputs()))

    def staged_rmse(self, df: DataFrame) -> DataFrame:
        """(trees, rmse) after 0, 1, 2, ... trees, from one pass over the rows."""
        base, trees = self.base, self.trees

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            error, n = np.zeros(len(trees) + 1), 0
            for part in batches:
                y, x = part["y"].to_numpy(float), [part.iloc[:, i].to_numpy(float) for i in range(1, part.shape[1])]
                rest = base - y
                error[0] += np.square(rest).sum()
                for i, t in enumerate(trees, 1):
                    rest = rest + t.value[t.leaves(x, t.threshold)]
                    error[i] += np.square(rest).sum()
                n += len(y)
            yield pd.DataFrame({"trees": np.arange(len(error)), "error": error, "n": n})

        known = df.filter(F.col(self.spec.target).isNotNull()).select(F.col(self.spec.target).cast("double").alias("y"), self._inputs().alias("x"))
        parts = known.select("y", "x.*").mapInPandas(run, "trees int, error double, n long")
        return parts.groupBy("trees").agg(F.sqrt(F.try_divide(F.sum("error"), F.sum("n"))).alias("rmse"))

    def nodes(self, spark: SparkSession) -> DataFrame:
        """One row per node: tree, node, feature (NULL in a leaf), threshold, children, value, gain, rows."""
        rows = []
        for number, t in enumerate(self.trees):
            for i, f in enumerate(t.feature.tolist()):
                inner = f >= 0
                rows.append((
                    number, i, self.spec.features[f] if inner else None, float(t.threshold[i]) if inner else None, int(t.cut[i]),
                    int(t.left[i]) if inner else None, int(t.right[i]) if inner else None, float(t.value[i]), float(t.gain[i]), float(t.rows[i]), t.depth,
                ))
        return spark.createDataFrame(
            rows, "tree int, node int, feature string, threshold double, cut int, left int, right int, value double, gain double, rows double, depth int"
        )

    def importance(self, spark: SparkSession, top_n: int | None = None) -> DataFrame:
        """(feature, importance): share of all gain, largest first; one row per feature."""
        total = np.zeros(len(self.spec.features))
        for t in self.trees:
            np.add.at(total, t.feature[t.feature >= 0], t.gain[t.feature >= 0])
        total = total / total.sum() if total.sum() else total
        table = spark.createDataFrame([(f, float(w)) for f, w in zip(self.spec.features, total)], "feature string, importance double")
        ordered = table.orderBy(F.col("importance").desc(), "feature")
        return ordered.limit(top_n) if top_n else ordered

    def params(self, spark: SparkSession) -> DataFrame:
        rows = [(self.name, k, str(v)) for k, v in asdict(self.spec).items()]
        rows.append((self.name, "trees", str(len(self.trees))))
        return spark.createDataFrame(rows, "model string, param string, value string")

    def save(self, path: str, spark: SparkSession) -> None:
        self.nodes(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        spec = json.dumps(asdict(self.spec) | {"base": self.base, "errors": self.errors, "kept": len(self.trees)})
        spark.createDataFrame([("boosted", spec)], "kind string, spec string").coalesce(1).write.mode("overwrite").parquet(f"{path}/spec")


def load_boosted(spark: SparkSession, path: str) -> FittedBoosting:
    """A saved boosted model; raises when ``path`` holds something else."""
    row = spark.read.parquet(f"{path}/spec").first()
    if row is None or row["kind"] != "boosted":
        raise TypeError(f"{path} is not a saved boosted model")
    spec = json.loads(row["spec"])
    base, errors, kept = spec.pop("base"), spec.pop("errors"), spec.pop("kept")
    spec["features"] = tuple(spec["features"])
    model = BoostedTrees(**spec)
    at = {f: i for i, f in enumerate(model.features)}
    nodes = spark.read.parquet(f"{path}/trees").orderBy("tree", "node").toPandas()
    trees = []
    for number in range(kept):
        t = nodes[nodes["tree"] == number]
        whole = lambda c: t[c].fillna(0).to_numpy().astype(np.int64)
        trees.append(Tree(
            np.array([at.get(f, -1) for f in t["feature"]]), whole("cut"), t["threshold"].fillna(0.0).to_numpy(float), whole("left"), whole("right"),
            t["value"].to_numpy(float), t["gain"].to_numpy(float), t["rows"].to_numpy(float), int(t["depth"].iloc[0]),
        ))
    return FittedBoosting(model, base, trees, errors)
