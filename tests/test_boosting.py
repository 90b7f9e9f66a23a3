"""Boosted trees against a plain loop on the driver."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidegrid.config import DemandConfig
from tidegrid.models import boosting
from tidegrid.models.backtest import BOOSTED_SPACE, tune
from tidegrid.models.boosting import BoostedTrees, boosting_presets, load_boosted
from tidegrid.session import small_batches

NAMES = ("a", "b", "c")
CUTS = {n: tuple(float(i) for i in range(9)) for n in NAMES}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    n = 400
    x = rng.integers(0, 10, (n, 3)).astype(float)
    y = 3 * (x[:, 0] > 4) + 2 * (x[:, 0] > 4) * (x[:, 1] < 3) + 0.3 * rng.normal(size=n)
    x[::17, 2] = np.nan
    data = [(i % 2, i, *(None if np.isnan(v) else float(v) for v in x[i]), float(np.float32(y[i]))) for i in range(n)]
    df = spark.createDataFrame(data, "PULocationID int, n int, a double, b double, c double, pickup_count double")
    return df.withColumn("hour", F.expr("timestamp'2024-01-01' + make_dt_interval(0, n)")).drop("n").persist()


def score(g, h, l1, l2):
    return max(abs(g) - l1, 0.0) ** 2 / (h + l2)


def best_cut(x, g, l1, l2, least):
    found = (0.0, None)
    for f in range(x.shape[1]):
        for b in range(0, 11):
            left = ~(x[:, f] > (-np.inf if b == 0 else CUTS["a"][b - 1] if b <= 9 else np.inf))
            if left.sum() < least or (~left).sum() < least:
                continue
            gain = score(g[left].sum(), left.sum(), l1, l2) + score(g[~left].sum(), (~left).sum(), l1, l2) - score(g.sum(), len(g), l1, l2)
            gain = np.rint(gain * 1e6) / 1e6
            if gain > max(found[0], 1e-9):
                found = (gain, (f, b, left))
    return found


def plain(pdf, spec, rounds):
    """Predictions of the hold-out after each tree, and those of all rows."""
    pdf = pdf.sort_values(["PULocationID", "hour"])
    held = pdf.groupby("PULocationID").cumcount(ascending=False).to_numpy() < spec.val_size
    x, y = pdf[list(NAMES)].to_numpy(float), pdf["pickup_count"].to_numpy(float)
    margin = np.full(len(y), y[~held].mean())
    errors = [np.sqrt(np.square(margin - y)[held].mean())] if held.any() else []
    for _ in range(rounds):
        g = np.rint((margin - y) * 65536) / 65536
        margin = margin + grow(x, g, held, spec)
        if held.any():
            errors.append(np.sqrt(np.square(margin - y)[held].mean()))
    return errors, margin, pdf


def grow(x, g, held, spec):
    """Leaf values per row; leaves come from the learning rows, the hold-out follows the same cuts."""
    learn = ~held
    leaf = np.zeros(len(g), int)
    depth, open_leaves, made = {0: 0}, {0: best_cut(x[learn], g[learn], spec.l1, spec.l2, spec.min_instances)}, 1
    while made < (spec.max_leaves or 10**9):
        able = [(gain, -k) for k, (gain, s) in open_leaves.items() if s is not None and depth[k] < spec.max_depth]
        if not able:
            break
        k = -max(able)[1]
        f, b, _ = open_leaves.pop(k)[1]
        at = np.flatnonzero(leaf == k)
        right = at[x[at, f] > (-np.inf if b == 0 else CUTS["a"][b - 1])]
        new = max(depth) + 1
        leaf[right] = new
        depth[k] += 1
        depth[new] = depth[k]
        made += 1
        for j in (k, new):
            here = (leaf == j) & learn
            open_leaves[j] = best_cut(x[here], g[here], spec.l1, spec.l2, spec.min_instances) if here.sum() >= 2 * spec.min_instances else (0.0, None)
    out = np.zeros(len(g))
    for k in depth:
        here = (leaf == k) & learn
        total = g[here].sum()
        out[leaf == k] = -np.sign(total) * max(abs(total) - spec.l1, 0.0) / (here.sum() + spec.l2) * spec.step
    return out


@pytest.mark.parametrize("growth, leaves, l1, l2", [("level", None, 0.0, 1.0), ("level", None, 4.0, 0.5), ("leaf", 5, 0.0, 1.0), ("leaf", 3, 2.0, 8.0)])
def test_trees_equal_a_plain_loop(rows, growth, leaves, l1, l2):
    spec = BoostedTrees(NAMES, growth=growth, iterations=4, max_depth=3 if growth == "level" else 6, max_leaves=leaves, step=0.3, subsample=1.0,
                        feature_fraction=1.0, l1=l1, l2=l2, min_instances=4, val_size=30, cuts=CUTS, trees_per_cache=2)
    fitted = spec.fit(rows)
    errors, margin, pdf = plain(rows.toPandas(), spec, 4)
    np.testing.assert_allclose(fitted.errors, errors, rtol=1e-9)
    assert len(fitted.trees) == int(np.argmin(errors))
    if len(fitted.trees) == 4:
        got = fitted.predict(rows).orderBy("PULocationID", "hour").toPandas()["prediction"]
        np.testing.assert_allclose(got, margin, rtol=1e-9)


def test_symmetric_trees_use_one_split_per_level(rows):
    spec = boosting_presets(NAMES, iterations=5, max_depth=3, step=0.3, val_size=0, cuts=CUTS, feature_fraction=1.0, subsample=1.0)[2]
    fitted = spec.fit(rows)
    for tree in fitted.trees:
        level, nodes = 0, [0]
        while nodes:
            splits = {(int(tree.feature[n]), int(tree.cut[n])) for n in nodes if tree.feature[n] >= 0}
            assert len(splits) <= 1
            nodes = [c for n in nodes if tree.feature[n] >= 0 for c in (int(tree.left[n]), int(tree.right[n]))]
            level += 1
        assert 1 < level <= 4
    curve = [r["rmse"] for r in fitted.staged_rmse(rows).orderBy("trees").collect()]
    assert len(curve) == 6 and all(a > b for a, b in zip(curve, curve[1:]))


def test_patience_keeps_the_best_number_of_trees(rows):
    noise = rows.withColumn("pickup_count", F.randn(3))  # nothing to learn
    spec = BoostedTrees(NAMES, iterations=40, max_depth=4, step=0.5, patience=3, val_size=60, cuts=CUTS)
    fitted = spec.fit(noise)
    best = int(np.argmin(fitted.errors))
    assert len(fitted.trees) == best and len(fitted.errors) == best + spec.patience + 1 < 41
    staged = fitted.staged_rmse(noise).count()
    assert staged == best + 1


def test_penalties_shrink_leaves_and_sampling_is_repeatable(rows):
    base = BoostedTrees(NAMES, iterations=1, max_depth=2, step=1.0, subsample=0.7, feature_fraction=0.67, val_size=0)
    free, tight = base.with_params(l2=0.0).fit(rows), base.with_params(l2=500.0, l1=20.0).fit(rows)
    assert np.abs(tight.trees[0].value).max() < np.abs(free.trees[0].value).max()
    again = base.with_params(l2=0.0).fit(rows.repartition(5))
    np.testing.assert_array_equal(free.trees[0].value, again.trees[0].value)
    assert not base.with_params(l1=1e9).fit(rows).trees[0].value.any()


def test_save_load_importance_and_odd_inputs(spark, rows, tmp_path):
    fitted = BoostedTrees(NAMES, iterations=3, max_depth=3, val_size=20).fit(rows)
    fitted.save(str(tmp_path / "m"), spark)
    again = load_boosted(spark, str(tmp_path / "m"))
    want = fitted.predict(rows).orderBy("PULocationID", "hour").toPandas()["prediction"]
    np.testing.assert_array_equal(want, again.predict(rows).orderBy("PULocationID", "hour").toPandas()["prediction"])
    shares = fitted.importance(spark).toPandas()
    assert shares.iloc[0]["feature"] == "a" and shares["importance"].sum() == pytest.approx(1)
    odd = rows.limit(5).withColumn("a", F.lit(None).cast("double")).withColumn("prediction", F.lit(1.0))
    assert fitted.predict(odd).filter("prediction is null").count() == 0
    constant = BoostedTrees(("k",), iterations=3, val_size=0).fit(rows.withColumn("k", F.lit(None).cast("double")))
    assert not constant.trees or not np.any(constant.trees[0].feature >= 0)
    with pytest.raises(ValueError):
        BoostedTrees(NAMES, growth="sideways").fit(rows)


def test_search_has_both_penalties(rows):
    space = BOOSTED_SPACE | {"max_depth": (2, 3, "int"), "iterations": (1, 2, "int")}
    best, scores = tune(rows, lambda p: BoostedTrees(NAMES, val_size=0).with_params(**p), 2, 1, 30, space, config=DemandConfig())
    assert {"l1", "l2"} <= set(best) and scores.count() == 2


def test_rows_are_kept_in_blocks_and_no_learning_table_is_written(spark, rows, monkeypatch):
    from tidegrid.models import boosting

    written = []
    keep = boosting.stored
    monkeypatch.setattr(boosting, "stored", lambda df, label: written.append(label) or keep(df, label))
    monkeypatch.setattr(boosting, "_BLOCK_ROWS", 64)
    spec = BoostedTrees(NAMES, iterations=2, max_depth=3, subsample=0.7, val_size=30, cuts=CUTS)
    spec.fit(rows)
    assert written == ["binned"]
    state = spec._binned(rows.repartition(1), [list(CUTS[n]) for n in NAMES], 0.5)
    assert state.count() < 10 < rows.count()
    sizes = [(len(r.y), len(r.is_val), len(r.u), len(r.margin), len(r.bins)) for r in state.collect()]
    assert sum(s[0] for s in sizes) == 8 * 400 and all(s == (8 * s[1], s[1], 8 * s[1], 8 * s[1], 3 * s[1]) for s in sizes)


@pytest.mark.parametrize("inner", [0, 1, 20, 400])
def test_leaves_equal_a_walk_per_row(inner):
    from tidegrid.models.boosting import Tree

    rng = np.random.default_rng(inner)
    feature, left, right, cut, level = [-1], [0], [0], [0], [0]
    for _ in range(inner):
        node = int(rng.choice(np.flatnonzero(np.array(feature) < 0)))
        feature[node], cut[node], left[node], right[node] = int(rng.integers(0, 4)), int(rng.integers(0, 60)), len(feature), len(feature) + 1
        for _side in range(2):
            feature.append(-1), left.append(0), right.append(0), cut.append(0), level.append(level[node] + 1)
    zero = np.zeros(len(feature))
    tree = Tree(*(np.array(c) for c in (feature, cut)), np.array(cut, float), np.array(left), np.array(right), zero, zero, zero, max(level))
    x = rng.integers(0, 64, (4, 500)).astype(np.uint8)
    real = np.where(rng.random(x.shape) < 0.1, np.nan, x.astype(float))
    for columns, limits in ((x, tree.cut), (real, tree.threshold)):
        want = []
        for row in columns.T:
            node = 0
            while feature[node] >= 0:
                node = right[node] if row[feature[node]] > limits[node] else left[node]
            want.append(node)
        assert tree.leaves(columns, limits).tolist() == want


def test_hold_out_joins_a_stored_cut(rows):
    from tidegrid.operators.splits import hold_out

    marked = hold_out(rows, ["PULocationID"], "hour", 30)
    assert marked.filter("is_val").count() == 60
    assert any("/cut-" in f for f in marked.inputFiles())


def test_cut_points_come_from_small_summaries_of_every_task(spark):
    """Exact for few distinct values, within a rank of one in some thousands for many; missing values take no part."""
    rows = spark.range(0, 300_000, 1, 5).selectExpr(
        "cast(id % 7 as int) as few", "if(id % 10 = 0, double('nan'), if(id % 10 = 1, null, pmod(xxhash64(id), 1000003) / 1000003D)) as many", "cast(null as double) as none", "cast(id % 3 as int) as pickup_count"
    )
    spec = BoostedTrees(("few", "many", "none"), max_bins=32)
    (few, many, none), base = spec._cut_points(rows)
    assert few == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0] and none == [] and base == 1.0
    known = np.sort(rows.filter("many is not null and not isnan(many)").toPandas()["many"])
    at = np.searchsorted(known, many) / len(known)
    assert np.abs(at - np.arange(1, 32) / 32).max() < 0.001
    from tidegrid.models import boosting

    values, weights = boosting._thinned([(known, np.ones(len(known), np.int64))] * 3)
    assert len(values) <= boosting._POINTS and weights.sum() == 3 * len(known) and values[-1] == known[-1]
    assert spec._cut_points(rows.filter("false")) == ([[], [], []], 0.0)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_blocks_are_written_and_read_a_few_at_a_time(spark):
    rows = spark.range(0, 800_000, 1, 1).selectExpr(
        "0 as PULocationID", "timestamp'2024-01-01' + make_dt_interval(0, cast(id as int)) as hour",
        "cast(id % 7 as double) as a", "cast(id % 11 as double) as b", "rand(1) as pickup_count",
    )
    before = spark.conf.get(BATCH_BYTES)
    spec = BoostedTrees(("a", "b"), val_size=0)
    ready = spec.prepare(rows)
    assert spark.conf.get(BATCH_BYTES) == before
    files = spec._binned(rows, ready.cuts, ready.base).inputFiles()
    groups = [pq.ParquetFile(f.removeprefix("file:").replace("///", "/")).metadata.num_row_groups for f in files]
    assert max(groups) > 1

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    with small_batches(spark), small_batches(spark):
        found = [r["n"] for r in ready.state.mapInArrow(sizes, "n long").collect()]
    assert spark.conf.get(BATCH_BYTES) == before
    assert sum(found) > 10e6 and max(found) < 4e6
    ready.release()


def test_fits_limit_their_batches(spark, rows, monkeypatch):
    before, seen, plain_pass = spark.conf.get(BATCH_BYTES), [], BoostedTrees._histograms

    def watched(self, *given):
        seen.append(int(spark.conf.get(BATCH_BYTES)))
        return plain_pass(self, *given)

    monkeypatch.setattr(BoostedTrees, "_histograms", watched)
    BoostedTrees(NAMES, iterations=1, max_depth=1, val_size=5).fit(rows)
    assert seen and max(seen) <= 2**21 and spark.conf.get(BATCH_BYTES) == before


def test_summaries_of_many_tasks_become_one_short_list():
    rng = np.random.default_rng(0)
    values = rng.normal(size=64 * boosting._POINTS)
    parts = [(np.sort(v), np.full(len(v), 3)) for v in np.split(values, 64)]
    points, weights = boosting._thinned(parts, boosting._MERGED, boosting._MERGE_LIMIT)
    assert len(points) <= boosting._MERGED and weights.sum() == 3 * len(values)
    ranks = np.searchsorted(np.sort(values), points, side="right") * 3
    np.testing.assert_array_equal(np.cumsum(weights), ranks)
    few = boosting._thinned(parts[:4], boosting._MERGED, boosting._MERGE_LIMIT)
    assert len(few[0]) == 4 * boosting._POINTS  # as they are
