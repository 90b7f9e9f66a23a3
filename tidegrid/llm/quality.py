"""Text quality by regularised quadratic discriminant analysis.

Every document becomes a short list of transformed statistics of its whole text. Each
class has a mean and a covariance; the covariances are shrunk towards the pooled one and
that one towards its diagonal, by amounts that fall with the number of labelled rows. A
score is the difference of the two log-densities (Mahalanobis distances by the
inverse Cholesky factors, kept for all rows) through the logistic function. The shrinkage
never falls below a floor, so a statistic that is constant or follows from others is no harm
at any number of labels.

Learning needs only sums of values and of products of values around their common mean (so
that no digits are lost): they are summed by Spark, and one row per class and pair of
statistics reaches the driver, whatever the input.

Defined cases: null and empty texts have all statistics of an empty text and are scored
like any other; repeated labels of one document count as one (the larger); null labels
are not learnt from; without labels of both classes every score is the share of label 1
(0.5 without any); repeated rows are scored each for itself; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.common import small_batches, stash, texts_of
from tidegrid.llm.language import remainder_of_id

THRESHOLD = 0.3
#: Label rows that weigh as much as the shrinkage target, for each statistic.
PRIOR_ROWS = 2.0
#: Least weight of the shrinkage targets, which counts from some 40,000 labelled rows on.
LEAST_SHRINKAGE = 1e-3
_ENDS = re.compile(rb"[.!?][\s]")
_KINDS = np.zeros((6, 256), bool)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\v\f\r", b".,;:'\"-!?()", b"")):
    _KINDS[_i, list(_chars)] = True
_KINDS[5, 128:] = True
#: Kind of each byte: upper, lower, digit, white space, common punctuation, beyond ASCII, other symbols.
_KIND_OF = np.where(_KINDS.any(axis=0), _KINDS.argmax(axis=0), 6)


def _share(part: float, whole: float) -> float:
    """A smoothed log-odds of a share."""
    return math.log((part + 0.5) / (max(whole - part, 0) + 0.5))


def statistics_of(text: bytes) -> list[float]:
    """The transformed statistics of one text."""
    data = np.frombuffer(text, np.uint8)
    bytes_of = np.bincount(data, minlength=256)
    kinds = np.bincount(_KIND_OF, bytes_of, 7)
    size = len(text)
    words = text.split()
    n = len(words)
    counted = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    line_counts = Counter(lines)
    letters = kinds[0] + kinds[1] + kinds[5]
    p = bytes_of[bytes_of > 0] / max(size, 1)
    repeated = sum(len(x) * (c - 1) for x, c in line_counts.items())
    lengths = np.fromiter(map(len, words), float, n) if n else np.zeros(1)
    odd_ends = sum(c for w, c in counted.items() if _KIND_OF[w[-1]] == 6 or w.endswith(b"!!"))
    packed = len(zlib.compress(text, 1)) if size else 0
    return [
        math.log1p(n), math.log1p(len(lines)), math.log1p(size / max(len(lines), 1)),
        math.log1p(lengths.mean()), math.log1p(lengths.std()),
        _share(kinds[0], letters), _share(kinds[2], size), _share(kinds[4], size), _share(kinds[6], size), _share(kinds[3], size),
        _share(bytes_of[ord("|")], size), _share(bytes_of[ord("!")], size),
        float(-(p * np.log2(p)).sum()), _share(odd_ends, n),
        _share(n - len(counted), n), _share(max(counted.values(), default=0), n),
        _share(repeated, size), _share(max((len(x) * c for x, c in line_counts.items()), default=0) if len(lines) > 1 else 0, size),
        math.log1p(10 * packed / max(size, 1)), _share(len(_ENDS.findall(text)), n),
    ]


WIDTH = len(statistics_of(b""))


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics, for every row of (doc_id, text)."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = [statistics_of(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=schema.names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


class Discriminant:
    """Two Gaussians with cached Cholesky factors."""

    def __init__(self, sums: dict[int, np.ndarray], prior_rows: float = PRIOR_ROWS, centre: np.ndarray | None = None):
        """``sums``: per class the summed outer products of (1, x - centre)."""
        self.centre = 0.0 if centre is None else centre
        count = {c: s[0, 0] for c, s in sums.items()}
        total = sum(count.values())
        self.share = (count.get(1, 0.0) / total) if total else 0.5
        self.classes = {}
        if min(count.get(0, 0.0), count.get(1, 0.0)) < 2:
            return
        scatter = {c: s[1:, 1:] - np.outer(s[0, 1:], s[0, 1:]) / s[0, 0] for c, s in sums.items()}
        pooled = sum(scatter.values()) / total
        width = len(pooled)
        least = LEAST_SHRINKAGE if prior_rows else 0.0
        weight = max(prior_rows * width / (prior_rows * width + total), least)
        pooled = (1 - weight) * pooled + weight * np.diag(np.diag(pooled)) + 1e-6 * np.eye(width)
        for c, s in sums.items():
            weight = max(prior_rows * width / (prior_rows * width + count[c]), least)
            root = np.linalg.cholesky((1 - weight) * scatter[c] / count[c] + weight * pooled)
            self.classes[c] = s[0, 1:] / s[0, 0], np.linalg.inv(root), 2 * np.log(np.diag(root)).sum(), math.log(count[c] / total)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.share)
        x = x - self.centre
        density = {c: prior - 0.5 * (spread + (((x - mean) @ inverse.T) ** 2).sum(axis=1)) for c, (mean, inverse, spread, prior) in self.classes.items()}
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def learn(rows: DataFrame, prior_rows: float = PRIOR_ROWS) -> Discriminant:
    """Fit from rows (label 0 or 1, x): the mean of each statistic first, then products around it."""
    means = rows.select(F.posexplode("x").alias("at", "value")).groupBy("at").agg(F.avg("value").alias("mean")).orderBy("at").collect()  # 20 rows
    centre = np.array([r["mean"] for r in means]) if means else np.zeros(WIDTH)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {c: np.zeros((WIDTH + 1, WIDTH + 1)) for c in (0, 1)}
        for batch in batches:
            if not batch.num_rows:
                continue
            label = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.array(batch.column(1).to_pylist()) - centre
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            for c in sums:
                part = x[label == c]
                sums[c] += part.T @ part
        n = (WIDTH + 1) ** 2
        for c, s in sums.items():
            if s[0, 0]:
                yield pa.RecordBatch.from_arrays([pa.array([c] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(s.ravel())], names=["label", "at", "total"])

    summed = rows.select(F.col("label").cast("int").alias("label"), "x").mapInArrow(products, "label int, at int, total double")
    sums = {}
    for r in summed.groupBy("label", "at").agg(F.sum("total").alias("total")).collect():  # 2 x 21 x 21 rows
        sums.setdefault(r.label, np.zeros((WIDTH + 1) ** 2))[r.at] = r.total
    return Discriminant({c: s.reshape(WIDTH + 1, WIDTH + 1) for c, s in sums.items()}, prior_rows, centre)


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; learns labels of those that aren't held out."""
    held_out = remainder_of_id(F.col("doc_id"), folds) == held
    values = stash(text_statistics(docs), "statistics")
    marked = labels.filter(F.col("quality").isin(0, 1)).filter(~held_out).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    model = learn(values.join(marked, "doc_id").select("label", "x"))
    schema = T.StructType([values.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(np.array(batch.column(2).to_pylist()).reshape(-1, WIDTH))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=schema.names)

    return values.select("doc_id", held_out.alias("held_out"), "x").mapInArrow(run, schema)
