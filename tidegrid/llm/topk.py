"""Exact top-k inner products on a bit-sliced index.

Every component is an integer. For a block of rows, each attribute is kept as
bitmaps, one per binary digit (a slice), of the component minus the attribute's
minimum. A query adds the slices with full adders on bitmaps: a digit of |q| shifts a
slice, and negative q take the complement of the slices. The sum is itself a list of
slices; from the most significant one downward, rows are selected until k remain, and
the rows that tie at the boundary are taken by smaller id.

Queries come in blocks, and each (query block, row block) is one task's work; a query
keeps k rows per row block, and the best k of those are the answer.

Defined cases: vectors that are null, empty, or hold nulls or non-finite values, and rows without
an id, take no part; vectors of another length than the query's are no candidates of it
(they meet only their own length); rows that repeat the query's id count as its own;
ties go to smaller ids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import stash

ROW_BLOCK = 65_536
QUERY_BLOCK = 512


class BitSlices:
    """Slices of the rows of one block; bit i of every bitmap is row i, in the order of ids."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], values[order]
        self.rows, self.dims = values.shape
        self.low = values.min(axis=0)
        shifted = (values - self.low).astype(np.uint64)
        self.digits = [max(1, int(m).bit_length()) for m in shifted.max(axis=0)]
        padded = np.zeros((-(-self.rows // 64) * 64, self.dims), np.uint64)
        padded[: self.rows] = shifted
        self.all = self._bitmap(np.arange(len(padded)) < self.rows)
        self.slices = [[self._bitmap((padded[:, d] >> np.uint64(b)) & np.uint64(1)) for b in range(self.digits[d])] for d in range(self.dims)]
        self.complements = [[~s for s in of] for of in self.slices]

    @staticmethod
    def _bitmap(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits.astype(bool), bitorder="little").view(np.uint64)

    def sums(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the (shifted) inner product of every row, and the constant that was shifted by."""
        columns: list[list[np.ndarray]] = [[] for _ in range(64)]
        constant = 0
        for d, q in enumerate(query.tolist()):
            if not q:
                continue
            constant += q * int(self.low[d])
            if q < 0:
                constant += q * ((1 << self.digits[d]) - 1)
            of, q = (self.slices if q > 0 else self.complements)[d], abs(q)
            for shift in range(q.bit_length()):
                if q >> shift & 1:
                    for b, s in enumerate(of):
                        columns[shift + b].append(s)
        out = []
        for w, column in enumerate(columns):
            at = 0
            while len(column) - at > 2:  # full adder: three bitmaps become one here and one above
                a, b, c = column[at : at + 3]
                at += 3
                half = a ^ b
                column.append(half ^ c)
                columns[w + 1].append((a & b) | (half & c))
            if len(column) - at == 2:
                a, b = column[at : at + 2]
                columns[w + 1].append(a & b)
                out.append(a ^ b)
            else:
                out.append(column[at] if at < len(column) else None)
        while out and out[-1] is None:
            out.pop()
        return out, constant

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but the query's own."""
        sums, constant = self.sums(query)
        ties, taken = self.all.copy(), np.zeros_like(self.all)
        own = np.arange(*(int(np.searchsorted(self.ids, query_id, side=s)) for s in ("left", "right")))
        for i in own.tolist():
            ties[i >> 6] &= ~np.uint64(1 << (i & 63))
        have = 0
        for s in reversed(sums):
            if s is None:
                continue
            ones = ties & s
            n = int(np.bitwise_count(ones).sum())
            if have + n > k:
                ties = ones
            else:
                taken |= ones
                have += n
                ties &= ~s
                if have == k:
                    ties[:] = 0
                    break
        rows = np.flatnonzero(np.unpackbits(taken.view(np.uint8), bitorder="little"))
        if have < k:  # rows that tie at the boundary: the smallest ids
            rows = np.concatenate([rows, np.flatnonzero(np.unpackbits(ties.view(np.uint8), bitorder="little"))[: k - have]])
        score = np.full(len(rows), constant, np.int64)
        word, bit = rows >> 6, (rows & 63).astype(np.uint64)
        for w, s in enumerate(sums):
            if s is not None:
                score += ((s[word] >> bit) & np.uint64(1)).astype(np.int64) << w
        return self.ids[rows], score


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k rows of highest inner product.

    Both take (vec_id long, values array<int>).
    """
    blocks = max(1, -(-vectors.count() // ROW_BLOCK))
    # The blocks of queries and rows are fixed by hash, so that work grows by whole blocks.
    rows = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks))).withColumn("query", F.lit(False))
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    cell = F.struct("block", "part")
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = queries.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(query_blocks)).cast("int")).withColumn("query", F.lit(True))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    both = rows.select(cell.alias("cell"), "query", "vec_id", "values").unionByName(asked.select(cell.alias("cell"), "query", "vec_id", "values"))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        found = []
        by_length = group["values"].str.len()
        for _, same in group.groupby(by_length):
            held, wanted = same[~same["query"]], same[same["query"]]
            if held.empty or wanted.empty:
                continue
            index = BitSlices(held["vec_id"].to_numpy(np.int64), np.stack(held["values"].to_numpy()).astype(np.int64))
            for q, vector in zip(wanted["vec_id"].tolist(), wanted["values"]):
                ids, scores = index.best(q, np.asarray(vector, np.int64), k)
                found.append(pd.DataFrame({"query_id": q, "vec_id": ids, "score": scores}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    found = both.groupBy("cell").applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(vectors: DataFrame, factor: int = 64, column: str = "embedding") -> DataFrame:
    """vec_id and the components as whole numbers floor(factor * x); rows that take no part are left out."""
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    values = F.transform(x, lambda v: F.floor(F.lit(factor) * v.cast("double")).cast("int"))
    good = vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)).filter(finite)
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("values"))


def search_every_nth(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """Every row whose id is divisible by ``every`` asks; all rows answer."""
    rows = stash(quantised(vectors), "vectors")
    return top_inner_products(rows, rows.filter(F.pmod("vec_id", F.lit(every)) == 0), k)
