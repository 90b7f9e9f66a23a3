"""Periodic runs of words by maximal pairs.

A run is a stretch of words with a smallest period q that cannot be made longer on
either side. Two equal substrings whose left and right neighbours differ are a maximal
pair; if the pair lies p apart and is at least (exponent - 1) * p long, the stretch from
the start of the first to the end of the second is a run with period p. So no stretch
has to be extended: the pair already ends where the run does.

Many texts are handled together. Suffixes are sorted by doubling (a suffix is compared
only with those of its own text, and only while it is not yet alone). The longest common
prefixes of neighbours follow from those whose left words differ. The LCP intervals of
at least the shortest useful length are walked bottom-up; each holds its positions with
the class (the word on the left) of each, and when two children meet, pairs of different
classes whose distance is within the limits are read off. Intervals in which all left
words agree have no such pair and are passed over as a whole.

Positions of one interval that lie within half its length form an arithmetic
progression, all of whose members but the first have the same left word (periodicity
lemma). So beside a position at most two classes meet, and two searches in the sorted
positions find them, however many classes the interval has. Each pair read off belongs
to a run, and the exponents of all runs sum up to less than a few times the words.

Defined cases: null and empty texts have no words and no runs; texts of any length are
taken whole (memory grows with the longest text, not with the table); of equal exponents
the smallest start, then the smallest period is the strongest; repeated rows are answered
one by one; rows without an id are answered too; an empty table gives no rows; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.common import small_batches, texts_of

Reorder = Callable[[int, int], "np.ndarray | None"]

_RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
_ARROW_RUN = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])


def sorted_repeats(words: np.ndarray, ends: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose first ``least`` words (rounded down to a power of two) recur in their
    text, as sorted suffixes, and the number of the group that shares these words.

    ``ends`` is the end of the text that each position lies in, ``owner`` its number. A
    rank is the place of the group's first suffix, so ranks of suffixes that are alone
    never change.
    """
    n = len(words)
    key = owner * (int(words.max(initial=0)) + 1) + words
    places = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    key = key[places]
    starts = np.concatenate([[True], key[1:] != key[:-1]])
    rank[places] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    several = ~(starts & np.concatenate([starts[1:], [True]]))
    open_places, width = places[several], 1
    repeats, groups = (open_places, rank[open_places]) if least < 2 else (None, None)
    while len(open_places):
        after = open_places + width
        inside = after < ends[open_places]
        second = np.where(inside, rank[np.minimum(after, n - 1)], -1)
        key = rank[open_places] * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        open_places, key = open_places[order], key[order]
        old = rank[open_places]
        at = np.arange(len(key))
        starts = np.concatenate([[True], key[1:] != key[:-1]])
        old_starts = np.concatenate([[True], old[1:] != old[:-1]])
        first, old_first = (np.maximum.accumulate(np.where(s, at, 0)) for s in (starts, old_starts))
        rank[open_places] = old + first - old_first
        several = ~(starts & np.concatenate([starts[1:], [True]]))
        open_places = open_places[several]
        width *= 2
        if repeats is None and width * 2 > least:
            repeats, groups = open_places, rank[open_places]
    if repeats is None or not len(repeats):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(rank[repeats], kind="stable")
    return repeats[order], groups[order]


def common_prefixes(words: np.ndarray, ends: np.ndarray, left: np.ndarray, places: np.ndarray, groups: np.ndarray, known: int) -> np.ndarray:
    """Words that each sorted suffix shares with the one before it; 0 at the start of a group.

    If the words on the left of both are equal, the value is one less than that of the
    position before; only the others (their values sum up to n log n) are compared.
    """
    out = np.zeros(len(places), np.int64)
    paired = np.flatnonzero(groups[1:] == groups[:-1]) + 1
    here, before = places[paired], places[paired - 1]
    order = np.argsort(here)
    paired, here, before = paired[order], here[order], before[order]
    anchor = left[here] != left[before]
    a, b = here[anchor], before[anchor]
    limit = ends[a] - np.maximum(a, b)
    value = np.minimum(known, limit)
    live = np.flatnonzero(value < limit)
    while len(live):
        block = int(np.clip(65_536 // len(live), 16, 4096))
        steps = np.arange(block)
        at = value[live, None] + steps
        within = at < limit[live, None]
        x, y = (np.minimum(side[live, None] + at, len(words) - 1) for side in (a, b))
        equal = within & (words[x] == words[y])
        same = np.where(equal.all(axis=1), block, np.argmin(equal, axis=1))
        value[live] += same
        live = live[(same == block) & (value[live] < limit[live])]
    last = np.maximum.accumulate(np.where(anchor, np.arange(len(here)), 0))
    values = np.zeros(len(here), np.int64)
    values[anchor] = value
    out[paired] = values[last] - (here - here[last])
    return out


class _Pairs:
    """Bottom-up walk over the LCP intervals of one group of suffixes."""

    def __init__(self, left: np.ndarray, exponent: int, least_length: int):
        self.left, self.exponent, self.least_length = left, exponent, least_length
        self.found: dict[tuple[int, int], int] = {}  # (start, length) -> smallest period

    def _emit(self, start: int, period: int, shared: int) -> None:
        run = start, shared + period
        if period < self.found.get(run, period + 1):
            self.found[run] = period

    def _join(self, a: list[int], b: list[int], shared: int) -> list[int]:
        """Pairs between two children of an interval; their positions in one sorted list."""
        small, large = (a, b) if len(a) < len(b) else (b, a)
        left, reach, near = self.left, shared // (self.exponent - 1), max(1, self.least_length - shared)
        for x in small:
            low, at, high = bisect_left(large, x - reach), bisect_left(large, x), bisect_right(large, x + reach)
            if low < at:  # the leftmost of the window is the only one that can be of another class
                first = large[low]
                if left[first] != left[x] and x - first >= near:
                    self._emit(first, x - first, shared)
            if at < high and left[large[at]] != left[x]:  # all of them are of one class, x of another
                for y in large[bisect_left(large, x + near, at, high) : high]:
                    self._emit(x, y - x, shared)
        if len(small) * 16 < len(large):
            for x in small:
                insort(large, x)
        else:
            large += small
            large.sort()
        return large

    def walk(self, places: list[int], prefixes: list[int]) -> None:
        """``prefixes[i]`` is shared by places i - 1 and i; the first one is not looked at."""
        stack: list[tuple[int, list[int]]] = []
        for i, place in enumerate(places):
            shared = prefixes[i + 1] if i + 1 < len(places) else 0
            child = [place]
            while stack and stack[-1][0] > shared:
                length, held = stack.pop()
                child = self._join(held, child, length)
            if stack and stack[-1][0] == shared:
                stack[-1] = shared, self._join(stack[-1][1], child, shared)
            else:
                stack.append((shared, child))


def runs_of(texts: list[np.ndarray], exponent: int = 3, least_length: int = 24) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) by start and period, for each text of word numbers (0 and up)."""
    if exponent < 3:
        raise ValueError("runs are read off for exponents of 3 and more only")
    sizes = np.array([len(t) for t in texts], np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not sizes.sum():
        return out
    words = np.concatenate(texts).astype(np.int64)
    last = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    ends, starts = last[owner], (last - sizes)[owner]
    # length = shared + period and period <= shared / (exponent - 1)
    least = max(1, -(-least_length * (exponent - 1) // exponent))
    places, groups = sorted_repeats(words, ends, owner, least)
    if not len(places):
        return out
    left = np.empty(len(words), np.int64)
    left[0], left[1:] = -1, words[:-1]
    left[starts == np.arange(len(words))] = -1
    prefixes = common_prefixes(words, ends, left, places, groups, 1 << (least.bit_length() - 1))
    # Only runs of neighbours that share enough words and do not all have the same left word.
    cut = np.flatnonzero(prefixes < least)
    changes = np.concatenate([[0], np.cumsum((left[places[1:]] != left[places[:-1]]))])
    stops = np.concatenate([cut[1:], [len(places)]])
    wanted = np.flatnonzero(changes[stops - 1] > changes[cut])
    walker = _Pairs(left, exponent, least_length)
    for g in wanted.tolist():
        walker.walk(places[cut[g] : stops[g]].tolist(), prefixes[cut[g] : stops[g]].tolist())
    for (start, length), period in walker.found.items():
        text = int(owner[start])
        out[text].append((start - int(last[text] - sizes[text]), length, period))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period, compared without rounding; the first of equals."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """True for words that no run holds after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) == 0


def find_runs(docs: DataFrame, exponent: int = 3, least_length: int = 24, reorder: Reorder | None = None) -> DataFrame:
    """doc_id, n_words, runs, strongest, collapsed for every document.

    ``runs`` are structs (start, length, period) in words, ``strongest`` is one of them or
    null, ``collapsed`` is the text with every run cut to its first period. ``reorder``
    may give the word numbers to read for (doc_id, number of words) in place of 0, 1, 2, ...
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()),
            T.StructField("runs", T.ArrayType(_RUN)), T.StructField("strongest", _RUN), T.StructField("collapsed", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            known: dict[bytes, int] = {}
            words, numbers = [], []
            for doc_id, raw in zip(batch.column(0).to_pylist(), texts_of(batch)):
                of = raw.split()
                ids = np.fromiter((known.setdefault(w, len(known)) for w in of), np.int64, len(of))
                order = reorder(doc_id, len(of)) if reorder and of else None
                if order is not None:
                    ids, of = ids[order], [of[i] for i in order.tolist()]
                words.append(of)
                numbers.append(ids)
            found = runs_of(numbers, exponent, least_length)
            collapsed = []
            for of, runs in zip(words, found):
                keep = kept_words(len(of), runs).tolist() if runs else None
                collapsed.append(b" ".join(of if keep is None else [w for w, k in zip(of, keep) if k]))
            as_dict = lambda r: None if r is None else dict(zip(("start", "length", "period"), r))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(w) for w in words], pa.int64()),
                    pa.array([[as_dict(r) for r in runs] for runs in found], pa.list_(_ARROW_RUN)),
                    pa.array([as_dict(strongest(runs)) for runs in found], _ARROW_RUN),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ],
                names=schema.names,
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Word numbers of texts whose tail is made periodic: one in ten by the checksum of the id."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % period, i)


def run_digest(found: DataFrame) -> DataFrame:
    """Counts, the strongest run and digests of all runs and of the collapsed text."""
    spelled: Column = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[best[n].alias(n) for n in ("start", "length", "period")],
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", spelled), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
