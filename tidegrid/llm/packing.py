"""Best-fit packing of token pieces by length patterns and non-negative least squares.

1. Every text becomes token ids; texts longer than the capacity are cut into pieces.
2. The lengths make one histogram (at most ``capacity`` entries, whatever the input).
3. Patterns of two or three length classes that fill a sequence are enumerated;
   non-negative least squares says how often each is repeated so that the patterns
   together use up the histogram. Repeats are rounded down, and made of lengths that
   fill a sequence exactly.
4. What the patterns leave over (documents, and room in the sequences) is packed by
   best fit on length counts.
5. Each piece finds its place from its rank among the pieces of its length.

Only the histogram and the plan (both bounded by the capacity) pass the driver.

Defined cases: a null or empty text is one piece that holds the end id only; equal
rows are separate documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.common import process_memo, small_batches, stash, texts_of

CAPACITY = 4096
END_ID = 1
#: Bound of the memo of word ids in one Python worker.
MEMO_WORDS = 600_000
#: Rows that one rank bucket holds on average.
BUCKET_ROWS = 4096

# Texts of these characters only are cut into words here; any other text goes to the
# tokenizer as it is.
_PLAIN = re.compile(r"[\x09-\x0d\x20-\x7eÀ-ÖØ-öø-ÿ]*")
# The word pattern of the tokenizer file, over the characters above in lower case.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\s0-9a-zß-öø-ÿ]+")


class WordTokenizer:
    """Ids of a tokenizer whose words never reach over white space, with a memo of words.

    The memo applies to plain texts without special tokens: they are cut by the file's own
    word pattern, and each distinct word is encoded once by the library.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo = process_memo(f"ids:{path}")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[i] = token.endswith("</w>")

    def _learn(self, words: list[str]) -> None:
        """Encode new words, some hundred in one call; each ends with exactly one end-of-word id."""
        if len(self.memo) + len(words) > MEMO_WORDS:
            self.memo.clear()
        groups = [words[i : i + 256] for i in range(0, len(words), 256)]
        for group, done in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = array("I", done.ids)
            cuts = np.flatnonzero(self.ends[np.frombuffer(ids, np.uint32)]) + 1
            if len(cuts) == len(group) and (not len(cuts) or cuts[-1] == len(ids)):
                raw, start = ids.tobytes(), 0
                for word, cut in zip(group, (4 * cuts).tolist()):
                    self.memo[word] = raw[start:cut]
                    start = cut
            else:
                for word in group:
                    self.memo[word] = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        cut, plain = [], []
        for raw in texts:
            text = raw.decode("utf-8", "replace")
            easy = _PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)
            plain.append(easy)
            cut.append(_WORD.findall(text.lower()) if easy else text)
        memo = self.memo
        new = set().union(*[c for c, easy in zip(cut, plain) if easy])
        new = [w for w in new if w not in memo]
        if new:
            self._learn(new)
            if len(memo) < len(new):
                raise AssertionError("the memo lost words")
        out = []
        for words, easy in zip(cut, plain):
            if easy:
                try:
                    out.append(b"".join([memo[w] for w in words]))
                    continue
                except KeyError:  # the memo was emptied while this batch was learnt
                    self._learn([w for w in set(words) if w not in memo])
                    out.append(b"".join([memo[w] for w in words]))
            else:
                out.append(array("I", self.tokenizer.encode(words, add_special_tokens=False).ids).tobytes())
        return out


def _doc_type(docs: DataFrame) -> T.DataType:
    return docs.schema["doc_id"].dataType


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` token ids of each document, the end id appended.

    Returns ``row`` (a number of the document's row), doc_id, piece, start, length,
    ids_crc32 and, on request, the ids.
    """
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()), T.StructField("doc_id", _doc_type(docs)), T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        ]
        + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = WordTokenizer(tokenizer_path), array("I", [end_id]).tobytes()
        for batch in small_batches(batches):
            source, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, raw in enumerate(tokenizer.encode(texts_of(batch))):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    source.append(i), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, np.int32))
            take = pa.array(source, pa.int64())
            columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, schema)


# --- the plan, on the driver: everything here is bounded by the capacity ---


def non_negative_fit(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Non-negative least squares by active sets: min |ax - b| with x >= 0."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    limit = 1e-9 * max(1.0, np.abs(a.T @ b).max(initial=0.0))
    for _ in range(rounds):
        slope = np.where(active, -np.inf, a.T @ (b - a @ x))
        best = int(slope.argmax())
        if slope[best] <= limit:
            break
        active[best] = True
        while True:
            on = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[on] = z
                break
            low = z <= 0
            step = (x[on][low] / np.maximum(x[on][low] - z[low], 1e-300)).min()
            moved = x[on] + step * (z - x[on])
            x[:] = 0
            x[on] = np.where(moved <= 1e-12, 0, moved)
            active &= x > 0
            if not active.any():
                break
    return x


def length_patterns(units: int) -> list[tuple[int, ...]]:
    """Multisets of one to three classes that fill ``units`` exactly."""
    out: list[tuple[int, ...]] = [(units,)]
    out += [(a, units - a) for a in range((units + 1) // 2, units)]
    out += [(a, b, units - a - b) for a in range(1, units) for b in range(1, a + 1) if 1 <= units - a - b <= b]
    return out


class Plan:
    """Groups of equal sequences; each holds runs (length, copies) and has room left."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.groups: list[list] = []  # [times, room, ((length, copies), ...)]

    def add(self, times: int, runs: tuple[tuple[int, int], ...]) -> None:
        if times:
            self.groups.append([times, self.capacity - sum(n * c for n, c in runs), runs])

    def best_fit(self, left: dict[int, int]) -> None:
        """Put what is left, longest first, where it leaves the least room; open sequences as needed."""
        by_room: dict[int, list[list]] = defaultdict(list)
        for g in self.groups:
            by_room[g[1]].append(g)
        rooms = sorted(by_room)
        for n in sorted((n for n, c in left.items() if c > 0), reverse=True):
            count = left[n]
            while count:
                at = bisect.bisect_left(rooms, n)
                while at < len(rooms) and not by_room[rooms[at]]:
                    del rooms[at]
                if at == len(rooms):
                    each = self.capacity // n
                    full, rest = divmod(count, each)
                    made = [[full, self.capacity - each * n, ((n, each),)]] * bool(full) + [[1, self.capacity - rest * n, ((n, rest),)]] * bool(rest)
                    count = 0
                else:
                    g = by_room[rooms[at]].pop()
                    times, room, runs = g
                    g[0], g[2] = 0, ()  # replaced by the groups made of it
                    each = min(room // n, count)
                    filled = min(times, count // each)
                    made = [[filled, room - each * n, (*runs, (n, each))]]
                    if times > filled:
                        made.append([times - filled, room, runs])
                    count -= filled * each
                for g in made:
                    self.groups.append(g)
                    if g[1] not in by_room or not by_room[g[1]]:
                        where = bisect.bisect_left(rooms, g[1])
                        if where == len(rooms) or rooms[where] != g[1]:
                            rooms.insert(where, g[1])
                    by_room[g[1]].append(g)

    def slots(self) -> np.ndarray:
        """Rows (length, first rank, copies in a sequence, first sequence, offset) by length and rank."""
        used: dict[int, int] = defaultdict(int)
        rows, sequence = [], 0
        for times, _, runs in self.groups:
            if not times:
                continue
            offset = 0
            for n, copies in runs:
                rows.append((n, used[n], copies, sequence, offset))
                used[n] += times * copies
                offset += n * copies
            sequence += times
        return np.array(sorted(rows), np.int64).reshape(-1, 5)


def plan_patterns(counts: dict[int, int], capacity: int = CAPACITY, unit: int = 32) -> Plan:
    """Patterns, their repeats and the best fit of the rest for a histogram of lengths."""
    plan, left = Plan(capacity), {n: c for n, c in counts.items() if c > 0}
    units = capacity // unit
    plan.add(left.pop(capacity, 0), ((capacity, 1),))
    classes, pools = np.zeros(units), defaultdict(list)
    for n in sorted(left):
        k = min(units - 1, (2 * n + unit) // (2 * unit))  # the nearest class
        if k:  # shorter ones fill room better one by one
            classes[k - 1] += left[n]
            pools[k].append(n)
    if units >= 2 and classes.sum() > 0:
        patterns = length_patterns(units)[1:]
        a = np.zeros((units, len(patterns)))
        for j, p in enumerate(patterns):
            for k in p:
                a[k - 1, j] += 1
        scale = classes.sum()
        repeats = np.floor(non_negative_fit(a, classes / scale) * scale + 1e-9).astype(np.int64)
        for j in np.argsort(-repeats, kind="stable"):
            if repeats[j] <= 0:
                break
            _draw(plan, left, pools, patterns[j], int(repeats[j]))
    plan.best_fit(left)
    return plan


def _draw(plan: Plan, left: dict[int, int], pools: dict[int, list[int]], pattern: tuple[int, ...], times: int) -> None:
    """Repeat a pattern up to ``times`` with lengths of its classes that fill a sequence exactly."""
    *heads, last = pattern
    inside = set(pools[last])
    for first in itertools.product(*(pools[k][::-1] for k in heads)):
        rest = plan.capacity - sum(first)
        if rest not in inside:
            continue
        need: dict[int, int] = defaultdict(int)
        for n in (*first, rest):
            need[n] += 1
        run = min([times, *(left[n] // c for n, c in need.items())])
        if run > 0:
            plan.add(run, tuple(sorted(need.items(), reverse=True)))
            for n, c in need.items():
                left[n] -= run * c
            times -= run
            if not times:
                return


def _ranked(pieces: DataFrame) -> DataFrame:
    """Rank (from 0) of each piece among those of its length; one length is counted in many tasks."""
    buckets = max(1, -(-pieces.count() // BUCKET_ROWS))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), F.lit(buckets)))
    before = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row", "piece"))
    return dealt.withColumn("inside", inside).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside") - 1).drop("bucket", "before", "inside")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (row, piece, length of 1 to ``capacity``)."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = plan_patterns(counts, capacity).slots()
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (slots[:, 0] << 48) + slots[:, 1]
        for batch in batches:
            length, rank = batch.column(batch.schema.get_field_index("length")).to_numpy(), batch.column(batch.schema.get_field_index("rank")).to_numpy()
            slot = slots[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            inside = rank - slot[:, 1]
            sequence, offset = slot[:, 3] + inside // slot[:, 2], slot[:, 4] + inside % slot[:, 2] * length
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=schema.names)

    return _ranked(pieces).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pack all documents: the pieces with their sequence_id and offset (see the module text)."""
    return pack_pieces(stash(token_pieces(docs, tokenizer_path, capacity, end_id, with_ids), "pieces"), capacity).drop("row")
