"""SentencePiece encoding and decoding with forward states shared between words.

A text is normalised, marked (a space becomes the mark) and cut before its marks, where
no piece of the vocabulary reaches over. The distinct marked words of a batch are sorted,
which lists the leaves of their trie in depth-first order: the forward states of a word
are kept up to the prefix it shares with the next one, and only the rest is computed.

With a vocabulary of unigram scores the state of a prefix is its best sum of scores and
the last piece of that segmentation; of equal sums the longer last piece stays (the library
lets the rounding of its total over the whole text decide there). With one
of merged pairs a best sum would give other ids than the library's, so there the state is
the last piece alone: the one piece that ends here and stays apart from the last piece of
the prefix before it when the two are merged together. Words that start with several
marks hold merges of equal rank and are merged directly.

Maps only, no shuffle; encoding and decoding share one map. A task's memo of words is
bounded by bytes, that of pairs by number.

Defined cases: null and empty texts have no ids and decode to the empty text; texts and
words of any length are taken whole; characters outside the vocabulary become their UTF-8
bytes (without byte pieces: the unknown piece, neighbours as one); the mark itself in a
text decodes to a space, as does what the normaliser changes; equal rows are separate; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.common import process_memo, small_batches, texts_of

MARK = "▁"
#: Bytes that the memo of words may hold (with about 200 for an entry), and entries of that of pairs (one number each).
MEMO_BYTES = 64 << 20
MEMO_PAIRS = 1_000_000
#: Bytes of text whose words are sorted together; more words share longer prefixes.
BATCH_BYTES = 8 << 20
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
# Fixed values of the model file format: piece types, model types, and how far an unknown character lies below the lowest score.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGED_PAIRS = 1, 2
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Fields of one message of the model file."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = number() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size


class PieceModel:
    """Pieces, scores (or ranks) and byte pieces of a model file of unigram scores or merged pairs."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.raw: list[bytes] = []
        self.byte_ids: list[int | None] = [None] * 256
        self.unknown = 0
        kind_of_model = UNIGRAM
        with open(path, "rb") as f:
            data = f.read()
        for field, value in _fields(data):
            if field == 2:
                kind_of_model = dict(_fields(value)).get(3, UNIGRAM)
            if field != 1:
                continue
            parts = dict(_fields(value))
            piece, kind, i = parts[1].decode("utf-8"), parts.get(3, NORMAL), len(self.raw)
            self.raw.append(b"")
            if kind == NORMAL:
                self.ids[piece], self.scores[piece] = i, struct.unpack("<f", parts.get(2, b"\0\0\0\0"))[0]
                self.raw[i] = piece.encode("utf-8")
            elif kind == BYTE:
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif kind == UNKNOWN:
                self.unknown, self.raw[i] = i, " ⁇ ".encode()
            elif kind == USER_DEFINED:
                raise ValueError("pieces given by the user are not supported")
        if kind_of_model not in (UNIGRAM, MERGED_PAIRS):
            raise ValueError("the model is neither one of unigram scores nor of merged pairs")
        self.by_score = kind_of_model == UNIGRAM
        self.id_bytes = [struct.pack("<I", i) for i in range(len(self.raw))]
        if self.by_score and any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces that reach over a mark are not supported")
        self.byte_pieces = None not in self.byte_ids
        self.unknown_score = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        # Lengths of the pieces that end with the same three characters, longest first.
        by_ending: dict[str, set[int]] = {}
        for piece in self.ids:
            if len(piece) > 2:
                by_ending.setdefault(piece[-3:], set()).add(len(piece))
        self.lengths = {k: (*sorted(v, reverse=True), 2, 1) for k, v in by_ending.items()}
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.held = 0

    def merged(self, text: str) -> list[str]:
        """Segmentation by merging: the pair of best score first, the leftmost of equals."""
        pieces: list[str | None] = list(text)
        after, before = list(range(1, len(pieces) + 1)), list(range(-1, len(pieces) - 1))
        heap: list[tuple[float, int, str, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(pieces) and (score := self.scores.get(pieces[a] + pieces[b])) is not None:
                heapq.heappush(heap, (-score, a, pieces[a], pieces[b]))

        for i in range(len(pieces) - 1):
            offer(i, i + 1)
        while heap:
            _, a, left, right = heapq.heappop(heap)
            b = after[a]
            if pieces[a] != left or b >= len(pieces) or pieces[b] != right:
                continue
            pieces[a], pieces[b] = left + right, None
            after[a] = after[b]
            if after[a] < len(pieces):
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in pieces if p is not None]

    def apart(self, left: str, right: str) -> bool:
        """Whether the two pieces stay as they are side by side (an empty left: whether the right one is one piece)."""
        return self.merged(left + right) == ([left, right] if left else [right])

    def coded(self, pieces: list[str]) -> bytes:
        """Little-endian 32-bit ids."""
        out = array("I")
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.byte_pieces:
                out.extend(self.byte_ids[b] for b in p.encode("utf-8", "replace"))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out.tobytes()

    def _sizes(self, word: str, end: int) -> tuple[int, ...]:
        """Lengths that a piece ending at ``end`` may have, longest first."""
        return self.lengths.get(word[end - 3 : end], (2, 1)) if end > 2 else (2, 1)[2 - end :]

    def _joined(self, before: bytes, piece: str, i: int) -> bytes:
        """Ids of a prefix and its last piece (``i`` is -1 for a character outside the vocabulary)."""
        if i >= 0:
            return before + self.id_bytes[i]
        if self.byte_pieces:
            return before + self.coded([piece])
        unknown = self.id_bytes[self.unknown]
        return before if before.endswith(unknown) else before + unknown

    def _best_ends(self, word: str, shared: int, states: tuple[list, list, list]) -> None:
        """Add the state of each longer prefix of ``word``: best sum of scores, ids."""
        sums, _, codes = states
        for end in range(shared + 1, len(word) + 1):
            best, found = None, 1
            for size in self._sizes(word, end):
                score = self.scores.get(word[end - size : end]) if size <= end else None
                if score is None and size == 1:
                    score = self.unknown_score
                if score is not None:
                    total = _single(sums[end - size] + score)
                    if best is None or total > best:
                        best, found = total, size
            piece = word[end - found : end]
            sums.append(best)
            codes.append(self._joined(codes[end - found], piece, self.ids.get(piece, -1)))

    def _apart_ends(self, word: str, shared: int, states: tuple[list, list, list]) -> None:
        """The same under merging, with length and id of the last piece: the one that stays apart from the piece before it."""
        sizes, lefts, codes = states
        ids, pairs, lengths, id_bytes, many = self.ids, self.pairs, self.lengths, self.id_bytes, len(self.raw) + 1
        for end in range(shared + 1, len(word) + 1):
            for size in lengths.get(word[end - 3 : end], (2, 1)) if end > 2 else (2, 1)[2 - end :]:
                if size > end:
                    continue
                piece = word[end - size : end]
                i = ids.get(piece)
                if i is None:
                    continue
                start = end - size
                left = lefts[start]
                known = pairs.get(left * many + i) if left >= 0 else None
                if known is None:
                    known = self.apart(word[start - sizes[start] : start], piece)
                    if left >= 0:
                        if len(pairs) >= MEMO_PAIRS:
                            pairs.clear()
                        pairs[left * many + i] = known
                if known:
                    codes.append(codes[start] + id_bytes[i])
                    break
            else:
                size, i = 1, -1
                codes.append(self._joined(codes[end - 1], word[end - 1], -1))
            sizes.append(size)
            lefts.append(i)

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Code words in sorted order; states are kept along the shared prefix."""
        coded: dict[str, bytes] = {}
        extend = self._best_ends if self.by_score else self._apart_ends
        states = ([0.0], [], [b""]) if self.by_score else ([0], [len(self.raw)], [b""])
        previous, codes = "", states[2]
        for word in sorted(words):
            if not self.by_score and word.startswith(MARK + MARK):
                coded[word] = self.coded(self.merged(word))
                continue
            shared = 0
            for a, b in zip(word, previous):
                if a != b:
                    break
                shared += 1
            for of in states:
                del of[shared + 1 :]
            extend(word, shared, states)
            previous, coded[word] = word, codes[-1]
        return coded

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [_WORDS.findall(t) for t in self.processor.normalize(texts)] if texts else []
        memo = self.words
        new = self.learn({w for w in set().union(*cut) if w not in memo})
        found = [b"".join([new[w] if w in new else memo[w] for w in words]) for words in cut]
        for word, ids in new.items():
            self.held += 200 + 4 * len(word) + len(ids)
            if self.held > MEMO_BYTES:
                memo.clear()
                self.held = 200 + 4 * len(word) + len(ids)
            memo[word] = ids
        return found

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def _single(x: float) -> float:
    """Rounded to single precision, in which the library adds up scores."""
    return struct.unpack("f", struct.pack("f", x))[0]


def _model(path: str) -> PieceModel:
    """The model of a worker; it is a pure function of the file."""
    memo = process_memo("pieces")
    if path not in memo:
        memo[path] = PieceModel(path)
    return memo[path]


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text, ids (array of int), ids_crc32 for every document."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path)
        for batch in small_batches(batches):
            found = model.encode([t.decode("utf-8", "replace") for t in texts_of(batch)])
            offsets = [0]
            for f in found:
                offsets.append(offsets[-1] + len(f) // 4)
            flat = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(found))])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids, pa.array(map(zlib.crc32, found), pa.int64())], names=schema.names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decoded_text(ids: Column, model_path: str) -> Column:
    """Text of an array of ids; null ids decode to null."""

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        model = _model(model_path)
        return pa.array([None if x is None else model.decode(x) for x in lists.to_pylist()], pa.string())

    return decode(ids)


def encode_and_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_crc32, round_trip (decoded equals the text) for every document.

    Ids are decoded where they were made; neither they nor the texts leave the task.
    """
    kinds = (("n_pieces", T.LongType()), ("ids_crc32", T.LongType()), ("decoded_crc32", T.LongType()), ("round_trip", T.BooleanType()))
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(*k) for k in kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path)
        for batch in small_batches(batches, limit=BATCH_BYTES):
            texts = texts_of(batch)
            found = model.encode([t.decode("utf-8", "replace") for t in texts])
            decoded = [model.decode(memoryview(f).cast("I")).encode("utf-8") for f in found]
            columns = [len(f) // 4 for f in found], map(zlib.crc32, found), map(zlib.crc32, decoded), [a == b for a, b in zip(texts, decoded)]
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=schema.names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
