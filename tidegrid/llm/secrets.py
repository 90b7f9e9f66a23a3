"""Secret scans through nested encodings.

Every text is scanned for three kinds of secrets. Then a worklist unwraps what the text
contains: percent escapes, Unicode escapes, base64 runs, and compressed bytes in such
runs. A base64 run may be broken over lines and start inside a longer word or path, so
its digits are read from each of the four phases; of bytes that are no clean text the
printable stretches (ASCII, as bytes or as UTF-16) are layers, and all members of joined
compressed streams are unpacked. Streams without a header (raw deflate) are found where
they are the whole run. Every new layer is scanned as well and unwrapped in turn, until nothing new comes
up; a layer that was already met at the same place is not unwrapped again, so quines
end. Each character of a layer remembers the span of the text it came from, so all
spans are those of the text as it was given (code points, end exclusive).

One pass over the documents without a shuffle.

Defined cases: null and empty texts have no spans; a span found in several layers counts
once; equal rows are scanned each for itself; an empty table gives no rows; other columns
are ignored (``redact`` keeps them); very long texts are scanned whole, like others. Bytes that unpack to more than ``max_unpacked`` in
one document are left packed, and ``complete`` is false for it.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.common import small_batches, texts_of

KINDS = ("assign", "access", "hex")
MAX_UNPACKED = 64 << 20
_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_LINE_END = re.compile(r"\r?\n[\x20\t]*")
_LAST_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
_HEADERS = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|BZh[1-9]\x17rE8P\x90|\xfd7zXZ\x00")
#: Shorter stretches can hold no secret of any kind: the shortest is ``token=`` and six characters.
_STRETCHES = (
    (1, 0, re.compile(rb"[\t\r\n\x20-\x7e]{12,}")),
    (2, 0, re.compile(rb"(?:[\t\r\n\x20-\x7e]\x00){12,}")),
    (2, 1, re.compile(rb"(?:\x00[\t\r\n\x20-\x7e]){12,}")),
)
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the secrets in one layer."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    return found + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]


class Layer:
    """A text and, for each character, the span of the original it stands for (None: itself)."""

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    def span(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.starts is None else (int(self.starts[start]), int(self.ends[end - 1]))

    def key(self) -> tuple:
        last = len(self.text)
        return (hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).digest(), *self.span(0, last)) if last else (b"", 0, 0)

    def maps(self) -> tuple[np.ndarray, np.ndarray]:
        if self.starts is None:
            at = np.arange(len(self.text))
            return at, at + 1
        return self.starts, self.ends


def _utf8_pieces(data: bytes) -> list[tuple[str, int, int]] | None:
    """Characters with their byte spans; None if the bytes aren't UTF-8."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    pieces, at = [], 0
    for c in text:
        size = len(c.encode("utf-8"))
        pieces.append((c, at, at + size))
        at += size
    return pieces


def _percent_pieces(run: str) -> list[tuple[str, int, int]]:
    data = bytes.fromhex(run.replace("%", ""))
    pieces = _utf8_pieces(data)
    if pieces is None:  # keep what isn't ASCII as it is
        return [(chr(b), i, i + 1) if b < 128 else (run[3 * i : 3 * i + 3], i, i + 1) for i, b in enumerate(data)]
    return pieces


def _unicode_pieces(run: str) -> list[tuple[str, int, int]]:
    if run.startswith("\\u") and run[2] != "{":
        units = [run[i + 2 : i + 6] for i in range(0, len(run), 6)]
        text = b"".join(int(u, 16).to_bytes(2, "little") for u in units).decode("utf-16-le", "surrogatepass")
        pieces, at = [], 0
        for c in text:
            size = 6 * (2 if ord(c) > 0xFFFF else 1)
            pieces.append((c, at, at + size))
            at += size
        return pieces
    digits = run.strip("\\uUx&#;{}X")
    code = int(digits, 10 if run.startswith("&#") and run[2] not in "xX" else 16)
    return [(chr(code), 0, len(run))] if code < 0x110000 else [(run, 0, len(run))]


def _replaced(layer: Layer, pattern: re.Pattern, unpack, unit: int) -> Layer | None:
    """The layer with every match of the pattern unwrapped, or None if nothing changes."""
    parts, starts, ends, last = [], [], [], 0
    old_starts, old_ends = layer.maps()
    for m in pattern.finditer(layer.text):
        parts.append(layer.text[last : m.start()])
        starts.append(old_starts[last : m.start()])
        ends.append(old_ends[last : m.start()])
        for c, a, b in unpack(m.group()):
            parts.append(c)
            starts.append(np.full(len(c), old_starts[m.start() + a * unit]))
            ends.append(np.full(len(c), old_ends[m.start() + b * unit - 1]))
        last = m.end()
    if not last:
        return None
    parts.append(layer.text[last:])
    starts.append(old_starts[last:])
    ends.append(old_ends[last:])
    text = "".join(parts)
    return None if text == layer.text else Layer(text, np.concatenate(starts), np.concatenate(ends))


class _Budget:
    def __init__(self, left: int):
        self.left, self.complete = left, True


def _box(data: bytes):
    """The decompressor for bytes that start with a header."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:1] == b"\x78":
        return zlib.decompressobj()
    return bz2.BZ2Decompressor() if data[:3] == b"BZh" else lzma.LZMADecompressor(memlimit=128 << 20)


def _member(box, data: bytes, budget: _Budget) -> bytes | None:
    """What one member unpacks to; None if the bytes are no such member or unpack to too much."""
    try:
        out = box.decompress(data, budget.left + 1)
    except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
        return None
    if len(out) > budget.left:
        budget.complete = False
        return None
    budget.left -= len(out)
    return out


def _unpacked(data: bytes, budget: _Budget) -> list[bytes]:
    """What the compressed streams in the bytes unpack to; members that follow each other are joined."""
    found, end, at = [], -1, 0
    while (m := _HEADERS.search(data, at)) is not None:
        box = _box(data[m.start() : m.start() + 8])
        out = _member(box, data[m.start() :], budget)
        if out is None:
            at = m.start() + 1
            continue
        if m.start() == end:
            found[-1] += out
        else:
            found.append(out)
        at = end = len(data) - len(box.unused_data)
    if not found and len(data) > 8:
        box = zlib.decompressobj(-15)
        out = _member(box, data, budget)
        if out and box.eof and not box.unused_data and _clean(out) is not None:
            found.append(out)
    return found


def _clean(data: bytes) -> str | None:
    """The bytes as UTF-8 text, None if they are not that or hold control characters."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return None if _CONTROL.search(text) else text


def _readable(data: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Texts in the bytes, with the first and last byte (exclusive) of each character."""
    text = _clean(data)
    if text is not None:
        sizes = np.ones(len(text), np.int64) if len(text) == len(data) else np.array([len(c.encode("utf-8")) for c in text], np.int64)
        last = np.cumsum(sizes)
        yield text, last - sizes, last
        return
    for width, skip, pattern in _STRETCHES:
        for m in pattern.finditer(data):
            first = np.arange(m.start(), m.end(), width)
            yield m.group()[skip::width].decode("ascii"), first, first + width


def _base64_runs(text: str) -> Iterator[tuple[str, np.ndarray, int]]:
    """Runs of base64 digits (lines of a broken run joined), the place of each digit and the end of the run."""
    at = 0
    while (m := _BASE64.search(text, at)) is not None:
        parts, places, at = [], [], m.start()
        while m is not None:
            digits = m.group().rstrip("=")
            parts.append(digits)
            places.append(np.arange(m.start(), m.start() + len(digits)))
            at = m.end()
            gap = _LINE_END.match(text, at) if len(digits) >= 16 and len(digits) == m.end() - m.start() else None
            m = _LAST_LINE.match(text, gap.end()) if gap else None
        yield "".join(parts), np.concatenate(places), at
        if len(parts) > 1:  # the next line may be no part of the run: each line also for itself
            for digits, place in zip(parts, places):
                if len(digits) >= 16:
                    yield digits, place, int(place[-1]) + 1


def _base64_layers(layer: Layer, budget: _Budget) -> Iterator[Layer]:
    old_starts, old_ends = layer.maps()
    for digits, places, end in _base64_runs(layer.text):
        for phase in range(4):
            run = digits[phase:]
            if len(run) % 4 == 1:
                run = run[:-1]
            if len(run) < 12:
                break
            data = base64.b64decode(run.translate(_SAFE) + "=" * (-len(run) % 4))
            for text, first, last in _readable(data):
                if text:
                    # Byte j holds the bits from 8 j; a base64 digit holds six.
                    yield Layer(text, old_starts[places[phase + first * 8 // 6]], old_ends[places[phase + (last * 8 + 5) // 6 - 1]])
            whole = old_starts[places[phase]], old_ends[end - 1]
            seen, work = set(), _unpacked(data, budget)
            opened = bool(work)
            while work:
                inner = work.pop()
                if (digest := hashlib.sha256(inner).digest()) in seen:
                    continue
                seen.add(digest)
                work += _unpacked(inner, budget)
                for text, _, _ in _readable(inner):
                    if text:
                        yield Layer(text, np.full(len(text), whole[0]), np.full(len(text), whole[1]))
            if phase == 0 and (opened and _HEADERS.match(data) or _clean(data) is not None):
                break  # the run is what it seems: the other phases are noise


_SAFE = str.maketrans("-_", "+/")


def scan(text: str, max_unpacked: int = MAX_UNPACKED) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, bool]:
    """Spans of the text itself, spans of all layers, number of layers, whether all was unpacked."""
    first = Layer(text)
    budget = _Budget(max_unpacked)
    base: list[tuple[int, int, int]] | None = None
    spans: set[tuple[int, int, int]] = set()
    seen, work, layers = {first.key()}, [first], 0
    while work:
        layer = work.pop()
        layers += 1
        found = find_secrets(layer.text)
        if base is None:
            base = sorted(found)
        for start, kind, end in found:
            a, b = layer.span(start, end)
            spans.add((a, kind, b))
        new = []
        if "%" in layer.text:
            new.append(_replaced(layer, _PERCENT, _percent_pieces, 3))
        if "\\" in layer.text or "&#" in layer.text:
            new.append(_replaced(layer, _UNICODE, _unicode_pieces, 1))
        if _BASE64.search(layer.text):
            new += _base64_layers(layer, budget)
        for one in new:
            if one is not None and one.text and (key := one.key()) not in seen:
                seen.add(key)
                work.append(one)
    return base or [], sorted(spans), layers, budget.complete


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_documents(docs: DataFrame, max_unpacked: int = MAX_UNPACKED) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_layers, complete for every document."""
    longs = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType), *longs, T.StructField("base_sha256", T.StringType()),
            T.StructField("spans", T.StringType()), T.StructField("n_layers", T.LongType()), T.StructField("complete", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = []
            for raw in texts_of(batch):
                base, spans, layers, complete = scan(raw.decode("utf-8", "replace"), max_unpacked)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((*counts, hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(spans), layers, complete))
            arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate([pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.bool_()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=schema.names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def redact(docs: DataFrame, mark: str = "[secret]", max_unpacked: int = MAX_UNPACKED) -> DataFrame:
    """All documents and columns as they were, each secret span of the text replaced by ``mark`` (overlapping spans by one)."""
    schema = T.StructType([docs.schema["text"]])

    def clean(text: str) -> str:
        parts, last = [], 0
        for start, _, end in scan(text, max_unpacked)[1]:
            if start >= last:
                parts += [text[last:start], mark]
            last = max(last, end)
        return "".join([*parts, text[last:]])

    fields = docs.columns
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("clean", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            known = batch.column(1).is_valid().to_pylist()
            done = [clean(t.decode("utf-8", "replace")) if ok else None for t, ok in zip(texts_of(batch), known)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.string())], names=schema.names)

    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in fields)).alias("row"), F.col("text").cast("string").alias("text"))
    return packed.mapInArrow(run, schema).select(*((F.col("clean") if c == "text" else F.col("row")[c]).alias(c) for c in fields))
