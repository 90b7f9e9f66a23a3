"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent letter n-grams (one to three
letters, words padded with a boundary mark) over all learning documents. A document's
own most frequent n-grams are ranked in the same way; its distance to a profile is the
sum of the places by which its n-grams are out of place, an n-gram the profile lacks
counting as the worst place. The nearest profile names the language.

N-grams are counted within each task, so one row per (task, language, n-gram) is
shuffled, however often it occurs. Only the profiles (languages x ``size`` rows) reach
the driver and the tasks.

Defined cases: null texts and texts without a letter are ``und`` with score 0; so is
every text when nothing could be learnt; equal counts share the mean of their places;
equal distances go to the first language in order; null languages are not learnt from;
a null doc_id counts as the empty text in ``held_out``; an empty table gives no rows;
other columns are ignored (``drop_unidentified`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.common import process_memo, small_batches, texts_of

PROFILE_SIZE = 400
UNKNOWN = "und"
#: Letters handled at once, so that a very long text needs no more memory.
STEP = 1 << 20
#: N-grams one task holds before it hands its counts on.
HELD_GRAMS = 1_000_000
_BOUNDARY = 1
_BITS = 21


def remainder_of_id(doc_id: Column, divisor: int) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % divisor


def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    memo = process_memo("letters")
    if "table" not in memo:
        memo["table"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return memo["table"]


def marked_letters(text: str) -> np.ndarray:
    """Code points of the lower-case letters, each run of other characters as one boundary, one at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(_letters()[codes], codes, np.uint32(_BOUNDARY))
    codes = np.concatenate([[_BOUNDARY], codes, [_BOUNDARY]]).astype(np.uint32)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != _BOUNDARY) | (codes[:-1] != _BOUNDARY)
    return codes[keep]


def _packed(codes: np.ndarray, own: int) -> np.ndarray:
    """N-grams that start in the first ``own`` places, as integers; none spans two words."""
    c = codes.astype(np.int64)
    one = c[:own]
    pairs = (c[:-1] << _BITS | c[1:])[:own]
    if len(c) < 3:
        return np.concatenate([one[one != _BOUNDARY], pairs])
    triples = (c[:-2] << 2 * _BITS | c[1:-1] << _BITS | c[2:])[c[1:-1] != _BOUNDARY] if own >= len(c) else (c[:-2] << 2 * _BITS | c[1:-1] << _BITS | c[2:])[:own][(c[1:-1] != _BOUNDARY)[:own]]
    return np.concatenate([one[one != _BOUNDARY], pairs, triples])


def _merged(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, where = np.unique(grams, return_inverse=True)
    return values, np.bincount(where, counts, len(values)).astype(np.int64)


def gram_counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of marked letters and how often each occurs."""
    if len(codes) <= STEP:
        return np.unique(_packed(codes, len(codes)), return_counts=True)
    parts = [np.unique(_packed(codes[at : at + STEP + 2], STEP), return_counts=True) for at in range(0, len(codes), STEP)]
    return _merged(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def _places(counts: np.ndarray) -> np.ndarray:
    """Places from 0 of descending counts; equal counts share the mean of theirs."""
    starts = np.flatnonzero(np.r_[True, counts[1:] != counts[:-1]])
    ends = np.r_[starts[1:], len(counts)]
    return np.repeat((starts + ends - 1) / 2, ends - starts)


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``size`` most frequent n-grams (equal counts by n-gram) and their places."""
    order = np.lexsort((grams, -counts))[:size]
    return grams[order], _places(counts[order])


def language_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (grams, counts) in held.items():
                for at in range(0, len(grams), 65536):
                    part = grams[at : at + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part), pa.array(counts[at : at + 65536])], names=["lang", "gram", "n"])
            held.clear()

        for batch in small_batches(batches, limit=1 << 20):
            by_lang: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(texts_of(batch), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(marked_letters(text.decode("utf-8", "replace")))
            for lang, lists in by_lang.items():
                # Two boundaries meet between documents; that pair is no n-gram of a document.
                grams, counts = gram_counts(np.concatenate(lists))
                real = grams != (_BOUNDARY << _BITS | _BOUNDARY)
                grams, counts = grams[real], counts[real]
                if lang in held:
                    grams, counts = _merged(np.concatenate([held[lang][0], grams]), np.concatenate([held[lang][1], counts]))
                held[lang] = (grams, counts)
            if sum(len(g) for g, _ in held.values()) > HELD_GRAMS:
                yield from out()
        yield from out()

    counted = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(count, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn_profiles(docs: DataFrame, size: int = PROFILE_SIZE) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Language to (n-grams, places) from rows of (text, lang)."""
    counts = language_counts(docs.filter("lang is not null and text is not null"))
    top = counts.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("at") <= size)
    found: dict[str, list[tuple[int, int]]] = {}
    for r in top.select("lang", "gram", "n").collect():  # languages x size rows
        found.setdefault(r.lang, []).append((r.gram, r.n))
    return {lang: ranked(*np.array(rows, np.int64).T, size) for lang, rows in sorted(found.items())}


def predict_languages(docs: DataFrame, profiles: dict[str, tuple[np.ndarray, np.ndarray]], size: int = PROFILE_SIZE) -> DataFrame:
    """doc_id, held columns, lang_pred and score (1 - distance / worst distance) of rows (doc_id, ..., text); text comes last."""
    langs = list(profiles)
    grams = np.unique(np.concatenate([g for g, _ in profiles.values()])) if langs else np.empty(0, np.int64)
    places = np.full((len(grams) + 1, len(langs)), float(size))
    for k, (g, p) in enumerate(profiles.values()):
        places[np.searchsorted(grams, g), k] = p
    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def nearest(text: bytes) -> tuple[str, float]:
        codes = marked_letters(text.decode("utf-8", "replace"))
        if not langs or len(codes) < 3:
            return UNKNOWN, 0.0
        own, at = ranked(*gram_counts(codes), size)
        where = np.searchsorted(grams, own)
        where[(where == len(grams)) | (grams[np.minimum(where, len(grams) - 1)] != own)] = len(grams)
        apart = np.minimum(np.abs(places[where] - at[:, None]), size)
        apart[where == len(grams)] = size
        apart[places[where] == size] = size
        total = apart.sum(axis=0)
        best = int(total.argmin())
        return langs[best], float(1 - total[best] / (size * len(own)))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [nearest(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(kept))), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=schema.names,
            )

    return docs.select(*(f.name for f in kept), F.col("text").cast("string").alias("text")).mapInArrow(predict, schema)


def identify(docs: DataFrame, size: int = PROFILE_SIZE, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the documents that aren't held out."""
    rest = remainder_of_id(F.col("doc_id"), folds)
    profiles = learn_profiles(docs.filter(rest != held), size)
    return predict_languages(docs.select("doc_id", (rest == held).alias("held_out"), "text"), profiles, size)


def drop_unidentified(docs: DataFrame, size: int = PROFILE_SIZE, folds: int = 4, held: int = 2) -> DataFrame:
    """The documents whose language could be told; texts without a letter go.

    A null ``lang`` takes the language that was told; all other values stay as they were.
    """
    profiles = learn_profiles(docs.filter(remainder_of_id(F.col("doc_id"), folds) != held), size)
    fields, packed = docs.columns, F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    told = predict_languages(docs.select(packed.alias("row"), F.col("text")), profiles, size)
    return told.filter(F.col("lang_pred") != UNKNOWN).select(
        *((F.coalesce(F.col("row")[c], "lang_pred") if c == "lang" and docs.schema[c].dataType == T.StringType() else F.col("row")[c]).alias(c) for c in fields)
    )
