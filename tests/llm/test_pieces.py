"""Unigram files made by hand (nothing is trained) against the library, and bounds of the memos."""

import random
import struct

import numpy as np
import pytest
import sentencepiece

from tidegrid.llm import pieces
from tidegrid.llm.pieces import MARK, PieceModel, encode_and_decode
from tidegrid.llm.tokenizer_files import tokenizer_file


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(field, data):
    return varint(field << 3 | 2) + varint(len(data)) + data


def model_file(path, entries, with_bytes):
    """A model file: (piece, score) of unigram scores behind the usual special pieces."""
    table = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if with_bytes:
        table += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    table += [(p, s, 1) for p, s in entries]
    data = b""
    for piece, score, kind in table:
        data += message(1, message(1, piece.encode()) + varint(2 << 3 | 5) + struct.pack("<f", score) + varint(3 << 3) + varint(kind))
    trainer = varint(3 << 3) + varint(1) + varint(4 << 3) + varint(len(table))
    if with_bytes:
        trainer += varint(35 << 3) + varint(1)
    normal = message(1, b"identity") + varint(3 << 3) + varint(1) + varint(4 << 3) + varint(0) + varint(5 << 3) + varint(1)
    path.write_bytes(data + message(2, trainer) + message(3, normal))
    return str(path)


@pytest.mark.parametrize("with_bytes", [True, False])
def test_unigram_ids_equal_the_library(tmp_path, with_bytes):
    rng = random.Random(5)
    entries = {MARK: -3.0, **{c: -4.0 - rng.random() for c in "abcdefgh"}}
    while len(entries) < 300:
        piece = "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
        entries[piece if rng.random() < 0.5 else MARK + piece] = -2.0 - 6 * rng.random()
    path = model_file(tmp_path / "u.model", entries.items(), with_bytes)
    model, library = PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert model.by_score
    texts = ["", "a", " ", "  a  b", "ab" * 3000, "é", "aéb xyz abc", "zzz"]
    texts += [" ".join("".join(rng.choices("abcdefghz" if rng.random() < 0.2 else "abcdefgh", k=rng.randint(1, 14))) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    found = [np.frombuffer(x, np.uint32).tolist() for x in model.encode(texts)]
    want = library.encode(texts)
    # Equal sums (a+aa, aa+a) are told apart in the library by the rounding of its total over the whole text.
    assert [sorted(x) for x in found] == [sorted(x) for x in want]
    assert sum(a == b for a, b in zip(found, want)) > 0.98 * len(texts)
    if with_bytes:
        assert [model.decode(x) for x in found] == library.decode(found)


def test_other_kinds_of_files_are_refused(tmp_path):
    with pytest.raises(ValueError):
        PieceModel(model_file(tmp_path / "m.model", [(MARK, -1.0), (f"a{MARK}b", -1.0)], True))


def test_memos_stay_within_their_bounds(monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_BYTES", 20_000)
    monkeypatch.setattr(pieces, "MEMO_PAIRS", 50)
    path = tokenizer_file("piece_bpe_32k.model")
    model, library = PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    for _ in range(10):
        texts = [" ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 9))) for _ in range(40)) for _ in range(5)]
        assert [np.frombuffer(x, np.uint32).tolist() for x in model.encode(texts)] == library.encode(texts)
        assert model.held <= 20_000 and len(model.pairs) <= 50


def test_very_long_words_repeats_and_no_rows(spark):
    rows = [(1, "x" * 50_000, 1), (1, "x" * 50_000, 1), (2, "ab " * 30_000, 2), (None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_pieces int")
    path = tokenizer_file("piece_bpe_32k.model")
    got = encode_and_decode(docs, path).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    assert sorted(r["n_pieces"] for r in got) == sorted(len(library.encode(t or "")) for _, t, _ in rows)
    assert encode_and_decode(docs.limit(0), path).count() == 0
