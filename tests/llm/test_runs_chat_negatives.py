"""Periodic runs, chat formatting and hard negatives against brute force."""

import hashlib
import json
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import chat
from tidegrid.llm.negatives import RTree, labelled, mine_negatives, shifted_label, tiles
from tidegrid.llm.runs import find_runs, kept_words, repeated_tail, run_digest, runs_of, strongest


def brute_runs(w, exponent=3, least=24):
    out = {}
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i > s and i - s + p >= max(least, exponent * p):
                out.setdefault((s, i - s + p), p)
            i += 1
    return sorted(((s, n, p) for (s, n), p in out.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [1, 3, 7, 24])
def test_runs_equal_brute_force_over_many_texts_at_once(least):
    rng = random.Random(least)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 5)):
            w = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.choice([0, 1, 5, 40, 120]))]
            if w and rng.random() < 0.6:
                a = rng.randrange(len(w))
                p = 1 + rng.randrange((len(w) - a) // 3 + 1)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            texts.append(w * rng.choice([1, 1, 4]))
        found = runs_of([np.array(w, np.int64) for w in texts], 3, least)
        assert found == [brute_runs(w, 3, least) for w in texts]


def test_exponents_below_three_are_refused():
    with pytest.raises(ValueError):
        runs_of([np.zeros(9, np.int64)], 2, 4)


def test_strongest_and_kept_words():
    assert strongest([(0, 30, 10), (5, 60, 20), (9, 24, 8)]) == (0, 30, 10)  # equal exponents
    assert strongest([(0, 30, 10), (40, 31, 10)]) == (40, 31, 10)
    assert strongest([]) is None
    assert kept_words(6, [(1, 5, 2)]).tolist() == [True, True, True, False, False, False]


def test_many_distinct_neighbours_and_one_repeated_word_stay_cheap():
    line = np.arange(20)
    lines = np.concatenate([np.r_[line, 1000 + i] for i in range(3000)])  # each repeat has its own neighbours
    assert runs_of([lines, np.zeros(50_000, np.int64)], 3, 24) == [[], [(0, 50_000, 1)]]


def test_run_query_on_documents(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choices("a b c d e f".split(), k=rng.randint(0, 200)))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, " \n\t"), (103, "x " * 40_000), (104, "p q r\n" * 30 + "end"), (104, "p q r\n" * 30 + "end"), (None, "k " * 50)]
    texts += [(200 + i, " ".join(f"w{j}" for j in range(90))) for i in range(30)]  # some get a repeated tail
    rows = [(d, t, i, 2, "s") for i, (d, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs long, start int, collapsed string")
    got = run_digest(find_runs(docs, reorder=repeated_tail)).collect()
    want = []
    for doc_id, text in texts:
        w = (text or "").split()
        order = repeated_tail(doc_id, len(w))
        w = w if order is None else [w[i] for i in order]
        ids = [hash(x) for x in w]
        runs = [(0, len(w), 1)] if len(set(w)) == 1 and len(w) > 300 else brute_runs(ids)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        spelled = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        milli = 1000 * best[1] // best[2] if runs else None
        want.append((doc_id, len(runs), *best, milli, hashlib.sha256(spelled.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    order = lambda rows: sorted(map(tuple, rows), key=lambda r: (r[0] is None, r))
    assert order(got) == order(want)
    assert any(r[1] and 200 <= (r[0] or 0) < 230 for r in want)  # a repeated tail was found
    none = find_runs(docs.limit(0))
    assert none.count() == 0 and run_digest(none).count() == 0


def test_repeated_tail_follows_the_checksum():
    doc_id = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    g = zlib.crc32(str(doc_id).encode()) // 10
    n = 50
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    assert repeated_tail(doc_id, n).tolist() == [i if i < a else a + (i - a) % p for i in range(n)]
    assert repeated_tail(doc_id, 0) is None and repeated_tail(None, 5) is None


NASTY = ["", "\\", "\\\\", "</s>", "<s>[INST] x [/INST]", "[\\INST]", "[", "<", "a\n\\[/INST] [/INST] ", "é😀</s", "$1 $0 \\1", "<\\/s>", "[[INST]]"]


def test_every_text_is_read_back(spark):
    turns = [(i, j, r, t) for i, r in enumerate(["user", "assistant", "system", "[/INST] x", "", None]) for j, t in enumerate([*NASTY, None, "y" * 200_000])]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(chat.table_turns(df))
    for row in formatted.select("conv_id", "formatted", chat.TEMPLATE.parsed(F.col("formatted")).alias("turns"), "segments").collect():
        mine = [(r or "", t or "") for c, _, r, t in turns if c == row["conv_id"]]
        assert [(t["role"], t["text"]) for t in row["turns"]] == mine
        assert row["formatted"] == "".join(s["text"] for s in row["segments"])
        assert [s["loss"] for s in row["segments"]] == [x for r, _ in mine for x in (False, r == "assistant", False)]
        body = "".join(s["text"] for s in row["segments"][1::3])
        assert not any(c in body for c in chat.TEMPLATE.controls)


def test_layouts_are_told_by_their_fields(spark):
    records = [
        (1, {"messages": [{"role": "human", "content": "hi"}, {"role": "assistant", "content": "yo", "weight": 1}], "id": 3}),
        (2, {"instruction": "do", "input": None, "output": "ok"}), (3, {"instruction": "do", "input": "it", "output": "ok"}),
        (4, {"prompt": '{"messages": [1]}', "response": "</s>"}), (5, {"system": "be", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}),
        (6, {"turn": 1, "role": "user", "text": "b"}), (6, {"turn": 0, "role": "assistant", "text": "a"}),
        (7, {"system": "", "question": "q", "answer": "a"}), (8, {"something": "else"}), (9, {"messages": []}),
    ]
    texts = [(i, json.dumps(r), "x") for i, r in records] + [(10, "no json", None), (11, None, None), (None, json.dumps({"prompt": "p", "completion": "c"}), None)]
    df = spark.createDataFrame(texts, "conv_id long, record string, layout string")
    got = {r["conv_id"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in chat.record_turns(df).collect()}
    assert got == {
        1: ("messages", [("user", "hi"), ("assistant", "yo")]), 2: ("instruction_input_output", [("user", "do"), ("assistant", "ok")]),
        3: ("instruction_input_output", [("user", "do\n\nit"), ("assistant", "ok")]), 4: ("prompt_response", [("user", '{"messages": [1]}'), ("assistant", "</s>")]),
        5: ("system_and_speakers", [("system", "be"), ("user", "q"), ("assistant", "a")]), 6: ("turn_rows", [("assistant", "a"), ("user", "b")]),
        7: ("system_question_answer", [("user", "q"), ("assistant", "a")]), 8: (None, []), 9: (None, []), 10: (None, []), 11: (None, []),
        None: ("prompt_completion", [("user", "p"), ("assistant", "c")]),
    }
    fingerprints = [chat.fingerprint(x.paths()) for x in chat.LAYOUTS]
    assert len(set(fingerprints)) == len(fingerprints)


def test_typed_tables_use_their_schema(spark):
    df = spark.createDataFrame([(1, [("human", "q"), ("gpt", None)], 5), (2, None, 5)], "conv_id long, conversations array<struct<from: string, value: string>>, more int")
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.table_turns(df).collect()}
    assert got == {1: [("user", "q"), ("assistant", "")], 2: []}
    with pytest.raises(ValueError):
        chat.table_turns(spark.range(1).withColumnRenamed("id", "conv_id"))


def test_chat_query_with_ties_repeats_and_no_rows(spark):
    rows = [(1, 0, "user", "b", 1), (1, 0, "user", "a", 2), (1, None, "system", None, 3), (1, 0, "user", "a", 2), (None, 1, None, "z", 4), (2, 0, "assistant", "", 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    got = {r["conv_id"]: r for r in chat.format_table(df).collect()}
    said = "system\n\nuser\na\nuser\na\nuser\nb\n"
    assert got[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[1]["n_turns"] == 4
    assert got[None]["n_turns"] == 1 and got[2]["loss_sha256"] == hashlib.sha256(b"").hexdigest()
    probe = "</s>[INST] ok [/INST]"
    assert got[-1]["loss_chars"] == len(probe) and got[-1]["loss_sha256"] == hashlib.sha256(probe.encode()).hexdigest()
    assert [r["conv_id"] for r in chat.format_table(df.limit(0)).collect()] == [-1]


def test_tiles_hold_every_row_once():
    rng = np.random.default_rng(1)
    for n, dims, size in ((0, 2, 4), (1, 1, 4), (500, 2, 16), (333, 6, 10), (90, 1, 7)):
        points = rng.integers(-3, 3, (n, dims))
        parts = tiles(points, size)
        assert sorted(np.concatenate(parts).tolist() if parts else []) == list(range(n))
        assert all(len(p) <= size for p in parts)


def test_boxes_hold_their_rows():
    rng = np.random.default_rng(2)
    values, queries = rng.integers(-50, 50, (700, 5)).astype(float), rng.integers(-50, 50, (9, 5)).astype(float)
    tree = RTree(np.arange(700), np.zeros(700, int), values, leaf=16, fan=4)
    low, high = tree.bounds(queries)
    scores = queries @ values.T

    def under(node):
        return tree.children[node] if node < tree.leaves else np.concatenate([under(c) for c in tree.children[node]])

    for node in range(len(tree.children)):
        assert (scores[:, under(node)] >= low[:, node, None]).all() and (scores[:, under(node)] <= high[:, node, None]).all()
    assert len(under(len(tree.children) - 1)) == 700


def brute_negatives(rows, every, k, m, least, most):
    out = []
    for a, la, va in rows:
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(va, v)) for i, (b, _, v) in enumerate(rows) if b != a and len(v) == len(va)}
        near = sorted(((-s, rows[i][0]) for i, s in score.items() if rows[i][1] == la))[:k]
        for ps, p in near:
            far = sorted(((-s, rows[i][0]) for i, s in score.items() if rows[i][1] != la and -least * ps <= 100 * s <= -most * ps))[:m]
            out += [(a, p, rank, n, -ps, -ns) for rank, (ns, n) in enumerate(far, 1)]
    return sorted(out)


@pytest.mark.parametrize("slab_rows, anchor_rows", [(16_384, 16_384), (40, 5)])
def test_negatives_equal_brute_force(spark, slab_rows, anchor_rows):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 4)), [float(x) for x in rng.normal(0, 0.4, 6)]) for i in range(250)]
    rows += [(300 + i, 1, rows[0][2]) for i in range(60)]  # copies: ties
    rows += [(400, None, [0.1] * 6), (401, 1, None), (402, 1, [0.1, None] + [0.2] * 4), (410, 2, [float("nan")] * 6), (420, 2, [float("inf")] * 6), (430, 1, [0.5, 0.5]), (431, 2, [0.4, 0.4]), (432, 1, [0.6, 0.5]), (440, 3, [])]
    df = spark.createDataFrame([(i, v, n, 7, 1) for i, n, v in rows], "vec_id long, embedding array<float>, label int, rank int, row int")
    got = mine_negatives(labelled(df, 256), every=10, n_positives=3, n_negatives=4, slab_rows=slab_rows, anchor_rows=anchor_rows)
    whole = []
    for i, n, v in rows:
        if n is not None and v and all(x is not None and np.isfinite(x) for x in v):
            whole.append((i, n, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    assert sorted(map(tuple, got.collect())) == brute_negatives(whole, 10, 3, 4, 30, 90)


def test_negatives_of_no_rows_and_shifted_labels(spark):
    df = spark.createDataFrame([(7, [1.0], 9), (14, [1.0], None), (8, [1.0], 9)], "vec_id long, embedding array<float>, label int")
    assert [r[0] for r in df.select(shifted_label()).collect()] == [0, None, 9]
    assert mine_negatives(labelled(df.limit(0))).count() == 0
    assert mine_negatives(labelled(df)).count() == 0  # no anchors
