"""Scores of whole documents by a gated recurrent language model.

1. Words of the learning documents are counted (all of them, summed in tasks first).
2. The ``vocabulary`` most frequent words, the end and one symbol for all rarer words are
   the symbols of the model; a rarer word costs its symbol and its smoothed share of the
   rarer words, so the probabilities of a text add up over all words.
3. A gated recurrent unit is trained in numpy by backpropagation truncated to windows;
   the output is factored: the class of a symbol (by frequency), then the symbol in its
   class. It starts from the counted frequencies. All learning documents
   are dealt to workers of about ``worker_tokens`` tokens; each trains its own copy, and
   the copies are averaged by their tokens, block by block in Spark. So what is counted
   and trained on grows with the input.
4. Scoring runs over every whole text: documents lie one after the other in lanes, and
   the state is carried from window to window until a document ends.

Counts of the ``table`` most frequent words travel to the tasks; the other words of a
document (with how often they occur) meet their counts in a join.

Defined cases: null and empty texts are one end token; a null doc_id counts as the empty
text in ``held_out``; without learning documents every symbol is equally likely; equal
rows are scored each for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.common import small_batches, stash, words_in
from tidegrid.llm.language import remainder_of_id

VOCABULARY = 4094
TABLE = 200_000
UNITS = 32
WINDOW = 24
#: Steps laid out at once, a multiple of the window.
STRETCH = 32 * WINDOW
TRAIN_LANES, SCORE_LANES = 128, 256
#: Of the learning documents one in so many (by a hash of doc_id) trains the network: all of them.
TRAIN_ONE_IN = 1
WORKER_TOKENS = 4_000_000
#: Tokens of a group (up to half as many more are held). Lanes are filled from them, so many more than the longest text times the
#: lanes keep windows full: a window of few lanes costs nearly as much as a full one.
GROUP_TOKENS = 4_000_000
#: Weights that one step of the optimiser touches at once (they stay in the cache).
STEP_BLOCK = 16384
#: Rows of a product: blocks of few rows are multiplied without being copied first.
ROWS = 256
#: Of words that are counted at once.
HELD_BYTES = 32 << 20
BLOCK = 8192
END, RARE = 0, 1


def word_counts(docs: DataFrame) -> DataFrame:
    """word (UTF-8 bytes) and n over all rows of (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []

        def out() -> Iterator[pa.RecordBatch]:
            found = pc.value_counts(pa.chunked_array(held, pa.binary()))
            held.clear()
            batch = pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])
            for at in range(0, len(batch), 65536):
                yield batch.slice(at, 65536)

        for batch in small_batches(batches):
            held.append(words_in(batch)[0])
            if sum(x.nbytes for x in held) > HELD_BYTES:
                yield from out()
        yield from out()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, table: int, least: int) -> list:
    """Rows (word, n), most frequent first: at most ``table`` of them, at least ``least`` if there are so many.

    Counts are grouped by their leading eleven bits (a few thousand groups at any size); the
    least count with room in the table is the filter, so only the table leaves the tasks.
    """
    step = F.expr("shiftleft(1L, greatest(length(bin(n)) - 11, 0))")
    groups = counts.groupBy((F.floor(F.col("n") / step) * step).alias("from")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("from")).collect()
    held, cut = 0, None
    for g in groups:
        if held + g.words > table:
            break
        held, cut = held + g.words, g["from"]
    top = counts.filter(F.col("n") >= cut).collect() if cut is not None else []
    if len(top) < least:  # more words than the table holds are equally frequent
        top = counts.orderBy(F.desc("n"), "word").limit(least).collect()
    return sorted(top, key=lambda r: (-r.n, bytes(r.word)))


def classes_of(symbols: int) -> tuple[int, int]:
    """Number of output classes and symbols in each."""
    size = math.isqrt(max(symbols - 1, 0)) + 1
    return -(-symbols // size), size


def first_weights(counts: np.ndarray, units: int = UNITS, seed: int = 3) -> dict[str, np.ndarray]:
    """Weights whose output is the smoothed frequency of each symbol (``counts``)."""
    n, size = classes_of(len(counts))
    rng = np.random.default_rng(seed)
    share = np.full(n * size, 1e-30)
    share[: len(counts)] = (counts + 1) / (counts.sum() + len(counts))
    share = share.reshape(n, size)
    return {
        "gates": rng.normal(0, 0.3, (len(counts), 3 * units)).astype(np.float32),
        "turn": rng.normal(0, 1 / math.sqrt(units), (units, 2 * units)).astype(np.float32),
        "fresh": rng.normal(0, 1 / math.sqrt(units), (units, units)).astype(np.float32),
        "class_w": np.zeros((units, n), np.float32), "class_b": np.log(share.sum(axis=1)).astype(np.float32),
        "word_w": np.zeros((n, units, size), np.float32), "word_b": np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Of ``x``, in place."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def run_window(w: dict[str, np.ndarray], inputs: np.ndarray, starts: np.ndarray, state: np.ndarray, learning: bool = True) -> tuple[np.ndarray, tuple]:
    """States after every step of (time, lane) inputs, and with ``learning`` what the way back needs.

    The gates lie apart, as (gate, lane, unit), so that every pass runs over whole blocks.
    """
    units, (steps, lanes) = state.shape[1], inputs.shape
    rows, places = w["gates"].reshape(-1, units), inputs[:, None, :] * 3 + np.arange(3)[:, None]
    kind, rooms = np.result_type(state, rows), steps if learning else 1
    states, given = np.empty((steps, lanes, units), kind), np.empty((3, lanes, units), rows.dtype)
    before, taken, new = (np.empty((rooms, lanes, units), kind) for _ in range(3))
    gates = np.empty((rooms, 2, lanes, units), kind)
    turn = np.ascontiguousarray(w["turn"].reshape(units, 2, units).swapaxes(0, 1))
    begun, any_begun = (~starts).astype(kind)[:, :, None], starts.any(axis=1)
    for t in range(steps):
        at = t % rooms
        rows.take(places[t], axis=0, out=given, mode="clip")
        if any_begun[t]:
            np.multiply(state, begun[t], out=before[at])
        else:
            before[at] = state
        state = before[at]
        both = np.matmul(state, turn, out=gates[at])
        both += given[:2]
        _sigmoid(both)
        made = np.matmul(np.multiply(both[1], state, out=taken[at]), w["fresh"], out=new[at])
        made += given[2]
        np.tanh(made, out=made)
        state = np.subtract(state, made, out=states[t])
        state *= both[0]
        state += made
    return states, (before, taken, gates, new)


def _moderate(w: dict[str, np.ndarray]) -> bool:
    """Whether no output can leave the range of the exponential, as states lie between -1 and 1."""
    for name in ("class", "word"):
        reach = np.abs(w[f"{name}_w"]).sum(axis=-2)
        bias = w[f"{name}_b"]
        if (bias + reach).max() > 60 or (bias - reach).max(axis=-1).min() < -60:
            return False
    return True


def _picked(x: np.ndarray, place: np.ndarray, slope: bool, moderate: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-softmax of each row at its place (``x`` is used up), and with ``slope`` the slope of its negative mean."""
    flat, at = x.reshape(-1), np.arange(0, x.size, x.shape[1]) + place
    if not moderate:
        x -= x.max(axis=1, keepdims=True)
    chosen = flat.take(at)
    np.exp(x, out=x)
    total = (x @ np.ones((x.shape[1], 1), x.dtype))[:, 0]
    found = chosen - np.log(total)
    if not slope:
        return found, None
    flat[at] -= total
    total *= len(x)
    x *= np.reciprocal(total, out=total)[:, None]
    return found, x


def _place(grads: dict[str, np.ndarray], name: str, like: np.ndarray) -> np.ndarray:
    """The array for the slopes of a weight: zeros, those of the caller if it brings them."""
    if name not in grads:
        grads[name] = np.zeros_like(like)
    return grads[name]


def log_probabilities(
    w: dict[str, np.ndarray], states: np.ndarray, targets: np.ndarray, grads: dict[str, np.ndarray] | None = None, moderate: bool | None = None
) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log-probability of each target; with ``grads`` (arrays of zeros, or empty) also the slope of their negative mean.

    ``moderate`` is what ``_moderate`` says of the weights, for callers that know it.
    """
    (n, units, size), learning = w["word_w"].shape, grads is not None
    moderate = _moderate(w) if moderate is None else moderate
    # Targets of one class lie together, so each class is one product over a slice.
    group = (targets // size).astype(np.uint16 if n <= 65536 else np.int64)
    order = np.argsort(group, kind="stable")
    group = group[order]
    place = targets[order] - group.astype(np.int64) * size
    # A last column of ones meets the bias as a last row of the weights.
    given = np.ones((len(states), units + 1), states.dtype)
    given[:, :units] = states.take(order, axis=0)
    of_class = np.concatenate([w["class_w"], w["class_b"][None]])
    of_word = np.concatenate([w["word_w"], w["word_b"][:, None]], axis=1)
    # Products of few rows at a time, which is faster than one over all rows.
    scores = np.empty((len(states), of_class.shape[1]), np.result_type(given, of_class))
    blocks = [slice(a, a + ROWS) for a in range(0, len(states), ROWS)]
    for b in blocks:
        np.matmul(given[b], of_class, out=scores[b])
    found, slope = _picked(scores, group, learning, moderate)
    found, back = found.astype(np.float64), None
    if learning:
        slopes, room = np.zeros_like(of_class), np.empty_like(of_class)
        back, toward = np.empty((len(states), units), scores.dtype), w["class_w"].T
        for b in blocks:
            slopes += np.matmul(given[b].T, slope[b], out=room)
            np.matmul(slope[b], toward, out=back[b])
        _place(grads, "class_w", w["class_w"])[...] = slopes[:units]
        _place(grads, "class_b", w["class_b"])[...] = slopes[units]
    edges = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)] if len(group) else [0]
    slices = [(c, slice(at, min(at + ROWS, b))) for c, a, b in zip(group[edges[:-1]].tolist(), edges[:-1], edges[1:]) for at in range(a, b, ROWS)]
    scores = np.empty((len(states), size), scores.dtype)
    for c, b in slices:
        np.dot(given[b], of_word[c], out=scores[b])
    inside, slope = _picked(scores, place, learning, moderate)
    found += inside
    if learning:
        slopes, toward = np.zeros_like(of_word), w["word_w"].swapaxes(1, 2)
        room, part, last = np.empty_like(back), np.empty_like(slopes[0]), -1
        for c, b in slices:
            if c == last:
                slopes[c] += np.dot(given[b].T, slope[b], out=part)
            else:
                np.dot(given[b].T, slope[b], out=slopes[c])
            np.dot(slope[b], toward[c], out=room[b])
            last = c
        back += room
        _place(grads, "word_w", w["word_w"])[...] = slopes[:, :units]
        _place(grads, "word_b", w["word_b"])[...] = slopes[:, units]
    unsorted = np.empty_like(found)
    unsorted[order] = found
    if learning:
        room[order] = back
        back = room
    return unsorted, back


def _sums(rows: np.ndarray, keys: np.ndarray, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the sum of the rows of each. Most keys have one row or a few, which need no call of their own.

    With ``places`` the row of a key consists of the rows at its places.
    """
    # Short keys are sorted by their digits.
    keys = keys.astype(np.uint16) if keys.max(initial=0) < 65536 else keys
    order = np.argsort(keys, kind="stable")
    in_order = keys[order]
    firsts = np.concatenate([[0], np.flatnonzero(in_order[1:] != in_order[:-1]) + 1])
    sizes = np.diff(firsts, append=len(order))
    rows = rows.take(order if places is None else places.take(order, axis=0), axis=0).reshape(len(order), -1)
    sums = rows.take(firsts, axis=0)
    few = np.flatnonzero((sizes > 1) & (sizes <= 4))
    for k in (1, 2, 3):
        here = few[sizes[few] > k]
        sums[here] += rows.take(firsts[here] + k, axis=0)
    many = np.flatnonzero(sizes > 4)
    ones = np.ones((1, int(sizes.max())), rows.dtype)
    for i, a, n in zip(many.tolist(), firsts[many].tolist(), sizes[many].tolist()):
        np.matmul(ones[:, :n], rows[a : a + n], out=sums[i : i + 1])
    return in_order[firsts].astype(np.int64), sums


def _through_time(
    w: dict[str, np.ndarray], inputs: np.ndarray, starts: np.ndarray, kept: tuple, back: np.ndarray, grads: dict[str, np.ndarray], whole: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the recurrent weights from those of the states, back to the window's first step.

    Returns the symbols of the window and the slopes of their gates (the others have none);
    with ``whole`` these are among the slopes of ``grads`` too.
    """
    steps, lanes, units = back.shape
    before, taken, gates, new = kept
    begun, any_begun = (~starts).astype(back.dtype)[:, :, None], starts.any(axis=1)
    given = np.empty((steps, 3, lanes, units), back.dtype)
    carried, kept_part, room = (np.zeros((lanes, units), back.dtype) for _ in range(3))
    both = np.empty((2, lanes, units), back.dtype)
    turn, fresh = np.ascontiguousarray(w["turn"].T).reshape(2, units, units), w["fresh"].T.copy()
    to_turn, to_fresh, part = np.zeros_like(turn), np.zeros_like(fresh), np.empty_like(turn)
    for t in range(steps - 1, -1, -1):
        (keep, reset), (of_keep, of_reset, of_new) = gates[t], given[t]
        carried += back[t]
        np.multiply(carried, keep, out=kept_part)
        # (1 - new^2) (1 - keep) carried
        np.subtract(carried, kept_part, out=carried)
        np.multiply(new[t], new[t], out=room)
        room *= carried
        np.subtract(carried, room, out=of_new)
        # (before - new) keep (1 - keep) carried
        np.multiply(kept_part, keep, out=room)
        np.subtract(kept_part, room, out=room)
        np.subtract(before[t], new[t], out=of_keep)
        of_keep *= room
        through = of_new @ fresh
        # before reset (1 - reset) through
        through *= reset
        np.multiply(through, reset, out=room)
        np.subtract(through, room, out=room)
        np.multiply(room, before[t], out=of_reset)
        np.matmul(given[t, :2], turn, out=both)
        to_turn += np.matmul(before[t].T, given[t, :2], out=part)
        to_fresh += np.dot(taken[t].T, of_new, out=part[0])
        np.add(kept_part, through, out=carried)
        carried += both[0]
        carried += both[1]
        if any_begun[t]:
            carried *= begun[t]
    _place(grads, "turn", w["turn"]).reshape(units, 2, units)[...] = to_turn.swapaxes(0, 1)
    _place(grads, "fresh", w["fresh"])[...] = to_fresh
    places = (np.arange(steps)[:, None] * 3 * lanes + np.arange(lanes)).reshape(-1, 1) + np.arange(3) * lanes
    symbols, sums = _sums(given.reshape(-1, units), inputs.ravel(), places)
    if whole:
        _place(grads, "gates", w["gates"])[symbols] = sums
    return symbols, sums


def lanes_of(docs: list[np.ndarray], lanes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Windows (inputs, targets, starts, document of each place or -1) with documents one after the other in lanes.

    Lanes are in order of falling length, and a window holds the first of them only, those
    that go on; so the state of a window is a prefix of the state before.
    """
    heap = [(0, k, []) for k in range(min(lanes, len(docs)))]
    for i in sorted(range(len(docs)), key=lambda i: (-len(docs[i]), i)):
        size, k, own = heap[0]
        own.append(i)
        heapq.heapreplace(heap, (size + len(docs[i]), k, own))
    heap.sort(key=lambda x: (-x[0], x[1]))
    sizes = np.array([h[0] for h in heap])
    targets = [np.concatenate([docs[i] for i in own]).astype(np.int32) for _, _, own in heap]
    owners = [np.repeat(np.array(own, np.int32), [len(docs[i]) for i in own]) for _, _, own in heap]
    for at in range(0, int(sizes.max(initial=0)), STRETCH):
        wide = int((sizes > at).sum())
        steps = int(min(STRETCH, sizes[0] - at))
        inp, tgt, own = np.zeros((steps, wide), np.int64), np.zeros((steps, wide), np.int64), np.full((steps, wide), -1, np.int64)
        for k in range(wide):
            part = targets[k][at : at + steps]
            tgt[: len(part), k], own[: len(part), k] = part, owners[k][at : at + steps]
            before = targets[k][max(at - 1, 0) : at - 1 + len(part)]
            inp[len(part) - len(before) : len(part), k] = before
        for a in range(0, steps, WINDOW):
            here = slice(a, a + WINDOW), slice(0, int((sizes > at + a).sum()))
            window = [np.ascontiguousarray(x[here]) for x in (inp, tgt, own)]
            # The end symbol comes before the first word of a document, and only there.
            yield window[0], window[1], window[0] == END, window[2]


def _laid_out(like: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """One flat array of zeros and its parts by the names and shapes of ``like``."""
    flat, parts, at = np.zeros(sum(v.size for v in like.values()), np.float32), {}, 0
    for k, v in like.items():
        parts[k] = flat[at : at + v.size].reshape(v.shape)
        at += v.size
    return flat, parts


def train(w: dict[str, np.ndarray], docs: list[np.ndarray], step: float = 0.01) -> dict[str, np.ndarray]:
    """One pass of truncated backpropagation with adaptive moments over the documents."""
    flat, own_w = _laid_out(w)
    for k, v in w.items():
        own_w[k][...] = v
    w = own_w
    slopes, grads = _laid_out(w)
    # The gates lie first; their moments are rows of (mean, square) by symbol.
    gates, split = w["gates"], w["gates"].size
    dense, rest = slopes[split:], flat[split:]
    # The moments lack their factors 0.1 and 0.01, which cancel but for the small constant. Their decay is
    # left to the factors of a step: a mean times ``decay``, a root times ``decay_root`` is the true one.
    mean, square = np.zeros_like(dense), np.zeros_like(dense)
    moments = np.zeros((len(gates), 2 * gates.shape[1]), np.float32)
    decay = decay_root = 1.0
    # Symbols outside a window have slopes of zero, so their moments stay and only the factors of the steps differ.
    # Those are summed (plain, and times the small constant) and made good when the symbol comes next.
    owed, done = np.zeros(2), np.zeros((len(gates), 2))
    room = np.empty(STEP_BLOCK, np.float32)

    def caught_up(symbols: np.ndarray) -> np.ndarray:
        """The moments of the symbols, whose gates have taken all steps so far."""
        own = moments.take(symbols, axis=0)
        rates, least = (owed - done[symbols]).T
        least = np.divide(least, rates, out=np.ones_like(rates), where=rates > 0)
        move = np.sqrt(own[:, gates.shape[1] :])
        move += least.astype(np.float32)[:, None]
        np.divide(own[:, : gates.shape[1]], move, out=move)
        move *= rates.astype(np.float32)[:, None]
        gates[symbols] = np.subtract(gates.take(symbols, axis=0), move, out=move)
        done[symbols] = owed
        return own

    state, turn, moderate = np.zeros((min(TRAIN_LANES, len(docs)), w["fresh"].shape[0]), np.float32), 0, False
    for inp, tgt, starts, own in lanes_of(docs, TRAIN_LANES):
        # A step moves a weight by less than 0.025, sixteen steps an output by less than 14 of the 28 in reserve.
        if turn % 16 == 0:
            moderate = _moderate(w)
        read = np.zeros(len(gates), bool)
        read[inp] = True
        own_moments = caught_up(np.flatnonzero(read))
        states, kept = run_window(w, inp, starts, state[: inp.shape[1]])
        real = own >= 0
        if real.all():
            _, back = log_probabilities(w, states.reshape(-1, states.shape[2]), tgt.ravel(), grads, moderate)
            back = back.reshape(states.shape)
        else:
            back = np.zeros_like(states)
            _, back[real] = log_probabilities(w, states[real], tgt[real], grads, moderate)
        symbols, sums = _through_time(w, inp, starts, kept, back, grads, whole=False)
        norm = math.sqrt(float(dense @ dense) + float(np.vdot(sums, sums)))
        turn += 1
        decay, decay_root = decay * 0.9, decay_root * math.sqrt(0.99)
        clip = 1 / (norm + 1e-9) if norm > 1 else 1.0
        to_mean, to_square = np.float32(clip / decay), np.float32((clip / decay_root) ** 2)
        rate, least = step * math.sqrt(1 - 0.99**turn) / (1 - 0.9**turn) * decay / decay_root, 1e-5 / decay_root
        own_moments[:, : sums.shape[1]] += sums * to_mean
        np.square(sums, out=sums)
        sums *= to_square
        own_moments[:, sums.shape[1] :] += sums
        moments[symbols] = own_moments
        owed += rate, rate * least
        for at in range(0, len(dense), STEP_BLOCK):
            part = slice(at, min(at + STEP_BLOCK, len(dense)))
            g, m, q, r = dense[part], mean[part], square[part], room[: part.stop - at]
            m += np.multiply(g, to_mean, out=r)
            np.square(g, out=r)
            r *= to_square
            q += r
            np.sqrt(q, out=r)
            r += np.float32(least)
            np.divide(m, r, out=r)
            r *= np.float32(rate)
            rest[part] -= r
        if turn % 64 == 0:  # before the factors leave the range of the numbers
            caught_up(np.arange(len(gates)))
            for x, factor in ((mean, decay), (square, decay_root**2), (moments[:, : gates.shape[1]], decay), (moments[:, gates.shape[1] :], decay_root**2)):
                x *= np.float32(factor)
            owed[:], done[:], decay, decay_root = 0, 0, 1.0, 1.0
        state = states[-1]
    caught_up(np.arange(len(gates)))
    return w


def score(w: dict[str, np.ndarray], docs: list[np.ndarray]) -> np.ndarray:
    """Natural log-probability of each symbol list."""
    total = np.zeros(len(docs))
    state, moderate = np.zeros((min(SCORE_LANES, len(docs)), w["fresh"].shape[0]), np.float32), _moderate(w)
    for inp, tgt, starts, own in lanes_of(docs, SCORE_LANES):
        states, _ = run_window(w, inp, starts, state[: inp.shape[1]], learning=False)
        real = own >= 0
        found, _ = log_probabilities(w, states[real], tgt[real], moderate=moderate)
        total += np.bincount(own[real], found, len(docs))
        state = states[-1]
    return total


def packed_weights(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def unpacked_weights(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _places(words: pa.Array, table: pa.Array) -> np.ndarray:
    """Table place of each word, -1 for the others."""
    return pc.fill_null(pc.index_in(words, value_set=table), -1).to_numpy()


def _symbols(places: np.ndarray, counts: np.ndarray, vocabulary: int) -> list[np.ndarray]:
    """Symbols of the table places of each text (it has so many ``counts``), then the end."""
    ends = np.cumsum(counts + 1) - 1
    out = np.empty(len(places) + len(counts), np.int32)
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word] = np.where((places < 0) | (places >= vocabulary), RARE, places + 2)
    out[ends] = END
    return np.split(out, ends[:-1] + 1)


def _full(sizes: list[int]) -> int:
    """How many of the batches of so many tokens make a group by now; none until half of the next group is held too.

    So what is left at the end of a task is no small group, whose few lanes would cost nearly as much as a full one's.
    """
    if sum(sizes) <= GROUP_TOKENS * 3 // 2:
        return 0
    return int(np.searchsorted(np.cumsum(sizes), GROUP_TOKENS)) + 1


def _averaged(copies: DataFrame, workers: int) -> np.ndarray:
    """Average of the copies by their tokens, in two steps so that no group holds all workers."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(len(table["values"][0].as_py()))
        for batch in table.to_batches():
            for v in batch.column(batch.schema.get_field_index("values")):
                total += v.values.to_numpy()
        tokens = sum(table["tokens"].to_pylist())
        return pa.table({"block": table["block"][:1], "part": table["part"][:1], "tokens": pa.array([tokens], pa.int64()), "values": pa.array([total], pa.list_(pa.float64()))})

    schema = "block int, part int, tokens long, values array<double>"
    parts = copies.withColumn("part", F.pmod("part", F.lit(max(1, math.isqrt(workers))))).groupBy("block", "part").applyInArrow(add, schema)
    rows = sorted(parts.withColumn("part", F.lit(0)).groupBy("block", "part").applyInArrow(add, schema).collect(), key=lambda r: r.block)
    return np.concatenate([np.array(r["values"]) / max(r.tokens, 1) for r in rows]) if rows else np.empty(0)


class Model:
    """Counts of the most frequent words, totals of all words, and the network."""

    def __init__(self, words: list[bytes], counts: np.ndarray, tokens: int, ends: int, distinct: int, vocabulary: int):
        self.words, self.counts = words, counts
        self.vocabulary = min(vocabulary, len(words))
        self.train_tokens = tokens + ends
        self.distinct = distinct + (ends > 0)
        rare = tokens - int(counts[: self.vocabulary].sum())
        self.rare_total = rare + distinct - self.vocabulary + 1
        self.base_total = self.train_tokens + self.distinct + 1
        self.ends = ends
        self.weights = first_weights(np.concatenate([[ends, rare], counts[: self.vocabulary]]).astype(float))


def learn(docs: DataFrame, vocabulary: int = VOCABULARY, table: int = TABLE, one_in: int = TRAIN_ONE_IN, worker_tokens: int = WORKER_TOKENS) -> tuple[Model, DataFrame]:
    """The model, and the counts (word, n) of all words, from rows (doc_id, text)."""
    counts = stash(word_counts(docs), "word_counts")
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = most_frequent(counts, table, vocabulary)
    model = Model([bytes(r.word) for r in top], np.array([r.n for r in top], np.int64), tokens, docs.count(), distinct, vocabulary)

    own = docs.filter(F.pmod(F.xxhash64(F.lit(29), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(one_in)) == 0)
    workers = max(1, round(model.train_tokens / one_in / worker_tokens))
    shared = docs.sparkSession.sparkContext.broadcast((model.words[: model.vocabulary], model.weights))
    size = model.vocabulary

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, w = shared.value
        table = pa.array(words, pa.binary())
        lists, sizes, seen, number = [], [], 0, None

        def trained(w: dict[str, np.ndarray], n: int) -> dict[str, np.ndarray]:
            own = [x for batch in lists[:n] for x in batch]
            del lists[:n], sizes[:n]
            return train(w, own)

        for batch in small_batches(batches):
            found, counts = words_in(batch)
            lists.append(_symbols(_places(found, table), counts, size))
            sizes.append(len(found) + len(counts))
            seen += sizes[-1]
            if n := _full(sizes):
                w = trained(w, n)
        if lists:
            w = trained(w, len(lists))
        if seen:
            from pyspark import TaskContext

            number, flat = TaskContext.get().partitionId(), packed_weights(w).astype(float) * seen
            for at in range(0, len(flat), BLOCK):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at // BLOCK], pa.int32()), pa.array([number], pa.int32()), pa.array([seen], pa.int64()), pa.array([flat[at : at + BLOCK]], pa.list_(pa.float64()))],
                    names=["block", "part", "tokens", "values"],
                )

    copies = own.select(F.col("text").cast("string").alias("text")).repartition(workers).mapInArrow(work, "block int, part int, tokens long, values array<double>")
    flat = _averaged(stash(copies, "copies"), workers)
    if len(flat):
        model.weights = unpacked_weights(flat, model.weights)
    shared.destroy()
    return model, counts


def score_with(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, text) with the token counts and both scores."""
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.counts, model.weights))
    size = model.vocabulary
    rare_total, base_total, ends = model.rare_total, model.base_total, model.ends
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()), docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
            T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("model", T.DoubleType()),
            T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("times", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, times, w = shared.value
        table = pa.array(words, pa.binary())
        base_of = np.log10((times + 1) / base_total)
        rare_of = np.where(np.arange(len(times)) < size, 0.0, np.log10((times + 1) / rare_total))
        end_base = math.log10((ends + 1) / base_total)
        parts, lists, sizes = [], [], []

        def out(n: int) -> Iterator[pa.RecordBatch]:
            found, done = score(w, [x for batch in lists[:n] for x in batch]) / math.log(10), 0
            for columns in parts[:n]:
                columns[6] = pa.array(columns[6] + found[done : done + len(columns[6])])
                done += len(columns[6])
                batch = pa.RecordBatch.from_arrays(columns, names=schema.names)
                for at in range(0, len(batch), 1024):
                    yield batch.slice(at, 1024)
            del parts[:n], lists[:n], sizes[:n]

        for batch in small_batches(batches):
            tokens, counts = words_in(batch)
            places, owners = _places(tokens, table), np.repeat(np.arange(len(counts)), counts)
            lists.append(_symbols(places, counts, size))
            known, other = np.flatnonzero(places >= 0), np.flatnonzero(places < 0)
            of_known = owners[known], places[known]
            sums = [np.bincount(of_known[0], x[of_known[1]], len(counts)) for x in (base_of, rare_of)]
            # The other words of each text, and how often it has them.
            coded = tokens.take(pa.array(other)).dictionary_encode()
            words_of_batch = max(len(coded.dictionary), 1)
            pairs, often = np.unique(owners[other] * words_of_batch + coded.indices.to_numpy(), return_counts=True)
            starts = pa.array(np.searchsorted(pairs, np.arange(len(counts) + 1) * words_of_batch), pa.int32())
            parts.append(
                [
                    *batch.columns[:3], pa.array(counts + 1), pa.array(np.bincount(of_known[0], minlength=len(counts)) + (ends > 0)), pa.array(sums[0] + end_base), sums[1],
                    pa.ListArray.from_arrays(starts, coded.dictionary.take(pa.array(pairs % words_of_batch))), pa.ListArray.from_arrays(starts, pa.array(often, pa.int64())),
                ]
            )
            sizes.append(len(tokens) + len(counts))
            if n := _full(sizes):
                yield from out(n)
        if parts:
            yield from out(len(parts))

    given = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", F.col("text").cast("string").alias("text"))
    rows = stash(given.mapInArrow(run, schema), "scored")
    other = rows.filter(F.size("words") > 0).select("row", F.explode(F.arrays_zip("words", "times")).alias("z")).select("row", F.col("z.words").alias("word"), F.col("z.times").alias("times"))
    other = other.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    part = lambda total: F.sum(F.col("times") * F.log10((F.col("n") + 1) / F.lit(float(total))))
    other = other.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"), part(base_total).alias("base_more"), part(rare_total).alias("model_more"))
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0)))
    return rows.join(other, "row", "left").select(
        "doc_id", "held_out", "n_tokens", plus("known", "more").alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        plus("base", "base_more").alias("base_score"), plus("model", "model_more").alias("score"),
    )


def score_documents(docs: DataFrame, folds: int = 7, held: int = 2, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns from the documents that aren't held out."""
    rest = remainder_of_id(F.col("doc_id"), folds)
    model, counts = learn(docs.filter(rest != held).select("doc_id", "text"), **options)
    return score_with(docs.select("doc_id", (rest == held).alias("held_out"), "text"), model, counts)
