"""Most likely state paths (Viterbi) over sequences cut into slices.

A slice's effect on the scores of states is a matrix under (max, +), and such matrices compose.
So: each slice's matrix, all slices at once; scores before each slice, carried along them; each
slice again, from its true scores, with the best path to each of its last states; and backwards
along slices, which of these paths is taken. Scores are whole numbers of 2 ** -20, so the
result does not depend on where slices are cut, ties included: the lower state wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .slices import BITS, sliced, walked

UNIT = 1 << 20
#: Score of what can't happen.
NEVER = -(1 << 44)
#: Numbers that one step works on at a time.
CELLS = 1 << 21


def units(x: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return np.where(np.isneginf(x), NEVER, np.rint(np.maximum(x, NEVER / UNIT) * UNIT)).astype(np.int64)


def viterbi(emit: np.ndarray, move: np.ndarray, start: np.ndarray) -> list[int]:
    """Most likely state path in log space over one sequence; the lower state on ties."""
    score, back = start + emit[0], []
    for row in emit[1:]:
        step = score[:, None] + move
        back.append(step.argmax(axis=0))
        score = step.max(axis=0) + row
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def emissions(states: list[str], log_probs: Column, anchors: dict[str, Column], reject: Column, unknown: str, weight: float = 1.0, bonus: float = 3.0, floor: float = -20.0) -> Column:
    """Log emissions of ``states`` (array) for a frame: ``weight`` times the classifier's log
    probabilities (an array in the order of ``states``) plus ``bonus`` for each anchor of the
    state that was seen. A rejected frame has ``floor`` for all but ``unknown``, which has one more."""
    seen = F.array(*[F.coalesce(anchors[s].cast("double"), F.lit(0.0)) if s in anchors and s != unknown else F.lit(0.0) for s in states])
    rejected = F.array(*[F.lit(floor + (s == unknown)) for s in states])
    return F.when(F.coalesce(reject, F.lit(False)), rejected).otherwise(F.transform(log_probs, lambda p, i: weight * p + bonus * F.get(seen, i)))


def class_log_probs(model, frames: DataFrame, states: list[str], least: float = 1e-12) -> DataFrame:
    """``frames`` with ``log_probs``: log probabilities of ``states`` by a fitted classifier; a state
    it has never seen gets that of ``least``."""
    at = {s: i for i, s in enumerate(model.stages[0].labels)}
    scored = model.transform(frames).withColumn("_p", vector_to_array("probability"))
    probs = F.array(*[F.log(F.greatest(F.get("_p", F.lit(at[s])), F.lit(least))) if s in at else F.lit(float(np.log(least))) for s in states])
    return scored.select(*frames.columns, probs.alias("log_probs"))


def _groups(lengths: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Slices, longest first, in groups of about ``CELLS`` numbers."""
    order, a = np.argsort(-lengths, kind="stable"), 0
    while a < len(order):
        n = max(1, CELLS // int(max(1, lengths[order[a]]) * width))
        yield order[a : a + n]
        a += n


def _stacked(emits: pa.ListArray, group: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """(slice, frame, state) of a group, padded with 0."""
    out = np.zeros((len(group), int(lengths[group[0]]), n), np.int64)
    edges, flat = emits.offsets.to_numpy(), emits.values.to_numpy()
    for k, i in enumerate(group.tolist()):
        out[k, : lengths[i]] = flat[edges[i] : edges[i + 1]].reshape(-1, n)
    return out


def _products(batches, move: np.ndarray):
    """Each slice's (max, +) matrix; its last row is for a sequence that begins here."""
    n = move.shape[1]
    for batch in batches:
        emits = batch.column(2)
        lengths = np.diff(emits.offsets.to_numpy()) // n
        out = np.zeros((len(lengths), n + 1, n), np.int64)
        for group in _groups(lengths, n * n * n):
            e, size = _stacked(emits, group, lengths, n), lengths[group]
            p = move[None] + e[:, 0, None, :]
            for t in range(1, e.shape[1]):
                live = int(np.searchsorted(-size, -t))  # slices longer than t come first
                p[:live] = (p[:live, :, :, None] + move[None, None, :n, :]).max(axis=2) + e[:live, t, None, :]
            out[group] = p
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * (n + 1) * n), pa.array(out.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["key", "slice", "product"])


def _paths(batches, move: np.ndarray):
    """From the scores before each slice: the state before it and the states within it on the best
    path to each last state, and the scores after it."""
    n = move.shape[1]
    for batch in batches:
        emits, entry = batch.column(3), batch.column(4)
        lengths = np.diff(emits.offsets.to_numpy()) // n
        begins = np.array([x is None for x in entry.to_pylist()])
        before = np.array([x or [0] * n for x in entry.to_pylist()], np.int64).reshape(-1, n)
        comes, ends, paths = np.zeros((len(lengths), n), np.int64), np.zeros((len(lengths), n), np.int64), [b""] * len(lengths)
        for group in _groups(lengths, 2 * n):
            e, size = _stacked(emits, group, lengths, n), lengths[group]
            back = np.zeros(e.shape, np.int8)
            step = before[group][:, :, None] + move[None, :n]
            score = np.where(begins[group][:, None], move[n], step.max(axis=1)) + e[:, 0]
            back[:, 0] = np.where(begins[group][:, None], -1, step.argmax(axis=1))
            for t in range(1, e.shape[1]):
                live = int(np.searchsorted(-size, -t))
                step = score[:live, :, None] + move[None, :n]
                back[:live, t] = step.argmax(axis=1)
                score[:live] = step.max(axis=1) + e[:live, t]
            state = np.tile(np.arange(n, dtype=np.int8), (len(group), 1))
            path = np.zeros((e.shape[1], len(group), n), np.int8)
            for t in range(e.shape[1] - 1, -1, -1):
                live = int(np.searchsorted(-size, -t))
                path[t, :live] = state[:live]
                state[:live] = np.take_along_axis(back[:live, t], state[:live].astype(np.int64), axis=1)
            comes[group], ends[group] = state, score
            for k, i in enumerate(group.tolist()):
                paths[i] = path[: lengths[i], k].tobytes()
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * n), pa.array(x.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(5), lists(comes), lists(ends), pa.array(paths, pa.binary())], ["key", "slice", "place", "tag", "comes", "ends", "paths"])


def best_paths(df: DataFrame, key: str, order: str, tag: str, emit: Column, move: np.ndarray, start: np.ndarray, states: list[str], bits: int = BITS) -> DataFrame:
    """key, order, tag and ``decoded`` of each row: the most likely states of each key's rows, by
    log emissions ``emit`` (array, one number for each state; null: all alike), transitions
    ``move`` and first states ``start`` (log, -inf for what can't happen)."""
    n = len(states)
    moves = np.concatenate([units(np.asarray(move)), units(np.asarray(start))[None]])
    even = F.array(*[F.lit(0.0)] * n)
    whole = F.transform(F.coalesce(emit, even), lambda x: F.when(x < NEVER / UNIT, F.lit(NEVER)).otherwise(F.rint(x * UNIT).cast("long")))
    slices = sliced(df, key, order, {"emit": whole, "tag": F.col(tag).cast("string")}, bits)
    flat = slices.withColumn("emit", F.flatten("emit"))
    kind = df.schema[key].dataType.simpleString()
    products = flat.select("key", "slice", "emit").mapInArrow(lambda b: _products(b, moves), f"key {kind}, slice long, product array<long>")

    def scores(state, product):
        matrix = np.array(product, np.int64).reshape(n + 1, n)
        after = matrix[n] if state is None else (state[:, None] + matrix[:n]).max(axis=0)
        return after - after.max(), (None if state is None else state.tolist(),)

    entries = walked(products, ["product"], scores, f"key {kind}, slice long, entry array<long>")
    joined = flat.join(entries.withColumnRenamed("key", "_key").withColumnRenamed("slice", "_slice"), F.col("key").eqNullSafe(F.col("_key")) & (F.col("slice") == F.col("_slice")))
    paths = joined.select("key", "slice", "place", "emit", "entry", "tag").mapInArrow(lambda b: _paths(b, moves), f"key {kind}, slice long, place array<long>, tag array<string>, comes array<long>, ends array<long>, paths binary")

    def choose(state, place, tag, comes, ends, path):
        last = int(np.argmax(ends)) if state is None else state
        return comes[last], (place, tag, (np.frombuffer(path, np.int8).reshape(-1, n)[:, last] + 1).tolist())

    chosen = walked(paths, ["place", "tag", "comes", "ends", "paths"], choose, f"key {kind}, slice long, place array<long>, tag array<string>, path array<int>", backwards=True)
    rows = chosen.select("key", F.explode(F.arrays_zip("place", "tag", "path")).alias("x"))
    names = F.array(*[F.lit(s) for s in states])
    return rows.select(F.col("key").alias(key), F.col("x.place").alias(order), F.col("x.tag").alias(tag), F.element_at(names, F.col("x.path")).alias("decoded"))


def decoded(df: DataFrame, key: str, order: str, state: str, states: list[str], stay: float, hit: float, bits: int = BITS) -> DataFrame:
    """Smoothed states: observed ones emit with chance ``hit``, states stay with ``stay``."""
    n = len(states)
    move = np.full((n, n), np.log((1 - stay) / (n - 1)))
    np.fill_diagonal(move, np.log(stay))
    miss, known = float(np.log((1 - hit) / (n - 1))), F.col(state).isin(states)
    emit = F.when(known, F.array(*[F.when(F.col(state) == s, float(np.log(hit))).otherwise(miss) for s in states]))
    rows = best_paths(df.withColumn("observed", F.col(state)), key, order, "observed", emit, move, np.full(n, -np.log(n)), states, bits)
    return rows.select(key, order, "observed", "decoded")
