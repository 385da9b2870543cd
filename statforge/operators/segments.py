"""Segments of equal states in sequences cut into slices.

The rule is a machine with one state for no open segment and one for each (open state, outliers
since the last match). A slice maps each machine state before it to the one after it; these
maps compose, so the machine state before each slice is found by carrying it along, and all
slices then report their parts of segments at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .slices import BITS, sliced, walked


def segments_of(states: list[str | None], times: list[float], opening: int = 3, outliers: int = 1, shortest: float = 3.0, unknown: str = "unknown", opening_by: dict[str, int] | None = None, shortest_by: dict[str, float] | None = None, period: float = 1.0) -> list[tuple[str, int, int]]:
    """Segments as (state, first, last) of one sequence, frame by frame. ``opening`` equal frames
    ahead open one, never for ``unknown`` or null; up to ``outliers`` other frames in a row stay
    within; the next one closes it at its last match and may open another. The end is the time of
    the frame after the last match (or ``period`` later), and shorter ones than ``shortest`` go."""
    out, open_, n = [], None, len(states)

    def close():
        state, first, last, _ = open_
        end = times[last + 1] if last + 1 < n else times[last] + period
        if end - times[first] + 1e-6 >= (shortest_by or {}).get(state, shortest):
            out.append((state, first, last))

    def opened(i):
        s = states[i]
        if s is None or s == unknown:
            return None
        need = (opening_by or {}).get(s, opening)
        return (s, i, i, 0) if states[i : i + need] == [s] * need else None

    for i, s in enumerate(states):
        if open_ is None:
            open_ = opened(i)
        elif s == open_[0]:
            open_ = (*open_[:2], i, 0)
        elif open_[3] < outliers:
            open_ = (*open_[:3], open_[3] + 1)
        else:
            close()
            open_ = opened(i)
    if open_ is not None:
        close()
    return out


class RunMachine:
    """Machine state 0: nothing open; 1 + s * (outliers + 1) + k: state s open, k outliers."""

    def __init__(self, n: int, outliers: int):
        self.width = outliers + 1
        self.size = 1 + n * self.width
        self.next = np.zeros((self.size, 2 * n + 1), np.int64)  # input: 2 * state + opens, or 2 * n
        for m in range(self.size):
            for u in range(2 * n + 1):
                fresh = 1 + (u // 2) * self.width if u < 2 * n and u % 2 else 0
                if m == 0:
                    self.next[m, u] = fresh
                else:
                    s, k = divmod(m - 1, self.width)
                    self.next[m, u] = 1 + s * self.width if u < 2 * n and u // 2 == s else m + 1 if k < outliers else fresh

    def begins(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether a segment begins with the frame between two machine states."""
        own = lambda m: (m - 1) // self.width
        return (after > 0) & ((before == 0) | (own(before) != own(after)))

    def matches(self, after: np.ndarray) -> np.ndarray:
        return (after > 0) & ((after - 1) % self.width == 0)


def _inputs(codes: np.ndarray, ahead: np.ndarray, need: np.ndarray, n: int) -> np.ndarray:
    """Machine inputs of a slice's frames; ``ahead``: the codes of frames behind it."""
    line = np.concatenate([codes, ahead, [-1]])
    change = np.flatnonzero(np.diff(line) != 0)
    run = change[np.searchsorted(change, np.arange(len(codes)))] + 1 - np.arange(len(codes))
    known = codes < n
    return np.where(known, 2 * codes + (run >= need[np.minimum(codes, n - 1)]), 2 * n)


def hysteresis_segments(df: DataFrame, key: str, order: str, state: str, seconds: str, states: list[str], opening: int = 3, outliers: int = 1, shortest: float = 3.0, opening_by: dict[str, int] | None = None, shortest_by: dict[str, float] | None = None, period: float = 1.0, bits: int = BITS) -> DataFrame:
    """key, segment (from 0), state, first_s, last_s, end_s and frames of each key's segments by
    the rules of ``segments_of``; states that are not among ``states`` are unknown."""
    n, kind = len(states), df.schema[key].dataType.simpleString()
    need = np.array([(opening_by or {}).get(s, opening) for s in states])
    machine = RunMachine(n, outliers)
    code = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in states]), F.col(state)), F.lit(0)).cast("int")
    slices = sliced(df, key, order, {"code": F.when(code > 0, code - 1).otherwise(n), "seconds": F.col(seconds).cast("double")}, bits)
    reach = max(1, int(need.max()) - 1)
    behind = Window.partitionBy("key").orderBy("slice").rowsBetween(1, reach)
    heads = F.slice(F.flatten(F.collect_list(F.slice("code", 1, reach)).over(behind)), 1, reach)
    slices = slices.withColumns({"ahead": heads, "then": F.first(F.element_at("seconds", 1)).over(Window.partitionBy("key").orderBy("slice").rowsBetween(1, 1))})

    def summaries(batches):
        for batch in batches:
            out = []
            for codes, ahead in zip(batch.column(2), batch.column(3), strict=True):
                u = _inputs(codes.values.to_numpy(), ahead.values.to_numpy(), need, n)
                now, begun = np.arange(machine.size), np.full(machine.size, -1)
                for i, x in enumerate(u.tolist()):
                    after = machine.next[now, x]
                    begun[machine.begins(now, after)] = i
                    now = after
                out.append((now.tolist(), begun.tolist(), len(u)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([r[k] for r in out], t) for k, t in enumerate((pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()))]], ["key", "slice", "now", "begun", "n"])

    small = slices.select("key", "slice", "code", "ahead").mapInArrow(summaries, f"key {kind}, slice long, now array<long>, begun array<long>, n long")

    def carry(before, now, begun, size):
        m, first, offset = before or (0, -1, 0)
        after = (now[m], offset + begun[m] if begun[m] >= 0 else first, offset + size)
        return after, (m, first, offset)

    entries = walked(small, ["now", "begun", "n"], carry, f"key {kind}, slice long, entry long, first long, offset long")
    entries = entries.withColumnRenamed("key", "_key").withColumnRenamed("slice", "_slice")
    joined = slices.join(entries, F.col("key").eqNullSafe(F.col("_key")) & (F.col("slice") == F.col("_slice")))

    def parts(batches):
        names = ["key", "state", "first", "first_s", "last", "last_s", "end_s"]
        for batch in batches:
            rows = []
            columns = [batch.column(k).to_pylist() for k in (0, 4, 5, 6, 7)]
            for codes, ahead, times, key_, m, first, offset, then in zip(batch.column(1), batch.column(2), batch.column(3), *columns, strict=True):
                u, t = _inputs(codes.values.to_numpy(), ahead.values.to_numpy(), need, n), times.values.to_pylist()
                found = {}
                for i, x in enumerate(u.tolist()):
                    after = int(machine.next[m, x])
                    if machine.begins(np.int64(m), np.int64(after)):
                        first = offset + i
                    m = after
                    if machine.matches(np.int64(m)):
                        end = t[i + 1] if i + 1 < len(t) else then
                        here = t[i] if first == offset + i else found[first][3] if first in found else None
                        found[first] = (key_, (m - 1) // machine.width, first, here, offset + i, t[i], end)
                rows += found.values()
            kinds = (batch.column(0).type, pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    found = joined.select("key", "code", "ahead", "seconds", "entry", "first", "offset", "then").mapInArrow(parts, f"key {kind}, state long, first long, first_s double, last long, last_s double, end_s double")
    whole = found.groupBy("key", "first").agg(F.max("state").alias("state"), F.max("first_s").alias("first_s"), F.max(F.struct("last", "last_s", "end_s")).alias("z"))
    end = F.coalesce(F.col("z.end_s"), F.col("z.last_s") + period)
    least = F.element_at(F.array(*[F.lit(float((shortest_by or {}).get(s, shortest))) for s in states]), F.col("state").cast("int") + 1)
    whole = whole.withColumn("end_s", end).filter(F.col("end_s") - F.col("first_s") + 1e-6 >= least)
    number = F.row_number().over(Window.partitionBy("key").orderBy("first")) - 1
    name = F.element_at(F.array(*[F.lit(s) for s in states]), F.col("state").cast("int") + 1)
    return whole.select(F.col("key").alias(key), number.cast("long").alias("segment"), name.alias("state"), "first_s", F.col("z.last_s").alias("last_s"), "end_s", (F.col("z.last") - F.col("first") + 1).alias("frames"))
