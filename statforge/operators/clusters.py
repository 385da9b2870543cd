"""Clusters of points around running medians, in the order of the points."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class RunningMedian:
    """Upper median of what was added: the smallest of the larger half."""

    def __init__(self):
        self.low: list[float] = []  # negated
        self.high: list[float] = []

    def add(self, x: float) -> float:
        heapq.heappush(self.high, -heapq.heappushpop(self.low, -x))
        if len(self.high) > len(self.low) + 1:
            heapq.heappush(self.low, -heapq.heappop(self.high))
        return self.high[0]


class MedianClusters:
    """``add`` gives the number of a point's cluster: the first one whose median is nearer than
    ``radius``, else a new one. Medians stand in a grid of radius-sized cells, so a point is
    compared with those of nine cells only."""

    def __init__(self, radius: float):
        self.radius = radius
        self.medians: list[tuple[RunningMedian, RunningMedian]] = []
        self.at: list[tuple[float, float]] = []
        self.cells: dict[tuple[int, int], set[int]] = defaultdict(set)

    def _cell(self, x: float, y: float) -> tuple[int, int]:
        return int(x // self.radius), int(y // self.radius)

    def add(self, x: float, y: float) -> int:
        i, j = self._cell(x, y)
        near = [c for p in (i - 1, i, i + 1) for q in (j - 1, j, j + 1) if (p, q) in self.cells for c in self.cells[p, q]]
        near = [c for c in near if (x - self.at[c][0]) ** 2 + (y - self.at[c][1]) ** 2 < self.radius**2]
        if near:
            c = min(near)
            self.cells[self._cell(*self.at[c])].discard(c)
        else:
            c = len(self.at)
            self.medians.append((RunningMedian(), RunningMedian()))
            self.at.append((0.0, 0.0))
        self.at[c] = (self.medians[c][0].add(x), self.medians[c][1].add(y))
        self.cells[self._cell(*self.at[c])].add(c)
        return c


def median_clusters(df: DataFrame, key: str, order: str, x: str, y: str, radius: float) -> DataFrame:
    """key, order, and ``cluster`` (from 0) of each point with both coordinates. The points of a
    key stream through one task in order, as each depends on all before it; the task holds that
    key's coordinates only."""

    def run(batches):
        last, clusters = object(), None
        for batch in batches:
            found = []
            for key_, px, py in zip(*[batch.column(k).to_pylist() for k in (0, 2, 3)], strict=True):
                if key_ != last:
                    last, clusters = key_, MedianClusters(radius)
                found.append(clusters.add(px, py))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["key", "place", "cluster"])

    rows = df.select(F.col(key).alias("key"), F.col(order).cast("long").alias("place"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = rows.filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").repartition("key").sortWithinPartitions("key", "place", "x", "y")
    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, place long, cluster long").withColumnsRenamed({"key": key, "place": order})
