"""From pixels to positions: a line fitted for each axis, and whether the landmarks enclose a point."""

from __future__ import annotations

from math import fma, isnan, nan

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import dealt

#: Half length and half width of the rink, how far off it a position may lie, and
#: where the outer zones begin.
HALF_LENGTH, HALF_WIDTH, FAR_X, FAR_Y, ZONE = 100.0, 42.5, 105.0, 45.0, 25.0
INSIDE, OUTSIDE = 1.0, 0.3


def _cross(p: Column, q: Column, x: Column, y: Column) -> Column:
    return (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"])


def fused(a: float, b: float, c: float) -> float:
    """a * b + c in one rounding; infinite or NaN as the plain sum where it has no finite value."""
    try:
        return fma(a, b, c)
    except (OverflowError, ValueError):
        return a * b + c


class Line:
    """A least-squares line by running means, a point at a time, with the products added in one
    rounding where DuckDB's regr_slope and regr_intercept do so."""

    def __init__(self, key):
        self.key, self.rows, self.n = key, 0, 0
        self.mean_x = self.mean_y = self.both = self.mid = self.square = self.sum_x = self.sum_y = 0.0

    def add(self, x: float | None, y: float | None) -> None:
        self.rows += 1
        if x is None or y is None:
            return
        self.n += 1
        far = x - self.mean_x
        self.mean_x += far / self.n
        self.mean_y += (y - self.mean_y) / self.n
        self.both = fused(far, y - self.mean_y, self.both)
        before = x - self.mid
        self.mid += before / self.n
        self.square += (x - self.mid) * before
        self.sum_x += x
        self.sum_y += y

    def fit(self) -> tuple:
        """key, rows, slope (null without points, NaN where all x are one) and intercept (null then)."""
        if not self.n:
            return self.key, self.rows, None, None
        spread = self.square / self.n
        slope = self.both / self.n / spread if spread else nan
        return self.key, self.rows, slope, None if isnan(slope) else fused(-slope, self.sum_x / self.n, self.sum_y / self.n)


def fitted_lines(df: DataFrame, key: str, order: str, x: str, y: str) -> DataFrame:
    """key, its number of rows ``n``, slope and intercept of the line through its points (x, y). Points
    stream through one task in order, which holds one line at a time: the last bits of a sum
    depend on the order of its parts, and with them which way a half is rounded."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        last, line = object(), None
        for batch in batches:
            done = []
            for key_, px, py in zip(*[batch.column(k).to_pylist() for k in (0, 2, 3)], strict=True):
                if key_ != last:
                    done += [line.fit()] if line else []
                    last, line = key_, Line(key_)
                line.add(px, py)
            yield record(done, batch.column(0).type)
        if line:
            yield record([line.fit()], batch.column(0).type)

    def record(fits, key_type):
        types = (key_type, pa.int64(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in fits], t) for k, t in enumerate(types)], ["key", "n", "slope", "intercept"])

    rows = df.select(F.col(key).alias("key"), F.col(order).alias("place"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = dealt(rows, "key").sortWithinPartitions("key", "place", "x", "y")
    return rows.mapInArrow(run, f"key {kind}, n long, slope double, intercept double").withColumnRenamed("key", key)


def hull_edges(points: Column) -> Column:
    """Edges (from, to) of the convex hull of an array of (x, y), counter-clockwise: pairs with no
    point on their right. For the few landmarks of a calibration."""
    pairs = F.flatten(F.transform(points, lambda p: F.transform(points, lambda q: F.struct(p.alias("p"), q.alias("q")))))
    edge = lambda e: ((e["p"]["x"] != e["q"]["x"]) | (e["p"]["y"] != e["q"]["y"])) & F.forall(points, lambda r: _cross(e["p"], e["q"], r["x"], r["y"]) >= 0)
    return F.filter(pairs, edge)


def calibrations(landmarks: DataFrame, key: str) -> DataFrame:
    """key, cx, half_w, cy, half_h and the hull's edges from landmarks (key, pixel_x, pixel_y, hockey_x,
    hockey_y) by least squares; keys whose landmarks don't span both axes have none."""
    line = lambda y, x: (F.regr_intercept(y, x), F.regr_slope(y, x))
    (cx, w), (cy, h) = line(F.col("pixel_x"), F.col("hockey_x") / HALF_LENGTH), line(F.col("pixel_y"), -F.col("hockey_y") / HALF_WIDTH)
    points = F.collect_set(F.struct(F.col("pixel_x").cast("double").alias("x"), F.col("pixel_y").cast("double").alias("y")))
    fits = landmarks.groupBy(key).agg(cx.alias("cx"), w.alias("half_w"), cy.alias("cy"), h.alias("half_h"), points.alias("_points"))
    fits = fits.filter("half_w > 0 AND half_h > 0")
    return fits.select(key, "cx", "half_w", "cy", "half_h", hull_edges(F.col("_points")).alias("edges"))


def located(markers: DataFrame, fits: DataFrame, key: str, flipped: Column) -> DataFrame:
    """``markers`` (key, pixel_x, pixel_y, ...) with x and y on the rink, zone and confidence (1.0 within
    the landmarks' hull or on it, 0.3 outside); ``flipped``: the side attacks to the left."""
    rows = markers.join(fits, key)
    at_x, at_y = F.col("pixel_x").cast("double"), F.col("pixel_y").cast("double")
    clamp = lambda v, far: F.greatest(F.lit(-far), F.least(F.lit(far), v))
    x = clamp((at_x - F.col("cx")) / F.col("half_w") * HALF_LENGTH, FAR_X)
    y = clamp(-(at_y - F.col("cy")) / F.col("half_h") * HALF_WIDTH, FAR_Y)
    x = F.when(flipped, -x).otherwise(x)
    at = F.round(x, 6)
    zone = F.when(at > ZONE, "offensive").when(at < -ZONE, "defensive").otherwise("neutral")
    inside = F.forall("edges", lambda e: _cross(e["p"], e["q"], at_x, at_y) >= 0)
    return rows.select(*markers.columns, F.round(x, 2).alias("x"), F.round(y, 2).alias("y"), zone.alias("zone"), F.when(inside, INSIDE).otherwise(OUTSIDE).alias("confidence"))
