"""Order-dependent operators over one bounded sequence at a time (a video, a match)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reels_of(states: list[str], openers: set[str], closers: set[str]) -> list[int]:
    """Reel number of each segment. An opener starts a reel unless the reel so far holds
    only openers; the first other segment after a closer starts one too."""
    out, reel, only_openers, closed = [], 0, True, False
    for i, s in enumerate(states):
        if i and ((s in openers and not only_openers) or (closed and s not in closers)):
            reel, only_openers, closed = reel + 1, True, False
        only_openers &= s in openers
        closed |= s in closers
        out.append(reel)
    return out


def reel_groups(df: DataFrame, key: str, order: str, state: str, openers: set[str], closers: set[str]) -> DataFrame:
    """key, reel, first and last segment, and which markers the reel has; no segment is
    dropped, a reel without opener or closer is only flagged. As closers only end a reel and
    openers only begin one, a reel starts where an opener follows another kind of segment or
    another kind follows a closer: the rule of ``reels_of`` by the segment before alone."""
    w = Window.partitionBy(key).orderBy(order)
    opens, closes = F.col(state).isin(list(openers)), F.col(state).isin(list(closers))
    rows = df.select(key, order, F.coalesce(opens, F.lit(False)).alias("opens"), F.coalesce(closes, F.lit(False)).alias("closes"))
    starts = (F.col("opens") & ~F.lag("opens").over(w)) | (~F.col("closes") & F.lag("closes").over(w))
    rows = rows.withColumn("starts", F.coalesce(starts, F.lit(False)).cast("long")).withColumn("reel", F.sum("starts").over(w))
    return rows.groupBy(key, "reel").agg(F.min(order).alias("first_segment"), F.max(order).alias("last_segment"), F.count("*").alias("segments"), F.bool_or("opens").alias("has_opener"), F.bool_or("closes").alias("has_closer"))


def collision_groups(df: DataFrame, key: str, order: str, x: str, y: str, radius: float) -> DataFrame:
    """Each point joins the first anchor within ``radius``, else becomes one."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, anchors, out = rows.sort_values(order), [], []
        for px, py in zip(rows[x], rows[y], strict=True):
            hit = next((i for i, (ax, ay) in enumerate(anchors) if (px - ax) ** 2 + (py - ay) ** 2 <= radius * radius), None)
            if hit is None:
                anchors.append((px, py))
                hit = len(anchors) - 1
            out.append(hit)
        return pd.DataFrame({key: rows[key], order: rows[order], "bucket": out})

    return df.select(key, order, x, y).groupBy(key).applyInPandas(run, f"{key} long, {order} long, bucket long")
