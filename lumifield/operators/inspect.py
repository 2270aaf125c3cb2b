"""Looking at single beads: look-up, windows around a point, grids of values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumifield.functions.lookup import box_join, window_join


def bead_at(requests: DataFrame, beads: DataFrame, keep: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """First bead (lowest bead_id) at each requested (x, y); requests carry request_id."""
    hit = requests.join(beads, [*by, "x", "y"])
    body = F.struct("bead_id", *keep)
    return hit.groupBy("request_id", *by, "x", "y").agg(F.min_by(body, "bead_id").alias("_b")).select(
        "request_id", *by, "x", "y", "_b.*")


def parse_bbox(beads: DataFrame, h: str | Column = "h", w: str | Column = "w", text: str = "bbox") -> DataFrame:
    """y1, x1, y2, x2 out of the text, clipped to the image."""
    nums = F.regexp_extract_all(F.col(text), F.lit(r"(-?\d+)"), F.lit(1))
    h, w = (F.col(c) if isinstance(c, str) else c for c in (h, w))
    clip = lambda i, n: F.least(F.greatest(F.get(nums, F.lit(i)).cast("long"), F.lit(0)), n - 1)
    return beads.withColumns({"y1": clip(0, h), "x1": clip(1, w), "y2": clip(2, h), "x2": clip(3, w)})


def window_samples(requests: DataFrame, px: DataFrame, radius: int = 2, scale: float = 2.0, by: Sequence[str] = ()) -> DataFrame:
    """Samples of every cycle and channel in the int(radius * scale) window around each request."""
    reach = int(radius * scale)
    points = requests.select("request_id", *by, F.col("y").alias("py"), F.col("x").alias("px"))
    return window_join(points, px, reach, reach, by).select("request_id", *by, "cycle", "channel", "y", "x", "v")


def box_samples(boxes: DataFrame, px: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Samples of every cycle and channel in the box [y1, y2) x [x1, x2) of each request."""
    spans = boxes.select(
        "request_id", *by, F.col("y1").alias("y0"), F.col("y2").alias("y1"), F.col("x1").alias("x0"), F.col("x2").alias("x1"))
    return box_join(spans, px, by).select("request_id", *by, "cycle", "channel", "y", "x", "v")


def grow_bbox(boxes: DataFrame, scale: float) -> DataFrame:
    """Box scaled about its centre: half sides floored, corners truncated."""
    out = {}
    for a in "xy":
        lo, hi = F.col(f"{a}1"), F.col(f"{a}2")
        centre, half = (lo + hi) / 2, F.floor((hi - lo) * F.lit(float(scale)) / 2)
        out[f"{a}1"], out[f"{a}2"] = (centre - half).cast("long"), (centre + half).cast("long")
    return boxes.withColumns(out)


def grid_report(samples: DataFrame, calls: DataFrame, channels: Sequence[int]) -> DataFrame:
    """Per request: one row per cycle, one column per channel (mean of the window), and the call.

    ``calls`` has request_id, cycle, call; a missing call reads N/A.
    """
    grid = samples.groupBy("request_id", "cycle").pivot("channel", list(channels)).agg(F.avg("v"))
    cells = [F.col(str(c)).alias(f"ch{c}") for c in channels]
    return grid.join(calls, ["request_id", "cycle"], "left").select(
        "request_id", "cycle", *cells, F.coalesce(F.col("call").cast("string"), F.lit("N/A")).alias("output"))
