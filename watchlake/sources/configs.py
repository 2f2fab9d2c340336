"""Configurations: regions of interest and clip profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POLYGON = "array<array<int>>"
# Name, least width and height, line, tolerance, least contour area, crop padding, motion scale and stride, padding of the
# tracker's region, extra tolerance at the line and crop padding for re-identification, hotspot.
PROFILES = [
    ("4k", 3800, 2100, 1600, 12, 7200, 60, 0.5, 2, 20, 40, 20, (2300, 900)),
    ("1080p", 1900, 1000, 810, 6, 1800, 30, 1.0, 1, 10, 20, 12, (1150, 450)),
]
# The small frames that are supported, and the least area and padding that they scale down to.
SMALL, LEAST_AREA, LEAST_PADDING = [(640, 360), (896, 512)], 60, 6


def parse_roi(text: DataFrame, value: str = "value", line_y: int | None = None) -> DataFrame:
    """motion, tracker and person polygons and line_y; a bare list of points is the motion polygon. Broken text has nulls."""
    whole = F.from_json(F.col(value), f"motion_detection_roi {POLYGON}, tracker_roi {POLYGON}, person_tracker_roi {POLYGON}, line_y int")
    bare = F.from_json(F.col(value), POLYGON)
    return text.select(
        "*", F.coalesce(whole["motion_detection_roi"], bare).alias("motion_roi"), whole["tracker_roi"].alias("tracker_roi"),
        whole["person_tracker_roi"].alias("person_roi"), F.coalesce(F.lit(line_y), whole["line_y"]).alias("line_y"),
    )


def clip_profile(clips: DataFrame, fast_stride: int = 3) -> DataFrame:
    """Adds profile, status, line_y, tolerance, least_area, padding, motion_scale, stride, roi_padding, reid_tolerance, reid_padding and
    hotspot (x, y) by a clip's width, height and ``fast``.

    Small frames have the line of the lower profile, and area and padding of the higher one scaled to their pixels, the
    area halved. Other frames are unsupported: their status is no_motion and they have no numbers but the stride.
    """
    w, h = F.col("width"), F.col("height")
    small = F.lit(False)
    for size in SMALL:
        small = small | ((w == size[0]) & (h == size[1]))
    fits = [(w >= p[1]) & (h >= p[2]) for p in PROFILES]
    high, low = PROFILES
    pick = lambda k: F.when(fits[0], high[k]).when(fits[1] | small, low[k])
    spot = lambda k: F.when(fits[0], high[12][k]).when(fits[1] | small, low[12][k])
    profile = F.when(fits[0], high[0]).when(fits[1], low[0]).when(small, "low").otherwise("unsupported")
    area = F.greatest(F.lit(LEAST_AREA), (high[5] * ((w * h) / F.lit(3840.0 * 2160.0)) * 0.5).cast("int"))
    pad = F.greatest(F.lit(LEAST_PADDING), (high[6] * (w / F.lit(3840.0))).cast("int"))
    stride = F.coalesce(pick(8), F.lit(1))
    return clips.withColumns({
        "profile": profile, "status": F.when(profile == "unsupported", "no_motion"), "line_y": pick(3), "tolerance": pick(4),
        "least_area": F.when(small, area).otherwise(pick(5)), "padding": F.when(small, pad).otherwise(pick(6)), "motion_scale": pick(7),
        "roi_padding": pick(9), "reid_tolerance": pick(10), "reid_padding": pick(11),
        "hotspot": F.when(profile != "unsupported", F.struct(spot(0).alias("x"), spot(1).alias("y"))),
        "stride": F.when(F.col("fast"), F.greatest(stride, F.lit(fast_stride))).otherwise(stride),
    })
