"""Column helpers: labels from file names, geometry, vectors, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def some(c: Column) -> Column:
    """An empty match as null."""
    return F.nullif(c, F.lit(""))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


# ---- times in names (P3-P8)


def time_from_path(path: Column) -> Column:
    """The first run of 14 digits; else a YYYYMMDDHH folder and a MMmSSs or MMSS name; else null."""
    stamp = F.try_to_timestamp(some(F.regexp_extract(path, r"(\d{14})", 1)), F.lit("yyyyMMddHHmmss"))
    hour = r"(?:^|/)(\d{10})/[^/]*$"
    old = F.regexp_extract(path, r"(?:^|/)(\d{2})M?(\d{2})S?[^/]*$", 1), F.regexp_extract(path, r"(?:^|/)(\d{2})M?(\d{2})S?[^/]*$", 2)
    legacy = F.when(F.regexp_like(path, F.lit(hour)), F.try_to_timestamp(F.concat(F.regexp_extract(path, hour, 1), *old), F.lit("yyyyMMddHHmmss")))
    return F.coalesce(stamp, legacy)


def stamp_or(video: Column, ts: Column) -> Column:
    """The time in a video's name (its first run of 14 digits), else ``ts``."""
    return F.coalesce(F.try_to_timestamp(some(F.regexp_extract(basename(video), r"(\d{14})", 1)), F.lit("yyyyMMddHHmmss")), ts)


def _legacy(name: Column) -> tuple[Column, Column]:
    pattern = r"^(\d{2})(?:M(\d{2})S|(\d{2}))"
    mm = some(F.regexp_extract(name, pattern, 1))
    return mm, F.coalesce(some(F.regexp_extract(name, pattern, 2)), some(F.regexp_extract(name, pattern, 3)))


def hhmm(video: Column, ts: Column) -> Column:
    """The log's hour and the name's minutes for names that start with four digits; else the stamp's time; else the log's."""
    name = basename(video)
    mm, _ = _legacy(name)
    return F.when(mm.isNotNull() & ts.isNotNull(), F.concat(F.date_format(ts, "HH"), F.lit(":"), mm)).otherwise(
        F.date_format(stamp_or(video, ts), "HH:mm")
    )


def hhmmss(video: Column, ts: Column) -> Column:
    return F.date_format(stamp_or(video, ts), "HH:mm:ss")


def mm_ss(video: Column, ts: Column) -> Column:
    name = basename(video)
    mm, ss = _legacy(name)
    at = stamp_or(video, ts)
    label = lambda a, b: F.concat(a, F.lit("M"), b, F.lit("S"))
    return F.when(mm.isNotNull(), label(mm, ss)).otherwise(label(F.date_format(at, "mm"), F.date_format(at, "ss")))


def minute_of_day(label: Column) -> Column:
    """Minute of HH:MM:SS; null beyond 23:59 or for anything else."""
    parts = F.split(label, ":")
    h, m = F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    return F.when((F.size(parts) == 3) & h.between(0, 23) & m.between(0, 59), h * 60 + m)


def caption_stamp(ts: Column) -> Column:
    return F.date_format(ts, "'_'HH'h'mm'm:_'")


def button_stamp(path: Column) -> Column:
    """HHhMM as on buttons (HHHMMM): the path's time, else the folder's last two digits and the name's first two; 00 where there is none."""
    at = time_from_path(path)
    hour = some(F.regexp_extract(path, r"(?:^|/)[^/]*(\d{2})/[^/]*$", 1))
    mm, _ = _legacy(basename(path))
    text = lambda h, m: F.concat(h, F.lit("H"), m, F.lit("M"))
    return F.coalesce(text(F.date_format(at, "HH"), F.date_format(at, "mm")), text(F.coalesce(hour, F.lit("00")), F.coalesce(mm, F.lit("00"))))


def duration_text(minutes: Column) -> Column:
    """1h14m, 2h, 5m, 0m."""
    h, m = F.floor(minutes / 60), minutes % 60
    hours = F.when(h > 0, F.concat(h.cast("string"), F.lit("h"))).otherwise("")
    return F.concat(hours, F.when((m > 0) | (h == 0), F.concat(m.cast("string"), F.lit("m"))).otherwise(""))


def flexible_time(since: Column, day: Column) -> Column:
    """A full stamp, or HH:MM:SS or HH:MM of the given day."""
    on_day = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), since)
    return F.coalesce(
        F.try_to_timestamp(since, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(on_day, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(on_day, F.lit("yyyy-MM-dd HH:mm"))
    )


# ---- geometry (P13-P15, P18)


def box_area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.greatest(F.lit(1.0), (x2 - x1) * (y2 - y1))


def iou(a: list[Column], b: list[Column]) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return w * h / (box_area(*a) + box_area(*b) - w * h)


def center_distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(F.pow((a[0] + a[2] - b[0] - b[2]) / 2, 2) + F.pow((a[1] + a[3] - b[1] - b[3]) / 2, 2))


def diagonal(a: list[Column]) -> Column:
    return F.sqrt(F.pow(a[2] - a[0], 2) + F.pow(a[3] - a[1], 2))


def in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Whether a point lies in a polygon (array of [x, y]) or on its edge."""
    n = F.size(polygon)
    edges = F.transform(polygon, lambda p, i: F.struct(p.alias("a"), F.get(polygon, (i + 1) % n).alias("b")))

    def on_edge(e: Column) -> Column:
        ax, ay, bx, by = e["a"][0], e["a"][1], e["b"][0], e["b"][1]
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        return (cross == 0) & x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))

    def crosses(e: Column) -> Column:
        ax, ay, bx, by = e["a"][0], e["a"][1], e["b"][0], e["b"][1]
        return ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / F.nullif(by - ay, F.lit(0)) + ax)

    hits = F.size(F.filter(edges, crosses))
    return F.exists(edges, on_edge) | (hits % 2 == 1)


def bounds(polygon: Column, pad: Column, width: Column, height: Column) -> Column:
    """The polygon's bounding box with padding, inside the frame."""
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    return F.struct(
        F.greatest(F.lit(0), F.array_min(xs) - pad).alias("x1"), F.greatest(F.lit(0), F.array_min(ys) - pad).alias("y1"),
        F.least(width, F.array_max(xs) + pad).alias("x2"), F.least(height, F.array_max(ys) + pad).alias("y2"),
    )


def rescale(polygon: Column, width: Column, height: Column) -> Column:
    """As it is if it fits the frame; halved if that fits; else halved and clipped to the frame."""
    half = _halved(polygon)
    return F.when(_fits(polygon, width, height), polygon).when(_fits(half, width, height), half).otherwise(_clipped(half, width, height))


def rescale_small(polygon: Column, width: Column, height: Column) -> Column:
    """For small frames: as it is or halved if that fits; else scaled from the resolution that the points look like, and clipped."""
    half = _halved(polygon)
    high = (_largest(polygon, 0) > 2500) | (_largest(polygon, 1) > 1400)
    share = lambda size, full, less: (size / F.when(high, full).otherwise(less)).cast("float")
    sx, sy = share(width, 3840, 1920), share(height, 2160, 1080)
    scaled = F.transform(polygon, lambda p: F.array((p[0].cast("float") * sx).cast("int"), (p[1].cast("float") * sy).cast("int")))
    return F.when(_fits(polygon, width, height), polygon).when(_fits(half, width, height), half).otherwise(_clipped(scaled, width, height))


def _largest(polygon: Column, axis: int) -> Column:
    return F.array_max(F.transform(polygon, lambda p: p[axis]))


def _fits(polygon: Column, width: Column, height: Column) -> Column:
    return (_largest(polygon, 0) <= width) & (_largest(polygon, 1) <= height)


def _halved(polygon: Column) -> Column:
    return F.transform(polygon, lambda p: F.transform(p, lambda v: (v * 0.5).cast("int")))


def _clipped(polygon: Column, width: Column, height: Column) -> Column:
    inside = lambda v, size: F.greatest(F.lit(0), F.least(v, size - 1))
    return F.transform(polygon, lambda p: F.array(inside(p[0], width), inside(p[1], height)))


# ---- vectors (SC2, SC3)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x / norm)).otherwise(a)
