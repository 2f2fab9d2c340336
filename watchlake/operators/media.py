"""Media tables: listings, files by stem, gate crossings with their crops, source videos, timelapse frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchlake.functions import columns as C
from watchlake.functions.ranks import numbered


# Fixed value: names of saved frames; the stem of their video stands after the hour.
FRAME = r"(?i)^\d{2}H(.+)_(?:insignificant|no_person)_\d+\.(?:jpg|jpeg|png)$"


def media_files(listing: DataFrame) -> DataFrame:
    """(day, name, path, kind, stem) of files right in a folder YYYYMMDD: crop, frame, image, pose or highlight.

    Crops are ``<stem>_reid_best...``, poses ``<stem>_pose_...``, frames are told by ``FRAME``; other pictures are images and have
    no stem. The other clips are highlights, by their own name.
    """
    name, low = C.basename(F.col("path")), F.lower(C.basename(F.col("path")))
    before = lambda mark: F.split_part("name", F.lit(mark), F.lit(1))
    has = lambda mark: F.contains("name", F.lit(mark))
    day = F.regexp_extract("path", r"(?:^|/)(\d{8})/[^/]*$", 1)
    rows = listing.select("path", name.alias("name"), low.alias("low"), day.alias("day")).where("day <> ''")
    frame = C.some(F.regexp_extract("name", FRAME, 1))
    picture, clip = F.col("low").rlike(r"\.(jpg|jpeg|png)$"), F.endswith("low", F.lit(".mp4"))
    kind = F.when(picture & has("_reid_best"), "crop").when(picture & frame.isNotNull(), "frame").when(picture, "image").when(clip & has("_pose_"), "pose").when(clip, "highlight")
    stem = F.when(kind == "crop", before("_reid_best")).when(kind == "frame", frame).when(kind == "pose", before("_pose_")).when(kind == "highlight", C.stem(F.col("name")))
    return rows.select("day", "name", "path", kind.alias("kind"), stem.alias("stem")).where("kind IS NOT NULL")


def media_index(listing: DataFrame) -> DataFrame:
    """(kind, stem, name, path, files): media by name; of several days the newest one's path, and how many days have it."""
    return media_files(listing).groupBy("kind", "stem", "name").agg(F.max_by("path", "day").alias("path"), F.count("*").alias("files"))


def crossings_with_crops(videos: DataFrame, index: DataFrame) -> DataFrame:
    """A day's videos that have crops, latest first: what the log says about each, and its crops' names in order.

    ``videos`` are ``logs.video_summary`` rows of videos with a status or a first line. A crop that lies in several days'
    folders is named once for each. place is the row's number in the order of first line, then name, both falling.
    """
    crops = index.where("kind = 'crop'").select("stem", F.explode(F.array_repeat("name", F.col("files").cast("int"))).alias("name"))
    crops = crops.groupBy(F.col("stem").alias("of")).agg(F.array_sort(F.collect_list("name")).alias("crops"))
    rows = videos.where("status IS NOT NULL OR first_seen IS NOT NULL").join(crops, C.stem(F.col("video")) == F.col("of"))
    rows = numbered(rows, "place", F.desc_nulls_last("first_seen"), F.desc("video"))
    reaction = F.when(F.col("reaction").isin("away", "back"), F.col("reaction"))
    return rows.select(
        "place", "video", C.hhmmss(F.col("video"), F.col("first_seen")).alias("time"), F.col("gate_dir").alias("direction"), F.col("gate_up").alias("persons_up"), F.col("gate_down").alias("persons_down"), "status",
        "reid_matched", F.round("reid_best", 3).alias("reid_score"), F.round("reid_neg", 3).alias("reid_neg"), reaction.alias("away_back"), "crops",
    )


def first_source(videos: DataFrame, listing: DataFrame) -> DataFrame:
    """(video, path): the first file of that name."""
    files = listing.groupBy(C.basename(F.col("path")).alias("video")).agg(F.min("path").alias("path"))
    return videos.select("video").distinct().join(files, "video")


def gallery_copies(videos: DataFrame, listing: DataFrame, k: int = 3, only_matched: bool = False) -> DataFrame:
    """(stem, path): the first ``k`` crops of each video by name, one at least, from the folder of the video's own day.

    Crops are .jpg files ``<stem>_reid_best...``; with ``only_matched`` those that end in _m.jpg. Videos without a time in
    their name have none.
    """
    crops = media_files(listing).where("kind = 'crop' AND name LIKE '%.jpg'")
    if only_matched:
        crops = crops.where(F.endswith(F.lower("name"), F.lit("_m.jpg")))
    own = videos.select(C.stem(C.basename(F.col("video"))).alias("stem"), F.date_format(C.time_from_path(F.col("video")), "yyyyMMdd").alias("day")).distinct()
    rows = crops.join(own, ["stem", "day"])
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("stem").orderBy("name"))).where(F.col("k") <= max(1, k)).select("stem", "path")


def copies_in_gallery(copies: DataFrame, gallery: DataFrame, present: bool = True) -> DataFrame:
    """Copies whose file name is (or isn't) among the gallery's paths."""
    names = gallery.select(C.basename(F.col("path")).alias("name")).distinct()
    rows = copies.withColumn("name", C.basename(F.col("path")))
    return rows.join(names, "name", "left_semi" if present else "left_anti").drop("name")


def nth_frames(frames: DataFrame, nth: int = 30) -> DataFrame:
    """(place, path): the nth frame of each clip; clips by their folder's name and the number after the last _ of theirs, names without one last."""
    got = frames.where(F.col("frame") == nth).select("path").distinct()
    parent = F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)
    stamp = C.some(F.regexp_extract(C.basename(F.col("path")), r"_(\d+)\.mp4$", 1)).try_cast("decimal(38,0)")
    rows = got.select("path", parent.alias("parent"), stamp.alias("stamp"))
    return numbered(rows, "place", F.col("parent"), F.asc_nulls_last("stamp"), F.col("path")).select("place", "path")
