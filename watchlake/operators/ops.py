"""Pipeline-state analytics: ledgers, recovery, retention, backlog, batches, throttling, health, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchlake.functions import columns as C
from watchlake.operators.graph import written


# ---- ledger


def ledger_state(updates: DataFrame, extras: tuple[str, ...] = ()) -> DataFrame:
    """(path, status, extras): completed stays; a queued after started doesn't set it back; extras keep their last value."""
    n, s = F.col("seq"), F.col("status")
    other = F.max_by("status", F.when(s != "queued", n))
    last = F.max_by("status", "seq")
    status = F.when(F.bool_or(s == "completed"), "completed").when(last != "queued", last).when(other == "started", "started").otherwise("queued")
    more = [F.max_by(c, F.when(F.col(c).isNotNull(), n)).alias(c) for c in extras]
    return updates.groupBy("path").agg(status.alias("status"), *more)


def most_recent(ledger: DataFrame, n: int = 10) -> DataFrame:
    """The rows latest by end, else start, else detection; 0 counts as missing."""
    at = F.coalesce(*(F.nullif(F.col(c).cast("double"), F.lit(0.0)) for c in ("end_ts", "start_ts", "detected_ts")))
    return ledger.withColumn("at", at).orderBy(F.desc("at"), "path").limit(n)


def keep_latest(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of an order: a report of fixed size, taken by a top-k that each task does on its own first."""
    return rows.orderBy(*order).limit(n)


def pruned_messages(rows: DataFrame, most: int = 400, keep: int = 200) -> DataFrame:
    """All rows while they are ``most`` or fewer; beyond that the ``keep`` of the largest seq."""
    n = F.broadcast(rows.agg(F.count("*").alias("_n")))  # a single row
    latest = keep_latest(rows, keep, F.desc("seq"))
    return rows.join(n).where(F.col("_n") <= most).unionByName(latest.join(n).where(F.col("_n") > most)).drop("_n")


def rotated_to_delete(files: DataFrame, base: str, keep: int = 60) -> DataFrame:
    """Rotated logs (path, mtime) beyond the ``keep`` newest: ``<base>.YYYY-MM-DD`` and ``<base without .log>_YYYY-MM-DD.log``."""
    name, stem, day = C.basename(F.col("path")), base.removesuffix(".log"), r"^\d{4}-\d{2}-\d{2}(\.\w+)?$"
    old = F.startswith(name, F.lit(base + ".")) & F.substring(name, len(base) + 2, 1 << 20).rlike(day)
    new = F.startswith(name, F.lit(stem + "_")) & F.endswith(name, F.lit(".log")) & F.regexp_replace(F.substring(name, len(stem) + 2, 1 << 20), r"\.log$", "").rlike(day)
    rotated = files.where(old | new)
    newest = keep_latest(rotated, keep, F.desc("mtime"), F.desc("path")).select("path")
    return rotated.join(F.broadcast(newest), "path", "left_anti")  # at most ``keep`` rows


def pending(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that the ledger doesn't hold as completed."""
    return files.join(ledger.where("status = 'completed'").select("path"), "path", "left_anti")


def on_disk(ledger: DataFrame, files: DataFrame) -> DataFrame:
    return ledger.join(files.select("path"), "path", "left_semi")


def recovery_candidates(hour_dirs: DataFrame, day_dirs: DataFrame, day_folders: DataFrame, fallback: DataFrame, unfinished: DataFrame) -> DataFrame:
    """(path, at): files of hour folders and day folders in the window, the fallback's, and unfinished ones; first source wins.

    The fallback stands in for a layout without day folders: it counts only if neither kind has a file and
    ``day_folders``, those that overlap the window, empty ones too, has no row. A quiet window alone doesn't call it.
    """
    parts = [x.select("path", "at", F.lit(k).alias("source")) for k, x in enumerate((hour_dirs, day_dirs))]
    found = parts[0].unionByName(parts[1])
    signs = found.select("path").limit(1).unionAll(day_folders.select("path").limit(1))
    any_ = signs.agg((F.count("*") > 0).alias("any"))
    spare = fallback.select("path", "at", F.lit(2).alias("source")).join(F.broadcast(any_)).where("NOT any").drop("any")
    every = found.unionByName(spare).unionByName(unfinished.select("path", "at", F.lit(3).alias("source")))
    return every.groupBy("path").agg(F.min_by("at", "source").alias("at"))


def recovery_sources(tree: DataFrame, root: str, ledger: DataFrame, since: Column, now: Column, slack_s: int = 180, deep: int = 3) -> tuple[DataFrame, ...]:
    """The five inputs of ``recovery_candidates`` from a directory tree and a ledger (path, status, at).

    ``tree`` has path, is_dir and mtime of everything below ``root``, empty folders too. Hour folders are named YYYYMMDDHH,
    day folders lie at YYYY/MM/DD; both must overlap the window from ``slack_s`` before ``since`` to ``now``. The
    fallback is every file down to ``deep`` folders. Only .mp4 files of the window that aren't completed count.
    """
    start = since - F.make_interval(secs=F.lit(slack_s))
    rest = F.substring("path", len(root.rstrip("/")) + 2, 1 << 20)
    rows = tree.select("path", "is_dir", F.col("mtime").alias("at"), rest.alias("rest"))
    rows = rows.withColumn("folder", F.when(F.col("is_dir"), F.col("rest")).otherwise(F.regexp_extract("rest", r"^(.*)/[^/]*$", 1)))
    hour = F.try_to_timestamp(F.regexp_extract("folder", r"^(\d{10})$", 1), F.lit("yyyyMMddHH"))
    day = F.try_to_date(F.regexp_extract("folder", r"^(\d{4}/\d{2}/\d{2})$", 1), "yyyy/MM/dd")
    files = pending(rows.where(~F.col("is_dir") & F.endswith("rest", F.lit(".mp4")) & F.col("at").between(start, now)), ledger)
    in_hour, in_day = hour.between(F.date_trunc("hour", start), now), day.between(F.to_date(start), F.to_date(now))
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    unfinished = ledger.where("status <> 'completed'").select("path", "at")
    return files.where(in_hour), files.where(in_day), rows.where(F.col("is_dir") & in_day), files.where(depth <= deep), unfinished


def recovery_list(candidates: DataFrame, ledger: DataFrame, since: Column, now: Column, slack_s: int = 180) -> DataFrame:
    """Candidates from ``slack_s`` before ``since`` to ``now`` that aren't completed, by time."""
    lo = since - F.make_interval(secs=F.lit(slack_s))
    return pending(candidates.where((F.col("at") >= lo) & (F.col("at") <= now)), ledger).orderBy("at", "path")


def expired(files: DataFrame, now: Column, days: int) -> DataFrame:
    return files.where(F.col("mday") < F.date_sub(now, days))


def expired_days(folders: DataFrame, today: Column, days: int) -> DataFrame:
    """Folders named YYYYMMDD whose day is more than ``days`` before today; other names never expire."""
    name = F.when(F.col("folder").rlike(r"^\d{8}$"), F.col("folder"))
    return folders.where(F.try_to_date(name, "yyyyMMdd") < F.date_sub(today, days))


def empty_folders(folders: DataFrame, files: DataFrame) -> DataFrame:
    """Folders (path) that one cleaning removes: those with neither a file (path) nor a folder in them."""
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    holds = files.select(parent.alias("path")).unionAll(folders.select(parent.alias("path"))).distinct()
    return folders.join(holds, "path", "left_anti")


def fileless_folders(folders: DataFrame, files: DataFrame) -> DataFrame:
    """Folders (path) without a file at any depth: what cleanings remove in the end, bottom-up.

    Each folder that holds files names all folders above it, so a tree of any depth is rolled up in one pass.
    """
    own = files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("path")).distinct()
    steps = F.split("path", "/")
    above = own.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))).alias("path"))
    return folders.join(above.distinct(), "path", "left_anti")


# ---- windows over state rows


def offline_since(health: DataFrame) -> DataFrame:
    """(host, since, samples): start of the current offline streak; hosts whose last sample is fine have no row."""
    back = health.groupBy("host").agg(F.max(F.when(F.col("status") != "offline", F.struct("ts", "n"))).alias("ok"))
    rows = health.join(back, "host").where(F.col("ok").isNull() | (F.struct("ts", "n") > F.col("ok")))
    return rows.groupBy("host").agg(F.min("ts").alias("since"), F.count("*").alias("samples"))


def first_stable(polls: DataFrame, needed: int = 2) -> DataFrame:
    """(path, poll): the first poll at which the size was above 0 and unchanged ``needed`` times in a row."""
    w = Window.partitionBy("path").orderBy("poll")
    same = F.coalesce((F.col("size") > 0) & (F.col("size") == F.lag("size").over(w)), F.lit(False))
    rows = polls.withColumn("same", same).withColumn("run", F.sum((~F.col("same")).cast("int")).over(w))
    streak = F.sum(F.col("same").cast("int")).over(Window.partitionBy("path", "run").orderBy("poll"))
    return rows.withColumn("streak", streak).where(F.col("streak") >= needed).groupBy("path").agg(F.min("poll").alias("poll"))


def backlog(steps: DataFrame, enter: int = 8, leave: int = 5, by: str = "day") -> DataFrame:
    """(by, n, depth, fast): depth never under 0; fast from a start at ``enter`` or more waiting to a finish at ``leave`` or fewer."""
    w = Window.partitionBy(by).orderBy("n")
    rows = steps.withColumn("sum", F.sum("step").over(w))
    rows = rows.withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(w)))
    before = F.coalesce(F.lag("depth").over(w), F.lit(0))
    mark = F.when((F.col("step") > 0) & (before >= enter), True).when((F.col("step") < 0) & (F.col("depth") <= leave), False)
    return rows.withColumn("mark", mark).select(by, "n", "depth", F.coalesce(F.last("mark", ignorenulls=True).over(w), F.lit(False)).alias("fast"))


def message_groups(clips: DataFrame, size: int = 4) -> DataFrame:
    """(day, batch, text, clips): runs of non-significant clips in groups of ``size``; a significant one ends a run.

    ``clips`` has day, n, text, significant.
    """
    w = Window.partitionBy("day").orderBy("n")
    rows = clips.withColumn("run", F.sum(F.col("significant").cast("int")).over(w)).where("NOT significant")
    place = F.floor((F.row_number().over(Window.partitionBy("day", "run").orderBy("n")) - 1) / size)
    rows = rows.withColumn("part", place)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy("day", "run", "part").agg(joined.alias("text"), F.count("*").alias("clips"), F.min("n").alias("first_n"))


def throttled(rows: DataFrame, cooldown: int, *by: str) -> DataFrame:
    """(by, at, n, suppressed): rows that pass, with how many were held back since the one before.

    A row passes if it comes ``cooldown`` or more after the last that passed. After a row that passes, the next is the first
    row at its time plus ``cooldown`` or later, whatever came before; so each row points at the one that would
    follow it. The rows that the first one reaches are marked by doubling these jumps. Rows are cut into pieces of
    ``cooldown``, and a next row is in the piece after its own or is the first of a later one; so a key of any number of
    rows is spread over its pieces, and only pieces are numbered by key. Times and ``cooldown`` are whole numbers; null
    keys are a key. Without a cooldown every row passes.
    """
    if cooldown < 1:
        return rows.select(*by, "at", "n", F.lit(0).cast("long").alias("suppressed"))
    span, names, by = cooldown, by, ("k",)
    piece = Window.partitionBy(*by, "piece")
    cut = rows.select(F.struct(*names).alias("k"), "at", "n").withColumn("piece", F.floor(F.col("at") / span))
    cut = written(cut.withColumn("nth", F.row_number().over(piece.orderBy("at", "n"))), "pieces")
    heads = cut.where("nth = 1").select(*by, "piece", F.col("at").alias("head_at"))
    sizes = cut.groupBy(*by, "piece").agg(F.count("*").alias("size"))
    order = Window.partitionBy(*by).orderBy("piece")
    ahead = F.lead(F.struct("piece", F.lit(1).alias("nth"))).over(order)
    pieces = heads.join(sizes, [*by, "piece"]).withColumns({
        "before": F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "later": ahead, "first": F.row_number().over(order) == 1,
    })
    pieces = written(pieces.drop("head_at", "size"), "piece")
    # a question of each row to the piece after its own: its first row at ``at`` + cooldown or later, else the first of the next
    ask = cut.select(*by, (F.col("piece") + 1).alias("piece"), (F.col("at") + span).alias("t"), F.lit(1).alias("side"), F.struct("piece", "nth").alias("me"))
    tell = cut.select(*by, "piece", F.col("at").alias("t"), F.lit(0).alias("side"), F.struct("piece", "nth").alias("me"))
    back = piece.orderBy(F.desc("t"), F.asc("side"), F.desc("me"))
    answers = ask.unionByName(tell).withColumn("next", F.last(F.when(F.col("side") == 0, F.col("me")), ignorenulls=True).over(back)).where("side = 1")
    # no answer there: the first row of the next piece that has rows, after the row's own
    own = pieces.select(*by, F.col("piece").alias("p"), "later")
    jumps = answers.select(*by, "me", "next").withColumn("p", F.col("me.piece")).join(own, [*by, "p"])
    after = F.when(F.col("later.piece") > F.col("p") + 1, F.col("later"))
    jumps = jumps.select(*by, "me", F.coalesce("next", after).alias("next"), F.when(F.col("next").isNull() & after.isNull() & F.col("later").isNotNull(), F.col("p") + 1).alias("skip"))
    then = pieces.select(*by, F.col("piece").alias("skip"), F.col("later").alias("then"))
    jumps = jumps.join(then, [*by, "skip"], "left").select(*by, "me", F.coalesce("next", "then").alias("next")).where("next IS NOT NULL")
    reached = written(pieces.where("first").select(*by, F.struct("piece", F.lit(1).alias("nth")).alias("me")), "reached")
    jumps = written(jumps, "jumps")
    while True:
        more = reached.join(jumps, [*by, "me"]).select(*by, F.col("next").alias("me"))
        grown = written(reached.unionByName(more).distinct(), "reached")
        if grown.count() == reached.count():
            break
        far = jumps.select(*by, F.col("me").alias("next"), F.col("next").alias("far"))
        reached, jumps = grown, written(jumps.join(far, [*by, "next"]).select(*by, "me", F.col("far").alias("next")), "jumps")
    passed = reached.select(*by, "me.piece", "me.nth").join(cut, [*by, "piece", "nth"]).join(pieces.select(*by, "piece", "before"), [*by, "piece"])
    place = F.col("before") + F.col("nth")
    last = F.lag(place).over(Window.partitionBy(*by).orderBy("piece"))  # at most one row passes in a piece
    return passed.withColumn("suppressed", F.coalesce(place - last - 1, F.lit(0))).select("k.*", "at", "n", F.col("suppressed").cast("long").alias("suppressed"))


def stage_profile(times: DataFrame, top: int = 5) -> DataFrame:
    """(stage, total, n, percent, mean_ms): the longest stages and one row for the others."""
    sums = times.groupBy("stage").agg(F.sum("seconds").alias("total"), F.sum("n").alias("n"))
    head = keep_latest(sums, top, F.desc(F.round("total", 9)), F.col("stage")).select("stage").withColumn("in_head", F.lit(True))
    rows = sums.join(F.broadcast(head), "stage", "left")
    rows = rows.groupBy(F.when(F.col("in_head"), F.col("stage")).otherwise("other").alias("stage")).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    whole = sums.agg(F.sum("total").alias("whole"))
    rows = rows.join(F.broadcast(whole))
    return rows.select("stage", "total", "n", F.try_divide(100 * F.col("total"), F.col("whole")).alias("percent"), F.try_divide(1000 * F.col("total"), F.col("n")).alias("mean_ms"))


def as_of(times: DataFrame, readings: DataFrame, tolerance: int, by: str) -> DataFrame:
    """Each time with the last reading at or before it, null if that is older than ``tolerance``.

    ``times`` has (by, at, n), ``readings`` (by, at, value). Both go through one window per key; of readings at one
    time the largest counts.
    """
    r = readings.groupBy(by, "at").agg(F.max("value").alias("value")).select(by, "at", "value", F.col("at").alias("read_at"), F.lit(None).cast("long").alias("n"), F.lit(0).alias("side"))
    t = times.select(by, "at", F.lit(None).cast(readings.schema["value"].dataType).alias("value"), F.lit(None).cast("long").alias("read_at"), F.col("n").cast("long").alias("n"), F.lit(1).alias("side"))
    w = Window.partitionBy(by).orderBy("at", "side")
    both = r.unionByName(t).withColumns({"v": F.last("value", True).over(w), "r": F.last("read_at", True).over(w)})
    return both.where("side = 1").select(by, "at", "n", F.when(F.col("at") - F.col("r") <= tolerance, F.col("v")).alias("value"))


def signature(files: DataFrame, *by: str) -> DataFrame:
    """SHA-1 over name, size and time of a folder's files, by name; it changes whenever one of them does."""
    item = F.concat_ws("|", "name", F.col("size").cast("string"), F.col("mtime").cast("string"))
    return files.groupBy(*by).agg(F.sha1(F.array_join(F.array_sort(F.collect_list(item)), "\n")).alias("signature"))


def stale_folders(current: DataFrame, stored: DataFrame, *by: str) -> DataFrame:
    """Folders whose stored signature is missing or different."""
    return current.join(stored, [*by, "signature"], "left_anti")


def prior_status(metrics: DataFrame) -> DataFrame:
    """(file, prior_status): the last status that was reported when motion detection was complete, of files that were new in the log."""
    done = F.when(F.col("content").rlike(r"Motion\s+detection\s+complete\.\s+Status:"), F.col("status"))
    rows = metrics.where("video IS NOT NULL").groupBy(F.col("video").alias("file")).agg(
        F.bool_or("is_new").alias("new"), F.max_by(done, F.when(done.isNotNull(), F.col("n"))).alias("prior_status")
    )
    return rows.where("new").select("file", "prior_status")


def replay_work(seen: DataFrame, listing: DataFrame, results: DataFrame) -> DataFrame:
    """(file, prior_status, new_status): files that weren't no_motion before; file_missing and unknown where they apply."""
    rows = seen.where(F.coalesce("prior_status", F.lit("")) != "no_motion")
    rows = rows.join(listing.select("file").withColumn("there", F.lit(True)), "file", "left").join(results, "file", "left")
    new = F.when(F.col("there").isNull(), "file_missing").otherwise(F.coalesce("status", F.lit("unknown")))
    return rows.select("file", F.coalesce("prior_status", F.lit("unknown")).alias("prior_status"), new.alias("new_status"))


# ---- projections


def route(status: Column, hour: Column) -> Column:
    """skip, offpeak, main or fallback."""
    quiet = status.isin("no_motion", "gate_crossing")
    return F.when(quiet, "skip").when((hour < 9) | (hour > 19), "offpeak").when(hour.between(9, 13), "main").otherwise("fallback")


def summary_text(persons: Column, cars: Column, direction: Column, up: Column, down: Column, score: Column, matched: Column, description: Column) -> Column:
    """Counts, direction, the rounded percent if matched, or if not matched and not 0, and the description cut to 512 characters if over 1023."""
    rounded = F.rint(F.coalesce(score, F.lit(0.0)) * 100).cast("int")
    percent = F.when(matched | (~matched & (rounded != 0)), F.concat(rounded.cast("string"), F.lit("%")))
    cut = F.when(F.length(description) > 1023, F.concat(F.substring(description, 1, 512), F.lit("..."))).otherwise(description)
    way = F.when(direction.isNotNull(), F.concat(direction, F.lit(" "), up.cast("string"), F.lit("/"), down.cast("string")))
    return F.concat_ws(" ", F.concat(F.lit("P"), persons.cast("string")), F.concat(F.lit("C"), cars.cast("string")), way, percent, cut)


def auto_event(matched: Column, direction: Column, matched_direction: Column) -> Column:
    """away for up, back for down, of matched clips; where both ways were crossed, the matched person's way counts."""
    way = F.when(direction == "both", matched_direction).otherwise(direction)
    return F.when(matched & (way == "up"), "away").when(matched & (way == "down"), "back")


# Reactions and their meaning.
UP, DOWN, THINKING, SHRUG = "\U0001f44d", "\U0001f44e", "\U0001f914", "\U0001f937"


def reaction_events(rows: DataFrame) -> DataFrame:
    """(message_id, kind): away for a thumb up, back for one down, further for thinking, negative for a shrug of any kind.

    ``rows`` has the reactions of a message after (new) and before (old) a change, and same_day. A thumb or shrug before
    the change is one remove, however many there were. Thumbs, added or removed, count on the message's own day only.
    """
    thumb = F.coalesce("same_day", F.lit(False))
    has = lambda c, e: F.coalesce(F.array_contains(c, e), F.lit(False))
    shrug = lambda c: F.coalesce(F.exists(c, lambda x: F.startswith(x, F.lit(SHRUG))), F.lit(False))
    kinds = (
        F.when(thumb & has("new", UP), "away"), F.when(thumb & has("new", DOWN), "back"), F.when(has("new", THINKING), "further"),
        F.when(shrug("new"), "negative"), F.when(thumb & (has("old", UP) | has("old", DOWN)) | shrug("old"), "remove"),
    )
    return rows.select("message_id", F.explode(F.array_compact(F.array(*kinds))).alias("kind"))


def message_day(explicit: Column, sent: Column, video: Column) -> Column:
    return F.coalesce(explicit, F.date_format(sent, "yyyyMMdd"), F.date_format(C.time_from_path(video), "yyyyMMdd"))


def to_worker_path(path: Column, master: str, worker: str) -> Column:
    """A master's path as a worker sees it: slashes always turn, and what lies below ``master``, in any case, moves below ``worker``."""
    turned = F.replace(path, F.lit("\\"), F.lit("/"))
    prefix = master.replace("\\", "/").rstrip("/") + "/"
    moved = F.concat(F.lit(worker.rstrip("/") + "/"), F.substring(turned, len(prefix) + 1, 1 << 20))
    return F.when(F.startswith(F.upper(turned), F.lit(prefix.upper())), moved).otherwise(turned)


def to_master_path(path: Column, master: str, worker: str) -> Column:
    """A worker's path as the master sees it: below ``worker``, in just that case, it moves and its slashes turn; others stay."""
    prefix = worker.rstrip("/") + "/"
    rest = F.replace(F.substring(path, len(prefix) + 1, 1 << 20), F.lit("/"), F.lit("\\"))
    return F.when(F.startswith(path, F.lit(prefix)), F.concat(F.lit(master.rstrip("\\") + "\\"), rest)).otherwise(path)


def translate_result(result: Column, local: str, share: str, master: str, worker: str) -> Column:
    """A worker's result struct with its paths as the master sees them: clip_path, insignificant_frames and reid.best_path.

    Files below ``local`` were copied below ``share``, so they are looked up there first; null and empty paths stay.
    """

    def moved(path: Column) -> Column:
        rest = F.substring(path, len(local.rstrip("/")) + 2, 1 << 20)
        shared = F.when(F.startswith(path, F.lit(local.rstrip("/") + "/")), F.concat(F.lit(share.rstrip("/") + "/"), rest)).otherwise(path)
        return F.when(path != "", to_master_path(shared, master, worker)).otherwise(path)

    out = result.withField("clip_path", moved(result["clip_path"])).withField("insignificant_frames", F.transform(result["insignificant_frames"], moved))
    reid = result["reid"].withField("best_path", moved(result["reid"]["best_path"]))
    return F.when(result["reid"].isNull(), out).otherwise(out.withField("reid", reid))


def tag_worker(line: Column) -> Column:
    """[W] after a line's video bracket, else after its level, else before it."""
    bracket, level = r"^(.*? - [A-Z]+ - \[[^\]]+\])\s*", r"^(.*? - [A-Z]+ - )"
    return (
        F.when(line.rlike(bracket), F.regexp_replace(line, bracket, "$1 [W] ")).when(line.rlike(level), F.regexp_replace(line, level, "$1[W] ")).otherwise(F.concat(F.lit("[W] "), line))
    )
