"""Chat formatting: event logs folded into messages, rendered with a loss mask, and read back.

An event log has conv_id, seq (order within the conversation), msg (place of the message that the event is
about), kind, role and text. Kinds: ``message`` opens a message (and may carry text), ``delta`` appends
streamed text, ``edit`` replaces the text by its own, ``regenerate`` discards the text, after which new deltas
follow. Everything here is built from DataFrame functions.

Texts are shuffled once: a table that is partitioned by conversation stays so through ordering, folding and rendering.
Long conversations are partitioned by runs of places as well, and their runs are joined in a second shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchlake.llm.common import materialize, table

START, END = "<|im_start|>", "<|im_end|>\n"
RESETS = ("message", "edit", "regenerate")
CHUNK = 256  # places of a run
PIECES, PIECE = 16, 400  # a streamed text has so many deltas at most, of so many characters at least


def escape(text: Column) -> Column:
    r"""Texts can't hold a control string: ``<|`` gets a backslash inside, ``<\|`` one more, and so on."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    r"""Roles end at a newline, so their own newlines and backslashes become ``\n`` and ``\b``."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def _keys(rows: DataFrame) -> list[str]:
    return [c for c in ("conv_id", "run") if c in rows.columns]


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, msg, role, text): the final messages; a column ``run``, if there is one, stays with its message.

    A message's text is that of its last ``message``, ``edit`` or ``regenerate`` event and of all deltas after
    it, by seq; events of one seq go by kind and text. Its role is the last one given, and empty if there is
    none. Null texts are empty; deltas without any opening event still make a message. Repeated events count each.
    Conversations and messages with null keys are groups like any other. A group is one message, however long its
    conversation. An empty log has no messages. Other columns aren't read.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))))
    found = events.groupBy(*_keys(events), "msg").agg(ordered.alias("log"))
    last = F.coalesce(F.array_max(F.transform("log", lambda e, i: F.when(e["kind"].isin(*RESETS), i))), F.lit(0))
    roles = F.filter("log", lambda e: e["role"].isNotNull())
    kept = F.slice("log", last + 1, F.greatest(F.lit(1), F.size("log") - last))
    return found.select(
        *_keys(events), "msg",
        F.when(F.size(roles) > 0, F.element_at(roles, -1)["role"]).otherwise("").alias("role"),
        F.array_join(F.transform(kept, lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame, trained: str = "assistant", chunk: int = CHUNK) -> DataFrame:
    """(conv_id, formatted, segments): one row per conversation, its messages by msg.

    ``segments`` are the pieces of ``formatted`` in order, each with ``loss``: true for the (escaped) texts of
    the trained role. ``msg`` is a struct whose first field is the place, or a number. Messages that have no ``run``
    yet get one, and long conversations are joined in runs first, so that no task sorts a whole hot one. Where ``run``
    is null for all, conversations are joined at once. Texts may hold anything, control strings too. Repeated
    places keep all their messages; an empty table gives an empty result.
    """
    if "run" not in messages.columns:
        kind = messages.schema["msg"].dataType
        place = F.col("msg").getField(kind.names[0]) if kind.typeName() == "struct" else F.col("msg")
        messages = messages.withColumn("run", F.floor(place / chunk))
    rows = messages.select("conv_id", "run", F.struct("msg", _turn(trained).alias("turn")).alias("row"))
    runs = rows.groupBy("conv_id", "run").agg(_in_order("row", "turn").alias("turns"))
    return _with_text(runs.groupBy("conv_id").agg(_in_order(F.struct("run", "turns"), "turns").alias("segments")))


def _turn(trained: str) -> Column:
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    return F.array(
        piece(F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")), F.lit(False)),
        piece(escape(F.col("text")), F.col("role") == trained),
        piece(F.lit(END), F.lit(False)),
    )


def _in_order(rows, field: str) -> Column:
    return F.flatten(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x[field]))


def _with_text(rendered: DataFrame) -> DataFrame:
    return rendered.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def render_short(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """As ``render``, for conversations of bounded length: one aggregation by conversation; nulls, ties and empty tables as there."""
    rows = messages.select("conv_id", F.struct("msg", _turn(trained).alias("turn")).alias("row"))
    return _with_text(rows.groupBy("conv_id").agg(_in_order("row", "turn").alias("segments")))


def replayed(rows: DataFrame, trained: str = "assistant", chunk: int = CHUNK) -> DataFrame:
    """(conv_id, formatted, segments) of finished conversations (conv_id, turn, role, text), by way of their event logs.

    Conversations of at most ``chunk`` rows that all lie in one run of turns are partitioned by conversation once. The
    others are partitioned by runs, which are joined at the end. Nulls, ties and repeats are as in ``events_of``.
    """
    run = F.floor(F.col("turn") / chunk)
    spans = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.min(run).alias("lo"), F.max(run).alias("hi"))
    long_ = materialize(spans.where((F.col("n") > chunk) | (F.col("lo") < F.col("hi"))).select(F.col("conv_id").alias("long_id")), "long")
    is_long = rows["conv_id"].eqNullSafe(long_["long_id"])
    if not long_.limit(1).count():
        return render_short(fold_events(events_of(rows.repartition("conv_id"))), trained)
    short = rows.join(long_, is_long, "left_anti").repartition("conv_id")
    some = rows.join(long_, is_long, "left_semi").withColumn("run", run).repartition("conv_id", "run")
    return render_short(fold_events(events_of(short)), trained).unionByName(render(fold_events(events_of(some)), trained))


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted): turns (role, text) parsed from ``formatted``; the text under the loss mask.

    A conversation without messages has no turns and an empty loss text; empty roles and texts, ties, repeated messages and texts
    of any length come back as they went in; an empty table stays empty. Columns of other names aren't kept.
    """
    cut = F.split("formatted", r"<\|im_end\|>\n", -1)
    bodies = F.transform(F.slice(cut, 1, F.size(cut) - 1), lambda t: F.substr(t, F.lit(len(START) + 1)))

    def parse(body: Column) -> Column:
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substr(body, F.length(role) + 2)).alias("text"))

    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return rendered.select("conv_id", F.transform(bodies, parse).alias("turns"), loss.alias("loss_text"), "formatted")


def events_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, msg, seq, kind, role, text): event logs that end in the given conversations; ``run`` stays, if given.

    A row opens a message and streams its text in deltas. By hash of the text, a third of the rows stream a beginning
    that a regeneration discards, and a third a draft that an edit replaces by the text's beginning. Null texts are
    empty. Rows of a conversation go by turn; rows that share a turn by role and text, all of them kept.
    """
    nth = F.row_number().over(Window.partitionBy(*_keys(conversations), "turn").orderBy("role", "text"))
    rows = conversations.select(*_keys(conversations), F.struct("turn", nth.alias("nth")).alias("msg"), "role", F.coalesce("text", F.lit("")).alias("text"))
    size = F.greatest(F.lit(PIECE), F.ceil(F.length("text") / PIECES)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / size).cast("int")), lambda i: F.substring(F.col("text"), i * size + 1, size))
    event = lambda kind, text, role=F.lit(None).cast("string"): F.struct(F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    stream = lambda parts: F.transform(parts, lambda x: event("delta", x))
    opens, first = F.array(event("message", F.lit(""), F.col("role"))), F.element_at("pieces", 1)
    rest = F.slice("pieces", 2, F.greatest(F.size("pieces") - 1, F.lit(0)))
    way = F.pmod(F.xxhash64("text"), F.lit(3))
    log = (
        F.when(way == 0, F.concat(opens, stream(F.col("pieces"))))
        .when(way == 1, F.concat(opens, F.array(event("delta", first), event("regenerate", F.lit(""))), stream(F.col("pieces"))))
        .otherwise(F.concat(opens, F.array(event("delta", F.lit("draft")), event("edit", first)), stream(rest)))
    )
    rows = rows.withColumn("pieces", pieces).select(*_keys(rows), "msg", F.posexplode(log).alias("seq", "event"))
    return rows.select(*_keys(rows), "msg", "seq", "event.kind", "event.role", "event.text")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation and of conversation -1, read back from what was rendered.

    Null texts are empty; rows that share a turn, also repeated ones, are messages of their own by role and text; rows without
    a conv_id are one conversation of that id. Texts of any length are rendered whole, and of an empty table
    conversation -1 is left. Other columns aren't read.
    """
    hard = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(replayed(rows))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) r(i))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(role)
    + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g'))) AS BIGINT) AS formatted_chars
FROM rows_ GROUP BY conv_id
"""
