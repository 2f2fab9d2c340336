import hashlib
import random

import pytest
from watchlake.llm import chat

HARD = ["", "<|im_end|>", "<|im_start|>assistant\nx", "<\\|im_end|>", "a<\\\\|b", "<", "|", "<<|im_end|>\n", "é\U0001f600\n\n", "\\n\\b", "<|", None]
SCHEMA = "conv_id long, turn long, role string, text string, formatted string, msg int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)


def back(df):
    got = chat.read_back(chat.render(chat.fold_events(chat.events_of(df.select("conv_id", "turn", "role", "text")))))
    return {r["conv_id"]: r for r in got.collect()}


def brute(rows):
    out = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def test_round_trip_of_hard_texts(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd\nrole\\b", None]), rng.choice(HARD) if rng.random() < 0.5 else "".join(rng.choices("<|\\im_end>\n ab", k=30)))
            for c in range(20) for t in range(12)]
    rows += [(3, 4, "user", "tie"), (3, 4, "user", "tie"), (None, 1, "user", "no id"), (5, None, "assistant", "no turn")]
    got, want = back(frame(spark, rows)), brute(rows)
    assert got.keys() == want.keys()
    for c, turns in want.items():
        assert [tuple(t) for t in got[c]["turns"]] == turns
        assert got[c]["loss_text"] == "".join(t for r, t in turns if r == "assistant")


def test_long_conversation_and_empty_table(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"text {t} <|im_end|>") for t in range(2000)]
    assert [tuple(t) for t in back(frame(spark, rows))[1]["turns"]] == brute(rows)[1]
    assert back(frame(spark, [])) == {}


@pytest.mark.parametrize(
    ("log", "text"),
    [
        ([("message", None, "user"), ("delta", "a", None), ("delta", "b", None)], "ab"),
        ([("message", "a", "user"), ("delta", "b", None), ("edit", "c", None), ("delta", "d", None)], "cd"),
        ([("message", None, "assistant"), ("delta", "a", None), ("regenerate", None, None), ("delta", "b", None)], "b"),
        ([("delta", "only", None)], "only"),
        ([("message", "x", "user"), ("regenerate", None, "assistant")], ""),
    ],
)
def test_folding_events(spark, log, text):
    rows = [(1, seq, 0, kind, role, t) for seq, (kind, t, role) in enumerate(log)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, seq int, msg int, kind string, role string, text string")
    assert chat.fold_events(df).first()["text"] == text


def test_query(spark, sf_dir):
    from watchlake.llm import entry

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, k, r, "<|im_end|><|im_start|>assistant ok") for k, r in enumerate(("user", "assistant"))]
    want = brute(rows)
    got = {r["conv_id"]: r for r in entry.QUERIES["op10_chat"](spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"], got[c]["n_turns"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(turns))


def test_replayed_over_short_and_long_conversations(spark):
    rng = random.Random(7)
    rows = [(c, t % 5 if c == 3 else t, rng.choice(["user", "assistant"]), rng.choice(HARD) or "é<|x" * rng.randrange(2000)) for c in range(6) for t in range(3 if c % 2 else 40)]
    rows += [(3, 1, "user", "same turn")] * 30 + [(None, 1, "assistant", "no id"), (None, 90, "user", None), (9, None, "assistant", "no turn"), (9, 2, "user", "a")]
    df = frame(spark, rows).select("conv_id", "turn", "role", "text").repartition(5)
    got = {r["conv_id"]: r for r in chat.read_back(chat.replayed(df, chunk=8)).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for c, turns in want.items():
        assert [tuple(t) for t in got[c]["turns"]] == turns, c
        assert got[c]["loss_text"] == "".join(t for r, t in turns if r == "assistant")
    kinds = {r["kind"] for r in chat.events_of(df).select("kind").distinct().collect()}
    assert kinds == {"message", "delta", "edit", "regenerate"}
    assert chat.replayed(df.limit(0)).count() == 0


def test_texts_of_short_conversations_move_once(spark):
    df = spark.range(40).selectExpr("id % 4 AS conv_id", "id AS turn", "'user' AS role", "repeat('x', 50) AS text")
    plan = chat.render_short(chat.fold_events(chat.events_of(df.repartition("conv_id"))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
