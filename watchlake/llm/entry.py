"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchlake.llm import chat, decontaminate, html, licenses, lm, media, merkle, mixing, quality, runs, simhash, substrings, toxicity
from watchlake.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; nulls, repeats, long texts and empty tables as in ``simhash.near_duplicates``."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_html": html.op2_html,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_mixing": mixing.op4_mixing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_media": media.op6_media,
    "op7_quality": quality.op7_quality,
    "op8_licenses": licenses.op8_licenses,
    "op9_lm": lm.op9_lm,
    "op10_chat": chat.op10_chat,
    "op11_runs": runs.op11_runs,
    "op12_merkle": merkle.op12_merkle,
    "op13_substrings": substrings.op13_substrings,
}
ORACLES: dict[str, str] = {"op3_decontaminate": decontaminate.OP3_SQL, "op10_chat": chat.OP10_SQL, "op12_merkle": merkle.OP12_SQL, "op13_substrings": substrings.OP13_SQL}
