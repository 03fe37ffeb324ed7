"""The corpus pipeline: raw documents in, a mixed, clean and encoded corpus out.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``; ``run``
writes what a stage returns as Parquet below ``spark.checkpoint.dir`` and reads it
again as the input of the next. All stages but the last return the columns of
``docs``.

1. ``language_id`` learns from the labelled rows and drops documents whose text is
   null, has no letter, or whose language is uncertain (probability below
   ``MIN_SCORE``). A missing label is filled with the prediction.
2. ``near_dedup`` keeps one document of each class of near duplicates, the one
   with the smallest doc_id.
3. ``pii`` replaces personal data by marks and sets n_chars anew.
4. ``source_mix`` repeats documents of small sources, at most ``MAX_REPEATS`` times,
   to flatten the mix; every document stays in it at least once.
5. ``byte_bpe`` adds the token ids and checks that they decode to the text.

Null and empty texts and an empty table pass every stage without error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frondlake.llm import bpe, langid, mixing, near_dedup, pii
from frondlake.llm.queries import PATTERN, RANKS
from frondlake.session import configure, cut_lineage

MIN_SCORE = 0.4
MAX_REPEATS = 2.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    if docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).isEmpty():
        return docs.where(F.col("text").rlike(r"\p{L}"))  # nothing to learn from: only texts without letters go
    found = langid.predict(docs, langid.fit(docs), label="_lang", score="_score")
    kept = found.where((F.col("_lang") != langid.UNKNOWN) & (F.col("_score") >= MIN_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "_lang")).select(*docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return pii.redact(docs, length="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return mixing.mix(docs, max_repeats=MAX_REPEATS).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``lang``, ``source``, ``n_tokens``, ``ids``; an encoding that doesn't decode to its text is an error."""
    configure(spark)
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), RANKS, PATTERN, check=True)
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable]] = [
    ("language_id", language_id), ("near_dedup", dedup), ("pii", redact), ("source_mix", mix), ("byte_bpe", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
