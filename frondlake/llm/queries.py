"""One query per operator over its whole table: ``(spark, folder) -> DataFrame``."""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import configure
from . import bpe, chat, html_text, langid, licenses, merkle, mixing, near_dedup, order_minhash, pii, quality, sharding, spelling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def query(function):
    QUERIES[function.__name__] = lambda spark, folder: function(configure(spark), folder)
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


DECIMAL = [str(i) for i in range(1 << 16)]  # ids of the vocabulary as text


def token_digest(ids: list[int], decoded: str) -> tuple[int, str, str]:
    return (len(ids), hashlib.sha256(" ".join(map(DECIMAL.__getitem__, ids)).encode()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest())


TOKEN_DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                             T.StructField("decoded_sha256", T.StringType())])


@query
def op3_byte_bpe(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, RANKS, PATTERN, token_digest, TOKEN_DIGEST)


@query
def op10_pii(spark, folder):
    found = pii.with_spans(table(spark, folder, "documents").select("doc_id", "text"), spans="found").drop("text")
    base = F.filter("found", lambda s: s.base)

    def count(kind):
        return F.size(F.filter(base, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    counts = map(count, pii.KINDS)
    return found.select("doc_id", *counts, F.sha2(pii.spelled_out(base), 256).alias("base_sha256"),
                        pii.spelled_out(F.col("found")).alias("spans"))


@query
def op4_license_scan(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return licenses.scan(docs).select("doc_id", *licenses.RESULT)


ORACLE["op4_license_scan"] = licenses.sql()


@query
def op8_quality_rules(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return quality.rules(docs).select("doc_id", *quality.DIGEST)


ORACLE["op8_quality_rules"] = quality.sql()


@query
def op2_shards(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32")
    return sharding.assign(docs, shards=8, extra=[crc]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op6_source_mix(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "source", mixing.tokens("text").alias("n_tokens"), "mix_pass")


ORACLE["op6_source_mix"] = mixing.sql()


@query
def op7_near_duplicates(spark, folder):
    found = near_dedup.classes(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(F.col("key").alias("doc_id"), "class_id", F.col("key").eqNullSafe(F.col("class_id")).alias("kept"))


@query
def op5_order_minhash(spark, folder):
    return order_minhash.fingerprint_edits(table(spark, folder, "documents"))


@query
def op1_language_id(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    known = docs.withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.fit(known.where(~F.col("held_out")))
    return langid.predict(known.select("doc_id", "held_out", "text"), model).drop("text")


@query
def op9_html_text(spark, folder):
    pages = html_text.extract(table(spark, folder, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op11_merkle_manifest(spark, folder):
    """Every row of ``documents`` folded to the root, rows of some ids with lower-cased text."""
    docs = table(spark, folder, "documents")
    number = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    found = merkle.leaf([lowered if c == "text" else F.col(c) for c in merkle.FIELDS])
    return merkle.verify(docs, F.when(number % 5 == 0, found))


ORACLE["op11_merkle_manifest"] = merkle.sql()


@query
def op12_chat_windows(spark, folder):
    """All ``conversations`` and one that holds control strings, formatted and read back."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], turns.schema)
    return chat.round_trip(turns.unionByName(more))


ORACLE["op12_chat_windows"] = chat.sql()


@query
def op13_spelling_variants(spark, folder):
    """All words of ``documents`` with their near words."""
    return spelling.variants(table(spark, folder, "documents"))


ORACLE["op13_spelling_variants"] = spelling.sql()
