"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodekey.llm import bpe, chat, chunking, media, packing, sharding, simhash, suffixes, toxicity, warc
from lodekey.llm.staging import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.captures(spark, table(spark, sf_dir, "pages"))
    said = [F.col("request.fields")["request"].alias("request_line"), F.col("metadata.fields")["via"].alias("metadata_via"), F.col("metadata.fields")["fetchedBytes"].cast("long").alias("metadata_fetched_bytes")]
    return got.select("page_id", F.col("payload_bytes").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "url", *said)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"])


def op9_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fingerprint_documents(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = chat.canonical_turns(table(spark, sf_dir, "conversations")).unionByName(chat.canonical_turns(extra))
    return chat.chat_digests(chat.read_chats(chat.format_chats(turns)))


def _escaped_sql(col: str) -> str:
    out = f"replace({col}, '\\', '\\\\')"
    for c in chat.CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


_LAYOUT = len(chat.START) + len(chat.SEP) + len(chat.END)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_media_columns": op3_media_columns,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_chat_format": op5_chat_format,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_kd_sharding": op9_kd_sharding,
    "op10_chunk_fingerprints": op10_chunk_fingerprints,
}

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_SHA1_BASE32 = f"""array_to_string(list_transform(range(32), lambda i: substr('{_BASE32}', ((('0x' || substr(hex, ((i // 8) * 10 + 1)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT + 1, 1)), '')"""

ORACLE_SQL: dict[str, str] = {
    "op1_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex,
            coalesce(replace(replace(url, chr(13), '%0D'), chr(10), '%0A'), 'about:blank') AS url FROM pages),
        o AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS owner FROM p)
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_SHA1_BASE32} AS payload_digest,
            CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> owner THEN owner END AS refers_to,
            url, 'GET ' || url || ' HTTP/1.1' AS request_line, url AS metadata_via, strlen(html)::BIGINT AS metadata_fetched_bytes
        FROM o""",
    "op5_chat_format": f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), g AS (
            SELECT conv_id, count(*) AS n,
                string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
                coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
                sum(length({_escaped_sql("role")}) + length({_escaped_sql("text")}) + {_LAYOUT}) AS size
            FROM t GROUP BY conv_id
        )
        SELECT conv_id, n::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
            sha256(loss) AS loss_sha256, size::BIGINT AS formatted_chars
        FROM g""",
}
