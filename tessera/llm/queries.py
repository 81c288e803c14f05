"""The queries of this subpackage, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, exact_dedup, html_text, language_id, license_scan, line_dedup, mixing, packing, quality, simhash
from . import pipeline as corpus
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out, learn = language_id.training_rows(docs)
    model = language_id.fit(docs.where(learn))
    return language_id.identify(docs, model, F.col("doc_id"), held_out.alias("held_out"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_format.digests(chat_format.format_conversations(rows))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.curriculum(mixing.mix(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_line_dedup": op2_line_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_chat_format": op4_chat_format,
    "op5_mixing": op5_mixing,
    "op6_license_scan": op6_license_scan,
    "op7_html_text": op7_html_text,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_simhash": op10_simhash,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op4_chat_format": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        said AS (
            SELECT conv_id, count(*) AS n_turns, string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t) AS turns,
                   string_agg(CASE WHEN r = 'assistant' THEN t ELSE '' END, '' ORDER BY turn, r, t) AS loss,
                   sum(15 + length(r) + length(t) + length(regexp_replace(r || t, '[^\\<\[]', '', 'g'))) AS chars
            FROM rows GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
               CAST(chars AS BIGINT) AS formatted_chars
        FROM said""",
    "op5_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   md5(coalesce(CAST(doc_id AS VARCHAR), '?') || ' ' || coalesce(text, '')) AS place FROM documents),
        totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS has FROM sized GROUP BY source),
        weighed AS (
            SELECT source, has, has * 3.0::DOUBLE AS cap, CAST(sum(has) OVER () AS DOUBLE) AS total,
                   CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w FROM totals),
        levels AS (
            SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS rank,
                   (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM weighed),
        wanted AS (
            SELECT source, has, least(cap, w * (SELECT arg_min(level, rank) FROM levels WHERE level <= cap / w)) AS target FROM levels),
        placed AS (
            SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sized)
        -- Constant weights: the middle of what is read first, as a share of the source's words, is its training position.
        SELECT doc_id, size, has AS source_size, round(target, 6) AS target,
               CASE WHEN least(size, round(target) - start) > 0 THEN round((start + least(size, round(target) - start) / 2) / target, 9) END AS position,
               CAST(greatest(0, least(size, round(target) - start)) + greatest(0, least(size, round(target) - start - has))
                    + greatest(0, least(size, round(target) - start - 2 * has)) AS BIGINT) AS taken
        FROM placed JOIN wanted ON placed.source IS NOT DISTINCT FROM wanted.source""",
}
