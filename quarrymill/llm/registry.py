"""The pN_ queries over the tables, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import read
from . import languages, main_content, mixing, neighbours, packing, sentences, source_files, splitting


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return main_content.p1_found(read(spark, d, "kb_documents"))


def p1_bodies(spark: SparkSession, d: str) -> DataFrame:
    return main_content.p1_bodies(read(spark, d, "kb_documents"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return source_files.p2_found(read(spark, d, "chunks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.p3_found(read(spark, d, "chunks"), read(spark, d, "lang_samples"))


def p3_languages(spark: SparkSession, d: str) -> DataFrame:
    return languages.p3_languages(read(spark, d, "chunks"), read(spark, d, "lang_samples"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.p4_found(read(spark, d, "chunks"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.p5_found(read(spark, d, "chunk_drafts"), read(spark, d, "kb_documents"), read(spark, d, "size_limits"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_items(splitting.with_limits(read(spark, d, "chunk_drafts"), read(spark, d, "kb_documents"), read(spark, d, "size_limits")))


def p5_files(spark: SparkSession, d: str) -> DataFrame:
    return splitting.p5_files(read(spark, d, "kb_documents"), read(spark, d, "size_limits"))


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.p6_packing(read(spark, d, "documents"), read(spark, d, "pack_capacities"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.p6_fill(read(spark, d, "documents"), read(spark, d, "pack_capacities"))


def p6_limits(spark: SparkSession, d: str) -> DataFrame:
    return packing.p6_limits(read(spark, d, "documents"), read(spark, d, "pack_capacities"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.p7_mixture(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.p7_shares(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.p8_found(read(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_bodies": p1_bodies,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_languages": p3_languages,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p5_files": p5_files,
    "p6_packing": p6_packing,
    "p6_fill": p6_fill,
    "p6_limits": p6_limits,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
}

ORACLE: dict[str, str] = {
    "p5_found": r"""
        WITH items AS (
            SELECT id AS item_id, any_value(content) AS t, CASE WHEN any_value(line_start) IS NULL THEN 'prose' ELSE 'code' END AS item
            FROM chunk_drafts WHERE id IS NOT NULL GROUP BY id
            UNION ALL
            SELECT source_id, any_value(body), 'document' FROM kb_documents WHERE source_id IS NOT NULL GROUP BY source_id),
        sized AS (
            SELECT item_id, t, max_tokens, chars_per_token,
                length(t) + len(regexp_extract_all(t, '[\x{10000}-\x{10FFFF}]')) AS units
            FROM items JOIN size_limits USING (item)),
        big AS (SELECT * FROM sized WHERE ceil(units / chars_per_token) > max_tokens)
        SELECT item_id,
            CASE WHEN len(list_filter(regexp_extract_all(t, '[^\s\p{Z}。！？]+'),
                lambda x: ceil((length(x) + len(regexp_extract_all(x, '[\x{10000}-\x{10FFFF}]'))) / chars_per_token) > max_tokens)) > 0
                THEN 'forced' ELSE 'natural' END AS cut
        FROM big""",
}
