"""The queries of this subpackage with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import licenses, quality
from .common import scratch_dir
from .decontaminate import contaminated
from .exact_dedup import exact_duplicates
from .html_extract import extracted
from .near_dedup import near_duplicates
from .packing import packed
from .suffix_dedup import repeats_removed
from .token_count import token_counts
from .token_output import read_token_files, write_token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    write_token_files(_table(spark, sf_dir, "documents"), path, _tokenizer("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, path)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), limit=4096)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=1)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_removed(_table(spark, sf_dir, "documents"), length=100).drop("kept")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, _table(spark, sf_dir, "labels"), "quality"), threshold=0.7)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(_table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_table(spark, sf_dir, "documents")).withColumn("notices", F.array_join("notices", ","))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"), keep="largest")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), threshold=0.8, width=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_files, op2_token_counts, op3_packing, op4_suffix_dedup, op5_quality, op6_html_extraction, op7_decontamination, op8_license_scan, op9_exact_dedup, op10_near_dedup)
}

_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op8_license_scan": licenses.oracle_sql(),
    "op9_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_NORM} AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.norm) AS text_sha256
        FROM d JOIN g USING (norm)""",
}
