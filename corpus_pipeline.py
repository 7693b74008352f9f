"""A training-data pipeline over documents: quality, exact and near copies, benchmark passages, packing.

Each stage takes all rows that its predecessor kept and is written before the next one reads it. All
stages but the last return the columns of documents, whatever other columns and types these have. A null
text is an empty one; rows with a null id stay where a stage has nothing against their text; rows are kept
or dropped by their text (and id), never for another row that repeats their id; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm import quality
from quern.llm.common import content, remove_scratch, scratch_dir, scratch_mark, written
from quern.llm.decontaminate import contaminated
from quern.llm.exact_dedup import deduplicated as exact_dedup_op
from quern.llm.near_dedup import deduplicated as near_dedup_op
from quern.llm.packing import packed


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is below 0.7. Labels of held-out ids aren't learned from.

    Rows of equal texts score alike; without labels every score is 0.5 and nothing is kept.
    """
    return quality.kept(docs, quality.fit(docs, _table(spark, sf_dir, "labels"), "quality"), threshold=0.7)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of smallest doc_id of texts that are equal but for the case of A-Z; a null id stays only without others, of rows equal in both one."""
    return exact_dedup_op(docs, keep="smallest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each class of near copies (five-word shingles, similarity 0.8).

    Texts without a word and rows without an id stay; of rows that share an id each has the class of its own text.
    """
    return near_dedup_op(docs, threshold=0.8, width=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text holds a benchmark item: the search knows texts by their digests, so another row with the same id stays."""
    texts = docs.select(content().alias("doc_id"), "text")
    found = written(contaminated(texts, _table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_content")).distinct())
    return docs.join(found, content() == found["_content"], "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of up to 2048 tokens, a row per piece; an empty text is its end id alone."""
    import public_tokenizers

    return packed(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: Scores, sketches and latent retrieval aren't SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and read again; a stage's own scratch goes once it is written."""
    docs = _table(spark, sf_dir, "documents")
    path = scratch_dir(spark)
    for i, (_, stage) in enumerate(STAGES[:-1]):
        mark = scratch_mark()
        result = stage(spark, docs, sf_dir)
        result.write.parquet(f"{path}/{i}")
        remove_scratch(spark, mark)
        docs = spark.read.schema(result.schema).parquet(f"{path}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
