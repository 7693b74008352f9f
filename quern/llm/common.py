"""What the training-data operators share: inputs, scratch tables, bounded pieces of long texts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Texts longer than this are tokenised or scanned piece by piece, so a task holds little beside the text itself.
PIECE_CHARS = 1_000_000
_CUT = re.compile("(?<=[^ ▁]) ")  # the second is how a tokenizer writes a space


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, whatever their working folder is."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (known, root)))


def documents(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Just ``key`` and ``text``, null texts as empty ones; other columns, whatever their names, fall away."""
    ship(df.sparkSession)
    return df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text))


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share: below spark.checkpoint.dir, or a local one where that is unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/quern-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


#: Scratch folders and tables that this process has made and not removed yet.
_SCRATCH: list[str] = []


def scratch_table(df: DataFrame, by: str, partitions: int) -> DataFrame:
    """``df``, already dealt out by ``by``, written once as a table of the warehouse that joins by ``by`` read where it lies."""
    name = f"quern_{uuid.uuid4().hex}"
    df.write.bucketBy(partitions, by).sortBy(by).option("compression", "zstd").saveAsTable(name)
    _SCRATCH.append(f"table {name}")
    return df.sparkSession.table(name)


def scratch_mark() -> int:
    """What scratch there is now, to be given to ``remove_scratch``."""
    return len(_SCRATCH)


def remove_scratch(spark: SparkSession, mark: int = 0) -> None:
    """Removes the scratch made since ``mark``; results that still read it must have been written before."""
    while len(_SCRATCH) > mark:
        what = _SCRATCH.pop()
        if what.startswith("table "):
            spark.sql(f"DROP TABLE IF EXISTS {what.removeprefix('table ')}")
        else:
            path = spark._jvm.org.apache.hadoop.fs.Path(what)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def content(text: str = "text") -> Column:
    """A text's 128-bit digest; a null text is an empty one."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def arrow_type(df: DataFrame, column: str):
    """The Arrow type of a column."""
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: its lineage ends there.

    A group's aggregate is written before rows are joined with it by the same key: the two are dealt out
    each for itself then, and Spark can split a hot key's rows among tasks.
    """
    path = scratch_dir(df.sparkSession)
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slim(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``function``, for mapInArrow, after whose end a task gives back what memory it has freed.

    Spark keeps a Python worker for other tasks, and without this all that any of them once held.
    """

    def run(batches: Iterator) -> Iterator:
        yield from function(batches)
        release()

    return run


def release() -> None:
    """Gives freed memory of this process back to the system, where the C library can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` cut before spaces that follow another character, into pieces of about ``limit`` characters.

    A run without such a space stays whole.
    """
    at = 0
    while len(text) - at > limit and (cut := _CUT.search(text, at + limit)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text
