"""Running sums and maxima along an order, in chunks, so that a hot key is no single task's work.

Rows of a key are cut into chunks of consecutive order numbers. A window runs inside each chunk, and a
second one over the chunks' totals, which are ``CHUNK`` times fewer; what a chunk begins with comes back
by a join on key and chunk. No task holds or sorts more of a key than a chunk of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Order numbers to a chunk.
CHUNK = 1 << 16


def chunk_of(order: str, size: int = CHUNK) -> Column:
    """The chunk of an order number; rows without a number share one."""
    return F.coalesce(F.floor(F.col(order) / size), F.lit(-1))


def running(rows: DataFrame, keys: list[str], order: str, value: str, how: str, name: str, size: int = CHUNK) -> DataFrame:
    """``rows`` with ``name``: the ``sum`` (0 at first) or ``max`` (null at first) of ``value`` over a key's earlier rows.

    ``order`` is a number that ascends along a key's rows; of equal numbers any may come first.
    """
    combine = {"sum": F.sum, "max": F.max}[how]
    before = lambda *by: Window.partitionBy(*by)
    upto = lambda w, o: w.orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
    chunked = rows.withColumn("_chunk", chunk_of(order, size))
    totals = chunked.groupBy(*keys, "_chunk").agg(combine(value).alias("_total")).withColumn("_carry", combine("_total").over(upto(before(*keys), "_chunk"))).drop("_total")
    within = chunked.withColumn("_within", combine(value).over(upto(before(*keys, "_chunk"), order)))
    both = F.coalesce("_carry", F.lit(0)) + F.coalesce("_within", F.lit(0)) if how == "sum" else F.greatest("_carry", "_within")
    same = [within[k].eqNullSafe(totals[k]) for k in (*keys, "_chunk")]
    return within.join(totals, same).select(*[within[c] for c in rows.columns], both.alias(name))


def floored_totals(steps: DataFrame, keys: list[str], order: str, value: str, name: str, size: int = CHUNK) -> DataFrame:
    """Per key the end of a count that begins at 0, takes each ``value`` in ``order`` and never falls below 0.

    That end is ``total - least(0, lowest partial sum)``; both compose over chunks. Of equal order numbers the lower value comes first.
    """
    chunked = steps.withColumn("_chunk", chunk_of(order, size))
    upto = Window.partitionBy(*keys, "_chunk").orderBy(order, value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = chunked.withColumn("_low", F.sum(value).over(upto)).groupBy(*keys, "_chunk").agg(F.sum(value).alias("_total"), F.min("_low").alias("_low"))
    before = F.coalesce(F.sum("_total").over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("_low", before + F.col("_low")).groupBy(*keys).agg((F.sum("_total") - F.least(F.lit(0), F.min("_low"))).alias(name))
