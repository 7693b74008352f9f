"""Near duplicates: DartMinHash sketches of word shingles, banded joining, exact check, components.

What is compared are distinct texts, by their 128-bit digests; copies of one text are one node whatever
their number and ids, and rows meet the class of their text only at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from .common import content, documents, scratch_table, slim, written
from .graph import components

#: 32 bands of 7 coordinates: a pair of similarity 0.8 shares a band with probability 0.9994, one of 0.5 with 0.22.
BANDS, ROWS = 32, 7
#: Texts of a bucket that are compared with as many others at a time, about.
BLOCK = 256
#: Digests that a task remembers, so as not to sketch a text again.
REMEMBERED = 200_000
SKETCH = "content binary, n_cells long, bands array<long>, cells binary"


def sketched(docs: DataFrame, width: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per text with at least one word, at least once: content (its digest), n_cells, bands and cells.

    Cells are the weighted shingles' unit cells as sorted unsigned 32-bit numbers: the j-th occurrence of
    a shingle is a cell of its own, so weighted Jaccard similarity is that of the cell sets.
    """

    def sketch(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from . import darts
        from .words import shingles, word_hashes

        def close(keys: list, cell: list) -> pa.RecordBatch:
            sizes = np.array([len(c) for c in cell])
            owner = np.repeat(np.arange(len(cell)), sizes)
            key = darts.bands(darts.sketches(np.concatenate(cell), owner, len(cell), bands * rows), rows)
            small = [np.unique((c >> np.uint64(32)).astype("<u4")).tobytes() for c in cell]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cell) + 1, dtype=np.int32) * bands), pa.array(key.ravel()))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([len(s) // 4 for s in small], pa.int64()), lists, pa.array(small, pa.binary())], ["content", "n_cells", "bands", "cells"])

        known: set = set()
        keys: list = []
        cell: list = []
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key in known:
                    continue
                if len(known) >= REMEMBERED:
                    known.clear()
                known.add(key)
                words = word_hashes(text.as_py())
                if not len(words):
                    continue
                keys.append(key)
                cell.append(darts.cells(shingles(words, width)))
                if sum(map(len, cell[-64:])) > 200_000 or len(cell) >= 256:
                    yield close(keys, cell)
                    keys, cell = [], []
        if keys:
            yield close(keys, cell)

    texts = documents(docs).where("doc_id is not null").select(content().alias("content"), "text")
    return texts.mapInArrow(slim(sketch), SKETCH)


def _similar(pairs: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose cell sets have a Jaccard similarity of at least ``threshold``.

    Many pairs may share their ``a``: its cells are looked up once and written, so that the join with
    them can split such pairs.
    """
    side = lambda x: cells.select(F.col("content").alias(x), F.col("n_cells").alias(f"n_{x}"), F.col("cells").alias(f"cells_{x}"))
    centres = written(pairs.select("a").distinct().join(side("a"), "a"))
    both = pairs.join(side("b"), "b").join(centres, "a").where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))

    def check(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(common >= threshold * (len(p) + len(q) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "cells_a", "cells_b").mapInArrow(slim(check), "a binary, b binary")


def near_classes(docs: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """Per distinct text with a word and an id: content, class_id (least doc_id of its class), class_size (rows) and first (whether it is the text of that id).

    Within a band's bucket pairs aren't expanded: every member is first compared with the bucket's least;
    where a bucket still holds several classes, all members outside its largest class are compared with
    all members in blocks, so no link between classes is lost.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # In a table by content, so that the joins of every round read the cells where they lie.
    sketches = scratch_table(sketched(docs, width).repartition(n, "content").dropDuplicates(["content"]), "content", n)
    cells = sketches.select("content", "n_cells", "cells")
    member = sketches.select("content", F.explode("bands").alias("bucket"))
    shared = written(member.groupBy("bucket").agg(F.min("content").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"))
    buckets = written(member.join(shared, "bucket"))

    stars = buckets.where("content <> least").select(F.col("least").alias("a"), F.col("content").alias("b")).distinct()
    links = written(_similar(written(stars), cells, threshold))
    labels = written(components(links))
    apart = _apart(buckets.select("bucket", "content"), labels)
    labels = written(components(links.unionByName(written(_across(apart, cells, threshold)))))

    rows = docs.where("doc_id is not null").select("doc_id", content().alias("content"))
    groups = written(rows.groupBy("content").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies")).join(sketches.select("content"), "content", "left_semi"))
    linked = written(groups.join(labels.withColumnRenamed("node", "content"), "content"))
    first = F.min_by("content", F.struct("least_id", "content"))
    classes = written(linked.groupBy("component").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"), first.alias("first")))
    of = linked.join(classes, "component").select("content", "class_id", "class_size", (F.col("content") == F.col("first")).alias("first"))
    return groups.join(of, "content", "left").select(
        "content", F.coalesce("class_id", "least_id").alias("class_id"), F.coalesce("class_size", "copies").alias("class_size"), F.coalesce("first", F.lit(True)).alias("first")
    )


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (least doc_id of its class), class_size, kept.

    Two texts are linked when the weighted Jaccard similarity of their word shingles (weight: number of
    occurrences; case and punctuation don't count) is at least ``threshold``; a class is what links
    connect. Null texts are empty; texts without a word and rows without an id link with nothing and are
    classes of their own. Rows that repeat an id have each the class of their own text; a row is kept if
    its id and text are the first of its class, so rows that are equal in both are kept together. Ids are
    of any type with an order. An empty table gives no rows.
    """
    classes = written(near_classes(docs, threshold, width))
    rows = docs.select("doc_id", content().alias("content"))
    out = rows.join(classes, "content", "left").select("doc_id", F.col("doc_id").isNotNull().alias("known"), "class_id", "class_size", "first")
    member = F.col("known") & F.col("class_id").isNotNull()
    own = F.when(member, F.col("class_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", own.alias("class_id"), F.when(member, F.col("class_size")).otherwise(F.lit(1)).cast("long").alias("class_size"), (F.col("doc_id").eqNullSafe(own) & (~member | F.col("first"))).alias("kept"))


def deduplicated(docs: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns. Rows are told apart by id and text."""
    classes = written(near_classes(docs, threshold, width))
    rows = docs.where("doc_id is not null").select("doc_id", content().alias("content"))
    dropped = rows.join(classes, "content").where("not first or doc_id <> class_id").select(F.col("doc_id").alias("_id"), F.col("content").alias("_content")).distinct()
    dropped = written(dropped)
    return docs.join(dropped, (docs["doc_id"] == dropped["_id"]) & (content() == dropped["_content"]), "left_anti")


def _apart(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with their classes, of the buckets that still hold several."""
    label = labels.select(F.col("node").alias("content"), "component")
    named = written(buckets.join(label, "content", "left").withColumn("class", F.coalesce("component", "content")).drop("component"))
    mixed = written(named.groupBy("bucket").agg(F.min("class").alias("c0"), F.max("class").alias("c1")).where("c0 < c1").select("bucket"))
    return written(named.join(mixed, "bucket"))


def _across(apart: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between classes that share a bucket: ``b`` is the class that text ``a`` has a link into.

    The texts outside a bucket's largest class are compared with all its members, a block of about
    BLOCK with another at a time, as products of two 0/1 matrices over the cells that both blocks have.
    Each pair of blocks is a row of its own, so a large bucket's are spread over tasks.
    """
    sizes = written(apart.groupBy("bucket", "class").count().groupBy("bucket").agg(F.max_by("class", "count").alias("main"), F.ceil(F.sum("count") / BLOCK).alias("blocks")))
    # The bucket itself is part of the hash, so that buckets' blocks differ.
    block = F.pmod(F.xxhash64("content", "bucket"), F.col("blocks")).alias("block")
    member = apart.join(sizes, "bucket").join(cells, "content").select("bucket", block, "blocks", "main", F.struct("content", "class", "cells").alias("m"))
    gathered = lambda rows, name: rows.groupBy("bucket", "block").agg(F.collect_list("m").alias(name), F.first("blocks").alias("blocks"))
    odd = gathered(member.where("m.class <> main"), "odd").select("bucket", "odd", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    pairs = odd.join(gathered(member, "all").drop("blocks"), ["bucket", "block"]).select("odd", "all")

    def compare(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def dense(sets: list, common) -> np.ndarray:
            out = np.zeros((len(sets), len(common)), np.float32)
            for i, x in enumerate(sets):
                out[i, np.searchsorted(common, np.intersect1d(x, common, assume_unique=True))] = 1
            return out

        for batch in batches:
            for odd, every in zip(batch.column(0), batch.column(1)):
                odd, every = odd.as_py(), every.as_py()
                x, y = ([np.frombuffer(m["cells"], "<u4") for m in side] for side in (odd, every))
                common = np.intersect1d(np.unique(np.concatenate(x)), np.unique(np.concatenate(y)), assume_unique=True)
                shared = np.zeros((len(x), len(y)), np.float32)
                for at in range(0, len(common), 8192):
                    some = common[at : at + 8192]
                    shared += dense(x, some) @ dense(y, some).T
                total = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])
                i, j = np.nonzero(shared >= threshold * (total - shared))
                edges = {(odd[a]["content"], every[b]["class"]) for a, b in zip(i.tolist(), j.tolist()) if odd[a]["class"] != every[b]["class"]}
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.binary()) for k in (0, 1)], ["a", "b"])

    return pairs.mapInArrow(slim(compare), "a binary, b binary")
