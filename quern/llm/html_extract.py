"""Main texts of web pages by a tree-structured graphical model over their elements."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

from .common import ship
from .html_tree import FEATURES, KINDS, Page
from .labelled_pages import labelled_page
from .tree_model import TreeModel, fit

#: Labelled pages the model is fitted on.
TRAINING_PAGES = 220


def states(page: Page) -> list[int]:
    """1 for nodes that hold a labelled content text, themselves or below."""
    own: list[int] = []
    for node in page.nodes:
        own.append(int(node.label) if node.label else own[node.parent] if node.parent >= 0 else 0)
    state = [0] * len(own)
    for i, _ in page.blocks:
        # Whatever holds content counts as content too, up to the root.
        at = i if own[i] else -1
        while at >= 0 and not state[at]:
            state[at], at = 1, page.parent[at]
    return state


@lru_cache(maxsize=1)
def trained(n: int = TRAINING_PAGES) -> TreeModel:
    """The model, fitted on the first ``n`` labelled pages; the same on every call."""
    pages = [Page(labelled_page(seed)) for seed in range(n)]
    return fit([(p.features, p.parent, p.kind, states(p)) for p in pages], len(FEATURES), max(KINDS.values()) + 2)


def main_text(html: str, model: TreeModel) -> str:
    """The blocks whose element is content with a probability of a half or more, one per line."""
    page = Page(html)
    marginal, _ = model.messages(page.features, page.parent, page.kind)
    return "\n".join(t for i, t in page.blocks if marginal[i] >= 0.5)


def extracted(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text (empty if there is none), n_chars (code points).

    A null html is an empty page; a null url stays null; repeated rows are extracted each; broken or
    truncated markup is read as far as it goes; an empty table gives no rows. Nothing is shuffled.
    """
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))

    def extract(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(h.as_py(), shared.value) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
