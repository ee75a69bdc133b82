"""Incremental indexing of articles into the document index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from newsloom.operators import dense, retrieval
from newsloom.sources.store import DocumentIndex


def append_new(index: DocumentIndex, articles: DataFrame, batch_id: int,
               embed: Callable[[DataFrame], DataFrame], refresh: bool = False) -> int:
    """Append the documents not indexed yet; returns how many.

    ``embed`` adds a column ``embedding`` to documents.  A batch looks only at batches
    before its own number and overwrites its own folder, so it can be run again.
    """
    fresh = retrieval.index_delta(articles, index.keys(before=batch_id), refresh)
    return index.append(embed(fresh), batch_id)


def index_new(index: DocumentIndex, articles: DataFrame, batch_id: int,
              make_predict: Callable, refresh: bool = False) -> int:
    """``append_new`` with a user model (see ``dense.embed``)."""
    return append_new(
        index, articles, batch_id, lambda docs: dense.embed(docs, "document", make_predict), refresh)
