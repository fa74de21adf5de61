"""Extension points: what the stages of a pipeline take and give, as small protocols, and the built-in parts that meet them.

Every stage works on DataFrames or Columns, so a replacement is a function of the same shape; ``Pipeline`` holds one of
each and ``DEFAULT`` is what ``cairn.engine`` uses.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators import chunking, cleaning, contract, ranking, serving, store
from cairn.operators.discovery import select_urls
from cairn.sources import search


@runtime_checkable
class QueryPlanner(Protocol):
    def __call__(self, text: str) -> list[str]: ...


@runtime_checkable
class SearchDiscovery(Protocol):
    """Sub-queries (a column ``subquery``) to hits."""

    def __call__(self, subqueries: DataFrame) -> DataFrame: ...


@runtime_checkable
class SelectionPolicy(Protocol):
    """Hits with scores to the chosen ones of each group."""

    def __call__(self, hits: DataFrame, group_col: str, id_col: str, max_urls: int) -> DataFrame: ...


@runtime_checkable
class ContentExtractor(Protocol):
    """Requested URLs to one outcome each."""

    def __call__(self, requests: DataFrame, pages: DataFrame) -> DataFrame: ...


@runtime_checkable
class StructuredDataExtractor(Protocol):
    """Markdown and a schema to (JSON data, JSON evidence by pointer)."""

    def __call__(self, markdown: str, schema: dict) -> tuple[str, str]: ...


@runtime_checkable
class PageCacheRepository(Protocol):
    """Requests to requests with the cached page of their key."""

    def __call__(self, requests: DataFrame, cache: DataFrame, key_col: str, now: float) -> DataFrame: ...


@runtime_checkable
class MarkdownCleaner(Protocol):
    def __call__(self, markdown: Column) -> Column: ...


@runtime_checkable
class SemanticChunker(Protocol):
    """Texts to rows of spans."""

    def __call__(self, df: DataFrame, id_col: str, text_col: str, version: Column, largest: Column, smallest: Column, segment: Column) -> DataFrame: ...


@runtime_checkable
class CandidatePrefilter(Protocol):
    def __call__(self, chunks: DataFrame, source_col: str, score_col: str, index_col: str, keep: int) -> DataFrame: ...


@runtime_checkable
class Reranker(Protocol):
    """A query and texts to one score per text; a batch at a time in executors."""

    def __call__(self, query: str, texts: list[str]) -> list[float]: ...


@runtime_checkable
class ResultAssembler(Protocol):
    """Scored passages to those within a budget of tokens, in order."""

    def __call__(self, scored: DataFrame, group_col: str, order: list[Column], budget: int) -> DataFrame: ...


@runtime_checkable
class EmbeddingFunction(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


@runtime_checkable
class BaseChunker(Protocol):
    """A text to (start, end, words, strategy) of its chunks."""

    def __call__(self, text: str | None) -> list[tuple[int, int, int, str]]: ...


def identity_planner(text: str) -> list[str]:
    return [text]


def no_model(markdown: str, schema: dict) -> tuple[str, str]:
    """The disabled extractor: no data, which ``contract.evidence_fields`` reports as invalid."""
    return "", ""


def overlap_scores(query: str, texts: list[str]) -> list[float]:
    """Share of the query's words in each text; a stand-in for a model."""
    wanted = set(query.lower().split())
    return [len(wanted & set(t.lower().split())) / max(len(wanted), 1) for t in texts]


def recorded_hits(subqueries: DataFrame) -> DataFrame:
    """Recorded responses of the sub-queries; the folder stands in the column ``folder`` of the first row."""
    row = subqueries.select("folder").first()
    spark = subqueries.sparkSession
    search.register(spark)
    found = spark.read.format(search.RecordedSearch.name()).load(row.folder if row is not None else "")
    return found.join(subqueries.select("subquery").distinct(), "subquery", "left_semi")


@dataclass(frozen=True)
class Pipeline:
    planner: QueryPlanner = identity_planner
    discovery: SearchDiscovery = recorded_hits
    selection: SelectionPolicy = select_urls
    extractor: ContentExtractor = search.fetch
    structured: StructuredDataExtractor = no_model
    cache: PageCacheRepository = store.lookup
    cleaner: MarkdownCleaner = cleaning.clean
    chunker: SemanticChunker = chunking.chunk_texts
    prefilter: CandidatePrefilter = ranking.prefilter
    reranker: Reranker = overlap_scores
    assembler: ResultAssembler = ranking.token_fill
    embedding: EmbeddingFunction = chunking.hashed_vectors
    text_chunker: BaseChunker = chunking.chunk
    options: dict = field(default_factory=dict)


DEFAULT = Pipeline()


def structured_fields(pages: DataFrame, id_col: str, markdown_col: str, schema: dict, extractor: StructuredDataExtractor = no_model) -> DataFrame:
    """Leaves that an extractor finds in each page, with their evidence checked; one failure voids a page."""

    @F.pandas_udf("data string, evidence string")
    def run(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        rows = [extractor(t or "", schema) for t in texts]
        return pd.DataFrame(rows, columns=["data", "evidence"])

    found = pages.withColumn("_x", run(markdown_col)).select(id_col, markdown_col, F.col("_x.data").alias("_data"), F.col("_x.evidence").alias("_evidence"))
    return contract.evidence_fields(found, id_col, "_data", "_evidence", markdown_col, schema)


def rerank(chunks: DataFrame, group_col: str, query: str, text_col: str, order: list, scorer: Callable[[str, list[str]], list[float]] = overlap_scores, batch: int = 32) -> DataFrame:
    """``serving.reranked`` with the built-in scorer."""
    return serving.reranked(chunks, group_col, query, text_col, order, scorer, batch)
