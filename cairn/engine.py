"""The whole search as one plan: hits, merge, policy, selection, pages, chunks, ranking, quality, budget, citations."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.identity import document_id, evidence_id
from cairn.functions.texts import cut_words, fingerprint, word_count
from cairn.functions.url import host, normalize_url
from cairn.operators import chunking, discovery, pages, ranking
from cairn.session import checkpoint


@dataclass(frozen=True)
class Profile:
    """Limits of a search; see ``PROFILES``."""

    token_budget: int = 4000
    max_urls: int = 6
    max_passages: int | None = None
    prefilter: int = 50
    relevance_floor: float | None = None
    item_bytes: int = 65_536
    list_bytes: int = 262_144

    def __post_init__(self) -> None:
        if min(self.token_budget, self.max_urls, self.prefilter) < 1:
            raise ValueError("limits must be positive")


PROFILES = {"default": Profile(), "quick": Profile(2000, 5, 5), "research": Profile(8000, 12, 20), "deep": Profile(16000, 20, 40)}


@dataclass
class SearchFrames:
    selected: DataFrame
    passages: DataFrame
    citations: DataFrame


def search(hits: DataFrame, page_cache: DataFrame, text: str, profile: Profile | str = "default", blocked: DataFrame | None = None, allowed: DataFrame | None = None) -> SearchFrames:
    """Passages and citations for a query over recorded hits and pages.

    Only rows of selected URLs reach the chunker, so the expensive part is bounded by the profile, not by the tables.
    """
    p = PROFILES[profile] if isinstance(profile, str) else profile
    found = discovery.normal_hits(hits, F.coalesce(F.try_element_at("positions", F.lit(1)), F.lit(1)))
    merged = discovery.merged_candidates(found, "result_id")
    candidates = discovery.domain_decisions(merged, blocked, allowed).filter("filtered_reason IS NULL")
    query = F.lit(text)
    scored = discovery.with_lexical(candidates, query).withColumn("search", F.lit(1))
    listed = None if allowed is None else allowed.select("host").distinct().limit(2).count()
    selected = discovery.select_urls(scored, "search", "result_id", p.max_urls, allowed=listed)
    urls = selected.select(normalize_url("url").alias("_key"), "choice").groupBy("_key").agg(F.min("choice").alias("choice"))
    newest = fetched(page_cache).join(F.broadcast(urls), "_key").groupBy("_key").agg(F.max_by(F.struct("record_id", "markdown", "title", "requested_url", "choice"), F.struct("fetched_at", "record_id")).alias("p")).select("p.*")
    return SearchFrames(selected, *answer(newest, text, p))


def fetched(page_cache: DataFrame) -> DataFrame:
    """The pages with content and the key of their URL."""
    return page_cache.filter("markdown IS NOT NULL AND outcome = 'content'").withColumn("_key", normalize_url(F.coalesce("final_url", "requested_url")))


def best_pages(page_cache: DataFrame, text: str, n: int) -> DataFrame:
    """The ``n`` best pages for a query by BM25: of every URL the newest delivery, of equal contents one page.

    Texts are not moved: ids, digests and word counts are ranked, then the texts of the ``n`` pages are read.
    """
    terms = sorted({t for t in re.findall("[a-z0-9]+", text.lower()) if len(t) > 1})
    n_words, counts = ranking.term_counts(F.col("markdown"), terms)
    key = F.coalesce("_key", F.col("record_id").cast("string"))
    slim = fetched(page_cache).select("record_id", key.alias("_key"), "fetched_at", fingerprint(F.col("markdown")).alias("fingerprint"), n_words.alias("n_words"), counts.alias("counts"))
    newest = pages.latest_versions(slim, "_key", "fetched_at", "record_id")
    unique = checkpoint(newest.groupBy("fingerprint").agg(F.min_by(F.struct("record_id", "n_words", "counts"), "record_id").alias("p")).select("p.*"))
    best = ranking.bm25(unique, "n_words", "counts", len(terms)).orderBy(F.desc("score"), "record_id").limit(n)
    return page_cache.join(F.broadcast(best.select("record_id")), "record_id", "left_semi").select("record_id", "markdown", "title", "requested_url")


def answer(bodies: DataFrame, text: str, p: Profile) -> tuple[DataFrame, DataFrame]:
    """(passages, citations) from a bounded set of pages: record_id, markdown, title, requested_url."""
    bodies = checkpoint(bodies)  # read several times below; a few rows
    firsts = pages.first_copies(bodies, "markdown", "record_id").select("record_id")
    unique = bodies.join(firsts, "record_id", "left_semi")
    none = F.lit(None).cast("int")
    spans = chunking.chunk_texts(unique, "record_id", "markdown", F.lit("cluster-semantic@1"), none, none, none)
    chunks = spans.join(unique, "record_id").withColumn("text", F.expr("substring(markdown, start_index + 1, end_index - start_index)"))
    score = ranking.prefilter_score(F.lit(text), F.col("text"), F.col("title"), F.col("chunk_no"))
    ranked = ranking.prefilter(chunks.withColumn("score", score).withColumn("position", F.struct("record_id", "chunk_no")), "record_id", "score", "position", p.prefilter)
    if p.relevance_floor is not None:
        ranked = ranked.filter(F.col("score") > p.relevance_floor)
    sound = ranked.filter(ranking.drop_reason(F.col("text")).isNull()).withColumn("n_bytes", F.octet_length("text")).withColumn("neg", -F.col("score")).withColumn("search", F.lit(1))
    fitting = ranking.byte_envelope(sound.drop("position", "markdown"), "search", ["neg", "requested_url", "chunk_no"], "n_bytes", p.item_bytes, p.list_bytes)
    filled = ranking.token_fill(fitting, "search", [F.desc("score"), F.col("requested_url"), F.col("chunk_no")], p.token_budget, p.max_passages)
    sources = unique.select("record_id", F.sha2("markdown", 256).alias("_sha"), document_id(F.col("requested_url"), F.col("markdown")).alias("document_id"))
    passages = filled.join(sources, "record_id").withColumn("evidence_id", evidence_id(F.col("requested_url"), F.col("_sha"), F.col("start_index"), F.col("end_index")))
    cited = ranking.citations(passages, "search", F.col("document_id")).drop("search")
    first_use = F.dense_rank().over(Window.orderBy("first_rank"))
    cited = cited.withColumn("citation_id", first_use)
    out = passages.join(cited.select(F.col("citation_key").alias("document_id"), "citation_id"), "document_id")
    return out.select("rank", "citation_id", "record_id", "requested_url", host("requested_url").alias("host"), "document_id", "evidence_id", "start_index", "end_index", "used_tokens", F.round("score", 6).alias("score"), F.when(word_count(F.col("text")) <= F.col("used_tokens"), F.col("text")).otherwise(cut_words(F.col("text"), F.col("used_tokens"))).alias("text")), cited
