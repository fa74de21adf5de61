"""Registered queries of the operators for training data, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, leakage, maincontent, neardup, residue, splitting, survivorship, toxicity
from cairn.operators.nested import crawl_bodies
from cairn.session import load_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one table whose three-word sequences have at least half of their union in common."""
    parts = []
    for table, key, text in (("passages", "passage_id", "text"), ("page_cache", "record_id", "markdown")):
        pairs = neardup.near_duplicate_pairs(load_table(spark, sf_dir, table), key, text, n=3, threshold=0.5)
        parts.append(pairs.select(F.lit(table).alias("table_name"), "a_id", "b_id"))
    return parts[0].unionByName(parts[1])


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per passage or page with its group of near-duplicates, its class of copies and its number of links."""
    parts = []
    for table, key, text in (("passages", "passage_id", "text"), ("page_cache", "record_id", "markdown")):
        groups = neardup.near_duplicate_groups(load_table(spark, sf_dir, table), key, text, n=3, threshold=0.5)
        parts.append(groups.select(F.lit(table).alias("table_name"), "*"))
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivorship.resolve_metadata(load_table(spark, sf_dir, "metadata_conflicts"), load_table(spark, sf_dir, "metadata_sources"))


def _residue_bodies(spark: SparkSession, sf_dir: str, model: tuple) -> DataFrame:
    return residue.residue_cases(crawl_bodies(load_table(spark, sf_dir, "crawl_results")), ["crawl_id", "result_pos"], "body", *model)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the article in markdown, raw_html and crawl bodies; bodies that are residue (p5) have none."""
    pages = load_table(spark, sf_dir, "page_cache")
    encoded = maincontent.encode_pages(pages, ["record_id"], "raw_html")
    model = maincontent.fit(encoded)
    parts = []
    for name, lines in (("markdown", maincontent.extract_lines(pages, ["record_id"], "markdown", False, model)), ("raw_html", maincontent.encoded_lines(encoded, model))):
        parts.append(lines.select(F.lit(name).alias("field_name"), F.col("record_id").alias("row_id"), F.lit(0).alias("result_pos"), "line_no"))
    residue_test = residue.case_test(spark, *residue.train(load_table(spark, sf_dir, "evidence_quality")))
    lines = maincontent.extract_lines(crawl_bodies(load_table(spark, sf_dir, "crawl_results")), ["crawl_id", "result_pos"], "body", False, model, residue_test)
    parts.append(lines.select(F.lit("fit_markdown").alias("field_name"), F.col("crawl_id").alias("row_id"), "result_pos", "line_no"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = load_table(spark, sf_dir, "evidence_quality")
    model = residue.train(evidence)
    own = residue.residue_cases(evidence, ["item_id"], "text", *model).select(F.lit("evidence_quality").alias("table_name"), F.col("item_id").alias("row_id"), F.lit(0).alias("result_pos"))
    bodies = _residue_bodies(spark, sf_dir, model).select(F.lit("crawl_results").alias("table_name"), F.col("crawl_id").alias("row_id"), "result_pos")
    return own.unionByName(bodies)


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = load_table(spark, sf_dir, "chunk_requests")
    return splitting.split_pieces(requests, "request_id", "text", F.col("params.max_chunk_tokens"), F.col("params.overlap_tokens"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that had to be cut: those with a second piece."""
    return _pieces(spark, sf_dir).filter("piece_no = 2").select("request_id")


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(load_table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "eval_items"))


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "labels"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_scores(spark, sf_dir).filter("flagged").select("doc_id")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rates_by_source(p10_scores(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups, "p2_found": p2_found, "p4_found": p4_found, "p5_found": p5_found, "p7_found": p7_found, "p7_pieces": p7_pieces, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates}

SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TOKENS = SPACE.replace("[", "[^", 1)

SQL = {
    "p7_found": f"""
        SELECT request_id FROM chunk_requests
        WHERE len(regexp_extract_all(text, '{TOKENS}+')) > CASE WHEN params.max_chunk_tokens > 0 THEN params.max_chunk_tokens ELSE 400 END""",
    "p2_found": f"""
        WITH long AS (SELECT document_id, field_name, observed_at, unnest(candidates) AS c FROM metadata_conflicts),
        clean AS (
          SELECT document_id, field_name, observed_at, c.source AS source, lower(regexp_replace(c.confidence, '^{SPACE}+|{SPACE}+$', '', 'g')) AS conf,
                 trim(regexp_replace(c.value, '{SPACE}+', ' ', 'g')) AS value FROM long),
        usable AS (
          SELECT u.*, s.source_rank AS r, regexp_replace(value, '(?:{SPACE}*(?:\\x{{2026}}|\\.(?:{SPACE}?\\.){{2,}}|[\\[(]{SPACE}*(?:\\x{{2026}}|\\.{{2,}}){SPACE}*[\\])]|\\x{{22ef}}))+{SPACE}*$', '') AS stem
          FROM clean u LEFT JOIN metadata_sources s USING (field_name, source)
          WHERE regexp_matches(value, '[\\p{{L}}\\p{{N}}]') AND lower(value) NOT IN ({', '.join("'" + x + "'" for x in survivorship.STAND_INS)})),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY document_id, field_name ORDER BY
            CASE conf WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, r NULLS LAST, observed_at DESC NULLS LAST, length(value) DESC, value) AS n FROM usable),
        best AS (SELECT document_id, field_name, value, stem FROM ranked WHERE n = 1),
        whole AS (
          SELECT b.document_id, b.field_name, u.value, row_number() OVER (PARTITION BY b.document_id, b.field_name ORDER BY length(u.stem) DESC, u.stem = u.value DESC, u.value) AS n
          FROM best b JOIN usable u ON u.document_id = b.document_id AND u.field_name = b.field_name
          WHERE b.stem <> '' AND length(u.stem) > length(b.stem) AND starts_with(u.stem, b.stem))
        SELECT b.document_id, b.field_name, coalesce(w.value, b.value) AS value
        FROM best b LEFT JOIN whole w ON w.document_id = b.document_id AND w.field_name = b.field_name AND w.n = 1""",
}
