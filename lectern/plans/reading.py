"""The two jobs around the external model call, composed from the operators."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from lectern.config import JobConfig
from lectern.operators import annotations, findings, grounding, locate, pages, reports, requests, responses, sections
from lectern.plans.skew import cut_lineage


def prepare_requests(papers: DataFrame, cfg: JobConfig, no_json_mode: DataFrame | None = None) -> DataFrame:
    """Documents (doc_id, full_text, meta_text) -> request rows for the model service."""
    return requests.request_rows(sections.with_condensed(papers, cfg.max_input_chars), cfg, no_json_mode)


def typed_results(log: DataFrame) -> DataFrame:
    """Response log -> request_id, doc_id, model, result for the answers that can be read.

    Parsed answers are stored first: a filter on them would otherwise be pushed below the parsing and parse twice.
    """
    parsed = cut_lineage(responses.parse_answers(responses.read_answers(log)).select(
        "request_id", "doc_id", "model", "answer_json"))
    return parsed.where(F.col("answer_json").isNotNull()).select(
        "request_id", "doc_id", "model", findings.normalise_result(F.col("answer_json")).alias("result"))


def grounded_findings(results: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row per finding with its verification, page and final wording."""
    flat = cut_lineage(findings.findings_flat(results, ["request_id", "doc_id", "model"]))
    return grounding.ground(flat, corpus, F.xxhash64("request_id", "ord"))


def grounded_results(grounded: DataFrame) -> DataFrame:
    """request_id, doc_id, model, findings (ordered array)."""
    return findings.regroup(grounded, ["request_id", "doc_id", "model"])


def located_findings(grounded: DataFrame, page_texts: DataFrame, boxed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Verified findings with their place on a page; the others are absent. ``boxed``: see ``locate.locate``."""
    key = ["request_id", "ord"]
    wanted = grounded.where(F.col("verified") & (F.col("quote") != ""))
    places = locate.locate(wanted.select("doc_id", *key, "quote", "page"), page_texts, key, boxed)
    return wanted.join(places, ["doc_id", *key])


def analysis_notes(results: DataFrame, papers: DataFrame) -> DataFrame:
    """Adds ``coverage`` and ``note`` to grounded results. ``papers``: doc_id, condensed, has_page_info."""
    joined = results.join(papers.select("doc_id", "condensed", "has_page_info"), "doc_id")
    return joined.withColumn("coverage", reports.coverage(F.col("condensed.partial"))).withColumn(
        "note", reports.coverage_note(F.col("condensed.omitted"), F.col("condensed.partial"),
                                      reports.corrected_count(F.col("findings")), F.col("has_page_info"))
    ).drop("condensed")


STORED = "cache_key string, title string, model string, created_at timestamp, result string"


def store_rows(noted: DataFrame, keys: DataFrame) -> DataFrame:
    """Grounded results with their notes as rows of the result store: cache_key, title, model, created_at, result (JSON).

    ``noted``: output of ``analysis_notes`` with title and created_at. ``keys``: doc_id, cache_key.
    """
    result = F.to_json(F.struct("findings", "coverage", "note"))
    return noted.join(keys.select("doc_id", "cache_key"), "doc_id").select("cache_key", "title", "model", "created_at", result.alias("result"))


def annotate(grounded: DataFrame, page_texts: DataFrame, stored: DataFrame, cfg: JobConfig) -> tuple[DataFrame, DataFrame]:
    """(annotations to append, statistics per document)."""
    located = located_findings(grounded, page_texts)
    created = annotations.new_annotations(located, stored, cfg)
    return created, annotations.annotation_stats(grounded, located, created)


def paged_corpus(raw: DataFrame) -> DataFrame:
    """Extracted text -> canonical corpus; documents without text are left out."""
    good, _ = pages.parse_documents(raw)
    return grounding.canonical_corpus(good)
