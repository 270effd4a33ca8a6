"""Landed answers taken into entities, batches and evidence in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from feedledger.operators import matching, transitions
from feedledger.session import stage
from feedledger.sources.documents import detail_documents, search_documents


@dataclass(frozen=True)
class Enriched:
    """What a set of answers leads to: the next snapshots, new evidence, and results per batch."""

    entities: DataFrame
    batches: DataFrame
    observations: DataFrame
    results: DataFrame


def apply_search_answers(kind: str, entities: DataFrame, batches: DataFrame, leases: DataFrame,
                         answers: DataFrame, now: Column, jitter: Column | None = None) -> Enriched:
    """Answers to batched lookups of one class."""
    verdicts = stage(transitions.search_verdicts(search_documents(answers)), "verdicts")
    validated, extras = transitions.match_answers(kind, leases, verdicts)
    validated = stage(validated, "validated")
    outcomes = stage(transitions.search_outcomes(kind, leases, verdicts, validated), "outcomes")
    results = transitions.batch_results(transitions.guard_lease(outcomes, entities), verdicts, extras)
    return Enriched(
        transitions.apply_outcomes(kind, entities, outcomes, now, jitter),
        transitions.finalize_batches(batches, results, now),
        matching.record_observations(kind, validated, extras, now), results)


def apply_detail_answers(kind: str, entities: DataFrame, batches: DataFrame, leases: DataFrame,
                         answers: DataFrame, now: Column, max_attempts: int = transitions.DETAIL_MAX_ATTEMPTS,
                         jitter: Column | None = None) -> Enriched:
    """Answers to single lookups of one class."""
    documents = stage(detail_documents(answers), "documents")
    judged = stage(transitions.detail_verdicts(kind, leases, documents, max_attempts), "details")
    outcomes = stage(transitions.detail_outcomes(kind, judged), "outcomes")
    results = transitions.detail_results(judged, transitions.guard_lease(outcomes, entities))
    read = judged.where("answer_class = 'ok'")
    return Enriched(
        transitions.apply_outcomes(kind, entities, outcomes, now, jitter),
        transitions.finalize_batches(batches, results, now),
        matching.record_detail_observations(kind, read, now), results)
