"""Lookups planned and answers applied on stored tables, each by one commit.

Two planners that begin at the same state cannot both win: the second to commit is worked out
again on the state the first one left, in which the entities are leased. An answer changes an
entity only while the stored row still carries the token of its lease.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedledger.operators import selection
from feedledger.operators.enrich import apply_detail_answers, apply_search_answers
from feedledger.operators.ingest import ATTEMPTS, SNAPSHOTS, with_untouched
from feedledger.operators.transitions import hold_leases, reclaim_stale
from feedledger.schemas import LEASES
from feedledger.session import configure, stage, staging_area
from feedledger.sources.commits import CommitConflict, Transaction, claim_batch

STAGES = {"search": "batch_in_flight", "detail": "detail_in_flight"}


def _committed(spark: SparkSession, root: str, job: str, work: Callable[[Transaction], DataFrame]) -> DataFrame:
    """Runs ``work`` in a transaction until it commits; returns the small table that it reports.

    The table is written outside the folder that is cleared after the work.
    """
    configure(spark)
    stream = f"{job}-{uuid.uuid4().hex}"
    batch, _ = claim_batch(spark, root, stream, 0)
    for attempt in range(ATTEMPTS):
        tx = Transaction(spark, root, batch, stream, 0)
        tx.next.streams.pop(stream)  # this name is never used again
        with staging_area(spark, f"{job}-{batch}"):
            told = work(tx)
            rows, schema = told.collect(), told.schema  # one row per class or verdict
        try:
            tx.commit()
            return spark.createDataFrame(rows, schema)
        except CommitConflict:
            if attempt == ATTEMPTS - 1:
                raise
    raise AssertionError


def plan_enrichment(spark: SparkSession, root: str, kind: str, now: Column, lane: str = "search") -> DataFrame:
    """Leases all due entities of a class and opens their batches; returns how many of either.

    ``lane`` is ``search`` for batches from the backlog, or ``detail`` for single lookups.
    """
    plan = {"search": selection.plan_members, "detail": selection.plan_details}[lane]
    table = SNAPSHOTS[kind]

    def work(tx: Transaction) -> DataFrame:
        members = stage(selection.leases_for(plan(kind, tx.rows(table), now), now), "members")
        own = tx.touched(table, members, "github_id")
        tx.replace(hold_leases(tx.rows(table, own), members, STAGES[lane]), table, own)
        opened = stage(selection.open_batches(members, lane, now), "opened")
        # A batch whose member is leased again has gone stale.
        named = opened.select("correlation_id").union(members.where("current_batch_id IS NOT NULL").select("current_batch_id"))
        held = tx.touched("batches", named, "correlation_id")
        tx.replace(with_untouched(opened, reclaim_stale(tx.rows("batches", held), members, now), "correlation_id"), "batches", held)
        lent = tx.touched("leases", members, "request_batch_id")
        tx.replace(with_untouched(members.select(*LEASES.names), tx.rows("leases", lent), "request_batch_id"), "leases", lent)
        return opened.agg(F.lit(kind).alias("entity_kind"), F.count("*").alias("batches"),
                          F.coalesce(F.sum("requested_count"), F.lit(0)).alias("leased"))

    return _committed(spark, root, "plan", work)


def apply_answers(spark: SparkSession, root: str, kind: str, answers: DataFrame, now: Column, lane: str = "search") -> DataFrame:
    """Takes landed answers into entities, batches and evidence; returns batches per result.

    An answer to a batch that is no longer in flight, or unknown, changes nothing, so answers
    may be delivered again.
    """
    table = SNAPSHOTS[kind]
    apply = {"search": apply_search_answers, "detail": apply_detail_answers}[lane]

    def work(tx: Transaction) -> DataFrame:
        asked = answers.select(F.col("request_batch_id").alias("correlation_id")).distinct()
        held = tx.touched("batches", asked, "correlation_id")
        stored = stage(tx.rows("batches", held), "batches")
        in_flight = (F.col("status") == "in_flight") & (F.col("entity_kind") == kind) & (F.col("request_kind") == lane)
        opened = stage(stored.where(in_flight).join(asked, "correlation_id", "left_semi"), "opened")
        fresh = stage(answers.join(opened.select(F.col("correlation_id").alias("request_batch_id")), "request_batch_id", "left_semi")
                      .select(*answers.columns), "answers")
        ids = opened.select(F.explode("requested_github_ids").alias("github_id"))
        own = tx.touched(table, ids, "github_id")
        entities = stage(tx.rows(table, own), "entities")
        answered = opened.select(F.col("correlation_id").alias("request_batch_id"))
        lent = tx.touched("leases", answered, "request_batch_id")
        lease_rows = stage(tx.rows("leases", lent), "lease-rows")
        leases = stage(lease_rows.join(answered, "request_batch_id", "left_semi"), "leases")
        done = apply(kind, entities, opened, leases, fresh, now)
        tx.replace(lease_rows.join(answered, "request_batch_id", "left_anti"), "leases", lent)
        tx.replace(done.entities.select(*entities.columns), table, own)
        tx.replace(with_untouched(done.batches.select(*stored.columns), stored, "correlation_id"), "batches", held)
        tx.append(done.observations, "observations")
        return done.results.groupBy("result").agg(F.count("*").alias("batches"))

    return _committed(spark, root, "answers", work)
