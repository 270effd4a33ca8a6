"""One state row per entity, kept by the stream itself (H4)."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from feedledger.operators.classify import classify
from feedledger.schemas import IDENTITY_FIELDS
from feedledger.sources.pages import explode_envelopes, stream_pages


# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _seen_type(fields: tuple[str, ...]) -> str:
    columns = ", ".join(f"{f} string, {f}_at timestamp, {f}_arrival string" for f in fields)
    return f"github_id long, {columns}, updated_at timestamp"


def _state_type(fields: tuple[str, ...]) -> str:
    return ", ".join(f"{f} string" for f in fields) + ", updated_at timestamp, version long"


def combine_frames(fields: tuple[str, ...]):
    """Reduces a frame of deliveries to one row per entity before the shuffle.

    Per field the last non-null value in arrival order is kept with its instant, so an
    entity named by a third of all deliveries sends one row per Arrow frame.
    """
    def combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pushes = frame[(frame["outcome"] == "push_event") & ~frame["fragment_undefined"].astype(bool)].sort_values("arrival")
            reduced = pushes.groupby("github_id")[["received_at"]].max().rename(columns={"received_at": "updated_at"})
            for field in fields:
                last = pushes[pushes[field].notna()].drop_duplicates("github_id", keep="last").set_index("github_id")
                reduced[field] = last[field]
                reduced[f"{field}_at"] = last["received_at"]
                reduced[f"{field}_arrival"] = last["arrival"]
            columns = ["github_id", *[c for f in fields for c in (f, f"{f}_at", f"{f}_arrival")], "updated_at"]
            yield reduced.reset_index()[columns]

    return combine


def fold_group(fields: tuple[str, ...]):
    """Folds one entity's reduced rows into its state, frame by frame.

    A value applies if its instant is not older than the state the micro-batch found.
    """
    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stored = state.get if state.exists else (*[None] * len(fields), None, 0)
        values = dict(zip(fields, stored))
        before, version = stored[-2], stored[-1] + 1
        before = None if before is None else pd.Timestamp(before)
        updated, newest = before, dict.fromkeys(fields, "")
        for frame in frames:
            for field in fields:
                fresh = frame[frame[field].notna()]
                if before is not None:
                    fresh = fresh[fresh[f"{field}_at"] >= before]
                if len(fresh):
                    row = fresh.loc[fresh[f"{field}_arrival"].idxmax()]
                    if row[f"{field}_arrival"] > newest[field]:
                        newest[field], values[field] = row[f"{field}_arrival"], row[field]
            latest = frame["updated_at"].max()
            updated = latest if updated is None else max(updated, latest)
        state.update((*[values[f] for f in fields], updated.to_pydatetime(), version))
        yield pd.DataFrame({"github_id": [key[0]], **{f: [values[f]] for f in fields},
                            "updated_at": [updated], "version": [version]})

    return fold


def identity_versions(kind: str, pages: DataFrame) -> DataFrame:
    """A stream of pages to a stream of new identity versions of one class."""
    fields = IDENTITY_FIELDS[kind]
    arrival = F.concat_ws(
        "|", F.date_format("received_at", "yyyyMMddHHmmss.SSSSSS"), "run_id",
        F.lpad(F.col("page_no").cast("string"), 9, "0"), F.lpad(F.col("pos").cast("string"), 9, "0"))
    # Pushes are picked out inside the combine step: a filter here would be pushed below the
    # rules and evaluate all of them twice.
    seen = classify(explode_envelopes(pages)).select(
        "outcome", F.coalesce("fragment_undefined", F.lit(False)).alias("fragment_undefined"), F.col(kind)["github_id"].alias("github_id"), *[F.col(kind)[f].alias(f) for f in fields],
        "received_at", arrival.alias("arrival"))
    reduced = seen.mapInPandas(combine_frames(fields), _seen_type(fields))
    return reduced.groupBy("github_id").applyInPandasWithState(
        fold_group(fields), f"github_id long, {_state_type(fields)}", _state_type(fields), "update",
        GroupStateTimeout.NoTimeout)


def fold_stream(spark: SparkSession, landing: str, kind: str, out: str, checkpoint: str,
                max_files: int | None = None) -> StreamingQuery:
    """Writes the versions of every micro-batch; writing one again replaces it."""
    versions = identity_versions(kind, stream_pages(spark, landing, max_files=max_files))

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch_id}")

    return (versions.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
