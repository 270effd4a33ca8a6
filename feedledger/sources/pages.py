"""Landed feed pages: reading them, walking a run, taking the envelopes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from feedledger.functions.decoder import decode_array_bodies
from feedledger.functions.http import header, http_class, next_link, request_key
from feedledger.functions.json_values import class_name, kind_of_shape
from feedledger.schemas import FETCH_LOG
from feedledger.sources.json_bodies import with_array_flag, with_problem

_META = ("run_id", "source_id", "page_no", "received_at")


def read_fetch_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed page; bodies stay text until they are parsed."""
    return spark.read.schema(FETCH_LOG).json(path)


def _bare_pages(files: DataFrame) -> DataFrame:
    """Whole files as pages: the file is the run, its modification time the arrival."""
    return files.select(
        F.col("_metadata.file_path").alias("run_id"), F.lit(None).cast("long").alias("source_id"),
        F.lit(1).alias("page_no"), F.lit(None).cast("string").alias("request_url"),
        F.col("_metadata.file_modification_time").alias("received_at"), F.lit(200).alias("status"),
        F.lit(None).cast("map<string,string>").alias("headers"), F.col("value").alias("body"))


def read_bare_pages(spark: SparkSession, path: str) -> DataFrame:
    return _bare_pages(spark.read.text(path, wholetext=True))


def stream_pages(spark: SparkSession, path: str, bare: bool = False, max_files: int | None = None) -> DataFrame:
    """The same rows as they land."""
    reader = spark.readStream
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if bare:
        return _bare_pages(reader.format("text").option("wholetext", True).load(path))
    return reader.schema(FETCH_LOG).json(path)


def page_state(pages: DataFrame) -> DataFrame:
    """Per page, without its body: its answer's class, whether it is readable as an array,
    whether it is empty, and its next link."""
    return with_array_flag(pages).select(
        *[c for c in _META if c in pages.columns], "request_url", "status",
        http_class(F.col("status"), F.col("headers")).alias("http_class"),
        "is_array",
        F.coalesce(F.col("body").rlike(r"^\s*\[\s*\]\s*\z"), F.lit(False)).alias("is_empty"),
        next_link(header(F.col("headers"), "link")).alias("next_url"),
    )


def walk_stops(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """``stops_of`` over landed pages."""
    return stops_of(page_state(pages), max_pages)


def link_targets(states: DataFrame) -> DataFrame:
    """The links each run has followed: ``(run_id, page_no, next_key)``, the first request as page 0."""
    first = states.where("page_no = 1").select(
        "run_id", F.lit(0).alias("page_no"), request_key(F.col("request_url")).alias("next_key"))
    return (states.select("run_id", "page_no", request_key(F.col("next_url")).alias("next_key"))
            .unionByName(first).where("next_key IS NOT NULL"))


def stops_of(states: DataFrame, max_pages: int | None = None, walks: DataFrame | None = None) -> DataFrame:
    """Where each run's walk ends and why: ``(run_id, stop_page, stop_reason, counted_through)``.

    Reasons are tested page by page in this order: unusable page, empty page, no next
    link, a link already visited, the cap if one is given. ``counted_through`` is the last page whose
    envelopes count; an unusable page ends the walk but does not count. ``walks`` tells how far
    earlier batches have walked the same runs; pages must have landed in the order of the walk.
    """
    targets = link_targets(states)
    if walks is not None:
        targets = targets.unionByName(walks.select("run_id", F.inline("visited"))).distinct()
    # The second sight of a target in page order is the loop; a run's first loop is what
    # counts. The rank filter keeps two rows per target on the map side.
    sightings = Window.partitionBy("run_id", "next_key").orderBy("page_no")
    loops = (targets.withColumn("_n", F.row_number().over(sightings)).where("_n <= 2").where("_n = 2")
             .groupBy("run_id").agg(F.min("page_no").alias("loop_page")))
    reason = (
        F.when(F.coalesce(F.col("http_class") != "ok", F.lit(True)) | ~F.col("is_array"), "page_error")
        .when(F.col("is_empty"), "empty_page")
        .when(F.col("next_url").isNull(), "no_next_link")
    )
    local = (states.withColumn("_reason", reason)
             .groupBy("run_id").agg(
                 F.min(F.when(F.col("_reason").isNotNull(), F.struct("page_no", "_reason"))).alias("_local"),
                 F.max("page_no").alias("_last")))
    joined = local.join(loops, "run_id", "left")
    if walks is None:
        earlier = F.lit(None).cast("struct<page:int,rank:int,reason:string>")
    else:
        before = walks.select("run_id", F.col("last_page").alias("_walked"), F.col("stop_page").alias("_stopped"),
                              F.col("stop_reason").alias("_stopped_by"))
        joined = (joined.join(before, "run_id", "left").withColumn("_last", F.greatest("_last", "_walked")))
        earlier = F.when(F.col("_stopped_by").isNotNull(), F.struct(
            F.col("_stopped").alias("page"), F.lit(0).alias("rank"), F.col("_stopped_by").alias("reason")))

    def stop(page, rank: int, why):
        return F.when(page.isNotNull(), F.struct(page.alias("page"), F.lit(rank).alias("rank"), why.alias("reason")))

    chosen = F.least(
        earlier,
        stop(F.col("_local.page_no"), 1, F.col("_local._reason")),
        stop(F.col("loop_page"), 2, F.lit("link_loop")),
        stop(F.lit(max_pages).cast("int"), 3, F.lit("page_cap")))
    ended = F.col("_stop.page") <= F.col("_last")
    return joined.select("run_id", chosen.alias("_stop"), "_last").select(
        "run_id", F.least(F.col("_stop.page"), F.col("_last")).alias("stop_page"),  # least() skips a null
        F.when(ended, F.col("_stop.reason")).alias("stop_reason"),
        (F.least(F.col("_stop.page"), F.col("_last"))
         - F.when(F.coalesce(ended & (F.col("_stop.reason") == "page_error"), F.lit(False)), 1).otherwise(0)).alias("counted_through"))


def walked(states: DataFrame, stops: DataFrame, walks: DataFrame) -> DataFrame:
    """The rows of ``walks`` after a batch, for the runs it holds pages of.

    Only a run that goes on keeps its links, which are as many as its pages.
    """
    seen = states.groupBy("run_id").agg(
        F.min("page_no").alias("_first"), F.min_by("http_class", "page_no").alias("_class"), F.max("page_no").alias("_last"))
    links = (link_targets(states).groupBy("run_id").agg(F.collect_set(F.struct("page_no", "next_key")).alias("_links")))
    before = walks.select("run_id", "first_page", "first_class", "last_page", "visited")
    joined = seen.join(stops, "run_id").join(links, "run_id", "left").join(before, "run_id", "left")
    earlier = F.coalesce(F.col("first_page") <= F.col("_first"), F.lit(False))
    none = F.array().cast("array<struct<page_no:int,next_key:string>>")
    visited = F.array_sort(F.array_union(F.coalesce("visited", none), F.coalesce("_links", none)))
    return joined.select(
        "run_id", F.least("first_page", "_first").alias("first_page"),
        F.when(earlier, F.col("first_class")).otherwise(F.col("_class")).alias("first_class"),
        F.greatest("last_page", "_last").alias("last_page"), "counted_through", "stop_page", "stop_reason",
        F.when(F.col("stop_reason").isNull(), visited).alias("visited"))


def left_out(states: DataFrame, stops: DataFrame) -> DataFrame:
    """Keys of the landed pages past their run's stop."""
    return (states.select("run_id", "page_no").join(stops, "run_id")
            .where("page_no > counted_through").select("run_id", "page_no"))


def walk_order(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """The pages whose envelopes count.

    Runs that stop early name the few pages to leave out, so page bodies are filtered
    against a narrow list instead of being shuffled to meet their run's stop.
    """
    states = pages.select("run_id", "page_no")
    return pages.join(left_out(states, walk_stops(pages, max_pages)), ["run_id", "page_no"], "left_anti")


def explode_envelopes(pages: DataFrame) -> DataFrame:
    """One row per array element, null and scalar elements included; ``pos`` counts from 0.

    ``value`` is the element as a variant, ``text`` its canonical text; ``k_`` and ``s_`` columns
    hold kind and text of the fields that classification looks at.
    """
    kept = [c for c in _META if c in pages.columns]
    read = pages.select(*kept, decode_array_bodies(F.col("body")).alias("_decoded"))
    # Over a bare column the optimizer adds a filter on the array's size and pushes it below
    # the decoder, so that every body would be decoded twice.
    elements = F.slice("_decoded.elements", 1, 2**31 - 1)
    return (read.select(*kept, F.posexplode(elements).alias("pos", "element"))
            .select(*kept, "pos", F.try_parse_json("element.text").alias("value"), "element.*"))


def page_errors(pages: DataFrame) -> DataFrame:
    """Pages whose body is not a JSON array, with what it is instead."""
    read = with_problem(pages.select("run_id", "page_no", "body")).where("NOT is_array")
    shaped = read.select(
        "run_id", "page_no", F.col("head").isNull().alias("_unreadable"),
        F.schema_of_variant("head.value").alias("_shape"),
        F.coalesce("head.text", F.to_json("head.value")).alias("_text"))
    kind = kind_of_shape(F.col("_shape"), F.col("_text"))
    return shaped.select(
        "run_id", "page_no",
        F.when(F.col("_unreadable"), F.lit("response body is not valid JSON"))
        .otherwise(F.concat(F.lit("expected a JSON array of events, got "), class_name(kind, F.col("_text"))))
        .alias("page_error"))
