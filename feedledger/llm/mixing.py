"""Mixing sources to target weights by Pareto order sampling (operator 13)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from feedledger.llm.hot_keys import join_by_source
from feedledger.llm.worker import ship
from feedledger.operators.ranking import global_rank
from feedledger.session import stage

ship(__name__)

WORD = r"[^\x20\x09-\x0D]+"
MOST_COPIES = 3
GRADES = 16
# A class of sizes is cut at one of so many places; with fewer documents, after each of them.
CUTS = 1024


def word_count(text: Column) -> Column:
    """Words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """Adds ``target`` to one row per source with ``source``, ``source_size``.

    Sources by code point, null last, weigh ``weights``, repeating, and share the sum of all
    sizes. A target stops at ``most`` times its source's size and the excess is shared anew
    among the others by weight: so all that are not stopped get one level times their weight.
    The level only rises from round to round, and two numbers come to the driver in each.
    """
    ranked = global_rank(sources, ["null_source", "source"], "__rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("__rank") - 1) % len(weights) + 1).cast("int"))
    table = stage(ranked.withColumn("__weight", weight.cast("long")).drop("__rank"), "weights")
    limit = most * F.col("source_size")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        at_limit = limit <= F.lit(level) * F.col("__weight")
        now = table.agg(F.count_if(at_limit), F.sum(F.when(at_limit, limit)), F.sum(F.when(~at_limit, F.col("__weight")))).first()
        if now[0] == stopped or not now[2]:
            break
        stopped, level = now[0], (total - (now[1] or 0)) / now[2]
    return table.withColumn("target", F.least(limit.cast("double"), F.lit(level) * F.col("__weight"))).drop("__weight")


def expected_copies(sizes: list[int], grades: list[int], target: float, most: int = MOST_COPIES) -> list[float]:
    """Copies per document for groups of so many words and so high a grade, that take ``target`` words.

    They are in proportion to the grade, but at most ``most``; what that stops goes to the others.
    """
    copies = [0.0] * len(sizes)
    left = {i for i in range(len(sizes)) if sizes[i]}
    words = target
    while left:
        rate = words / sum(sizes[i] * grades[i] for i in left)
        full = {i for i in left if rate * grades[i] >= most}
        if not full:
            for i in left:
                copies[i] = rate * grades[i]
            break
        for i in full:
            copies[i] = float(most)
            words -= most * sizes[i]
        left -= full
    return copies


def cut_classes(rows: list[tuple[int, int, float, int]]) -> dict[int, int]:
    """For each class of sizes, below which place of the Pareto order its documents are taken.

    ``rows`` are (class, place, expected words, words). Each class takes the documents that
    come first, until their words are nearest to what is expected of it. What it takes too
    much or too little is carried from the longest documents down to the shortest, so that the
    whole source ends within about half of a short document.
    """
    by_class: dict[int, list] = {}
    for size_class, place, expected, words in rows:
        by_class.setdefault(size_class, []).append((place, expected, words))
    cuts, carried = {}, 0.0
    for size_class in sorted(by_class, reverse=True):
        places = sorted(by_class[size_class])
        goal = carried + sum(expected for _, expected, _ in places)
        taken, cut, best = 0, 0, abs(goal)
        for place, _, words in places:
            taken += words
            if abs(goal - taken) < best:
                best, cut = abs(goal - taken), place + 1
        cuts[size_class] = cut
        carried = goal - sum(words for place, _, words in places if place < cut)
    return cuts


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), grade_col: str | None = None, seed: int = 13,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    Each source's target is met by whole copies of its documents. Documents of a source are
    expected equally often, or in proportion to ``grade_col`` (whole numbers, held between 1 and
    16; null counts as 1). The whole part of that number is certain. For the fraction p, a
    document draws u in (0, 1) from its id and text, and those with the smallest
    u / (1 - u) : p / (1 - p) are taken: a Pareto order sample of fixed size in words, one for
    each class of sizes (powers of two) of each source.

    A document's place in that order is one of 1,024; the words per place, class and source are
    summed before they are shuffled, so one source's plan is made from at most 64 * 1,024 sums
    however many documents it has. Rows of a source are joined to its plan without being
    gathered. No draw depends on where a row lies, so reruns agree; rows that repeat id and
    text are taken alike. Null and empty texts have size 0 and are taken as 0 words; null ids
    are drawn by their text; null sources are one source, the last; other columns are ignored;
    an empty table gives no row.
    """
    grade = F.least(F.greatest(F.coalesce(F.col(grade_col).cast("int"), F.lit(1)), F.lit(1)), F.lit(GRADES)) if grade_col else F.lit(1)
    source = F.col(source_col)
    narrow = stage(docs.select(
        F.col(id_col).alias("id"), F.coalesce(source, F.lit("")).alias("source"), source.isNull().alias("null_source"),
        word_count(F.col(text_col)).alias("size"), grade.alias("grade"),
        # 52 bits of a hash, in the middle of their step, so neither 0 nor 1 occurs.
        ((F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 12) + 0.5) / float(1 << 52)).alias("u"),
    ), "mix-documents")
    source_keys = ["null_source", "source"]
    by_grade = stage(narrow.groupBy(*source_keys, "grade").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "grades")
    sources = stage(targets(by_grade.groupBy(*source_keys).agg(F.sum("words").alias("source_size"), F.sum("n").alias("n")), weights),
                    "targets")

    def rate(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("grade")
        target = float(group["target"].iloc[0])
        copies = expected_copies(group["words"].tolist(), group["grade"].tolist(), target)
        by = dict(zip(group["grade"].tolist(), copies))
        return pd.DataFrame({"null_source": [group["null_source"].iloc[0]], "source": [group["source"].iloc[0]],
                             "source_size": [group["source_size"].iloc[0]], "target": [target], "n": [group["n"].iloc[0]],
                             "rates": [[by.get(g, 0.0) for g in range(1, GRADES + 1)]]})

    # At most 16 grades of a source meet here.
    rates = stage(by_grade.drop("n").join(sources, source_keys).groupBy(*source_keys).applyInPandas(
        rate, "null_source boolean, source string, source_size long, target double, n long, rates array<double>"), "rates")

    expected = F.element_at("rates", F.col("grade"))
    p = expected - F.floor(expected)
    odds = (F.col("u") / (1 - F.col("u"))) * ((1 - p) / F.nullif(p, F.lit(0.0)))
    rated = join_by_source(narrow, rates, source_keys)
    placed = stage(rated.select(
        "id", *source_keys, "size", "source_size", "target", F.floor(expected).cast("int").alias("base"),
        (p * F.col("size")).alias("expected"),
        F.length(F.conv(F.col("size").cast("string"), 10, 2)).cast("int").alias("class"),
        F.when((p > 0) & (F.col("size") > 0), F.least(F.floor(odds / (1 + odds) * CUTS), F.lit(CUTS - 1)).cast("int")).alias("place"),
    ), "mix-places")
    sums = placed.where("place IS NOT NULL").groupBy(*source_keys, "class", "place").agg(
        F.sum("expected").alias("expected"), F.sum("size").alias("size"))

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["class", "place"])
        cuts = cut_classes(list(zip(group["class"], group["place"], group["expected"], group["size"])))
        return pd.DataFrame({"null_source": [group["null_source"].iloc[0]], "source": [group["source"].iloc[0]],
                             "cuts": [[cuts.get(c, 0) for c in range(65)]]})

    plans = sums.groupBy(*source_keys).applyInPandas(plan, "null_source boolean, source string, cuts array<int>")
    plans = stage(rates.select(*source_keys, "n").join(plans, source_keys, "left"), "mix-plans")
    chosen = F.coalesce(F.col("place") < F.element_at("cuts", F.col("class") + 1), F.lit(False))
    mixed = (join_by_source(placed, plans, source_keys)
             .withColumn("copies", F.col("base") + F.when(chosen, 1).otherwise(0)))
    return mixed.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies",
                        (F.col("size") * F.col("copies")).cast("long").alias("taken"))

