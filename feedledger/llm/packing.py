"""Best-fit packing of token pieces by exact complements (operator 5)."""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

from feedledger.llm.units import tokenizer_cache
from feedledger.llm.worker import ship
from feedledger.session import stage

ship(__name__)


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0,
                    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32`` and ``ids``.

    A text's ids are those of the tokenizers file, then ``end_id``; only documents longer than
    ``capacity`` are cut, into pieces of that many ids. Null and empty texts give one piece that
    holds the end id alone; special tokens spelled out in a text get their own ids, as the
    library has it; repeated rows are cut each; other columns are ignored. No shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = tokenizer_cache(tokenizer_path)
        end = int(end_id).to_bytes(4, "little")
        step = 4 * capacity
        for batch in batches:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, encoded in enumerate(cache.many(v.as_py() for v in batch.column(1))):
                raw = encoded + end
                for k, at in enumerate(range(0, len(raw), step)):
                    part = raw[at:at + step]
                    rows.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                      pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    narrow = docs.select(id_col, text_col)
    kind = narrow.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long"
                             + (", ids array<int>" if with_ids else ""))


def plan_patterns(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fillings of a sequence and how often each is used, for so many pieces of each length.

    From the longest length down, the gap beside a piece is filled exactly: by one length, else
    by the sum of a pair, else of a triple, as the index of available lengths offers them,
    long parts first; each combination is consumed as often as its scarcest length allows.
    What no combination completes is then packed best fit, longest first, many equal pieces at
    a time. Time and memory depend on ``capacity``, not on how many pieces there are.
    """
    if any(not 0 < length <= capacity for length, n in counts.items() if n):
        raise ValueError("a piece must have at least one token and at most the capacity")
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns: list[tuple[tuple[int, ...], int]] = []

    def use(*parts: int) -> None:
        need = {p: parts.count(p) for p in parts}
        times = min(int(left[p]) // n for p, n in need.items())
        if times:
            patterns.append((parts, times))
            for p, n in need.items():
                left[p] -= n * times

    def pairs(gap: int, most: int) -> list[tuple[int, int]]:
        """Available pairs with that sum, the longer part first and at most ``most``."""
        longer = np.arange(min(most, gap - 1), (gap - 1) // 2, -1)
        longer = longer[(left[longer] > 0) & (left[gap - longer] > 0)]
        return [(a, gap - a) for a in longer.tolist()]

    for length in np.flatnonzero(left)[::-1].tolist():
        gap = capacity - length
        if not gap:
            use(length)
        elif gap <= length:
            use(length, gap)
        for a, b in pairs(gap, length) if left[length] else ():
            use(length, a, b)
            if not left[length]:
                break
        if left[length]:
            tops = np.arange(min(length, gap - 2), (gap - 1) // 3, -1)
            for a in tops[left[tops] > 0].tolist():
                for b, c in pairs(gap - a, a):
                    use(length, a, b, c)
                if not left[length]:
                    break

    # Best fit of the rest: open sequences are kept by gap, equal ones as one entry with a count.
    opened: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    gaps: list[int] = []

    def put(gap: int, parts: tuple[int, ...], times: int) -> None:
        if gap == 0:
            patterns.append((parts, times))
            return
        if not opened[gap]:
            bisect.insort(gaps, gap)
        opened[gap][parts] = opened[gap].get(parts, 0) + times

    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                fits = min(capacity // length, n)
                put(capacity - fits * length, (length,) * fits, n // fits)
                n %= fits
                continue
            gap = gaps[at]
            parts, times = opened[gap].popitem()
            if not opened[gap]:
                gaps.pop(at)
            used = min(n, times)
            if times > used:
                put(gap, parts, times - used)
            put(gap - length, (*parts, length), used)
            n -= used
    for gap in gaps:
        patterns.extend(opened[gap].items())
    return patterns


def lay_out(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Per length: rows (first rank, first sequence, offset), by rank.

    The pieces of one length are ranked from 0; the ranks from one row's first up to the next
    row's take that offset in consecutive sequences.
    """
    ranks: dict[int, int] = defaultdict(int)
    rows: dict[int, list] = defaultdict(list)
    sequence = 0
    for parts, times in patterns:
        offset = 0
        for p in parts:
            rows[p].append((ranks[p], sequence, offset))
            ranks[p] += times
            offset += p
        sequence += times
    return {p: np.array(r, np.int64) for p, r in rows.items()}


def pack(pieces: DataFrame, capacity: int = 2048, length_col: str = "length") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to every row of ``pieces``.

    Rows with the same ``sequence_id`` fill one sequence of ``capacity`` tokens, gapless from
    offset 0. The plan is made on the driver from the counts per length, a table of at most
    ``capacity`` rows, and sent out as per-length tables whose size depends on ``capacity``
    alone. Pieces are ranked within their length without gathering a length anywhere: they are
    written once with their place in their own partition, and each partition's count per
    length gives where its ranks begin. A null length, or one outside 1..capacity, is an error;
    an empty table stays empty.
    """
    columns = pieces.columns
    placed = stage(pieces.withColumn("__part", F.spark_partition_id())
                   .withColumn("__row", F.monotonically_increasing_id()), "pieces")
    per_part = stage(placed.groupBy("__part", length_col).agg(F.count("*").alias("__n")), "piece-counts")
    counts = {r[0]: r[1] for r in per_part.groupBy(length_col).agg(F.sum("__n")).collect()}
    if None in counts:
        raise ValueError("a piece has no length")
    table = lay_out(plan_patterns(counts, capacity))
    starts = per_part.select("__part", F.col(length_col).alias("__length"), F.sum("__n").over(_earlier(length_col)).alias("__start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(length_col).to_numpy(zero_copy_only=False)
            ranks = batch.column("__rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                rows = table[int(length)]
                at = np.searchsorted(rows[:, 0], ranks[own], "right") - 1
                sequence[own] = rows[at, 1] + ranks[own] - rows[at, 0]
                offset[own] = rows[at, 2]
            yield pa.RecordBatch.from_arrays([*map(batch.column, columns), pa.array(sequence), pa.array(offset)],
                                             names=[*columns, "sequence_id", "offset"])

    ranked = _rank_in_parts(placed, starts, length_col)
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.select(*columns, "__rank").mapInArrow(run, schema)


def _earlier(length_col: str) -> WindowSpec:
    return Window.partitionBy(length_col).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)


def _rank_in_parts(placed: DataFrame, starts: DataFrame, length_col: str) -> DataFrame:
    """``__rank`` of each row within its length: the earlier partitions' rows, then its own place."""
    own = F.row_number().over(Window.partitionBy("__part", length_col).orderBy("__row")) - 1
    return (placed.withColumn("__own", own).alias("p")
            .join(starts.alias("s"), (F.col("p.__part") == F.col("s.__part")) & (F.col(f"p.{length_col}") == F.col("s.__length")))
            .select("p.*", (F.coalesce(F.col("s.__start"), F.lit(0)) + F.col("__own")).cast("long").alias("__rank")))
