"""Periodic runs of words, by tiles per octave of periods and boundary Z-functions (operator 12)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from feedledger.llm.worker import ship
from feedledger.session import stage

ship(__name__)

# A run repeats its period this often at least, and has so many words at least.
REPEATS, SHORTEST = 4, 6
TILE_WORDS = 8192
GROUP_WORDS = 1 << 18
# Any odd multiplier serves; equal windows always have equal sums, whatever it is.
MULTIPLIER = 0x9E3779B97F4A7C15

RUNS_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"
_SPANS = pa.list_(pa.struct([("period", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())]))
_TILES = pa.list_(pa.struct([("octave", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))]))


def z_function(s: list) -> list[int]:
    """For each place, how many items from there on equal the beginning of ``s``."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


@cache
def _proper_divisors(period: int) -> tuple[int, ...]:
    """The period divided by each of its prime factors."""
    found, rest, factor = [], period, 2
    while factor * factor <= rest:
        if rest % factor == 0:
            found.append(period // factor)
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return (*found, period // rest) if rest > 1 else tuple(found)


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, 2**bits of them."""
    n = 1 << bits
    both = np.ones((2, n), np.uint64)
    for row, base in zip(both, (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64))):
        done = 1
        while done < n:
            row[done:2 * done] = row[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
    return both[0], both[1]


def _scattered(ids: np.ndarray) -> np.ndarray:
    """Word numbers spread over 64 bits, different ones to different values."""
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def octave_spans(ids: np.ndarray, octave: int) -> list[tuple[int, int, int]]:
    """Maximal spans ``(period, lo, hi)`` of places that equal the place ``period`` further on.

    Periods from ``octave`` up to twice that are looked for, spans of at least 2 * octave places
    are found, and those whose words have a smaller period are left out. Boundaries lie 2 *
    octave apart; a span that long reaches ``octave`` places before or after one of them, so a
    boundary is taken up only where such a window recurs one period on. This is seen from the
    windows' sums for all boundaries and periods at once, and loses nothing, since equal
    windows have equal sums. There the Z-function of the tile after the boundary, and that of
    the tile before it read backwards, give how far each period holds on either side.
    """
    step = 2 * octave
    rows = len(ids) // step + 2
    total = rows * step + octave
    # The padding equals no word and no other padding.
    padded = np.concatenate([ids, -(1 << 48) - np.arange(total - len(ids), dtype=np.int64)])
    power, inverse = _powers(max(total - 1, 1).bit_length())
    sums = np.zeros(total + 1, np.uint64)
    np.cumsum(_scattered(padded) * power[:total], out=sums[1:])
    windows = ((sums[octave:] - sums[:-octave])[:rows * step] * inverse[:rows * step]).reshape(rows, step)
    hit = windows[:, octave:] == windows[:, :1]
    hit[1:] |= windows[1:, :octave] == windows[:-1, octave:octave + 1]

    found: dict[int, list[int]] = {}
    out: list[tuple[int, int, int]] = []
    boundaries, lags = np.nonzero(hit)
    cuts = np.flatnonzero(np.diff(boundaries)) + 1
    for own in np.split(np.arange(len(boundaries)), cuts) if len(boundaries) else ():
        at = int(boundaries[own[0]]) * step
        first = max(0, at - step)
        tile = padded[first:at + 2 * step].tolist()
        before = at - first
        ahead = z_function(tile[before:])
        size = before + min(step, len(tile) - before)
        back = z_function([*tile[:before][::-1], None, *tile[:size][::-1]])
        for lag in lags[own].tolist():
            period = octave + lag
            if period >= len(ahead):
                continue
            forward, backward = ahead[period], back[before + 1 + size - before - period]
            backward = min(backward, before)
            if forward + backward < step:
                continue
            piece = tile[before - backward:before - backward + 2 * period]
            if any(piece[d:] == piece[:-d] for d in _proper_divisors(period)):
                continue
            lo, hi = at - backward, at + forward
            open_span = found.get(period)
            if open_span and lo <= open_span[1]:
                open_span[1] = max(open_span[1], hi)
            else:
                if open_span:
                    out.append((period, *open_span))
                found[period] = [lo, hi]
    out.extend((period, *span) for period, span in found.items())
    return out


def _long_enough(period: int, lo: int, hi: int) -> bool:
    return hi - lo + period >= max(SHORTEST, REPEATS * period)


def octaves(n: int) -> Iterator[int]:
    """The octaves that hold a period of a run in ``n`` words."""
    octave = 1
    while n >= max(SHORTEST, REPEATS * octave):
        yield octave
        octave *= 2


def _whole_documents(docs: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """The spans of runs of each document, each being one tile; they are solved side by side."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    for octave in octaves(max(map(len, docs), default=0)):
        own = [i for i, ids in enumerate(docs) if len(ids) >= max(SHORTEST, REPEATS * octave)]
        parts, starts, at = [], [], 0
        for i in own:
            starts.append(at)
            parts += [docs[i], np.array([-1 - i], np.int64)]  # no period reaches across
            at += len(docs[i]) + 1
        for period, lo, hi in octave_spans(np.concatenate(parts), octave):
            if _long_enough(period, lo, hi):
                k = int(np.searchsorted(starts, lo, "right")) - 1
                out[own[k]].append((period, lo - starts[k], hi - starts[k]))
    return out


def tiles_of(ids: np.ndarray, tile_words: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(octave, start, words)`` of the overlapping tiles of a long document.

    A tile goes 8 octaves into the next one. A span that crosses into the next tile is either
    whole in one of them, or long enough in both to be found there, and the pieces overlap.
    """
    for octave in octaves(len(ids)):
        core = max(tile_words, 16 * octave)
        for start in range(0, len(ids), core):
            yield octave, start, ids[start:start + core + 8 * octave]


def _digest_or_text(words: list[bytes], digest: bool) -> str:
    text = b" ".join(words)
    return sha256(text).hexdigest() if digest else text.decode()


def find_runs(docs: DataFrame, rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None, digest: bool = False,
              tile_words: int = TILE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``runs`` by start and period, and ``collapsed``.

    Words are separated by space and the characters 9 to 13. A run is a longest stretch of
    words with smallest period ``period`` that is at least 6 words and 4 periods long.
    ``collapsed`` joins by one space the words that no run repeats, that is, without what lies
    past the first period of a run; with ``digest`` it is the SHA-256 of that text.
    ``rewrite`` may change a row's words first.

    Documents up to ``tile_words`` words are one tile per octave of periods and solved as they
    are read, many side by side. Longer ones are exploded into overlapping tiles per octave,
    which are dealt over all tasks. All spans are then shuffled by document and period and
    stitched; only rows with a span or a tile carry their text further.

    Null and empty texts have no words; null ids and repeated rows are worked on each; other
    columns are ignored; an empty table gives no row.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = 0, batch.num_rows
            while at < n:
                first, size, words, arrays, known = at, 0, [], [], {}
                while at < n and (size < GROUP_WORDS or at == first):
                    own = (batch.column(1)[at].as_py() or "").encode().split()
                    if rewrite:
                        own = rewrite(batch.column(0)[at].as_py(), own)
                    words.append(own)
                    arrays.append(np.array([known.setdefault(w, len(known)) for w in own], np.int64))
                    size += len(own)
                    at += 1
                short = [i for i, ids in enumerate(arrays) if len(ids) <= tile_words]
                spans: list[list] = [[] for _ in arrays]
                for i, found in zip(short, _whole_documents([arrays[i] for i in short])):
                    spans[i] = [{"period": p, "lo": lo, "hi": hi} for p, lo, hi in found]
                tiles = [[] if len(ids) <= tile_words else
                         [{"octave": o, "start": s, "ids": t.astype(np.int32)} for o, s, t in tiles_of(ids, tile_words)]
                         for ids in arrays]
                opened = [bool(s or t) for s, t in zip(spans, tiles)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, at - first), pa.array(opened), pa.array(spans, _SPANS), pa.array(tiles, _TILES),
                    pa.array([b" ".join(w).decode() if o else None for w, o in zip(words, opened)], pa.string()),
                    pa.array([None if o else _digest_or_text(w, digest) for w, o in zip(words, opened)], pa.string()),
                ], names=[id_col, "__open", "__spans", "__tiles", "__words", "collapsed"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, octave, start, ids in zip(*(batch.column(i) for i in range(4))):
                words = np.asarray(ids.values.to_numpy(zero_copy_only=False), np.int64)
                rows += [(row.as_py(), p, lo + start.as_py(), hi + start.as_py())
                         for p, lo, hi in octave_spans(words, octave.as_py())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["__row", "period", "lo", "hi"])

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(batch.column("__words"), batch.column("runs")):
                words = text.as_py().split(" ") if text.as_py() else []
                keep = np.ones(len(words), bool)
                for run in runs.as_py():
                    keep[run["start"] + run["period"]:run["start"] + run["length"]] = False
                out.append(_digest_or_text([words[i].encode() for i in np.flatnonzero(keep)], digest))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("runs"), pa.array(out, pa.string())],
                                             names=[id_col, "runs", "collapsed"])

    narrow = docs.select(F.col(id_col), F.col(text_col))
    kind = narrow.schema[id_col].dataType.simpleString()
    # A row's number is fixed once the rows are written.
    read = stage(narrow.mapInArrow(scan, f"`{id_col}` {kind}, __open boolean, __spans array<struct<period:bigint,lo:bigint,hi:bigint>>, "
                                         "__tiles array<struct<octave:bigint,start:bigint,ids:array<int>>>, __words string, collapsed string")
                 .withColumn("__row", F.monotonically_increasing_id()), "period-scan")
    tiles = read.where("__open").select("__row", F.inline("__tiles"))
    # As many tasks as the session shuffles to: a tile is work in proportion to its words, whoever's it is.
    solved = tiles.repartition(F.col("__row"), F.col("octave"), F.col("start")).mapInArrow(
        solve, "__row long, period long, lo long, hi long")
    spans = read.where("__open").select("__row", F.inline("__spans")).unionByName(solved)

    runs = (stitched(spans, ["__row", "period"]).where(
        (F.col("hi") - F.col("lo") + F.col("period")) >= F.greatest(F.lit(SHORTEST), REPEATS * F.col("period")))
        .groupBy("__row").agg(F.sort_array(F.collect_list(F.struct(
            F.col("lo").alias("start"), (F.col("hi") - F.col("lo") + F.col("period")).alias("length"), "period"))).alias("runs")))
    opened = (read.where("__open").select("__row", id_col, "__words").join(runs, "__row", "left")
              .select(id_col, "__words", F.coalesce("runs", F.array().cast(RUNS_TYPE)).alias("runs")))
    closed = read.where("NOT __open").select(id_col, F.array().cast(RUNS_TYPE).alias("runs"), "collapsed")
    return closed.unionByName(opened.mapInArrow(collapse, f"`{id_col}` {kind}, runs {RUNS_TYPE}, collapsed string"))


def stitched(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans ``lo`` up to ``hi`` of equal ``keys`` that overlap or touch, joined into one.

    A group holds the spans of one period of one document, a few per tile; they are streamed
    in order, not gathered.
    """
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    reached = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reached.isNull() | (F.col("lo") > reached), 1).otherwise(0)
    return (spans.withColumn("__begins", begins)
            .withColumn("__island", F.sum("__begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy(*keys, "__island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("__island"))
