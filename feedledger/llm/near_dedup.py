"""Near-duplicate texts by BagMinHash, banding and verified multiset overlap (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from feedledger.llm.components import components
from feedledger.llm.sieve import passes, sieve
from feedledger.llm.worker import kept, ship
from feedledger.session import stage

ship(__name__)

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 64, 8  # a pair at similarity 0.8 shares no band with probability 1e-5
# Bands are settled in two steps: the first few gather nearly all of a large class, so few buckets of the others are open.
BAND_STEPS = ((4, 1), (BANDS, 4))  # up to which band, and pivots of a bucket in the step's first round
MORE_PIVOTS = 16  # growth of the pivots from round to round
MAP_WORDS = 8  # a candidate's item map has 64 bits a word
BATCH_BYTES = 1 << 21

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEPARATOR = 10  # a byte that is in no word


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte values, powers for places in a word, and which bytes belong to words."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
    powers = np.cumprod(np.full(1 << 16, _ODD, np.uint64))
    word = np.array([b >= 128 or chr(b).isalnum() or b == 95 for b in range(256)])
    return values, powers, word


def shingles(raw: bytes, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of ``WORDS`` words in lower-cased UTF-8 texts laid end to end.

    ``docs`` gives each byte's document. A word is a maximal run of ASCII letters, digits,
    underscores and non-ASCII characters. A text of fewer words, but at least one, has all its
    words as its only shingle.
    """
    values, powers, word = kept("shingle tables", _tables)
    data = np.frombuffer(raw, np.uint8)
    inside = word[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts = np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    ends = np.append(np.flatnonzero(edge == -1), len(data))[:len(starts)]
    at = np.flatnonzero(inside)
    lengths = ends - starts
    place = at - np.repeat(starts, lengths)
    firsts = np.cumsum(lengths) - lengths
    hashes = mix(np.add.reduceat(values[data[at]] * powers[place & 0xFFFF], firsts) + lengths.astype(np.uint64))
    owner = docs[starts]
    count = np.bincount(owner, minlength=docs[-1] + 1)
    short = np.flatnonzero((count > 0) & (count < WORDS))
    runs = len(hashes) - WORDS + 1
    whole = np.empty(0, np.int64)
    made = np.empty(0, np.uint64)
    if runs > 0:
        whole = np.flatnonzero(owner[:runs] == owner[WORDS - 1:])
        made = np.zeros(len(whole), np.uint64)
        for k in range(WORDS):
            made = mix(made * _ODD + hashes[whole + k])
    out_docs, out = owner[whole], mix(made + np.uint64(WORDS))
    if len(short):
        first = np.searchsorted(owner, short)
        few = np.zeros(len(short), np.uint64)
        for k in range(WORDS - 1):
            has = count[short] > k
            few[has] = mix(few[has] * _ODD + hashes[first[has] + k])
        out_docs, out = np.concatenate([out_docs, short]), np.concatenate([out, mix(few + count[short].astype(np.uint64))])
    return out_docs, out


def bags(docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) with their counts, by document."""
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return docs[first], hashes[first], np.diff(np.append(first, len(docs)))


def bag_minhash(docs: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """Signatures of weighted sets: ``size`` values per document; the share of equal values
    estimates the weighted Jaccard similarity without bias.

    Weights are discretised into the levels 1, 2, 3, ... and the levels into a hierarchy of
    ranges [0,1), [1,2), [2,4), [4,8), ... Every (element, range) carries a Poisson process whose
    rate is the width of the range; its points fall on random signature places and, inside the
    range, on random levels, and count for a document when the level lies below its weight.
    A place keeps its earliest point. Processes run side by side, in rounds of one point each,
    and end when they are later than every place of their document, which is soon for large
    bags and independent of their weights.
    """
    best = np.full(n_docs * size, np.inf)
    top = np.frexp(counts.astype(np.float64) - 0.5)[1].clip(0)  # the last range that begins below the weight
    ranges = top + 1
    element = np.repeat(np.arange(len(docs)), ranges)
    level = np.arange(len(element)) - np.repeat(np.cumsum(ranges) - ranges, ranges)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.maximum(low, 1)
    share = np.minimum(1.0, (counts[element] - low) / width)
    owner = docs[element]
    state = mix(hashes[element] + level.astype(np.uint64) * _ODD)
    time = np.zeros(len(element))
    present = np.unique(docs)
    while len(owner):
        state = mix(state + _ODD)
        time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / width
        other = mix(state ^ np.uint64(0xD1B54A32D192ED03))
        counted = (other >> np.uint64(32)).astype(np.float64) * 2.0 ** -32 < share
        place = owner * size + ((other & np.uint64(0xFFFFFFFF)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(best, place[counted], time[counted])
        latest = np.zeros(n_docs)
        latest[present] = best.reshape(n_docs, size)[present].max(axis=1)
        alive = time < latest[owner]
        owner, state, time, width, share = owner[alive], state[alive], time[alive], width[alive], share[alive]
        present = np.unique(owner)
    return best.reshape(n_docs, size)


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Rows of a batch in runs of about ``BATCH_BYTES``: first, last, texts end to end, bytes' rows."""
    rows, parts, held, first = [], [], 0, 0
    column = batch.column(1)
    for row in range(len(column)):
        raw = (column[row].as_py() or "").lower().encode()
        parts.append(raw)
        held += len(raw)
        rows.append(len(raw) + 1)
        if held >= BATCH_BYTES or row == len(column) - 1:
            joined = bytes([_SEPARATOR]).join(parts) + bytes([_SEPARATOR])
            yield first, row + 1, joined, np.repeat(np.arange(len(rows)), rows)
            rows, parts, held, first = [], [], 0, row + 1


def _digests(docs: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: the bag's size and 128 bits that name the bag."""
    sizes = np.bincount(docs, counts, n).astype(np.int64)
    names = []
    for salt in (1, 2):
        sums = np.zeros(n, np.uint64)
        np.add.at(sums, docs, mix(hashes ^ mix(counts.astype(np.uint64) + np.uint64(salt))))
        names.append(sums.view(np.int64))
    return sizes, *names


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n`` (shingles with repeats), ``bag_a``, ``bag_b`` (the bag's name), ``bands``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, raw, owner in _groups(batch):
                d, h, c = bags(*shingles(raw, owner))
                n = last - first
                sizes, a, b = _digests(d, h, c, n)
                # Exact copies inside the run are signed once.
                lead = {}
                source = np.array([lead.setdefault(k, i) for i, k in enumerate(zip(a.tolist(), b.tolist(), strict=True))])
                leads = np.flatnonzero(source == np.arange(n))
                number = np.zeros(n, np.int64)
                number[leads] = np.arange(len(leads))
                own = source[d] == d
                signed = bag_minhash(number[d[own]], h[own], c[own], len(leads), BANDS * ROWS).view(np.uint64)
                bands = np.zeros((len(leads), BANDS), np.uint64)
                for k in range(ROWS):
                    bands = mix(bands * _ODD + signed.reshape(len(leads), BANDS, ROWS)[:, :, k])
                bands = mix(bands + np.arange(BANDS, dtype=np.uint64)).view(np.int64)[number[source]]
                bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(sizes), pa.array(a), pa.array(b), bands],
                    names=["id", "n", "bag_a", "bag_b", "bands"])

    narrow = docs.select(F.col(id_col).alias("id"), text_col)
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, n long, bag_a long, bag_b long, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text whose id passes the sieve ``wanted``: its bag's name, ``items``, a number
    for every shingle and repeat of it, and ``map``, in which every item sets one bit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(passes(wanted, batch.column(0).to_numpy())))
            for first, last, raw, owner in _groups(batch):
                d, h, c = bags(*shingles(raw, owner))
                n = last - first
                _, a, b = _digests(d, h, c, n)
                repeat = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                items = mix(np.repeat(h, c) + repeat.astype(np.uint64) * _ODD).view(np.int64)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(d, c, n).astype(np.int64))])
                bit = items.view(np.uint64) >> np.uint64(32)
                maps = np.zeros(n * MAP_WORDS, np.uint64)
                np.bitwise_or.at(maps, np.repeat(d, c) * MAP_WORDS + (bit >> np.uint64(6)).astype(np.int64) % MAP_WORDS, np.uint64(1) << (bit & np.uint64(63)))
                maps = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * MAP_WORDS, pa.int32()), pa.array(maps.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(b), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(items)), maps],
                    names=["bag_a", "bag_b", "items", "map"])

    return docs.select(F.xxhash64(id_col), text_col).mapInArrow(run, "bag_a long, bag_b long, items array<long>, map array<long>")


def _slots(nodes: DataFrame, wanted: np.ndarray) -> DataFrame:
    """A row per node and band whose bucket passes the sieve: ``bucket``, ``band``, ``node``, ``n``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets = batch.column(2).flatten().to_numpy()
            at = np.flatnonzero(passes(wanted, buckets))
            rows = pa.array(at // BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(buckets[at]), pa.array((at % BANDS).astype(np.int32)), batch.column(0).take(rows), batch.column(1).take(rows)],
                                             names=["bucket", "band", "node", "n"])

    return nodes.select("node", "n", "bands").mapInArrow(run, "bucket long, band int, node long, n long")


def _overlap(threshold: float) -> Column:
    """Whether two item sets reach the threshold: multiset Jaccard, exact on the items."""
    shared = F.size(F.array_intersect("items", "pivot_items"))
    return shared >= F.lit(threshold) * (F.size("items") + F.size("pivot_items") - shared)


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``class_id`` (smallest id of its class), ``class_size``.

    Classes are the connected components over texts whose bags of five-word shingles have a
    multiset Jaccard similarity of ``threshold`` or more, found through shared bands and
    verified exactly. Texts with equal bags are one node from the start, however many copies there
    are. Shingles that no other candidate has bound the overlap a text can reach, so texts
    that are all too much their own meet nobody, and pairs that cannot reach the threshold are
    never made; so do maps of 512 bits: two items that differ in a bit are not the same. Both bounds
    are exact. In a bucket of a band, a
    pivot, the member with the smallest share of own shingles first, meets the members that are
    not yet in its component, and then leaves the bucket; a bucket ends when
    those left are of one component, so every candidate link is verified or implied. Each
    round takes more pivots, so rounds are few, and works out components from its new links
    between the components before it. A few bands are settled first: they join nearly
    all of a large class, whose members are then of one component in the other bands' buckets.
    Members that agree in a band, share most of their shingles and yet are not linked do meet
    each other in the later rounds, as far as the bounds let them. Nulls, empty texts and texts
    without a word are classes of their own; a null id counts as smallest; repeated rows fall
    in one class; other columns are ignored.
    """
    signed = stage(signatures(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "signatures")
    nodes = stage(signed.where("n > 0").groupBy("bag_a", "bag_b").agg(F.min(F.struct("row", "id")).alias("first"), F.min("n").alias("n"))
                  .select("bag_a", "bag_b", "n", F.col("first.row").alias("node"), F.col("first.id").alias("id")), "nodes")
    bands = signed.select("row", "bands").join(nodes.select("node", "n"), F.col("row") == F.col("node"))
    bands = stage(bands.select("node", "n", "bands"), "bands")
    shared = stage(bands.select(F.explode("bands").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("members"))
                   .where("members > 1").select("bucket"), "shared-buckets")
    members = stage(_slots(bands, sieve(shared, "bucket")).join(shared, "bucket"), "bucket-members")
    label = _labels(docs, nodes, members, threshold, id_col, text_col)
    named = (signed.join(nodes.select("bag_a", "bag_b", "node"), ["bag_a", "bag_b"], "left")
             .join(label.withColumnRenamed("node", "labelled"), F.col("node") == F.col("labelled"), "left")
             .select("id", F.coalesce("component", "node", "row").alias("class")))
    named = stage(named, "classes")
    classes = named.groupBy("class").agg(F.min(F.struct("id")).alias("least"), F.count("*").alias("class_size"))
    return (named.join(classes, "class")
            .select(F.col("id").alias(id_col), F.col("least.id").alias("class_id"), "class_size"))


def _labels(docs, nodes, members, threshold, id_col, text_col) -> DataFrame:
    """The components of all verified candidate links: ``node``, ``component``; nodes without a link may be absent."""
    wanted = stage(nodes.join(members.select("node").distinct(), "node", "left_semi").withColumn("key", F.xxhash64("id")), "candidates")
    sets = (shingle_sets(docs, sieve(wanted, "key"), id_col, text_col).join(wanted, ["bag_a", "bag_b"]).groupBy("node")
            .agg(F.first("items").alias("items"), F.first("map").alias("map")))
    sets = stage(sets, "shingle-sets")
    members = stage(members.join(_common(sets, threshold), "node")
                    .select("bucket", "band", "node", "n", "common", "map", F.col("node").alias("component")), "bucket-members")
    label, first = members.select("node", "component").limit(0), 0
    for last, pivots in BAND_STEPS:
        own = members.where((F.col("band") >= first) & (F.col("band") < last)).drop("band")
        label, first = _settled(_open(_relabelled(own, label)), label, sets, threshold, pivots), last
    return label


def _settled(members, label, sets, threshold, pivots_per_bucket) -> DataFrame:
    """The components after the rounds that settle all buckets of ``members``.

    A pivot meets every member that its bucket still has, and then leaves it: nobody is left there for it to meet.
    """
    while not members.isEmpty():
        chosen = stage(_pivots(members, pivots_per_bucket), "pivots")
        pivots = stage(members.join(chosen, ["bucket", "node"]), "pivot-members")
        members = stage(members.join(chosen, ["bucket", "node"], "left_anti"), "bucket-members")
        new = _verified(stage(_pairs(members, pivots, threshold), "pairs"), sets, threshold)
        if not new.isEmpty():
            joined = components(new, "component", "pivot_component")
            members = stage(_relabelled(members, joined), "bucket-members")
            label = stage(_relabelled(label, joined).union(joined.join(label.select("node"), "node", "left_anti")), "labels")
        members = _open(members)
        pivots_per_bucket *= MORE_PIVOTS
    return label


def _common(sets: DataFrame, threshold: float) -> DataFrame:
    """Nodes that may have a partner: ``node``, ``map`` and ``common``, how many of its items other nodes have too.

    Two sets share no more than the smaller ``common``, so a node with less than the threshold's
    share of its own size has no partner. Items are counted by partial aggregates; an item of one node
    alone is handed to that node.
    """
    own = (sets.select("node", F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("nodes"), F.min("node").alias("node"))
           .where("nodes = 1").groupBy("node").agg(F.count("*").alias("own")))
    common = F.col("size") - F.coalesce("own", F.lit(0))
    sized = sets.select("node", "map", F.size("items").cast("long").alias("size")).join(own, "node", "left")
    return stage(sized.where(common >= F.lit(threshold) * F.col("size")).select("node", "map", common.alias("common")), "common-items")


def _pivots(members: DataFrame, per_bucket: int) -> DataFrame:
    """Up to ``per_bucket`` members of each bucket: ``bucket``, ``node``."""
    spread = F.pmod(F.xxhash64("node"), F.lit(per_bucket))
    first = F.struct(((F.col("n") - F.col("common")) / F.col("n")).alias("own"), F.col("node"))
    return (members.groupBy("bucket", spread.alias("spread")).agg(F.min(first).alias("first"))
            .select("bucket", F.col("first.node").alias("node")))


def _pairs(members: DataFrame, pivots: DataFrame, threshold: float) -> DataFrame:
    """Pairs of a pivot and a member of another component that may reach the threshold, with their components.

    Two pivots of a bucket are paired once. Items that differ in their maps are not shared, so the sizes less the
    differing bits hold the shared items twice at most.
    """
    own = pivots.select("bucket", F.col("node").alias("pivot"), F.col("n").alias("pivot_n"), F.col("common").alias("pivot_common"),
                        F.col("map").alias("pivot_map"), F.col("component").alias("pivot_component"))
    sizes = F.col("n") + F.col("pivot_n")
    differ = sum(F.bit_count(F.get("map", F.lit(k)).bitwiseXOR(F.get("pivot_map", F.lit(k)))) for k in range(MAP_WORDS))
    near = F.col("component") != F.col("pivot_component")
    for most in (F.least("common", "pivot_common"), (sizes - differ) / 2):
        near &= most >= F.lit(threshold) * (sizes - most)
    swap = F.col("node") < F.col("pivot")
    among = pivots.join(own, "bucket").where(near & (F.col("node") > F.col("pivot")))
    return (members.join(own, "bucket").where(near).union(among)
            .select(F.greatest("node", "pivot").alias("node"), F.least("node", "pivot").alias("pivot"),
                    F.when(swap, F.col("pivot_component")).otherwise(F.col("component")).alias("component"),
                    F.when(swap, F.col("component")).otherwise(F.col("pivot_component")).alias("pivot_component")).distinct())


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between the components that the pairs reaching the threshold belong to: ``component``, ``pivot_component``."""
    # Most sets are in no pair of the round; the others are left where they lie.
    ends = pairs.select("node").union(pairs.select("pivot")).distinct()
    items = sets.select("node", "items").join(ends, "node", "left_semi")
    found = (pairs.join(items, "node")
             .join(items.select(F.col("node").alias("pivot"), F.col("items").alias("pivot_items")), "pivot")
             .where(_overlap(threshold)).select("component", "pivot_component").distinct())
    return stage(found, "links")


def _relabelled(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows with the components that theirs have become part of."""
    joined = joined.select(F.col("node").alias("before"), F.col("component").alias("joined"))
    return (rows.join(joined, F.col("component") == F.col("before"), "left")
            .withColumn("component", F.coalesce("joined", "component")).drop("before", "joined"))


def _open(members: DataFrame) -> DataFrame:
    """Members of the buckets whose rows are of several components."""
    buckets = (members.groupBy("bucket")
               .agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket"))
    return stage(members.join(buckets, "bucket"), "bucket-members")


def keep_one(docs: DataFrame, threshold: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its class, with all their columns.

    Rows that repeat one id are all kept or all dropped; a stage before this one leaves no exact copies.
    """
    kept_ids = near_duplicates(docs, threshold, id_col, text_col).select(F.col("class_id").alias("__keep")).distinct()
    return docs.join(kept_ids, F.col(id_col).eqNullSafe(F.col("__keep")), "left_semi")
