"""Prefix trie of conversations, by adaptive radix trees over turn ids (operator 11)."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5, sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from feedledger.llm.mixing import word_count
from feedledger.llm.radix_tree import RadixNode, RadixTree
from feedledger.llm.worker import ship
from feedledger.session import stage

ship(__name__)

# A turn id is the first 16 bytes, big-endian as they stand, of the SHA-256 of role and text.
ID_BYTES = 16
TURNS_PER_TASK = 200_000
OUT_ROWS = 10_000

NODE_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends", "ends_sha256")


def turn_id(role: Column, text: Column) -> Column:
    """Hexadecimal digits of a turn's id; equal for turns with equal role and text."""
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * ID_BYTES)


def conversation_turns(rows: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns``: (turn, id, words) of each conversation, in order, without texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return (rows.where(F.col("conv_id").isNotNull())
            .select("conv_id", F.struct(F.col("turn"), turn_id(role, text).alias("id"), word_count(text).alias("words")).alias("t"))
            .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))


def paths_of(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``path`` (its turn ids, one after another) and ``words`` of each turn."""
    ids = F.transform("turns", lambda t: t["id"])
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.unhex(F.array_join(ids, "")).alias("path"),
                                F.transform("turns", lambda t: t["words"]).alias("words"))


def _depths(node: RadixNode, above: int) -> range:
    """Depths of the trie nodes on the edge into ``node``, from the end of its parent on."""
    return range(above // ID_BYTES + 1, node.end // ID_BYTES + 1)


def _sums(tree: RadixTree) -> dict[int, tuple[int, int, int]]:
    """Per radix node what lies below its end: trie nodes right below, leaves and saved words.

    Only of nodes all of whose conversations are in this task; the others hold the first or the
    last of its conversations and are added up over all tasks.
    """
    below: dict[int, tuple[int, int, int]] = {}
    todo: list[tuple[RadixNode, bool]] = [(tree.root, False)]
    while todo:
        node, ready = todo.pop()
        children = node.below()
        if not ready:
            todo.append((node, True))
            todo.extend((child, False) for child in children)
            continue
        tops = leaves = saved = 0
        for child in children:
            depths, (t, l, s) = _depths(child, node.end), below[id(child)]
            if not depths:
                tops, leaves, saved = tops + t, leaves + l, saved + s
            elif not _shared(child, tree):
                tops += 1
                leaves += l or 1
                saved += s + (child.n - 1) * sum(child.sample[depths[0] - 1:depths[-1]])
        below[id(node)] = tops, leaves, saved
    return below


def _shared(node: RadixNode, tree: RadixTree) -> bool:
    """Whether other tasks may hold conversations of the node as well."""
    return node.first == 0 or node.last == tree.size - 1


def _chain(path: bytes) -> list[bytes]:
    """A name for each prefix of whole turns, the empty one first."""
    names = [md5(b"").digest()]
    for at in range(0, len(path), ID_BYTES):
        names.append(md5(names[-1] + path[at:at + ID_BYTES]).digest())
    return names


def _digest(ends: list[int]) -> str:
    return sha256(",".join(map(str, ends)).encode()).hexdigest()


def tree_rows(part: int, tree: RadixTree, first: bytes, last: bytes) -> Iterator[dict]:
    """The trie nodes of one task, parents first.

    Rows with a ``seq`` are nodes that other tasks may share, with what this task adds to them;
    the others are whole, but for the conversation of a shared parent, given by its seq.
    """
    below = _sums(tree)
    chains = _chain(first), _chain(last)
    seq = 0
    todo: list[tuple[RadixNode, int, int | None, int | None]] = [(tree.root, -1, None, None)]
    while todo:
        node, above, parent, parent_seq = todo.pop()
        depths = _depths(node, above) if above >= 0 else range(0, 1)
        shared = _shared(node, tree)
        tops, leaves, saved = below[id(node)]
        if not shared:  # from the deepest up, what each depth saves is added
            leaves = leaves or 1
            sums, total = [], saved
            for depth in reversed(depths):
                total += (node.n - 1) * node.sample[depth - 1]
                sums.append(total)
            sums.reverse()
        for k, depth in enumerate(depths):
            deepest = depth == depths[-1]
            ends = node.ends if deepest and node.end == depth * ID_BYTES else []
            row = {"part": part, "depth": depth, "conv_id": node.lowest, "n_convs": node.n, "n_ends": len(ends),
                   "parent_conv_id": parent, "parent_seq": parent_seq}
            if shared:
                row |= {"seq": seq, "name": chains[0 if node.first == 0 else 1][depth], "ends": ends,
                        "words": node.sample[depth - 1] if depth else 0, "n_children": tops if deepest else 0,
                        "n_leaves": leaves if deepest else 0, "saved_tokens": saved if deepest else 0}
                parent, parent_seq = None, seq
                seq += 1
            else:
                row |= {"n_children": tops if deepest else 1, "n_leaves": leaves, "saved_tokens": sums[k], "ends_sha256": _digest(ends)}
                parent, parent_seq = node.lowest, None
            yield row
        todo.extend((child, node.end, parent, parent_seq) for child in reversed(node.below()))


_TREE_SCHEMA = pa.schema([
    ("part", pa.int64()), ("seq", pa.int64()), ("name", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()),
    ("parent_conv_id", pa.int64()), ("parent_seq", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("words", pa.int64()), ("n_ends", pa.int64()),
    ("ends", pa.list_(pa.int64())), ("ends_sha256", pa.string())])
_TREE_TYPE = ("part long, seq long, name binary, depth long, conv_id long, parent_conv_id long, parent_seq long, n_convs long, "
              "n_children long, n_leaves long, saved_tokens long, words long, n_ends long, ends array<long>, ends_sha256 string")


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree, first, last, part = RadixTree(), b"", b"", None
    for batch in batches:
        for conv, path, words, own in zip(*(batch.column(n) for n in ("conv_id", "path", "words", "part"))):
            last = path.as_py()
            if part is None:
                first, part = last, own.as_py()
            tree.insert(last, conv.as_py(), words.values.to_pylist())
    if part is None:
        return
    rows = []
    for row in tree_rows(part, tree, first, last):
        rows.append(row)
        if len(rows) == OUT_ROWS:
            yield pa.RecordBatch.from_pylist(rows, _TREE_SCHEMA)
            rows = []
    yield pa.RecordBatch.from_pylist(rows, _TREE_SCHEMA)


def merge_shared(rows: Iterator[dict]) -> Iterator[dict]:
    """Adds up the shared nodes of all tasks, which come in the order of the tasks, parents first.

    The tasks' conversations are in the order of their paths, so a node's rows come while it is
    on the current path, and it is whole once the path has left it.
    """
    path: list[dict] = []

    def close() -> Iterator[dict]:
        node = path.pop()
        node["n_leaves"] = node["n_leaves"] or 1
        node["saved_tokens"] += (node["n_convs"] - 1) * node["words"]
        for child in node.pop("kids"):
            yield child | {"parent_conv_id": node["conv_id"]}
        if path:
            path[-1]["kids"].append(node)
            for name, value in (("n_children", 1), ("n_leaves", node["n_leaves"]), ("saved_tokens", node["saved_tokens"])):
                path[-1][name] += value
        else:
            yield node | {"parent_conv_id": None}

    for row in rows:
        depth = row["depth"]
        if depth < len(path) and path[depth]["name"] == row["name"]:
            node = path[depth]
            node["conv_id"] = min(node["conv_id"], row["conv_id"])
            for name in ("n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends"):
                node[name] += row[name]
        else:
            while len(path) > depth:
                yield from close()
            path.append({**row, "kids": []})
    while path:
        yield from close()


_MERGED = ("name", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.binary() if n == "name" else pa.int64()) for n in _MERGED])
    rows = []
    for node in merge_shared(row for batch in batches for row in batch.to_pylist()):
        rows.append({n: node[n] for n in _MERGED})
        if len(rows) == OUT_ROWS:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
    yield pa.RecordBatch.from_pylist(rows, schema)


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per name; its lists come in ascending order and are hashed as they stream by."""
    name, state = None, None
    out: list[tuple[bytes, str]] = []
    for batch in batches:
        for own, ends in zip(batch.column("name"), batch.column("ends")):
            text = ",".join(map(str, ends.as_py())).encode()
            if own.as_py() == name:
                state.update(b"," + text)
                continue
            if name is not None:
                out.append((name, state.hexdigest()))
            name, state = own.as_py(), sha256(text)
    if name is not None:
        out.append((name, state.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.binary()), pa.array([d for _, d in out], pa.string())],
                                     names=["name", "ends_sha256"])


def prefix_trie(conversations: DataFrame, turns_per_task: int = TURNS_PER_TASK) -> DataFrame:
    """One row per distinct sequence of first turns, the empty one included.

    ``conversations`` has ``conv_id``, once each, and ``turns`` as ``conversation_turns`` makes
    them. Rows are ``NODE_COLUMNS``: the smallest conversation that begins so, ``depth``, the
    parent's, how many begin so, child nodes, childless nodes at or below, words saved at or
    below by keeping shared turns once, and the conversations that end there, counted and as
    SHA-256 of their ascending ids, comma-joined.

    Paths of turn ids are range-sorted with their conversation, so a path that very many
    conversations share spreads over tasks. Each task keeps one adaptive radix tree of its
    paths; turn-aligned depths are nodes. All nodes but those on the way to a task's first and
    last path are whole there. These few, twice the depth per task, are added up in path order
    by one task, whose work so depends on the number of tasks and not on that of conversations.
    SHA-256 can only be worked out in order: ids that end in a node shared by tasks stream
    through one task, never held together.

    Conversations without turns end in the root; null ids are left out by
    ``conversation_turns``; an empty table gives no node. A conversation is one row, so its
    turns' ids must fit a task together.
    """
    paths = stage(paths_of(conversations), "paths")
    spark = paths.sparkSession
    turns = paths.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // turns_per_task))
    ordered = (paths.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
               .withColumn("part", F.spark_partition_id().cast("long")))
    rows = stage(ordered.mapInArrow(_build, _TREE_TYPE), "trie-rows")
    shared = rows.where("seq IS NOT NULL")
    merged = stage(shared.drop("ends", "ends_sha256").repartition(1).sortWithinPartitions("part", "seq").mapInArrow(
        _merge, ", ".join(f"{n} {'binary' if n == 'name' else 'long'}" for n in _MERGED)), "trie-shared")
    ends = (shared.where("n_ends > 0").select("name", "part", "ends").repartition("name")
            .sortWithinPartitions("name", "part").mapInArrow(_hash_ends, "name binary, ends_sha256 string"))
    empty = F.lit(sha256(b"").hexdigest())
    of_shared = merged.join(ends, "name", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", empty))

    # Which conversation each task's shared parents are named by, once all tasks are added up.
    named = (shared.select("part", F.col("seq").alias("parent_seq"), "name")
             .join(merged.select("name", F.col("conv_id").alias("__parent")), "name").drop("name"))
    own = rows.where("seq IS NULL")
    under_shared = (own.where("parent_seq IS NOT NULL").join(named, ["part", "parent_seq"])
                    .withColumn("parent_conv_id", F.col("__parent")))
    return (own.where("parent_seq IS NULL").select(*NODE_COLUMNS)
            .unionByName(under_shared.select(*NODE_COLUMNS)).unionByName(of_shared.select(*NODE_COLUMNS)))


def borrowed_heads(conversations: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations that begin with the first turns of another one.

    Of conversation c the first h = crc32(c) % ``most`` turns are replaced by the first h turns,
    or as many as there are, of conversation c - c % ``every``; if that is absent they are
    just left out. At most ``2 * every`` conversations meet the one they borrow from.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = conversations.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("__lender"), F.slice("turns", 1, most).alias("__head"))
    nothing = F.array().cast(conversations.schema["turns"].dataType)
    return (conversations.withColumn("__lender", F.col("conv_id") - F.col("conv_id") % every).join(heads, "__lender", "left")
            .select("conv_id", F.concat(F.slice(F.coalesce("__head", nothing), F.lit(1), h),
                                        F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).alias("turns")))
