"""Byte-level BPE by longest matches and backtracking (operator 6)."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from hashlib import sha256

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from feedledger.llm.units import UnitCache
from feedledger.llm.worker import kept, ship

ship(__name__)

KEPT_PAIRS = 500_000


class ByteBpe:
    """Encodes and decodes with the ranks of a public rank file.

    Bytes are mapped to the Latin-1 characters of the same number, so that a string trie tells
    how far vocabulary entries can reach from a place. At each place the longest entry
    that is compatible with the token before it is taken; when none is left the place is dead
    and the token before it gives way to its next shorter entry. Two tokens are compatible
    when merging their joined bytes gives just these two, which is worked out once per pair.
    A chain whose neighbours are all compatible is the result of the merges, and there is one
    such chain at most up to each place, so a dead place never needs a second visit and the
    work is linear in the pre-token.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {rank: piece for piece, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.automaton = ahocorasick.Automaton()
        self.ids: dict[str, int] = {}
        for piece, rank in ranks.items():
            name = piece.decode("latin-1")
            self.ids[name] = rank
            self.automaton.add_word(name, rank)
        self.split = regex.compile(pattern)
        self.pairs: dict[tuple[int, int], bool] = {}

    def merge(self, raw: bytes) -> list[int]:
        """Plain merging, lowest rank first and leftmost of equals; only for joined pairs."""
        parts = [raw[i:i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            ranked = [(self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.ranks]
            if not ranked:
                break
            _, at = min(ranked)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            found = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            self.pairs[left, right] = found
        return found

    def encode_pretoken(self, raw: bytes) -> list[int]:
        text = raw.decode("latin-1")
        whole = self.ids.get(text)
        if whole is not None:
            return [whole]
        size, longest, ids = len(text), self.longest, self.ids
        chosen: list[int] = []
        places, tried = [0], [None]  # where each token begins, and the length last tried there
        dead: set[int] = set()
        while (place := places[-1]) < size:
            ahead = text[place:place + longest]
            limit = self.automaton.longest_prefix(ahead) if tried[-1] is None else tried[-1] - 1
            for length in range(limit, 0, -1):
                token = ids.get(ahead[:length])
                if token is None or place + length in dead:
                    continue
                if not chosen or self.compatible(chosen[-1], token):
                    tried[-1] = length
                    chosen.append(token)
                    places.append(place + length)
                    tried.append(None)
                    break
            else:
                if not chosen:
                    raise ValueError(f"the vocabulary cannot spell {raw!r}")
                dead.add(place)
                places.pop()
                tried.pop()
                chosen.pop()
        return chosen

    def encode(self, text: str) -> list[int]:
        return [i for part in self.split.findall(text) for i in self.encode_pretoken(part.encode())]

    def encode_many(self, units: list[str]) -> list[bytes]:
        return [array("I", self.encode(u)).tobytes() for u in units]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_bpe(ranks_path: str, pattern: str) -> ByteBpe:
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}
    return ByteBpe(ranks, pattern)


def _coder(ranks_path: str, pattern: str) -> tuple[ByteBpe, UnitCache]:
    def make():
        bpe = read_bpe(ranks_path, pattern)
        return bpe, UnitCache(bpe.encode_many)

    return kept(("byte bpe", ranks_path, pattern), make)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and ``ids``, the token ids of the whole text.

    Null and empty texts give an empty list; texts of any length are encoded whole; repeated
    rows are encoded each; other columns are ignored. No shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, cache = _coder(ranks_path, pattern)
        for batch in batches:
            lists = [memoryview(ids).cast("I").tolist() for ids in cache.many(v.as_py() for v in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], names=[id_col, "ids"])

    narrow = docs.select(id_col, text_col)
    return narrow.mapInArrow(run, f"`{id_col}` {narrow.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(coded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``coded``: id and ``raw``, the bytes its ids stand for.

    A null list gives empty bytes; an id outside the vocabulary is an error. No shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = _coder(ranks_path, pattern)
        for batch in batches:
            raws = [bpe.decode(v.as_py() or ()) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raws, pa.binary())], names=[id_col, "raw"])

    narrow = coded.select(id_col, ids_col)
    return narrow.mapInArrow(run, f"`{id_col}` {narrow.schema[id_col].dataType.simpleString()}, raw binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of encoding and of decoding again: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    The two directions run in one pass, text by text, so no list of ids leaves the task. Edge
    cases are those of ``encode``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = _coder(ranks_path, pattern)
        decimal = kept(("decimal", ranks_path), lambda: {i: str(i) for i in bpe.bytes_of})
        for batch in batches:
            counts, coded, decoded = [], [], []
            for value in batch.column(1):
                ids = memoryview(cache.encode(value.as_py())).cast("I").tolist()
                counts.append(len(ids))
                coded.append(sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                decoded.append(sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    narrow = docs.select(id_col, text_col)
    return narrow.mapInArrow(
        run, f"`{id_col}` {narrow.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
