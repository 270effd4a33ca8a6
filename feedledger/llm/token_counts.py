"""Token counts under a unigram model, by forward scores shared along a trie (operator 1)."""

from __future__ import annotations

import base64
import itertools
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from feedledger.llm.units import UnitCache
from feedledger.llm.worker import kept, ship

ship(__name__)

# Costs are integers in units of 2**-20 nats, so sums are exact and ties are true ties.
COST_ONE = 1 << 20
COUNT_BITS = 40
COUNT_MASK = (1 << COUNT_BITS) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte pieces and their ranks from a public rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


def piece_cost(rank: int) -> int:
    """Cost of a piece: its negative log-probability under Zipf's law over ranks, without the constant.

    The rank file lists pieces by falling frequency and carries no scores of its own.
    """
    return round(COST_ONE * math.log(rank + 2))


class PrefixScores:
    """Counts the tokens of the cheapest segmentation of pre-tokens.

    The distinct pre-tokens of a block of texts, in order, are a trie walked depth first: the
    nodes from its root to the current pre-token are that pre-token's prefixes, and the next one
    goes back to the last node they share. Each node holds the forward score of its prefix,
    worked out once however many pre-tokens share it, as the best of the pieces that end there,
    each after the node where it begins. Of equal costs the fewer tokens win. Terminal counts are
    handed out per pre-token. Memory is the current path, not the trie.
    """

    def __init__(self, ranks: dict[bytes, int]):
        # Every ending of a piece, 0 if it is none itself: no longer piece ends in anything else.
        # A score is cost and count of tokens in one number, so the smaller one is the better.
        self.endings = {piece[at:]: 0 for piece in ranks for at in range(len(piece))}
        self.endings.update((piece, (piece_cost(rank) << COUNT_BITS) + 1) for piece, rank in ranks.items())

    def terminal_counts(self, pretokens: Iterable[bytes]) -> dict[bytes, int]:
        """Tokens of each pre-token."""
        ending, out, path, last = self.endings.get, {}, [0], b""
        for word in sorted(set(pretokens)):
            shared = min(len(last), len(word))
            if last[:shared] != word[:shared]:
                different = int.from_bytes(last[:shared], "big") ^ int.from_bytes(word[:shared], "big")
                shared -= (different.bit_length() + 7) // 8
            del path[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                best, start = None, end - 1
                while start >= 0 and (own := ending(word[start:end])) is not None:
                    if own and (before := path[start]) is not None and (best is None or before + own < best):
                        best = before + own
                    start -= 1
                path.append(best)
            if path[-1] is None:
                raise ValueError(f"the vocabulary cannot spell {word!r}")
            out[word], last = path[-1] & COUNT_MASK, word
        return out


def unit_counts(scores: PrefixScores, split: regex.Pattern, units: list[str]) -> list[int]:
    """Pre-tokens and tokens of each unit, in one number: sums of it are sums of both."""
    parts = [[part.encode() for part in split.findall(u)] for u in units]
    counts = scores.terminal_counts(itertools.chain.from_iterable(parts))
    return [(len(own) << COUNT_BITS) + sum(map(counts.__getitem__, own)) for own in parts]


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_pretokens``, ``n_tokens``.

    A text is cut by ``pattern`` into pre-tokens, each segmented apart into byte pieces of
    the rank file. Null and empty texts give zeros; repeated rows are counted each; other
    columns of ``docs`` are ignored, so their names cannot clash. The work is one pass without a
    shuffle. Units of text met before are remembered with their counts; those of the others'
    pre-tokens are worked out together, a few texts or a part of a long one at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make() -> UnitCache:
            scores, split = PrefixScores(read_ranks(ranks_path)), regex.compile(pattern)
            return UnitCache(lambda units: unit_counts(scores, split, units), sum)

        cache = kept(("unit counts", ranks_path, pattern), make)
        for batch in batches:
            texts = [v.as_py() or "" for v in batch.column(1)]
            both = cache.many(texts)
            sizes, pre, tokens = [len(t.encode()) for t in texts], [n >> COUNT_BITS for n in both], [n & COUNT_MASK for n in both]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(pre, pa.int64()), pa.array(tokens, pa.int64())],
                names=[id_col, "n_bytes", "n_pretokens", "n_tokens"])

    narrow = docs.select(id_col, text_col)
    kind = narrow.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_pretokens long, n_tokens long")
