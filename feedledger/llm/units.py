"""Cuts texts into units that tokenizers encode alike alone and in context.

A unit is a word with the one space before it, or white space that belongs to no word. The
public patterns never let a pre-token cross such a cut: they tell letters, digits and signs
apart inside a word, and treat white space before a word exactly as ``UNITS`` does. The ids of
a text are therefore the ids of its units, one after another, and each distinct unit needs to
be encoded only once. Units are kept as bytes of little-endian unsigned 32-bit ids.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

from feedledger.llm.worker import kept, ship

ship(__name__)

# Characters with the property White_Space, as fixed by the character standard.
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNITS = re.compile(f" ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]")
# A single white space between two other characters always begins a unit.
CUT = re.compile(f"(?<=[^{WHITE_SPACE}])(?=[{WHITE_SPACE}][^{WHITE_SPACE}])")
BLOCK_CHARS = 1 << 20
KEPT_UNITS = 400_000
KEPT_UNIT_CHARS = 48


def blocks(text: str, size: int = BLOCK_CHARS) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut only where a unit begins."""
    start = 0
    while len(text) - start > size:
        cut = CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:] if start else text


class UnitCache:
    """Works texts out unit by unit; remembers a bounded number of short units.

    ``work_out`` turns distinct units into values; those of a text's units are put together by
    ``total``. Units are kept in two generations: when the younger is full it becomes the older,
    and what is met again moves back, so frequent units stay. The bound limits memory only: what
    is not remembered is worked out again, with the same result. A ``mark`` is a unit of its own
    wherever it stands.
    """

    def __init__(self, work_out: Callable[[list[str]], list], total: Callable[[Iterable], object] = b"".join,
                 limit: int = KEPT_UNITS, marks: Iterable[str] = ()):
        self.work_out, self.total, self.limit, self.known, self.older = work_out, total, limit, {}, {}
        marks = sorted(marks, key=len, reverse=True)
        self.own_marks = frozenset(marks)
        self.marks = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None

    def cut(self, block: str) -> list[str]:
        """The units of a block; what stands beside a mark is cut like a text of its own."""
        if self.marks is None or not self.marks.search(block):
            return UNITS.findall(block)
        units = []
        for i, part in enumerate(self.marks.split(block)):
            units += [part] if i % 2 else UNITS.findall(part)
        return units

    def many(self, texts: Iterable[str | None]) -> list:
        """The totals of whole texts; null counts as empty.

        The units of a few texts, or of a part of a long one, are looked up together, so that
        those not remembered are worked out in one call.
        """
        parts, group, held = [], [], 0
        for row, text in enumerate(texts):
            parts.append([])
            for block in blocks(text) if text else ():
                group.append((row, self.cut(block)))
                held += len(block)
                if held >= BLOCK_CHARS:
                    self._add(group, parts)
                    group, held = [], 0
        self._add(group, parts)
        return [own[0] if len(own) == 1 else self.total(own) for own in parts]

    def encode(self, text: str | None):
        """The total of one whole text."""
        return self.many([text])[0]

    def _work_out(self, units: list[str]) -> list:
        return self.work_out(units)

    def _add(self, group: list[tuple[int, list[str]]], parts: list[list]) -> None:
        missing: set[str] = set()
        for _, units in group:
            missing.update(itertools.filterfalse(self.known.__contains__, units))
        found = {u: v for u in missing if (v := self.older.get(u)) is not None}
        new = [u for u in missing if u not in found]
        if new:
            found.update(zip(new, self._work_out(new), strict=True))
        if len(self.known) + len(found) > self.limit:
            self.older, self.known = self.known, {}
            for _, units in group:
                self.known.update((u, self.older[u]) for u in set(units).difference(found, self.known))
        self.known.update(found)
        for row, units in group:
            parts[row].append(self.total(map(self.known.__getitem__, units)))
        for u in found:
            if len(u) > KEPT_UNIT_CHARS:
                del self.known[u]


# A file whose normalizer and splitter do nothing to a composed text but lower-case it and drop its white space.
LOWERING = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
# Characters below the combining marks are composed already, and are lowered one by one, but for the
# dotted I. Python splits at four control characters that are not white space to the library.
COMPOSED = re.compile("[^\x1c-\x1f\u0130\u0250-\U0010ffff]*").fullmatch
# Signs that no word goes on after; an apostrophe may begin a contraction.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class LoweredWords(UnitCache):
    """Units of a lower-casing tokenizer: words without their case, white space and last signs.

    ``plain`` gives the ids of words that are lowered already, ``whole`` those of any text.
    """

    def __init__(self, plain: Callable[[list[str]], list[bytes]], whole: Callable[[list[str]], list[bytes]], marks: Iterable[str]):
        super().__init__(whole, marks=marks)
        self.plain = plain

    def cut(self, block: str) -> list[str]:
        lowered = block.lower()
        if COMPOSED(block) and not (self.marks and self.marks.search(lowered)):
            return lowered.split()
        # Units of other texts keep a space before them, so they are never taken for plain words.
        return [u if u[0] == " " or u in self.own_marks else " " + u for u in super().cut(block)]

    def _work_out(self, units: list[str]) -> list[bytes]:
        heads, tails = [], []
        for u in units:
            head = u if u[0] == " " or u in self.own_marks else u.rstrip(SIGNS)
            # Letters and digits never belong to one piece with the signs after them.
            if head and len(head) < len(u) and (head[-1].isalpha() or head[-1] in "0123456789"):
                heads.append(head)
                tails.append(u[len(head):])
            else:
                heads.append(u)
                tails.append("")
        known = {t: None for t in (*heads, *tails)}
        new = []
        for t in known:
            known[t] = self.known.get(t, self.older.get(t)) if t else b""
            if known[t] is None:
                new.append(t)
        words = [t for t in new if t[0] != " " and t not in self.own_marks]
        known.update(zip(words, self.plain(words), strict=True))
        rest = [t for t in new if t[0] == " " or t in self.own_marks]
        known.update(zip(rest, self.work_out(rest), strict=True))
        return [known[h] + known[t] if t else known[h] for h, t in zip(heads, tails)]


def tokenizer_cache(path: str) -> UnitCache:
    """A cache over a tokenizers file at ``path``, kept by the worker between tasks.

    Ids are those that the library gives a text as it stands: a special token spelled out in a
    text gets its own id.
    """
    def make() -> UnitCache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        marks = [t["content"] for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        tokenizer = Tokenizer.from_file(path)

        def ids(by: Tokenizer, units: list[str]) -> list[bytes]:
            return [array("I", e.ids).tobytes() for e in by.encode_batch_fast(units, add_special_tokens=False)]

        if spec["normalizer"] != LOWERING:
            return UnitCache(lambda units: ids(tokenizer, units), marks=marks)
        # Words lowered here need not pass the normalizer, which is the costlier half.
        bare = Tokenizer.from_file(path)
        bare.normalizer = normalizers.Sequence([])
        bare.encode_special_tokens = True  # lower-casing may spell one that the text does not
        return LoweredWords(lambda units: ids(bare, units), lambda units: ids(tokenizer, units), marks)

    return kept(("tokenizers", path), make)
