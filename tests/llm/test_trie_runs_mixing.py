"""Operators 11 to 13 against brute force, and their edge cases."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedledger.llm import conversation_trie, hot_keys, mixing, period_runs, queries, radix_tree

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `n` string, size int, __row int, runs int, place int"
TURNS = "conv_id long, turn long, role string, text string, words string, part int, path string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(texts, source=lambda i: "s") -> list[tuple]:
    return [(i, t, "en", source(i), 0, "x", 1, 2, 3, 4) for i, t in enumerate(texts)]


# 11 conversation trie

def brute_trie(rows, rebuild=True) -> list[tuple]:
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, mine in turns.items():
        h = crc32(str(c).encode()) % 4 if rebuild else 0
        lender = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(turns.get(lender, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)

    def subtree(path):
        todo = [path]
        while todo:
            at = todo.pop()
            yield at
            todo += children[at]

    out = []
    for path, own_members in members.items():
        below = list(subtree(path))
        saved = sum((len(members[p]) - 1) * len(WORD.findall(p[-1][1])) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in own_members if built[c] == path)))
        out.append((min(own_members), len(path), min(members[path[:-1]]) if path else None, len(own_members), len(children[path]),
                    sum(not children[p] for p in below), saved, sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(spark, rows, rebuild=True, **kw) -> list[tuple]:
    turns = conversation_trie.conversation_turns(spark.createDataFrame(rows, TURNS).repartition(3))
    nodes = conversation_trie.prefix_trie(conversation_trie.borrowed_heads(turns) if rebuild else turns, **kw)
    assert tuple(nodes.columns) == conversation_trie.NODE_COLUMNS
    return sorted(map(tuple, nodes.drop("n_ends").collect()), key=str)


def conversations(seed: int, n: int, kinds: int = 3) -> list[tuple]:
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-30, 40 * n), n):
        for turn in range(rnd.randint(1, 5)):
            rows.append((c, turn, "user", f"turn {rnd.randint(0, kinds) ** 2} says\tso", "w", 1, "p"))
    return rows


@pytest.mark.parametrize("per_task", [1_000_000, 7])
def test_trie_matches_brute_force(spark, per_task):
    rows = conversations(1, 120)
    rows += [(0, None, None, None, "w", 1, "p"), (20, 1, "", "", "w", 1, "p"), (20, 2, "ab", "c", "w", 1, "p"),
             (40, 1, "a", "bc", "w", 1, "p"), (41, 0, "user", "x " * 5000, "w", 1, "p"), (41, 0, "user", "y", "w", 1, "p"),
             (None, 0, "user", "left out", "w", 1, "p")]
    assert trie_rows(spark, rows, turns_per_task=per_task) == brute_trie(rows)


def test_trie_of_one_conversation_repeated_over_all_tasks(spark):
    rows = [(c, t, "user", f"same {t}", "w", 1, "p") for c in range(300) for t in range(4)]
    rows += [(c, t, "user", f"same {min(t, 2)} {c % 3 if t > 2 else ''}", "w", 1, "p") for c in range(300, 360) for t in range(5)]
    rows += [(c, 0, "user", "same 0", "w", 1, "p") for c in range(400, 420)]
    assert trie_rows(spark, rows, rebuild=False, turns_per_task=40) == brute_trie(rows, rebuild=False)


def test_trie_edge_cases(spark):
    assert trie_rows(spark, []) == []
    # A conversation left without turns ends in the root.
    lone = next(c for c in range(1, 99) if crc32(str(c).encode()) % 4 == 3 and c % 20)
    rows = [(lone, 0, "user", "gone", "w", 1, "p")]
    none = sha256(str(lone).encode()).hexdigest()
    assert trie_rows(spark, rows) == [(lone, 0, None, 1, 0, 1, 0, none)] == brute_trie(rows)


def test_radix_layouts_grow_and_keep_order():
    tree = radix_tree.RadixTree()
    keys = sorted({bytes([a, 7, b]) for a in range(256) for b in (0, a)} | {b"", b"\x05"})
    random.Random(3).shuffle(keys)
    for value, key in enumerate(keys):
        tree.insert(key, value, None)
    assert type(tree.root.children) is radix_tree.DirectLayout
    found, kinds = [], set()

    def walk(node, path):
        kinds.add(type(node.children))
        assert node.end == len(path)
        if node.ends:
            found.append(path)
        for byte, child in node.children.items() if node.children else ():
            walk(child, path + bytes([byte]) + child.prefix)

    walk(tree.root, b"")
    assert found == sorted(keys)
    for n, kind in ((4, radix_tree.SortedLayout), (16, radix_tree.SortedLayout), (17, radix_tree.IndexedLayout), (48, radix_tree.IndexedLayout), (49, radix_tree.DirectLayout)):
        layout = radix_tree.SortedLayout()
        for byte in random.Random(n).sample(range(256), n):
            layout = layout.put(byte, byte)
        assert type(layout) is kind and [k for k, _ in layout.items()] == sorted(v for _, v in layout.items())
        assert all(layout.find(b) in (b, None) for b in range(256)) and sum(layout.find(b) == b for b in range(256)) == n


# 12 period runs

def smallest_period(s) -> int:
    return next(q for q in range(1, len(s) + 1) if all(s[i] == s[i + q] for i in range(len(s) - q)))


def brute_runs(words) -> list[tuple[int, int, int]]:
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(6, 4 * q) and smallest_period(words[start:start + length]) == q:
                out.append((start, length, q))
    return sorted(out)


def brute_collapsed(words, runs) -> str:
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def run_texts() -> list[str | None]:
    rnd = random.Random(5)
    texts: list[str | None] = [None, "", " \t", "a", "a a a a a", "a a a a a a", "a b a b a b a", "a b a b a b a b", "x " * 500]
    for _ in range(60):
        words = []
        while len(words) < rnd.randint(1, 220):
            if rnd.random() < 0.4:
                base = [rnd.choice("abc") for _ in range(rnd.randint(1, 14))]
                words += (base * rnd.randint(2, 9))[:rnd.randint(1, 99)]
            else:
                words.append(rnd.choice("abcdefgh"))
        texts.append(" ".join(words))
    base = [str(rnd.randint(0, 10**6)) for _ in range(100)]
    texts.append(" ".join(["head"] * 3 + base * 5 + ["tail"]))
    texts.append("\n".join((base[:37] * 9)[:300] + ["é"] * 6 + base[37:60] * 4))
    return texts


@pytest.mark.parametrize("tile", [16, period_runs.TILE_WORDS])
def test_runs_match_brute_force(spark, tile):
    rows = rows_of(run_texts())
    rows += [rows[20], rows[20], (None, rows[21][1], *rows[21][2:])]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    got = sorted(((r[0], [tuple(x) for x in r[1]], r[2]) for r in period_runs.find_runs(df, tile_words=tile).collect()), key=str)
    want = []
    for doc_id, text, *_ in rows:
        words = WORD.findall(text or "")
        runs = brute_runs(words)
        want.append((doc_id, runs, brute_collapsed(words, runs)))
    assert got == sorted(want, key=str)
    assert sum(len(r) > 1 for _, r, _ in want) > 10


def test_a_long_run_is_stitched_from_tiles():
    """Every period of every octave, in tiles much shorter than the run, without Spark."""
    rnd = random.Random(9)
    for period in (1, 2, 3, 5, 8, 13, 31, 64, 100):
        base = list(range(period))
        words = [900 + i for i in range(rnd.randint(0, 40))]
        start = len(words)
        words += (base * 900)[:rnd.randint(max(6, 4 * period), 900)]
        length = len(words) - start
        words += [5000 + i for i in range(rnd.randint(0, 40))]
        spans = sorted((p, lo + at, hi + at) for octave, at, ids in period_runs.tiles_of(np.array(words), 16)
                       for p, lo, hi in period_runs.octave_spans(ids, octave) if p == period)
        merged = [list(spans[0])]
        for p, lo, hi in spans[1:]:
            if lo <= merged[-1][2]:
                merged[-1][2] = max(hi, merged[-1][2])
            else:
                merged.append([p, lo, hi])
        assert merged == [[period, start, start + length - period]]


def test_z_function():
    for s in ("", "a", "aaaa", "abacabab", "abababc"):
        assert period_runs.z_function(list(s)) == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]


def test_runs_query_on_rewritten_words(spark, tmp_path):
    ids = [i for i in range(4000) if crc32(str(i).encode()) % 10 == 0][:40] + [i for i in range(50) if crc32(str(i).encode()) % 10][:10]
    rnd = random.Random(2)
    texts = {i: " ".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(0, 120))) for i in ids}
    spark.createDataFrame([(i, t, "en", "s", 0, "x", 1, 2, 3, 4) for i, t in texts.items()], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_period_runs"](spark, str(tmp_path)).collect()}
    assert set(got) == set(ids)
    for i, text in texts.items():
        words, h = WORD.findall(text), crc32(str(i).encode())
        if h % 10 == 0 and words:
            a = (h // 10) % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(len(words))]
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        row = got[i]
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(runs), *best)
        assert row["exponent_milli"] == (None if not runs else 1000 * best[1] // best[2])
        assert row["runs_sha256"] == sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == sha256(brute_collapsed(words, runs).encode()).hexdigest()
    assert sum(r["n_runs"] for r in got.values()) > 20


def test_runs_of_an_empty_table(spark):
    assert period_runs.find_runs(spark.createDataFrame([], DOCS)).collect() == []


# 13 mixing

def brute_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, open_ = {s: 0.0 for s in sizes}, set(sizes)
    left = float(sum(sizes.values()))
    while open_ and left > 1e-9:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if target[s] + share[s] > 3 * sizes[s]}
        if not above:
            for s in open_:
                target[s] += share[s]
            break
        for s in above:
            target[s] = 3.0 * sizes[s]
        left = sum(sizes.values()) - sum(target[s] for s in set(sizes) - open_ | above)
        open_ -= above
    return target


def mixed_rows(seed: int, n: int) -> list[tuple]:
    rnd = random.Random(seed)
    names = ["a", "b", "B", "é", "tiny", "", None, "hollow"]
    share = [40, 20, 8, 8, 1, 2, 3, 1]
    texts = [" ".join("w" * min(1500, int(rnd.paretovariate(0.9) * 8))) for _ in range(n)]
    picked = rnd.choices(names, share, k=n)
    return rows_of([None if s == "hollow" else t for s, t in zip(picked, texts)], lambda i: picked[i])


def test_mix_meets_targets_and_reruns_agree(spark):
    rows = mixed_rows(4, 3000)
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df.repartition(4)).collect()
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    source = {r[0]: r[3] for r in rows}
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, s in source.items():
        sizes[s] += size[i]
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        base = r["target"] / r["source_size"] if r["source_size"] else 0
        assert r["copies"] in (int(base), int(base) + 1)
        taken[source[r["doc_id"]]] += r["taken"]
    for s, words in taken.items():
        assert abs(words - want[s]) <= max(8, 0.002 * want[s]), s
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


def test_pareto_order_follows_unequal_odds(spark):
    """Inclusion by grade is what the grades ask for, within five standard deviations."""
    rows = [(i, f"t{i} " * 10, "en", "ab"[i % 2], 0, "x", i % 4, 2, 3, 4) for i in range(8000)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), grade_col="size").collect()
    by_grade = defaultdict(list)
    for r in got:
        by_grade["ab"[r["doc_id"] % 2], r["doc_id"] % 4].append(r["copies"])
    for s, grades in (("a", (1, 2)), ("b", (1, 3))):
        # Grade 0 is held at 1; odd ids have grades 1 and 3, even ones 0 and 2.
        sizes = [20_000, 20_000]
        expected = mixing.expected_copies(sizes, list(grades), {"a": 80_000 / 3, "b": 160_000 / 3}[s])
        for grade, copies in zip(grades, expected):
            own = by_grade[s, {1: 0, 2: 2}[grade] if s == "a" else grade]
            p = copies % 1
            assert set(own) <= {int(copies), int(copies) + 1}
            assert abs(np.mean(own) - copies) <= 5 * (p * (1 - p) / len(own)) ** 0.5 + 0.002
        assert sum(sum(by_grade[k]) for k in by_grade if k[0] == s) * 10 == pytest.approx({"a": 80_000 / 3, "b": 160_000 / 3}[s], abs=50)


def test_expected_copies_stop_and_spread():
    assert mixing.expected_copies([10, 10], [1, 16], 33.0) == [pytest.approx(0.3), 3.0]
    assert mixing.expected_copies([10, 0], [1, 2], 30.0) == [3.0, 0.0]
    assert mixing.expected_copies([], [], 0.0) == []


def test_classes_carry_what_is_left():
    rows = [(5, 0, 12.5, 25), (5, 1, 12.5, 25), (2, 0, 1.5, 3), (2, 1, 1.5, 3), (1, 0, 0.5, 1), (1, 1, 0.5, 1)]
    cuts = mixing.cut_classes(rows)
    assert sum(w for c, place, _, w in rows if place < cuts[c]) == pytest.approx(29, abs=0.5)


def test_mix_edge_cases(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).collect() == []
    hollow = rows_of([None, "", " "], lambda i: None)
    assert [(r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.mix(spark.createDataFrame(hollow, DOCS)).collect()] == [(0, 0, 0.0, 0)] * 3
    rows = rows_of(["a b c"] * 4 + ["long " * 30_000], lambda i: "s" if i < 4 else "t")
    rows += [rows[0], rows[0], (None, "n n", "en", "s", 0, "x", 1, 2, 3, 4)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows) and len({r["taken"] for r in got if r["doc_id"] == 0}) == 1
    # The small source is stopped at three times its words.
    assert {r["taken"] // r["size"] for r in got if r["doc_id"] != 4} == {3}


def test_rows_of_cold_and_hot_keys_meet_their_row(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") < 2500, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    per_key = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = hot_keys.join_by_source(rows, per_key, ["k"]).collect()
    assert len(got) == 5000 and all(r["top"] == (2499 if r["k"] == "hot" else r["id"]) for r in got)
