"""The corpus operators against brute force, round trips and held-out rows, and their edge cases."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

import corpus_pipeline
from feedledger.llm import (byte_bpe, components, exact_dedup, language_id, near_dedup, packing, queries,
                            sequence_files, sharding, token_counts, top_k, units, url_filter)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, bucket int, __x int"


def texts_of(seed: int, n: int) -> list[str]:
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abdefgilmnorstuéß") for _ in range(rnd.randint(1, 9))) for _ in range(300)]
    return [" ".join(rnd.choice(words) for _ in range(rnd.randint(6, 80))) for _ in range(n)]


def rows_of(texts) -> list[tuple]:
    return [(i, t, "en", "s", 0, "k", 1, 2) for i, t in enumerate(texts)]


# The library gives special tokens that a text spells out their own ids.
SPECIAL_TEXTS = ["a<|endoftext|>b", "<|endoftext|>", "<|startoftext|> Ab <|endoftext|><|endoftext|>", " <|endoftext|> \n", "<|endoftext", "<|ENDOFTEXT|>"]
ODD_TEXTS = [None, "", " ", "\n\t", "a", "Ab  c\x85d", "x" * 3000, "日本語 テキスト" * 40, "don't  stop\n\n now ", "😀 é́ \x1c!"]


@pytest.fixture(scope="module")
def docs(spark):
    base = texts_of(1, 60)
    long = " ".join(texts_of(2, 900))
    rows = rows_of([*base, *ODD_TEXTS, *SPECIAL_TEXTS, base[0], base[0] + " ", base[1].replace(" ", "\t"), long])
    rows += [rows[3], rows[3], (None, base[4], None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1 token counts

def test_token_counts_match_an_independent_unigram_model(docs):
    ranks = token_counts.read_ranks(queries.BYTE_RANKS)
    # The library maximises summed scores; exact integer costs are exact doubles too.
    vocab = [(piece.decode("latin-1"), -float(token_counts.piece_cost(rank))) for piece, rank in sorted(ranks.items(), key=lambda x: x[1])]
    model = models.Unigram(vocab, None, False)
    split = regex.compile(public_tokenizers.PATTERN)
    got = {(r.doc_id, r.n_bytes): r for r in token_counts.count_tokens(docs, queries.BYTE_RANKS, public_tokenizers.PATTERN).collect()}
    for row in docs.select("doc_id", "text").collect():
        text = row.text or ""
        want, parts = 0, split.findall(text)
        for part in parts:
            pieces = [t.value for t in model.tokenize(part.encode().decode("latin-1"))]
            assert "".join(pieces) == part.encode().decode("latin-1")
            want += len(pieces)
        mine = got[row.doc_id, len(text.encode())]
        assert (mine.n_pretokens, mine.n_tokens) == (len(parts), want)


def brute_count(ranks, raw: bytes) -> tuple[int, int]:
    best = [(0, 0)]
    for end in range(1, len(raw) + 1):
        best.append(min((best[s][0] + token_counts.piece_cost(ranks[raw[s:end]]), best[s][1] + 1) for s in range(end) if raw[s:end] in ranks))
    return best[-1]


def test_forward_scores_are_shared_along_sorted_prefixes():
    ranks = token_counts.read_ranks(queries.BYTE_RANKS)
    words = [w.encode() for t in texts_of(3, 8) for w in t.split()] + [b"", b"a" * 150, "é".encode() * 60, b"international", b"internationally"]
    scores = token_counts.PrefixScores(ranks)
    assert scores.terminal_counts(words) == {w: brute_count(ranks, w)[1] for w in words}

    class Counted(dict):
        asked = 0

        def get(self, key, default=None):
            Counted.asked += 1
            return super().get(key, default)

    scores.endings = Counted(scores.endings)
    scores.terminal_counts([b"internationally"])
    alone, Counted.asked = Counted.asked, 0
    scores.terminal_counts([b"international", b"internationally", b"internationally"])
    assert Counted.asked == alone  # each prefix once
    with pytest.raises(ValueError):
        token_counts.PrefixScores({b"a": 0}).terminal_counts([b"ab"])


def test_token_counts_of_a_text_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(units, "BLOCK_CHARS", 50)
    ranks, split = token_counts.read_ranks(queries.BYTE_RANKS), regex.compile(public_tokenizers.PATTERN)
    scores = token_counts.PrefixScores(ranks)
    cache = units.UnitCache(lambda u: token_counts.unit_counts(scores, split, u), sum, limit=30)
    texts = [*texts_of(21, 30), None, "", "x" * 300]
    want = [split.findall(t or "") for t in texts]
    assert [(n >> token_counts.COUNT_BITS, n & token_counts.COUNT_MASK) for n in cache.many(texts)] == [
        (len(w), sum(brute_count(ranks, p.encode())[1] for p in w)) for w in want]


def test_token_counts_of_an_empty_table(empty):
    assert token_counts.count_tokens(empty, queries.BYTE_RANKS, public_tokenizers.PATTERN).collect() == []


# 2 url filter

RULES = queries.URL_RULES
PAGES = "page_id long, url string, html string, node string, host string"


def test_url_filter_carries_blocks_to_aliases(spark):
    canonical = '<html><link rel="canonical" href="{}"></html>'.format
    rows = [
        (1, "http://example.org/es/1", None), (2, "http://mirror.net/a", canonical("http://example.org/es/1")),
        (3, "http://mirror.net/b#top", '<meta http-equiv="refresh" content="0; url=/a">'),
        (4, "http://x.com/fr/1", canonical("http://mirror.net/b")), (5, "http://clean.net/", canonical("http://clean.net/home")),
        (6, "http://clean.net/home?x=1", None), (7, None, None), (8, "no scheme", canonical("http://example.org/es/1")),
        (9, "HTTP://WWW.Example.ORG/en/12?q#z", "<LINK HREF='//mirror.net/c' REL='alternate'>"), (10, "http://other.net/d", "<link href=//gone.com/de/9 rel=canonical>"),
        (11, "http://hub.net/", None), (1, "http://example.org/es/1", None)]
    rows += [(100 + i, f"http://copy{i}.net/p", canonical("http://hub.net/")) for i in range(40)]
    pages = spark.createDataFrame([(a, b, c, "n", "h") for a, b, c in rows], PAGES)
    got = {r.page_id: r for r in url_filter.judge(pages, RULES).collect()}
    assert url_filter.judge(pages, RULES).count() == len(rows)
    assert {k: r.verdict for k, r in got.items() if k < 100} == {
        1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "block", 10: "block", 11: "allow"}
    assert got[4].rule == "com/fr/" and got[2].rule is None and got[2].blocked_by_alias and not got[1].blocked_by_alias
    assert (got[9].host, got[9].path) == ("www.example.org", "/en/12") and (got[7].host, got[8].path) == ("", "")
    spam = spark.createDataFrame([("http://hub.net/", "http://example.org/es/7")], "source string, target string")
    both = url_filter.alias_edges(pages).union(spam)
    assert all(r.verdict == "block" for r in url_filter.judge(pages, RULES, both).where("page_id >= 100 OR page_id = 11").collect())


def test_url_filter_of_an_empty_table(spark):
    assert url_filter.judge(spark.createDataFrame([], PAGES), RULES).collect() == []


def test_components_match_union_find(spark):
    rnd = random.Random(5)
    pairs = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(500, i) for i in range(501, 560)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    got = dict(components.components(spark.createDataFrame([*pairs, (None, 1)], "a long, b long"), "a", "b").collect())
    assert got == {x: root(x) for a, b in pairs for x in (a, b) if any(x in p and p[0] != p[1] for p in pairs)}


# 3 near duplicates

def words_of(text: str) -> list[str]:
    return re.findall(r"(?:[a-z0-9_]|[^\x00-\x7f])+", (text or "").lower())


def bag(text: str) -> Counter:
    words = words_of(text)
    if 0 < len(words) < 5:
        return Counter([tuple(words)])
    return Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def brute_classes(rows) -> dict:
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    having = defaultdict(list)
    for i, own in enumerate(bags):
        shared = Counter()
        for item, n in own.items():
            for j, m in having[item]:
                shared[j] += min(n, m)
            having[item].append((i, n))
        size = sum(own.values())
        for j, both in shared.items():
            if both >= 0.8 * (size + sum(bags[j].values()) - both):
                parent[root(j)] = root(i)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[root(i)].append(doc)
    return {doc: (min(least[root(i)]), len(least[root(i)])) for i, (doc, _) in enumerate(rows)}


def near_texts() -> list:
    rnd = random.Random(9)
    out = []
    for text in texts_of(11, 25):
        words = text.split() + texts_of(len(text), 1)[0].split()
        out.append(" ".join(words))
        for _ in range(rnd.randint(0, 4)):
            changed = list(words)
            for _ in range(rnd.randint(1, 3)):
                changed[rnd.randrange(len(changed))] = "zz%d" % rnd.randrange(99)
            out.append(" ".join(changed))
    base = texts_of(77, 6)
    out += [" ".join(base) + f" tail{i}" for i in range(60)]  # one large group of near copies
    out += [base[0] + " " + t for t in texts_of(78, 15)]  # a passage many share
    out += [None, "", "one two", "One, two!", "three", " ".join(["rep eat ed words here"] * 40), " ".join(["rep eat ed words here"] * 36), " ".join(["rep eat ed words here"] * 20)]
    return [*out, out[0], out[0].upper()]


def test_near_duplicates_match_brute_force(spark):
    rows = list(enumerate(near_texts()))
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, items string, row int")
    got = {r.doc_id: (r.class_id, r.class_size) for r in near_dedup.near_duplicates(frame.repartition(4)).collect()}
    assert got == brute_classes(rows)
    kept = near_dedup.keep_one(frame)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {c for c, _ in got.values()}


def test_near_duplicates_edge_rows(spark, empty, docs):
    assert near_dedup.near_duplicates(empty).collect() == []
    assert near_dedup.near_duplicates(docs).count() == docs.count()


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(3)
    for top in (1, 6, 50):
        keys = near_dedup.mix(np.arange(1, 300, dtype=np.uint64))
        a, b = rng.integers(1, top + 1, 299), rng.integers(0, top + 1, 299)
        b[100:] = a[100:]
        has = b > 0
        wanted = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        signs = near_dedup.bag_minhash(np.r_[np.zeros(299, int), np.ones(has.sum(), int)], np.r_[keys, keys[has]], np.r_[a, b[has]], 2, 6000)
        assert abs((signs[0] == signs[1]).mean() - wanted) < 0.03


# 4 exact duplicates

def brute_exact(rows) -> dict:
    groups = defaultdict(list)
    for doc, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc))
    return {doc: (min(g)[1], len(g), min(g)[1] == doc, sha256(body.encode()).hexdigest()) for body, g in groups.items() for _, doc in g}


@pytest.mark.parametrize("capacity", [None, 1, 3])
def test_exact_dedup_matches_brute_force(spark, capacity):
    texts = [*texts_of(4, 40), *ODD_TEXTS]
    texts += ["hot copy  " + " " * (i % 3) for i in range(60)] + [t + " " for t in texts[:5] if t]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame([(i, t, "h") for i, t in rows], "doc_id long, text string, hash string").repartition(5)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.dedup(frame, capacity).collect()}
    assert got == brute_exact(rows)


def test_chain_separates_texts_under_one_hash(spark):
    rows = [("aa", 0), ("bb", 0), ("aa", 0), ("cc", 1)]
    frame = spark.createDataFrame([(b, h, 0, 0) for b, h in rows], "body string, hash long, bucket int, page int").coalesce(1)
    got = exact_dedup._chain(frame.sortWithinPartitions("bucket", "page", "hash"), F.lit(True)).collect()
    assert sorted((r.hash, r.chain) for r in got) == [(0, 0), (0, 0), (0, 1), (1, 0)]
    assert sorted(r.link for r in got if r.link) == ["aa", "bb", "cc"]


def test_directory_doubles_only_where_buckets_are_full():
    entries = exact_dedup.double_directory({0: 5, 1: 5, 8: 50, 15: 1}, 6, 4)
    by_slot = {slot: (bucket, depth, pages) for slot, bucket, depth, pages in entries}
    assert len(by_slot) == 16 and by_slot[0][0] != by_slot[1][0] and by_slot[8][1:] == (4, 9)
    assert by_slot[12][0] == by_slot[15][0] and by_slot[15][2] == 1


def test_exact_dedup_keeps_columns_and_one_of_repeated_rows(docs, empty):
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    bodies = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in docs.collect()]
    assert sorted(re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept.collect()) == sorted(set(bodies))
    assert exact_dedup.dedup(empty).collect() == [] and exact_dedup.keep_first(empty).collect() == []


# 5 packing

def check_packing(rows, capacity):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_and_is_tight(seed):
    rnd = random.Random(seed)
    counts = Counter(min(64, int(rnd.expovariate(1 / 18)) + 1) for _ in range(3000))
    patterns = packing.plan_patterns(dict(counts), 64)
    used = Counter()
    for parts, times in patterns:
        assert sum(parts) <= 64 and times > 0
        for p in parts:
            used[p] += times
    assert used == counts
    assert sum(t for _, t in patterns) <= -(-sum(k * n for k, n in counts.items()) // 64) + 1


def test_plan_finds_single_pair_and_triple_complements():
    assert packing.plan_patterns({10: 1, 6: 1}, 16) == [((10, 6), 1)]
    assert packing.plan_patterns({10: 1, 4: 1, 2: 1}, 16) == [((10, 4, 2), 1)]
    assert packing.plan_patterns({11: 2, 5: 2, 3: 2, 1: 2}, 20) == [((11, 5, 3, 1), 2)]
    assert packing.plan_patterns({}, 16) == []
    with pytest.raises(ValueError):
        packing.plan_patterns({17: 1}, 16)


def test_packing_whole_documents(docs, empty):
    tokenizer = Tokenizer.from_file(queries.WORD_TOKENIZER)
    rows = packing.pack(packing.tokenize_pieces(docs, queries.WORD_TOKENIZER, 128), 128).collect()
    check_packing(rows, 128)
    pieces = defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
        pieces[r.doc_id].append((r.start, r.piece, r.ids))
    for row in docs.dropDuplicates(["doc_id"]).collect():
        own = sorted(pieces[row.doc_id])
        want = [*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 0]
        copies = len([p for p in own if p[0] == 0])
        assert [i for p in own[::copies] for i in p[2]] == want and [p[0] for p in own[::copies]] == list(range(0, len(want), 128))
    assert packing.pack(packing.tokenize_pieces(empty, queries.WORD_TOKENIZER, 128), 128).collect() == []


# 6 byte-level BPE

def test_bpe_equals_the_public_library():
    bpe = byte_bpe.read_bpe(queries.BYTE_RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rnd = random.Random(1)
    alphabet = "ab  \n\t\r\x85\xa0 　\x1c'sreSé1２½!-—日本aaáİß😀"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rnd.choice("aeinrst") for _ in range(300)) for _ in range(100)] + [" " * k + "x" * k for k in range(0, 90, 7)]
    cache = units.UnitCache(bpe.encode_many, limit=50)
    for text in [*texts, "a" * 5000, "Ab" * 3000]:
        want = library.encode_ordinary(text)
        assert bpe.encode(text) == want and memoryview(cache.encode(text)).cast("I").tolist() == want
        assert bpe.decode(want) == text.encode()


def test_bpe_round_trip_of_a_table(docs, empty):
    args = (queries.BYTE_RANKS, public_tokenizers.PATTERN)
    coded = byte_bpe.encode(docs, *args)
    assert sorted(bytes(r.raw) for r in byte_bpe.decode(coded, *args).collect()) == sorted((r.text or "").encode() for r in docs.collect())
    digests = {r.doc_id: r for r in byte_bpe.round_trip(docs, *args).collect()}
    for r in coded.collect():
        d = digests[r.doc_id]
        assert d.n_tokens == len(r.ids) and d.ids_sha256 == sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
    assert byte_bpe.round_trip(empty, *args).collect() == []


@pytest.mark.parametrize("path", [queries.BYTE_TOKENIZER, queries.WORD_TOKENIZER])
def test_units_give_the_ids_of_whole_texts(path):
    tokenizer = Tokenizer.from_file(path)
    rnd = random.Random(2)
    alphabet = "ab  \n\t\r\x85\xa0 　\x1c'sreSé1２½!-—日本aaáİßΣς́😀<|endoftext|>"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(1500)] + texts_of(8, 20)
    texts += SPECIAL_TEXTS
    texts += ["".join(rnd.choice([*"ab \n", "<|endoftext|>", "<|startoftext|>", "<|", "|>"]) for _ in range(20)) for _ in range(300)]
    texts += ["".join(map(chr, range(a, a + 40))) for a in range(0, 0x250, 40)] + ["É" + chr(k) + " Ab" + chr(k) + "C" for k in range(0x80, 0x380)]
    cache = units.tokenizer_cache(path)
    for text in texts:
        assert memoryview(cache.encode(text)).cast("I").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    long = " \n".join(texts_of(9, 60))
    assert "".join(units.blocks(long, 100)) == long and len(list(units.blocks(long, 100))) > 5
    assert b"".join(cache.encode(b) for b in units.blocks(long, 100)) == cache.encode(long)
    signs = ["".join(p) for p in itertools.product("a1é½²'.,—!", repeat=3)]
    assert [memoryview(i).cast("I").tolist() for i in cache.many(signs)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in signs]
    assert cache.many([long, None, "", *texts[:50]]) == [cache.encode(t) for t in (long, None, "", *texts[:50])]


# 7 sequence files

def test_sequence_files_read_back_whole(spark, docs, empty):
    tokenizer = Tokenizer.from_file(queries.BYTE_TOKENIZER)
    folder = sequence_files.sequence_folder(spark)
    unique = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    index = sequence_files.write_sequences(unique, folder, queries.BYTE_TOKENIZER, length=16)
    read = {r.doc_id: r.ids for r in sequence_files.read_sequences(index, folder).collect()}
    digest = {r.doc_id: r for r in sequence_files.digest_sequences(index, folder).collect()}
    start = 0
    for row in unique.orderBy("doc_id").collect():
        ids = [*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 0]
        assert read[row.doc_id] == ids
        d = digest[row.doc_id]
        assert (d.start, d.n_tokens, d.ids_crc32) == (start, len(ids), crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    used = 0
    for (part,) in index.select("part").distinct().collect():
        reader = sequence_files.SequenceReader(folder, part)
        for k in range(reader.file.num_record_batches):
            batch = reader.file.get_batch(k)
            assert batch.schema.field("ids").type.list_size == 16
            used += int(batch.column("mask").flatten().to_numpy(zero_copy_only=False).sum())
    assert used == start
    none = sequence_files.sequence_folder(spark)
    assert sequence_files.digest_sequences(sequence_files.write_sequences(empty, none, queries.BYTE_TOKENIZER), none).collect() == []


def test_sequence_files_hold_null_and_repeated_ids(spark, docs):
    tokenizer = Tokenizer.from_file(queries.BYTE_TOKENIZER)
    folder = sequence_files.sequence_folder(spark)
    index = sequence_files.write_sequences(docs, folder, queries.BYTE_TOKENIZER, length=16)
    rows = sorted(sequence_files.digest_sequences(index, folder).collect(), key=lambda r: r.start)
    want = Counter()
    for row in docs.collect():
        ids = [*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 0]
        want[row.doc_id, len(ids), crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    assert [r.start for r in rows] == [0, *itertools.accumulate(r.n_tokens for r in rows)][:-1]
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i))


# 8 top k

VECTORS = "vec_id long, embedding array<float>, label int, bucket int, stripe string"


def brute_top(rows, k):
    usable = [(i, [int(np.floor(64.0 * float(np.float32(x)))) for x in v]) for i, v, *_ in rows
              if i is not None and v and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    out = []
    for q, a in usable:
        if q % 20 == 0:
            own = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in usable if i != q and len(b) == len(a))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(own)]
    return sorted(out)


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(top_k, "BUCKET", 32)
    monkeypatch.setattr(top_k, "STRIPE_BUCKETS", 3)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.1, 1, 4])).astype(np.float32).tolist(), 0, 0, "s") for i in range(400)]
    rows += [(1000 + i, rows[20][1], 0, 0, "s") for i in range(70)]  # many equal vectors
    rows += [(2000 + i, [1.0, 2.0], 0, 0, "s") for i in range(0, 41, 20)] + [(2500 + i, (np.eye(8)[i % 8] * 90).tolist(), 0, 0, "s") for i in range(40)]
    rows += [(3000, None, 0, 0, "s"), (3020, [], 0, 0, "s"), (3040, [None, 1.0], 0, 0, "s"), (3060, [float("nan")] * 8, 0, 0, "s"),
             (3080, [float("inf")] * 8, 0, 0, "s"), (None, [1.0] * 8, 0, 0, "s"), (3100, [0.0] * 8, 0, 0, "s")]
    frame = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = sorted(map(tuple, top_k.top_k(frame, F.col("vec_id") % 20 == 0, 20).collect()))
    assert got == brute_top(rows, 20)
    huge = [(i, [3e5 * (i + 1) + i, 1.0], 0, 0, "s") for i in range(0, 60, 5)]
    assert sorted(map(tuple, top_k.top_k(spark.createDataFrame(huge, VECTORS), F.col("vec_id") % 20 == 0, 5).collect())) == brute_top(huge, 5)
    assert top_k.top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0).collect() == []


@pytest.mark.parametrize("dim", [2, 3, 4, 8])
def test_top_k_keeps_neighbours_nearer_to_the_axis_than_the_query(dim):
    rng = np.random.default_rng(dim)
    matrix = np.floor(64 * rng.normal(size=(1500, dim)))
    matrix[::20] = np.floor(matrix[::20] / 8)
    matrix[np.arange(0, 1500, 20), rng.integers(dim, size=75)] = rng.choice([-70.0, 70.0], 75)  # one dominant component
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    order = np.argsort(-norms, kind="stable")
    queries_at = np.flatnonzero(order % 20 == 0)
    matrix, norms, ids, k = matrix[order], norms[order], order, 20
    best = top_k.Best(len(queries_at), k)
    for at in range(0, len(ids), 64):
        part = slice(at, at + 64)
        if not top_k.search_bucket(best, matrix[queries_at], ids[queries_at], norms[queries_at], matrix[part], ids[part], norms[part]):
            break
    for n, at in enumerate(queries_at):
        own = sorted((-score, i) for score, i in zip(matrix @ matrix[at], ids, strict=True) if i != ids[at])[:k]
        assert own == [(-score, i) for score, i in zip(best.score[n], best.ids[n], strict=True)]
    # Cosine 0.988 with a query on the axis, at a limit of 0.8.
    best = top_k.Best(1, 1)
    length = float(np.hypot(63, 10))
    best.offer(0, np.array([0.8 * 64 * length]), np.array([9]))
    query, one = np.eye(1, dim) * 64, np.zeros((1, dim))
    one[0, :2] = 63, 10
    top_k.search_bucket(best, query, np.array([0]), np.array([64.0]), one, np.array([5]), np.array([length]))
    assert best.ids[0].tolist() == [5]


# 9 sharding

def smallest(sizes: list[int], shards: int) -> int:
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, n, used = (low + high) // 2, 1, 0
        for s in sizes:
            if used + s > middle:
                n, used = n + 1, 0
            used += s
        low, high = (low, middle) if n <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("hot", [0, 60])
def test_sharding_is_minimax(spark, hot):
    from hashlib import md5

    texts = [*texts_of(21, 90), None, "", *["one hot text"] * hot, *texts_of(21, 10)]
    frame = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, size string").repartition(3)
    got = sharding.shard(frame, 8).collect()
    assert len(got) == len(texts)
    shard_of, rows, sizes = defaultdict(set), defaultdict(list), Counter()
    groups = Counter()
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == crc32(raw) and r.law == "bytes" and r.grown_shard is None
        shard_of[raw].add(r.shard)
        rows[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        groups[md5(raw).digest()] += r.size
    assert all(len(s) == 1 for s in shard_of.values())
    assert all(sorted(s) == list(range(len(s))) for s in rows.values()) and set(rows) <= set(range(8))
    ordered = [groups[k] for k in sorted(groups)]
    assert max(sizes.values()) <= smallest(ordered, 8)
    order = [next(iter(shard_of[raw])) for raw in sorted(shard_of, key=lambda x: md5(x).digest())]
    assert order == sorted(order)


LAWS = {"uniform": lambda rng, n: rng.integers(1, 1000, n), "pareto": lambda rng, n: 10 * (1 + rng.pareto(1.1, n)),
        "lognormal": lambda rng, n: 1 + rng.lognormal(3, 1.5, n)}


def sizes_of(law: str, seed: int) -> list[int]:
    rng = np.random.default_rng(seed)
    n = int(rng.integers(9, 120))
    return [int(x) for x in LAWS[law](rng, n)]


@pytest.mark.parametrize("law", LAWS)
def test_capacity_search_equals_bisection_over_lists(monkeypatch, law):
    def reach(sums, limits, largest):
        return [max((u for u in sums if x - largest <= u <= x), default=None) for x in limits]

    monkeypatch.setattr(sharding, "_reach", reach)
    for seed in range(100):
        sizes = sizes_of(law, seed)
        sums = list(itertools.accumulate(sizes))
        assert sharding.smallest_capacity(sums, 8, sums[-1], max(sizes)) == smallest(sizes, 8), seed


@pytest.mark.parametrize("law, seed", [("uniform", 8), ("pareto", 5)])
def test_largest_shard_is_as_small_as_it_can_be(spark, law, seed):
    sizes = sizes_of(law, seed)
    sums = list(itertools.accumulate(sizes))
    table = spark.createDataFrame(list(zip(sizes, sums, strict=True)), "bytes long, upto long").coalesce(1).cache()
    ends = [0, *sharding.cut_points(table, 8, sums[-1], max(sizes)), sums[-1]]
    assert ends == sorted(ends) and set(ends) <= {0, *sums}
    assert max(b - a for a, b in itertools.pairwise(ends)) == smallest(sizes, 8)


def test_sharding_edge_tables(spark, docs, empty):
    assert sharding.shard(empty).collect() == []
    assert sharding.shard(docs).count() == docs.count()
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert [(r.shard in range(8), r.slot) for r in sharding.shard(one).collect()] == [(True, 0)]


# 10 language

def test_codewords_are_far_apart():
    for n, apart in ((2, 1), (4, 4), (7, 32), (9, 8), (40, 32)):
        code = language_id.codewords(n)
        assert min((code[a] != code[b]).sum() for a, b in itertools.combinations(range(n), 2)) >= apart
    assert language_id.codewords(1).shape == (1, 0)


def test_language_of_held_out_rows(spark, sf_dir):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(frame).join(frame.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    unseen = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in unseen) >= 0.99 * len(unseen)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_rows(spark, docs, empty):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 -- !!", "en"), (4, "the quick brown fox", None), (None, "der schnelle Fuchs", "de"),
            (5, "the lazy dog and the fox", "en"), (6, "der faule Hund und die Katze", "de"), (7, "the the and", "en"), (9, "und der die das", "de")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(frame).collect()}
    assert len(got) == len(rows) and [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[None].held_out
    assert {r.lang_pred for r in got.values()} <= {"und", "en", "de"}
    assert language_id.identify(empty).collect() == []
    unlabelled = frame.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(unlabelled).collect()} == {"und"}
    assert language_id.keep_known(docs).columns == docs.columns


def test_number_signs_are_no_letters(spark):
    rows = [(1, "12 \u00bd \u00b2 \u2460 \u2167", "en"), (2, "\u2167 a", "en"), (5, "the lazy dog", "en"), (6, "der faule Hund", "de"),
            (7, "the the and", "en"), (9, "und der die das", "de")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(frame).collect()}
    assert (got[1].lang_pred, got[1].score, got[1].ambiguous) == ("und", 0.0, False) and got[2].lang_pred != "und"


# pipeline

def test_pipeline_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    known = {r.doc_id for r in corpus_pipeline.language(spark, documents, sf_dir).collect()}
    assert {d for d, t in rows if re.search(r"[^\W\d_]", t or "")} == known
    left = [(d, t) for d, t in rows if d in known]
    exact = brute_exact(left)
    left = [(d, t) for d, t in left if exact[d][2]]
    classes = brute_classes(left)
    left = {d for d, _ in left if classes[d][0] == d}
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in packed} == left
    tokens = sum(r.length for r in packed)
    assert check_packing(packed, corpus_pipeline.CAPACITY) <= -(-tokens // corpus_pipeline.CAPACITY) + 1


def test_pipeline_stages_take_edge_rows(spark, docs, empty):
    for frame in (docs, empty):
        for name, step in corpus_pipeline.STAGES[:-1]:
            assert step(spark, frame, "").columns == frame.columns, name
    assert corpus_pipeline.pack(spark, docs.where("doc_id < 5"), "").count() >= 5


def test_a_bucket_without_links_pairs_its_members_once(spark, monkeypatch):
    """A pivot that has met its bucket leaves it, so each pair comes once however many rounds the bucket takes."""
    size = 40
    sets = spark.createDataFrame([(n, [n * 10 + k for k in range(10)]) for n in range(size)], "node long, items array<long>")
    members = spark.createDataFrame([(1, n, 10, 10, [0] * near_dedup.MAP_WORDS, n) for n in range(size)],
                                    "bucket long, node long, n long, common long, map array<long>, component long")
    met, real = [], near_dedup._pairs

    def pairs(*args):
        found = real(*args)
        met.extend((r.node, r.pivot) for r in found.collect())
        return found

    monkeypatch.setattr(near_dedup, "_pairs", pairs)
    label = near_dedup._settled(members, members.select("node", "component").limit(0), sets, 0.8, 1)
    assert label.isEmpty()
    assert sorted(met) == [(a, b) for a in range(size) for b in range(a)]
