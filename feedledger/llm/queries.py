"""The registered queries of this subpackage, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from feedledger.llm import (byte_bpe, conversation_trie, exact_dedup, language_id, mixing, near_dedup, packing, period_runs,
                            sequence_files, sharding, token_counts, top_k, url_filter)
from feedledger.llm.worker import ship

ship(__name__)

Query = Callable[[SparkSession, str], DataFrame]

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CAPACITY = 2048
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


@query
def op2_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op3_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


@query
def op5_packing(spark, sf_dir):
    pieces = packing.tokenize_pieces(table(spark, sf_dir, "documents"), WORD_TOKENIZER, CAPACITY, with_ids=False)
    return packing.pack(pieces, CAPACITY)


@query
def op6_byte_bpe(spark, sf_dir):
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


@query
def op7_sequence_files(spark, sf_dir):
    folder = sequence_files.sequence_folder(spark)
    index = sequence_files.write_sequences(table(spark, sf_dir, "documents"), folder, BYTE_TOKENIZER)
    return sequence_files.digest_sequences(index, folder)


@query
def op8_top_k(spark, sf_dir):
    return top_k.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op9_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


@query
def op10_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


@query
def op11_conversation_trie(spark, sf_dir):
    turns = conversation_trie.conversation_turns(table(spark, sf_dir, "conversations"))
    nodes = conversation_trie.prefix_trie(conversation_trie.borrowed_heads(turns))
    return nodes.drop("n_ends")


def repeat_from(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words of every tenth document or so, made periodic from some word on as its id decides; a null id changes nothing."""
    h = crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % period] for i in range(a, n)]


@query
def op12_period_runs(spark, sf_dir):
    found = period_runs.find_runs(table(spark, sf_dir, "documents"), rewrite=repeat_from, digest=True)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.shorter")).alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * -best.shorter div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"))


@query
def op13_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


@query
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


ORACLES["op2_url_filter"] = """
WITH RECURSIVE split AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(rule, rule_host, rule_path, verdict) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
best AS (
  SELECT s.page_id, s.host, s.path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM split s LEFT JOIN rules r
    ON (s.host = r.rule_host OR ends_with(s.host, '.' || r.rule_host)) AND starts_with(s.path, r.rule_path)
  GROUP BY ALL),
links AS (
  SELECT url, regexp_extract(tag, '(?i)href\\s*=\\s*["'']?([^"''\\s>]+)', 1) AS target
  FROM (SELECT url, unnest(regexp_extract_all(html, '(?i)<link\\b[^>]*>')) AS tag FROM pages WHERE contains(lower(html), 'canonical'))
  WHERE regexp_matches(tag, '(?i)\\srel\\s*=\\s*["'']?canonical')
  UNION ALL
  SELECT url, regexp_extract(tag, '(?i)url\\s*=\\s*([^"''>]+)', 1)
  FROM (SELECT url, unnest(regexp_extract_all(html, '(?i)<meta\\b[^>]*>')) AS tag FROM pages WHERE contains(lower(html), 'refresh'))
  WHERE regexp_matches(tag, '(?i)\\shttp-equiv\\s*=\\s*["'']?refresh')),
edges AS (
  SELECT split_part(url, '#', 1) AS a, split_part(target, '#', 1) AS b FROM links WHERE contains(url, '://') AND contains(target, '://')),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
nodes AS (
  SELECT n.node, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM (SELECT DISTINCT a AS node, regexp_extract(a, '^.*?://([^/?#]*)', 1, 's') AS host, regexp_extract(a, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
        FROM both_ways) n
  JOIN rules r ON (lower(n.host) = r.rule_host OR ends_with(lower(n.host), '.' || r.rule_host)) AND starts_with(n.path, r.rule_path)
  GROUP BY ALL),
tainted AS (SELECT DISTINCT r.a AS node FROM reach r JOIN nodes n ON r.b = n.node WHERE n.verdict = 'block')
SELECT b.page_id, b.host, b.path, b.rule, coalesce(b.verdict, CASE WHEN t.node IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       b.verdict IS NULL AND t.node IS NOT NULL AS blocked_by_alias
FROM best b JOIN pages p USING (page_id) LEFT JOIN tainted t ON t.node = split_part(p.url, '#', 1) AND contains(p.url, '://')
"""

ORACLES["op4_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = first_value(doc_id) OVER best AS kept, sha256(body) AS text_sha256
FROM t WINDOW best AS (PARTITION BY body ORDER BY length(raw) DESC, doc_id)
"""

ORACLES["op8_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
"""

ORACLES["op11_conversation_trie"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, sha256(length(role)::VARCHAR || ':' || role || text)) AS turns
  FROM t GROUP BY conv_id),
crc AS (
  SELECT conv_id, turns, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)),
                             lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)::BIGINT))) % 4 AS h
  FROM own),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(d.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM crc c LEFT JOIN own d ON d.conv_id = c.conv_id - c.conv_id % 20),
placed AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt),
nodes AS (
  SELECT turns[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CASE WHEN len(turns) = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM placed GROUP BY 1, 2),
children AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
told AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children,
         CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * len(regexp_extract_all(n.path[n.depth].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.path = n.path),
up AS (SELECT path, saved, n_children, unnest(range(0, depth + 1)) AS depth FROM told),
subtrees AS (SELECT path[1:depth] AS path, depth, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM up GROUP BY 1, 2)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM told n JOIN subtrees s ON s.depth = n.depth AND s.path = n.path
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
"""
