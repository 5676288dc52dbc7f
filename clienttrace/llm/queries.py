"""The registered queries of the operators, with their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clienttrace.llm import (
    bpe, decontaminate, language, licenses, neighbours, pitman_yor, repair, simhash, substrings, toxicity,
    trie, urls, warc)
from clienttrace.llm.common import fold

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op6_bpe(spark, sf_dir):
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), TOKENIZER))


@query
def op5_simhash(spark, sf_dir):
    return simhash.groups(table(spark, sf_dir, "documents"))


@query
def op1_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold("doc_id", 5) == 0
    machine = toxicity.fit(docs, labels, ~held_out)
    return toxicity.score(docs, machine).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op10_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    return language.predict(docs, language.fit(docs, ~held_out)).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op8_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_neighbours(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)



@query
def op3_licenses(spark, sf_dir):
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))


@query
def op4_warc(spark, sf_dir):
    _, revisits = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, revisits, payloads=False).select(
        F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"))


SQL["op4_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h,
    min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes::bigint AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::bigint >> (15 - (i % 4) * 5)) & 31)::int + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d"""

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@query
def op7_urls(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


@query
def op9_pitman_yor(spark, sf_dir):
    return pitman_yor.score(table(spark, sf_dir, "documents"), fold("doc_id", 10) != 0)


@query
def op12_repair(spark, sf_dir):
    return repair.repairs(table(spark, sf_dir, "conversations"))


@query
def op13_trie(spark, sf_dir):
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


SQL["op13_trie"] = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_transform(range(0, 8 * length(conv_id::varchar)),
      lambda i: (ascii(substr(conv_id::varchar, (i // 8 + 1)::bigint, 1)) >> (i % 8)::int) & 1)::bigint[],
    lambda a, b: xor(a >> 1, CASE WHEN (xor(a, b) & 1) = 1 THEN 3988292384 ELSE 0 END), 4294967295::bigint), 4294967295::bigint) % 9 AS h
  FROM t GROUP BY ALL),
seq AS (SELECT i.conv_id, 0 AS own, pos, role, text FROM ids i JOIN t ON t.conv_id = i.base AND pos <= h
  UNION ALL SELECT i.conv_id, 1, pos, role, text FROM ids i JOIN t ON t.conv_id = i.conv_id AND pos > h),
whole AS (SELECT conv_id, coalesce(list({'role': role, 'text': text} ORDER BY own, pos) FILTER (pos IS NOT NULL), []) AS turns
  FROM ids LEFT JOIN seq USING (conv_id) GROUP BY conv_id),
members AS (SELECT conv_id, unnest(range(0, len(turns) + 1)) AS depth, turns FROM whole),
nodes AS (SELECT turns[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(octet_length(encode(any_value(turns[depth].text))), 0) AS size,
    string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (len(turns) = depth) AS ends FROM members GROUP BY ALL),
children AS (SELECT node[1:depth - 1] AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
valued AS (SELECT nodes.*, coalesce(n, 0) AS n_children, (n_convs - 1) * size AS saved
  FROM nodes LEFT JOIN children USING (node)),
above AS (SELECT node[1:d] AS node, sum((n_children = 0)::int) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM valued) GROUP BY ALL)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves::bigint AS n_leaves,
  saved_tokens::bigint AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM valued v JOIN above USING (node) LEFT JOIN valued p ON v.depth > 0 AND p.depth = v.depth - 1 AND p.node = v.node[1:v.depth - 1]"""


@query
def op11_substrings(spark, sf_dir):
    return substrings.digests(substrings.kept(table(spark, sf_dir, "documents")))


SQL["op11_substrings"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS sequence
  FROM (SELECT *, unnest(range(1, len(words) - 18)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY sequence ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM again),
numbered AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d),
left_over AS (SELECT doc_id, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone.i IS NULL) AS kept
  FROM numbered LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)"""
