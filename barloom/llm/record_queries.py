"""Registered queries of the operators on ordered records and report texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.ranks import positions
from barloom.llm import merkle, prefix_trie, suffix_family
from barloom.llm.common import as_reports, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def id_crc(key: str) -> Column:
    """Unsigned CRC-32 of an integer key in decimal."""
    return F.crc32(F.col(key).cast("string").cast("binary"))


def op11_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_family.remove_repeated_bytes(as_reports(table(spark, sf_dir, "documents")))
    return cut.select(
        F.col("report_id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def rebuilt_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations of the contract as parts, and all their ids.

    Every conversation takes its first h turns from the first conversation of
    its hundred, then goes on with its own turns behind h.
    """
    turns = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    turns = positions(turns, ["conv_id"], ["turn", "role", "text"])
    ids = turns.select("conv_id").distinct().select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("head"), (id_crc("conv_id") % 6).alias("h")
    )
    part = ["place", "role", "text"]
    own = turns.where(F.col("place") > id_crc("conv_id") % 6).select("conv_id", *part)
    heads = turns.where("place < 6").withColumnRenamed("conv_id", "head")
    taken = ids.join(heads, "head").where("place <= h").select("conv_id", *part)
    return own.unionByName(taken).toDF("report_id", "position", "section", "body"), ids.select(F.col("conv_id").alias("report_id"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, ids = rebuilt_conversations(table(spark, sf_dir, "conversations"))
    nodes, ends = prefix_trie.prefix_trie(parts, ids)
    digests = prefix_trie.ends_digest(ends).withColumnRenamed("node_report_id", "report_id")
    return nodes.join(digests, ["report_id", "depth"], "left").select(
        F.col("report_id").alias("conv_id"), "depth", F.col("parent_report_id").alias("parent_conv_id"),
        F.col("n_reports").alias("n_convs"), "n_children", "n_leaves", F.col("saved_chars").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = merkle.record_digest([*fields[:4], F.translate("text", UPPER, LOWER)])
    docs = docs.withColumn("claimed", F.when(id_crc("doc_id") % 5 == 0, lowered).otherwise(merkle.record_digest(fields)))
    found = merkle.panel_manifest(docs, "source", ["doc_id"], fields, carry=["claimed"])
    folded = found.withColumn("folded_root", merkle.fold(F.col("claimed"), F.col("path")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


QUERIES = {
    "op11_suffix_array": op11_suffix_array,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES = {
    "op11_suffix_array": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
chunk AS (
  SELECT doc_id, o, substr(x, 2 * o + 1, 2 * 1049) AS c
  FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2, 1000)) AS o FROM d)),
win AS (
  SELECT doc_id, o + i AS p, substr(c, 2 * i + 1, 100) AS s
  FROM (SELECT doc_id, o, c, unnest(range(0, least(1000, len(c) // 2 - 49))) AS i FROM chunk)),
src AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM win JOIN src USING (s) WHERE m < doc_id),
run AS (
  SELECT doc_id, min(p) AS b, max(p) + 50 AS e
  FROM (SELECT doc_id, p, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM hit)
  GROUP BY doc_id, r),
around AS (
  SELECT doc_id, e AS b, lead(b) OVER (PARTITION BY doc_id ORDER BY b) AS e FROM run
  UNION ALL SELECT doc_id, 0, min(b) FROM run GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(substr(x, 2 * b + 1, 2 * (coalesce(e, len(x) // 2) - b)), '' ORDER BY b) AS k
  FROM around JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(e - b) AS n_removed, count(*) AS n_spans FROM run GROUP BY doc_id)
SELECT doc_id, len(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op12_prefix_trie": """
WITH RECURSIVE polynomial(i, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM polynomial WHERE k < 8),
byte_table AS (SELECT list(c ORDER BY i) AS t FROM polynomial WHERE k = 8),
t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS head, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: xor(a >> 8, tb[xor(a & 255, b) + 1])), 4294967295) % 6 AS h
  FROM t, (SELECT t AS tb FROM byte_table)),
r AS (
  SELECT c.conv_id, p, role, text FROM c JOIN t ON t.conv_id = head AND p <= h
  UNION ALL SELECT c.conv_id, p, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND p > h),
s AS (
  SELECT c.conv_id, coalesce(list({'role': role, 'text': text} ORDER BY p) FILTER (p IS NOT NULL), []) AS turns
  FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
pre AS (
  SELECT conv_id, len(turns) AS n, d, sha256(CAST(turns[1:d] AS JSON)::VARCHAR) AS k, sha256(CAST(turns[1:d - 1] AS JSON)::VARCHAR) AS up,
         CASE WHEN d = 0 THEN 0 ELSE length(turns[d].text) END AS w
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM s)),
node AS (
  SELECT d, k, min(conv_id) AS conv_id, min(up) AS up, count(*) AS n_convs, (count(*) - 1) * min(w) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends, max(n) = d AS leaf
  FROM pre GROUP BY d, k),
sub AS (
  SELECT a.d, a.k, CAST(sum(b.leaf::INT) AS BIGINT) AS n_leaves, CAST(sum(b.saved) AS BIGINT) AS saved,
         count(*) FILTER (b.d = a.d + 1) AS n_children
  FROM node b JOIN pre x ON x.conv_id = b.conv_id AND x.d <= b.d JOIN node a ON a.d = x.d AND a.k = x.k
  GROUP BY a.d, a.k)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, n_children, n_leaves, sub.saved AS saved_tokens,
       v.ends AS ends_sha256
FROM node v JOIN sub ON sub.d = v.d AND sub.k = v.k LEFT JOIN node u ON u.d = v.d - 1 AND u.k = v.up""",
    "op13_merkle_manifest": """
WITH RECURSIVE polynomial(i, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM polynomial WHERE k < 8),
byte_table AS (SELECT list(c ORDER BY i) AS t FROM polynomial WHERE k = 8),
crc AS (
  SELECT DISTINCT doc_id, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) AS crc
  FROM documents, byte_table),
f AS (
  SELECT doc_id, source, text,
         CASE WHEN doc_id IS NULL THEN '-' ELSE length(doc_id::VARCHAR) || ':' || doc_id END ||
         CASE WHEN source IS NULL THEN '-' ELSE octet_length(encode(source)) || ':' || source END ||
         CASE WHEN lang IS NULL THEN '-' ELSE octet_length(encode(lang)) || ':' || lang END ||
         CASE WHEN n_chars IS NULL THEN '-' ELSE length(n_chars::VARCHAR) || ':' || n_chars END AS head
  FROM documents),
leaf AS (
  SELECT doc_id, source, crc % 5 = 0 AS touched,
         sha256(head || CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(text)) || ':' || text END) AS leaf,
         sha256(head || CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(text)) || ':' ||
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END) AS lowered
  FROM f LEFT JOIN crc USING (doc_id)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree
  FROM leaf),
low(tree, level, pos, n, h) AS (
  SELECT tree, 0, pos, n, leaf FROM placed
  UNION ALL
  SELECT tree, any_value(level) + 1, pos // 16, any_value(n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos))
  FROM low WHERE n > 1 GROUP BY tree, pos // 16),
subroots AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high(level, pos, n, h) AS (
  SELECT 0, pos, n, subroot FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, pos // 16, any_value(n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos))
  FROM high WHERE n > 1 GROUP BY pos // 16),
runs AS (
  SELECT tree, level, pos // 16 AS run, list(h ORDER BY pos) AS hs FROM low WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT 0, level, pos // 16, list(h ORDER BY pos) FROM high WHERE n > 1 GROUP BY ALL),
up(tree, pos0, level, pos, proof, digest) AS (
  SELECT tree, pos, 0, pos, '', CASE WHEN touched THEN lowered ELSE leaf END FROM placed
  UNION ALL
  SELECT u.tree, pos0, u.level + 1, u.pos // 16,
         proof || array_to_string(hs[1:u.pos % 16], '') || array_to_string(hs[u.pos % 16 + 2:], ''),
         sha256(array_to_string(hs[1:u.pos % 16], '') || digest || array_to_string(hs[u.pos % 16 + 2:], ''))
  FROM up u JOIN runs r ON r.tree = u.tree AND r.level = u.level AND r.run = u.pos // 16),
below AS (SELECT tree, pos0, arg_max(proof, level) AS proof, arg_max(digest, level) AS digest FROM up GROUP BY tree, pos0),
over(tree, pos0, level, pos, proof, digest) AS (
  SELECT b.tree, pos0, 0, s.pos, proof, digest FROM below b JOIN subroots s ON s.tree = b.tree
  UNION ALL
  SELECT u.tree, pos0, u.level + 1, u.pos // 16,
         proof || array_to_string(hs[1:u.pos % 16], '') || array_to_string(hs[u.pos % 16 + 2:], ''),
         sha256(array_to_string(hs[1:u.pos % 16], '') || digest || array_to_string(hs[u.pos % 16 + 2:], ''))
  FROM over u JOIN runs r ON r.tree = 0 AND r.level = u.level AND r.run = u.pos // 16),
done AS (SELECT tree, pos0, arg_max(proof, level) AS proof, arg_max(digest, level) AS digest FROM over GROUP BY tree, pos0)
SELECT doc_id, leaf, subroot, (SELECT h FROM high WHERE n = 1) AS root, sha256(proof) AS proof_sha256,
       digest AS folded_root, digest = (SELECT h FROM high WHERE n = 1) AS verified
FROM placed p JOIN subroots s ON s.tree = p.tree JOIN done d ON d.tree = p.tree AND d.pos0 = p.pos""",
}
