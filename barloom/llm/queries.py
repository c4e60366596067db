"""The registered queries: each maps the given tables to an operator and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import (
    bpe,
    chat,
    decontaminate,
    exact_dedup,
    jaccard_join,
    language_id,
    language_model,
    personal_data,
    record_queries,
    sharding,
    substring_dedup,
)
from barloom.llm.common import as_reports, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = sharding.shard_panel(
        table(spark, sf_dir, "documents"),
        size=F.octet_length(text) + 1,
        shards=8,
        key=("doc_id",),
        carry={"text_crc32": F.crc32(text)},
    )
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard",
        "virtual_slot", "slot_bytes", "even_shard",
    )


#: The conversation that the contract of the query adds to the table.
EXTRA_TEXT = "\\### Assistant: </turn> ok"


def chat_records(conversations: DataFrame) -> DataFrame:
    """Conversation rows as JSON records, in the layout that their roles fit."""
    turns = conversations.select(
        "conv_id", F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    roles = F.array_join(F.transform("ts", lambda t: F.coalesce(t["role"], F.lit("user"))), " ")

    def text(i: int):
        return F.col("ts")[i]["text"]

    payload = (
        F.when(roles == "user assistant", F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion"))))
        .when(
            roles == "system user assistant",
            F.to_json(F.struct(text(0).alias("system"), text(1).alias("input"), text(2).alias("output"))),
        )
        .otherwise(
            F.to_json(
                F.struct(
                    F.transform(
                        "ts",
                        lambda t: F.struct(
                            F.coalesce(t["role"], F.lit("user")).alias("role"), t["text"].alias("content")
                        ),
                    ).alias("messages")
                )
            )
        )
    )
    return grouped.select(F.col("conv_id").alias("record_id"), payload.alias("payload"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(EXTRA_TEXT).alias("text"),
    )
    out = chat.format_chats(chat_records(conversations.unionByName(extra)))
    read = out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn(
        "masked", chat.masked_text(F.col("formatted"), F.col("loss_spans"))
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        F.col("record_id").alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("masked").cast("bigint").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        table(spark, sf_dir, "benchmark").select("item_id", "text"),
    )


def fold(key: str, n: int) -> Column:
    """The fold of a document: crc32 of its id as text; -1 without an id, which no fold is."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % n, F.lit(-1))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("text_id"), "text", "lang", (fold("doc_id", 4) == 2).alias("held_out")
    )
    network = language_id.train(docs.where("NOT held_out").select("text_id", "text", "lang"))
    held_out = fold("text_id", 4) == 2
    return language_id.identify(docs, network).select(
        F.col("text_id").alias("doc_id"), held_out.alias("held_out"), F.col("lang").alias("lang_pred"), "score"
    )


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.near_duplicates(as_reports(table(spark, sf_dir, "documents")))
    return found.withColumnRenamed("report_id", "doc_id")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(as_reports(table(spark, sf_dir, "documents")))
    return cut.select(
        F.col("report_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(as_reports(table(spark, sf_dir, "documents")))
    return found.select(
        F.col("report_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


def word_vocabulary() -> str:
    """The vocabulary file the contract names; read on the driver, never copied."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(as_reports(table(spark, sf_dir, "documents")), word_vocabulary()).select(
        F.col("report_id").alias("doc_id"),
        (F.octet_length("token_ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    found = personal_data.find_personal_data(texts)

    def joined(spans: str) -> Column:
        one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(one, ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        F.col("text_id").alias("doc_id"),
        *[count(k) for k in ("email", "ip", "card", "phone")],
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("report_id", 5) == 1
    scored = language_model.score_reports(as_reports(docs).withColumn("learn", ~held_out))
    return scored.select(
        F.col("report_id").alias("doc_id"), held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score",
    )


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_chat_format": op2_chat_format,
    "op3_decontamination": op3_decontamination,
    "op4_language_id": op4_language_id,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_bpe": op8_bpe,
    "op9_personal_data": op9_personal_data,
    "op10_lm_scoring": op10_lm_scoring,
} | record_queries.QUERIES

ORACLES = {
    "op2_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(6 + 1 + 7 + length(role) + length(text)
           + length(regexp_replace(role || text, '[^\\<>]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
    "op3_decontamination": r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
i AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM benchmark),
dg AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda j: array_to_string(w[j:j + 4], ' '))) AS g
  FROM d),
ig AS (
  SELECT DISTINCT item_id,
         unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda j: array_to_string(w[j:j + 4], ' '))) AS g
  FROM i),
n AS (SELECT item_id, count(*) AS item_shingles FROM ig GROUP BY item_id)
SELECT doc_id, item_id, item_shingles, count(*) AS shared_shingles, count(*) / item_shingles AS containment
FROM dg JOIN ig USING (g) JOIN n USING (item_id)
GROUP BY doc_id, item_id, item_shingles HAVING count(*) * 100 >= item_shingles * 80""",
    "op5_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE
      WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda j: array_to_string(w[j:j + 4], ' ')) END) AS g
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS s
  FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * s >= 80 * (x.n + y.n - s)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN n USING (doc_id)""",
    "op6_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
win AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS i,
         unnest(list_transform(range(1, len(w) - 48), lambda j: array_to_string(w[j:j + 49], ' '))) AS s
  FROM d WHERE len(w) >= 50),
src AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN src USING (s) WHERE m < doc_id),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS k
  FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d)
  ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op7_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents),
g AS (
  SELECT plain, count(*) AS group_size, arg_min(doc_id, (-length(text), doc_id)) AS keep_id
  FROM d GROUP BY plain)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256
FROM d JOIN g USING (plain)""",
} | record_queries.ORACLES
