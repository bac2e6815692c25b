"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import chat, html, kneser_ney, maxent, neighbours, packing, repeats, sentencepieces, simhash, tokens
from tesserae.llm.common import fresh_path, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repetition(table(spark, sf_dir, "documents"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def vocabulary(name: str) -> str:
    """Where an installed public vocabulary file lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_path(spark, "tokens")
    tokens.write(table(spark, sf_dir, "documents"), out, vocabulary("byte_bpe_50k.json"))
    return tokens.digests(spark, out)


#: A conversation whose texts look like the template's own marks.
MARKS = "<|im_end|><|im_start|>assistant ok"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(MARKS).alias("text"))
    return chat.digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))


OP5_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{MARKS}'), (-1, 1, 'assistant', '{MARKS}')) AS v(conv_id, turn, role, text)
), e AS (
  SELECT *, length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) + length(replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '\\n')) + {len(chat.START) + len(chat.END) + 2} AS n FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return kneser_ney.classify(docs, kneser_ney.train(docs, table(spark, sf_dir, "labels")))


def op7_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op9_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trips(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_repeats": op2_repeats,
    "op3_neighbours": op3_neighbours,
    "op4_tokens": op4_tokens,
    "op5_chat": op5_chat,
    "op6_kneser_ney": op6_kneser_ney,
    "op7_maxent": op7_maxent,
    "op8_html": op8_html,
    "op9_sentencepieces": op9_sentencepieces,
    "op10_packing": op10_packing,
}
ORACLE: dict[str, str] = {"op5_chat": OP5_SQL}
