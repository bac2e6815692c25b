"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and only its reply is
trainable. As each example is a prefix of its conversation's formatted text, the text is written once and an
example is three offsets into it; with_text() spells examples out. So the output grows with the input, not with
the square of a conversation's turns.

Template: <|im_start|>ROLE, line break, TEXT, <|im_end|>, line break. In roles and texts a backslash is
doubled and "<|" becomes "<", backslash, "|"; a line break in a role becomes backslash, "n".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import fresh_path

START, END, TRAINED = "<|im_start|>", "<|im_end|>", "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def _unescaped_role(role: Column) -> Column:
    return unescaped(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, text, spans (array of turn, context_end, loss_start, loss_end: code points before each place).

    turns: conv_id, turn, role, text. Turns are taken by turn, ties by role and text; null turns come first,
    null roles and texts are empty, null conv_ids form a conversation. Repeated rows are turns of their own.
    Other columns are not read; no rows give no rows.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    head, body = F.concat(F.lit(START), _escaped_role(F.col("role")), F.lit("\n")), escaped(F.col("text"))
    rows = rows.withColumns({"head": F.length(head), "body": F.length(body), "piece": F.concat(head, body, F.lit(END + "\n"))})
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0).cast("long")))
    part = F.struct("at", "turn", (F.col("role") == TRAINED).alias("trained"), "head", "body", "piece")
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))

    def span(p: Column) -> Column:
        start = p["at"] + p["head"]
        return F.struct(p["turn"].alias("turn"), p["at"].alias("context_end"), start.alias("loss_start"), (start + p["body"]).alias("loss_end"))

    return whole.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("text"),
        F.transform(F.filter("parts", lambda p: p["trained"]), span).alias("spans"),
    )


def write(turns: DataFrame, path: str) -> None:
    """Two tables: texts (conv_id, text) and examples (conv_id, example from 0, turn, context_end, loss_start, loss_end)."""
    spark = turns.sparkSession
    formatted(turns).write.parquet(f"{path}/formatted")
    done = spark.read.parquet(f"{path}/formatted")
    done.select("conv_id", F.posexplode("spans").alias("example", "s")).select("conv_id", "example", "s.*").write.parquet(f"{path}/examples")


def with_text(texts: DataFrame, examples: DataFrame) -> DataFrame:
    """examples with context, target (the trainable reply, still escaped) and suffix spelled out."""
    part = lambda a, b: F.substr("text", a + 1, b - a)
    joined = examples.join(texts.select(F.col("conv_id").alias("_conv"), "text"), F.col("conv_id").eqNullSafe(F.col("_conv")))
    zero = F.lit(0).cast("long")
    return joined.select("conv_id", "example", "turn", part(zero, F.col("loss_start")).alias("context"), part(F.col("loss_start"), F.col("loss_end")).alias("target"), F.lit(END).alias("suffix"))


def turns_of(text: Column) -> Column:
    """The turns that a formatted text holds: an array of role and text, unescaped."""
    pieces = F.filter(F.split(text, r"<\|im_end\|>\n", -1), lambda p: p != "")
    body = lambda p: F.substr(p, F.lit(len(START) + 1))
    role = lambda p: F.substring_index(body(p), "\n", 1)
    return F.transform(pieces, lambda p: F.struct(_unescaped_role(role(p)).alias("role"), unescaped(F.substr(body(p), F.length(role(p)) + 2)).alias("text")))


def digests(turns: DataFrame) -> DataFrame:
    """Formats turns into the shared folder, reads the output back and describes each conversation."""
    spark = turns.sparkSession
    path = fresh_path(spark, "chat")
    write(turns, path)
    texts, examples = spark.read.parquet(f"{path}/formatted").select("conv_id", "text"), spark.read.parquet(f"{path}/examples")
    spans = examples.groupBy(F.col("conv_id").alias("_conv")).agg(F.array_sort(F.collect_list(F.struct("example", "loss_start", "loss_end"))).alias("spans"))
    joined = texts.join(spans, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    loss = F.array_join(F.transform(F.coalesce("spans", F.array()), lambda s: unescaped(F.substr("text", s["loss_start"] + 1, s["loss_end"] - s["loss_start"]))), "")
    told = joined.select("conv_id", "text", loss.alias("loss"), turns_of(F.col("text")).alias("turns"))
    return told.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
    )
