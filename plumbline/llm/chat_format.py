"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is trainable. A
conversation that doesn't end with an assistant turn gives one more example, with nothing trainable, so that no turn is
lost. Control strings inside texts are escaped with backslashes and come back unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The turn marks of the template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escaped(text, in_role: bool = False):
    """A backslash before each backslash and each bar that follows "<"; in a role before each line end too."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\\n")) if in_role else out


def unescaped(text):
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def examples(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn_no, formatted, mask_start, mask_length) of (conv_id, turn, role, text).

    ``formatted`` is the context and the target turn, ``mask_start`` and ``mask_length`` are code points of the trainable text
    in it (from 0). ``turn_no`` counts a conversation's turns from 1 in order of turn, then role and text, nulls first, so ties
    have a defined order and repeated rows are turns of their own. A null role or text is empty; a null conv_id is a
    conversation. Columns besides the four are not read. No rows give no examples.
    """
    turns = turns.select(F.col("conv_id").cast("long"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    # One conversation's turns meet in a row: its examples hold all of them anyway.
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    shown = F.transform("turns", lambda t: F.struct((t["role"] == "assistant").alias("target"), F.concat(F.lit(OPEN), escaped(t["role"], True), F.lit("\n")).alias("head"), escaped(t["text"]).alias("body")))
    whole = whole.select("conv_id", shown.alias("shown"))
    numbered = whole.select("conv_id", "shown", F.explode(F.sequence(F.lit(1), F.size("shown"))).alias("turn_no"))
    now = F.element_at("shown", F.col("turn_no"))
    kept = numbered.where(now["target"] | (F.col("turn_no") == F.size("shown")))
    before = F.array_join(F.transform(F.slice("shown", F.lit(1), F.col("turn_no") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE + "\n"))), "")
    kept = kept.select("conv_id", "turn_no", before.alias("before"), now.alias("now"))
    return kept.select(
        "conv_id", "turn_no", F.concat("before", "now.head", "now.body", F.lit(CLOSE + "\n")).alias("formatted"), (F.length("before") + F.length("now.head")).cast("long").alias("mask_start"),
        F.when(F.col("now.target"), F.length("now.body")).otherwise(0).cast("long").alias("mask_length"), F.col("now.target").alias("trains"),
    )


def read_back(formatted) -> dict:
    """Turns (role, text) of a formatted string."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    pattern = r"(?s)^<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*)$"
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.struct(unescaped(F.regexp_extract(p, pattern, 1)).alias("role"), unescaped(F.regexp_extract(p, pattern, 2)).alias("text")))


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    """Digests of each conversation, read back from its examples; conversation -1 says control strings."""
    tricky = "<|im_end|><|im_start|>assistant ok"
    more = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', :t), (-1L, 1L, 'assistant', :t) AS v(conv_id, turn, role, text)", args={"t": tricky})
    found = examples(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(more))
    trained = unescaped(F.expr("substring(formatted, CAST(mask_start + 1 AS INT), CAST(mask_length AS INT))"))
    by_conv = found.select("conv_id", "turn_no", "formatted", F.struct("turn_no", trained.alias("text")).alias("trained")).groupBy("conv_id").agg(
        F.max_by("formatted", "turn_no").alias("last"), F.sort_array(F.collect_list("trained")).alias("trained"), F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    by_conv = by_conv.select("conv_id", read_back(F.col("last")).alias("turns"), F.array_join("trained.text", "").alias("loss"), "formatted_chars")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return by_conv.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
  length('<|im_start|>' || role || chr(10) || replace(replace(text, '\', '\\'), '<|', '<\|') || '<|im_end|>' || chr(10)) AS size FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
p AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM n)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR i = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""
