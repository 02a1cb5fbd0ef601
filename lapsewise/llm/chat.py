"""Chat formatting with DataFrame functions only: turns are sorted, adjacent turns of one role merged, marked and joined.

Template: a user run is "[INST] text [/INST]", an assistant run "<s>text</s>", a system run "<<SYS>>text<</SYS>>", a run
of any other role "<|role|>role<|text|>text<|end|>"; turns merged into a run are parted by "<|turn|>". Inside texts and
roles a backslash is doubled and every one of these marks gets a backslash after its first character, so that no mark
is left in a text, and taking the backslashes away again restores it.

The loss mask is a list of spans of the formatted text (code points, end exclusive), one for each assistant turn.

Nulls: a null text is empty, a null role is the role "", a null conv_id is left out; a null turn comes first. Turns
with one number are ordered by role, then text; repeated rows are repeated turns. Extra columns are ignored, empty
tables give empty results. A conversation is one output row, so its turns meet in one task; their number is its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.llm.shared import read_table, running_sums

#: role: opening and closing mark
RUNS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("<|role|>", "<|text|>", "<|end|>")
TURN = "<|turn|>"
#: Marks as they may not appear inside texts, as a pattern: first character, rest.
MARKS = r"(\[)(/?INST\])|(<)(/?s>|</?SYS>>|\|(?:role|text|end|turn)\|>)"
CLOSERS = r"(?<= \[/INST\]|</s>|<</SYS>>|<\|end\|>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), MARKS, "$1$3\\\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans of each conversation in turns (conv_id, turn, role, text)."""
    clean = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chats = turns.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(clean)).alias("turns"))
    n = F.size("turns")
    fresh = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    chats = chats.select("conv_id", "turns", fresh.alias("fresh"))

    def run(first: Column, k: Column) -> Column:
        after = F.coalesce(F.get("fresh", k + 1), n)
        texts = F.transform(F.slice("turns", first + 1, after - first), lambda t: escape(t["text"]))
        role = F.get("turns", first)["role"]
        opening = F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1]))
        closing = F.lit(OTHER[2])
        for name, (a, b) in RUNS.items():
            opening, closing = F.when(role == name, F.lit(a)).otherwise(opening), F.when(role == name, F.lit(b)).otherwise(closing)
        return F.struct(role.alias("role"), opening.alias("opening"), closing.alias("closing"), texts.alias("texts"))

    chats = chats.select("conv_id", F.transform("fresh", run).alias("runs"))
    block = lambda r: F.concat(r["opening"], F.array_join(r["texts"], TURN), r["closing"])
    # where runs end, and inside an assistant run where its turns end
    ends = running_sums(F.transform("runs", lambda r: F.length(block(r)).cast("long")))

    def masked(end: Column, i: Column) -> Column:
        own = F.get("runs", i)
        begin = end - F.length(block(own)) + F.length(own["opening"])
        past = running_sums(F.transform(own["texts"], lambda t: (F.length(t) + len(TURN)).cast("long")))
        turns = F.transform(past, lambda x, k: F.struct((begin + x - len(TURN) - F.length(F.get(own["texts"], k))).alias("start"), (begin + x - len(TURN)).alias("stop")))
        return F.when(own["role"] == "assistant", turns).otherwise(F.array().cast("array<struct<start:long,stop:long>>"))

    spans = F.flatten(F.transform(ends, masked))
    return chats.select("conv_id", F.array_join(F.transform("runs", block), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """role and text of every turn of a formatted conversation."""

    def body(block: Column, opening: int | Column, closing: str) -> Column:
        return F.substring(block, F.lit(1) + opening, F.length(block) - opening - len(closing))

    def turns(block: Column) -> Column:
        head = F.split(block, r"<\|text\|>", 2)
        role, text = unescape(F.substring(F.get(head, F.lit(0)), len(OTHER[0]) + 1, 2**30)), body(F.get(head, F.lit(1)), 0, OTHER[2])
        for name, (a, b) in RUNS.items():
            here = F.startswith(block, F.lit(a))
            role, text = F.when(here, F.lit(name)).otherwise(role), F.when(here, body(block, len(a), b)).otherwise(text)
        return F.transform(F.split(text, r"<\|turn\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(F.array_remove(F.split(formatted, CLOSERS, -1), ""), turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    out = format_chats(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    out = out.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


#: formatted_chars counts the marks and the escapes that the template adds.
SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
esc AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
         + len(regexp_extract_all(text, '\[/?INST\]|<(?:/?s>|</?SYS>>|\|(?:role|text|end|turn)\|>)'))
         + CASE WHEN lag(role) OVER w = role THEN 8 WHEN role = 'user' THEN 15 WHEN role = 'assistant' THEN 7
                WHEN role = 'system' THEN 15 ELSE 23 + length(role) END AS chars
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM esc GROUP BY conv_id
"""
