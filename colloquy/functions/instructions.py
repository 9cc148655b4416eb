"""Instruction documents to lines, and conversations to transcripts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What kinds of lines a Markdown instruction has.
LINE_KINDS = {"section": r"^#{1,6}\s", "step": r"^\s*\d+[.、)]\s", "branch": r"^\s*[-*]?\s*(如果|若|当|if|when)\b?", "bullet": r"^\s*[-*•]\s", "limit": r"\d+\s*(字|words|characters)"}


def parse_lines(docs: DataFrame, id_col: str, text_col: str, kinds: dict[str, str] = LINE_KINDS, short: int = 0) -> DataFrame:
    """id, pos (from 0), kind of each line that isn't blank: the first pattern that matches, else section for short lines, else step."""
    rows = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).where(F.trim("line") != "")
    kind = reduce(lambda c, kv: c.when(F.col("line").rlike(kv[1]), kv[0]), list(kinds.items())[1:], F.when(F.col("line").rlike(next(iter(kinds.values()))), next(iter(kinds))))
    return rows.select(id_col, F.col("pos").cast("long").alias("pos"), kind.when(F.length("line") <= short, "section").otherwise("step").alias("kind"))


#: Fixed values of instruction documents: headings, numbered steps, branches (condition and what follows), list items, and limits of the
#: length of an answer, the first kind that occurs counts.
HEADING, STEP, ITEM = r"^#{1,2}\s+(.+)", r"^(\d+)\.\s*(.+)", r"^[-*]\s+(.+)"
BRANCH = r"-\s*(?:若|如果)(.+?)→\s*(.+)"
LIMITS = [r"约\s*(\d+)\s*个?字", r"最多\s*\d+\s*[-~]\s*(\d+)\s*个?字", r"\d+\s*[-~]\s*(\d+)\s*个?字"]


def instruction_items(docs: DataFrame, id_col: str, text_col: str, *, heading: str = HEADING, step: str = STEP, item: str = ITEM, branch: str = BRANCH) -> DataFrame:
    """id, section, pos, step, kind, text, condition of the parts of instruction documents.

    Lines belong to the heading above them (its name in lower case without a colon at the end); what stands before the first one falls away. Kinds are step
    (numbered), branch (with its condition; it belongs to the step above it in its section) and item; other lines are no parts.
    """
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    found = lambda p, i: F.when(F.col("line").rlike(p), F.regexp_extract("line", p, i))
    above = Window.partitionBy(id_col).orderBy("pos")
    rows = lines.withColumns({"head": found(heading, 1), "number": found(step, 1).cast("long")}).withColumn("nth", F.count("head").over(above))
    own = Window.partitionBy(id_col, "nth").orderBy("pos")
    name = F.lower(F.regexp_replace(F.trim("head"), ":+$", ""))
    rows = rows.where("nth > 0").select(id_col, "pos", "line", "head", "number", F.first(name).over(own).alias("section"), F.last("number", ignorenulls=True).over(own).alias("step")).where("head is null")
    kind = F.when(F.col("number").isNotNull(), "step").when(F.col("line").rlike(branch), "branch").when(F.trim("line").rlike(item), "item")
    text = F.when(F.col("number").isNotNull(), F.regexp_extract("line", step, 2)).when(F.col("line").rlike(branch), F.regexp_extract("line", branch, 2)).otherwise(F.regexp_extract(F.trim("line"), item, 1))
    made = rows.select(id_col, "section", F.col("pos").cast("long").alias("pos"), "step", kind.alias("kind"), F.trim(text).alias("text"), F.trim(found(branch, 1)).alias("condition"))
    return made.where("kind is not null").withColumn("condition", F.when(F.col("kind") == "branch", F.col("condition")))


def length_limits(docs: DataFrame, id_col: str, text_col: str, patterns: list[str] = LIMITS) -> DataFrame:
    """id, limit on the length of an answer (0: none), by the first pattern that occurs in the text."""
    got = [F.when(F.col(text_col).rlike(p), F.regexp_extract(text_col, p, 1).cast("long")) for p in patterns]
    return docs.select(id_col, F.coalesce(*got, F.lit(0)).alias("limit"))


def _ordered(messages: DataFrame, value, sep: str = "") -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("msg_idx", value.alias("v"))))
    return messages.groupBy("trace_id").agg(F.array_join(F.transform(parts, lambda p: p["v"]), sep).alias("t"))


def dialogue_fingerprint(messages: DataFrame) -> DataFrame:
    """trace_id, fingerprint: SHA-256 over roles and contents in order."""
    line = F.concat("role", F.lit("\x1f"), "content", F.lit("\x1e"))
    return _ordered(messages, line).select("trace_id", F.sha2("t", 256).alias("fingerprint"))


def transcript_text(messages: DataFrame, per_message: int = 500, total: int = 30_000) -> DataFrame:
    """trace_id, transcript: one line per message, cut per message and in all."""
    line = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), "role", F.lit(": "), F.substring("content", 1, per_message))
    return _ordered(messages, line, "\n").select("trace_id", F.substring("t", 1, total).alias("transcript"))
