"""Sources and sinks: trace and scenario documents, JSON lines, rating sheets, locked predictions, event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Schema of a trace document; every field may be missing. `arguments`, `result` and `metadata` keep their open shape.
TRACE = """id STRING,
  scenario STRUCT<id:STRING, name:STRING, domain:STRING, difficulty:STRING, description:STRING, max_turns:INT>,
  conversation STRUCT<scenario_id:STRING, started_at:TIMESTAMP, ended_at:TIMESTAMP, termination_reason:STRING,
    messages:ARRAY<STRUCT<turn:INT, role:STRING, content:STRING, timestamp:TIMESTAMP, metadata:VARIANT,
      tool_calls:ARRAY<STRUCT<id:STRING, tool_name:STRING, arguments:VARIANT, result:VARIANT, error:STRING, latency_ms:INT, fault_injected:BOOLEAN, source:STRING>>>>>,
  score_report STRUCT<hard_score:DOUBLE, soft_score:DOUBLE, overall_score:DOUBLE, official:BOOLEAN, conversation_length:INT, failure_summary:ARRAY<STRING>,
    run_validity:STRUCT<status:STRING, reason:STRING>, task_outcome:STRUCT<status:STRING>,
    checks:ARRAY<STRUCT<check_id:STRING, check_type:STRING, dimension:STRING, passed:BOOLEAN, score:DOUBLE, evidence_turn:INT, explanation:STRING>>>,
  run_metadata STRUCT<model_backend:STRING, agent_type:STRING, timestamp:STRING, duration_seconds:DOUBLE>,
  metadata VARIANT"""


def read_traces(spark: SparkSession, path: str, *, multiline: bool = True, schema: str = TRACE) -> DataFrame:
    """Trace documents with an id and a score report; files whose names start with _ and unparseable ones are left out."""
    docs = spark.read.schema(schema).option("multiLine", multiline).option("mode", "PERMISSIVE").option("pathGlobFilter", "[!_]*").json(path)
    return docs.where("id is not null and score_report is not null")


def read_scenarios(spark: SparkSession, paths: list[str], schema: str, *, multiline: bool = True) -> DataFrame:
    """Scenario documents; of equal ids the first path's counts, and there the first file's."""
    docs = [spark.read.schema(schema).option("multiLine", multiline).json(p).select("*", F.lit(i).alias("_path"), F.input_file_name().alias("_file")) for i, p in enumerate(paths)]
    rows = docs[0]
    for d in docs[1:]:
        rows = rows.unionByName(d)
    first = F.row_number().over(Window.partitionBy("id").orderBy("_path", "_file"))
    return rows.where("id is not null").withColumn("_r", first).where("_r = 1").drop("_path", "_file", "_r")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_rating_sheet(spark: SparkSession, path: str, mapping: DataFrame, numbers: list[str]) -> DataFrame:
    """Rows of a rating sheet (CSV with a header, a byte-order mark or not) with a rater and a known blind_id; digits become ints."""
    sheet = spark.read.csv(path, header=True, encoding="UTF-8")
    sheet = sheet.select(*(F.col(f"`{c}`").alias(c.lstrip("﻿")) for c in sheet.columns))
    casts = {n: F.expr(f"try_cast(trim(`{n}`) as int)") for n in numbers}
    return sheet.where("trim(coalesce(rater, '')) <> ''").withColumns(casts).join(mapping, "blind_id")


def headers(traces: DataFrame) -> DataFrame:
    return traces.select(F.col("id").alias("trace_id"), F.col("scenario.id").alias("scenario_id"), F.col("run_metadata.model_backend").alias("model"), F.col("run_metadata.agent_type").alias("agent_type"),
                         "conversation.started_at", "conversation.ended_at", F.col("run_metadata.duration_seconds").alias("duration_s"), "conversation.termination_reason")


def _role(c: Column) -> Column:
    return F.when(c == "assistant", "agent").otherwise(c)


def messages(traces: DataFrame) -> DataFrame:
    """One row per message, numbered from 0."""
    rows = traces.select(F.col("id").alias("trace_id"), F.posexplode("conversation.messages").alias("msg_idx", "m"))
    return rows.select("trace_id", "msg_idx", "m.turn", _role(F.col("m.role")).alias("role"), "m.content", F.col("m.timestamp").alias("ts"), "m.metadata")


def tool_calls(traces: DataFrame) -> DataFrame:
    """One row per tool call inside messages."""
    rows = traces.select(F.col("id").alias("trace_id"), F.posexplode("conversation.messages").alias("msg_idx", "m"))
    rows = rows.select("trace_id", "msg_idx", "m.turn", F.posexplode("m.tool_calls").alias("call_idx", "c"))
    return rows.select("trace_id", "msg_idx", "turn", "call_idx", F.col("c.id").alias("call_id"), "c.tool_name", "c.arguments", "c.result", "c.error", "c.latency_ms", "c.fault_injected", "c.source")


def ledger(traces: DataFrame) -> DataFrame:
    """One row per ledger event in the metadata; older documents have none."""
    kind = "array<struct<seq:bigint,event_type:string,turn:int,tool_name:string,tool_call_id:string,error:string,source:string,prev_hash:string>>"
    rows = traces.select(F.col("id").alias("trace_id"), F.explode(F.expr(f"try_variant_get(metadata, '$.ledger_events', '{kind}')")).alias("e"))
    return rows.select("trace_id", "e.*")


def write_locked(df: DataFrame, path: str, key: str, force: bool = False) -> str:
    """Write predictions once; an existing path is an error unless forced. Returns their fingerprint."""
    df.write.mode("overwrite" if force else "errorifexists").json(path)
    return fingerprint(df, key).first()["fingerprint"]


def fingerprint(df: DataFrame, key: str) -> DataFrame:
    """fingerprint of the rows, whatever their order: rows are hashed, and a tree of hashes is built over the leading digits of these, so
    that each node joins the hashes of a small part of the rows."""
    h = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("h")).withColumn("p", F.substring("h", 1, 6))
    for digits in (4, 2, 0):
        own = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), "")
        h = h.withColumn("q", F.substring("p", 1, digits)).groupBy(F.col("q").alias("p")).agg(F.sha2(own, 256).alias("h"))
    return h.select(F.col("h").alias("fingerprint"))


def rescore_in_place(traces: DataFrame, scores: DataFrame) -> DataFrame:
    """Traces whose report's scores are replaced (trace_id, hard, soft, overall); all other fields stay."""
    s = scores.select(F.col("trace_id").alias("id"), *(F.col(c).alias(f"_{c}") for c in ("hard", "soft", "overall")))
    rows = traces.join(s, "id", "left")
    report = F.col("score_report")
    for field in ("hard", "soft", "overall"):
        report = report.withField(f"{field}_score", F.coalesce(F.col(f"_{field}"), F.col(f"score_report.{field}_score")))
    return rows.withColumn("score_report", report).select(traces.columns)


def merge_rater_sheets(sheets: list[DataFrame]) -> DataFrame:
    """One sheet of all raters' rows, in order of blind_id and rater; a missing column is null."""
    rows = sheets[0]
    for s in sheets[1:]:
        rows = rows.unionByName(s, allowMissingColumns=True)
    return rows.orderBy("blind_id", "rater")


def read_event_stream(spark: SparkSession, path: str, schema, *, kind: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Messages or ledger events as a stream of files."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).format(kind).load(path)
