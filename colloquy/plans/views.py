"""The engine's tables as views over the given ones, for Spark and as common table expressions for SQL.

No given table holds policies, ledgers or runs, so conversations serve as messages, events as tool ledgers, orders as scored
runs and line items as checks.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSIONS = ["speech_protocol", "forbidden_behavior", "outcome", "tool_usage", "efficiency", "constraint", "emotion_handling"]
SEVERITIES = ["critical", "major", "medium", "minor"]
TOOLS = ["click", "view", "signup", "purchase"]


def _pick(values: list[str], index: str) -> str:
    """Element `index` (from 0) of a list, in SQL that both engines read."""
    return "CASE " + " ".join(f"WHEN {index} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


MESSAGES = """SELECT conv_id AS trace_id, turn, turn AS msg_idx, CASE role WHEN 'assistant' THEN 'agent' ELSE role END AS role, text AS content
    FROM conversations"""
EVENTS = """SELECT user_id AS trace_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id, ts, event_type AS raw_type, value AS amount, {k} AS k
    FROM events"""
LEDGER = f"""SELECT trace_id, seq, seq AS turn, event_id, ts, amount, k,
      CASE WHEN raw_type = 'error' THEN 'tool_failed' WHEN k % 11 = 0 THEN 'tool_rollback' ELSE 'tool_executed' END AS event_type,
      CASE WHEN raw_type = 'error' THEN {_pick(TOOLS, 'k % 4')} ELSE raw_type END AS tool_name,
      concat(CASE WHEN raw_type = 'error' THEN {_pick(TOOLS, 'k % 4')} ELSE raw_type END, '-', CAST(k % 20 AS {{text}})) AS call_id,
      CASE WHEN raw_type = 'error' THEN 'failed' END AS error, CASE WHEN k % 13 = 0 THEN 'guard' ELSE 'agent' END AS source,
      CASE WHEN k % 7 = 0 THEN CAST(NULL AS {{text}}) ELSE concat('MT', CAST(trace_id % 3 AS {{text}})) END AS order_id
    FROM ({EVENTS}) e"""
RUNS = f"""SELECT o_orderkey AS trace_id, o_orderpriority AS model, o_orderstatus AS scenario, {_pick(['easy', 'medium', 'hard', 'extreme'], 'o_custkey % 4')} AS difficulty,
      {_pick(['good', 'medium', 'flawed'], 'o_orderkey % 3')} AS condition, o_custkey % 5 = 0 AS has_guard, least(o_totalprice / 500000.0e0, 1.0e0) AS overall,
      (o_orderkey % 101) / 100.0e0 AS hard, CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE (o_custkey % 97) / 96.0e0 END AS soft, (o_orderkey % 89) / 88.0e0 AS step,
      CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE (o_custkey % 11) / 10.0e0 END AS branch, (o_orderkey % 13) / 12.0e0 AS temporal, (o_custkey % 17) / 16.0e0 AS path,
      o_custkey AS cust, o_orderdate AS started_at
    FROM orders"""
CHECKS = f"""SELECT l_orderkey AS trace_id, concat('c', CAST(l_linenumber AS {{text}})) AS check_id, l_linenumber AS line, {_pick(DIMENSIONS, 'l_linenumber - 1')} AS dimension,
      concat('D', CAST(l_linenumber % 6 + 1 AS {{text}})) AS soft_dimension, CASE l_returnflag WHEN 'R' THEN 'judge' ELSE 'rule' END AS check_type,
      l_discount * 10 AS score, l_discount * 10 >= 0.6 AS passed, {_pick(SEVERITIES, 'l_partkey % 4')} AS severity, l_partkey AS part, l_suppkey AS supp, l_linestatus AS status,
      CAST(l_quantity AS BIGINT) AS qty
    FROM lineitem"""
PAIRS = """SELECT l_orderkey AS trace_id, concat('i', CAST(l_linenumber AS {text})) AS item_id, least(CAST(floor(l_quantity / 10) AS BIGINT), 5) AS system_score,
      CAST((l_linenumber + l_partkey) % 6 AS BIGINT) AS label
    FROM lineitem"""
CALLS = """SELECT user_id AS trace_id, event_type AS purpose, concat('m', CAST(user_id % 5 AS {text}), CASE WHEN event_id % 3 = 0 THEN '-mini' ELSE '' END) AS model,
      CAST(floor(value * 100) AS BIGINT) AS input_tokens, {k} AS output_tokens
    FROM events"""
STEPS = """SELECT * FROM (VALUES
      ('p1', 'greet', 1, 'view', false, 1.0e0), ('p1', 'confirm', 2, 'click', false, 2.0e0), ('p1', 'inform', 3, 'signup', false, 1.0e0),
      ('p1', 'complete', 4, 'purchase', true, 1.5e0), ('p1', 'reschedule', 5, 'view', true, 0.5e0), ('p1', 'farewell', 6, 'click', false, 1.0e0)
    ) AS t(scenario_id, step_id, ord, action, is_optional, weight)"""
BRANCHES = """SELECT * FROM (VALUES ('p1', 'inform', 0, 'home', 'complete'), ('p1', 'inform', 1, 'away', 'reschedule')) AS t(scenario_id, step_id, branch_idx, cond, next_step)"""
MUST_CALL = """SELECT * FROM (VALUES ('p1', 0, 'click'), ('p1', 1, 'signup'), ('p1', 2, 'purchase')) AS t(scenario_id, pos, tool_name)"""
EXPECTED = """SELECT * FROM (VALUES ('p1', 0, 'greet'), ('p1', 1, 'confirm'), ('p1', 2, 'inform'), ('p1', 3, 'complete'), ('p1', 4, 'farewell')) AS t(scenario_id, pos, step_id)"""

#: A policy per customer: six steps whose order, tools, arguments, words and options differ from one to the next.
BASE_STEPS = [
    ("greet", 1, 1.0, "the,und", "que,der"), ("confirm", 2, 2.0, "tion,keit", "ver,und"), ("inform", 3, 1.0, "ing,en", "con,la"),
    ("complete", 4, 1.5, "er,st", "tion,de"), ("reschedule", 5, 0.5, "not,nicht", "pas,no"), ("farewell", 6, 1.0, "of,to", "le,el"),
]
BASE_BRANCHES = [("inform", 0, "home", "complete", 0), ("inform", 1, "away", "reschedule", 0), ("confirm", 2, "known", "inform", 1), ("confirm", 3, "unknown", "farewell", 1)]


def _rows(rows: list[tuple], names: str, spark: bool) -> str:
    """A join with literal rows, as each engine says it. For Spark it is a join too, not a generator: of that Spark takes the rows to be no larger than the
    table's file, and would send policies to the driver and to all tasks however many there are."""
    lines = ["(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}e0" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows]
    return f"CROSS JOIN (SELECT /*+ BROADCAST(few) */ * FROM VALUES {', '.join(lines)} AS few({names})) t" if spark else f"CROSS JOIN (VALUES {', '.join(lines)}) t({names})"


POLICIES = f"""SELECT c_custkey AS scenario_id, step_id, CAST(CASE c_custkey % 3 WHEN 0 THEN base WHEN 1 THEN CASE base WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 4 THEN 5 WHEN 5 THEN 4 ELSE base END
        ELSE CASE base WHEN 5 THEN 6 WHEN 6 THEN 5 ELSE base END END AS BIGINT) AS ord,
      {_pick(TOOLS, '(base + c_nationkey) % 4')} AS action, base IN (4, 5) OR (base + c_custkey) % 6 = 0 AS is_optional, weight,
      CASE WHEN base % 2 = 0 THEN CAST(c_custkey % 3 AS {{text}}) END AS level, CASE WHEN (base + c_custkey) % 2 = 0 THEN words ELSE other END AS words
    FROM customer {{six}}"""
PREDICATES = f"""SELECT scenario_id, step_id, ord, 0 AS pred, CASE WHEN step_id IN ('inform', 'farewell') THEN 'words' ELSE 'tool' END AS kind, action AS tool_name, level, words
    FROM ({POLICIES}) p
    UNION ALL SELECT scenario_id, step_id, ord, 1, 'words', CAST(NULL AS {{text}}), CAST(NULL AS {{text}}), 'men,ed' FROM ({POLICIES}) q WHERE step_id IN ('inform', 'farewell')"""
POLICY_BRANCHES = """SELECT c_custkey AS scenario_id, step_id, branch_idx, cond, next_step FROM customer {fork} WHERE even = 0 OR c_custkey % 2 = 0"""
POLICY_MUST = f"""SELECT c_custkey AS scenario_id, pos, {_pick(TOOLS, '(pos + c_nationkey) % 4')} AS tool_name FROM customer {{three}}"""
POLICY_EXPECTED = f"""SELECT scenario_id, row_number() OVER (PARTITION BY scenario_id ORDER BY ord) AS pos, step_id FROM ({POLICIES}) p WHERE NOT is_optional"""
#: Traces are dealt to the policies of all customers.
OWN = "trace_id % (SELECT greatest(count(*), 1) FROM customer) + 1"
#: Ledgers and messages with their trace's policy; calls have one argument, a number that is written in two ways.
TRACED = f"""SELECT *, CASE WHEN scenario_id % 4 = 0 THEN 'MT9' END AS own_order FROM (SELECT l.*, {OWN} AS scenario_id, concat(CAST(k % 3 AS {{text}}), CASE WHEN k % 2 = 0 THEN '' ELSE '.0' END) AS level_arg FROM ({LEDGER}) l) x"""
SAID = f"SELECT m.*, {OWN} AS scenario_id FROM ({MESSAGES}) m"

#: Edges of these policies, for SQL.
POLICY_EDGES = """lead_ AS (SELECT *, lead(step_id) OVER w AS nxt FROM policies WINDOW w AS (PARTITION BY scenario_id ORDER BY ord)),
    edges AS (SELECT scenario_id, step_id AS src, nxt AS dst FROM lead_ l WHERE nxt IS NOT NULL AND NOT (EXISTS (SELECT 1 FROM policy_branches b WHERE b.scenario_id = l.scenario_id AND b.step_id = l.step_id)
        AND EXISTS (SELECT 1 FROM policy_branches b WHERE b.scenario_id = l.scenario_id AND b.next_step = l.nxt))
      UNION ALL SELECT scenario_id, step_id, next_step FROM policy_branches)"""

TEXTS = {
    "messages": MESSAGES, "ledger": LEDGER, "runs": RUNS, "checks": CHECKS, "pairs": PAIRS, "llm_calls": CALLS,
    "steps": STEPS, "branches": BRANCHES, "must_call": MUST_CALL, "expected": EXPECTED, "policies": POLICIES, "predicates": PREDICATES, "policy_branches": POLICY_BRANCHES,
    "policy_must": POLICY_MUST, "policy_expected": POLICY_EXPECTED, "traced": TRACED, "said": SAID,
}
LITERALS = {"six": (BASE_STEPS, "step_id, base, weight, words, other"), "fork": (BASE_BRANCHES, "step_id, branch_idx, cond, next_step, even"), "three": ([(0,), (1,), (2,)], "pos")}
SPARK = {"text": "STRING", "k": "CAST(get_json_object(props, '$.k') AS BIGINT)"} | {k: _rows(*v, spark=True) for k, v in LITERALS.items()}
DUCK = {"text": "VARCHAR", "k": "CAST(json_extract_string(props, '$.k') AS BIGINT)"} | {k: _rows(*v, spark=False) for k, v in LITERALS.items()}


def duck(names: str, more: str = "") -> str:
    """`WITH` clause of these views, and further expressions, for SQL."""
    parts = [f"{n} AS ({TEXTS[n].format(**DUCK)})" for n in names.split()]
    return "WITH " + ",\n".join(parts + ([more] if more else [])) + "\n"


class Views:
    """The views over one folder of tables. Each is planned once, and nothing is read until a query asks for it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _view(self, name: str, **tables: str) -> DataFrame:
        text = TEXTS[name].format(**SPARK)
        frames = {}
        for given in tables.values():
            text = text.replace(f"FROM {given}", f"FROM {{{given}}}")
            frames[given] = self.table(given)
        return self.spark.sql(text, **frames)

    @cached_property
    def messages(self) -> DataFrame:
        return self._view("messages", t="conversations")

    @cached_property
    def ledger(self) -> DataFrame:
        return self._view("ledger", t="events")

    @cached_property
    def runs(self) -> DataFrame:
        return self._view("runs", t="orders")

    @cached_property
    def checks(self) -> DataFrame:
        return self._view("checks", t="lineitem")

    @cached_property
    def pairs(self) -> DataFrame:
        return self._view("pairs", t="lineitem")

    @cached_property
    def llm_calls(self) -> DataFrame:
        return self._view("llm_calls", t="events")

    @cached_property
    def steps(self) -> DataFrame:
        return self._view("steps")

    @cached_property
    def branches(self) -> DataFrame:
        return self._view("branches")

    @cached_property
    def must_call(self) -> DataFrame:
        return self._view("must_call")

    @cached_property
    def expected(self) -> DataFrame:
        return self._view("expected")

    @cached_property
    def agents(self) -> DataFrame:
        return self.messages.where("role = 'agent'")

    @cached_property
    def users(self) -> DataFrame:
        return self.messages.where("role = 'user'")

    @cached_property
    def policies(self) -> DataFrame:
        return self._view("policies", t="customer")

    @cached_property
    def predicates(self) -> DataFrame:
        """With arguments as a map and words as an array."""
        return self._view("predicates", t="customer").selectExpr("* except (level, words)", "if(level is null, map(), map('level', level)) AS args", "split(words, ',') AS words")

    @cached_property
    def policy_branches(self) -> DataFrame:
        return self._view("policy_branches", t="customer")

    @cached_property
    def policy_must(self) -> DataFrame:
        return self._view("policy_must", t="customer")

    @cached_property
    def policy_expected(self) -> DataFrame:
        return self._view("policy_expected", t="customer")

    @cached_property
    def traced(self) -> DataFrame:
        return self._view("traced", t="events", c="customer").withColumn("arguments", F.create_map(F.lit("level"), "level_arg"))

    @cached_property
    def said(self) -> DataFrame:
        return self._view("said", t="conversations", c="customer")

    def values(self, ddl: str, rows: list[tuple]) -> DataFrame:
        """A small literal table."""
        return self.spark.createDataFrame(rows, ddl)
