"""Hand-computed rows for operators that SQL can't express, and invariants."""

import itertools
import collections
import random

import pytest
from pyspark.sql import functions as F

from colloquy.functions import fuzzy
from colloquy.functions import text as T
from colloquy.operators import agreement, diagnosis, mutations, sampling, scoring, verify


def test_default_negation(spark):
    rows = [("无法退款", "negated"), ("无法退款，但可以补送", "ambiguous"), ("已为您退款", "clear")]
    df = spark.createDataFrame(rows, "t string, e string").select(T.negation_status(F.col("t")).alias("s"), "e")
    assert all(r.s == r.e for r in df.collect())


def test_even_negation_is_none(spark):
    df = spark.createDataFrame([("不会不退款", True), ("不退款", False), ("不是。退款", True)], "t string, e boolean")
    assert all(r.s == r.e for r in df.select(T.unnegated_keyword(F.col("t"), F.lit("退款")).alias("s"), "e").collect())


def test_emotion_and_normal_form(spark):
    df = spark.createDataFrame([("天气不错", False), ("我很生气", True)], "t string, e boolean")
    assert all(r.s == r.e for r in df.select(T.negative_emotion(F.col("t")).alias("s"), "e").collect())
    assert spark.createDataFrame([("ＡＢ​c",)], "t string").select(fuzzy.normalize_text(F.col("t"))).first()[0] == "abc"


def test_fuzzy_functions():
    assert fuzzy.alias_score("refund", "you get a refund now") == 1.0
    assert fuzzy.alias_score("ab", "ab") == 0.0
    assert fuzzy.quote_found("Hello World", "say helloworld!") and not fuzzy.quote_found("zzzzzz", "hello world")


def best_cost(e, o, optional):
    costs = {(len(e), len(o)): 0.0}
    for i, j in itertools.product(range(len(e), -1, -1), range(len(o), -1, -1)):
        ways = [costs[i, j]] if (i, j) in costs else []
        if i < len(e):
            ways.append(costs[i + 1, j] + (0.5 if e[i] in optional else 3.0))
        if j < len(o):
            ways.append(costs[i, j + 1] + 0.2)
        if i < len(e) and j < len(o):
            ways.append(costs[i + 1, j + 1] + (0.0 if e[i] == o[j] else 2.0))
        costs[i, j] = min(ways)
    return costs[0, 0]


def test_alignment_against_search():
    r = random.Random(1)
    for _ in range(200):
        e, o = ([r.choice("abcd") for _ in range(r.randrange(6))] for _ in range(2))
        assert verify.align(e, o, {"b"})[0] == pytest.approx(best_cost(e, o, {"b"}))
    assert verify.align(list("ABC"), list("AC")) == (3.0, ["match:A", "delete:B", "match:C"])


def test_alignment_modes(spark):
    rows = [(1, list("ABC"), list("AC"), [], []), (2, list("AB"), list("ABC"), [], []), (3, ["A"], [], [], []), (4, list("AB"), ["A"], ["B"], []), (5, list("AB"), list("AC"), [], ["A>C"])]
    df = spark.createDataFrame(rows, "trace_id long, expected array<string>, observed array<string>, optional array<string>, legal array<string>")
    costs = lambda made: {r.trace_id: round(r.cost, 6) for r in made.collect()}
    assert costs(verify.align_strict(df)) == {1: 5.0, 2: 0.2, 3: 3.0, 4: 0.5, 5: 2.0}
    assert costs(verify.align_unordered(df)) == {1: 3.0, 2: 0.2, 3: 3.0, 4: 0.5, 5: 3.2}
    assert costs(verify.align_ordered(df)) == {1: 3.0, 2: 0.2, 3: 3.0, 4: 0.5, 5: 1.0}


MATCH = "trace_id long, scenario_id long, step_id string, ord long, pred int, kind string, key string, event long, turn long"


def test_events_serve_one_step(spark):
    """A tool event counts once; a message once per set of words; half of several utterances are needed."""
    rows = [(1, 9, "a", 1, 0, "tool", None, 5, 5), (1, 9, "b", 2, 0, "tool", None, 5, 5), (1, 9, "c", 3, 0, "words", "x,y", 5, 4), (1, 9, "d", 4, 0, "words", "x,y", 5, 4), (1, 9, "e", 5, 0, "words", "z", 5, 4),
            (1, 9, "f", 6, 1, "words", "v", 8, 8), (2, 9, "b", 2, 0, "tool", None, 5, 5)]
    predicates = [(9, s, p, k) for s, p, k in (("a", 0, "tool"), ("b", 0, "tool"), ("c", 0, "words"), ("d", 0, "words"), ("e", 0, "words"), ("e", 1, "words"), ("f", 0, "words"), ("f", 1, "words"), ("f", 2, "words"))]
    got = verify.observed_steps(spark.createDataFrame(rows, MATCH), spark.createDataFrame(predicates, "scenario_id long, step_id string, pred int, kind string"))
    assert {(r.trace_id, r.step_id): (r.first_turn, r.evidence, r.confidence) for r in got.collect()} == {(1, "a"): (5, 1, 1.0), (1, "c"): (4, 1, 1.0), (1, "e"): (4, 1, 0.5), (2, "b"): (5, 1, 1.0)}


def test_two_policies_in_one_table(spark):
    """The same events mean different steps under different policies; orders, arguments and the guard decide what counts."""
    ledger = [(1, 7, 1, 1, "pay", {"n": "2.0"}, "agent", None), (2, 8, 1, 1, "pay", {"n": "2"}, "agent", None), (3, 7, 1, 1, "pay", {"n": "3"}, "agent", None), (3, 7, 2, 2, "pay", {"n": "2"}, "guard", None),
              (4, 7, 1, 1, "pay", {"n": "2"}, "agent", "other"), (4, 7, 2, 2, "pay", {"n": "2", "more": "x"}, "agent", "own")]
    df = spark.createDataFrame(ledger, "trace_id long, scenario_id long, seq long, turn long, tool_name string, arguments map<string,string>, source string, order_id string").selectExpr(
        "*", "'tool_executed' AS event_type", "cast(null as string) AS error", "if(trace_id = 4, 'own', null) AS own_order")
    predicates = spark.createDataFrame([(7, "charge", 1, 0, "tool", "pay", {"n": "2"}), (8, "settle", 1, 0, "tool", "pay", {})], "scenario_id long, step_id string, ord long, pred int, kind string, tool_name string, args map<string,string>")
    assert {(r.trace_id, r.step_id, r.event) for r in verify.match_tools(df, predicates).collect()} == {(1, "charge", 1), (2, "settle", 1), (4, "charge", 2)}


def test_equivalent_values(spark):
    rows = [("1", "1.0", True), ("true", "TRUE", True), ("true", "1", False), ("a", "a", True), ("a", "A", False), (None, None, False), ("1", None, False), ("1e2", "100", True), ("[1]", "[1]", True)]
    df = spark.createDataFrame(rows, "e string, a string, want boolean")
    assert all(r[0] == r[1] for r in df.select(verify.values_equivalent(F.col("e"), F.col("a")), "want").collect())
    calls = spark.sql("select 1L AS trace_id, 1L AS seq, 'pay' AS tool_name, parse_json('{\"n\": 2, \"ok\": true, \"s\": \"x\"}') AS v").withColumn("arguments", verify.variant_arguments(F.col("v")))
    want = spark.createDataFrame([("pay", {"n": "2.0", "ok": "True", "gone": "1"}), ("pay", {}), ("other", {})], "tool_name string, args map<string,string>")
    assert {(r.matched, round(r.confidence, 4)) for r in verify.tool_call_match(calls, want).collect()} == {(False, 0.6667), (True, 1.0)}


def test_semantic_predicates(spark):
    from colloquy.functions.semantic import Concept, SemanticPredicate, semantic_match

    p = SemanticPredicate(positive=["all done"], negative=["never mind"], concepts=[Concept(["refund"], 2.0), Concept(["tomorrow", "next day"], 1.0, required=False)], keywords=["parcel", "door", "ring"], ratio=0.6)
    rows = [("we are ALL DONE", True), ("all done but never mind", False), ("your refund comes the next day", True), ("your refund comes", False), ("we will not refund tomorrow", False), ("the parcel is at the door", True), ("the parcel", False), (None, False)]
    df = spark.createDataFrame(rows, "content string, want boolean")
    got = df.select(semantic_match(F.col("content"), p, prefix=[" not "], suffix=["##"], double=["##"], contrast=["##"]), "want").collect()
    assert [r[0] for r in got] == [w for _, w in rows]


def test_forbidden_behaviours_by_policy(spark):
    from colloquy.operators import joins

    said = spark.createDataFrame([(1, 7, "agent", 1, "a REFUND now", None), (2, 8, "agent", 1, "a refund now", None), (1, 7, "agent", 2, "fine", "get your money back"), (1, 7, "user", 3, "refund", None), (1, 7, "agent", 4, "leak refund", None)],
                                 "trace_id long, scenario_id long, role string, turn int, norm string, norm_raw string").withColumns({"norm": F.lower("norm")})
    behaviors = spark.createDataFrame([(7, "promise", "critical", ["cash", "refund"]), (8, "other", "minor", ["now"]), (7, "leak", "minor", ["leak"])], "scenario_id long, behavior_id string, severity string, keywords array<string>")
    got = joins.forbidden_hits(said, behaviors, {"refund": ["money back"]}).collect()
    assert {(r.trace_id, r.behavior_id, r.turn, r.severity, r.keyword) for r in got} == {(1, "promise", 1, "critical", "refund"), (2, "other", 1, "minor", "now"), (1, "promise", 2, "major", "money back"), (1, "leak", 4, "minor", "leak"), (1, "promise", 4, "critical", "refund")}


def test_instructions(spark):
    from colloquy.functions.instructions import instruction_items, length_limits

    text = "before\n# Call Flow:\n1. greet them\n   - 若 busy → call later\n- 如果 angry → say sorry\n2.inform\nplain\n## Constraints\n- at most 最多 10-30 个字\n* be kind\n- 若 x → y"
    df = spark.createDataFrame([(1, text), (2, "no heading\n1. step"), (3, None), (4, "约 20 字, 5-8字")], "id long, text string")
    got = sorted((r.section, r.pos, r.step, r.kind, r.text, r.condition) for r in instruction_items(df, "id", "text").where("section = 'call flow'").collect())
    assert got == [("call flow", 2, 1, "step", "greet them", None), ("call flow", 3, 1, "branch", "call later", "busy"), ("call flow", 4, 1, "branch", "say sorry", "angry"), ("call flow", 5, 2, "step", "inform", None)]
    assert [(r.kind, r.text, r.step) for r in instruction_items(df, "id", "text").where("section = 'constraints'").orderBy("pos").collect()] == [("item", "at most 最多 10-30 个字", None), ("item", "be kind", None), ("branch", "y", None)]
    assert instruction_items(df, "id", "text").select("id").distinct().count() == 1
    assert {r.id: r.limit for r in length_limits(df, "id", "text").collect()} == {1: 30, 2: 0, 3: 0, 4: 20}


def test_repair_needs_all_causes(spark):
    df = spark.createDataFrame([(7, 1, a, "unsatisfied", -1.0) for a in "abcd"], "scenario_id long, trace_id long, atom string, verdict string, delta double")
    causes = spark.createDataFrame([(7, "a", "b"), (7, "a", "c"), (7, "d", "c"), (8, "b", "d")], "scenario_id long, src string, dst string")
    got = {r.atom: r.recovers for r in diagnosis.counterfactual_repair(df, causes).collect()}
    assert got == {"a": 2, "b": 1, "c": 1, "d": 1}


def test_null_scores_change_weights(spark):
    df = spark.createDataFrame([(0.8, 0.5, None, 1.0, 1.0), (0.8, 0.5, 1.0, 1.0, 1.0)], "h double, s double, b double, t double, p double")
    got = [r[0] for r in df.select(scoring.objective_score(*(F.col(c) for c in "hsbtp"))).collect()]
    assert got == pytest.approx([0.56 * 0.88 / 0.74, 0.70])
    assert scoring.soft_score(spark.createDataFrame([(1, "D1", None)], "trace_id long, soft_dimension string, score double")).first().soft is None


def test_sampling(spark, small):
    from colloquy.plans.views import Views

    v = Views(spark, small)
    runs = v.runs.withColumns({"active": F.expr("cust % 4 = 1"), "scenario": F.concat("scenario", (F.col("cust") % 9).cast("string")), "model": F.concat("model", (F.col("cust") % 2).cast("string"))})
    rows = sampling.stratified_sample(runs, 20, 3).join(runs, "trace_id").collect()
    assert len(rows) == 20 and len({r.blind_id for r in rows}) == 20
    for key, most in (("scenario", 3), ("model", 6)):
        assert max(collections.Counter(r[key] for r in rows).values()) <= most
    bound = {"severe": 0.0, "weak": 0.4, "borderline": 0.6, "pass": 0.8}
    assert all(r.overall >= bound[r.stratum] for r in rows) and {r.stratum for r in rows} == set(bound) and sum(r.active for r in rows) > 10
    n = v.runs.count()
    assert sorted(r.blind_id for r in sampling.blind_ids(v.runs, 1).collect()) == list(range(1, n + 1))
    traps = sampling.insert_traps(v.pairs.withColumn("row_id", F.xxhash64("trace_id", "item_id", "system_score", "label")), 8, 1).where("trap").collect()
    assert len(traps) == 8 and all(r.shown_score == r.system_score + (-3 if r.system_score >= 3 else 3) for r in traps)


def test_bootstrap_covers_the_mean(spark):
    df = spark.range(2000).select(F.col("id").alias("row_id"), (F.col("id") % 10).cast("double").alias("d"), (F.col("id") % 10 + F.col("id") % 3).alias("e"))
    r = agreement.bootstrap_ci(df, lambda w: F.sum(F.col("d") * w) / F.sum(w), n=60).first()
    assert r.low < 4.5 < r.high and r.high - r.low < 0.5
    exact = agreement.human_agreement(df.select(F.col("d").alias("system_score"), F.col("e").alias("label"))).first().spearman
    r = agreement.bootstrap_spearman(df, "d", "e", n=60).first()
    assert r.low < exact < r.high and r.high - r.low < 0.05


def test_ranks_of_many_values(spark):
    import pandas as pd

    r = random.Random(3)
    values = [r.choice([r.random(), r.gauss(0, 100), 5.0, float(r.randrange(4))]) for _ in range(3000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double")
    want = pd.Series(values).rank(method="average").tolist()
    for ranges in (1, 1024):
        assert [x.r for x in agreement.average_ranks(df, "v", "r", ranges=ranges).orderBy("id").collect()] == pytest.approx(want)


def test_entity_swap_permutes(spark):
    df = spark.range(50).select("id", F.concat(F.lit("n"), "id").alias("name"))
    rows = mutations.entity_swap(df, ["name"]).collect()
    assert {r.name for r in rows} == {f"n{i}" for i in range(50)} and sum(r.name != f"n{r.id}" for r in rows) == 50


def test_large_tables_are_never_crossed(spark, small):
    from colloquy import plans

    for name in ("c4_forbidden_hits", "h12_required_tools", "f8_temporal_violations", "b11_feasible_slots"):
        plan = plans.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert "CartesianProduct" not in plan
