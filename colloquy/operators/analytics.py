"""Summaries of many runs: one flat table of runs (trace and headline metrics), grouped in as few passes as it takes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.operators.ranges import before, in_ranges
from colloquy.operators.scoring import OBJECTIVE_WEIGHTS

BINS = [0.2, 0.4, 0.6, 0.8]
COVERAGE_WEIGHTS = {"step": 0.35, "branch": 0.25, "constraint": 0.20, "fault": 0.20}
#: USD per million input and output tokens of unknown models.
DEFAULT_PRICE = (1.0, 3.0)


def stat_block(runs: DataFrame, value: str, *by: str) -> DataFrame:
    """mean, min, max, exact median and count of a value in each group."""
    v = F.col(value)
    return runs.groupBy(*by).agg(F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.median(v).alias("median"), F.count(v).alias("n"))


def summary_sections(runs: DataFrame) -> DataFrame:
    """section, key, mean, n: overall, by model, difficulty, scenario and guard, in one pass of grouping sets."""
    keys = ["model", "difficulty", "scenario", "has_guard"]
    out = runs.groupingSets([[], *([k] for k in keys)], *keys).agg(F.avg("overall").alias("mean"), F.count("overall").alias("n"), F.grouping_id(*keys).alias("g"))
    ids = {2 ** (len(keys) - 1 - i): k for i, k in enumerate(keys)}
    all_ = 2 ** len(keys) - 1
    section = reduce(lambda c, x: c.when(F.col("g") == all_ - x[0], x[1]), ids.items(), F.when(F.col("g") == all_, "overall"))
    key = F.coalesce(*(F.when(F.col("g") == all_ - i, F.col(k).cast("string")) for i, k in ids.items()))
    return out.select(section.alias("section"), key.alias("key"), "mean", "n")


def score_histogram(runs: DataFrame, bins: list[float] = BINS) -> DataFrame:
    """bin (from 0), n."""
    b = reduce(lambda c, x: c.when(F.col("overall") < x[1], x[0]), enumerate(bins), F.when(F.col("overall").isNull(), None)).otherwise(len(bins))
    return runs.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def top_k(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent keys with their counts; ties by key."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def guard_delta(runs: DataFrame) -> DataFrame:
    """on, off, delta: mean scores with and without the guard."""
    on, off = F.avg(F.when(F.col("has_guard"), F.col("overall"))), F.avg(F.when(~F.col("has_guard"), F.col("overall")))
    return runs.agg(on.alias("on"), off.alias("off"), (on - off).alias("delta"))


def compliance_section(runs: DataFrame, steps: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """The stat block of step compliance over all runs, and the k steps (step_id, n) that were skipped, missed or not reached most often."""
    return stat_block(runs, "step"), top_k(steps.where("status in ('skipped', 'missed', 'not_reached')"), "step_id", k)


def failure_section(diagnoses: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """The k most frequent failure modes (mode, n) and the number of runs of each severity, from diagnoses (modes: an array, severity)."""
    modes = top_k(diagnoses.select(F.explode("modes").alias("mode")), "mode", k)
    return modes, diagnoses.where("severity is not null").groupBy("severity").agg(F.count("*").alias("n"))


def safety_section(runs: DataFrame) -> DataFrame:
    """violations, traces (with any), blocks: totals of runs (violations, blocks; null counts as none)."""
    v = F.coalesce("violations", F.lit(0))
    return runs.agg(F.sum(v).alias("violations"), F.count_if(v > 0).alias("traces"), F.sum(F.coalesce("blocks", F.lit(0))).alias("blocks"))


def recommendations(runs: DataFrame) -> DataFrame:
    """scenario, advice: what the thresholds on a scenario's means say."""
    g = runs.groupBy("scenario").agg(F.avg("overall").alias("o"), F.avg("step").alias("s"), F.avg("branch").alias("b"))
    advice = F.array_compact(F.array(F.when(F.col("o") < 0.55, "raise_overall"), F.when(F.col("s") < 0.505, "follow_steps"), F.when(F.col("b") < 0.505, "check_branches")))
    return g.select("scenario", F.array_join(advice, ",").alias("advice"))


def model_matrix(runs: DataFrame, scenarios: list[str]) -> DataFrame:
    """Mean score of each model (prefix H with the guard) in each scenario."""
    label = F.concat(F.when(F.col("has_guard"), "H+").otherwise(""), "model")
    return runs.groupBy(label.alias("label")).pivot("scenario", scenarios).agg(F.avg("overall"))


#: Tokens of a turn and price per 1000 tokens where no calls were counted: fixed values.
TOKENS_PER_TURN, FALLBACK_PRICE = 800, 0.01


def overview(checks: DataFrame) -> DataFrame:
    """Share of rule checks, mean score and passed share over all checks."""
    return checks.agg(F.avg((F.col("check_type") == "rule").cast("double")).alias("rule_share"), F.avg("score").alias("mean"), F.avg(F.col("passed").cast("double")).alias("passed"))


def estimated_cost(runs: DataFrame, counted: DataFrame, prices: DataFrame) -> DataFrame:
    """cost, counted (runs with counted calls), runs: what all runs cost.

    A run has the cost of its counted calls (trace_id, calls, cost) if there are any; otherwise its turns at so many tokens each, at its
    model's price per 1000 tokens (model, per_1k) or the default.
    """
    rows = runs.join(counted.where("calls > 0").select("trace_id", "cost"), "trace_id", "left").join(prices, "model", "left")
    guess = F.col("turns") * TOKENS_PER_TURN / 1000 * F.coalesce("per_1k", F.lit(FALLBACK_PRICE))
    return rows.agg(F.sum(F.coalesce("cost", guess)).alias("cost"), F.count("cost").alias("counted"), F.count("*").alias("runs"))


def pass_k(runs: DataFrame, threshold: float = 0.6, k: int = 4, least: int = 1) -> DataFrame:
    """scenario, model, k, value: (share of passing runs) to the power k, of groups with `least` runs."""
    g = runs.groupBy("scenario", "model").agg(F.avg((F.col("overall") >= threshold).cast("double")).alias("p"), F.count("*").alias("n")).where(F.col("n") >= least)
    return g.select("scenario", "model", "p", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("k")).select("scenario", "model", "k", F.pow("p", "k").alias("value"))


def ablation(runs: DataFrame, weights: dict[str, float] = OBJECTIVE_WEIGHTS) -> DataFrame:
    """config, mean, delta to the full one: the objective with each component in turn left out and the rest scaled up."""
    full = sum(weights.values())
    parts = {k: F.coalesce(F.col(k), F.lit(0.0)) * w for k, w in weights.items()}
    configs = {"full": set(), **{f"no_{k}": {k} for k in weights}}
    scores = [F.avg(sum((c for k, c in parts.items() if k not in out), F.lit(0.0)) * (full / sum(w for k, w in weights.items() if k not in out))).alias(name) for name, out in configs.items()]
    wide = runs.agg(*scores)
    long = wide.select(F.explode(F.array(*(F.struct(F.lit(n).alias("config"), F.col(n).alias("mean"), (F.col(n) - F.col("full")).alias("delta")) for n in configs))).alias("r"))
    return long.select("r.*")


#: Arms of the guard experiment, by columns has_guard and adaptive.
ARM = "case when adaptive then 'adaptive' when has_guard then 'guard' else 'bare' end"


def guard_matrix(runs: DataFrame, *by: str) -> DataFrame:
    """model (or `by`), bare, guard, adaptive (means of the arms), delta (guard - bare), rescue (delta in percent of bare)."""
    arm = lambda name: F.avg(F.when(F.expr(ARM) == name, F.col("overall")))
    g = runs.groupBy(*(by or ("model",))).agg(*(arm(a).alias(a) for a in ("bare", "guard", "adaptive")))
    delta = F.col("guard") - F.col("bare")
    return g.withColumns({"delta": delta, "rescue": F.when(F.col("bare") > 0, delta / F.col("bare") * 100)})


def guard_error_rates(runs: DataFrame, least_compliance: float = 0.8) -> DataFrame:
    """kind, bare, guard: errors per run without and with the guard, of runs (has_guard, opening_ok, closing_ok, violations, step)."""
    kinds = {"opening_wrong": (~F.coalesce("opening_ok", F.lit(False))).cast("double"), "closing_wrong": (~F.coalesce("closing_ok", F.lit(False))).cast("double"), "forbidden_word": F.coalesce("violations", F.lit(0)).cast("double"),
             "step_incomplete": (F.coalesce("step", F.lit(0.0)) < least_compliance).cast("double")}
    rows = runs.select("has_guard", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), e.alias("n")) for k, e in kinds.items()))).alias("e"))
    return rows.groupBy("e.kind").agg(F.coalesce(F.avg(F.when(~F.col("has_guard"), F.col("e.n"))), F.lit(0.0)).alias("bare"), F.coalesce(F.avg(F.when(F.col("has_guard"), F.col("e.n"))), F.lit(0.0)).alias("guard"))


def repeat_stats(runs: DataFrame) -> DataFrame:
    """scenario (null: all), mean, sample deviation, min, max, n."""
    v = F.col("overall")
    return runs.rollup("scenario").agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("stdev"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"))


def last_by_condition(runs: DataFrame, *by: str) -> DataFrame:
    """The score of each condition's last run (latest start, then largest id) in each group: columns good, medium, flawed."""
    last = runs.groupBy(*by, "condition").agg(F.max_by("overall", F.struct("started_at", "trace_id")).alias("o"))
    return last.groupBy(*by).pivot("condition", ["good", "medium", "flawed"]).agg(F.first("o"))


def discrimination(runs: DataFrame, *by: str) -> DataFrame:
    """n, and the shares of groups with good >= medium, medium >= flawed, good >= flawed."""
    w = last_by_condition(runs, *by)
    share = lambda a, b: F.avg((F.col(a) >= F.col(b)).cast("double"))
    return w.agg(F.count("*").alias("n"), share("good", "medium").alias("good_medium"), share("medium", "flawed").alias("medium_flawed"), share("good", "flawed").alias("good_flawed"))


def anti_cheat(runs: DataFrame, *by: str) -> DataFrame:
    """Groups in which the flawed run scores above the medium one."""
    return last_by_condition(runs, *by).where("flawed > medium").select(*by, "medium", "flawed")


def flaw_recall(messages: DataFrame, flaws: DataFrame) -> DataFrame:
    """flaw, n, caught: messages of runs with a seeded flaw that its pattern finds."""
    hit = messages.join(flaws, F.col("flaw") == F.col("seeded"))
    return hit.groupBy("flaw").agg(F.count("*").alias("n"), F.sum(F.expr("content rlike pattern").cast("int")).alias("caught"))


def _squares(table: DataFrame) -> DataFrame:
    """Sums of squares of a complete table (subject, rater, x): between subjects, between raters, in all; and both sizes."""
    subject, rater, all_ = Window.partitionBy("subject"), Window.partitionBy("rater"), Window.partitionBy(F.lit(1))
    s = table.groupBy("subject").agg(F.sum("x").alias("s"), F.count("*").alias("k")).agg(F.sum(F.col("s") * F.col("s") / F.col("k")).alias("ss"), F.count("*").alias("n"))
    r = table.groupBy("rater").agg(F.sum("x").alias("s"), F.count("*").alias("m")).agg(F.sum(F.col("s") * F.col("s") / F.col("m")).alias("rr"), F.count("*").alias("k"))
    t = table.agg(F.sum("x").alias("t"), F.sum(F.col("x") * F.col("x")).alias("tt"))
    both = s.join(r).join(t)
    base = F.col("t") * F.col("t") / (F.col("n") * F.col("k"))
    return both.select("n", "k", (F.col("ss") - base).alias("rows"), (F.col("rr") - base).alias("cols"), (F.col("tt") - base).alias("total"))


def _mean_squares(table: DataFrame) -> tuple[DataFrame, Column, Column, Column]:
    q = _squares(table)
    n, k = F.col("n"), F.col("k")
    return q, F.col("rows") / (n - 1), F.col("cols") / (k - 1), (F.col("total") - F.col("rows") - F.col("cols")) / ((n - 1) * (k - 1))


def icc3(table: DataFrame) -> DataFrame:
    """icc: two-way consistency of single ratings; subjects x raters must be complete. Three small rows are joined, never the table."""
    q, rows, _, rest = _mean_squares(table)
    return q.select(((rows - rest) / (rows + (F.col("k") - 1) * rest)).alias("icc"))


def icc2(table: DataFrame) -> DataFrame:
    """icc: two-way random agreement of single ratings."""
    q, rows, cols, rest = _mean_squares(table)
    return q.select(((rows - rest) / (rows + (F.col("k") - 1) * rest + F.col("k") * (cols - rest) / F.col("n"))).alias("icc"))


def balanced(runs: DataFrame, subject: str, least: int = 3) -> DataFrame:
    """subject, rater (run number), x: groups of `least` runs or more, cut to the shortest; runs in order of start.

    Runs are numbered in ranges of (subject, start), so no task holds a whole group, however few groups there are."""
    sizes = runs.groupBy(subject).agg(F.count("*").alias("size")).where(F.col("size") >= least)
    short = sizes.agg(F.min("size").alias("short"))
    placed = in_ranges(runs.select(subject, "started_at", "trace_id", "overall"), subject, "started_at", "trace_id")
    parts = placed.groupBy(subject, "_part").agg(F.count("*").alias("_n"))
    own = F.row_number().over(Window.partitionBy("_part", subject).orderBy("started_at", "trace_id"))
    rows = placed.withColumn("_own", own).join(before(parts, "_n", subject), [subject, "_part"]).withColumn("rater", F.col("_before") + F.col("_own"))
    rows = rows.join(sizes.select(subject), subject).join(F.broadcast(short)).where("rater <= short")
    return rows.select(F.col(subject).alias("subject"), "rater", F.col("overall").alias("x"))


def variation(runs: DataFrame, subject: str) -> DataFrame:
    """cv: the mean over groups of deviation over mean, in percent."""
    g = runs.groupBy(subject).agg((F.stddev_samp("overall") / F.avg("overall") * 100).alias("cv"))
    return g.agg(F.avg("cv").alias("cv"))


def field_shares(runs: DataFrame, fields: list[str]) -> DataFrame:
    """Share of runs in which each field is there."""
    return runs.agg(*(F.avg(F.col(f).isNotNull().cast("double")).alias(f) for f in fields))


def naive_baseline(messages: DataFrame, forbidden: list[str], polite: list[str]) -> DataFrame:
    """trace_id, baseline (0 to 100): 50, less 15 for each forbidden word (then 40 at most), 3 more for each polite word, less for very
    few or very many agent messages."""
    text = F.lower("content")
    count = lambda words: reduce(lambda a, w: a + F.when(text.contains(w), 1).otherwise(0), words, F.lit(0))
    g = messages.where("role = 'agent'").groupBy("trace_id").agg(F.sum(count(forbidden)).alias("bad"), F.sum(count(polite)).alias("good"), F.count("*").alias("n"))
    raw = 50 - 15 * F.col("bad") + 3 * F.col("good") - F.when(F.col("n") < 2, 10).when(F.col("n") > 20, 5).otherwise(0)
    capped = F.when(F.col("bad") > 0, F.least(raw, F.lit(40))).otherwise(raw)
    return g.select("trace_id", F.greatest(F.lit(0), F.least(F.lit(100), capped)).cast("int").alias("baseline"))


def coverage(step: Column, branch: Column, constraint: Column, fault: Column, weights: dict[str, float] = COVERAGE_WEIGHTS) -> Column:
    """Weighted coverage; each part is a share, the constraints' capped at 1."""
    return weights["step"] * step + weights["branch"] * branch + weights["constraint"] * F.least(constraint, F.lit(1.0)) + weights["fault"] * fault


def price_calls(calls: DataFrame, pricing: DataFrame, default: tuple[float, float] = DEFAULT_PRICE) -> DataFrame:
    """calls with usd: prices of the exact model, else of the first declared prefix, else the default.

    `pricing` (model, ordinal, usd_in, usd_out) is a small fixed table. Prices are looked up once per model, not per call.
    """
    models = calls.select("model").distinct().withColumnRenamed("model", "used")
    fit = models.join(pricing, F.expr("startswith(used, model)"), "left")
    best = fit.groupBy("used").agg(F.min_by(F.struct("usd_in", "usd_out"), F.struct((F.col("model") != F.col("used")).cast("int").alias("prefix"), "ordinal")).alias("p"))
    prices = best.select(F.col("used").alias("model"), F.coalesce("p.usd_in", F.lit(default[0])).alias("usd_in"), F.coalesce("p.usd_out", F.lit(default[1])).alias("usd_out"))
    usd = (F.col("input_tokens") * F.col("usd_in") + F.col("output_tokens") * F.col("usd_out")) / 1e6
    return calls.join(prices, "model", "left").withColumn("usd", usd).drop("usd_in", "usd_out")


def cost_summary(priced: DataFrame) -> DataFrame:
    """purpose, model (null: all), calls, tokens, usd: in all, by purpose and by model, in one pass."""
    return priced.groupingSets([[], ["purpose"], ["model"]], "purpose", "model").agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("usd").alias("usd")
    )


def aggregate_raters(sheet: DataFrame) -> DataFrame:
    """trace_id, overall (mean of numeric ratings), raters (sorted)."""
    return sheet.groupBy("trace_id").agg(F.avg("overall").alias("overall"), F.array_join(F.array_sort(F.collect_set("rater")), ",").alias("raters"))


def score_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and new mean, runs that changed by 0.05 or more, runs that changed their bucket (of 0.4, 0.6, 0.8)."""
    bucket = lambda c: reduce(lambda a, x: a + (F.col(c) >= x).cast("int"), (0.4, 0.6, 0.8), F.lit(0))
    both = old.select("trace_id", F.col("overall").alias("old")).join(new.select("trace_id", F.col("overall").alias("new")), "trace_id")
    return both.agg(F.avg("old").alias("old"), F.avg("new").alias("new"), F.sum((F.abs(F.col("new") - F.col("old")) >= 0.05).cast("long")).alias("changed"), F.sum((bucket("old") != bucket("new")).cast("long")).alias("moved"))


def gold_items(checks: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per trace and judged dimension; traces without judged checks get one row made from their hard score (0 to 5)."""
    judged = checks.where("check_type = 'judge'").groupBy("trace_id", F.col("soft_dimension").alias("item")).agg((F.avg("score") * 5).alias("score")).withColumn("made", F.lit(False))
    rest = runs.join(judged.select("trace_id").distinct(), "trace_id", "left_anti").select("trace_id", F.lit("hard").alias("item"), (F.col("hard") * 5).alias("score"), F.lit(True).alias("made"))
    return judged.unionByName(rest)


def mutation_relations(original: DataFrame, mutated: DataFrame) -> DataFrame:
    """trace_id, relation, holds: does the mutated score relate to the original as the mutation's relation says?"""
    both = original.select("trace_id", F.col("overall").alias("a")).join(mutated.select("trace_id", "relation", F.col("overall").alias("b")), "trace_id")
    a, b = F.col("a"), F.col("b")
    holds = F.when(F.col("relation") == "invariant", F.abs(a - b) < 1e-9).when(F.col("relation") == "down", b <= a).when(F.col("relation") == "up", b >= a).when(F.col("relation") == "zero", b == 0).when(F.col("relation") == "cap", b <= 0.4)
    return both.select("trace_id", "relation", holds.alias("holds"))


def instruction_compliance(defects: DataFrame) -> DataFrame:
    """trace_id, score: 100 less 12 for each severity point of verified defects; of equal (dimension, first 40 characters) one counts."""
    one = defects.where("verified").groupBy("trace_id", "dim", F.substring("quote", 1, 40).alias("q")).agg(F.max("severity").alias("s"))
    return one.groupBy("trace_id").agg(F.greatest(F.lit(0.0), 100 - 12 * F.sum("s")).alias("score"))


#: Which kinds of gaps are closed first.
GAP_ORDER = ["step", "branch", "constraint", "persona", "fault"]


def coverage_gap_report(universe: DataFrame, seen: DataFrame, personas: dict[str, str], default: str = "neutral") -> DataFrame:
    """dimension, item, persona, n_dimension, suggested: what no run covers, with a persona suggested by the first keyword (in order of the
    map) in the item, the number of gaps of the dimension, and how many variants to make (branch and persona gaps, 1 to 10)."""
    gaps = universe.select("dimension", "item").distinct().join(seen.select("dimension", "item").distinct(), ["dimension", "item"], "left_anti")
    persona = F.coalesce(*(F.when(F.col("item").contains(k), p) for k, p in personas.items()), F.lit(default))
    counts = gaps.groupBy("dimension").agg(F.count("*").alias("n_dimension"))
    total = gaps.agg(F.least(F.lit(10), F.greatest(F.lit(1), F.coalesce(F.sum(F.col("dimension").isin("branch", "persona").cast("long")), F.lit(0)))).alias("suggested"))
    return gaps.withColumn("persona", persona).join(counts, "dimension").join(total).select("dimension", "item", "persona", "n_dimension", "suggested")


def targeted_variants(gaps: DataFrame, presets: DataFrame, n: int, order: list[str] = GAP_ORDER) -> DataFrame:
    """The first n gaps by priority of their dimension, as scenario rows with their persona's parameters (`presets`: persona, ...)."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("dimension"))
    return gaps.orderBy(place, "item").limit(n).join(presets, "persona", "left")
