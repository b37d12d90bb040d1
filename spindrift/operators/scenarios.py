"""Scenario CI: run alignment, noise floor, regression diff, shard merging and hotspot mining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions.expressions import wilson
from spindrift.functions.special import fisher_udf
from spindrift.operators.pairs import paired_interval, sequential_test
from spindrift.storage import settled

LEAST_SINGLE, LEAST_PAIR, LIFT, MOST_RULES = 8, 15, 1.15, 5  # fixed values: what counts as a region
#: Factors of a battery, above which mining raises, and the ranges that a factor's values are ranked in.
MOST_FACTORS, STRIPES = 10_000, 256


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """(scenario_hash, index, a, b) of two runs over one battery; a scenario that one run lacks raises.

    Runs have scenario_hash, index, success.
    """
    both = a.select("scenario_hash", F.col("index"), F.col("success").cast("double").alias("a")).join(b.select("scenario_hash", F.col("success").cast("double").alias("b"), F.lit(True).alias("__in")), "scenario_hash", "full")
    missing = F.col("__in").isNull() | F.col("index").isNull()
    return both.select("scenario_hash", "index", "a", F.when(missing, F.raise_error(F.concat(F.lit("scenario in one run only: "), F.col("scenario_hash"))).cast("double")).otherwise(F.col("b")).alias("b"))


def noise_floor(a: DataFrame, b: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row over two runs of one policy: flips, the rate of passes that break, and whether reward and steps repeat.

    A scenario missing from the second run counts as differing.
    """
    right = b.select("scenario_hash", *[F.col(c).alias(f"b_{c}") for c in ("success", "max_reward", "steps")])
    j = a.join(right, "scenario_hash", "left")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    same = lambda c: F.col(c).eqNullSafe(F.col(f"b_{c}"))
    passed, then = F.col("success"), F.coalesce("b_success", F.lit(False))
    got = j.agg(
        F.count("*").alias("n"), n(passed).alias("n_eligible"), n(passed & ~then).alias("broken"), n(~passed & then).alias("fixed"),
        n(same("max_reward")).alias("same_reward"), n(same("steps")).alias("same_steps"), n(same("success")).alias("same_outcome"),
    )
    w, whole = wilson("broken", "n_eligible", alpha), F.col("n")
    steady = (F.col("same_reward") == whole) & (F.col("same_steps") == whole) & (F.col("same_outcome") == whole)
    return got.select("n", "n_eligible", "broken", "fixed", (F.col("broken") + F.col("fixed")).alias("flips"), w["estimate"].alias("rate"), w["lower"].alias("lower"), w["upper"].alias("upper"), F.when(steady, "deterministic").otherwise("stochastic").alias("determinism"), "same_reward", "same_steps")


def diff(a: DataFrame, b: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row: both rates, fixed and broken counts, paired interval and the sequential decision in battery order."""
    pairs = aligned(a, b).withColumn("one", F.lit(1))
    counts = pairs.agg(F.count("*").alias("n"), F.sum("a").cast("long").alias("a_passed"), F.sum("b").cast("long").alias("b_passed"), F.sum(F.when((F.col("a") == 0) & (F.col("b") == 1), 1).otherwise(0)).cast("long").alias("fixed"), F.sum(F.when((F.col("a") == 1) & (F.col("b") == 0), 1).otherwise(0)).cast("long").alias("broken"))
    p = paired_interval(pairs, ["one"], alpha).select(F.col("estimate").alias("difference"), F.col("lower").alias("difference_lower"), F.col("upper").alias("difference_upper"))
    s = sequential_test(pairs, ["one"], ["index"], alpha, stop_early=False).select("decision")
    wa, wb = wilson("a_passed", "n", alpha), wilson("b_passed", "n", alpha)
    rates = counts.select("*", wa["estimate"].alias("a_rate"), wa["lower"].alias("a_lower"), wa["upper"].alias("a_upper"), wb["estimate"].alias("b_rate"), wb["lower"].alias("b_lower"), wb["upper"].alias("b_upper"))
    return rates.join(F.broadcast(p), F.lit(True)).join(F.broadcast(s), F.lit(True))  # one row each


def changed(a: DataFrame, b: DataFrame) -> DataFrame:
    """(scenario_hash, index, change) of the scenarios that the second run fixed or broke."""
    both = aligned(a, b)
    return both.where("a <> b").select("scenario_hash", "index", F.when(F.col("a") == 1, "broken").otherwise("fixed").alias("change"))


def recommendation(decision: Column, broken: Column, floor_flips: Column, has_warnings: Column) -> Column:
    """block, approve, approve_with_review, no_change or insufficient_evidence; without a noise floor nothing is approved unless a warning says why."""
    return (
        F.when(~has_warnings & floor_flips.isNull(), "insufficient_evidence")
        .when(decision == "A_better", "block")
        .when(decision == "B_better", F.when(broken > 0, "approve_with_review").otherwise("approve"))
        .when(decision == "no_difference_within_margin", "no_change")
        .otherwise("insufficient_evidence")
    )


def outcome_of(success: str = "success", touched: str = "touched", lifted: str = "lifted", timed_out: str = "timed_out", reward: str = "max_reward") -> Column:
    """struct(score, failure_class, subclass, gates) of a simulator's stage flags."""
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    kind = lambda a, b, c, d: F.when(F.col(success), None).when(no(touched), a).when(no(lifted), b).when(~no(timed_out), c).otherwise(d)
    gate = lambda good: F.when(good, "pass").otherwise("fail")
    gates = F.create_map(
        F.lit("grasp"), gate(~no(lifted)), F.lit("transfer"), gate(F.col(success)), F.lit("time_budget"), gate(no(timed_out)), F.lit("collision"), F.lit("unavailable"), F.lit("placement_error"), F.lit("unavailable")
    )
    score = F.least(F.lit(1.0), F.coalesce(F.col(reward), F.lit(0)) / 4.0)
    return F.struct(score.alias("score"), kind("grasp", "grasp", "timeout", "action").alias("failure_class"), kind("missed_grasp", "unstable_grasp", "no_progress", "inconsistent_chunks").alias("subclass"), gates.alias("gates"))


def merge_check(shards: DataFrame, battery: DataFrame) -> DataFrame:
    """(scenario_hash, problem) of results that occur in two shards, that the battery lacks, or that no shard has; empty is good."""
    twice = shards.groupBy("scenario_hash").count().where("count > 1").select("scenario_hash", F.lit("duplicate").alias("problem"))
    extra = shards.select("scenario_hash").distinct().join(battery, "scenario_hash", "left_anti").select("scenario_hash", F.lit("extra").alias("problem"))
    missing = battery.select("scenario_hash").distinct().join(shards, "scenario_hash", "left_anti").select("scenario_hash", F.lit("missing").alias("problem"))
    return twice.unionByName(extra).unionByName(missing)


def gathered(long: DataFrame) -> DataFrame:
    """(scenario_hash, broken, factors map<string,double>) of rows (scenario_hash, factor, value, broken)."""
    entries = F.map_from_entries(F.collect_list(F.struct("factor", "value")))
    return long.where("factor is not null").groupBy("scenario_hash").agg(F.max("broken").alias("broken"), entries.alias("factors"))


def value_counts(scenarios: DataFrame) -> DataFrame:
    """(factor, value, n, b) of scenarios with broken and a map of factors: scenarios and broken ones at each distinct value, pre-aggregated."""
    long = scenarios.select("broken", F.explode("factors").alias("factor", "value"))
    return long.groupBy("factor", "value").agg(F.count("*").alias("n"), F.sum(F.col("broken").cast("long")).alias("b"))


def rule_supports(counts: DataFrame, rules: DataFrame) -> DataFrame:
    """n_in, b_in, n_out, b_out of each rule (factor, op, cut) over value counts; rules are at most 18 per factor."""
    j = counts.join(rules, "factor")
    inside = F.when(F.col("op") == ">", F.col("value") > F.col("cut")).otherwise(F.col("value") <= F.col("cut"))
    total = lambda c, of: F.sum(F.when(c, F.col(of)).otherwise(0)).cast("long")
    return j.groupBy("factor", "op", "cut").agg(total(inside, "n").alias("n_in"), total(inside, "b").alias("b_in"), total(~inside, "n").alias("n_out"), total(~inside, "b").alias("b_out"))


def _kinds(counts: DataFrame) -> tuple[list[str], list[str]]:
    """Factors without missing values, and those of them whose values lie on both sides of zero; over MOST_FACTORS factors raise."""
    facts = counts.groupBy("factor").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.bool_or(F.col("value").isNull() | F.isnan("value")).alias("holes"))
    rows = facts.limit(MOST_FACTORS + 1).collect()
    if len(rows) > MOST_FACTORS:
        raise ValueError(f"more than {MOST_FACTORS} factors")
    whole = [r for r in rows if not r.holes and r.factor is not None]
    return sorted(r.factor for r in whole), sorted(r.factor for r in whole if r.lo < 0 < r.hi)


def with_magnitudes(counts: DataFrame, kinds: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """Value counts of the factors, and of abs_<factor> of each one whose values lie on both sides of zero; factors with missing values go."""
    whole, signed = kinds or _kinds(counts)
    own = counts.where(F.col("factor").isin(whole))
    both = own.where(F.col("factor").isin(signed)).select(F.concat(F.lit("abs_"), "factor").alias("factor"), F.abs("value").alias("value"), "n", "b")
    return own.unionByName(both).groupBy("factor", "value").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))


def quantiles(counts: DataFrame, shares: list[float]) -> DataFrame:
    """(factor, share, cut): exact quantiles, interpolated between neighbours, of value counts.

    A sketch splits each factor's values into at most STRIPES ranges; running
    counts are taken within the ranges, so no task orders all values of a factor.
    """
    edges = counts.groupBy("factor").agg(F.sum("n").alias("total"), F.percentile_approx("value", [k / STRIPES for k in range(1, STRIPES)], STRIPES).alias("edges"))
    striped = counts.join(edges, "factor").select("factor", "value", "n", "total", F.size(F.filter("edges", lambda e: e <= F.col("value"))).alias("stripe"))
    before = Window.partitionBy("factor").orderBy("stripe").rowsBetween(Window.unboundedPreceding, -1)
    sums = striped.groupBy("factor", "stripe").agg(F.sum("n").alias("own")).withColumn("before", F.coalesce(F.sum("own").over(before), F.lit(0))).drop("own")
    upto = Window.partitionBy("factor", "stripe").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = striped.join(sums, ["factor", "stripe"]).withColumn("end", F.col("before") + F.sum("n").over(upto))
    wanted = F.array(*[F.lit(float(s)) for s in shares])
    at = lambda s: s * (F.col("total") - 1)
    # a value stands at the ranks [end - n, end); it takes part in a quantile that lies between two ranks by its share of the way
    holds = lambda rank: (rank >= F.col("end") - F.col("n")) & (rank < F.col("end"))
    parts = ranked.select("factor", "value", "total", "end", "n", F.explode(wanted).alias("share")).withColumn("at", at(F.col("share")))
    low, high = holds(F.floor("at")), holds(F.ceil("at"))
    weight = F.when(low & high, 1.0).when(low, F.ceil("at") - F.col("at")).otherwise(F.col("at") - F.floor("at"))
    return parts.where(low | high).groupBy("factor", "share").agg(F.sum(weight * F.col("value")).alias("cut"))


def cut_rules(counts: DataFrame, low: float, high: float, n: int) -> DataFrame:
    """(factor, op, cut) at n even quantiles of each factor, in both directions."""
    cuts = quantiles(counts, [low + (high - low) * k / (n - 1) for k in range(n)])
    return cuts.select("factor", "cut").distinct().withColumn("op", F.explode(F.array(F.lit(">"), F.lit("<="))))


def enriched(supports: DataFrame, least: int, alpha: float) -> DataFrame:
    """Rules with enough support on both sides inside which failures are likelier, by the one-sided exact test."""
    good = supports.where((F.col("n_in") >= least) & (F.col("n_out") >= least) & (F.col("b_in") > 0))
    tested = good.withColumn("p_value", fisher_udf("greater")("b_in", F.col("n_in") - F.col("b_in"), "b_out", F.col("n_out") - F.col("b_out")))
    inside, outside = F.col("b_in") / F.col("n_in"), F.col("b_out") / F.col("n_out")
    lift = F.when(outside > 0, inside / outside).otherwise(float("inf"))
    return tested.where((F.col("p_value") <= alpha) & (inside > outside)).withColumn("lift", lift)


def _best_of_factor(own: DataFrame, alpha: float) -> DataFrame:
    found = enriched(rule_supports(own, cut_rules(own, 0.1, 0.9, 9)), LEAST_SINGLE, alpha)
    best = Window.partitionBy("factor").orderBy(F.desc("lift"), F.desc("n_in"), "cut", F.desc("op"))
    return found.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")


def single_hotspots(scenarios: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The best rule of each factor: (factor, op, cut, n_in, b_in, n_out, b_out, p_value, lift)."""
    return _best_of_factor(settled(with_magnitudes(settled(value_counts(scenarios)))), alpha)


def _condition(factor: Column, op: Column, cut: Column) -> Column:
    return F.concat_ws(" ", factor, op, F.format_number(cut, 6))


def hotspots(scenarios: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Regions where failures concentrate: single rules and, seeded by the three best, conjunctions of two; at most five, best first.

    scenarios has a row each with broken and its map of factors (`gathered` makes
    one of long rows).  They are read twice, for the counts at each distinct value
    of all and of those within the three best rules; only such counts are shuffled.
    """
    plain = settled(value_counts(scenarios))
    kinds = _kinds(plain)
    own = settled(with_magnitudes(plain, kinds))
    singles = settled(_best_of_factor(own, alpha))
    columns = ["n_in", "b_in", "n_out", "b_out", "p_value", "lift"]
    found = singles.select(F.array("factor").alias("factors"), _condition(F.col("factor"), F.col("op"), F.col("cut")).alias("rule"), *columns)
    first = singles.orderBy(F.desc("lift"), F.desc("n_in"), "factor").limit(3).collect()
    if first:
        found = found.unionByName(settled(_conjunctions(scenarios, own, kinds, first, alpha).select("factors", "rule", *columns)))
    order = [F.desc("lift"), F.desc("n_in"), "rule"]
    best = found.withColumn("k", F.row_number().over(Window.partitionBy("factors").orderBy(*order))).where("k = 1").drop("k")
    # a conjunction goes where a rule of one of its factors ranks above it
    single = best.where(F.size("factors") == 1).select(F.col("factors")[0].alias("sf"), F.col("lift").alias("sl"))
    worse = best.where(F.size("factors") == 2).select("factors", "lift", F.explode("factors").alias("sf")).join(single, "sf").where(F.col("sl") >= F.col("lift")).select("factors")
    return best.join(worse, "factors", "left_anti").orderBy(*order).limit(MOST_RULES)


def _conjunctions(scenarios: DataFrame, own: DataFrame, kinds: tuple[list[str], list[str]], first: list, alpha: float) -> DataFrame:
    """factors, rule and the support of each of the first rules with a second one of another factor."""
    whole, signed = kinds
    plain = F.map_filter("factors", lambda k, v: k.isin(whole))
    sized = F.map_filter("factors", lambda k, v: k.isin(signed))
    rows = scenarios.select("broken", F.concat(F.map_entries(plain), F.transform(F.map_entries(sized), lambda e: F.struct(F.concat(F.lit("abs_"), e["key"]).alias("key"), F.abs(e["value"]).alias("value")))).alias("e"))
    inside = lambda r: F.exists("e", lambda e: (e["key"] == r.factor) & (e["value"] > r.cut if r.op == ">" else e["value"] <= r.cut))
    of = F.array_compact(F.array(*[F.when(inside(r), F.lit(k)) for k, r in enumerate(first)]))
    members = rows.select("broken", "e", F.explode(of).alias("first")).select("first", "broken", F.explode("e").alias("e")).select("first", "broken", F.col("e.key").alias("factor"), "e.value")
    counts = members.groupBy("first", "factor", "value").agg(F.count("*").alias("n"), F.sum(F.col("broken").cast("long")).alias("b"))
    rules = cut_rules(own, 0.2, 0.8, 7)
    held = counts.join(rules, "factor").where(F.when(F.col("op") == ">", F.col("value") > F.col("cut")).otherwise(F.col("value") <= F.col("cut")))
    got = held.groupBy("first", "factor", "op", "cut").agg(F.sum("n").alias("n_in"), F.sum("b").alias("b_in"))
    number = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("first") + 1)
    total = scenarios.agg(F.count("*"), F.sum(F.col("broken").cast("long"))).first()
    got = got.withColumns({"f1": number(*[r.factor for r in first]), "o1": number(*[r.op for r in first]), "c1": number(*[r.cut for r in first]), "l1": number(*[r.lift for r in first])})
    got = got.where(F.col("factor") != F.col("f1")).withColumns({"n_out": total[0] - F.col("n_in"), "b_out": total[1] - F.col("b_in")})
    got = enriched(got, LEAST_PAIR, alpha).where(F.col("lift") > F.col("l1") * LIFT)
    rule = F.concat_ws(" and ", _condition(F.col("f1"), F.col("o1"), F.col("c1")), _condition(F.col("factor"), F.col("op"), F.col("cut")))
    return got.withColumns({"factors": F.array_sort(F.array("f1", "factor")), "rule": rule})


def shard_of(index: str, shards: int) -> Column:
    return F.pmod(F.col(index), F.lit(shards)).cast("int")


def lhs_battery(spark, names_low_high: list[tuple[str, float, float]], n: int, seed: int = 0) -> DataFrame:
    """(index, params) of n scenarios by Latin hypercube: every factor has one value in each of n equal strata.

    Strata are dealt by the order of hashes, one window per factor over n rows.
    """
    df = spark.range(n).withColumnRenamed("id", "index")
    entries = []
    for k, (name, low, high) in enumerate(names_low_high):
        u = F.pmod(F.xxhash64("index", F.lit(seed), F.lit(k), F.lit("u")), F.lit(1 << 40)) / float(1 << 40)
        df = df.withColumn(f"__{k}", F.row_number().over(Window.orderBy(F.xxhash64("index", F.lit(seed), F.lit(k)))))
        entries += [F.lit(name), F.round(low + (high - low) * (F.col(f"__{k}") - u) / n, 6)]
    return df.select("index", F.create_map(*entries).alias("params"))
