"""Command line over the operators; the exit code is the verdict: 0 pass, 1 fail, 2 refused."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spindrift.functions import expressions as X
from spindrift.functions import special
from spindrift.functions.taxonomy import SUBCLASSES
from spindrift.operators import audit, conformal, contract, fingerprint, guard, pairs, planning, rates, scenarios, steps, survival
from spindrift.sources import arrays, tables
from spindrift.sources.report import Report, Section, roll_up

PASS, FAIL, REFUSED = 0, 1, 2


def stats_interval(spark, a) -> int:
    w = spark.range(1).select(X.wilson(F.lit(a.k), F.lit(a.n), a.alpha).alias("w")).first().w
    low, high = special.clopper_pearson(a.k, a.n, a.alpha)
    print(f"{w.estimate:.3f} [{w.lower:.3f}, {w.upper:.3f}] score, [{low:.3f}, {high:.3f}] exact")
    return PASS


def stats_plan(spark, a) -> int:
    print(planning.trials_needed(a.p_a, a.p_b, a.alpha, a.power, a.rho))
    return PASS


def stats_schedule(spark, a) -> int:
    planning.schedule(spark, a.policies.split(","), a.conditions.split(","), a.repeats, a.seed).orderBy("slot").coalesce(1).write.mode("overwrite").option("header", True).csv(a.out)
    return PASS


def stats_compare(spark, a) -> int:
    """Whether policy b is better than a: rates, paired interval, sequential decision, survival."""
    t = tables.read_results(spark, a.results).where(F.col("policy").isin(a.a, a.b))
    matched = pairs.pair_trials(t, a.a, a.b).withColumn("all", F.lit("ALL"))
    sections, verdicts = [Section.of("Success rates", rates.success_rates(t, ["policy", "task"], a.alpha).orderBy("task", "policy"))], []
    if matched.limit(2).count() == 2:
        paired = pairs.paired_interval(matched, ["all"], a.alpha)
        test = pairs.sequential_test(matched, ["all"], ["pair_id", "task"], a.alpha, a.margin, stop_early=False)
        sections += [Section.of("Paired difference", paired), Section.of("Bootstrap", pairs.bootstrap_interval(matched, "all", a.alpha)), Section.of("Sequential test", test)]
        low, high = (paired.first()[c] for c in ("lower", "upper"))
        verdicts.append("PASS" if low > 0 else "FAIL" if high < 0 else "WARN")
    time, event = survival.censored_time()
    times = t.select("policy", F.lit("ALL").alias("all"), time.alias("time"), event.alias("event"))
    if times.where("time is null").limit(1).count() == 0 and times.where("event = 1").limit(1).count():
        sections.append(Section.of("Time to success", survival.log_rank(times, ["all"], "policy", a.a, a.b)))
    report = Report(f"{a.b} against {a.a}", roll_up(verdicts), sections)
    print(report.markdown())
    if a.html:
        with open(a.html, "w") as f:
            f.write(report.html())
    return FAIL if report.verdict == "FAIL" else PASS


def stats_audit(spark, a) -> int:
    claims = tables.read_claims(spark, a.claims)
    found = audit.claim_pairs(claims, a.alpha)
    print(Report("Claims", "", [Section.of("Rates", audit.claim_rates(claims, a.alpha)), Section.of("Pairs", found)]).markdown())
    return PASS if found.where("not resolved").limit(1).count() == 0 else FAIL


def episodes_validate(spark, a) -> int:
    bad = tables.validate_episodes(spark, a.log)
    for r in bad.orderBy("file", "line").limit(20).collect():
        print(f"line {r.line}: {r.error}")
    return FAIL if bad.limit(1).count() else PASS


def episodes_to_results(spark, a) -> int:
    tables.write_results(tables.read_episodes(spark, a.log), a.out)
    return PASS


def episodes_metrics(spark, a) -> int:
    e = tables.read_episodes(spark, a.log).select("episode_id", "policy", "unit_id", F.col("outcome.success").alias("success"), F.col("timing.duration_s").alias("duration_s"), "interventions", F.col("failure.failure_class").alias("failure_class"))
    m = rates.with_poisson_bounds(rates.fleet_metrics(e, a.alpha), "n_interventions", "hours", a.alpha)
    print(Report("Fleet", "", [Section.of("Metrics", m.orderBy("level", "name")), Section.of("Failures", rates.pareto(e, "failure_class", "episode_id"))]).markdown())
    return PASS


def episodes_from_frames(spark, a) -> int:
    info = tables.read_dataset_info(spark, a.dataset)
    e = tables.episodes_from_frames(tables.read_frames(spark, a.dataset), tables.read_tasks(spark, a.dataset), info["repo_id"] or "dataset", info["fps"], a.policy)
    e.write.mode("append").json(a.out)
    return PASS


def episodes_from_mcap(spark, a) -> int:
    tables.append_episodes(arrays.episodes_from_mcap(spark, a.source), a.out)
    return PASS


def episodes_taxonomy(spark, a) -> int:
    for name, parts in SUBCLASSES.items():
        print(f"{name}: {', '.join(parts)}")
    return PASS


def contract_check(spark, a) -> int:
    read = lambda p: spark.read.csv(p, header=True).select("field", "value")
    found = contract.check(read(a.evaluated), read(a.deployed), contract.rules(spark), a.allow_unknown, a.ignore.split(",") if a.ignore else [])
    print(Report("Contract", "", [Section.of("Findings", found.where("finding <> 'ok'")), Section.of("Verdict", contract.verdict(found))]).markdown())
    return PASS if contract.verdict(found).first().passed else FAIL


def fingerprint_unit(spark, a) -> int:
    fingerprint.unit_fingerprint(tables.read_excitation(spark, a.log, a.unit)).write.mode("overwrite").json(a.out)
    return PASS


def fingerprint_diff(spark, a) -> int:
    schema = "unit_id string, joint string, " + ", ".join(f"{f} double" for f in fingerprint.FIELDS)
    found = fingerprint.unit_difference(spark.read.schema(schema).json(a.reference), spark.read.schema(schema).json(a.current))
    print(Report("Drift", "", [Section.of("Differences", found.where("grade <> 'ok'"))]).markdown())
    return FAIL if found.where("grade = 'fail'").limit(1).count() else PASS


def judge_features(spark, a) -> int:
    s = arrays.read_npz(spark, a.episodes).withColumn("action", F.element_at("chunk", 1)).withColumn("gripper", F.lit(None).cast("double"))
    steps.action_features(s).write.mode("overwrite").json(a.out)
    return PASS


def judge_calibrate(spark, a) -> int:
    s = spark.read.csv(a.scores, header=True).select(F.col("score").cast("double").alias("score"), X.binary_label("label").alias("y"))
    got = conformal.calibrate(s, a.target).first()
    if got is None:
        print("too few rows of a class")
        return REFUSED
    print(f"t_fail={got.t_fail} t_succ={got.t_succ} alpha={got.alpha_used} error={got.selective_error}")
    return PASS


def guard_replay(spark, a) -> int:
    """Levels of recorded scores: a CSV of episode_id, step, t, score, threshold."""
    s = spark.read.csv(a.scores, header=True, schema="episode_id string, step int, t double, score double, threshold double").withColumn("violation", F.lit(False))
    levels = guard.levels(s, a.patience, a.hysteresis, keep=("t",))
    levels.write.mode("overwrite").json(a.out)
    print(Report("Replay", "", [Section.of("Episodes", guard.episodes_of(levels))]).markdown())
    return PASS


def scenarios_diff(spark, a) -> int:
    x, y = tables.read_run(spark, a.a), tables.read_run(spark, a.b)
    if x.select("battery_hash").union(y.select("battery_hash")).distinct().count() != 1:
        print("the runs used different batteries")
        return REFUSED
    d = scenarios.diff(x, y, a.alpha)
    print(Report("Regression", "", [Section.of("Summary", d), Section.of("Changed scenarios", scenarios.changed(x, y).orderBy("index"))]).markdown())
    return FAIL if d.first().decision == "A_better" else PASS


ARGS = {
    stats_interval: [("k", int), ("n", int)],
    stats_plan: [("p_a", float), ("p_b", float), ("--power", float, 0.8), ("--rho", float, 0.0)],
    stats_schedule: [("policies", str), ("conditions", str), ("out", str), ("--repeats", int, 1), ("--seed", int, 0)],
    stats_compare: [("results", str), ("a", str), ("b", str), ("--margin", float, 0.0), ("--html", str, "")],
    stats_audit: [("claims", str)],
    episodes_validate: [("log", str)],
    episodes_to_results: [("log", str), ("out", str)],
    episodes_metrics: [("log", str)],
    episodes_from_frames: [("dataset", str), ("out", str), ("--policy", str, "unknown")],
    episodes_from_mcap: [("source", str), ("out", str)],
    episodes_taxonomy: [],
    contract_check: [("evaluated", str), ("deployed", str), ("--allow-unknown", bool, False), ("--ignore", str, "")],
    fingerprint_unit: [("log", str), ("out", str), ("--unit", str, "unknown")],
    fingerprint_diff: [("reference", str), ("current", str)],
    judge_features: [("episodes", str), ("out", str)],
    judge_calibrate: [("scores", str), ("--target", float, 0.05)],
    guard_replay: [("scores", str), ("out", str), ("--patience", int, 3), ("--hysteresis", float, 0.1)],
    scenarios_diff: [("a", str), ("b", str)],
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="spindrift", description=__doc__)
    commands = parser.add_subparsers(required=True)
    for fn, args in ARGS.items():
        p = commands.add_parser(fn.__name__.replace("_", "-"), help=(fn.__doc__ or "").strip() or None)
        for name, kind, *default in args:
            if kind is bool:
                p.add_argument(name, action="store_true")
            else:
                p.add_argument(name, type=kind, **({"default": default[0]} if default else {}))
        p.add_argument("--alpha", type=float, default=0.05)
        p.set_defaults(fn=fn)
    a = parser.parse_args(argv)
    if spark is None:
        from spindrift.session import local_session

        spark = local_session("cli")
    return a.fn(spark, a)


if __name__ == "__main__":
    sys.exit(main())
