"""Named queries over the test tables, each beside an independent SQL formulation where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions import expressions as X
from spindrift.functions.verdicts import verdict
from spindrift.operators import audit, conformal, contract, fingerprint, guard, judge, pairs, planning, ranking, rates, scenarios, steps, survival
from spindrift.plans import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
Z = NormalDist().inv_cdf(0.975)


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of sums does not show; negative zero is zero."""
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(expr: str, name: str, places: int = 6) -> str:
    return f"round({expr}, {places}) + 0.0 AS {name}"


def wilson_sql(k: str, n: str, part: str) -> str:
    """One bound of the score interval, as SQL."""
    p, z = f"({k})::DOUBLE / ({n})", f"{Z}::DOUBLE"
    centre = f"(({p}) + {z} * {z} / (2 * ({n}))) / (1 + {z} * {z} / ({n}))"
    half = f"{z} * sqrt(({p}) * (1 - ({p})) / ({n}) + {z} * {z} / (4.0::DOUBLE * ({n}) * ({n}))) / (1 + {z} * {z} / ({n}))"
    if part == "lower":
        return f"CASE WHEN ({n}) > 0 THEN CASE WHEN ({k}) = 0 THEN 0.0 ELSE greatest(0.0, {centre} - {half}) END END"
    if part == "upper":
        return f"CASE WHEN ({n}) > 0 THEN CASE WHEN ({k}) = ({n}) THEN 1.0 ELSE least(1.0, {centre} + {half}) END END"
    return f"CASE WHEN ({n}) > 0 THEN {p} END"


def w3(k: str, n: str, *names: str) -> str:
    return ", ".join(r(wilson_sql(k, n, part), name) for part, name in zip(("estimate", "lower", "upper"), names, strict=True))


# ---- rates


@query(f"WITH {V.TRIALS}, c AS (SELECT policy, task, sum(success)::BIGINT AS successes, count(*) AS trials FROM trials GROUP BY ALL) SELECT policy, task, successes, trials, {w3('successes', 'trials', 'rate', 'lower', 'upper')} FROM c")
def rates_wilson(spark, d):
    return rounded(rates.success_rates(V.trials(spark, d), ["policy", "task"]))


@query(f"WITH {V.TRIALS}, c AS (SELECT policy, sum(success)::BIGINT AS successes, count(*) AS trials FROM trials WHERE task = 'F' AND policy IN ('1-URGENT', '5-LOW') GROUP BY ALL) SELECT policy, successes, trials, {w3('successes', 'trials', 'rate', 'lower', 'upper')} FROM c")
def rates_subset(spark, d):
    own = V.trials(spark, d).where("task = 'F'").where(F.col("policy").isin("1-URGENT", "5-LOW"))
    return rounded(rates.success_rates(own, ["policy"]))


@query(f"WITH {V.TRIALS} SELECT DISTINCT policy, task FROM trials")
def distinct_policies(spark, d):
    return V.trials(spark, d).select("policy", "task").distinct()


@query()
def rates_clopper_pearson(spark, d):
    return rounded(rates.exact_rates(V.trials(spark, d), ["policy", "task"]))


_FLEET = f"""WITH {V.EPISODES}, g AS (SELECT grouping(policy) AS gp, grouping(unit_id) AS gu, policy, unit_id, count(*) AS n_episodes, count(success) AS n_judged, coalesce(sum(success), 0)::BIGINT AS k,
    sum(autonomous::INTEGER)::BIGINT AS a, sum(duration_s) / 3600 AS hours, sum(n_int)::BIGINT AS n_interventions, sum(int_s) AS int_s FROM episodes GROUP BY GROUPING SETS ((), (policy), (unit_id)))
    SELECT CASE WHEN gp = 1 AND gu = 1 THEN 'all' WHEN gp = 0 THEN 'policy' ELSE 'unit' END AS level, CASE WHEN gp = 1 AND gu = 1 THEN 'all' WHEN gp = 0 THEN policy ELSE unit_id END AS name, n_episodes, n_judged,
    {w3('k', 'n_judged', 'success_rate', 'success_lower', 'success_upper')}, {w3('a', 'n_episodes', 'autonomous_rate', 'autonomous_lower', 'autonomous_upper')}, {r('hours', 'hours')}, n_interventions,
    {r('n_interventions / hours', 'per_hour')}, {r('hours * 3600 / nullif(n_interventions, 0)', 'mean_s_between')}, {r('int_s / (hours * 3600)', 'time_share')} FROM g"""


@query(_FLEET)
def fleet_metrics(spark, d):
    return rounded(rates.fleet_metrics(V.episodes(spark, d)))


@query()
def fleet_poisson_bounds(spark, d):
    return rounded(rates.with_poisson_bounds(rates.fleet_metrics(V.episodes(spark, d)).select("level", "name", "n_interventions", "hours"), "n_interventions", "hours"))


@query(f"WITH {V.EPISODES}, c AS (SELECT failure_class, count(*) AS n FROM episodes WHERE failure_class IS NOT NULL GROUP BY ALL) SELECT failure_class, n, {r('n / sum(n) OVER ()', 'share')}, row_number() OVER (ORDER BY n DESC)::INTEGER AS place FROM c")
def failure_pareto(spark, d):
    return rounded(rates.pareto(V.episodes(spark, d), "failure_class", "episode_id"))


@query(f"WITH {V.EPISODES} SELECT episode_id, autonomous, {r('int_s', 'intervention_s')} FROM episodes")
def intervention_time(spark, d):
    e = V.episodes(spark, d)
    return rounded(e.select("episode_id", rates.autonomous(F.col("interventions")).alias("autonomous"), rates.intervention_seconds(F.col("interventions")).alias("intervention_s")))


@query(f"""WITH {V.GUARD}, a AS (SELECT count(*) AS n_episodes, count(*) FILTER (truth IS NULL) AS n_unlabelled, count(*) FILTER (NOT truth) AS n_failures, count(*) FILTER (NOT truth AND detected) AS n_detected,
    avg(lead_time_s) FILTER (NOT truth AND detected) AS lead_mean_s, median(lead_time_s) FILTER (NOT truth AND detected) AS lead_median_s, count(*) FILTER (NOT truth AND stopped) AS stops_on_failures, count(*) FILTER (truth) AS n_nominal,
    sum(duration_s) FILTER (truth) / 3600 AS nominal_hours, (sum(n_alert_onsets) FILTER (truth))::BIGINT AS n_false_alarms, count(*) FILTER (truth AND detected) AS n_nominal_alarmed, count(*) FILTER (truth AND stopped) AS stops_on_nominal FROM g)
    SELECT * REPLACE (round(lead_mean_s, 6) AS lead_mean_s, round(lead_median_s, 6) AS lead_median_s, round(nominal_hours, 6) AS nominal_hours), {w3('n_detected', 'n_failures', 'detection_rate', 'detection_lower', 'detection_upper')},
    {r('n_false_alarms / nominal_hours', 'false_alarms_per_hour')}, {w3('n_nominal_alarmed', 'n_nominal', 'alarm_rate', 'alarm_lower', 'alarm_upper')} FROM a""")
def guard_metrics(spark, d):
    return rounded(rates.guard_metrics(V.guard_episodes(spark, d)))


_DECIDED = f"{V.SCORES}, p AS (SELECT *, CASE WHEN score >= 0.45 AND score <= 0.55 THEN 'abstain' WHEN score > 0.5 THEN 'success' ELSE 'failure' END AS decision FROM scores)"


@query(f"""WITH {_DECIDED}, a AS (SELECT grouping(task) AS g, task AS t, count(*) AS n, count(*) FILTER (decision <> 'abstain') AS n_decided, sum(duration_s) / 3600 AS hours, count(*) FILTER (decision = 'success' AND y = 1) AS tp,
    count(*) FILTER (decision = 'failure' AND y = 0) AS tn, count(*) FILTER (decision = 'failure' AND y = 1) AS false_alarms, count(*) FILTER (decision = 'success' AND y = 0) AS missed, count(*) FILTER (y = 1) AS ns,
    count(*) FILTER (y = 1 AND decision <> 'abstain') AS nsd, count(*) FILTER (y = 0 AND decision <> 'abstain') AS nfd FROM p GROUP BY GROUPING SETS ((), (task)))
    SELECT CASE WHEN g = 1 THEN 'ALL' ELSE t END AS task, n, n_decided, n - n_decided AS n_abstain, {r('n_decided / n', 'coverage')}, {r('(tp + tn) / nullif(n_decided, 0)', 'accuracy')}, {r(wilson_sql('tp', 'nsd', 'estimate'), 'success_recall')},
    {r(wilson_sql('tn', 'nfd', 'estimate'), 'failure_recall')}, {r(wilson_sql('tn', 'tn + false_alarms', 'estimate'), 'failure_precision')},
    {', '.join(r(f"(({wilson_sql('tp', 'nsd', p)}) + ({wilson_sql('tn', 'nfd', p)})) / 2", f'balanced_{n}') for p, n in (('estimate', 'accuracy'), ('lower', 'lower'), ('upper', 'upper')))},
    {r('(tp + missed - nsd) / nullif(n_decided, 0)', 'success_bias')}, false_alarms, {r('false_alarms / hours', 'false_alarms_per_hour')},
    {r(f"({wilson_sql('false_alarms', 'ns', 'lower')}) * ns / hours", 'false_alarms_per_hour_lower')}, {r(f"({wilson_sql('false_alarms', 'ns', 'upper')}) * ns / hours", 'false_alarms_per_hour_upper')} FROM a""")
def judge_metrics(spark, d):
    s = V.scores(spark, d).withColumn("decision", F.when((F.col("score") >= 0.45) & (F.col("score") <= 0.55), "abstain").when(F.col("score") > 0.5, "success").otherwise("failure"))
    return rounded(rates.judge_metrics(s))


# ---- pairs, sequential tests, survival

_PAIRS = f"""{V.TRIALS}, last AS (SELECT *, row_number() OVER (PARTITION BY policy, pair_id, task ORDER BY pos DESC) AS rn FROM trials WHERE pair_id <> '' AND policy IN ('1-URGENT', '5-LOW')),
    pairs AS (SELECT x.pair_id, x.task, x.success::DOUBLE AS a, y.success::DOUBLE AS b FROM last x JOIN last y ON x.pair_id = y.pair_id AND x.task = y.task WHERE x.rn = 1 AND y.rn = 1 AND x.policy = '1-URGENT' AND y.policy = '5-LOW')"""


def _pairs(spark, d):
    return pairs.pair_trials(V.trials(spark, d), "1-URGENT", "5-LOW")


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def pair_join(spark, d):
    return _pairs(spark, d)


@query(f"""WITH {_PAIRS}, g AS (SELECT task, count(*) AS n, avg(b - a) AS m, stddev_samp(b - a) AS sd, count(*) FILTER (a > b) AS a_only, count(*) FILTER (b > a) AS b_only FROM pairs GROUP BY ALL)
    SELECT task, n, {r('m', 'estimate')}, {r(f'CASE WHEN n > 1 THEN greatest(-1.0, m - {Z} * sd / sqrt(n)) END', 'lower')}, {r(f'CASE WHEN n > 1 THEN least(1.0, m + {Z} * sd / sqrt(n)) END', 'upper')}, a_only, b_only FROM g""")
def paired_interval(spark, d):
    return rounded(pairs.paired_interval(_pairs(spark, d), ["task"]))


@query()
def paired_bootstrap(spark, d):
    return rounded(pairs.bootstrap_interval(_pairs(spark, d), "task"))


_LOG = "ln(40::DOUBLE)"
_CS = f"""{_PAIRS}, o AS (SELECT task, pair_id, a, b, (b - a + 1) / 2 AS x, row_number() OVER w AS t, coalesce(sum((b - a + 1) / 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s1,
    coalesce(sum(((b - a + 1) / 2) ** 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s2 FROM pairs WINDOW w AS (PARTITION BY task ORDER BY pair_id)),
    m AS (SELECT *, (0.5 + s1) / t AS mu FROM o), v AS (SELECT *, greatest(1e-12, (0.25 + s2 - 2 * mu * s1 + (t - 1) * mu * mu) / t) AS var FROM m),
    l AS (SELECT *, least(0.5, sqrt(2 * {_LOG} / (var * t * ln((t + 1)::DOUBLE)))) AS lam FROM v),
    s AS (SELECT *, sum(lam * x) OVER w AS slx, sum(lam) OVER w AS sl, sum(4 * (x - mu) ** 2 * (-ln(1 - lam) - lam) / 4) OVER w AS sv FROM l WINDOW w AS (PARTITION BY task ORDER BY t)),
    trace AS (SELECT task, t::INTEGER AS t, a, b, 2 * slx / sl - 1 AS estimate, 2 * greatest(0, slx / sl - ({_LOG} + sv) / sl) - 1 AS lower, 2 * least(1, slx / sl + ({_LOG} + sv) / sl) - 1 AS upper FROM s)"""


@query(f"WITH {_CS} SELECT task, t, a, b, {r('estimate', 'estimate')}, {r('lower', 'lower')}, {r('upper', 'upper')} FROM trace")
def confidence_sequence(spark, d):
    return rounded(pairs.confidence_sequence(_pairs(spark, d), ["task"], ["pair_id"]))


@query(f"""WITH {_CS}, dec AS (SELECT *, CASE WHEN t >= 5 AND lower > -0.2 AND upper < 0.2 AND NOT lower > 0.2 AND NOT upper < -0.2 THEN 'no_difference_within_margin' WHEN t >= 5 AND lower > 0.2 THEN 'B_better' WHEN t >= 5 AND upper < -0.2 THEN 'A_better' END AS label FROM trace),
    f AS (SELECT *, min(CASE WHEN label IS NOT NULL THEN t END) OVER (PARTITION BY task) AS first FROM dec), u AS (SELECT * FROM f WHERE first IS NULL OR t <= first)
    SELECT task, coalesce(max_by(label, t) FILTER (label IS NOT NULL), 'undecided') AS decision, max(t) AS n, {r('max_by(estimate, t)', 'estimate')}, {r('max_by(lower, t)', 'lower')}, {r('max_by(upper, t)', 'upper')} FROM u GROUP BY task""")
def sequential_test(spark, d):
    return rounded(pairs.sequential_test(_pairs(spark, d), ["task"], ["pair_id"], margin=0.2))


@query(f"""WITH {_CS}, dec AS (SELECT *, CASE WHEN t >= 5 AND lower > 0 THEN 'B_better' WHEN t >= 5 AND upper < 0 THEN 'A_better' END AS label FROM trace)
    SELECT task, coalesce(max_by(label, t) FILTER (label IS NOT NULL), 'undecided') AS decision, max(t) AS n, {r('max_by(estimate, t)', 'estimate')}, {r('max_by(lower, t)', 'lower')}, {r('max_by(upper, t)', 'upper')} FROM dec GROUP BY task""")
def sequential_full(spark, d):
    return rounded(pairs.sequential_test(_pairs(spark, d), ["task"], ["pair_id"], stop_early=False))


@query(f"WITH {_CS} SELECT task, min(CASE WHEN t >= 5 AND (lower > 0 OR upper < 0) THEN t END) AS crossed_at, count(*) FILTER ((t - 1) % greatest(1, floor(mx / 20))::INTEGER = 0) AS kept FROM (SELECT *, max(t) OVER (PARTITION BY task) AS mx FROM trace) GROUP BY task")
def first_crossing(spark, d):
    return pairs.first_crossing(pairs.confidence_sequence(_pairs(spark, d), ["task"], ["pair_id"]), ["task"]).select("task", "crossed_at", F.size("trace").cast("long").alias("kept"))


_KM = f"""{V.TRIALS}, {V.TIMES}, c AS (SELECT policy, time, count(*) AS n, sum(event)::BIGINT AS events FROM times GROUP BY ALL), k AS (SELECT *, (sum(n) OVER (PARTITION BY policy ORDER BY time DESC))::BIGINT AS at_risk FROM c),
    curve AS (SELECT policy, time, at_risk, events, product(1 - events / at_risk) OVER (PARTITION BY policy ORDER BY time) AS survival FROM k)"""


@query(f"WITH {_KM} SELECT policy, time, at_risk, events, {r('survival', 'survival')} FROM curve")
def kaplan_meier(spark, d):
    return rounded(survival.kaplan_meier(V.times(spark, d), ["policy"]))


@query(f"WITH {_KM} SELECT policy, coalesce(min(time) FILTER (survival <= 0.5 + 1e-12), 'inf'::DOUBLE) AS median_time FROM curve GROUP BY policy")
def median_time(spark, d):
    return survival.median_time(survival.kaplan_meier(V.times(spark, d), ["policy"]), ["policy"])


@query(f"""WITH {V.TRIALS}, {V.TIMES}, u AS (SELECT task, time, count(*) AS m, count(*) FILTER (policy = '1-URGENT') AS m_a, sum(event) AS d, sum(event) FILTER (policy = '1-URGENT') AS d_a FROM times WHERE policy IN ('1-URGENT', '5-LOW') GROUP BY ALL),
    k AS (SELECT task, coalesce(d_a, 0) AS d_a, d, sum(m) OVER w AS n, sum(m_a) OVER w AS n_a FROM u WINDOW w AS (PARTITION BY task ORDER BY time DESC)), e AS (SELECT * FROM k WHERE d > 0 AND n > 1)
    SELECT task, {r('sum(d_a - d * n_a / n) ** 2 / sum(d * (n_a / n) * (1 - n_a / n) * (n - d) / (n - 1))', 'statistic')}, sum(d_a)::BIGINT AS events_a, (sum(d) - sum(d_a))::BIGINT AS events_b FROM e GROUP BY task""")
def log_rank(spark, d):
    return rounded(survival.log_rank(V.times(spark, d), ["task"], "policy", "1-URGENT", "5-LOW").drop("p_value"))


@query()
def log_rank_p(spark, d):
    return rounded(survival.log_rank(V.times(spark, d), ["task"], "policy", "1-URGENT", "5-LOW").select("task", "p_value"))


@query(f"""WITH {V.TRIALS}, {V.TIMES}, x AS (SELECT task, policy, CASE WHEN event = 1 THEN time ELSE max(time) OVER (PARTITION BY task) END AS moment FROM times WHERE policy IN ('1-URGENT', '5-LOW')),
    g AS (SELECT task, moment, count(*) FILTER (policy = '1-URGENT') AS a, count(*) FILTER (policy = '5-LOW') AS b FROM x GROUP BY ALL), c AS (SELECT task, a, b, abs(sum(a) OVER w / sum(a) OVER (PARTITION BY task) - sum(b) OVER w / sum(b) OVER (PARTITION BY task)) AS gap FROM g WINDOW w AS (PARTITION BY task ORDER BY moment))
    SELECT task, {r('max(gap)', 'distance')}, sum(a)::BIGINT AS n_a, sum(b)::BIGINT AS n_b FROM c GROUP BY task""")
def ks_distance(spark, d):
    return rounded(survival.ks_distance(V.times(spark, d), ["task"], "policy", "1-URGENT", "5-LOW").drop("p_value"))


# ---- claims


@query(f"WITH {V.CLAIMS} SELECT policy, task, successes, trials, {w3('successes', 'trials', 'rate', 'lower', 'upper')} FROM claims")
def claim_rates(spark, d):
    return rounded(audit.claim_rates(V.claims(spark, d)))


def _newcombe(part):
    a = [wilson_sql("x.successes", "x.trials", p) for p in ("estimate", "lower", "upper")]
    b = [wilson_sql("y.successes", "y.trials", p) for p in ("estimate", "lower", "upper")]
    est = f"(({b[0]}) - ({a[0]}))"
    return {"estimate": est, "lower": f"greatest(-1.0, {est} - sqrt((({b[0]}) - ({b[1]})) ** 2 + (({a[2]}) - ({a[0]})) ** 2))", "upper": f"least(1.0, {est} + sqrt((({b[2]}) - ({b[0]})) ** 2 + (({a[0]}) - ({a[1]})) ** 2))"}[part]


@query(f"""WITH {V.CLAIMS} SELECT x.task, x.policy AS policy_a, y.policy AS policy_b, x.successes AS successes_a, x.trials AS trials_a, y.successes AS successes_b, y.trials AS trials_b, {', '.join(r(_newcombe(p), p) for p in ('estimate', 'lower', 'upper'))},
    {_newcombe('lower')} > 0 OR {_newcombe('upper')} < 0 AS resolved FROM claims x JOIN claims y ON x.task = y.task AND x.pos < y.pos""")
def claim_pairs(spark, d):
    return rounded(audit.claim_pairs(V.claims(spark, d)).drop("p_value"))


@query()
def claim_fisher(spark, d):
    return rounded(audit.claim_pairs(V.claims(spark, d)).select("task", "policy_a", "policy_b", "p_value"))


# ---- step sequences


@query(f"WITH {V.STEPS} SELECT episode_id, step, {r('motion', 'motion')} FROM moved")
def step_motion(spark, d):
    return rounded(steps.motion(V.steps(spark, d)).select("episode_id", "step", "motion"))


@query(f"""WITH {V.STEPS}, f AS (SELECT *, event_type IN ('error', 'signup') AS flag, lead(t) OVER e AS nt, row_number() OVER e - row_number() OVER (PARTITION BY episode_id, event_type IN ('error', 'signup') ORDER BY step) AS island FROM steps WINDOW e AS (PARTITION BY episode_id ORDER BY step))
    SELECT episode_id, min(step) AS first_step, max(step) AS last_step, count(*) AS n, {r('min(t)', 't_start')}, {r('max_by(coalesce(nt, t), step)', 't_end')} FROM f WHERE flag GROUP BY episode_id, island""")
def flag_runs(spark, d):
    flagged = V.steps(spark, d).withColumn("flag", F.col("event_type").isin("error", "signup"))
    return rounded(steps.runs(flagged, "flag"))


@query(f"WITH {V.STEPS}, f AS (SELECT episode_id, gripper > 0.2 AS c, lag(gripper > 0.2) OVER (PARTITION BY episode_id ORDER BY step) AS p FROM steps) SELECT episode_id, count(*) FILTER (c <> p) AS toggles FROM f GROUP BY episode_id")
def gripper_toggles(spark, d):
    return steps.toggles(V.steps(spark, d).withColumn("closed", F.col("gripper") > 0.2), "closed")


@query(f"WITH {V.STEPS} SELECT episode_id, count(*) AS n_steps, {r('coalesce(avg(m), 0)', 'motion')}, {r('coalesce(sum(m), 0)', 'total')}, {r('(stddev_pop(x) + stddev_pop(y)) / 2', 'spread')} FROM (SELECT episode_id, x, y, sqrt((x - lag(x) OVER e) ** 2 + (y - lag(y) OVER e) ** 2) AS m FROM steps WINDOW e AS (PARTITION BY episode_id ORDER BY step)) GROUP BY episode_id")
def raw_motion(spark, d):
    return rounded(steps.raw_motion(V.steps(spark, d)))


_NEXT = "lead(x) OVER e AS x1, lead(y) OVER e AS y1, lead(x, 2) OVER e AS x2, lead(y, 2) OVER e AS y2, lead(x, 3) OVER e AS x3, lead(y, 3) OVER e AS y3"
_CHUNKS = f"{V.STEPS}, ch AS (SELECT *, {_NEXT} FROM steps WINDOW e AS (PARTITION BY episode_id ORDER BY step)), full4 AS (SELECT * FROM ch WHERE x3 IS NOT NULL)"


@query(f"WITH {_CHUNKS} SELECT episode_id, step, {r('(x + x1 + x2 + x3) / 4', 'mean_x')}, {r('(y + y1 + y2 + y3) / 4', 'mean_y')} FROM full4")
def forward_chunks(spark, d):
    c = steps.forward_chunks(V.steps(spark, d), 4).withColumn("m", X.mean_vector("chunk"))
    return rounded(c.select("episode_id", "step", F.col("m")[0].alias("mean_x"), F.col("m")[1].alias("mean_y")))


@query(f"WITH {V.STEPS}, p AS (SELECT *, first_value(x) OVER e AS fx, lag(x) OVER e AS b1, lag(x, 2) OVER e AS b2 FROM steps WINDOW e AS (PARTITION BY episode_id ORDER BY step)) SELECT episode_id, step, {r('(x + coalesce(b1, fx) + coalesce(b2, fx)) / 3', 'mean_x')} FROM p")
def trailing_chunks(spark, d):
    c = steps.trailing_chunks(V.steps(spark, d), 3).withColumn("m", X.mean_vector("chunk"))
    return rounded(c.select("episode_id", "step", F.col("m")[0].alias("mean_x")))


_CONSISTENT = f"""{_CHUNKS}, q AS (SELECT *, lag(x2) OVER e AS px2, lag(y2) OVER e AS py2, lag(x3) OVER e AS px3, lag(y3) OVER e AS py3, lag(x) OVER e AS px FROM full4 WINDOW e AS (PARTITION BY episode_id ORDER BY step)),
    raw AS (SELECT *, CASE WHEN px IS NULL THEN 0.0 ELSE (sqrt((px2 - x) ** 2 + (py2 - y) ** 2) + sqrt((px3 - x1) ** 2 + (py3 - y1) ** 2)) / 2 END AS raw FROM q)"""


@query(f"WITH {_CONSISTENT} SELECT episode_id, step, {r('raw', 'raw')} FROM raw")
def chunk_consistency(spark, d):
    c = steps.chunk_consistency(steps.forward_chunks(V.steps(spark, d), 4))
    return rounded(c.select("episode_id", "step", "raw"))


@query(f"WITH {_CONSISTENT} SELECT {r('avg(raw)', 'raw_mean')}, {r('stddev_samp(raw)', 'raw_std')} FROM raw WHERE step > 0")
def consistency_fit(spark, d):
    return rounded(steps.moments(steps.chunk_consistency(steps.forward_chunks(V.steps(spark, d), 4)).where("step > 0"), ["raw"]))


_STAGNANT = f"""{_CHUNKS}, mid AS (SELECT *, (x + x1 + x2 + x3) / 4 AS mx, (y + y1 + y2 + y3) / 4 AS my FROM full4), mv AS (SELECT *, sqrt((mx - lag(mx) OVER e) ** 2 + (my - lag(my) OVER e) ** 2) AS move FROM mid WINDOW e AS (PARTITION BY episode_id ORDER BY step)),
    st AS (SELECT *, avg(move) OVER (PARTITION BY episode_id ORDER BY step ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS raw FROM mv)"""


@query(f"WITH {_STAGNANT} SELECT episode_id, step, {r('raw', 'raw')} FROM st")
def stagnation_raw(spark, d):
    return rounded(steps.stagnation_raw(steps.forward_chunks(V.steps(spark, d), 4)).select("episode_id", "step", "raw"))


@query(f"WITH {_STAGNANT}, f AS (SELECT greatest(quantile_cont(raw, 0.5) * 0.05::DOUBLE, 1e-12) AS floor FROM st WHERE raw IS NOT NULL) SELECT {r('any_value(floor)', 'floor')}, {r('avg(ln(raw + floor))', 'log_mean')}, {r('stddev_samp(ln(raw + floor))', 'log_std')} FROM st, f WHERE raw IS NOT NULL")
def stagnation_fit(spark, d):
    return rounded(steps.stagnation_fit(steps.stagnation_raw(steps.forward_chunks(V.steps(spark, d), 4))))


_FEATURE = """, f0 AS (SELECT *, sqrt(x * x + y * y) AS mag, quantile_cont(motion, 0.95) OVER p AS p95, min(gripper) OVER p AS lo, max(gripper) OVER p AS hi, max(t) OVER p AS tl FROM src WINDOW p AS (PARTITION BY key)),
    f1 AS (SELECT *, motion < greatest(1e-4, 0.1::DOUBLE * p95) AS stagnant, CASE WHEN hi - lo > 1e-9 THEN gripper < (lo + hi) / 2 END AS closed FROM f0),
    f2 AS (SELECT *, row_number() OVER e - row_number() OVER (PARTITION BY key, stagnant ORDER BY step) AS island, lag(closed) OVER e AS pc FROM f1 WINDOW e AS (PARTITION BY key ORDER BY step)),
    f3 AS (SELECT *, CASE WHEN stagnant THEN count(*) OVER (PARTITION BY key, stagnant, island) ELSE 0 END AS run FROM f2),
    f4 AS (SELECT key, max(t) - min(t) AS duration_s, count(*)::DOUBLE AS n_steps, avg(mag) AS mm, max(mag) AS mx, avg(motion) AS motion_mean, avg(stagnant::INTEGER) AS sf, max(run) AS longest, count(*) FILTER (closed <> pc)::DOUBLE AS tg,
        avg(CASE WHEN closed AND stagnant THEN 1.0::DOUBLE ELSE 0 END) AS cs, avg(motion) FILTER (t >= tl - 2.0) AS fm FROM f3 GROUP BY key),
    f5 AS (SELECT *, CASE WHEN n_steps >= 2 AND duration_s > 0 THEN duration_s / (n_steps - 1) ELSE 1.0 END AS dt FROM f4)"""
_FEATURE_COLUMNS = ", ".join(
    r(e, n)
    for e, n in (
        ("1.0::DOUBLE", "has_actions"), ("duration_s", "duration_s"), ("n_steps", "n_steps"), ("1 / dt", "control_hz"), ("mm", "action_mag_mean"), ("mx", "action_mag_max"), ("0.0::DOUBLE", "chunk_variance"), ("0.0::DOUBLE", "temporal_inconsistency"),
        ("motion_mean", "motion_mean"), ("sf", "stagnation_fraction"), ("longest * dt", "longest_stagnation_s"), ("tg", "gripper_toggles"), ("CASE WHEN duration_s > 0 THEN tg / (duration_s / 60) ELSE tg END", "gripper_toggles_per_min"), ("cs", "gripper_closed_no_motion_fraction"),
        ("fm", "final_window_motion"), ("CASE WHEN motion_mean > 0 THEN fm / (motion_mean + 1e-12) ELSE 0 END", "final_window_motion_ratio"),
    )
)


def _featured(spark, d):
    return V.steps(spark, d).withColumn("chunk", F.array("action"))


@query(f"WITH {V.STEPS}, src AS (SELECT *, episode_id AS key FROM moved) {_FEATURE} SELECT key AS episode_id, {_FEATURE_COLUMNS} FROM f5")
def action_features(spark, d):
    return rounded(steps.action_features(_featured(spark, d)))


@query(f"""WITH {V.STEPS}, b AS (SELECT episode_id, min(t) AS t0, max(t) AS tl, ceil((max(t) - min(t) - 96) / 48)::INTEGER AS c FROM steps GROUP BY ALL), ends AS (SELECT episode_id, k, CASE WHEN k = greatest(c, 0) THEN tl ELSE t0 + 96 + k * 48 END AS t_end FROM b, generate_series(0, greatest(c, 0)) AS s(k)),
    j AS (SELECT s.*, e.episode_id || '#' || e.k AS key FROM steps s JOIN ends e ON s.episode_id = e.episode_id AND s.t > e.t_end - 96 AND s.t <= e.t_end), src0 AS (SELECT *, count(*) OVER (PARTITION BY key) AS members FROM j),
    src AS (SELECT *, coalesce(sqrt((x - lag(x) OVER e) ** 2 + (y - lag(y) OVER e) ** 2), sqrt((lead(x) OVER e - x) ** 2 + (lead(y) OVER e - y) ** 2), 0) AS motion FROM src0 WHERE members >= 2 WINDOW e AS (PARTITION BY key ORDER BY step)) {_FEATURE}
    SELECT key AS "window", {_FEATURE_COLUMNS} FROM f5""")
def windowed_features(spark, d):
    return rounded(steps.action_features(steps.windowed(_featured(spark, d), 96.0), key="window"))


@query(f"""WITH {V.STEPS}, o AS (SELECT *, max(step) OVER (PARTITION BY episode_id) // 2 AS onset FROM steps), h AS (SELECT *, max(CASE WHEN step = onset THEN x END) OVER (PARTITION BY episode_id) AS hx, stddev_pop(CASE WHEN step < onset THEN x END) OVER (PARTITION BY episode_id) + 1e-9 AS sx FROM o)
    SELECT episode_id, step, {r('CASE WHEN step >= onset THEN hx ELSE x END', 'frozen')}, {r('CASE WHEN step >= onset THEN x + 2 * sx ELSE x END', 'shifted')} FROM h""")
def fault_injection(spark, d):
    s = V.steps(spark, d)
    onset = F.floor(F.max("step").over(Window.partitionBy("episode_id")) / 2)
    frozen = steps.inject_fault(s, onset, "freeze").select("episode_id", "step", F.col("action")[0].alias("frozen"))
    return rounded(frozen.join(steps.inject_fault(s, onset, "offset", 2.0).select("episode_id", "step", F.col("action")[0].alias("shifted")), ["episode_id", "step"]))


@query()
def fault_noise(spark, d):
    onset = F.floor(F.max("step").over(Window.partitionBy("episode_id")) / 2)
    return rounded(steps.inject_fault(V.steps(spark, d), onset, "noise", 1.0).select("episode_id", "step", F.col("action")[0].alias("noisy")))


# ---- conformal thresholds and calibration

_TOP = f"{V.STEPS}, m AS (SELECT episode_id, step, motion AS score FROM moved)"


def _motion_scores(spark, d):
    return steps.motion(V.steps(spark, d), name="score").select("episode_id", "step", "t", "score")


@query(f"""WITH {_TOP}, x AS (SELECT episode_id, max(score) AS top FROM m GROUP BY ALL), s AS (SELECT top, row_number() OVER (ORDER BY top) AS rn, count(*) OVER () AS n FROM x), k AS (SELECT *, ceil((n + 1) * 0.9::DOUBLE) AS rank FROM s)
    SELECT 0 AS bin, 0 AS from_step, {r('max(top) FILTER (rn <= rank)', 'threshold')}, any_value(rank > n) AS saturated, {r('any_value(CASE WHEN rank > n THEN 1.0 / (n + 1) ELSE 0.1::DOUBLE END)', 'achievable_alpha')} FROM k""")
def conformal_max(spark, d):
    return rounded(conformal.sequential_thresholds(_motion_scores(spark, d), alpha=0.1))


_BINS = f"""{_TOP}, hz AS (SELECT max(n) AS h FROM (SELECT count(*) AS n FROM m GROUP BY episode_id)), ed AS (SELECT k, round_even(h * k / 4.0::DOUBLE, 0)::INTEGER AS lo, CASE WHEN k = 3 THEN h ELSE round_even(h * (k + 1) / 4.0::DOUBLE, 0)::INTEGER END AS hi FROM hz, generate_series(0, 3) AS g(k)),
    x AS (SELECT k, any_value(lo) AS lo, episode_id, max(score) AS top FROM m JOIN ed ON step >= lo AND step < hi GROUP BY k, episode_id), s AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY top) AS rn, count(*) OVER (PARTITION BY k) AS n FROM x), q AS (SELECT *, ceil((n + 1) * (1 - 0.05::DOUBLE)) AS rank FROM s),
    th AS (SELECT k::INTEGER AS bin, any_value(lo) AS from_step, max(top) FILTER (rn <= rank) AS threshold, any_value(rank > n) AS saturated, any_value(CASE WHEN rank > n THEN 1.0 / (n + 1) ELSE 0.05::DOUBLE END) AS achievable_alpha FROM q GROUP BY k)"""


@query(f"WITH {_BINS} SELECT bin, from_step, {r('threshold', 'threshold')}, saturated, {r('achievable_alpha', 'achievable_alpha')} FROM th")
def conformal_bins(spark, d):
    return rounded(conformal.sequential_thresholds(_motion_scores(spark, d), alpha=0.2, method="bonferroni", bins=4))


@query(f"WITH {_BINS}, a AS (SELECT episode_id, bool_or(score > threshold) AS alarmed FROM m ASOF JOIN th ON step >= from_step GROUP BY ALL) SELECT * FROM a")
def conformal_alarms(spark, d):
    s = _motion_scores(spark, d)
    return conformal.alarms(s, conformal.sequential_thresholds(s, alpha=0.2, method="bonferroni", bins=4))


_CON = f"""{_TOP}, x AS (SELECT episode_id, max(score) AS top, episode_id::INTEGER % 2 = 0 AS nominal FROM m GROUP BY ALL),
    t1 AS (SELECT max(top) FILTER (rn <= ceil((n + 1) * 0.9::DOUBLE)) AS th FROM (SELECT top, row_number() OVER (ORDER BY top) AS rn, count(*) OVER () AS n FROM x WHERE nominal)),
    t2 AS (SELECT max(top) FILTER (rn <= ceil((n + 1) * 0.9::DOUBLE)) AS th FROM (SELECT top, row_number() OVER (ORDER BY top) AS rn, count(*) OVER () AS n FROM x))"""


@query(f"WITH {_CON} SELECT {r('t1.th', 'nominal_threshold')}, {r('t2.th', 'union_threshold')}, {r('avg(CASE WHEN top > t1.th THEN 1.0::DOUBLE ELSE 0 END)', 'benign_alarms_nominal')}, {r('avg(CASE WHEN top > t2.th THEN 1.0::DOUBLE ELSE 0 END)', 'benign_alarms_union')}, {r('t2.th - t1.th', 'shift')}, {r('(t2.th - t1.th) / greatest(abs(t1.th), 1e-12)', 'shift_share')} FROM x, t1, t2 WHERE NOT nominal GROUP BY t1.th, t2.th")
def conformal_contrast(spark, d):
    s = _motion_scores(spark, d)
    even = F.col("episode_id").cast("int") % 2 == 0
    return rounded(conformal.contrast(s.where(even), s.where(~even), alpha=0.1))


_NC = f"{V.SCORES}, nc AS (SELECT task, y, CASE WHEN y = 1 THEN 1 - score ELSE score END AS v FROM scores), rk AS (SELECT *, row_number() OVER (PARTITION BY task, y ORDER BY v) AS rn, count(*) OVER (PARTITION BY task, y) AS n FROM nc)"


@query(f"WITH {_NC}, q AS (SELECT task, y, coalesce(min(v) FILTER (rn = greatest(1, ceil((n + 1) * (1 - 0.2::DOUBLE)))), 1.0) AS q FROM rk GROUP BY ALL) SELECT task, {r('coalesce(max(q) FILTER (y = 0), 1.0)', 't_fail')}, {r('1 - coalesce(max(q) FILTER (y = 1), 1.0)', 't_succ')} FROM q GROUP BY task")
def class_thresholds(spark, d):
    return rounded(conformal.class_thresholds(V.scores(spark, d), ["task"], 0.2))


@query(f"""WITH RECURSIVE {V.SCORES}, al AS (SELECT 0 AS k, 0.1::DOUBLE AS alpha UNION ALL SELECT k + 1, alpha * 0.8::DOUBLE FROM al WHERE k < 59 AND alpha >= 1e-4),
    rk AS (SELECT y, score, CASE WHEN y = 1 THEN 1 - score ELSE score END AS v, row_number() OVER (PARTITION BY y ORDER BY CASE WHEN y = 1 THEN 1 - score ELSE score END) AS rn, count(*) OVER (PARTITION BY y) AS n FROM scores),
    q AS (SELECT k, alpha, coalesce(min(v) FILTER (y = 0 AND rn = greatest(1, ceil((n + 1) * (1 - alpha)))), 1.0) AS f, 1 - coalesce(min(v) FILTER (y = 1 AND rn = greatest(1, ceil((n + 1) * (1 - alpha)))), 1.0) AS t FROM rk, al GROUP BY k, alpha),
    dcd AS (SELECT k, alpha, f, t, y, CASE WHEN score >= t AND score > f THEN 1 WHEN score <= f AND score < t THEN 0 WHEN score >= t AND score <= f THEN -1 WHEN score >= 0.5 * (f + t) THEN 1 ELSE 0 END AS says FROM scores, q),
    e AS (SELECT k, alpha, f, t, count(*) FILTER (says >= 0) AS n_decided, count(*) FILTER (says >= 0 AND says <> y) AS n_errors, count(*) FILTER (y = 1) AS n_success, count(*) FILTER (y = 0) AS n_failure FROM dcd GROUP BY ALL)
    SELECT {r('f', 't_fail')}, {r('t', 't_succ')}, {r('alpha', 'alpha_used')}, {r('coalesce(n_errors / nullif(n_decided, 0), 0)', 'selective_error')}, n_decided, n_errors, n_success, n_failure FROM e WHERE coalesce(n_errors / nullif(n_decided, 0), 0) <= 0.1::DOUBLE OR alpha < 1e-4 OR k = 59 ORDER BY k LIMIT 1""")
def calibrate_selective(spark, d):
    return rounded(conformal.calibrate(V.scores(spark, d), target=0.1))


@query()
def calibrate_by_task(spark, d):
    return rounded(conformal.calibrate_by_task(V.scores(spark, d), target=0.1))


@query(f"WITH {_NC}, q AS (SELECT task, y, coalesce(min(v) FILTER (rn = greatest(1, ceil((n + 1) * (1 - 0.2::DOUBLE)))), 1.0) AS q FROM rk GROUP BY ALL), th AS (SELECT task, coalesce(max(q) FILTER (y = 0), 1.0) AS f, 1 - coalesce(max(q) FILTER (y = 1), 1.0) AS t FROM q GROUP BY task) SELECT id, CASE WHEN score >= t AND score > f THEN 'success' WHEN score <= f AND score < t THEN 'failure' WHEN score >= t AND score <= f THEN 'abstain' WHEN score >= 0.5 * (f + t) THEN 'success' ELSE 'failure' END AS decision FROM scores JOIN th USING (task)")
def decide_by_task(spark, d):
    s = V.scores(spark, d)
    th = conformal.class_thresholds(s, ["task"], 0.2)
    return conformal.lookup_thresholds(s, th).select("id", X.abstain_decision("score", "t_fail", "t_succ").alias("decision"))


# ---- ranking


@query(f"WITH {V.SCORES} SELECT task, {r('(sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0)', 'auroc')}, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg FROM (SELECT *, avg(rn) OVER (PARTITION BY task, score) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY score) AS rn FROM scores)) GROUP BY task")
def auroc(spark, d):
    return rounded(ranking.auroc(V.scores(spark, d), ["task"]))


@query()
def auroc_bootstrap(spark, d):
    return rounded(ranking.auroc_bootstrap(V.scores(spark, d).select("score", "y")))


@query(f"WITH {V.COMPARISONS}, b AS (SELECT policy_i AS policy, policy_j AS rival, outcome AS won FROM comparisons UNION ALL SELECT policy_j, policy_i, 1 - outcome FROM comparisons) SELECT policy, rival, sum(won) AS wins, count(*) AS games FROM b GROUP BY ALL")
def win_table(spark, d):
    return ranking.win_table(V.comparisons(spark, d))


@query()
def bradley_terry(spark, d):
    return rounded(ranking.bradley_terry(V.comparisons(spark, d)), 4)


# ---- guard


def _levelled(spark, d):
    s = _motion_scores(spark, d)
    th = conformal.sequential_thresholds(s, alpha=0.2, method="bonferroni", bins=4)
    return conformal.with_threshold(s, th).withColumn("threshold", F.col("threshold") * 0.4).withColumn("violation", (F.col("step") == 60) & (F.col("episode_id").cast("int") % 10 == 0))


_LEVELS = f"""{_BINS}, sc AS (SELECT episode_id, step, t, score, 0.4::DOUBLE * threshold AS threshold, step = 60 AND episode_id::INTEGER % 10 = 0 AS violation FROM (SELECT episode_id, step, t, motion AS score FROM moved) ASOF JOIN th ON step >= from_step),
    fsm AS (SELECT episode_id, step, violation AS stopped, CASE WHEN NOT violation AND score > threshold THEN 1 ELSE 0 END AS above, CASE WHEN NOT violation AND score < threshold - 0.1::DOUBLE * abs(threshold) THEN 1 ELSE 0 END AS below, 0 AS level FROM sc WHERE step = 0
    UNION ALL SELECT s.episode_id, s.step, f.stopped OR s.violation,
        CASE WHEN f.stopped OR s.violation THEN f.above WHEN s.score > s.threshold THEN CASE WHEN f.above + 1 >= 3 AND f.level < 2 THEN 0 ELSE f.above + 1 END ELSE 0 END,
        CASE WHEN f.stopped OR s.violation THEN f.below WHEN s.score < s.threshold - 0.1::DOUBLE * abs(s.threshold) THEN CASE WHEN f.below + 1 >= 3 AND f.level > 0 THEN 0 ELSE f.below + 1 END ELSE 0 END,
        f.level + CASE WHEN f.stopped OR s.violation THEN 0 WHEN s.score > s.threshold AND f.above + 1 >= 3 AND f.level < 2 THEN 1 WHEN s.score < s.threshold - 0.1::DOUBLE * abs(s.threshold) AND f.below + 1 >= 3 AND f.level > 0 THEN -1 ELSE 0 END
    FROM fsm f JOIN sc s ON s.episode_id = f.episode_id AND s.step = f.step + 1),
    lv AS (SELECT episode_id, step, CASE WHEN stopped THEN 'stop' WHEN level = 0 THEN 'ok' WHEN level = 1 THEN 'slow' ELSE 'handover' END AS level FROM fsm)"""


@query(f"WITH RECURSIVE {_LEVELS} SELECT * FROM lv")
def guard_levels(spark, d):
    return guard.levels(_levelled(spark, d))


@query(f"WITH RECURSIVE {_LEVELS} SELECT * FROM lv")
def guard_levels_grouped(spark, d):
    return guard.levels_by_group(_levelled(spark, d))


@query(f"""WITH RECURSIVE {_LEVELS}, l2 AS (SELECT lv.*, t, level <> 'ok' AND lag(level, 1, 'ok') OVER (PARTITION BY episode_id ORDER BY step) = 'ok' AS onset FROM lv JOIN sc USING (episode_id, step)),
    e AS (SELECT episode_id, count(*) AS n_steps, min(t) AS t0, max(t) - min(t) AS span, count(*) FILTER (onset) AS n_alert_onsets, min(t) FILTER (onset) AS alert_t, max(CASE level WHEN 'ok' THEN 0 WHEN 'slow' THEN 1 WHEN 'handover' THEN 2 ELSE 3 END) AS rk FROM l2 GROUP BY ALL)
    SELECT episode_id, n_steps, {r('CASE WHEN n_steps > 1 THEN span + span / (n_steps - 1) ELSE 1.0 END', 'duration_s')}, n_alert_onsets, {r('alert_t - t0', 'first_alert_s')}, ['ok', 'slow', 'handover', 'stop'][rk + 1] AS max_level, rk = 3 AS stopped, n_alert_onsets > 0 AS detected,
    {r('CASE WHEN n_alert_onsets > 0 THEN CASE WHEN n_steps > 1 THEN span + span / (n_steps - 1) ELSE 1.0 END - (alert_t - t0) END', 'lead_time_s')} FROM e""")
def guard_episodes(spark, d):
    lv = _levelled(spark, d)
    return rounded(guard.episodes_of(guard.levels(lv, keep=("t",))))


@query(f"WITH RECURSIVE {_LEVELS}, f AS (SELECT lv.*, t, max(t) OVER (PARTITION BY episode_id) / 2 AS onset_t FROM lv JOIN sc USING (episode_id, step)) SELECT episode_id, {r('any_value(onset_t)', 'onset_t')}, {r('min(t) FILTER (level <> $$ok$$ AND t >= onset_t - 1)', 'alert_t')}, count(*) FILTER (level <> 'ok' AND t >= onset_t - 1) > 0 AS hit, {r('min(t) FILTER (level <> $$ok$$ AND t >= onset_t - 1) - any_value(onset_t)', 'latency_s')} FROM f GROUP BY episode_id")
def alert_latency(spark, d):
    lv = _levelled(spark, d)
    onsets = lv.groupBy("episode_id").agg((F.max("t") / 2).alias("onset_t"))
    return rounded(guard.alert_after_onset(guard.levels(lv, keep=("t",)), onsets, 1.0))


@query(f"WITH {_CHUNKS} SELECT episode_id, step, greatest(sqrt(x * x + y * y), sqrt(x1 * x1 + y1 * y1), sqrt(x2 * x2 + y2 * y2), sqrt(x3 * x3 + y3 * y3)) > 90 OR greatest(abs(x), abs(x1), abs(x2), abs(x3), abs(y), abs(y1), abs(y2), abs(y3)) > 95 OR greatest(sqrt((x1 - x) ** 2 + (y1 - y) ** 2), sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2), sqrt((x3 - x2) ** 2 + (y3 - y2) ** 2)) > 85 OR least(x, x1, x2, x3) < 0.05 OR greatest(y, y1, y2, y3) > 98 AS violation FROM full4")
def hard_limits(spark, d):
    limits = guard.HardLimits(joint_low=[0.05], joint_high=[1e9, 98.0], max_norm=90.0, max_abs=95.0, max_step=85.0)
    c = steps.forward_chunks(V.steps(spark, d), 4).withColumn("state", F.lit(None).cast("array<double>"))
    return c.select("episode_id", "step", limits.violated().alias("violation"))


@query()
def mahalanobis(spark, d):
    e = V.embeddings(spark, d)
    mean, cov, _ = guard.ledoit_wolf(e.where("label = 0"))
    return rounded(e.select("vec_id", guard.mahalanobis(mean, cov)("features").alias("distance2")), 4)


@query("WITH e AS (SELECT vec_id, label, embedding FROM embeddings), f AS (SELECT i, avg(embedding[i]::DOUBLE) AS m FROM e, generate_series(1, 64) AS g(i) WHERE label = 0 GROUP BY i) SELECT vec_id, round(sqrt(sum((embedding[i]::DOUBLE - m) ** 2)), 6) + 0.0 AS distance FROM e, f GROUP BY vec_id")
def centroid_distance(spark, d):
    e = V.embeddings(spark, d)
    facts = e.where("label = 0").select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    centre = facts.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    return rounded(e.join(F.broadcast(centre), F.lit(True)).select("vec_id", X.distance("features", "c").alias("distance")))


# ---- fingerprints


@query()
def unit_fingerprint(spark, d):
    return rounded(fingerprint.unit_fingerprint(V.excitation(spark, d)), 5)


_POP = """pop AS (SELECT cast(l_suppkey AS VARCHAR) AS unit_id, stat, value, l_suppkey % 2 AS part FROM (SELECT l_suppkey, avg(l_quantity) AS q, avg(l_discount) AS disc, max(l_tax) AS tax FROM lineitem GROUP BY ALL) UNPIVOT (value FOR stat IN (q, disc, tax))),
    c0 AS (SELECT stat, median(value) AS center, stddev_pop(value) AS sd FROM pop WHERE part = 0 GROUP BY ALL), model AS (SELECT stat, center, greatest(median(abs(value - center)) * 1.4826::DOUBLE, max(sd) * 1e-3, 1e-12) AS scale FROM pop JOIN c0 USING (stat) WHERE part = 0 GROUP BY ALL)"""


def _population(spark, d):
    g = V.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("disc"), F.max("l_tax").alias("tax"))
    entries = F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).alias("value")) for c in ("q", "disc", "tax")])
    return g.select(F.col("l_suppkey").cast("string").alias("unit_id"), F.when(F.col("l_suppkey") % 2 == 0, "fit").otherwise("cal").alias("part"), F.explode(entries).alias("e")).select("unit_id", "part", "e.*")


@query(f"WITH {_POP} SELECT stat, {r('center', 'center')}, {r('scale', 'scale')} FROM model")
def drift_model(spark, d):
    return rounded(fingerprint.drift_model(_population(spark, d).where("part = 'fit'")))


@query(f"""WITH {_POP}, z AS (SELECT unit_id, part, max(abs(value - center) / scale) AS score FROM pop JOIN model USING (stat) GROUP BY ALL), k AS (SELECT score, row_number() OVER (ORDER BY score) AS rn, count(*) OVER () AS n FROM z WHERE part = 1), th AS (SELECT max(score) FILTER (rn <= ceil((n + 1) * 0.95::DOUBLE)) AS threshold FROM k)
    SELECT unit_id, CASE part WHEN 0 THEN 'fit' ELSE 'cal' END AS part, {r('score', 'score')}, {r('threshold', 'threshold')}, score > threshold AS alarm FROM z, th""")
def drift_alarms(spark, d):
    return rounded(fingerprint.drift_alarms(_population(spark, d), "fit", "cal").drop("worst"))


@query(f"WITH {_POP}, z AS (SELECT unit_id, stat, value, abs(value - center) / scale AS z FROM pop JOIN model USING (stat)) SELECT unit_id, place, stat, {r('value', 'value')}, {r('z', 'z')} FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY z DESC, stat)::INTEGER AS place FROM z) WHERE place <= 2")
def drift_explain(spark, d):
    p = _population(spark, d)
    return rounded(fingerprint.explain_drift(p, fingerprint.drift_model(p.where("part = 'fit'")), top=2))


@query(f"WITH {_POP}, f AS (SELECT stat, avg(value) AS m, stddev_pop(value) AS s FROM pop WHERE part = 0 GROUP BY ALL) SELECT unit_id, bool_or(abs(value - m) > 3 * greatest(s, 1e-12)) AS alarm FROM pop JOIN f USING (stat) GROUP BY unit_id")
def three_sigma(spark, d):
    return fingerprint.three_sigma(_population(spark, d), "fit")


def _unit(spark, d, which):
    g = V.table(spark, d, "part").where(F.col("p_partkey") % 2 == which).groupBy(F.concat(F.lit("j"), (F.col("p_size") % 12 + which).cast("string")).alias("joint"))
    x = F.avg("p_retailprice") / 1000
    return g.agg(x.alias("rmse"), (x / 20).alias("lag_s"), (x / 3).alias("backlash"), (x / 50).alias("steady_error"), (x * 1.02).alias("gain"), (x * 2).alias("max_abs_error"))


_SIDE = "SELECT 'j' || (p_size % 12 + {w}) AS joint, avg(p_retailprice) / 1000 AS x FROM part WHERE p_partkey % 2 = {w} GROUP BY ALL"
_STATS = [("rmse", "1.0", "rel", 0.5, 1.5, 0.002), ("backlash", "1.0 / 3", "rel", 0.5, 1.5, 0.001), ("max_abs_error", "2.0", "rel", 0.5, 1.5, 0.005), ("lag_s", "1.0 / 20", "abs", 0.02, 0.05, 0), ("steady_error", "1.0 / 50", "abs", 0.005, 0.02, 0), ("gain", "1.02", "abs", 0.05, 0.15, 0)]


def _diff_sql():
    parts = []
    for stat, scale, kind, warn, fail, floor in _STATS:
        a, b, s = f"a.x * ({scale})::DOUBLE", f"b.x * ({scale})::DOUBLE", stat
        delta = f"({b} - {a}) / greatest(abs({a}), {floor})" if kind == "rel" else f"{b} - {a}"
        mark = f"CASE WHEN abs({delta}) >= {fail} THEN 'fail' WHEN abs({delta}) >= {warn} THEN 'warn' ELSE 'ok' END"
        parts.append(f"SELECT joint, '{s}' AS stat, {r(a, 'reference', 11)}, {r(b, 'current', 11)}, {r(delta, 'delta', 11)}, " + (f"CASE WHEN {b} > {a} THEN {mark} ELSE 'ok' END" if kind == "rel" else mark) + " AS grade FROM a JOIN b USING (joint)")
    parts.append("SELECT coalesce(a.joint, b.joint), 'present', NULL, NULL, 1.0, 'fail' FROM a FULL JOIN b USING (joint) WHERE a.joint IS NULL OR b.joint IS NULL")
    return f"WITH a AS ({_SIDE.format(w=0)}), b AS ({_SIDE.format(w=1)}) " + " UNION ALL ".join(parts)


@query(_diff_sql())
def unit_difference(spark, d):
    return rounded(fingerprint.unit_difference(_unit(spark, d, 0), _unit(spark, d, 1)), 11)


@query(f"SELECT stat, count(*) FILTER (grade = 'ok') AS n_ok, count(*) FILTER (grade = 'warn') AS n_warn, count(*) FILTER (grade = 'fail') AS n_fail, CASE WHEN count(*) FILTER (grade = 'fail') > 0 THEN 'fail' WHEN count(*) FILTER (grade = 'warn') > 0 THEN 'warn' ELSE 'ok' END AS worst, count(*) FILTER (grade = 'fail') = 0 AS passed FROM ({_diff_sql()}) GROUP BY stat")
def drift_roll_up(spark, d):
    return fingerprint.roll_up(fingerprint.unit_difference(_unit(spark, d, 0), _unit(spark, d, 1)), ["stat"])


# ---- contract

_RULES = " UNION ALL ".join(f"SELECT '{f}' AS field, '{s}' AS severity" for s, names in (("fatal", contract.FATAL), ("warn", contract.WARN), ("info", contract.INFO)) for f in names)
_FINDINGS = f"""{V.MANIFESTS}, rules AS ({_RULES}), grid AS (SELECT site, field, severity FROM (SELECT DISTINCT site FROM ends), rules), f AS (SELECT g.site, g.field, g.severity, e.value AS evaluated, d.value AS deployed FROM grid g LEFT JOIN evaluated e USING (site, field) LEFT JOIN deployed d USING (site, field)),
    findings AS (SELECT *, CASE WHEN coalesce(evaluated, '') IN ('', 'unknown', '[]') OR coalesce(deployed, '') IN ('', 'unknown', '[]') THEN CASE severity WHEN 'fatal' THEN 'fatal' ELSE 'info' END WHEN evaluated = deployed THEN 'ok' ELSE severity END AS finding FROM f)"""


@query(f"WITH {_FINDINGS} SELECT site, field, severity, evaluated, deployed, finding FROM findings")
def contract_check(spark, d):
    a, b = V.manifests(spark, d)
    return contract.check(a, b, contract.rules(spark), keys=["site"])


@query(f"WITH {_FINDINGS}, c AS (SELECT site, count(*) FILTER (finding = 'fatal') AS n_fatal, count(*) FILTER (finding = 'warn') AS n_warn, count(*) FILTER (finding = 'info') AS n_info, count(*) FILTER (finding = 'ok') AS n_ok FROM findings GROUP BY site) SELECT *, CASE WHEN n_fatal > 0 THEN 'fatal' WHEN n_warn > 0 THEN 'warn' WHEN n_info > 0 THEN 'info' ELSE 'ok' END AS worst, n_fatal = 0 AS passed FROM c")
def contract_verdict(spark, d):
    a, b = V.manifests(spark, d)
    return contract.verdict(contract.check(a, b, contract.rules(spark), keys=["site"]), ["site"])


@query(f"WITH {V.MANIFESTS} SELECT e.site || ':' || e.field AS key, e.value AS a, d.value AS b FROM evaluated e FULL JOIN deployed d ON e.site = d.site AND e.field = d.field WHERE e.value IS DISTINCT FROM d.value")
def pin_mismatch(spark, d):
    a, b = [m.select(F.concat_ws(":", F.col("site").cast("string"), "field").alias("key"), "value") for m in V.manifests(spark, d)]
    return contract.mismatched_pins(a, b)


# ---- scenario runs


@query(f"WITH {V.RUN_A}, {V.RUN_B} SELECT scenario_hash, index, CASE WHEN run_a.success THEN 'broken' ELSE 'fixed' END AS change FROM run_a JOIN run_b USING (scenario_hash, index) WHERE run_a.success <> run_b.success")
def run_changes(spark, d):
    return scenarios.changed(V.run(spark, d, "a"), V.run(spark, d, "b"))


@query(f"""WITH {V.RUN_A}, {V.RUN_A2}, j AS (SELECT a.*, b.success AS bs, b.max_reward AS br, b.steps AS bt FROM run_a a LEFT JOIN (SELECT * FROM run_a2 WHERE index % 50 <> 0) b USING (scenario_hash)),
    c AS (SELECT count(*) AS n, count(*) FILTER (success) AS n_eligible, count(*) FILTER (success AND NOT coalesce(bs, false)) AS broken, count(*) FILTER (NOT success AND coalesce(bs, false)) AS fixed, count(*) FILTER (max_reward IS NOT DISTINCT FROM br) AS same_reward, count(*) FILTER (steps IS NOT DISTINCT FROM bt) AS same_steps, count(*) FILTER (success IS NOT DISTINCT FROM bs) AS so FROM j)
    SELECT n, n_eligible, broken, fixed, broken + fixed AS flips, {w3('broken', 'n_eligible', 'rate', 'lower', 'upper')}, CASE WHEN same_reward = n AND same_steps = n AND so = n THEN 'deterministic' ELSE 'stochastic' END AS determinism, same_reward, same_steps FROM c""")
def noise_floor(spark, d):
    return rounded(scenarios.noise_floor(V.run(spark, d, "a"), V.run(spark, d, "a2").where(F.col("index") % 50 != 0)))


@query(f"""WITH {V.RUN_A}, {V.RUN_B}, p AS (SELECT run_a.success::INTEGER AS a, run_b.success::INTEGER AS b FROM run_a JOIN run_b USING (scenario_hash)), c AS (SELECT count(*) AS n, sum(a)::BIGINT AS a_passed, sum(b)::BIGINT AS b_passed, count(*) FILTER (a = 0 AND b = 1) AS fixed, count(*) FILTER (a = 1 AND b = 0) AS broken, avg(b - a) AS m, stddev_samp(b - a) AS sd FROM p)
    SELECT n, a_passed, b_passed, fixed, broken, {w3('a_passed', 'n', 'a_rate', 'a_lower', 'a_upper')}, {w3('b_passed', 'n', 'b_rate', 'b_lower', 'b_upper')}, {r('m', 'difference')}, {r(f'm - {Z} * sd / sqrt(n)', 'difference_lower')}, {r(f'm + {Z} * sd / sqrt(n)', 'difference_upper')} FROM c""")
def run_diff(spark, d):
    return rounded(scenarios.diff(V.run(spark, d, "a"), V.run(spark, d, "b")).drop("decision"))


@query()
def run_decision(spark, d):
    got = scenarios.diff(V.run(spark, d, "a"), V.run(spark, d, "b"))
    floor = scenarios.noise_floor(V.run(spark, d, "a"), V.run(spark, d, "a2")).select(F.col("broken").alias("floor"))
    return got.join(F.broadcast(floor), F.lit(True)).select("decision", scenarios.recommendation(F.col("decision"), F.col("broken"), F.col("floor"), F.lit(False)).alias("recommendation"))


@query(f"""WITH {V.RUN_A}, shards AS (SELECT scenario_hash FROM run_a WHERE index % 9 <> 0 UNION ALL SELECT scenario_hash FROM run_a WHERE index % 40 = 1), battery AS (SELECT scenario_hash FROM run_a WHERE index % 31 <> 0)
    SELECT scenario_hash, 'duplicate' AS problem FROM shards GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT scenario_hash, 'extra' FROM shards WHERE scenario_hash NOT IN (SELECT scenario_hash FROM battery) UNION ALL SELECT scenario_hash, 'missing' FROM battery WHERE scenario_hash NOT IN (SELECT scenario_hash FROM shards)""")
def shard_merge_check(spark, d):
    a = V.run(spark, d, "a").select("scenario_hash", "index")
    shards = a.where(F.col("index") % 9 != 0).unionByName(a.where(F.col("index") % 40 == 1)).select("scenario_hash")
    return scenarios.merge_check(shards, a.where(F.col("index") % 31 != 0).select("scenario_hash"))


_SUPPORT = f"""{V.FACTORS}, q AS (SELECT factor, unnest(list_distinct(quantile_cont(value, [{', '.join(f'{k / 10}' for k in range(1, 10))}]))) AS cut FROM long GROUP BY factor), rl AS (SELECT factor, op, cut FROM q, (VALUES ('>'), ('<=')) AS o(op)),
    sup AS (SELECT factor, op, cut, count(*) FILTER (inside) AS n_in, count(*) FILTER (inside AND broken) AS b_in, count(*) FILTER (NOT inside) AS n_out, count(*) FILTER (NOT inside AND broken) AS b_out FROM (SELECT factor, op, cut, broken, CASE op WHEN '>' THEN value > cut ELSE value <= cut END AS inside FROM long JOIN rl USING (factor)) GROUP BY ALL)"""


@query(f"WITH {_SUPPORT} SELECT factor, op, {r('cut', 'cut')}, n_in, b_in, n_out, b_out FROM sup")
def rule_supports(spark, d):
    own = scenarios.with_magnitudes(scenarios.value_counts(V.factors(spark, d)))
    return rounded(scenarios.rule_supports(own, scenarios.cut_rules(own, 0.1, 0.9, 9)))


@query()
def hotspots(spark, d):
    return rounded(scenarios.hotspots(V.factors(spark, d)))


@query("SELECT p_partkey AS index, least(1.0, p_size % 6 / 4.0)::DOUBLE AS score, CASE WHEN p_size % 6 >= 4 THEN NULL WHEN p_size % 2 = 0 THEN 'grasp' WHEN p_size % 3 = 0 THEN 'grasp' WHEN p_size % 5 = 0 THEN 'timeout' ELSE 'action' END AS failure_class, CASE WHEN p_size % 6 >= 4 THEN NULL WHEN p_size % 2 = 0 THEN 'missed_grasp' WHEN p_size % 3 = 0 THEN 'unstable_grasp' WHEN p_size % 5 = 0 THEN 'no_progress' ELSE 'inconsistent_chunks' END AS subclass FROM part")
def scenario_outcomes(spark, d):
    s = F.col("p_size")
    p = V.table(spark, d, "part").select("p_partkey", (s % 6 >= 4).alias("success"), (s % 2 != 0).alias("touched"), (s % 3 != 0).alias("lifted"), (s % 5 == 0).alias("timed_out"), (s % 6).alias("max_reward"))
    o = scenarios.outcome_of()
    return p.select(F.col("p_partkey").alias("index"), o["score"].alias("score"), o["failure_class"].alias("failure_class"), o["subclass"].alias("subclass"))


@query("SELECT p_partkey AS index, sha256(cast(p_partkey AS VARCHAR)) AS scenario_hash, ('0x' || substr(sha256('7:' || sha256(cast(p_partkey AS VARCHAR))), 1, 8))::BIGINT AS seed, (p_partkey % 4)::INTEGER AS shard FROM part")
def scenario_seeds(spark, d):
    p = V.run(spark, d, "a").select("index", "scenario_hash")
    return p.select("index", "scenario_hash", X.policy_seed(F.lit(7), F.col("scenario_hash")).alias("seed"), scenarios.shard_of("index", 4).alias("shard"))


# ---- judge


_BODY = "regexp_extract(text, '(?s)(\\{.*\\})', 1)"


@query("""WITH c AS (SELECT conv_id, turn, conv_id * 3 + turn AS k FROM conversations) SELECT conv_id, turn, CASE WHEN k % 7 IN (0, 3) THEN 0.5 ELSE least(1.0, k % 140 / 100.0) END::DOUBLE AS success_prob,
    CASE WHEN k % 7 IN (0, 3) THEN NULL WHEN k % 3 = 0 THEN 'grasp' WHEN k % 3 = 2 THEN 'timeout' END AS failure_class, k % 7 IN (0, 3) AS parse_error FROM c""")
def verdict_parsing(spark, d):
    t = V.verdict_texts(spark, d).withColumn("v", verdict(F.col("text")))
    return t.select("conv_id", "turn", "v.success_prob", "v.failure_class", "v.parse_error")


@query(f"""WITH {V.STEPS}, src AS (SELECT *, episode_id AS key FROM moved) {_FEATURE} SELECT key AS episode_id, CASE WHEN sf >= 0.5 THEN 'action' WHEN tg >= 4 THEN 'grasp' WHEN cs >= 0.3 THEN 'grasp' ELSE 'unknown' END AS failure_class, CASE WHEN sf >= 0.5 THEN 'freeze' WHEN tg >= 4 THEN 'missed_grasp' WHEN cs >= 0.3 THEN 'unstable_grasp' END AS subclass FROM f5""")
def failure_guess(spark, d):
    f = steps.action_features(_featured(spark, d)).withColumn("failure_class", F.lit(None).cast("string")).withColumn("g", judge.failure_guess())
    return f.select("episode_id", "g.failure_class", "g.subclass")


@query()
def fusion_fit(spark, d):
    s = V.scores(spark, d).withColumn("x2", F.col("score") * F.col("score"))
    model = judge.fit_fusion(s, ["score", "x2", "duration_s"])
    return rounded(s.select("id", model.probability().alias("p")))


@query(f"WITH {V.SCORES} SELECT id, CASE WHEN id % 4 = 0 AND id % 3 <> 0 THEN 'abstain' WHEN score >= 0.5 THEN 'success' ELSE 'failure' END AS decision FROM scores")
def plain_decision(spark, d):
    return V.scores(spark, d).select("id", X.plain_decision("score", F.col("id") % 4 == 0, F.col("id") % 3 == 0).alias("decision"))


# ---- expressions, splits and planning


@query("SELECT o_orderkey AS k, round(1 / (1 + exp(-greatest(-35.0, least(35.0, (o_totalprice - 250000) / 5000)))), 6) + 0.0 AS sigmoid, round((-ln(1 - 0.3::DOUBLE * (o_totalprice / 500001)) - 0.3::DOUBLE * (o_totalprice / 500001)) / 4, 6) + 0.0 AS psi, round(cos(radians(o_totalprice / 2000) / 2), 6) + 0.0 AS qw, round(sin(radians(o_totalprice / 2000) / 2), 6) + 0.0 AS qz, CASE WHEN abs(o_totalprice - 250000) >= 200000 THEN 'fail' WHEN abs(o_totalprice - 250000) >= 100000 THEN 'warn' ELSE 'ok' END AS grade FROM orders")
def scalar_functions(spark, d):
    o = V.table(spark, d, "orders")
    p = F.col("o_totalprice")
    q = X.quaternion_of_yaw(p / 2000)
    return rounded(o.select(F.col("o_orderkey").alias("k"), X.sigmoid((p - 250000) / 5000).alias("sigmoid"), X.psi_e(0.3 * (p / 500001)).alias("psi"), q[0].alias("qw"), q[3].alias("qz"), X.grade(p - 250000, 100000, 200000).alias("grade")))


@query("SELECT o_orderkey AS k, round(CASE WHEN o_orderkey % 3 = 0 THEN b WHEN o_orderkey % 3 = 1 THEN a ELSE (0.7::DOUBLE * a + 0.3::DOUBLE * b) END, 8) + 0.0 AS composite, round(greatest(CASE WHEN o_orderkey % 3 <> 0 THEN a - 0.4::DOUBLE END, CASE WHEN o_orderkey % 3 <> 1 THEN b - 0.6::DOUBLE END), 8) + 0.0 AS excess, round(2 * a - 1, 8) + 0.0 AS scaled FROM (SELECT o_orderkey, o_totalprice / 500000 AS a, o_custkey % 10 / 10.0::DOUBLE AS b FROM orders)")
def composite_scores(spark, d):
    k = F.col("o_orderkey")
    o = V.table(spark, d, "orders").select(k.alias("k"), (F.col("o_totalprice") / 500000).alias("a"), (F.col("o_custkey") % 10 / 10.0).alias("b"))
    a, b = F.when(F.col("k") % 3 != 0, F.col("a")), F.when(F.col("k") % 3 != 1, F.col("b"))
    return rounded(o.select("k", X.weighted_composite([a, b], [0.7, 0.3]).alias("composite"), X.head_excess([a, b], [0.4, 0.6]).alias("excess"), X.normalised("a", "min_max", F.lit(0.0), F.lit(1.0)).alias("scaled")), 8)


@query("SELECT event_id, epoch_us(ts) * 1000 AS ns, 0::BIGINT AS bad FROM events")
def timestamps_to_ns(spark, d):
    e = V.table(spark, d, "events")
    return e.select("event_id", X.iso_to_ns(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("ns"), X.iso_to_ns(F.lit("never")).alias("bad"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS y FROM orders")
def label_parsing(spark, d):
    k = F.col("o_orderkey")
    words = F.when(k % 4 == 0, " Success").when(k % 4 == 1, "fail").when(k % 4 == 2, "TRUE").otherwise("0 ")
    return V.table(spark, d, "orders").select(k.alias("k"), X.binary_label(words).alias("y"))


@query("WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, row_number() OVER (PARTITION BY o_orderstatus ORDER BY sha256('3:' || o_orderkey), o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) SELECT k, s, CASE WHEN rn <= round_even(n * 0.4::DOUBLE, 0) THEN 'train' WHEN rn <= round_even(n * (0.4::DOUBLE + 0.3::DOUBLE), 0) THEN 'cal' ELSE 'test' END AS part FROM o")
def stratified_split(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    return planning.split(o, "k", [("train", 0.4), ("cal", 0.3), ("test", 0.3)], ["s"], seed=3)


_ZP = NormalDist().inv_cdf(0.975) + NormalDist().inv_cdf(0.8)


@query(f"SELECT p_partkey AS k, CASE WHEN a <> b THEN ceil({_ZP ** 2}::DOUBLE * (a * (1 - a) + b * (1 - b)) / (b - a) ** 2)::BIGINT END AS trials, {r(f'{_ZP}::DOUBLE * sqrt(2 * a * (1 - a) / (10 + p_size))', 'detectable')} FROM (SELECT p_partkey, p_size, (10 + p_size) / 100.0::DOUBLE AS a, (15 + p_partkey % 60) / 100.0::DOUBLE AS b FROM part)")
def trial_planning(spark, d):
    p = V.table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_size", ((10 + F.col("p_size")) / 100.0).alias("a"), ((15 + F.col("p_partkey") % 60) / 100.0).alias("b"))
    return rounded(p.select("k", planning.required_trials("a", "b").alias("trials"), planning.detectable(10 + F.col("p_size"), F.col("a")).alias("detectable")))


@query()
def blinded_schedule(spark, d):
    names = [r_.r_name for r_ in V.table(spark, d, "region").orderBy("r_name").collect()]
    return planning.schedule(spark, names, ["bright", "dim", "cluttered"], repeats=2, seed=1)


@query()
def latin_hypercube(spark, d):
    b = scenarios.lhs_battery(spark, [("size", 0.0, 50.0), ("yaw", -20.0, 20.0)], 64, seed=2)
    return b.select("index", F.col("params")["size"].alias("size"), F.col("params")["yaw"].alias("yaw"))


@query("SELECT n_nationkey AS k, [round_even(i * (n_nationkey + 4) / 4.0::DOUBLE, 0)::INTEGER FOR i IN range(5)] AS picked FROM nation")
def frame_subsample(spark, d):
    k = F.col("n_nationkey")
    return V.table(spark, d, "nation").select(k.alias("k"), X.evenly(k + 5, 5).alias("picked")).where("k >= 0")


@query("SELECT event_type, count(*) AS n, sum(first_bytes)::BIGINT AS checks FROM (SELECT event_type, ('0x' || substr(sha1(cast(event_id AS VARCHAR)), 1, 8))::BIGINT AS first_bytes FROM events) GROUP BY event_type")
def stable_units(spark, d):
    e = V.table(spark, d, "events").select("event_type", X.leading_bits(F.col("event_id").cast("string")).alias("b"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("b").alias("checks"))


# ---- further operators


@query(f"WITH {_POP} SELECT stat, {r('quantile_cont(value, 0.25)', 'q25')}, {r('quantile_cont(value, 0.5)', 'q50')}, {r('quantile_cont(value, 0.75)', 'q75')} FROM pop GROUP BY stat")
def statistic_quartiles(spark, d):
    q = _population(spark, d).groupBy("stat").agg(F.percentile("value", [0.25, 0.5, 0.75]).alias("q"))
    return rounded(q.select("stat", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75")))


@query("""WITH e AS (SELECT cast(user_id AS VARCHAR) AS unit_id, 'j' || (event_id % 2) AS joint, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts) AS k, user_id FROM events), c AS (SELECT unit_id, joint, k * 0.1::DOUBLE AS t, sin(k / 7.0::DOUBLE + user_id) AS cmd FROM e),
    g AS (SELECT *, lead(t) OVER w - t AS gap, lead(cmd) OVER w AS n, lag(cmd) OVER w AS p FROM c WINDOW w AS (PARTITION BY unit_id, joint ORDER BY t)), m AS (SELECT *, median(gap) OVER (PARTITION BY unit_id, joint) AS dt FROM g)
    SELECT unit_id, joint, round(t, 6) + 0.0 AS t, round(coalesce((n - p) / (2 * dt), (n - cmd) / dt, (cmd - p) / dt), 6) + 0.0 AS v FROM m""")
def command_velocity(spark, d):
    v = fingerprint.velocity(V.excitation(spark, d), ["unit_id", "joint"], "cmd")
    return rounded(v.select("unit_id", "joint", "t", "v"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'valid' WHEN o_orderkey % 4 = 1 THEN 'valid' WHEN o_orderkey % 4 = 2 THEN 'subclass' ELSE 'class' END AS verdict FROM orders")
def taxonomy_check(spark, d):
    from spindrift.functions.taxonomy import CLASSES, SUBCLASSES

    k = F.col("o_orderkey") % 4
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.when(k == 3, "no_such_class").otherwise("grasp").alias("kind"), F.when(k == 0, "slip").when(k == 2, "jam").otherwise(None).alias("sub"))
    pairs_ = F.array(*[F.lit(f"{c}/{s}") for c in CLASSES for s in SUBCLASSES[c]])
    bad_sub = F.col("sub").isNotNull() & ~F.array_contains(pairs_, F.concat_ws("/", "kind", "sub"))
    return o.select("k", F.when(~F.col("kind").isin(CLASSES), "class").when(bad_sub, "subclass").otherwise("valid").alias("verdict"))


@query(f"WITH {V.TRIALS} SELECT policy, count(*) FILTER (task = 'F') AS \"F\", count(*) FILTER (task = 'O') AS \"O\", count(*) FILTER (task = 'P') AS \"P\" FROM trials GROUP BY policy")
def outcome_pivot(spark, d):
    return V.trials(spark, d).groupBy("policy").pivot("task", ["F", "O", "P"]).count().na.fill(0)


@query(f"WITH {V.TRIALS} SELECT policy, task, sum(success)::BIGINT AS successes, count(*) AS trials FROM trials GROUP BY ALL")
def trial_claims(spark, d):
    from spindrift.sources.imports import claims_of

    return claims_of(V.trials(spark, d))


@query(f"WITH {V.STEPS} SELECT {r('avg(x)', 'x_mean')}, {r('greatest(stddev_samp(x), 1e-12)', 'x_std')}, {r('avg(y)', 'y_mean')}, {r('greatest(stddev_samp(y), 1e-12)', 'y_std')} FROM steps")
def action_moments(spark, d):
    s = V.steps(spark, d).select(F.col("action")[0].alias("x"), F.col("action")[1].alias("y"))
    return rounded(steps.moments(s, ["x", "y"]))


@query(f"""WITH {_CHUNKS} SELECT episode_id, step, {r('var_pop4x + var_pop4y', 'variance', 11)} FROM (SELECT *, list_var_pop([x, x1, x2, x3]) AS var_pop4x, list_var_pop([y, y1, y2, y3]) AS var_pop4y FROM full4)""")
def chunk_variance(spark, d):
    c = steps.forward_chunks(V.steps(spark, d), 4)
    return rounded(c.select("episode_id", "step", X.chunk_variance("chunk").alias("variance")), 11)


@query(f"""WITH {_CHUNKS}, q AS (SELECT *, lag(x1) OVER e AS px1, lag(y1) OVER e AS py1, lag(x2) OVER e AS px2, lag(y2) OVER e AS py2, lag(x3) OVER e AS px3, lag(y3) OVER e AS py3 FROM full4 WINDOW e AS (PARTITION BY episode_id ORDER BY step))
    SELECT episode_id, {r('coalesce(avg(CASE WHEN px1 IS NOT NULL THEN (sqrt((px1 - x) ** 2 + (py1 - y) ** 2) + sqrt((px2 - x1) ** 2 + (py2 - y1) ** 2) + sqrt((px3 - x2) ** 2 + (py3 - y2) ** 2)) / 3 END), 0)', 'temporal_inconsistency')} FROM q GROUP BY episode_id""")
def temporal_inconsistency(spark, d):
    return rounded(steps.temporal_inconsistency(steps.forward_chunks(V.steps(spark, d), 4)).select("episode_id", "temporal_inconsistency"))


@query(f"WITH {V.STEPS}, n AS (SELECT episode_id, dense_rank() OVER (ORDER BY episode_id) AS k, step, t FROM steps) SELECT episode_id, step::INTEGER AS step, round(step / 30.0::DOUBLE, 6) + 0.0 AS t FROM n WHERE k <= 5")
def episode_assembly(spark, d):
    e = V.table(spark, d, "events").select(F.col("user_id").cast("string").alias("episode_id"), "ts")
    return rounded(steps.numbered(e, "episode_id", ["ts"], fps=30.0, most_episodes=5).select("episode_id", F.col("step").cast("int").alias("step"), "t"))


@query(f"""WITH {V.TRIALS}, s AS (SELECT cast(pos AS VARCHAR) AS scenario_hash, pos AS index, success FROM trials), d AS (SELECT count(*) FILTER (success = 1) AS passed, count(*) AS n FROM s) SELECT passed, n, {w3('passed', 'n', 'rate', 'lower', 'upper')} FROM d""")
def overall_rate(spark, d):
    t = V.trials(spark, d).agg(F.sum("success").cast("long").alias("passed"), F.count("*").alias("n"))
    w = X.wilson("passed", "n")
    return rounded(t.select("passed", "n", w["estimate"].alias("rate"), w["lower"].alias("lower"), w["upper"].alias("upper")))


@query()
def unpaired_bootstrap(spark, d):
    t = V.trials(spark, d)
    return rounded(pairs.bootstrap_unpaired(t, "task", "1-URGENT", "5-LOW"))


@query()
def baseline_detectors(spark, d):
    from spindrift.operators import detectors

    e = V.embeddings(spark, d)
    nominal = e.where("label = 0")
    return rounded(e.select("vec_id", detectors.pca(nominal)("features").alias("pca"), detectors.mixture_density(nominal, parts=2, rounds=5)("features").alias("density"), detectors.isolation_forest(nominal, trees=20)("features").alias("isolation")), 4)


@query()
def guard_replay(spark, d):
    from spindrift.operators import guard_model

    s = steps.trailing_chunks(V.steps(spark, d), 4).select("episode_id", "step", "t", F.col("action").alias("features"), "chunk", F.lit(None).cast("array<double>").alias("state"))
    model = guard_model.fit(s.where(F.col("episode_id").cast("int") % 3 != 0), alpha=0.1)
    return rounded(guard.episodes_of(model.replay(s)))
