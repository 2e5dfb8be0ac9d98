"""The registered queries of the evaluation engine, each with the SQL that another engine checks it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.functions import stats, text
from evalloom.operators import latency, ordered, paired, ranks
from evalloom.plans.workload import BASE, EVAL, NOISE, REQUESTS, eval_long, requests, table, valid

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def pairs_of(spark: SparkSession, d: str) -> DataFrame:
    return paired.pair_with_base(valid(eval_long(spark, d)), BASE)


PAIRS = EVAL + """,
p AS (SELECT o.*, b.score AS base_score, b.predicted AS base_predicted FROM v o JOIN v b ON o.dataset = b.dataset AND o.idx = b.idx AND b.config = 2 AND o.config <> 2)"""
MCNEMAR = "round(CASE WHEN worse + better = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(worse, better) + 1), lambda i: exp(lgamma(worse + better + 1) - lgamma(i + 1) - lgamma(worse + better - i + 1) - (worse + better) * ln(2))))) END, 6) AS p_mcnemar"
DELTA = f"""SELECT {{keys}}, n_paired, base_acc_pct, acc_pct, round(100.0 * (better - worse) / n_paired, 6) AS delta_pts, worse, better, {MCNEMAR}
FROM (SELECT {{keys}}, count(*) AS n_paired, round(100.0 * sum(base_score) / count(*), 6) AS base_acc_pct, round(100.0 * sum(score) / count(*), 6) AS acc_pct,
  count(*) FILTER (WHERE base_score = 1 AND score = 0) AS worse, count(*) FILTER (WHERE base_score = 0 AND score = 1) AS better FROM p GROUP BY {{group}})"""


@register(f"WITH {PAIRS} {DELTA.format(keys='config, dataset', group='config, dataset')}")
def paired_delta(spark, d):
    return paired.paired_delta(pairs_of(spark, d), "config", "dataset")


@register(f"WITH {PAIRS} {DELTA.format(keys='config, task', group='GROUPING SETS ((config, task), (config))').replace('SELECT config, task, n_paired', "SELECT config, coalesce(task, 'all') AS task, n_paired")}")
def subgroup_delta(spark, d):
    """Tasks and the roll-in row `all`, from one pass over the pairs."""
    p = pairs_of(spark, d)
    both = p.withColumn("task", F.explode(F.array("task", F.lit("all"))))
    return paired.paired_delta(both, "config", "task")


SOFT = "CASE WHEN dataset = 'es' THEN least(1.0, idx % 5 * 0.3) ELSE CAST(predicted = gt AS INT) END"


def soft_scored(rows: DataFrame) -> DataFrame:
    """The rows with scores, as loaded files have them: one dataset has partial credit."""
    return rows.withColumn("score", F.when(F.col("dataset") == "es", F.least(F.lit(1.0), F.col("idx") % 5 * 0.3)).otherwise((F.col("predicted") == F.col("gt")).cast("double")))


@register(f"WITH {EVAL} SELECT config, dataset, round(100.0 * sum(score) / count(score), 6) AS accuracy_pct, count(score) AS n_valid, count(*) FILTER (WHERE error IS NOT NULL) AS n_error FROM (SELECT *, CASE WHEN error IS NULL THEN {SOFT} END AS score FROM e) GROUP BY ALL")
def accuracy_table(spark, d):
    """One dataset has soft scores, which its predictions and ground truths don't tell."""
    return paired.accuracy(soft_scored(eval_long(spark, d)), "config", "dataset")


@register(f"WITH {EVAL} SELECT config, dataset, count(*) AS attempted, count(s) AS answered, count(*) FILTER (WHERE error IS NOT NULL) AS errors, round(coalesce(sum(s), 0), 6) AS score_sum, round(coalesce(sum(s), 0) / count(*), 6) AS score_raw, round(sum(s) / nullif(count(s), 0), 6) AS score_answered FROM (SELECT *, CASE WHEN error IS NULL THEN {SOFT} END AS s FROM e) GROUP BY ALL")
def run_metrics(spark, d):
    return paired.run_metrics(soft_scored(eval_long(spark, d)), "config", "dataset")


@register(f"WITH {EVAL} SELECT config, round(avg(score_answered), 6) AS macro, CAST(count(*) AS BIGINT) AS n_datasets FROM (SELECT config, dataset, round(sum(score) / count(*), 6) AS score_answered FROM v GROUP BY ALL) GROUP BY config HAVING count(*) > 1")
def macro_average(spark, d):
    per = paired.run_metrics(eval_long(spark, d), "config", "dataset")
    return per.groupBy("config").agg(F.round(F.avg("score_answered"), 6).alias("macro"), F.count("*").alias("n_datasets")).where("n_datasets > 1")


@register(f"WITH {EVAL} SELECT config, round(100.0 * sum(score) / count(*), 6) AS pooled_pct, min(n_chars) AS least_chars, round(sum(n_chars) / count(*), 6) AS mean_chars FROM v GROUP BY config")
def pooled_overall(spark, d):
    return valid(eval_long(spark, d)).groupBy("config").agg(paired.pct(F.col("score")).alias("pooled_pct"), F.min("n_chars").alias("least_chars"), F.round(F.sum("n_chars") / F.count("*"), 6).alias("mean_chars"))


@register(f"WITH {EVAL}, x AS (SELECT DISTINCT dataset, idx FROM e WHERE error IS NOT NULL) SELECT config, e.dataset, round(100.0 * sum(CAST(predicted = gt AS INT)) / count(*), 6) AS accuracy_pct, count(*) AS n_valid, CAST(0 AS BIGINT) AS n_error FROM e ANTI JOIN x ON e.dataset = x.dataset AND e.idx = x.idx GROUP BY ALL")
def matched_records(spark, d):
    return paired.accuracy(paired.matched(eval_long(spark, d)), "config", "dataset")


@register(f"""WITH {EVAL}, g AS (SELECT dataset, idx, count(*) FILTER (WHERE error IS NOT NULL) AS n, count(*) FILTER (WHERE error IS NOT NULL AND config = 2) AS base FROM e GROUP BY ALL)
SELECT dataset, count(*) AS n_total, count(*) FILTER (WHERE n > 0) AS n_excluded, count(*) FILTER (WHERE n = 0) AS n_matched, count(*) FILTER (WHERE base > 0 AND n = 1) AS only_base FROM g GROUP BY dataset""")
def exclusion_accounting(spark, d):
    g = eval_long(spark, d).groupBy("dataset", "idx").agg(F.count_if(paired.failed()).alias("n"), F.count_if(paired.failed() & (F.col("config") == BASE)).alias("base"))
    return g.groupBy("dataset").agg(F.count("*").alias("n_total"), F.count_if(F.col("n") > 0).alias("n_excluded"), F.count_if(F.col("n") == 0).alias("n_matched"), F.count_if((F.col("base") > 0) & (F.col("n") == 1)).alias("only_base"))


@register(f"WITH {EVAL} SELECT o.config, o.dataset, count(*) FILTER (WHERE o.gt IS DISTINCT FROM b.gt OR o.task IS DISTINCT FROM b.task) AS misaligned, count(*) AS n FROM e o JOIN e b ON o.dataset = b.dataset AND o.idx = b.idx AND b.config = 2 WHERE o.config <> 2 GROUP BY ALL")
def alignment_check(spark, d):
    e = eval_long(spark, d)
    b = e.where(F.col("config") == BASE).select("dataset", "idx", F.col("gt").alias("b_gt"), F.col("task").alias("b_task"))
    odd = ~(F.col("gt").eqNullSafe(F.col("b_gt")) & F.col("task").eqNullSafe(F.col("b_task")))
    return e.where(F.col("config") != BASE).join(b, ["dataset", "idx"]).groupBy("config", "dataset").agg(F.count_if(odd).alias("misaligned"), F.count("*").alias("n"))


@register(f"""WITH {EVAL}, a AS (SELECT idx FROM v WHERE config = 2), b AS (SELECT idx FROM v WHERE config = 9)
SELECT count(*) FILTER (WHERE b.idx IS NULL) AS only_base, count(*) FILTER (WHERE a.idx IS NULL) AS only_other, count(*) FILTER (WHERE a.idx = b.idx) AS in_both FROM a FULL JOIN b ON a.idx = b.idx""")
def coverage_check(spark, d):
    v = valid(eval_long(spark, d))
    side = lambda c, n: v.where(F.col("config") == c).select("idx", F.lit(True).alias(n))
    j = side(2, "a").join(side(9, "b"), "idx", "full")
    return j.agg(F.count_if(F.col("b").isNull()).alias("only_base"), F.count_if(F.col("a").isNull()).alias("only_other"), F.count_if(F.col("a") & F.col("b")).alias("in_both"))


@register(f"""WITH {EVAL}, s AS (SELECT config, dataset, idx FROM e WHERE error IS NOT NULL)
SELECT o.config, o.dataset, o.idx FROM s o ANTI JOIN s b ON b.config = 2 AND o.dataset = b.dataset AND o.idx = b.idx WHERE o.config <> 2""")
def error_set_diff(spark, d):
    s = eval_long(spark, d).where(paired.failed()).select("config", "dataset", "idx")
    b = s.where(F.col("config") == BASE).select("dataset", "idx")
    return s.where(F.col("config") != BASE).join(b, ["dataset", "idx"], "left_anti").select("config", "dataset", "idx")


@register(f"WITH {EVAL} SELECT config, task, round(100.0 * sum(CAST(predicted = 1 AS INT)) / count(*), 6) AS predicted_one_pct, round(100.0 * sum(CAST(gt = 1 AS INT)) / count(*), 6) AS gt_one_pct FROM v GROUP BY ALL")
def position_bias(spark, d):
    return valid(eval_long(spark, d)).groupBy("config", "task").agg(paired.pct((F.col("predicted") == 1).cast("int")).alias("predicted_one_pct"), paired.pct((F.col("gt") == 1).cast("int")).alias("gt_one_pct"))


@register(f"""WITH {EVAL}, o AS (SELECT dataset, idx, gt, predicted, score FROM v WHERE config = 2), s AS (SELECT dataset, idx, 1 - predicted AS predicted, score FROM v WHERE config = 9)
SELECT dataset, count(*) AS n, round(100.0 * sum(CAST(1 - s.predicted = o.predicted AS INT)) / count(*), 6) AS consistent_pct, round((100.0 * sum(o.score) / count(*) + 100.0 * sum(s.score) / count(*)) / 2, 6) AS balanced_pct FROM o JOIN s USING (dataset, idx) GROUP BY dataset""")
def order_swap_consistency(spark, d):
    v = valid(eval_long(spark, d))
    o = v.where("config = 2").select("dataset", "idx", "predicted", "score")
    s = v.where("config = 9").select("dataset", "idx", (1 - F.col("predicted")).alias("s_predicted"), F.col("score").alias("s_score"))
    same = ((1 - F.col("s_predicted")) == F.col("predicted")).cast("int")
    balanced = (100.0 * F.sum("score") / F.count("*") + 100.0 * F.sum("s_score") / F.count("*")) / 2
    return o.join(s, ["dataset", "idx"]).groupBy("dataset").agg(F.count("*").alias("n"), paired.pct(same).alias("consistent_pct"), F.round(balanced, 6).alias("balanced_pct"))


FLIPS = PAIRS + """,
f AS (SELECT config, dataset, idx, CASE WHEN score < base_score THEN 'lost' ELSE 'gained' END AS direction, CASE WHEN n_chars <= 500 THEN 'short' WHEN n_chars <= 2000 THEN 'middle' ELSE 'long' END AS category FROM p WHERE score <> base_score)"""


def flips(spark: SparkSession, d: str) -> DataFrame:
    p = pairs_of(spark, d).where("score <> base_score")
    size = F.when(F.col("n_chars") <= 500, "short").when(F.col("n_chars") <= 2000, "middle").otherwise("long")
    return p.select("config", "dataset", "idx", F.when(F.col("score") < F.col("base_score"), "lost").otherwise("gained").alias("direction"), size.alias("category"))


@register(f"""WITH {FLIPS}, c AS (SELECT config, category, count(*) FILTER (WHERE direction = 'lost') AS lost, count(*) FILTER (WHERE direction = 'gained') AS gained FROM f GROUP BY ALL)
SELECT c.config, c.category, c.lost, c.gained, c.lost - c.gained AS net, c.lost - c.gained - coalesce(z.lost - z.gained, 0) AS net_over_noise FROM c LEFT JOIN c z ON z.config = 5 AND z.category = c.category WHERE c.config <> 5""")
def net_over_noise_floor(spark, d):
    side = lambda x: F.count_if(F.col("direction") == x)
    c = flips(spark, d).groupBy("config", "category").agg(side("lost").alias("lost"), side("gained").alias("gained")).withColumn("net", F.col("lost") - F.col("gained"))
    z = c.where(F.col("config") == NOISE).select("category", F.col("net").alias("noise"))
    return c.where(F.col("config") != NOISE).join(z, "category", "left").select("config", "category", "lost", "gained", "net", (F.col("net") - F.coalesce("noise", F.lit(0))).alias("net_over_noise"))


@register(f"""WITH {FLIPS}, l AS (SELECT DISTINCT config, dataset, idx FROM f WHERE direction = 'lost'), n AS (SELECT config, count(*) AS n FROM l GROUP BY config),
b AS (SELECT x.config AS a, y.config AS b, count(*) AS both_lost FROM l x JOIN l y ON x.dataset = y.dataset AND x.idx = y.idx AND x.config < y.config GROUP BY ALL)
SELECT a, b, both_lost, round(both_lost / (x.n + y.n - both_lost), 6) AS jaccard FROM b JOIN n x ON x.config = a JOIN n y ON y.config = b""")
def lost_overlap_jaccard(spark, d):
    """From one aggregate by record: the configs that lost it, and each two of them."""
    lost = flips(spark, d).where("direction = 'lost'").groupBy("dataset", "idx").agg(F.array_sort(F.collect_set("config")).alias("c"))  # at most all configs
    two = F.flatten(F.transform("c", lambda a: F.transform(F.filter("c", lambda b: b >= a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    met = lost.select(F.explode(two).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("both_lost"))  # one row for two configs; a config with itself has its own
    own = F.broadcast(met.where("a = b").select(F.col("a").alias("c"), F.col("both_lost").alias("n")))
    x, y = (own.withColumnsRenamed({"c": c, "n": f"n{c}"}) for c in "ab")
    both = met.where("a < b").join(x, "a").join(y, "b")
    return both.select("a", "b", "both_lost", F.round(F.col("both_lost") / (F.col("na") + F.col("nb") - F.col("both_lost")), 6).alias("jaccard"))


@register(f"""WITH {PAIRS}, q AS (SELECT config, CASE WHEN n_chars <= 500 THEN 'short' WHEN n_chars <= 2000 THEN 'middle' ELSE 'long' END AS bucket, score, base_score FROM p)
SELECT config, bucket, count(*) AS n, round(100.0 * sum(CAST(score < base_score AS INT)) / count(*), 6) AS lost_pct FROM q GROUP BY ALL""")
def loss_by_length(spark, d):
    size = F.when(F.col("n_chars") <= 500, "short").when(F.col("n_chars") <= 2000, "middle").otherwise("long")
    return pairs_of(spark, d).groupBy("config", size.alias("bucket")).agg(F.count("*").alias("n"), paired.pct((F.col("score") < F.col("base_score")).cast("int")).alias("lost_pct"))


@register(f"WITH {PAIRS} SELECT config, count(*) AS n, count(*) FILTER (WHERE score > base_score) AS wins, count(*) FILTER (WHERE score < base_score) AS losses, count(*) FILTER (WHERE predicted <> base_predicted) AS differ FROM p GROUP BY config")
def win_loss(spark, d):
    s, b = F.col("score"), F.col("base_score")
    return pairs_of(spark, d).groupBy("config").agg(F.count("*").alias("n"), F.count_if(s > b).alias("wins"), F.count_if(s < b).alias("losses"), F.count_if(F.col("predicted") != F.col("base_predicted")).alias("differ"))


@register(f"""WITH {EVAL}, w(a, b) AS (VALUES (2, 5), (2, 9), (2, 8), (5, 9), (2, 77)), j AS (SELECT w.a, w.b, x.idx, x.score AS xs, y.score AS ys FROM w LEFT JOIN v x ON x.config = w.a LEFT JOIN v y ON y.config = w.b AND y.dataset = x.dataset AND y.idx = x.idx)
SELECT a, b, count(ys) AS n_paired, CASE WHEN count(ys) = 0 THEN 'pending' ELSE 'ok' END AS status, round(100.0 * sum(CASE WHEN ys IS NOT NULL THEN ys - xs END) / nullif(count(ys), 0), 6) AS delta_pts FROM j GROUP BY a, b""")
def pair_list(spark, d):
    """Explicit ordered pairs of configs; a pair with a missing side stays as pending."""
    wanted = [(2, 5), (2, 9), (2, 8), (5, 9), (2, 77)]
    p = paired.pairs_of_runs(valid(eval_long(spark, d)), wanted)
    got = p.groupBy(F.col("baseline").alias("a"), F.col("other").alias("b")).agg(F.count("*").alias("n"), F.sum(F.col("score") - F.col("base_score")).alias("s"))
    out = spark.createDataFrame(wanted, "a int, b int").join(got, ["a", "b"], "left").withColumn("n_paired", F.coalesce("n", F.lit(0)))
    return out.select("a", "b", "n_paired", F.when(F.col("n_paired") == 0, "pending").otherwise("ok").alias("status"), F.round(F.try_divide(100.0 * F.col("s"), F.col("n_paired")), 6).alias("delta_pts"))


COMPARISONS = ((2, 5), (2, 9), (2, 8), (5, 9), (5, 8), (9, 8), (8, 2), (9, 5), (2, 77))


@register(f"""WITH {EVAL}, w(a, b) AS (VALUES {', '.join(map(str, COMPARISONS))}), p AS (SELECT w.a AS baseline, w.b AS other, unnest([x.task, 'all']) AS task, x.score AS base_score, y.score AS score
  FROM w JOIN v x ON x.config = w.a JOIN v y ON y.config = w.b AND y.dataset = x.dataset AND y.idx = x.idx)
{DELTA.format(keys='baseline, other, task', group='baseline, other, task')}""")
def several_baselines(spark, d):
    """Nine comparisons by four baselines, each by task and over all tasks, from one shuffle of the log; a run that isn't there has no rows."""
    p = paired.pairs_of_runs(valid(eval_long(spark, d)), COMPARISONS)
    return paired.paired_delta(p.withColumn("task", F.explode(F.array("task", F.lit("all")))), "baseline", "other", "task")


@register(f"WITH {EVAL} SELECT dataset, count(*) AS n FROM (SELECT dataset, idx FROM v GROUP BY ALL HAVING count(DISTINCT config) = 4) GROUP BY dataset")
def common_to_all(spark, d):
    g = valid(eval_long(spark, d)).groupBy("dataset", "idx").agg(F.count("config").alias("c")).where("c = 4")  # a config has an idx once
    return g.groupBy("dataset").agg(F.count("*").alias("n"))


@register(f"WITH {EVAL} SELECT e.config, e.dataset, count(*) AS n FROM e SEMI JOIN v u ON u.config = 2 AND u.dataset = e.dataset AND u.idx = e.idx GROUP BY ALL")
def base_universe(spark, d):
    e = eval_long(spark, d)
    u = valid(e).where(F.col("config") == BASE).select("dataset", "idx")
    return e.join(u, ["dataset", "idx"], "left_semi").groupBy("config", "dataset").agg(F.count("*").alias("n"))


@register(f"WITH {EVAL} SELECT d.doc_id AS idx FROM documents d ANTI JOIN v ON v.config = 9 AND v.idx = d.doc_id")
def resume_todo(spark, d):
    """Records that have no answer of config 9 yet; errors are redone."""
    done = valid(eval_long(spark, d)).where("config = 9").select("idx")
    return table(spark, d, "documents").select(F.col("doc_id").alias("idx")).join(done, "idx", "left_anti")


@register(f"""WITH {EVAL}, s AS (SELECT config, dataset, count(*) FILTER (WHERE error IS NOT NULL) AS errors, CAST(sum(CASE WHEN error IS NULL THEN CAST(predicted = gt AS INT) END) AS BIGINT) AS score_sum FROM e GROUP BY ALL),
claimed AS (SELECT config, dataset, errors + CAST(config = 9 AND dataset = 'de' AS INT) AS c_errors, score_sum AS c_sum FROM s WHERE dataset <> 'es')
SELECT s.config, s.dataset, CASE WHEN c_sum IS NULL THEN 'no summary' WHEN c_errors <> errors OR abs(c_sum - score_sum) > 1e-6 THEN 'differs' ELSE 'ok' END AS status FROM s LEFT JOIN claimed USING (config, dataset)""")
def summary_check(spark, d):
    s = paired.run_metrics(eval_long(spark, d), "config", "dataset").select("config", "dataset", "errors", "score_sum")
    odd = ((F.col("config") == 9) & (F.col("dataset") == "de")).cast("int")
    claimed = s.where("dataset <> 'es'").select("config", "dataset", (F.col("errors") + odd).alias("c_errors"), F.col("score_sum").alias("c_sum"))
    differs = (F.col("c_errors") != F.col("errors")) | (F.abs(F.col("c_sum") - F.col("score_sum")) > 1e-6)
    return s.join(claimed, ["config", "dataset"], "left").select("config", "dataset", F.when(F.col("c_sum").isNull(), "no summary").when(differs, "differs").otherwise("ok").alias("status"))


@register(f"""WITH {PAIRS}, d AS (SELECT config, dataset, score - base_score AS d, row_number() OVER (PARTITION BY config, dataset ORDER BY idx) - 1 AS i, count(*) OVER (PARTITION BY config, dataset) AS n FROM p),
w AS (SELECT config, dataset, rep, CAST('0x' || substr(md5(rep || '|' || i), 1, 7) AS BIGINT) % n AS j FROM d, (SELECT unnest(range(0, 20)) AS rep))
SELECT w.config, w.dataset, CAST(rep AS INT) AS rep, round(sum(d.d) / count(*), 9) AS mean_diff FROM w JOIN d ON d.config = w.config AND d.dataset = w.dataset AND d.i = w.j GROUP BY ALL""")
def bootstrap_md5(spark, d):
    diff = pairs_of(spark, d).withColumn("diff", F.col("score") - F.col("base_score"))
    return stats.bootstrap_md5(diff, ["config", "dataset"], "idx", "diff", 20).withColumn("mean_diff", F.round("mean_diff", 9))


@register()
def bootstrap_interval(spark, d):
    """Rows only: 10,000 multinomial replicates a cell; whether the interval excludes 0."""
    return stats.bootstrap_pairs(pairs_of(spark, d), ["config", "dataset"]).withColumn("significant", (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0))


# latency


@register(f"""WITH {REQUESTS} SELECT config, dataset, count(*) FILTER (WHERE valid) AS n_valid, count(*) FILTER (WHERE NOT valid) AS n_invalid, round(quantile_cont(wall_ms, 0.25) FILTER (WHERE valid), 6) AS p25, round(quantile_cont(wall_ms, 0.5) FILTER (WHERE valid), 6) AS median, round(quantile_cont(wall_ms, 0.75) FILTER (WHERE valid), 6) AS p75, round(quantile_cont(wall_ms, 0.95) FILTER (WHERE valid), 6) AS p95 FROM r WHERE phase = 'timed' GROUP BY ALL""")
def latency_summary(spark, d):
    return latency.summary(requests(spark, d).where("phase = 'timed'"), "config", "dataset")


@register(f"WITH {REQUESTS} SELECT config, k // 25 AS round, round(median(wall_ms), 6) AS median_ms, count(*) AS n FROM r WHERE valid GROUP BY ALL")
def per_round_medians(spark, d):
    r = requests(spark, d).where("valid").withColumn("round", F.floor(F.col("k") / 25).cast("int"))
    return ranks.with_median(r.groupBy("config", "round").agg(F.count("*").alias("n")), r, ["config", "round"], "wall_ms", "median_ms", 6)


@register(f"WITH {REQUESTS} SELECT config, max(wall_ms) AS upper_median FROM (SELECT config, wall_ms, row_number() OVER (PARTITION BY config ORDER BY wall_ms) AS i, count(*) OVER (PARTITION BY config) AS n FROM r WHERE valid) WHERE i = n // 2 + 1 GROUP BY config")
def upper_median(spark, d):
    found = ranks.ranked(requests(spark, d).where("valid"), ["config"], "wall_ms", lambda n: [F.floor(n / 2)])
    return found.select("config", F.col("_v0").alias("upper_median"))


@register(f"WITH {REQUESTS}, m AS (SELECT config, dataset, median(wall_ms) AS m FROM r WHERE valid GROUP BY ALL) SELECT o.config, o.dataset, round(b.m / o.m, 6) AS speedup FROM m o JOIN m b ON b.config = 2 AND b.dataset = o.dataset WHERE o.config <> 2")
def speedup_vs_baseline(spark, d):
    m = ranks.percentiles(requests(spark, d).where("valid"), ["config", "dataset"], "wall_ms", {"m": 0.5})
    b = m.where("config = 2").select("dataset", F.col("m").alias("b"))
    return m.where("config <> 2").join(b, "dataset").select("config", "dataset", F.round(F.col("b") / F.col("m"), 6).alias("speedup"))


@register(f"""WITH {REQUESTS}, n AS (SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY us, event_id) AS rn FROM r), b AS (SELECT *, min(CASE WHEN NOT valid THEN rn END) OVER (PARTITION BY server_id) AS bad FROM n)
SELECT server_id, count(*) AS n, CAST(max(bad) AS INT) AS first_bad, count(*) FILTER (WHERE valid AND phase = 'timed' AND (bad IS NULL OR rn < bad)) AS valid_timed_before, CASE WHEN max(bad) IS NULL THEN -1 ELSE count(*) FILTER (WHERE valid AND rn > bad) END AS valid_after FROM b GROUP BY server_id""")
def first_bad_request(spark, d):
    return latency.first_bad(requests(spark, d))


@register(f"""WITH {REQUESTS}, n AS (SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY us, event_id) AS a, row_number() OVER (PARTITION BY server_id ORDER BY us DESC, event_id DESC) AS z, count(*) OVER (PARTITION BY server_id) AS n FROM r WHERE wall_ms IS NOT NULL)
SELECT server_id, max(n) AS n, round((median(wall_ms) FILTER (WHERE z <= 10)) - (median(wall_ms) FILTER (WHERE a <= 10)), 6) AS drift FROM n WHERE n >= 20 GROUP BY server_id""")
def memory_drift(spark, d):
    return latency.drift(requests(spark, d), "wall_ms", places=6)


@register(f"""WITH {REQUESTS}, i AS (SELECT event_id, config, us AS t0, us + 3600000000 AS t1 FROM r WHERE event_type = 'signup'), s AS (SELECT us, wall_ms FROM r WHERE event_type <> 'signup'),
j AS (SELECT i.event_id, i.config, max(wall_ms) AS peak, max(CASE WHEN us BETWEEN t0 + 60000000 AND t1 - 60000000 THEN wall_ms END) AS strict_peak, count(*) AS n FROM i JOIN s ON us BETWEEN t0 AND t1 GROUP BY ALL)
SELECT config, count(*) AS intervals, CAST(sum(n) AS BIGINT) AS samples, max(peak) AS peak, max(strict_peak) AS strict_peak, round(median(peak), 6) AS median_peak FROM j GROUP BY config""")
def interval_ram_peak(spark, d):
    r = requests(spark, d)
    i = r.where("event_type = 'signup'").select("event_id", "config", F.col("us").alias("t0"), (F.col("us") + 3_600_000_000).alias("t1"))
    j = latency.samples_in_intervals(i, r.where("event_type <> 'signup'").select("us", "wall_ms"), 3_600_000_000)
    strict = F.when((F.col("us") >= F.col("t0") + 60_000_000) & (F.col("us") <= F.col("t1") - 60_000_000), F.col("wall_ms"))
    per = j.groupBy("event_id", "config").agg(F.max("wall_ms").alias("p"), F.max(strict).alias("s"), F.count("*").alias("n"))
    return per.groupBy("config").agg(F.count("*").alias("intervals"), F.sum("n").alias("samples"), F.max("p").alias("peak"), F.max("s").alias("strict_peak"), F.round(F.median("p"), 6).alias("median_peak"))


@register(f"""WITH {REQUESTS}, a AS (SELECT server_id, sum(CAST(valid AS INT)) OVER (PARTITION BY server_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS island, valid FROM r), g AS (SELECT server_id, island, count(*) AS n FROM a WHERE NOT valid GROUP BY ALL)
SELECT server_id, max(n) AS longest_error_run, count(*) AS error_runs FROM g GROUP BY server_id""")
def error_runs(spark, d):
    return latency.error_runs(requests(spark, d))


@register(f"""WITH {REQUESTS}, a AS (SELECT server_id, us, event_id, valid, row_number() OVER w AS n, sum(CAST(valid AS INT)) OVER w AS ok, count(*) OVER (PARTITION BY server_id) AS total FROM r WINDOW w AS (PARTITION BY server_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING))
SELECT server_id, CAST(n AS INT) AS n, CAST(ok AS BIGINT) AS ok FROM a WHERE n % 25 = 0 OR n = total""")
def running_progress(spark, d):
    return latency.progress(requests(spark, d))


@register(f"WITH {REQUESTS} SELECT event_id, round(us // 3600000000 + (row_number() OVER w - 1) / count(*) OVER (PARTITION BY us // 3600000000), 6) AS t FROM r WINDOW w AS (PARTITION BY us // 3600000000 ORDER BY event_id)")
def subsecond_spread(spark, d):
    """Samples that share a stamp (here an hour) get evenly spread offsets."""
    r = requests(spark, d).withColumn("h", F.floor(F.col("us") / 3_600_000_000))
    w = W.partitionBy("h")
    return r.select("event_id", F.round(F.col("h") + (F.row_number().over(w.orderBy("event_id")) - 1) / F.count("*").over(w), 6).alias("t"))


@register(f"WITH {REQUESTS}, g AS (SELECT dataset, k, config, count(DISTINCT server_id) AS n FROM r GROUP BY ALL) SELECT dataset, k, count(*) FILTER (WHERE n > 1) AS mixed_configs, CAST(max(n) AS BIGINT) AS most FROM g GROUP BY ALL")
def prompt_consistency(spark, d):
    g = requests(spark, d).select("dataset", "k", "config", "server_id").distinct().groupBy("dataset", "k", "config").agg(F.count("*").alias("n"))
    return g.groupBy("dataset", "k").agg(F.count_if(F.col("n") > 1).alias("mixed_configs"), F.max("n").alias("most"))


@register(f"WITH {REQUESTS} SELECT config, count(*) FILTER (WHERE valid) AS n_valid, count(*) FILTER (WHERE wall_ms IS NULL) AS missing, count(*) FILTER (WHERE wall_ms > 100) AS hits, count(*) FILTER (WHERE NOT valid) AS deaths, min(wall_ms) AS least, max(wall_ms) AS most, count(*) = 3 * count(DISTINCT server_id) * count(DISTINCT k) AS complete FROM r GROUP BY config")
def server_counters(spark, d):
    r = requests(spark, d)
    ms = F.col("wall_ms")
    return r.groupBy("config").agg(
        F.count_if("valid").alias("n_valid"), F.count_if(ms.isNull()).alias("missing"), F.count_if(ms > 100).alias("hits"), F.count_if(~F.col("valid")).alias("deaths"), F.min(ms).alias("least"), F.max(ms).alias("most"),
        (F.count("*") == 3 * F.count_distinct("server_id") * F.count_distinct("k")).alias("complete"),
    )


@register(f"WITH {REQUESTS} SELECT server_id, event_id, k, wall_ms FROM (SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY us DESC, event_id DESC) AS i FROM r) WHERE i = 1")
def last_write_wins(spark, d):
    r = requests(spark, d).withColumn("at", F.struct("us", "event_id"))
    return paired.keep_last(r.select("server_id", "at", "event_id", "k", "wall_ms"), ["server_id"], "at").select("server_id", "event_id", "k", "wall_ms")


@register(f"WITH {REQUESTS}, m AS (SELECT server_id, k FROM r WHERE phase = 'timed'), q AS (SELECT server_id, k FROM r WHERE phase = 'timed' AND valid) SELECT server_id, max(k) AS died_at FROM m ANTI JOIN q ON m.server_id = q.server_id AND m.k = q.k GROUP BY server_id")
def inflight_died(spark, d):
    m = requests(spark, d).where("phase = 'timed'")
    return m.select("server_id", "k").join(m.where("valid").select("server_id", "k"), ["server_id", "k"], "left_anti").groupBy("server_id").agg(F.max("k").alias("died_at"))


@register(f"WITH {REQUESTS} SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY server_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS section FROM r")
def carry_forward(spark, d):
    section = ordered.latest(F.when(F.col("event_type") == "signup", F.col("event_id")))
    return ordered.folded(requests(spark, d), ["server_id"], latency.ORDER, {"section": section}).select("event_id", "section")


@register(f"""WITH {REQUESTS}, q AS (SELECT server_id, us, event_type = 'signup' AS opens FROM r WHERE event_type IN ('signup', 'purchase')),
n AS (SELECT *, lead(us) OVER w AS nu, lead(opens) OVER w AS no FROM q WINDOW w AS (PARTITION BY server_id ORDER BY us, opens))
SELECT server_id, us AS t0, CASE WHEN nu <= us + 86400000000 THEN nu ELSE us + 86400000000 END AS t1, coalesce(nu <= us + 86400000000 AND NOT no, false) AS closed FROM n WHERE opens""")
def phase_intervals(spark, d):
    """Intervals from open and close events (here signups and purchases), a day at most."""
    q = requests(spark, d).where("event_type in ('signup', 'purchase')")
    return latency.phase_intervals(q, ["server_id"], F.col("event_type") == "signup", 86_400_000_000)


RESTART_EVERY = 50


@register(f"""WITH {REQUESTS}, n AS (SELECT *, row_number() OVER w AS n FROM r WINDOW w AS (PARTITION BY server_id ORDER BY us, event_id)),
f AS (SELECT *, (n - coalesce(last_value(CASE WHEN k = 7 THEN n END IGNORE NULLS) OVER (PARTITION BY server_id ORDER BY n ROWS UNBOUNDED PRECEDING), 1)) % {RESTART_EVERY} + 1 AS since_restart FROM n),
b AS (SELECT *, sum(CAST(since_restart = 1 AND n > 1 AS INT)) OVER (PARTITION BY server_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS block FROM f)
SELECT event_id, CAST(since_restart AS BIGINT) AS since_restart, CAST(block AS BIGINT) AS block, CAST(sum(CAST(NOT valid AS INT)) OVER (PARTITION BY server_id, block ORDER BY n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS restarts_in_block FROM b""")
def restart_counter(spark, d):
    """Requests since the server's last restart, which comes after fifty of them or where one is sent again (here those with k = 7), and
    the deaths in the block between two restarts."""
    r = requests(spark, d).select("event_id", "us", "server_id", "k", "valid")
    return ordered.restart_counter(r, ["server_id"], latency.ORDER, F.col("k") == 7, ~F.col("valid"), RESTART_EVERY).select("event_id", "since_restart", "block", "restarts_in_block")


@register(f"""WITH {REQUESTS}, q AS (SELECT * EXCLUDE server_id, event_type AS server_id FROM r), a AS (SELECT *, row_number() OVER w AS rn, sum(CAST(valid AS INT)) OVER w AS ok, last_value(CASE WHEN k = 7 THEN event_id END IGNORE NULLS) OVER w AS section FROM q WINDOW w AS (PARTITION BY server_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, CAST(rn AS BIGINT) AS rn, CAST(ok AS BIGINT) AS ok, section FROM a""")
def hot_server_folds(spark, d):
    """Running figures where one of five groups has most of the rows: cut into segments of a few thousand."""
    q = requests(spark, d).withColumn("server_id", F.col("event_type"))
    folds = {"rn": ordered.running(F.lit(1)), "ok": ordered.running(F.col("valid").cast("int")), "section": ordered.latest(F.when(F.col("k") == 7, F.col("event_id")))}
    return ordered.folded(q, ["server_id"], latency.ORDER, folds, per=2000).select("event_id", "rn", "ok", "section")


# selection


@register("SELECT p_partkey, p_brand, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS i FROM part) WHERE i = 1 ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def top_distinct_images(spark, d):
    """The ten largest with different keys: the best of each key by a partial aggregate, then a top-k."""
    best = table(spark, d, "part").groupBy("p_brand").agg(F.max(F.struct("p_retailprice", -F.col("p_partkey"))).alias("b"))
    return best.select((-F.col("b.col2")).alias("p_partkey"), "p_brand", "b.p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10)


@register("""WITH o AS (SELECT p_partkey, p_brand, md5('249|' || p_partkey) AS h FROM part), f AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY h) AS i FROM o)
SELECT p_partkey, CAST(row_number() OVER (ORDER BY h) AS INT) AS place FROM f WHERE i = 1 ORDER BY h LIMIT 20""")
def frozen_sample(spark, d):
    """A seeded sample with different keys, in a stable order."""
    h = F.md5(F.concat(F.lit("249|"), F.col("p_partkey").cast("string")))
    one = table(spark, d, "part").groupBy("p_brand").agg(F.min(F.struct(h.alias("h"), "p_partkey")).alias("b")).orderBy("b.h").limit(20)
    return one.select("b.p_partkey", F.row_number().over(W.orderBy("b.h")).alias("place"))


# texts: replies are built from the ids, so that each parser rule is met

SEPARATOR = chr(0x2028)
REPLY = "CASE doc_id % 10 WHEN 0 THEN chr(65 + CAST(doc_id % 5 AS INT)) WHEN 1 THEN '(' || chr(97 + CAST(doc_id % 5 AS INT)) || ') is it' WHEN 2 THEN '**' || chr(65 + CAST(doc_id % 5 AS INT)) || '.** yes' WHEN 3 THEN 'The answer is (' || chr(65 + CAST(doc_id % 5 AS INT)) || ')' WHEN 4 THEN 'Apple pie' WHEN 5 THEN '<think>maybe A</think>' || chr(65 + CAST(doc_id % 5 AS INT)) WHEN 6 THEN chr(65 + CAST(doc_id % 5 AS INT)) || chr(13) || 'because' WHEN 7 THEN chr(65 + CAST(doc_id % 5 AS INT)) || ' ' || chr(11) || 'so' WHEN 8 THEN 'B" + SEPARATOR + "or C' ELSE '  ' || chr(98) || ' ' END"


def replies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.expr(REPLY.replace("CASE doc_id", "CASE CAST(doc_id AS INT)")).alias("reply"), "text")


@register(rf"""WITH q AS (SELECT doc_id, {REPLY} AS reply FROM documents), t AS (SELECT *, trim(regexp_replace(regexp_replace(reply, '<think>.*?</think>', '', 'gs'), '[*`]', '', 'g')) AS t FROM q),
c AS (SELECT *, [upper(regexp_extract(trim(regexp_extract(t, '^[^\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]*')), '^([A-Za-z])$', 1)), upper(regexp_extract(t, '^\(([A-Za-z])\)', 1)), regexp_extract(t, '^([A-Z])[.):](?:\s|$)', 1), regexp_extract(t, '\b(?i:answer)(?:\s+(?i:is))?\s*[:\-]?\s*\(?([A-Z])\)?(?:[^A-Za-z]|$)', 1)] AS c FROM t)
SELECT doc_id, upper(left(trim(reply), 1)) AS v1, coalesce(list_filter(c, lambda x: x <> '' AND ascii(x) - 65 < 4)[1], '') AS v2 FROM c""")
def parse_letters(spark, d):
    q = replies(spark, d)
    return q.select("doc_id", text.parse_letter_v1(F.col("reply")).alias("v1"), text.parse_letter_v2(F.col("reply"), F.lit(4)).alias("v2"))


@register("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda x: x <> '')[1:4] AS c FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 'Which word?' || chr(10) || chr(10) || array_to_string(list_transform(c, lambda x, i: chr(CAST(64 + i AS INT)) || '. ' || x), chr(10)) || chr(10) || chr(10) || 'Answer with only the letter of the correct choice. Do not explain.' AS prompt FROM w""".replace("\\\\", "\\"))
def mcq_prompt(spark, d):
    c = F.slice(F.array_remove(F.split("text", r"[ \t\n\r]+"), ""), 1, 4)
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.mcq_prompt(F.lit("Which word?"), c).alias("prompt"))


@register(r"""SELECT page_id, CASE WHEN url IS NULL THEN 'missing url' WHEN length(html) = 0 THEN 'empty html' WHEN NOT starts_with(url, 'http') THEN 'relative url' END AS problem, length(html) AS size, CASE WHEN length(html) <= 3 THEN '1-3' WHEN length(html) <= 8 THEN '4-8' WHEN length(html) <= 15 THEN '9-15' ELSE '16+' END AS bucket FROM pages""")
def validate_records(spark, d):
    problem = F.when(F.col("url").isNull(), "missing url").when(F.length("html") == 0, "empty html").when(~F.startswith("url", F.lit("http")), "relative url")
    return table(spark, d, "pages").select("page_id", problem.alias("problem"), F.length("html").cast("long").alias("size"), text.length_bucket(F.length("html")).alias("bucket"))


@register("""SELECT o.o_orderpriority AS grp, count(*) AS n, round(median(l.q / o.o_totalprice), 9) AS med, round(min(l.q / o.o_totalprice), 9) AS lo, round(max(l.q / o.o_totalprice), 9) AS hi, count(*) FILTER (WHERE abs(l.q / o.o_totalprice - 1) <= 0.1) AS near
FROM orders o LEFT JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS q FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey GROUP BY 1""")
def token_ratio(spark, d):
    """Ratios of a looked-up count to a record's own, null where there is none."""
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("q"))
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority").join(l, "o_orderkey", "left")
    r = F.col("r")
    o = o.select(F.col("o_orderpriority").alias("grp"), (F.col("q") / F.col("o_totalprice")).alias("r"))
    g = o.groupBy("grp").agg(F.count("*").alias("n"), F.round(F.min(r), 9).alias("lo"), F.round(F.max(r), 9).alias("hi"), F.count_if(F.abs(r - 1) <= 0.1).alias("near"))
    return ranks.with_median(g, o, ["grp"], "r", "med", 9)


@register("""SELECT l_returnflag AS kind, count(*) FILTER (WHERE l_quantity > l_linenumber * 5) AS over, count(*) FILTER (WHERE l_quantity < l_linenumber * 5) AS under, count(*) FILTER (WHERE abs(l_quantity - l_linenumber * 5) = 1) AS off_by_one FROM lineitem GROUP BY 1""")
def count_error_direction(spark, d):
    gap = F.col("l_quantity") - F.col("l_linenumber") * 5
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("kind")).agg(F.count_if(gap > 0).alias("over"), F.count_if(gap < 0).alias("under"), F.count_if(F.abs(gap) == 1).alias("off_by_one"))


@register(f"WITH {EVAL} SELECT dataset, array_to_string(list_sort(list(idx))[1:3], ',') AS first_three, count(*) AS n FROM e WHERE error IS NOT NULL GROUP BY dataset")
def first_examples(spark, d):
    """The three least ids by a ranked window, which cuts each group before the shuffle, not by collecting groups."""
    bad = eval_long(spark, d).where(paired.failed()).select("dataset", "idx")
    n = bad.groupBy("dataset").agg(F.count("*").alias("n"))
    top = bad.withColumn("i", F.row_number().over(W.partitionBy("dataset").orderBy("idx"))).where("i <= 3")
    three = top.groupBy("dataset").agg(F.array_join(F.transform(F.sort_array(F.collect_list("idx")), lambda x: x.cast("string")), ",").alias("first_three"))
    return three.join(n, "dataset")
