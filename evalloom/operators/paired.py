"""Accuracy, pairing and exclusion operators over evaluation rows (config, dataset, idx, task, gt, predicted, error)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.stats import mcnemar_exact

def failed() -> Column:
    """Null and empty both mean that there was no error."""
    return F.coalesce(F.col("error"), F.lit("")) != ""



def pct(x: Column) -> Column:
    """Per cent of the mean of 0/1 values, in a form every engine rounds alike."""
    return F.round(100.0 * F.sum(x) / F.count(x), 6)


def points(rows: DataFrame) -> Column:
    """A row's score, null for a failed one; rows without a column of scores are right where predicted equals gt."""
    score = F.col("score").cast("double") if "score" in rows.columns else (F.col("predicted") == F.col("gt")).cast("int")
    return F.when(~failed(), score)


def accuracy(rows: DataFrame, *keys: str) -> DataFrame:
    hit = points(rows)
    return rows.groupBy(*keys).agg(pct(hit).alias("accuracy_pct"), F.count(hit).alias("n_valid"), F.count_if(failed()).alias("n_error"))


def run_metrics(rows: DataFrame, *keys: str) -> DataFrame:
    hit = points(rows)
    total, summed = F.count("*"), F.coalesce(F.sum(hit), F.lit(0))
    return rows.groupBy(*keys).agg(
        total.alias("attempted"), F.count(hit).alias("answered"), F.count_if(failed()).alias("errors"), (F.round(summed, 6) if "score" in rows.columns else summed).alias("score_sum"),
        F.round(summed / total, 6).alias("score_raw"), F.round(F.try_divide(F.sum(hit), F.count(hit)), 6).alias("score_answered"),
    )


def pair_with_base(valid: DataFrame, base: int) -> DataFrame:
    """Every other config's valid rows beside the baseline's, on (dataset, idx): the few rows of a record meet in one aggregate, so the
    log is read and shuffled once."""
    rest = [c for c in valid.columns if c not in ("dataset", "idx")]
    first = F.col("config") == base
    met = valid.groupBy("dataset", "idx").agg(F.max(F.when(first, F.struct("score", "predicted"))).alias("_b"), F.collect_list(F.when(~first, F.struct(*rest))).alias("_o"))
    pairs = met.where(F.col("_b").isNotNull()).select("dataset", "idx", F.col("_b.score").alias("base_score"), F.col("_b.predicted").alias("base_predicted"), F.explode("_o").alias("_r"))
    return pairs.select("dataset", "idx", *[F.col(f"_r.{c}").alias(c) for c in rest], "base_score", "base_predicted")


def pairs_of_runs(valid: DataFrame, wanted: Sequence[tuple[int, int]]) -> DataFrame:
    """A row for each record and each wanted (baseline, other) whose runs both have it: baseline, other, the record's columns as in the
    baseline's run, base_score and score, base_predicted and predicted. The few rows of a record meet in one aggregate, whatever the
    number of baselines, and pairs are made inside it."""
    own = [c for c in valid.columns if c not in ("dataset", "idx", "config", "score", "predicted")]
    runs = F.map_from_entries(F.collect_list(F.struct("config", F.struct("score", "predicted", *own))))  # one a config
    met = valid.groupBy("dataset", "idx").agg(runs.alias("_runs"))
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in wanted])).alias("_p")
    x, y = (F.try_element_at("_runs", F.col(f"_p.{k}")) for k in "ab")
    out = met.select("dataset", "idx", "_runs", pairs).select("dataset", "idx", "_p", x.alias("_x"), y.alias("_y")).where("_x is not null and _y is not null")
    each = {"baseline": "_p.a", "other": "_p.b"} | {c: f"_x.{c}" for c in own} | {"base_score": "_x.score", "score": "_y.score", "base_predicted": "_x.predicted", "predicted": "_y.predicted"}
    return out.select("dataset", "idx", *[F.col(x).alias(c) for c, x in each.items()])


def paired_delta(pairs: DataFrame, *keys: str) -> DataFrame:
    """Mean difference in points; worse, better and the exact p only where all scores are 0 or 1."""
    s, b = F.col("score"), F.col("base_score")
    binary = F.bool_and(s.isin(0, 1) & b.isin(0, 1))
    out = pairs.groupBy(*keys).agg(
        F.count("*").alias("n_paired"), pct(b).alias("base_acc_pct"), pct(s).alias("acc_pct"), F.round(100.0 * F.sum(s - b) / F.count("*"), 6).alias("delta_pts"), binary.alias("_binary"),
        F.count_if((b == 1) & (s == 0)).alias("_worse"), F.count_if((b == 0) & (s == 1)).alias("_better"),
    )
    only = lambda x: F.when(F.col("_binary"), x)
    return out.select(*keys, "n_paired", "base_acc_pct", "acc_pct", "delta_pts", only(F.col("_worse")).alias("worse"), only(F.col("_better")).alias("better"), only(F.round(mcnemar_exact(F.col("_worse"), F.col("_better")), 6)).alias("p_mcnemar"))


def no_placeholders(rows: DataFrame) -> DataFrame:
    """rows; one of a record that was never tried raises, as the run is not complete."""
    stop = F.raise_error(F.concat(F.lit("never tried: record "), F.col("idx").cast("string"))).cast("string")
    return rows.withColumn("error_type", F.when(F.col("error_type") == "ServerUnavailable", stop).otherwise(F.col("error_type")))


def excluded_ids(rows: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """(dataset, idx) of records with an error in any config, and of those that error files (dataset, idx) name."""
    bad = rows.where(failed()).select("dataset", "idx")
    return (bad if errors is None else bad.unionByName(errors.select("dataset", "idx"))).distinct()


def set_differences(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Keys that only one of two sets holds, and in which it is: one aggregate, no sides of a join."""
    both = a.select(*keys, F.lit(1).alias("_s")).union(b.select(*keys, F.lit(2).alias("_s")))
    return both.groupBy(*keys).agg(F.bit_or("_s").alias("_s")).where("_s < 3").select(*keys, F.when(F.col("_s") == 1, "first").otherwise("second").alias("only_in"))


def matched(rows: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Rows of records that have no error in any config, nor in the error files (dataset, idx)."""
    return rows.join(excluded_ids(rows, errors), ["dataset", "idx"], "left_anti")


def accounting(rows: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Per dataset: n_total, n_excluded and n_matched records, how many of the excluded have an error of their own (from_error_field) or are named by
    error files only (from_error_files_only), and errors_by_config (map of config to its failed records). Records that no run has don't count."""
    bad = F.when(failed(), F.col("config"))
    per = rows.groupBy("dataset", "idx").agg(F.collect_set("config").alias("_runs"), F.collect_set(bad).alias("_bad"))  # one config each
    if errors is not None:
        named = errors.select("dataset", "idx").distinct().withColumn("_named", F.lit(True))
        per = per.join(named, ["dataset", "idx"], "left")
    else:
        per = per.withColumn("_named", F.lit(None).cast("boolean"))
    own, named = F.size("_bad") > 0, F.coalesce("_named", F.lit(False))
    n = per.groupBy("dataset").agg(
        F.count("*").alias("n_total"), F.count_if(own | named).alias("n_excluded"), F.count_if(~own & ~named).alias("n_matched"), F.count_if(own).alias("from_error_field"), F.count_if(~own & named).alias("from_error_files_only"),
    )
    runs = rows.groupBy("dataset", "config").agg(F.count_if(failed()).alias("_n"))
    by_config = runs.groupBy("dataset").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("config", "_n")))).alias("errors_by_config"))  # one row a config
    return n.join(by_config, "dataset")


def error_sets(rows: DataFrame, strict: Sequence[str] = (), allow: bool = False) -> DataFrame:
    """Per dataset and config: whether its failed records are those of the dataset's first config: n_errors, only_here, only_first and status (ok,
    warning). In a dataset of strict the runs are taken to fail alike: there a difference raises when the rows are used, unless allow."""
    runs = rows.groupBy("dataset").agg(F.array_sort(F.collect_set("config")).alias("_runs"))  # the configs of a dataset
    bad = rows.where(failed()).groupBy("dataset", "idx").agg(F.collect_set("config").alias("_bad"))
    every = runs.join(bad, "dataset", "left").select("dataset", F.element_at("_runs", 1).alias("_first"), F.explode("_runs").alias("config"), F.coalesce("_bad", F.array().cast(runs.schema["_runs"].dataType)).alias("_bad"))
    here, first = F.array_contains("_bad", F.col("config")), F.array_contains("_bad", F.col("_first"))
    out = every.groupBy("dataset", "config").agg(F.count_if(here).alias("n_errors"), F.count_if(here & ~first).alias("only_here"), F.count_if(first & ~here).alias("only_first"))
    stop = F.raise_error(F.concat_ws(" ", F.lit("the failed records differ between runs of"), "dataset", F.lit("in config"), F.col("config").cast("string"))).cast("string")
    odd = F.when(F.lit(not allow) & F.col("dataset").isin(*strict), stop).otherwise("warning") if strict else F.lit("warning")
    return out.withColumn("status", F.when(F.col("only_here") + F.col("only_first") > 0, odd).otherwise("ok"))


def macro_average(figures: DataFrame, *keys: str) -> DataFrame:
    """The mean of answered scores over the complete datasets of a run, where there are more than one. figures: a row a dataset with score_answered and complete."""
    whole = figures.where(F.col("complete") & F.col("score_answered").isNotNull())
    return whole.groupBy(*keys).agg(F.round(F.avg("score_answered"), 6).alias("macro"), F.count("*").alias("n_datasets")).where("n_datasets > 1")


def count_direction(pairs: DataFrame, value: Column, base_value: Column, truth: Column, *keys: str) -> DataFrame:
    """How counts go wrong where only one of two runs is right, by the sign of the other's error. pairs: score and base_score; value, base_value, truth: the
    numbers behind both predictions and the ground truth, null where there is none. lost doesn't count the unparsed ones, gained does."""
    lost, gained = F.col("base_score") > F.col("score"), F.col("base_score") < F.col("score")
    gap, base_gap = value - truth, base_value - truth
    n = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    return pairs.groupBy(*keys).agg(
        n(lost & gap.isNotNull()).alias("lost"), n(lost & gap.isNull()).alias("unparsed"), n(lost & (gap > 0)).alias("over"), n(lost & (gap <= 0)).alias("under"), n(lost & (F.abs(gap) == 1)).alias("off_by_one"),
        n(gained).alias("gained"), n(gained & (base_gap > 0)).alias("base_over"), n(gained & (base_gap <= 0)).alias("base_under"),
    )


def keep_last(rows: DataFrame, keys: list[str], order: str, last: bool = True) -> DataFrame:
    """Last (or first) write wins by key, without sorting a key's rows: the row with the extreme order value."""
    pick = F.max_by if last else F.min_by
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(pick(F.struct(*others), order).alias("_r")).select(*keys, "_r.*")
