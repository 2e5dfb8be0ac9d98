"""Mixing sources to target weights with hash-threshold histograms.

Every row has a 40-bit hash of its doc_id and text; rows that agree in both are numbered, and the number is hashed too, so
that the copies of a row are taken one by one like any other rows. A source whose target is T words out of S is taken floor(T / S) times
as a whole, and once more for the rows whose hash lies below a threshold. The threshold is found without sorting rows:
words are summed by source and hash bucket (10 bits), the bucket in which the running sum crosses the budget is
found, and only the rows of that bucket are summed again by the next 10 bits, until the bucket is a single hash.

Defined cases: null texts count 0 words, and hash as empty ones; a null source is a source of its own, after all others; rows that share a
doc_id (or a null one) are taken or left by their texts, rows that share both by their numbers; an empty table gives an empty result; a source of
size 0 has target 0 and its rows are taken once; other rows without words are taken as their hash says, at most `max_repeats`
times. At the boundary the hash is taken if that brings the source nearer to its target. Texts are counted whole, whatever their
length; columns of docs may have any other names, none is touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.llm._shared import discard, materialize, n_words, small_side, table

RATIO, WEIGHTS, MAX_REPEATS = 1.5, (5, 2, 1), 2
BITS, LEVELS = 10, 4


def bits_of(text: Column) -> Column:
    """40 bits of a text's MD5, so that any SQL engine can recompute it."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 10), 16, 10).cast("long")


def hash_key(doc_id: Column, text: Column) -> Column:
    return bits_of(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))


def repeated(rows: DataFrame) -> DataFrame:
    """(r_source, r_key) that several rows (source, key) share, written to the shared folder."""
    several = rows.groupBy("source", "key").agg(F.count("*").alias("n")).where("n > 1")
    return materialize(several.select(F.col("source").alias("r_source"), F.col("key").alias("r_key")), "mix-repeated")


def shares(rows: DataFrame, several: DataFrame) -> Column:
    return rows["source"].eqNullSafe(several["r_source"]) & (rows["key"] == several["r_key"])


def told_apart(rows: DataFrame) -> DataFrame:
    """rows (source, key, part, ...) that share a key: the number of a row among its equals goes into its key. They are numbered inside each part that
    they were written by, and moved on by the parts' counts, so no task holds all equals."""
    by = W.partitionBy("source", "key")
    counts = rows.groupBy("source", "key", "part").agg(F.count("*").alias("n"))
    before = counts.select(F.col("source").alias("b_source"), F.col("key").alias("b_key"), F.col("part").alias("b_part"), (F.sum("n").over(by.orderBy("part")) - F.col("n")).alias("before"))
    own = rows.withColumn("number", F.row_number().over(W.partitionBy("source", "key", "part").orderBy("part")) - 1)
    met = own.join(before, own["source"].eqNullSafe(before["b_source"]) & (own["key"] == before["b_key"]) & (own["part"] == before["b_part"]))
    number = F.col("before") + F.col("number")
    key = F.when(number == 0, F.col("key")).otherwise(bits_of(F.concat_ws(":", F.col("key").cast("string"), number.cast("string"))))
    return met.withColumn("key", key).select(*rows.columns)


def targets(sizes: DataFrame, ratio: float = RATIO, weights: tuple[int, ...] = WEIGHTS, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> also weight and target: shares of ratio x all sizes by weight, capped at max_repeats x
    the source's size, the excess reshared by weight. One row a source; closed form of the water-filling: with sources
    ordered by cap / weight, the water level is the first prefix level that does not exceed its own row's cap."""
    by_name, by_cap = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("cap_per_weight", F.col("source").asc_nulls_last())
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights)) + 1))
    rows = rows.withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size")).withColumn("cap_per_weight", F.col("cap") / F.col("weight"))
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    level = (F.lit(float(ratio)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    rows = rows.withColumn("level", level)
    water = F.min_by(F.when(F.col("level") <= F.col("cap_per_weight"), F.col("level")), F.when(F.col("level") <= F.col("cap_per_weight"), F.col("cap_per_weight"))).over(every)
    return rows.withColumn("water", water).select(
        "source", "source_size", "weight", F.coalesce(F.least("cap", F.col("water") * F.col("weight")), F.col("cap")).alias("target")
    )


def thresholds(sized: DataFrame, **plan) -> tuple[DataFrame, int]:
    """sized: (source, size, key). The result has a row for each source: whole copies, the exclusive hash threshold of
    the last copy, target and source_size; and the number of those rows."""
    levels = per = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), **plan), "mix-targets")
    n = per.count()
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    per = per.withColumn("copies", base).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    state = per.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for i in range(LEVELS):
        shift = BITS * (LEVELS - 1 - i)
        last, s = state, state.select(F.col("source").alias("s_source"), "rest", "prefix", "before")
        inside = sized.join(small_side(s, n), sized.source.eqNullSafe(s.s_source) & (F.shiftright("key", shift + BITS) == s.prefix))
        sums = inside.groupBy("source", F.shiftright("key", shift).alias("bucket")).agg(F.sum("size").alias("t"), F.first("rest").alias("rest"), F.first("before").alias("b"))
        upto = F.sum("t").over(W.partitionBy("source").orderBy("bucket"))
        crossing = sums.withColumn("upto", F.col("b") + upto).where("upto > rest")
        state = crossing.groupBy("source").agg(F.min_by(F.struct("rest", "bucket", "upto", "t"), "bucket").alias("x")).select(
            "source", "x.rest", F.col("x.bucket").alias("prefix"), (F.col("x.upto") - F.col("x.t")).alias("before"), F.col("x.t").alias("t")
        )
        state = materialize(state, "mix-level")
        if i:
            discard(per.sparkSession, last)
    nearer = (F.col("before") + F.col("t") - F.col("rest")) < (F.col("rest") - F.col("before"))
    cut = state.select(F.col("source").alias("c_source"), (F.col("prefix") + nearer.cast("long")).alias("below"))
    # nothing is left to take of a source at its cap: no hash is below, or rows without words would be taken once too often
    below = F.when(F.col("rest") <= 0, 0).otherwise(F.coalesce("below", F.lit(1 << (BITS * LEVELS))))
    out = per.join(small_side(cut, n), per.source.eqNullSafe(cut.c_source), "left").select(
        "source", "source_size", "target", "copies", F.when(F.col("source_size") > 0, below).otherwise(F.lit(1 << (BITS * LEVELS))).alias("below")
    )
    out = materialize(out, "mix-cut")
    discard(per.sparkSession, levels, state)
    return out, n


def apply_mix(rows: DataFrame, cut: DataFrame, n: int) -> DataFrame:
    """rows (source, key, ...) with copies (how often the row is taken), source_size and target."""
    c = cut.select(F.col("source").alias("c_source"), "source_size", "target", F.col("copies").alias("base"), "below")
    joined = rows.join(small_side(c, n), rows["source"].eqNullSafe(c["c_source"]))
    return joined.withColumn("copies", F.col("base") + (F.col("key") < F.col("below")).cast("long")).drop("c_source", "base", "below")


def sized_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows (source, size, key, ...) written to the shared folder, with all keys told apart; the keys that had to be, None without any)."""
    sized = materialize(rows.withColumn("part", F.spark_partition_id()), "mix-sized")
    several = repeated(sized)
    n = several.count()
    if not n:
        return sized, None
    met = small_side(several, n)
    apart = told_apart(sized.join(met, shares(sized, several), "left_semi"))
    return materialize(sized.join(met, shares(sized, several), "left_anti").unionByName(apart), "mix-apart"), several


def mix(docs: DataFrame, **plan) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of docs (doc_id, source, text)."""
    sized, _ = sized_rows(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), hash_key(F.col("doc_id"), F.col("text")).alias("key")))
    cut, n = thresholds(sized, **plan)
    return apply_mix(sized, cut, n).select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **plan) -> DataFrame:
    """The rows of docs, all their columns, each as often as the mix takes it. Rows that share id and text are written down to be numbered;
    all others stay where they are read."""
    names = docs.columns
    held = docs.toDF(*[f"in{i}" for i in range(len(names))])
    doc_id, source, text = (F.col(f"in{names.index(c)}") for c in ("doc_id", "source", "text"))
    marked = held.withColumns({"source": source, "key": hash_key(doc_id, text)})
    sized, several = sized_rows(marked.select("source", n_words(text).alias("size"), "key"))
    cut, n = thresholds(sized, **plan)
    if several is not None:
        met = small_side(several, several.count())
        equal = materialize(marked.join(met, shares(marked, several), "left_semi").withColumn("part", F.spark_partition_id()), "mix-equal")
        marked = marked.join(met, shares(marked, several), "left_anti").unionByName(told_apart(equal).drop("part"))
    out = apply_mix(marked, cut, n).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(*held.columns).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH hashed AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 10) AS BIGINT) AS plain
  FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source, plain) - 1 AS copy FROM hashed),
sized AS (SELECT doc_id, source, size, CASE copy WHEN 0 THEN plain ELSE CAST('0x' || substr(md5(plain || ':' || copy), 1, 10) AS BIGINT) END AS key FROM numbered),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM per),
capped AS (SELECT *, 2.0::DOUBLE * source_size AS cap, (2.0::DOUBLE * source_size) / weight AS cap_per_weight FROM weighed),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM capped WINDOW w AS (ORDER BY cap_per_weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT arg_min(level, cap_per_weight) AS water FROM levels WHERE level <= cap_per_weight),
goal AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies
  FROM (SELECT source, source_size, least(cap, water * weight) AS target FROM levels, water)),
running AS (
  SELECT s.*, g.source_size, g.target, g.copies, g.target - g.copies * g.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key RANGE UNBOUNDED PRECEDING) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.key) AS t
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
cut AS (
  SELECT source, min(key) FILTER (WHERE upto > rest) AS at_key FROM running GROUP BY source),
nearer AS (
  SELECT DISTINCT r.source, CASE WHEN r.upto - r.rest < r.rest - (r.upto - r.t) THEN r.key + 1 ELSE r.key END AS below
  FROM running r JOIN cut c ON r.source IS NOT DISTINCT FROM c.source AND r.key = c.at_key)
SELECT r.doc_id, r.size, r.source_size, r.target,
       CAST((r.copies + CASE WHEN r.key < coalesce(n.below, 1099511627776) THEN 1 ELSE 0 END) * r.size AS BIGINT) AS taken
FROM running r LEFT JOIN nearer n ON r.source IS NOT DISTINCT FROM n.source
"""
