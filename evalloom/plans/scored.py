"""Registered queries of the scored-row path: answers normalised and scored, rows built and checked, runs summed up, records selected."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.functions import scoring, text
from evalloom.operators import latency, ordered, metrics, paired
from evalloom.plans.catalog import register
from evalloom.plans.workload import REQUESTS, requests, table

# Answers are made of a document's own words: one of the first five, dressed in seven ways of which some mean the same.

WORD = r"(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r]+'), lambda x: x <> '') || ['', '', '', '', ''])[1 + CAST(doc_id % 5 AS INT)]"
WAYS = ("{w}", "'the ' || {w}", "{w} || '.'", "'\"' || {w} || '\"?'", "{w} || ' , 2'", "'Two ' || {w}", "'dont ' || {w} || chr(10) || 'an'")


def way_sql(word: str, k: str) -> str:
    return f"CASE CAST(({k}) % {len(WAYS)} AS INT) " + " ".join(f"WHEN {i} THEN {x.format(w=word)}" for i, x in enumerate(WAYS)) + " END"


def dressed(word, k):
    ways = [word, F.concat(F.lit("the "), word), F.concat(word, F.lit(".")), F.concat(F.lit('"'), word, F.lit('"?')), F.concat(word, F.lit(" , 2")), F.concat(F.lit("Two "), word), F.concat(F.lit("dont "), word, F.lit("\nan"))]
    return F.element_at(F.array(*ways), (k % len(ways) + 1).cast("int"))


def asked(spark, d):
    """(doc_id, lang, word, answers): ten answers a document."""
    words = F.concat(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\r]+"), ""), F.array_repeat(F.lit(""), 5))
    docs = table(spark, d, "documents").select("doc_id", "lang", F.get(words, (F.col("doc_id") % 5).cast("int")).alias("word"))
    return docs.withColumn("answers", F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: dressed(F.col("word"), F.col("doc_id") + i * i)))


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: The normalisation in SQL: a fold over the marks that looks at the whole string, then periods, number words, articles, contractions.
MARKS_SQL = "[" + ", ".join(map(quoted, text.MARKS)) + "]"
NUMBERS_SQL, FULL_SQL = ("MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in x.items()) + "}" for x in (text.NUMBERS, text.CONTRACTIONS))


def normal_sql(rows: str, keep: str, out: str) -> str:
    """SQL that gives rows (keep, x) with the normalised form of x as `out`."""
    return f"""(SELECT {keep}, array_to_string(list_transform(list_filter(list_transform(list_filter(string_split_regex(bare, '\\s+'), lambda w: w <> ''), lambda w: coalesce({NUMBERS_SQL}[w], w)), lambda w: w NOT IN ('a', 'an', 'the')), lambda w: coalesce({FULL_SQL}[w], w)), ' ') AS {out}
  FROM (SELECT {keep}, regexp_replace(regexp_replace(list_reduce(list_prepend(t, {MARKS_SQL}), lambda acc, m: CASE WHEN contains(t, m || ' ') OR contains(t, ' ' || m) OR regexp_matches(t, '[0-9],[0-9]') THEN replace(acc, m, '') ELSE replace(acc, m, ' ') END), '\\.([^0-9.])', '\\1', 'g'), '\\.+$', '') AS bare
  FROM (SELECT {keep}, trim(replace(replace(trim(replace(replace(replace(lower(x), ',', ''), '?', ''), '''s', ' ''s'), ' ' || chr(9) || chr(10) || chr(13)), chr(10), ' '), chr(9), ' ')) AS t FROM {rows})))"""


ASKED = f"""q AS (SELECT doc_id, lang, {WORD} AS w FROM documents),
a AS (SELECT doc_id, lang, w, CAST(unnest(range(1, 11)) AS INT) AS i FROM q),
n AS {normal_sql(f"(SELECT doc_id, {way_sql('w', 'doc_id + i * i')} AS x FROM a)", "doc_id", "g")}"""


def soft_sql(k: str, name: str) -> str:
    return f"""{name} AS (SELECT doc_id, any_value(lang) AS lang, any_value(p) AS p, CAST(count(*) FILTER (WHERE n.g = z.p) AS DOUBLE) AS m FROM {normal_sql(f"(SELECT doc_id, lang, {way_sql('w', k)} AS x FROM q)", "doc_id, lang", "p")} z JOIN n USING (doc_id) GROUP BY doc_id),
{name}s AS (SELECT doc_id, lang, p, (m * least(1.0, (m - 1) / 3) + (10 - m) * least(1.0, m / 3)) / 10 AS score FROM {name})"""


def soft_scores(spark, d, k, name):
    q = asked(spark, d).withColumn("said", dressed(F.col("word"), k))
    # an alias called like an input column would be what lambdas see under that name
    return q.select("doc_id", "lang", text.normalize_answer(F.col("said")).alias("normalized"), scoring.vqa_score(F.col("said"))["score"].alias(name))


@register(f"WITH {ASKED}, {soft_sql('doc_id', 's')} SELECT doc_id, p AS normalized, round(score, 6) AS score FROM ss")
def soft_vqa_score(spark, d):
    """A document's words as answers with articles, marks, number words and contractions: normalised, and scored against ten."""
    return soft_scores(spark, d, F.col("doc_id"), "score").select("doc_id", "normalized", F.round("score", 6).alias("score"))


@register(f"""WITH {ASKED}, {soft_sql('doc_id', 's')}, {soft_sql('doc_id * 3 + 1', 't')}
SELECT ss.lang AS dataset, count(*) AS n_paired, round(100.0 * sum(ss.score) / count(*), 6) AS base_acc_pct, round(100.0 * sum(ts.score) / count(*), 6) AS acc_pct, round(100.0 * sum(ts.score - ss.score) / count(*), 6) AS delta_pts,
  NOT bool_and(ss.score IN (0, 1) AND ts.score IN (0, 1)) AS soft FROM ss JOIN ts USING (doc_id) GROUP BY ss.lang""")
def soft_paired_delta(spark, d):
    """Two runs with soft scores: the mean difference, which no count of better and worse records gives."""
    b = soft_scores(spark, d, F.col("doc_id"), "base_score").drop("normalized")
    o = soft_scores(spark, d, F.col("doc_id") * 3 + 1, "score").select("doc_id", "score")
    return paired.paired_delta(b.join(o, "doc_id").withColumnRenamed("lang", "dataset"), "dataset").select("dataset", "n_paired", "base_acc_pct", "acc_pct", "delta_pts", F.col("p_mcnemar").isNull().alias("soft"))


# Result rows: a document asks for a letter, its reply is one of seven, some requests fail, some were never sent.

LETTER = "chr(65 + CAST(doc_id % 5 AS INT))"
REPLY = f"CASE doc_id % 7 WHEN 0 THEN {LETTER} WHEN 1 THEN '(' || lower({LETTER}) || ') it is' WHEN 2 THEN '**' || {LETTER} || '.** yes' WHEN 3 THEN 'The answer is (' || {LETTER} || ')' WHEN 4 THEN 'Apple' WHEN 5 THEN '' ELSE ' b ' END"
PARSED = "CASE WHEN doc_id % 7 IN (0, 1, 2, 3) THEN CASE WHEN doc_id % 5 < 4 THEN chr(65 + CAST(doc_id % 5 AS INT)) ELSE '' END WHEN doc_id % 7 = 6 THEN 'B' ELSE '' END"
FIRST = f"CASE doc_id % 7 WHEN 0 THEN {LETTER} WHEN 1 THEN '(' WHEN 2 THEN '*' WHEN 3 THEN 'T' WHEN 4 THEN 'A' WHEN 5 THEN '' ELSE 'B' END"
LINES = f"""b AS (SELECT doc_id, lang, CASE WHEN doc_id % 29 = 3 THEN 'HTTP Error 500' WHEN doc_id % 31 = 5 THEN 'server down' END AS error, CASE WHEN doc_id % 29 = 3 THEN 'HTTPError' WHEN doc_id % 31 = 5 THEN 'ServerUnavailable' END AS error_type,
  chr(65 + CAST(doc_id % 4 AS INT)) AS gt, {PARSED} AS v2, {FIRST} AS v1 FROM documents),
l AS (SELECT doc_id AS idx, lang, error, error_type, gt AS gt_answer, CASE WHEN error IS NULL THEN v2 ELSE '' END AS predicted, CASE WHEN error IS NULL THEN v1 ELSE '' END AS pred_parser_v1, CASE WHEN error IS NULL THEN CAST(v2 = gt AS DOUBLE) END AS score,
  CASE WHEN error IS NULL THEN v2 = gt END AS correct, CASE WHEN error IS NULL AND doc_id % 3 > 0 THEN doc_id % 3 * 8.5 ELSE 0.0 END AS tok_s, doc_id % 17 = 0 AS retried FROM b)"""


def lines(spark, d):
    """Result rows of the documents as multiple-choice records, built from JSON responses."""
    i = F.col("doc_id")
    reply = F.expr(REPLY.replace("CASE doc_id", "CASE CAST(doc_id AS INT)"))
    body = F.to_json(F.struct(F.array(F.struct(F.struct(reply.alias("content")).alias("message"), F.lit("stop").alias("finish_reason"))).alias("choices"), F.struct(F.when(i % 3 > 0, (i % 3) * 8.5).alias("predicted_per_second")).alias("timings")))
    records = table(spark, d, "documents").select(
        i.alias("idx"), i.alias("rec_no"), "lang", F.lit("Which?").alias("question"), F.array(*map(F.lit, "wxyz")).alias("choices"), F.element_at(F.array(*map(F.lit, ("0", "(b)", " C ", "3"))), (i % 4 + 1).cast("int")).alias("answer"), body.alias("response"),
        F.when(i % 29 == 3, "HTTP Error 500").when(i % 31 == 5, "server down").alias("error"), F.when(i % 29 == 3, "HTTPError").when(i % 31 == 5, "ServerUnavailable").alias("error_type"), (i % 17 == 0).alias("retried"), F.lit(None).cast("long").alias("mem_avail_mb"),
    )
    return scoring.built_lines(records, "scienceqa", "F16")


@register(f"WITH {LINES} SELECT idx, predicted, predicted AS prediction_normalized, pred_parser_v1, predicted AS pred_parser_v2, score, correct, gt_answer, tok_s, error, error_type, CASE WHEN error IS NULL THEN 'stop' END AS finish_reason FROM l")
def built_lines(spark, d):
    return lines(spark, d).select("idx", "predicted", "prediction_normalized", "pred_parser_v1", "pred_parser_v2", "score", "correct", "gt_answer", "tok_s", "error", "error_type", "finish_reason")


@register(f"""WITH {LINES}, t AS (SELECT *, coalesce(error_type, '') <> 'ServerUnavailable' AS tried, error IS NULL AS ok FROM l)
SELECT lang AS dataset, 'accuracy' AS metric, count(*) AS target, count(*) FILTER (WHERE tried) AS total, count(*) FILTER (WHERE NOT tried) AS pending, count(*) FILTER (WHERE NOT tried) AS placeholders, count(*) FILTER (WHERE tried) >= count(*) AS complete,
  CASE WHEN bool_and(tried) THEN 'complete' WHEN NOT bool_or(tried) THEN 'not attempted' ELSE 'partial' END AS status, count(*) FILTER (WHERE ok) AS answered, count(*) FILTER (WHERE tried AND NOT ok) AS errors, count(*) FILTER (WHERE tried AND retried) AS retries,
  count(*) FILTER (WHERE ok AND predicted = '') AS unparsed, count(*) FILTER (WHERE ok AND correct) AS correct, round(coalesce(sum(score), 0.0), 4) AS score_sum, round(sum(score) / nullif(count(*) FILTER (WHERE tried), 0), 9) AS score_raw,
  round(sum(score) / nullif(count(*) FILTER (WHERE ok), 0), 9) AS score_answered, round(coalesce(avg(CASE WHEN ok AND tok_s > 0 THEN tok_s END), 0.0), 1) AS avg_tok_s, count(*) FILTER (WHERE ok AND pred_parser_v1 <> predicted) AS parser_disagreements FROM t GROUP BY lang""")
def run_figures(spark, d):
    out = metrics.run_figures(lines(spark, d), "mcq", "lang").withColumnRenamed("lang", "dataset")
    return out.withColumns({c: F.round(c, 9) for c in ("score_raw", "score_answered")})


@register(f"WITH {LINES} SELECT lang AS dataset, round(100.0 * sum(s) / count(s), 6) AS accuracy_pct, count(s) AS n_valid FROM (SELECT lang, CASE WHEN idx % 2 = 0 THEN score ELSE CAST(correct AS DOUBLE) END AS s FROM l WHERE error IS NULL) GROUP BY lang")
def legacy_scores(spark, d):
    """Accuracy over rows with a score and older rows with only `correct`."""
    rows = lines(spark, d).where(F.col("error").isNull()).withColumns({"score": F.when(F.col("idx") % 2 == 0, F.col("score")), "correct": F.when(F.col("idx") % 2 == 1, F.col("correct"))})
    return rows.groupBy(F.col("lang").alias("dataset")).agg(paired.pct(scoring.record_score()).alias("accuracy_pct"), F.count("*").alias("n_valid"))


@register("""WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN [] ELSE ['i.png'] END AS image_paths, CASE WHEN p_partkey % 17 = 0 THEN [] WHEN p_partkey % 19 = 0 THEN NULL ELSE ['x', 'y'][1 : 1 + p_size % 2] END AS choices,
  CASE WHEN p_partkey % 23 = 0 THEN 'open_vqa' WHEN p_partkey % 3 = 0 THEN 'mcq' END AS format, CASE p_partkey % 4 WHEN 0 THEN '(A)' WHEN 1 THEN 'b' WHEN 2 THEN '1' ELSE 'maybe' END AS answer, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 99 END AS place FROM part)
SELECT p_partkey AS idx, CASE WHEN image_paths IS NULL THEN 'missing field ''image_paths''' WHEN choices IS NULL THEN 'missing field ''choices''' WHEN len(image_paths) = 0 THEN 'empty image_paths' WHEN len(choices) = 0 THEN 'empty choices' WHEN format = 'open_vqa' THEN 'record format open_vqa is not mcq'
  WHEN place > len(choices) THEN 'ground truth ' || answer || ' is outside the ' || CAST(len(choices) AS VARCHAR) || ' choices' END AS problem FROM r""")
def record_problems(spark, d):
    """What is wrong with each of a dataset's records, first things first."""
    k = F.col("p_partkey")
    none = F.array().cast("array<string>")
    records = table(spark, d, "part").select(
        k.alias("idx"), F.lit("Which?").alias("question"), F.when(k % 13 == 0, None).when(k % 11 == 0, none).otherwise(F.array(F.lit("i.png"))).alias("image_paths"),
        F.when(k % 17 == 0, none).when(k % 19 == 0, None).otherwise(F.slice(F.array(F.lit("x"), F.lit("y")), F.lit(1), F.col("p_size") % 2 + 1)).alias("choices"),
        F.when(k % 23 == 0, "open_vqa").when(k % 3 == 0, "mcq").alias("format"), F.when(k % 4 == 0, "(A)").when(k % 4 == 1, "b").when(k % 4 == 2, "1").otherwise("maybe").alias("answer"),
    )
    return records.select("idx", scoring.record_problem(records, scoring.DATASETS["scienceqa"]).alias("problem"))


@register("SELECT p_partkey AS idx, p_brand || '/' || p_name AS choices, CASE WHEN p_partkey % 2 = 0 THEN '(B)' ELSE '(A)' END AS answer, true AS swapped FROM part")
def swapped_records(spark, d):
    records = table(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.array("p_name", "p_brand").alias("choices"), F.when(F.col("p_partkey") % 2 == 0, " (A)").otherwise("(B) ").alias("answer"))
    return scoring.swapped(records).withColumn("choices", F.array_join("choices", "/"))


@register("""WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE role IS NOT NULL), f AS (SELECT conv_id, role, max(text) FILTER (WHERE turn < 2) AS old, max(text) FILTER (WHERE turn >= 2) AS new FROM m GROUP BY ALL)
SELECT conv_id, count(*) FILTER (WHERE old IS DISTINCT FROM new) AS n, coalesce(string_agg(role || ': ' || coalesce(left(old, 9), 'null') || ' -> ' || coalesce(left(new, 9), 'null'), '; ' ORDER BY role) FILTER (WHERE left(old, 9) IS DISTINCT FROM left(new, 9)), '') AS changed FROM f GROUP BY conv_id""")
def settings_diff(spark, d):
    """Two maps of settings, here the early and the late texts of each role: the keys of either whose values differ."""
    m = table(spark, d, "conversations").where("role is not null").withColumn("text", F.coalesce("text", F.lit("")))
    f = m.groupBy("conv_id", "role").agg(F.max(F.when(F.col("turn") < 2, F.col("text"))).alias("old"), F.max(F.when(F.col("turn") >= 2, F.col("text"))).alias("new"))

    def settings(c: str, value):
        return F.map_from_entries(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("role", value.alias("value")))))  # one entry a role

    whole, short = ([settings(c, f_(F.col(c))).alias(n) for c, n in zip(("old", "new"), names, strict=True)] for f_, names in ((lambda x: x, ("a", "b")), (lambda x: F.left(x, F.lit(9)), ("x", "y"))))
    g = f.groupBy("conv_id").agg(*whole, *short)
    return g.select("conv_id", F.size(scoring.fingerprint_diff(F.col("a"), F.col("b"))).cast("long").alias("n"), F.array_join(scoring.fingerprint_diff(F.col("x"), F.col("y")), "; ").alias("changed"))


# latency, whole: valid requests, those that were sent again, times of prompt and answer

WHOLE = REQUESTS.strip() + """,
w AS (SELECT *, coalesce(http = 200 AND reply IS NOT NULL, false) AS fine FROM (SELECT *, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS http, CASE WHEN k % 13 > 0 THEN 'ok' END AS reply, k % 11 = 0 AS retried, CASE WHEN k % 5 > 0 THEN wall_ms / 4 END AS prompt_ms, CASE WHEN k % 7 > 0 THEN k END AS predicted_n FROM r))"""


def whole_log(spark, d):
    k = F.col("k")
    r = requests(spark, d).withColumns({"http": F.when(F.col("event_type") == "error", 500).otherwise(200), "error": F.lit(""), "reply": F.when(k % 13 > 0, "ok"), "retried": k % 11 == 0, "prompt_ms": F.when(k % 5 > 0, F.col("wall_ms") / 4), "predicted_n": F.when(k % 7 > 0, k)})
    return r.withColumn("valid", latency.valid_request())


@register(f"""WITH {WHOLE}, g AS (SELECT *, coalesce(fine AND NOT retried, false) AS good FROM w WHERE phase = 'timed')
SELECT config, dataset, count(*) FILTER (WHERE good) AS n_valid, count(*) FILTER (WHERE NOT good) AS n_invalid, round(quantile_cont(wall_ms, 0.25) FILTER (WHERE good), 6) AS p25, round(quantile_cont(wall_ms, 0.5) FILTER (WHERE good), 6) AS median,
  round(quantile_cont(wall_ms, 0.75) FILTER (WHERE good), 6) AS p75, round(quantile_cont(wall_ms, 0.95) FILTER (WHERE good), 6) AS p95, round(median(prompt_ms) FILTER (WHERE good), 6) AS prompt_ms_med, round(median(predicted_n) FILTER (WHERE good), 6) AS gen_tokens_med FROM g GROUP BY ALL""")
def latency_whole(spark, d):
    return latency.summary(whole_log(spark, d).where("phase = 'timed'"), "config", "dataset")


@register(f"WITH {WHOLE} SELECT config, count(*) FILTER (WHERE event_type = 'error') AS deaths, count(*) FILTER (WHERE retried AND fine) AS retried_valid, count(*) FILTER (WHERE retried AND NOT fine) AS skipped, count(*) FILTER (WHERE fine AND prompt_ms IS NULL) AS no_prompt_ms, count(*) FILTER (WHERE wall_ms > 300) AS timed_out FROM w GROUP BY config")
def retry_counters(spark, d):
    w = whole_log(spark, d)
    return w.groupBy("config").agg(
        F.count_if(F.col("event_type") == "error").alias("deaths"), F.count_if(F.col("retried") & F.col("valid")).alias("retried_valid"), F.count_if(F.col("retried") & ~F.col("valid")).alias("skipped"),
        F.count_if(F.col("valid") & F.col("prompt_ms").isNull()).alias("no_prompt_ms"), F.count_if(F.col("wall_ms") > 300).alias("timed_out"),
    )


# selection and lookups


@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25")
def head_in_order(spark, d):
    """The first records of a file, by their numbers."""
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(25)


def seeded(key: str, seed: int = 249):
    """The order that a seed gives to records: by hash, the same in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


@register("""WITH big AS (SELECT p_brand, max(p_retailprice) AS m FROM part GROUP BY 1 ORDER BY m DESC, p_brand LIMIT 5), one AS (SELECT p_brand, min(md5('249|' || p_partkey) || '|' || p_partkey) AS h FROM part WHERE p_brand NOT IN (SELECT p_brand FROM big) GROUP BY 1)
SELECT CAST(string_split(h, '|')[2] AS BIGINT) AS p_partkey, p_brand FROM one ORDER BY h LIMIT 12""")
def disjoint_remainder(spark, d):
    """A seeded sample of records with different images, none of them among the largest."""
    part = table(spark, d, "part")
    big = part.groupBy("p_brand").agg(F.max("p_retailprice").alias("m")).orderBy(F.desc("m"), "p_brand").limit(5).select("p_brand")
    one = part.join(F.broadcast(big), "p_brand", "left_anti").groupBy("p_brand").agg(F.min(F.struct(seeded("p_partkey").alias("h"), "p_partkey")).alias("b"))
    return one.orderBy("b.h").limit(12).select("b.p_partkey", "p_brand")


@register("SELECT o_orderkey, CASE WHEN i <= 40 THEN 'timed' ELSE 'warmup' END AS part, CAST(i AS INT) AS place FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('249|' || o_orderkey), o_orderkey) AS i FROM orders) WHERE i <= 43")
def sample_with_warmups(spark, d):
    """Disjoint slices of one seeded order: the sample, then three warm-ups."""
    first = table(spark, d, "orders").select("o_orderkey", seeded("o_orderkey").alias("h")).orderBy("h", "o_orderkey").limit(43)
    n = F.row_number().over(W.orderBy("h", "o_orderkey"))  # 43 rows
    return first.select("o_orderkey", n.alias("place")).withColumn("part", F.when(F.col("place") <= 40, "timed").otherwise("warmup"))


WARMUPS = 3


@register(f"""WITH s AS (SELECT p_brand AS dataset, p_partkey AS pos, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, CASE WHEN p_brand = 'Brand#11' THEN 1 ELSE {WARMUPS} END AS w FROM part)
SELECT dataset, CASE WHEN i < w THEN 'warmup' ELSE 'timed' END AS phase, CAST(CASE WHEN i < w THEN i ELSE i - w END AS BIGINT) AS k, pos FROM s""")
def job_list(spark, d):
    """Each dataset's warm-ups (fewer in one of them), then its timed records, numbered in their phase."""
    part = table(spark, d, "part").select(F.col("p_brand").alias("dataset"), F.col("p_partkey").alias("pos"))
    n = ordered.folded(part, ["dataset"], ["pos"], {"n": ordered.running(F.lit(1).cast("long"))})
    i, w = F.col("n") - 1, F.when(F.col("dataset") == "Brand#11", 1).otherwise(WARMUPS)
    return n.select("dataset", F.when(i < w, "warmup").otherwise("timed").alias("phase"), F.when(i < w, i).otherwise(i - w).alias("k"), "pos")


REGISTRY = ((2, "F16", "mmproj-F16"), (5, "Q8", "mmproj-Q8_0"), (8, "Q4", "mmproj-Q4_0"), (9, "Q6", "mmproj-Q6_K"))


@register("WITH c(num, short, mmproj) AS (VALUES (2, 'F16', 'mmproj-F16'), (5, 'Q8', 'mmproj-Q8_0'), (8, 'Q4', 'mmproj-Q4_0'), (9, 'Q6', 'mmproj-Q6_K')) SELECT n_nationkey, 'config' || num || '_' || short || '__' || lower(n_name) || '.jsonl' AS file, mmproj FROM nation JOIN c ON c.num = n_nationkey % 10")
def config_lookup(spark, d):
    """A run's file name and encoder by its number; numbers that the registry lacks are left out."""
    known = F.broadcast(spark.createDataFrame(REGISTRY, "num int, short string, mmproj string"))
    n = table(spark, d, "nation").join(known, F.col("n_nationkey") % 10 == F.col("num"))
    return n.select("n_nationkey", F.format_string("config%d_%s__%s.jsonl", "num", "short", F.lower("n_name")).alias("file"), "mmproj")


@register("SELECT page_id, CASE WHEN starts_with(p, '/') THEN p ELSE '/data/' || p END AS path, left(html, 40) AS head, page_id + 1 AS record_num FROM (SELECT page_id, html, CASE WHEN page_id % 2 = 0 THEN '/abs/' ELSE '' END || page_id || '.png' AS p FROM pages)")
def image_paths(spark, d):
    """Relative paths below the dataset's folder, absolute ones as they are; and a reply's head and the number shown for a record."""
    name = F.concat(F.when(F.col("page_id") % 2 == 0, "/abs/").otherwise(""), F.col("page_id").cast("string"), F.lit(".png"))
    full = F.transform(F.array(name), lambda p: F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit("/data/"), p)))
    return table(spark, d, "pages").select("page_id", full[0].alias("path"), F.left("html", F.lit(40)).alias("head"), (F.col("page_id") + 1).alias("record_num"))


@register("SELECT event_id, strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S+02:00') AS iso FROM events")
def zoned_stamps(spark, d):
    """Epoch times as local ISO stamps of a zone, here a fixed one."""
    local = F.convert_timezone(F.lit("UTC"), F.lit("+02:00"), F.col("ts").cast("timestamp_ntz"))
    return table(spark, d, "events").select("event_id", F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")).alias("iso"))


KNOWN_BAD = (3, 14, 15, 92)


@register(f"SELECT source, count(*) AS n, count(*) FILTER (WHERE lang IS NOT NULL) AS answered, round(sum(n_chars * 2 / 1e6), 2) AS megapixels FROM documents WHERE text IS NOT NULL AND doc_id NOT IN {KNOWN_BAD} GROUP BY source")
def usable_records(spark, d):
    """Records with a text that are not known to be bad."""
    docs = table(spark, d, "documents").where(F.col("text").isNotNull() & ~F.col("doc_id").isin(*KNOWN_BAD))
    rows = docs.select("source", F.col("lang").alias("predicted"), F.lit(None).cast("string").alias("error"), "n_chars")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(scoring.answered()).alias("answered"), F.round(F.sum(F.col("n_chars") * 2 / 1e6), 2).alias("megapixels"))


@register("SELECT event_id, user_id, CASE WHEN user_id % 3 = 0 THEN round(user_id * 1.5, 1) END AS image_kb, user_id % 6 = 0 AS is_large FROM events WHERE event_type = 'error'")
def failing_images(spark, d):
    """A map from positions, as strings, to sizes and a list of the large ones, looked up for each failing request."""
    users = table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("pos")).distinct()
    sizes = users.where("pos % 3 = 0").select(F.col("pos").cast("string").alias("key"), F.round(F.col("pos") * 1.5, 1).alias("image_kb"), (F.col("pos") % 6 == 0).alias("large"))
    e = table(spark, d, "events").where("event_type = 'error'").select("event_id", "user_id")
    return e.join(sizes, F.col("user_id").cast("string") == F.col("key"), "left").select("event_id", "user_id", "image_kb", F.coalesce("large", F.lit(False)).alias("is_large"))


@register("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND value > 200), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 200)
SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN b.user_id IS NULL THEN 'first' ELSE 'second' END AS only_in FROM a FULL JOIN b ON a.user_id = b.user_id WHERE a.user_id IS NULL OR b.user_id IS NULL""")
def set_differences(spark, d):
    """What only one of two sets holds, from one aggregate."""
    kind = lambda x: table(spark, d, "events").where((F.col("event_type") == x) & (F.col("value") > 200)).select("user_id")
    return paired.set_differences(kind("signup"), kind("purchase"), "user_id")


@register("SELECT dataset, coalesce(bool_and(score IN (0, 1)), false) AS binary FROM (SELECT lang AS dataset, CASE WHEN lang = 'de' THEN n_chars % 3 / 2.0 ELSE n_chars % 2 END AS score FROM documents) GROUP BY dataset")
def binary_scores(spark, d):
    """Whether a dataset's scores are only 0 and 1."""
    score = F.when(F.col("lang") == "de", F.col("n_chars") % 3 / 2.0).otherwise((F.col("n_chars") % 2).cast("double"))
    return table(spark, d, "documents").groupBy(F.col("lang").alias("dataset")).agg(F.coalesce(F.bool_and(score.isin(0.0, 1.0)), F.lit(False)).alias("binary"))
