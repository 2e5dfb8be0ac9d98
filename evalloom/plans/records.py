"""More registered queries: record keys, run comparison, reports and run bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.functions import text
from evalloom.operators import latency, ordered, paired, preflight, ranks
from evalloom.plans.catalog import RESTART_EVERY, register
from evalloom.plans.workload import BASE, EVAL, NOISE, REQUESTS, eval_long, requests, table, valid

#: Configs in the order that reports list them; others come last, by number.
REPORT_ORDER = (2, 5, 9, 10, 8, 11)
ROUNDS = 4


@register(f"WITH {REQUESTS} SELECT server_id, k, count(*) AS n, min(event_id) AS first_id FROM r GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    """Request keys that were logged more than once."""
    g = requests(spark, d).groupBy("server_id", "k").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))
    return g.where("n > 1")


@register(f"""WITH {REQUESTS} SELECT server_id, k, event_id, source FROM (SELECT *, row_number() OVER (PARTITION BY server_id, k ORDER BY source, event_id) AS i
FROM (SELECT server_id, k, event_id, 0 AS source FROM r WHERE event_type = 'purchase' UNION ALL SELECT server_id, k, event_id, 1 FROM r WHERE event_type = 'view')) WHERE i = 1""")
def first_source_wins(spark, d):
    """Of several logs the first that has a position gives its row: one partial aggregate, no sort."""
    r = requests(spark, d).where("event_type in ('purchase', 'view')").withColumn("source", F.when(F.col("event_type") == "purchase", 0).otherwise(1))
    return r.groupBy("server_id", "k").agg(F.min(F.struct("source", "event_id")).alias("b")).select("server_id", "k", "b.event_id", "b.source")


@register(f"""WITH {EVAL} SELECT a.dataset, count(*) AS common, count(*) FILTER (WHERE a.predicted = b.predicted) AS identical, count(*) FILTER (WHERE a.score > b.score) AS lost, count(*) FILTER (WHERE a.score < b.score) AS gained
FROM v a JOIN v b ON a.config = 2 AND b.config = 5 AND a.dataset = b.dataset AND a.idx = b.idx GROUP BY a.dataset""")
def run_compare(spark, d):
    """Two runs record by record, from one pass over the log: both sides of a record meet in one aggregate."""
    v = valid(eval_long(spark, d)).where(F.col("config").isin(BASE, NOISE))
    side = lambda c, x: F.max(F.when(F.col("config") == c, F.col(x)))
    both = v.groupBy("dataset", "idx").agg(side(BASE, "predicted").alias("pa"), side(NOISE, "predicted").alias("pb"), side(BASE, "score").alias("a"), side(NOISE, "score").alias("b")).where("pa is not null and pb is not null")
    return both.groupBy("dataset").agg(F.count("*").alias("common"), F.count_if(F.col("pa") == F.col("pb")).alias("identical"), F.count_if(F.col("a") > F.col("b")).alias("lost"), F.count_if(F.col("a") < F.col("b")).alias("gained"))


@register("""SELECT page_id, sha256(html) AS actual, CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 7 = 0 THEN false ELSE true END AS matches FROM pages WHERE html IS NOT NULL""")
def hash_check(spark, d):
    """Hashes against a listing: true, false, or null where the listing has none."""
    p = table(spark, d, "pages").where("html is not null").select("page_id", F.sha2("html", 256).alias("actual"))
    listed = p.where("page_id % 5 <> 0").select("page_id", F.when(F.col("page_id") % 7 == 0, F.lit("0" * 64)).otherwise(F.col("actual")).alias("expected"))
    return p.join(listed, "page_id", "left").select("page_id", "actual", (F.col("actual") == F.col("expected")).alias("matches"))


@register("""WITH m AS (SELECT conv_id, role AS key, text AS value, turn FROM conversations WHERE role IS NOT NULL),
f AS (SELECT conv_id, key, arg_min(value, turn) AS old, arg_max(value, turn) AS new FROM (SELECT * FROM m WHERE value IS NOT NULL) GROUP BY ALL)
SELECT conv_id, string_agg(key, ',' ORDER BY key) AS changed FROM f WHERE old IS DISTINCT FROM new GROUP BY conv_id""")
def fingerprint_diff(spark, d):
    """Keys whose value differs between the first and the last settings of a conversation."""
    m = table(spark, d, "conversations").where("role is not null and text is not null")
    f = m.groupBy("conv_id", "role").agg(F.min_by("text", "turn").alias("old"), F.max_by("text", "turn").alias("new")).where(~F.col("old").eqNullSafe(F.col("new")))
    return f.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("changed"))


@register(f"WITH {EVAL} SELECT config, count(*) AS n, round(100.0 * sum(CASE WHEN error IS NULL AND predicted = gt THEN 1 ELSE 0 END) / count(*), 6) AS score_all_lines, round(median(n_chars) FILTER (WHERE error IS NULL), 6) AS median_ok, count(*) FILTER (WHERE n_chars > 5000) AS n_long FROM e GROUP BY config")
def eval_log_line(spark, d):
    """A score over all lines (errors count 0) beside a median over the answered ones."""
    hit = F.when(~paired.failed() & (F.col("predicted") == F.col("gt")), 1).otherwise(0)
    e = eval_long(spark, d)
    g = e.groupBy("config").agg(F.count("*").alias("n"), F.round(F.sum(hit) * 100.0 / F.count("*"), 6).alias("score_all_lines"), F.count_if(F.col("n_chars") > 5000).alias("n_long"))
    return ranks.with_median(g, e.where(~paired.failed()), ["config"], "n_chars", "median_ok", 6)


@register(f"""WITH {EVAL}, a AS (SELECT config, round(100.0 * sum(score) / count(*), 2) AS acc FROM v GROUP BY config), {REQUESTS.strip()}, l AS (SELECT CAST(config AS INT) AS config, round(median(wall_ms), 6) AS ms FROM r WHERE valid GROUP BY ALL)
SELECT a.config, a.acc, coalesce(CAST(l.ms AS VARCHAR), 'pending') AS latency, CASE a.config WHEN 2 THEN 0 WHEN 5 THEN 1 WHEN 9 THEN 2 WHEN 8 THEN 4 ELSE 99 END AS place FROM a LEFT JOIN l ON l.config = a.config""")
def report_join(spark, d):
    """Accuracy beside latency; a config without a latency run is pending. Listed in the order of reports."""
    a = valid(eval_long(spark, d)).groupBy("config").agg(F.round(F.sum("score") * 100.0 / F.count("*"), 2).alias("acc"))
    l = ranks.percentiles(requests(spark, d).where("valid").withColumn("config", F.col("config").cast("int")), ["config"], "wall_ms", {"ms": 0.5}).withColumn("ms", F.round("ms", 6))
    at = F.array_position(F.array(*map(F.lit, REPORT_ORDER)), F.col("config"))
    return a.join(l, "config", "left").select("config", "acc", F.coalesce(F.col("ms").cast("string"), F.lit("pending")).alias("latency"), F.when(at > 0, at - 1).otherwise(99).cast("int").alias("place"))


@register(f"WITH {REQUESTS}, n AS (SELECT server_id, valid, row_number() OVER (PARTITION BY server_id ORDER BY us, event_id) - 1 AS pos FROM r) SELECT server_id, pos // 50 AS block, count(*) AS n, count(*) FILTER (WHERE NOT valid) AS deaths, max(pos) AS last_pos FROM n GROUP BY ALL")
def restart_blocks(spark, d):
    """Requests of a server in blocks between restarts."""
    n = ordered.folded(requests(spark, d).select("server_id", "us", "event_id", "valid"), ["server_id"], latency.ORDER, {"n": ordered.running(F.lit(1))}).withColumn("pos", F.col("n") - 1)
    return n.groupBy("server_id", F.floor(F.col("pos") / RESTART_EVERY).alias("block")).agg(F.count("*").alias("n"), F.count_if(~F.col("valid")).alias("deaths"), F.max("pos").alias("last_pos"))


@register("""WITH c AS (SELECT n_regionkey, list_sort(list(n_nationkey)) AS keys FROM nation GROUP BY 1), s AS (SELECT n_regionkey, keys, CAST(unnest(range(0, 4)) AS INT) AS round FROM c), h AS (SELECT *, (round * len(keys)) // 4 AS shift FROM s)
SELECT n_regionkey, round, array_to_string(list_concat(keys[shift + 1 :], keys[1 : shift]), ',') AS plan FROM h""")
def round_rotation(spark, d):
    """Each round starts further along the list of configs."""
    keys = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("keys"))
    h = keys.select("n_regionkey", "keys", F.explode(F.sequence(F.lit(0), F.lit(ROUNDS - 1))).alias("round")).withColumn("shift", F.floor(F.col("round") * F.size("keys") / ROUNDS).cast("int"))
    plan = F.concat(F.slice("keys", F.col("shift") + 1, F.size("keys")), F.slice("keys", F.lit(1), F.col("shift")))
    return h.select("n_regionkey", "round", F.array_join(plan.cast("array<string>"), ",").alias("plan"))


@register(f"""WITH {REQUESTS}, m AS (SELECT config, us // 3600000000 AS hour, min(wall_ms) AS least FROM r WHERE wall_ms IS NOT NULL GROUP BY ALL) SELECT config, count(*) AS windows, round(median(least), 6) AS idle FROM m GROUP BY config""")
def idle_minima(spark, d):
    """The idle level: the median of the windows' minima."""
    m = requests(spark, d).where("wall_ms is not null").groupBy("config", F.floor(F.col("us") / 3_600_000_000).alias("hour")).agg(F.min("wall_ms").alias("least"))
    return m.groupBy("config").agg(F.count("*").alias("windows"), F.round(F.median("least"), 6).alias("idle"))


@register("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'New York City' WHEN 1 THEN '10 o''clock' WHEN 2 THEN 'Answers vary' WHEN 3 THEN '' WHEN 4 THEN 'cat' ELSE 'two' END AS short, CASE doc_id % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'B' WHEN 3 THEN 'D' ELSE 'Z' END AS gt,
'What?' || chr(10) || chr(10) || 'Answer with a single word or short phrase. Do not explain.' AS prompt FROM documents""")
def short_answers(spark, d):
    """Short replies and ground truths in each accepted spelling, and with each kind of line end."""
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("doc_id") % 6 + 1).cast("int"))
    reply = pick("  New   York City \nextra line", "<think>noon?</think>Answer: 10 o'clock", "\n\nAnswers vary", "<THINK>x\ny</THINK> \n ", "cat\rdog", f"\x0b {chr(0x2028)}Answer: two{chr(0x85)}x")
    return table(spark, d, "documents").select("doc_id", text.parse_short(reply).alias("short"), text.gt_letter(pick("0", "2", "(b)", " (D) ", "25", "z")).alias("gt"), text.short_prompt(F.lit("What?")).alias("prompt"))


@register("""WITH r AS (SELECT doc_id AS rec_no, CAST(CASE WHEN doc_id % 97 = 5 THEN 5 ELSE doc_id END AS VARCHAR) AS idx, CASE WHEN doc_id % 50 = 0 THEN [] WHEN doc_id % 3 = 0 THEN [(doc_id % 400) || '.png', '/data/' || (doc_id % 31) || '.png'] ELSE [(doc_id % 400) || '.png'] END AS p FROM documents),
f AS (SELECT '/data/' || page_id || '.png' AS file, CASE WHEN page_id % 11 = 3 THEN 0 ELSE length(html) END AS n FROM pages),
w AS (SELECT rec_no, idx, CASE WHEN starts_with(u, '/') THEN u ELSE '/data/' || u END AS path FROM (SELECT rec_no, idx, unnest(p) AS u FROM r))
SELECT 'error' AS severity, CASE WHEN n IS NULL THEN 'missing image' ELSE 'empty image' END AS problem, rec_no, idx, path FROM w LEFT JOIN f ON f.file = w.path WHERE coalesce(n, 0) = 0
UNION ALL SELECT 'warning', 'repeated idx', rec_no, idx, NULL FROM r WHERE idx IN (SELECT idx FROM r GROUP BY idx HAVING count(*) > 1)
UNION ALL SELECT 'error', 'no images', rec_no, idx, NULL FROM r WHERE len(p) = 0""")
def image_problems(spark, d):
    """Records against a listing of files: images that are missing or empty, records without any, repeated ids."""
    n, png = F.col("doc_id"), lambda x, m: F.concat((x % m).cast("string"), F.lit(".png"))
    paths = F.when(n % 50 == 0, F.array().cast("array<string>")).when(n % 3 == 0, F.array(png(n, 400), F.concat(F.lit("/data/"), png(n, 31)))).otherwise(F.array(png(n, 400)))
    r = table(spark, d, "documents").select(n.alias("rec_no"), F.when(n % 97 == 5, 5).otherwise(n).cast("string").alias("idx"), paths.alias("image_paths"))
    size = F.when(F.col("page_id") % 11 == 3, 0).otherwise(F.length("html"))
    files = table(spark, d, "pages").select(F.concat(F.lit("file:/data/"), F.col("page_id").cast("string"), F.lit(".png")).alias("file"), size.alias("length"))
    return preflight.image_problems(r, files, "/data", strict=False, need_images=True)


@register(f"""WITH {EVAL}, old AS (SELECT config, idx, predicted FROM e WHERE config = 2), new AS (SELECT config, idx, predicted, error FROM e WHERE config = 9)
SELECT config, count(*) AS n, count(error) AS with_error FROM (SELECT config, idx, predicted, NULL AS error FROM old UNION ALL SELECT * FROM new) GROUP BY config""")
def evolving_union(spark, d):
    """Old rows without a column beside new ones with it."""
    e = eval_long(spark, d)
    old, new = e.where("config = 2").select("config", "idx", "predicted"), e.where("config = 9").select("config", "idx", "predicted", "error")
    return old.unionByName(new, allowMissingColumns=True).groupBy("config").agg(F.count("*").alias("n"), F.count("error").alias("with_error"))


@register("""SELECT conv_id, turn, text AS content, CASE WHEN turn % 3 = 0 THEN 'length' ELSE 'stop' END AS finish_reason, CAST(coalesce(CASE WHEN turn % 2 = 0 THEN turn * 1.5 END, 0) AS DOUBLE) AS tok_s FROM conversations WHERE text IS NOT NULL""")
def chat_fields(spark, d):
    """A chat response as JSON and its fields read back, with defaults where a path is missing."""
    turn = F.col("turn")
    timings = F.struct(F.when(turn % 2 == 0, turn * 1.5).alias("predicted_per_second"))
    choice = F.struct(F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content")).alias("message"), F.when(turn % 3 == 0, "length").alias("finish_reason"))
    body = table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.to_json(F.struct(F.array(choice).alias("choices"), timings.alias("timings"))).alias("body"))
    at = lambda path, default: F.coalesce(F.get_json_object("body", path), F.lit(default))
    return body.select("conv_id", "turn", at("$.choices[0].message.content", "").alias("content"), at("$.choices[0].finish_reason", "stop").alias("finish_reason"), at("$.timings.predicted_per_second", "0").cast("double").alias("tok_s"))


@register("""WITH c AS (SELECT p_partkey, [CAST(p_size AS VARCHAR), CAST(p_partkey AS VARCHAR), 'none'] AS choices, chr(CAST(65 + p_partkey % 5 AS INT)) AS letter FROM part)
SELECT p_partkey, letter, CASE letter WHEN 'A' THEN TRY_CAST(choices[1] AS DOUBLE) WHEN 'B' THEN TRY_CAST(choices[2] AS DOUBLE) END AS value FROM c""")
def choice_values(spark, d):
    """The number behind a choice letter; null beyond the choices or for a choice that is no number."""
    p = table(spark, d, "part").select("p_partkey", F.array(F.col("p_size").cast("string"), F.col("p_partkey").cast("string"), F.lit("none")).alias("choices"), F.char(F.col("p_partkey") % 5 + 65).alias("letter"))
    return p.select("p_partkey", "letter", F.try_element_at("choices", F.ascii("letter") - 64).try_cast("double").alias("value"))


@register(f"""WITH {EVAL}, s AS (SELECT config, dataset, count(*) AS target, count(*) FILTER (WHERE NOT (error IS NOT NULL AND idx % 2 = 0)) AS done FROM e GROUP BY ALL)
SELECT config, count(*) AS datasets, bool_and(done = target) AS complete, CAST(sum(target - done) AS BIGINT) AS pending, CASE WHEN bool_and(done = target) THEN 'complete' WHEN sum(done) = 0 THEN 'not run' ELSE 'partial' END AS status FROM s GROUP BY config""")
def run_status(spark, d):
    """Whether all datasets of a run are complete; placeholders of an unavailable server are pending, other errors done."""
    waits = paired.failed() & (F.col("idx") % 2 == 0)
    s = eval_long(spark, d).groupBy("config", "dataset").agg(F.count("*").alias("target"), F.count_if(~waits).alias("done"))
    whole = F.bool_and(F.col("done") == F.col("target"))
    status = F.when(whole, "complete").when(F.sum("done") == 0, "not run").otherwise("partial")
    return s.groupBy("config").agg(F.count("*").alias("datasets"), whole.alias("complete"), F.sum(F.col("target") - F.col("done")).alias("pending"), status.alias("status"))


@register(f"""WITH {REQUESTS}, m AS (SELECT config, k, round(avg(wall_ms), 6) AS v FROM r WHERE wall_ms IS NOT NULL GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY config) AS n FROM m)
SELECT config, max(v) FILTER (WHERE i = CAST(floor(n * 25 / 1000) AS BIGINT)) AS lo, max(v) FILTER (WHERE i = CAST(floor(n * 975 / 1000) AS BIGINT)) AS hi FROM o GROUP BY config""")
def order_statistic_interval(spark, d):
    """An interval from sorted replicates by position, not interpolated. The replicates of a config, here one a key k, are few."""
    m = requests(spark, d).where("wall_ms is not null").groupBy("config", "k").agg(F.round(F.avg("wall_ms"), 6).alias("v"))
    s = m.groupBy("config").agg(F.array_sort(F.collect_list("v")).alias("v"))
    at = lambda q: F.element_at("v", (F.floor(F.size("v") * q / 1000) + 1).cast("int"))
    return s.select("config", at(25).alias("lo"), at(975).alias("hi"))


@register("""SELECT o_custkey, count(*) AS sessions, CAST(count(*) - 1 AS BIGINT) AS resumes, round(sum(o_totalprice), 2) AS elapsed FROM orders GROUP BY o_custkey""")
def session_totals(spark, d):
    """Elapsed time over all sessions of a run, and how often it was resumed."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("sessions"), (F.count("*") - 1).alias("resumes"), F.round(F.sum("o_totalprice"), 2).alias("elapsed"))


@register(f"""WITH {EVAL}, g AS (SELECT config, dataset, sum(score) AS s, count(*) AS n FROM v GROUP BY ALL), q AS (SELECT o.config, o.dataset, CAST(round(100000.0 * (o.s * b.n - b.s * o.n) / (o.n * b.n)) AS BIGINT) AS m FROM g o JOIN g b ON b.config = 2 AND b.dataset = o.dataset AND o.config <> 2)
SELECT config, dataset, CASE WHEN m >= 0 THEN '+' ELSE '-' END || CAST(abs(m) // 1000 AS VARCHAR) || '.' || lpad(CAST(abs(m) % 1000 AS VARCHAR), 3, '0') || CASE WHEN abs(m) > 5000 THEN '*' ELSE '' END AS cell FROM q""")
def delta_cells(spark, d):
    """Signed report cells, +0.000 for nothing, with a mark on large deltas."""
    g = valid(eval_long(spark, d)).groupBy("config", "dataset").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    b = g.where(F.col("config") == BASE).select("dataset", F.col("s").alias("bs"), F.col("n").alias("bn"))
    m = F.round((F.col("s") * F.col("bn") - F.col("bs") * F.col("n")) * 100000.0 / (F.col("n") * F.col("bn"))).cast("long")
    q = g.where(F.col("config") != BASE).join(b, "dataset").select("config", "dataset", m.alias("m"))
    part = F.abs("m")
    digits = F.concat(F.floor(part / 1000).cast("string"), F.lit("."), F.lpad((part % 1000).cast("string"), 3, "0"))
    return q.select("config", "dataset", F.concat(F.when(F.col("m") >= 0, "+").otherwise("-"), digits, F.when(part > 5000, "*").otherwise("")).alias("cell"))


ERROR_FILES = "SELECT lang AS dataset, doc_id AS idx FROM documents WHERE doc_id % 29 = 3"


@register(f"""WITH {EVAL}, x AS ({ERROR_FILES}), g AS (SELECT dataset, idx, bool_or(error IS NOT NULL) AS own FROM e GROUP BY ALL), h AS (SELECT g.*, x.idx IS NOT NULL AS named FROM g LEFT JOIN x ON x.dataset = g.dataset AND x.idx = g.idx),
c AS (SELECT dataset, string_agg(config || ':' || n, ',' ORDER BY config) AS errors_by_config FROM (SELECT dataset, config, count(error) AS n FROM e GROUP BY ALL) GROUP BY dataset)
SELECT h.dataset, count(*) AS n_total, count(*) FILTER (WHERE own OR named) AS n_excluded, count(*) FILTER (WHERE NOT own AND NOT named) AS n_matched, count(*) FILTER (WHERE own) AS from_error_field, count(*) FILTER (WHERE named AND NOT own) AS from_error_files_only, any_value(c.errors_by_config) AS errors_by_config
FROM h JOIN c ON c.dataset = h.dataset GROUP BY h.dataset""")
def exclusion_with_error_files(spark, d):
    """What the runs' own errors and the error files leave out, and how many errors each run has."""
    named = table(spark, d, "documents").where("doc_id % 29 = 3").select(F.col("lang").alias("dataset"), F.col("doc_id").alias("idx"))
    out = paired.accounting(eval_long(spark, d), named)
    shown = F.array_join(F.transform(F.map_entries("errors_by_config"), lambda x: F.concat_ws(":", x["key"].cast("string"), x["value"].cast("string"))), ",")
    return out.withColumn("errors_by_config", shown)


@register(f"""WITH {EVAL}, x AS ({ERROR_FILES}) SELECT config, e.dataset, round(100.0 * sum(CAST(predicted = gt AS INT)) / count(*), 6) AS accuracy_pct, count(*) AS n_valid, CAST(0 AS BIGINT) AS n_error
FROM e ANTI JOIN (SELECT dataset, idx FROM e WHERE error IS NOT NULL UNION SELECT * FROM x) u ON e.dataset = u.dataset AND e.idx = u.idx GROUP BY ALL""")
def matched_with_error_files(spark, d):
    named = table(spark, d, "documents").where("doc_id % 29 = 3").select(F.col("lang").alias("dataset"), F.col("doc_id").alias("idx"))
    return paired.accuracy(paired.matched(eval_long(spark, d), named), "config", "dataset")


@register(f"""WITH {EVAL}, k AS (SELECT dataset, min(config) AS f FROM e GROUP BY ALL), b AS (SELECT dataset, config, idx FROM e WHERE error IS NOT NULL),
r AS (SELECT DISTINCT e.dataset, e.config, f FROM e JOIN k USING (dataset)), i AS (SELECT DISTINCT dataset, idx FROM b),
p AS (SELECT r.dataset, r.config, h.idx IS NOT NULL AS here, g.idx IS NOT NULL AS first FROM r LEFT JOIN i ON i.dataset = r.dataset LEFT JOIN b h ON h.dataset = r.dataset AND h.config = r.config AND h.idx = i.idx LEFT JOIN b g ON g.dataset = r.dataset AND g.config = f AND g.idx = i.idx)
SELECT dataset, config, count(*) FILTER (WHERE here) AS n_errors, count(*) FILTER (WHERE here AND NOT first) AS only_here, count(*) FILTER (WHERE first AND NOT here) AS only_first, CASE WHEN count(*) FILTER (WHERE here <> first) > 0 THEN 'warning' ELSE 'ok' END AS status FROM p GROUP BY ALL""")
def error_sets(spark, d):
    """Whether the runs of a dataset fail on the same records."""
    return paired.error_sets(eval_long(spark, d))


@register(f"""WITH {EVAL}, s AS (SELECT config, dataset, round(sum(CASE WHEN error IS NULL THEN CAST(predicted = gt AS INT) END) / count(*) FILTER (WHERE error IS NULL), 6) AS score_answered, count(*) FILTER (WHERE error IS NOT NULL AND idx % 2 = 0) = 0 AS complete FROM e GROUP BY ALL)
SELECT config, round(avg(score_answered), 6) AS macro, count(*) AS n_datasets FROM s WHERE complete GROUP BY config HAVING count(*) > 1""")
def macro_of_complete(spark, d):
    """The macro average leaves out datasets with records that were never tried (here errors of even numbers)."""
    e = eval_long(spark, d)
    waits = paired.failed() & (F.col("idx") % 2 == 0)
    whole = e.groupBy("config", "dataset").agg((F.count_if(waits) == 0).alias("complete"))
    return paired.macro_average(paired.run_metrics(e, "config", "dataset").join(whole, ["config", "dataset"]), "config")


COUNTED = "CASE WHEN idx % 7 = 0 THEN NULL ELSE n_chars % 9 + ({x}) * (idx % 3 - 1) END"


@register(f"""WITH {EVAL}, p AS (SELECT o.config, o.idx, o.n_chars, o.score, b.score AS base_score FROM v o JOIN v b ON b.config = 2 AND o.config <> 2 AND b.dataset = o.dataset AND b.idx = o.idx),
q AS (SELECT *, n_chars % 9 AS truth, {COUNTED.format(x='1 - score')} AS value, {COUNTED.format(x='2 * (1 - base_score)')} AS base_value FROM p)
SELECT config, count(*) FILTER (WHERE base_score > score AND value IS NOT NULL) AS lost, count(*) FILTER (WHERE base_score > score AND value IS NULL) AS unparsed, count(*) FILTER (WHERE base_score > score AND value > truth) AS over, count(*) FILTER (WHERE base_score > score AND value <= truth) AS under,
count(*) FILTER (WHERE base_score > score AND abs(value - truth) = 1) AS off_by_one, count(*) FILTER (WHERE base_score < score) AS gained, count(*) FILTER (WHERE base_score < score AND base_value > truth) AS base_over, count(*) FILTER (WHERE base_score < score AND base_value <= truth) AS base_under FROM q GROUP BY config""")
def count_direction(spark, d):
    """Counts that only one run gets right: over, under, off by one or unparsed in the other, and the baseline's errors where it is the other way round."""
    pairs = paired.pair_with_base(valid(eval_long(spark, d)), BASE)
    value = lambda x: F.expr(COUNTED.format(x=x))
    return paired.count_direction(pairs, value("1 - score"), value("2 * (1 - base_score)"), F.col("n_chars") % 9, "config")


@register(f"""WITH {REQUESTS}, g AS (SELECT dataset, k, config, count(DISTINCT server_id % 5) AS own FROM r GROUP BY ALL), u AS (SELECT dataset, k, count(DISTINCT server_id % 5) AS every FROM r GROUP BY ALL)
SELECT dataset, count(*) AS records, count(*) FILTER (WHERE mixed) AS differ_in_a_config, count(*) FILTER (WHERE every > 1) AS differ_over_configs FROM (SELECT u.dataset, u.k, every, (SELECT max(own) FROM g WHERE g.dataset = u.dataset AND g.k IS NOT DISTINCT FROM u.k) > 1 AS mixed FROM u) GROUP BY dataset""")
def prompt_sets(spark, d):
    """Records whose prompt counts (here servers modulo 5) differ within a config, and over the union of all configs' counts: one aggregate of different
    values, then sets by record."""
    one = requests(spark, d).select("dataset", "k", "config", (F.col("server_id") % 5).alias("n")).distinct()
    own = one.groupBy("dataset", "k", "config").agg(F.count("n").alias("own"), F.collect_set("n").alias("s"))
    every = own.groupBy("dataset", "k").agg(F.max("own").alias("own"), F.array_distinct(F.flatten(F.collect_list("s"))).alias("s"))  # few values a record
    return every.groupBy("dataset").agg(F.count("*").alias("records"), F.count_if(F.col("own") > 1).alias("differ_in_a_config"), F.count_if(F.size("s") > 1).alias("differ_over_configs"))
