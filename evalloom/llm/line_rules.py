"""Line-first quality cleaning, in native expressions only.

Each line is judged on its own and by its neighbours: punctuation (symbol characters or repeated marks on many of its words,
all capitals, no letter at all), navigation (a chain of separated labels, or a run of `MENU_LINES` or more short lines
without an end mark, as menus are), boilerplate (web phrases in five languages that make up `PHRASE_SHARE` of a line). Failing lines are removed,
and a document that loses more than `max_loss` of its words is rejected. The document statistics of the contract come from the
same arrays. What only few texts hold is looked for in the whole text first, so that clean texts skip the line rules.

Defined cases: null is a text without words (counts 0, base_failed true); repeated rows are judged alike, each on its own;
nothing is shuffled, so a hot source or a long text only costs its own length; an empty table gives no rows; blank lines are no
part of a run and don't end one; input columns called `_lr` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm._shared import let, table

SYMBOLS = r"[#*$%&|<>]"
SPACES = r"[\x20\x09-\x0D]+"
#: Phrases of web boilerplate, lower case.
BOILERPLATE = (
    "accept all cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "lorem ipsum", "powered by wordpress",
    "privacy policy", "skip to content", "subscribe to our", "terms of service", "terms of use", "use of cookies",
    "alle cookies akzeptieren", "alle rechte vorbehalten", "allgemeine geschäftsbedingungen", "bitte aktivieren sie javascript", "cookie-richtlinie", "datenschutzerklärung", "hier klicken", "newsletter abonnieren",
    "accepter tous les cookies", "cliquez ici", "conditions d'utilisation", "inscrivez-vous à notre newsletter", "mentions légales", "politique de confidentialité", "politique de cookies", "tous droits réservés", "veuillez activer javascript",
    "accetta tutti i cookie", "informativa sulla privacy", "read more", "share on facebook", "tutti i diritti riservati",
    "aceptar todas las cookies", "activar javascript", "aviso legal", "haga clic aquí", "política de cookies", "política de privacidad", "suscríbete a nuestro", "términos y condiciones", "todos los derechos reservados",
)
#: Marks that end a sentence, at a line's end.
END_MARKS = r"[.!?:;…。！？；：｡]['\"”’»)」』）]*$"
MAX_SYMBOLS_A_WORD, MAX_MARKED, MIN_LABELS, MAX_LOSS = 0.3, 0.3, 4, 0.5
#: A menu's lines have few words and characters, as some scripts write sentences without blanks.
MENU_WORDS, MENU_CHARS, MENU_LINES = 3, 30, 4
#: The least part of a line that phrases of boilerplate make up, so that prose may speak of them.
PHRASE_SHARE = 0.4
MIN_WORDS, MAX_REPEATED, WINDOW = 10, 20, 5
SEPARATED, MARKED = r" [|»›·>] ", r"[!?]{2,}"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def holds_phrase(text: Column) -> Column:
    """Whether a text holds a phrase of BOILERPLATE, by plain searches: an alternation would try each phrase at each place."""

    def any_of(low: Column) -> Column:
        out = F.lit(False)
        for x in BOILERPLATE:
            out |= F.contains(low, F.lit(x))
        return out

    return let(F.lower(text), any_of)


def phrase_chars(line: Column) -> Column:
    """Characters of the different phrases of BOILERPLATE that a line holds."""
    return let(F.lower(line), lambda low: sum((F.when(F.contains(low, F.lit(x)), len(x)).otherwise(0) for x in BOILERPLATE), F.lit(0)))


def n_symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, SYMBOLS + "+", ""))


def line_fails(line: Column, n_words: Column, may: Column) -> Column:
    """The verdict on one line with n_words > 0 words; may: what its text holds at all."""
    symbols = may["symbols"] & (n_symbols(line) > F.lit(MAX_SYMBOLS_A_WORD) * n_words)
    marked = may["marked"] & (F.regexp_count(line, F.lit(MARKED)) > F.lit(MAX_MARKED) * n_words)
    labels = may["separated"] & (F.regexp_count(line, F.lit(SEPARATED)) + 1 >= MIN_LABELS)
    lowered = F.lower(line)
    upper = (n_words >= 3) & (F.upper(line) == line) & (lowered != line)
    wordless = (F.upper(line) == line) & (lowered == line) & ~line.rlike(r"\p{L}")
    return symbols | marked | labels | upper | wordless | (may["phrase"] & (phrase_chars(line) >= PHRASE_SHARE * F.length(line)))


def menu_lines(lines: Column) -> Column:
    """For each of a text's worded lines (short: few words and no end mark) 1 if it is in a run of MENU_LINES short ones, else 0."""
    flags = F.array_join(F.transform(lines, lambda x: F.when(x["short"], "1").otherwise("0")), "")
    for n in range(1, MENU_LINES):
        flags = F.regexp_replace(flags, f"(?<!1){'1' * n}(?!1)", "0" * n)
    return F.split(flags, "")


def repeated_words(words: Column) -> Column:
    """Words in windows found twice or more. Hashes show whether any window repeats; if so, hashes are sorted with their places, and
    the places of equal neighbours are merged."""

    def count(w: Column) -> Column:
        last = F.size(w) - (WINDOW - 1)

        def window(i: Column) -> Column:
            return F.array_join(F.slice(w, i, F.lit(WINDOW)), " ")

        def cover(p: Column) -> Column:
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
            step = lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["to"])).alias("n"), (i + WINDOW).alias("to"))
            return F.aggregate(p, start, step, lambda a: a["n"])

        def places(s: Column, same) -> Column:
            return F.sort_array(F.transform(F.filter(s, lambda x, k: F.coalesce(same(F.get(s, k - 1), x), F.lit(False)) | F.coalesce(same(F.get(s, k + 1), x), F.lit(False))), lambda x: x["i"]))

        def by_hash(h: Column) -> Column:
            """Neighbours of equal hash in sorted order; if any of them differ as strings, the strings are sorted instead."""
            pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("s"), (i + 1).alias("i"))))

            def check(s: Column) -> Column:
                collide = F.exists(F.sequence(F.lit(1), F.size(s) - 1), lambda k: (F.get(s, k)["s"] == F.get(s, k - 1)["s"]) & (window(F.get(s, k)["i"]) != window(F.get(s, k - 1)["i"])))
                strings = F.sort_array(F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(window(i).alias("s"), i.alias("i"))))
                found = places(s, lambda a, b: a["s"] == b["s"])
                return F.when(collide, let(strings, lambda t: let(places(t, lambda a, b: a["s"] == b["s"]), cover))).otherwise(let(found, cover))

            return let(pairs, check)

        def checked(h: Column) -> Column:
            return F.when(F.size(F.array_distinct(h)) < F.size(h), by_hash(h)).otherwise(F.lit(0))

        hashes = let(F.transform(w, lambda x: F.xxhash64(x)), lambda g: F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.xxhash64(*(F.get(g, i + k) for k in range(WINDOW)))))
        return F.when(last >= 2, let(hashes, checked)).otherwise(F.lit(0))

    return let(words, count)


def judge(docs: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """docs, all columns, with `_lr` added: a struct of the statistics, base_failed, kept_words, clean_text and kept."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def of_line(line: Column) -> Column:
        def counted(w: Column) -> Column:
            n = F.size(w)
            short = (n <= MENU_WORDS) & (F.length(line) <= MENU_CHARS) & ~line.rlike(END_MARKS)
            return F.struct(line.alias("line"), w.alias("words"), n.alias("n"), ((n > 0) & line_fails(line, n, F.col("_lr_may"))).alias("fails"), short.alias("short"))

        return let(words_of(line), counted)

    may = F.struct((n_symbols(text) > 0).alias("symbols"), text.rlike(MARKED).alias("marked"), text.rlike(SEPARATED).alias("separated"), holds_phrase(text).alias("phrase"))
    plain = [c for c in docs.columns if c != "_lr"]
    rows = docs.select(*plain, may.alias("_lr_may"))
    rows = rows.select("*", F.transform(F.split(text, "\n"), of_line).alias("_lr_every"))
    rows = rows.withColumn("_lr_worded", F.filter("_lr_every", lambda x: x["n"] > 0)).withColumn("_lr_words", F.flatten(F.transform("_lr_worded", lambda x: x["words"])))
    # a line's verdict with its run's; blank lines have no place in the runs and stay
    judged = F.zip_with("_lr_worded", menu_lines(F.col("_lr_worded")), lambda x, m: F.struct(x["line"].alias("line"), x["n"].alias("n"), (x["fails"] | (m == "1")).alias("fails")))
    rows = rows.withColumn("_lr_lines", F.filter(judged, lambda x: x["line"].isNotNull()))
    worded = F.transform("_lr_worded", lambda x: x["line"])
    n_words = F.size("_lr_words").cast("long")
    none = ~F.exists("_lr_lines", lambda x: x["fails"])
    rows = rows.select(
        *plain,
        n_words.alias("_lr_n"),
        F.length(F.array_join("_lr_words", "")).cast("long").alias("_lr_chars"),
        n_symbols(text).cast("long").alias("_lr_symbols"),
        let(worded, lambda x: (F.size(x) - F.size(F.array_distinct(x)))).cast("long").alias("_lr_dups"),
        repeated_words(F.col("_lr_words")).cast("long").alias("_lr_repeated"),
        F.aggregate("_lr_lines", F.lit(0), lambda a, x: a + F.when(x["fails"], 0).otherwise(x["n"])).cast("long").alias("_lr_kept"),
        F.when(none, text).otherwise(F.array_join(F.transform(F.filter("_lr_lines", lambda x: ~x["fails"]), lambda x: x["line"]), "\n")).alias("_lr_text"),
    )
    failed = (F.col("_lr_n") < MIN_WORDS) | (100 * F.col("_lr_repeated") > MAX_REPEATED * F.col("_lr_n"))
    kept = ~failed & (F.col("_lr_kept") >= (1 - max_loss) * F.col("_lr_n"))
    return rows.select(
        *plain,
        F.struct(
            F.col("_lr_n").alias("n_words"), F.col("_lr_chars").alias("word_chars"), F.col("_lr_symbols").alias("n_symbols"), F.col("_lr_dups").alias("n_dup_lines"),
            F.col("_lr_repeated").alias("n_repeat_words"), F.col("_lr_kept").alias("kept_words"), F.col("_lr_text").alias("clean_text"), failed.alias("base_failed"), kept.alias("kept"),
        ).alias("_lr"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *(F.col(f"_lr.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_words")))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (
  SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
often AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM wins) WHERE c >= 2),
cover AS (
  SELECT doc_id, CAST(sum(least(5, coalesce(nxt - i, 5))) AS BIGINT) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM often) GROUP BY doc_id),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
lined AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM lines),
single AS (
  SELECT *, length(line) - length(regexp_replace(line, '[#*$%&|<>]+', '', 'g')) > 0.3 * n
     OR len(regexp_extract_all(line, '[!?]{2,}')) > 0.3 * n
     OR (n >= 3 AND upper(line) = line AND lower(line) <> line)
     OR NOT regexp_matches(line, '\p{L}')
     OR len(regexp_extract_all(line, ' [|»›·>] ')) + 1 >= 4
     OR PHRASES >= 0.4 * length(line) AS fails,
     n <= 3 AND length(line) <= 30 AND NOT regexp_matches(line, '[.!?:;…。！？；：｡][''"”’»)」』）]*$') AS short
  FROM lined WHERE n > 0),
islands AS (
  SELECT *, sum(CAST(NOT short AS INT)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM single),
judged AS (
  SELECT doc_id, line, n, fails OR (short AND count(*) FILTER (WHERE short) OVER (PARTITION BY doc_id, island) >= 4) AS fails FROM islands),
per AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, CAST(coalesce(sum(n) FILTER (WHERE NOT fails), 0) AS BIGINT) AS kept_words
  FROM judged GROUP BY doc_id),
stats AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(kept_words, 0) AS BIGINT) AS kept_words
  FROM d LEFT JOIN per USING (doc_id) LEFT JOIN cover USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND kept_words >= 0.5 * n_words AS kept
FROM stats
""".replace("PHRASES", "(" + " + ".join("CASE WHEN contains(lower(line), '{}') THEN {} ELSE 0 END".format(x.replace("'", "''"), len(x)) for x in BOILERPLATE) + ")")
