"""Fill-in-middle transformation by an Aho-Corasick event scan.

A text's units are tokens `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`, so a unit ends where a run of other characters ends, or
with the blanks at the text's end. One automaton finds the ASCII white space (the characters at which the class changes) and
the sentinels in one scan. Two neighbouring events with a gap between them have exactly one unit's end there, so units are counted by
arithmetic on the events' positions, and the end of the k-th unit is the end of the k-th gap. Texts are scanned in
blocks: a first scan keeps one count for each block, a second one rereads the block that holds a wanted unit.
Positions are code points throughout.

A document's draws come from the SHA-256 of seed, colon and doc_id. Prefix, middle and suffix are written in the order suffix, prefix,
middle (spm) or prefix, suffix, middle (psm) behind a sentinel each, or left alone (plain). As no two sentinels overlap and a text
that holds one stays plain, the first sentinels found in an output cut it again, which `restored` does with the same automaton.

Defined cases: a null or empty text is plain and empty; a text of blanks is one unit; prefix, middle or suffix may be empty; a null
doc_id draws as the text after the colon were empty; rows with one id draw alike; bytes that are not UTF-8 are read as U+FFFD;
an empty table gives an empty result; texts are whole whatever their length; other columns pass through, and ones called `_fim` are
replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm._shared import table, trim

#: Fixed values of the format: sentinels, the blanks between units, the seed, per cent of texts that change and of those in spm order.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLANKS = " \t\n\x0b\x0c\r"
SEED, RATE, SPM_RATE = 42, 50, 80

#: Code points that are scanned at once, and the most that a sentinel has; a block's events take 8 bytes each.
BLOCK, LONGEST = 1 << 18, 64


def automaton_of(sentinels: tuple[str, ...]) -> ahocorasick.Automaton:
    """Blanks are event 0, sentinels 1, 2, 3."""
    found = ahocorasick.Automaton()
    for c in BLANKS:
        found.add_word(c, 0)
    if len(set(sentinels)) < len(sentinels) or any(s in t for s in sentinels for t in sentinels if s != t):
        raise ValueError(f"sentinels that hold each other: {sentinels}")
    for i, s in enumerate(sentinels, 1):
        if not 2 <= len(s) <= LONGEST or any(c in BLANKS for c in s) or any(s[:k] == t[-k:] for t in sentinels for k in range(1, len(s))):
            raise ValueError(f"a sentinel that is a blank, holds one or overlaps another: {s!r}")
        found.add_word(s, i)
    found.make_automaton()
    return found


class Scan:
    """One text's events."""

    def __init__(self, found: ahocorasick.Automaton, text: str, block: int = BLOCK):
        self.found, self.text, self.block = found, text, block
        self.counts, self.sentinels = [], []  # units that end in each block; (event, last position) of each sentinel
        before = -1  # the last blank so far
        for start in range(0, len(text), block):
            places = []
            for at, event in self.events(start):
                if event:
                    self.sentinels.append((event, at))
                else:
                    places.append(at)
            ends = np.diff(np.fromiter(places, np.int64, len(places)), prepend=before) > 1
            self.counts.append(int(ends.sum()))
            before = places[-1] if places else before
        if text:
            self.counts[-1] += 1  # what stands behind the last blank, or the blanks at the end
        self.upto = list(accumulate(self.counts))
        self.n = self.upto[-1] if text else 0

    def events(self, start: int) -> Iterator[tuple[int, int]]:
        """(position, event) in the block from start; a sentinel counts where it ends, so the scan begins a little earlier."""
        return ((at, event) for at, event in self.found.iter(self.text, max(0, start - LONGEST), min(start + self.block, len(self.text))) if at >= start)

    def end(self, k: int) -> int:
        """Where unit k (from 1) ends; 0 for k = 0, the text's length for the last one."""
        if k <= 0:
            return 0
        if k >= self.n:
            return len(self.text)
        at = bisect_left(self.upto, k)
        start = at * self.block
        before = start - 1 if start == 0 or self.text[start - 1] in BLANKS else start - 2
        blanks = np.array([i for i, event in self.events(start) if not event], np.int64)
        ends = blanks[np.diff(blanks, prepend=before) > 1]
        return int(ends[k - 1 - (self.upto[at] - self.counts[at])])


def cut(scan: Scan, draws: list[int], rate: int, spm_rate: int, sentinels: tuple[str, str, str]) -> tuple[str, str, int | None, int | None]:
    """(form, output, code points of the prefix, of the middle)."""
    text, n, (prefix, suffix, middle) = scan.text, scan.n, sentinels
    if not text or scan.sentinels or draws[2] % 100 >= rate:
        return "plain", text, None, None
    first, last = sorted(x % (n + 1) for x in draws[:2])
    a, b = scan.end(first), scan.end(last)
    if draws[3] % 100 < spm_rate:
        return "spm", f"{suffix}{text[b:]}{prefix}{text[:a]}{middle}{text[a:b]}", a, b - a
    return "psm", f"{prefix}{text[:a]}{suffix}{text[b:]}{middle}{text[a:b]}", a, b - a


def fim(text: Column, doc_id: Column, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """struct<n, form, output, prefix_chars, middle_chars> of each document. sentinels: of prefix, suffix and middle."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    draws = F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])
    kind = pa.struct([("n", pa.int64()), ("form", pa.string()), ("output", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        found = automaton_of(sentinels)
        for texts, draws_ in batches:
            rows = []
            for raw, own in zip(texts, draws_, strict=True):
                scan = Scan(found, (raw.as_py() or b"").decode("utf-8", "replace"))
                rows.append((scan.n, *cut(scan, own.as_py(), rate, spm_rate, sentinels)))
            yield pa.array([dict(zip(kind.names, r, strict=True)) for r in rows], kind)
            del rows
            trim()

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<n: long, form: string, output: string, prefix_chars: long, middle_chars: long>")(text.cast("binary"), draws)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text again, from an output and its form; an output that its form doesn't fit raises."""
    orders = {"psm": (1, 2, 3), "spm": (2, 1, 3)}

    def back(scan: Scan, form_: str) -> str:
        if form_ == "plain":
            return scan.text
        if tuple(e for e, _ in scan.sentinels) != orders[form_]:
            raise ValueError(f"the sentinels found don't fit form {form_}")
        ends = {e: at + 1 for e, at in scan.sentinels}
        stops = dict(zip((e for e, _ in scan.sentinels), [at + 1 - len(sentinels[e - 1]) for e, at in scan.sentinels[1:]] + [len(scan.text)], strict=True))
        return "".join(scan.text[ends[e] : stops[e]] for e in (1, 3, 2))

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        found = automaton_of(sentinels)
        for outputs, forms in batches:
            yield pa.array([back(Scan(found, x.as_py() or ""), f.as_py()) for x, f in zip(outputs, forms, strict=True)], pa.string())
            trim()

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(output, form)


def fim_documents(docs: DataFrame, **how) -> DataFrame:
    """docs, all columns, with `_fim`: n, form, output, prefix_chars, middle_chars."""
    return docs.withColumn("_fim", fim(F.col("text"), F.col("doc_id"), **how))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "_fim.*")
    hexed = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hexed(F.col("output")).alias("output_sha256"), hexed(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
d AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, [CAST('0x' || substr(h, 1 + 8 * i, 8) AS BIGINT) FOR i IN [0, 1, 2, 3]] AS r FROM u),
c AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT doc_id, n, form, t, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
