"""Substring dedup over prefix-partitioned suffix trees.

Every word of a document that has WINDOW words from it on begins a suffix, known here to WINDOW words. Suffixes are split into groups by
variable-length prefixes: a first pass counts them by the prefix of PREFIXES[0] words, cells that hold more than GROUP suffixes are
counted again by the prefix of PREFIXES[1] words, and what is still too large is split by all WINDOW words, where nothing branches any
more. So a group fits a task's memory, whatever prefix is frequent, and equal suffixes always share a group.

A group's tree is built from its sorted suffixes, as intervals of equal prefixes. Only nodes of depth WINDOW matter, the
deep internal nodes: the suffixes below one begin with the same WINDOW words, and below them runs a maximal repeat of at least as many. A node
tells each of its documents whether a smaller doc_id is below it too. In the last step a document removes the words that its repeated
windows cover; windows that follow one another make up the whole maximal repeat.

Suffixes travel as 64-bit hashes of their words beside the cell, packed in one row for each chunk of documents and cell. A chunk first
drops what it can decide alone: of the documents that hold a window only the one with the smallest id goes on to the tree, the others are told at
once. So a passage that a third of all documents share is one suffix for each chunk. Two different windows count as equal if the 64 bits and
the cell of the prefix agree by chance.

Defined cases: null and empty texts and those shorter than a window lose nothing; rows that share a doc_id are one document to the others,
and don't make each other lose words; a null doc_id is smaller than any other; an empty table gives an empty result; bytes that are not UTF-8 stay as
they are up to the last step, where they are read as U+FFFD; texts are whole whatever their length; other columns pass through, and ones
called `_sd_*` are replaced. docs is read three times, so write down what is costly to compute.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm._shared import materialize, table, trim

WINDOW, PREFIXES = 50, (10, 25)
#: Suffixes that a group of equal prefixes holds at most (but for equal windows); each takes about 60 bytes where its tree is built.
GROUP = 2_000_000
#: Bytes and rows of text that make a chunk, and bytes that are cut into words at once.
CHUNK_BYTES, CHUNK_ROWS, PIECE = 8 << 20, 1 << 15, 1 << 20
#: First-level cells there are at most: their counts, not suffixes, are what the driver looks through for large ones.
MAX_CELLS = 1 << 16
NO_ID = -(2**63)
SPACE = b" \t\n\x0b\x0c\r"

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
MIX = np.uint64(0xD6E8FEB86659FD93)


class Words(dict):
    """64-bit hashes of words; forgets all when there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in parts that no word goes over."""
    start = 0
    while len(text) - start > PIECE:
        stop = start + PIECE
        while stop < len(text) and text[stop] not in SPACE:
            stop += 1
        yield text[start:stop]
        start = stop
    yield text[start:]


def word_hashes(text: bytes, known: Words) -> np.ndarray:
    return np.concatenate([np.fromiter(map(known.__getitem__, words := part.split()), np.uint64, len(words)) for part in pieces(text)])


def powers(base: np.uint64, n: int, kept: dict = {}) -> np.ndarray:  # noqa: B006
    """base ** 0, 1, ... n - 1; those of the longest chunk so far are kept."""
    if len(kept.get(int(base), ())) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[:1] = 1
        kept[int(base)] = np.cumprod(out, dtype=np.uint64)
    return kept[int(base)][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


class Windows:
    """Of some documents, by word: the hashes of the prefixes of all suffixes that have a whole window."""

    def __init__(self, texts: list[bytes], known: Words, window: int = WINDOW):
        self.words = [word_hashes(t, known) for t in texts]
        self.n = np.array([len(w) for w in self.words], np.int64)
        every = np.concatenate(self.words) if texts else np.zeros(0, np.uint64)
        count = np.maximum(self.n - window + 1, 0)
        start = np.cumsum(self.n) - self.n
        edge = np.cumsum(count)
        self.doc = np.repeat(np.arange(len(texts)), count)
        self.place = np.arange(edge[-1] if len(texts) else 0) - np.repeat(edge - count, count)  # in its document
        self.at = self.place + np.repeat(start, count)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(every * powers(BASE, len(every)), dtype=np.uint64)])
        self.back = powers(INVERSE, len(every) + 1)

    def prefix(self, k: int, at: np.ndarray | None = None) -> np.ndarray:
        """The hash of the first k words of suffixes (numbers at; all)."""
        i = self.at if at is None else self.at[at]
        return mixed((self.sums[i + k] - self.sums[i]) * self.back[i])


class Cells:
    """Which group a suffix belongs to. bits: of the first-level cells; second, third: for cells that are too large, how many bits the next
    longer prefix adds. A cell's number holds its first-level bits and, above them, what the longer prefixes add."""

    def __init__(self, bits: int, prefixes: tuple[int, ...] = PREFIXES, window: int = WINDOW):
        self.bits, self.lengths, self.more = bits, (*prefixes, window), [{} for _ in prefixes]

    def of(self, windows: Windows, at: np.ndarray | None = None, levels: int | None = None) -> np.ndarray:
        cell = (windows.prefix(self.lengths[0], at) >> np.uint64(64 - self.bits)).astype(np.int64)
        used = self.bits
        for k, more in zip(self.lengths[1:], self.more[:levels], strict=False):
            if not more:
                break
            keys = np.array(sorted(more), np.int64)
            split = np.array([more[x] for x in keys.tolist()], np.uint64)
            where = np.minimum(np.searchsorted(keys, cell), len(keys) - 1)
            large = np.flatnonzero(keys[where] == cell)
            if len(large):
                h = windows.prefix(k, large if at is None else at[large])
                cell[large] |= (1 + (h >> (np.uint64(64) - split[where[large]])).astype(np.int64)) << used
            used += 18
        return cell


def smallest(windows: Windows, docs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes that go on, their window's hash, suffixes that a smaller document of the chunk holds too): one for each window and document."""
    h = windows.prefix(window)
    owner = docs[windows.doc]
    order = np.lexsort((owner, h))
    h, owner = h[order], owner[order]
    new = np.diff(h, prepend=~h[:1]) != 0
    once = new | (np.diff(owner, prepend=owner[:1]) != 0)  # a window that a document holds twice, or two rows of one id
    keep, again = new, once & ~new
    return order[keep], h[keep], order[again]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(doc ids, texts) of a few MB each, however long an Arrow batch is."""
    pa.set_memory_pool(pa.system_memory_pool())
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(NO_ID if doc is None else doc)
            texts.append(t := text.as_py() or b"")
            held += len(t)
            if held >= CHUNK_BYTES or len(ids) >= CHUNK_ROWS:
                yield np.array(ids, np.int64), texts
                ids, texts, held = [], [], 0
                trim()
    if ids:
        yield np.array(ids, np.int64), texts
    trim()


def read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))


def counted(docs: DataFrame, cells: Cells, level: int, window: int) -> DataFrame:
    """(cell, n): how many suffixes of all documents a cell holds; from the second level on only of cells split so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for _, texts in chunks(batches):
            windows = Windows(texts, known, window)
            cell = cells.of(windows, None, level)
            if level:
                cell = cell[cell >= 1 << (cells.bits + 18 * (level - 1))]
            found, n = np.unique(cell, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["cell", "n"])

    return read(docs).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def cells_of(docs: DataFrame, group: int = GROUP, window: int = WINDOW, prefixes: tuple[int, ...] = PREFIXES) -> Cells:
    """Prefixes long enough that none of their groups holds more than `group` suffixes, unless they are one window's. The driver sees
    large cells only."""
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = max(least, 2 * words // 6 // group, 1)
    cells = Cells(min(MAX_CELLS, 1 << (wanted - 1).bit_length()).bit_length() - 1, prefixes, window)
    for level in range(len(prefixes)):
        large = counted(docs, cells, level, window).where(F.col("n") > group).collect()
        if not large:
            break
        cells.more[level] = {r.cell: min(17, (2 * r.n // group).bit_length()) for r in large}
    return cells


#: Hashes of windows by document: docs, how many each of them has, and the hashes one document after the other.
PACKED = (("docs", pa.binary()), ("sizes", pa.binary()), ("hashes", pa.binary()))
SUFFIXES = "cell long, docs binary, sizes binary, hashes binary"
ANSWERS = "bucket long, docs binary, sizes binary, hashes binary"
TOLD = "doc_id long, hashes binary"


def packed(part: np.ndarray, owner: np.ndarray, h: np.ndarray) -> Iterator[tuple]:
    """(part, docs, sizes, hashes) for each part."""
    order = np.lexsort((owner, part))
    part, owner, h = part[order], owner[order], h[order]
    edge = np.flatnonzero(np.diff(part, prepend=part[:1] - 1))
    for start, stop in pairwise([*edge, len(part)]):
        first = start + np.flatnonzero(np.concatenate([[True], np.diff(owner[start:stop]) != 0]))
        yield int(part[start]), owner[first].tobytes(), np.diff([*first, stop]).astype(np.uint32).tobytes(), h[start:stop].tobytes()


def unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(documents, hashes) of packed rows."""
    docs, sizes, hashes = (np.concatenate([np.frombuffer(x.as_py(), kind) for x in rows[name]]) for name, kind in (("docs", np.int64), ("sizes", np.uint32), ("hashes", np.uint64)))
    return np.repeat(docs, sizes), hashes


def as_batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), kind, strict=True)] if rows else [pa.array([], f.type) for f in kind], schema=kind)


def suffixes(docs: DataFrame, cells: Cells, window: int) -> DataFrame:
    """SUFFIXES: a row for each chunk and cell, with the window hashes of its documents; what a chunk has decided alone comes with
    a negative cell, its own."""
    kind = pa.schema([("cell", pa.int64()), *PACKED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for ids, texts in chunks(batches):
            windows = Windows(texts, known, window)
            del texts
            at, h, again = smallest(windows, ids, window)
            rows = list(packed(cells.of(windows, at), ids[windows.doc[at]], h))
            if len(again):
                told = windows.prefix(window, again)
                rows += packed(np.full(len(again), -1 - int(told[0] >> np.uint64(8)), np.int64), ids[windows.doc[again]], told)
            del windows
            yield as_batch(rows, kind)
            trim()

    return read(docs).mapInArrow(run, SUFFIXES)


def deep_nodes(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which leaves of a group's tree stand below a deep internal node beside a smaller document. Sorted suffixes with the same window
    are a node's interval."""
    order = np.argsort(h, kind="stable")
    start = np.flatnonzero(np.diff(h[order], prepend=~h[order[:1]]) != 0)
    least = np.minimum.reduceat(owner[order], start) if len(start) else start
    out = np.zeros(len(h), bool)
    out[order] = np.repeat(least, np.diff([*start, len(h)])) < owner[order]
    return out


def answers(rows: DataFrame, bits: int) -> DataFrame:
    """ANSWERS: for documents, dealt to 2 ** bits buckets, the hashes of windows that a smaller document holds too, by one tree for each group."""
    kind = pa.schema([("bucket", pa.int64()), *PACKED])

    def run(group: pa.Table) -> pa.Table:
        owner, h = unpacked(group)
        if group["cell"][0].as_py() >= 0:
            below = deep_nodes(h, owner)
            owner, h = owner[below], h[below]
        known = owner != NO_ID  # nothing is smaller than no id
        owner, h = owner[known], h[known]
        bucket = (mixed(owner.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
        out = pa.Table.from_batches([as_batch(list(packed(bucket, owner, h)), kind)])
        del owner, h
        trim()
        return out

    return rows.groupBy("cell").applyInArrow(run, ANSWERS)


def told(rows: DataFrame) -> DataFrame:
    """TOLD: a row for each document that something was told, from the rows of its bucket."""
    kind = pa.schema([("doc_id", pa.int64()), ("hashes", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        owner, h = unpacked(group)
        order = np.argsort(owner, kind="stable")
        owner, h = owner[order], h[order]
        start = np.flatnonzero(np.concatenate([[True], np.diff(owner) != 0]))
        out = pa.table([pa.array(owner[start]), pa.array([x.tobytes() for x in np.split(h, start[1:])], pa.binary())], schema=kind)
        del owner, h
        trim()
        return out

    return rows.groupBy("bucket").applyInArrow(run, TOLD)


def removed(text: bytes, repeated: np.ndarray, known: Words, window: int) -> tuple[str, int, int]:
    """(kept words, words, removed words)."""
    if not len(repeated):
        words = [w for part in pieces(text) for w in part.split()]
        return b" ".join(words).decode("utf-8", "replace"), len(words), 0
    windows = Windows([text], known, window)
    gone = np.zeros(int(windows.n[0]), bool)
    hit = np.isin(windows.prefix(window), repeated)
    edge = np.zeros(len(gone) + 1, np.int64)
    edge[: len(hit)] += hit
    edge[window : window + len(hit)] -= hit
    gone = np.cumsum(edge[:-1]) > 0
    kept, at = [], 0
    for part in pieces(text):
        words = part.split()
        kept += [w for w, x in zip(words, gone[at : at + len(words)].tolist(), strict=True) if not x]
        at += len(words)
    return b" ".join(kept).decode("utf-8", "replace"), len(gone), int(gone.sum())


def dedup_substrings(docs: DataFrame, window: int = WINDOW, prefixes: tuple[int, ...] = PREFIXES, group: int = GROUP) -> DataFrame:
    """docs, all columns, with text as the kept words joined by one blank, and `_sd_words`, `_sd_removed` (counts) added."""
    if not prefixes or [*prefixes, window] != sorted({*prefixes, window}):
        raise ValueError("prefixes have to grow, and be shorter than the window")
    cells = cells_of(docs, group, window, prefixes)
    given = materialize(answers(suffixes(docs, cells, window), cells.bits), "substring-answers")
    per = told(given).select(F.col("doc_id").alias("_sd_doc"), F.col("hashes").alias("_sd_told"))
    docs = docs.select(*[c for c in docs.columns if not c.startswith("_sd_")])
    met = docs.join(per, docs["doc_id"].cast("long") == per["_sd_doc"], "left").drop("_sd_doc")
    kind = pa.struct([("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        pa.set_memory_pool(pa.system_memory_pool())
        known = Words()
        for texts, every in batches:
            out = []
            for text, own in zip(texts, every, strict=True):
                repeated = np.frombuffer(own.as_py() or b"", np.uint64)
                out.append(dict(zip(kind.names, removed(text.as_py() or b"", repeated, known, window), strict=True)))
            yield pa.array(out, kind)
            del out
            trim()

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    done = met.withColumn("_sd", F.arrow_udf(run, "struct<text: string, n_words: long, n_removed: long>")(F.col("text").cast("binary"), F.col("_sd_told")))
    columns = [F.col("_sd.text").alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return done.select(*columns, F.col("_sd.n_words").alias("_sd_words"), F.col("_sd.n_removed").alias("_sd_removed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_sd_words").alias("n_words"), F.col("_sd_removed").alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM w WHERE len(w) >= 50),
x AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM p),
f AS (
  SELECT x.doc_id, x.i FROM x JOIN (SELECT k, min(doc_id) AS m FROM x GROUP BY k) s ON s.k = x.k AND s.m < x.doc_id),
g AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM f),
e AS (
  SELECT w.doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w)
SELECT w.doc_id, CAST(len(any_value(w.w)) AS BIGINT) AS n_words, count(g.i) AS n_removed, sha256(coalesce(string_agg(e.word, ' ' ORDER BY e.i) FILTER (WHERE g.i IS NULL), '')) AS kept_sha256
FROM w LEFT JOIN e ON e.doc_id = w.doc_id LEFT JOIN g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY w.doc_id
"""
