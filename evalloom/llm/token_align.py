"""Cross-tokenizer alignment by a postings cogroup.

Each text is encoded by a byte-level BPE (A) and a SentencePiece BPE (B), both over the same bytes, blank + text. Where tokens of
both end at one byte, a group ends, and the two tokens that end there are linked. How often a pair of ids is linked in the whole
corpus, and which A id a B id is linked with most, comes from one cogroup:

* Documents are encoded in chunks of a few MB, once, and written: one row with the figures of a chunk's documents, and for each cell of B ids
  (the side) a block of postings, the pairs that each document links and how often.
* Blocks are summed by task into totals of pairs, which go to the cells too. A cell that holds more than its share of the
  postings (a frequent B id) is dealt to as many salts as its size asks for, with the totals sent to each of them.
* Blocks and totals meet in partitions sorted by (cell, salt, kind), by Spark's sort, which spills. A task reads such a stream once:
  a cell's totals come first and are summed to the counts and to each B id's highest one; then the documents' blocks pass by,
  one after another, and leave each document's contributions. What a task holds is bounded by the vocabularies, not by rows.
* Contributions are summed by document, in the document's chunk.

Encoding goes by segments, white space and what follows it: no token of either vocabulary begins in one segment and ends in the next, which
`Pair` reads from the models when they are loaded. A chunk's different segments are joined, encoded and aligned once by numpy.

Defined cases: null and empty texts, and those whose tokens of either side don't spell blank + text (one with a literal U+2581), have no
tokens and zeros; rows that share a doc_id are documents of their own, a null doc_id too; bytes that are not UTF-8 are read as U+FFFD; an
empty table gives an empty result; texts are whole whatever their length; of the input only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import types
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm._shared import discard, materialize, table, trim
from evalloom.llm.sentencepiece_viterbi import BLANK, wire_fields

PATH_A, PATH_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: The pattern that byte-level BPE splits texts by, and the characters of Unicode's property White_Space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + f"{chr(0x2000)}-{chr(0x200A)}"
TAIL = re.compile(f"[{WHITE}]\\Z")

#: Bytes and rows of text that make a chunk, and bytes of segments that a library encodes at once.
CHUNK_BYTES, CHUNK_ROWS, BLOB = 4 << 20, 1 << 15, 1 << 16
#: Postings that one salt of a cell takes at least; cells there are at most.
SALT_POSTINGS, MAX_CELLS = 4_000_000, 4096

ENCODED = "chunk long, cell int, n long, docs binary, sizes binary, pairs binary, counts binary, rows array<struct<doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string>>"


@dataclass
class Aligned:
    """Segments and their tokens: for segment i the pairs linked[edge[i] : edge[i + 1]] and the figures at i."""

    edge: np.ndarray
    linked: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    good: np.ndarray
    spelled: list[str]


class Pair:
    """Both tokenizers, from the bytes of their files."""

    def __init__(self, file_a: bytes, file_b: bytes):
        import sentencepiece
        import tiktoken

        file = json.loads(file_a)
        model, before = file["model"], file["pre_tokenizer"]
        if model["type"] != "BPE" or before != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": before.get("trim_offsets"), "use_regex": True} or file["normalizer"] or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError("A has to be a plain byte-level BPE")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level entries write as themselves, the others from U+0100 on
        as_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*printable}))}
        added = {x["content"] for x in file["added_tokens"]}
        entries = {bytes(map(as_byte.__getitem__, t)): i for t, i in model["vocab"].items() if t not in added}
        made = [entries[b"".join(bytes(map(as_byte.__getitem__, x)) for x in (m.split(" ") if isinstance(m, str) else m))] for m in model["merges"]]
        if made != sorted(made) or len({*made}) != len(made) or len(entries) != 256 + len(made):
            raise ValueError("A's ids have to follow its merges")  # then the order of merges is that of ids
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=entries, special_tokens={})
        self.bytes_a = [b""] * (1 + max(entries.values()))
        for raw, i in entries.items():
            self.bytes_a[i] = raw

        self.b = sp = sentencepiece.SentencePieceProcessor(model_proto=file_b)
        keeps = {3: 1, 4: 1, 5: 1}
        for number, value in wire_fields(file_b):
            if number == 3:
                keeps |= dict(wire_fields(value))
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        behind = {c for p in pieces for c in re.findall(f"(?<=[^{WHITE}{BLANK}])[{WHITE}{BLANK}]", p)}  # white space that a piece goes on over
        if keeps.get(2) or not keeps[3] or keeps[4] or not keeps[5] or any("\n" in p for p in pieces) or behind & {BLANK, " "}:
            raise ValueError("B has to add a blank, keep texts as they are, and have no piece with a line's end or a blank behind a word")
        on = f"(?:[{''.join(sorted(behind))}][{WHITE}]*[^{WHITE}]*)*" if behind else ""
        self.segments = re.compile(f"[{WHITE}]*[^{WHITE}]+{on}|[{WHITE}]+").findall
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(len(pieces))]
        self.bytes_b = [(bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(BLANK, " ").encode()) if ok else b"" for i, (p, ok) in enumerate(zip(pieces, plain, strict=True))]
        self.lead = len(sp.encode("\n"))
        self.size_a, self.size_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        self.wide = 1 + max(model["vocab"].values())  # a pair's code is b * wide + a
        if self.wide * len(self.bytes_b) > 2**32:
            raise ValueError("the vocabularies are too large for pairs of 32 bits")
        ends = (",", "|", ";", "\n")
        self.signs = [f"{i}{e}" for e in ends for i in range(max(self.wide, len(self.bytes_b)))]

    def tokens_b(self, text: str) -> np.ndarray:
        """B's ids of text without the blank that the library adds: a line's end, whose piece takes part in no merge, stands between."""
        return np.array(self.b.encode("\n" + text, num_threads=1)[self.lead :], np.int64)

    def encode(self, segments: list[str]) -> Aligned:
        """Segments, which begin with white space, joined by blobs; those that end with it too (a text's end) one by one."""
        parts, blob, held = [], [], 0
        for s in segments:
            if not TAIL.search(s):
                blob.append(s)
                held += len(s)
                if held >= BLOB:
                    parts.append(blob)
                    blob, held = [], 0
            else:
                parts.append([s])
        if blob:
            parts.append(blob)
        order, found = [], []
        for part in parts:
            found += self.blob(part)
            order += part
        at = {s: i for i, s in enumerate(order)}
        return self.align(found, np.fromiter((at[s] for s in segments), np.int64, len(segments)))

    def blob(self, segments: list[str]) -> list[tuple]:
        """(sizes in bytes, tokens A, tokens B, good) of segments; those that don't come out as they are alone."""
        text = "".join(segments)
        raw = text.encode()
        a, b = np.array(self.a.encode_ordinary(text), np.int64), self.tokens_b(text)
        sizes = np.fromiter((len(s) if s.isascii() else len(s.encode()) for s in segments), np.int64, len(segments))
        good = b"".join(map(self.bytes_a.__getitem__, a.tolist())) == raw and b"".join(map(self.bytes_b.__getitem__, b.tolist())) == raw
        if good:
            ends = np.cumsum(sizes)
            good = bool(np.isin(ends, np.cumsum(self.size_a[a])).all() and np.isin(ends, np.cumsum(self.size_b[b])).all())
        if good or len(segments) == 1:
            return [(sizes, a, b, good)]
        return [x for s in segments for x in self.blob([s])]

    def align(self, found: list[tuple], order: np.ndarray) -> Aligned:
        """The groups of all segments, by the bytes at which tokens end; order: which of them is asked for at each place."""
        size = np.concatenate([x[0] for x in found])
        good = np.concatenate([np.full(len(x[0]), x[3]) for x in found])
        none = np.zeros(0, np.int64)
        size = np.where(good, size, 0)  # a bad segment has no bytes and no tokens
        a = np.concatenate([none, *(x[1] for x in found if x[3])])
        b = np.concatenate([none, *(x[2] for x in found if x[3])])
        end_a, end_b, ends = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]), np.cumsum(size)
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        last_a, last_b = np.searchsorted(end_a, both), np.searchsorted(end_b, both)  # the token that ends a group
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        upto = lambda x: np.searchsorted(x, ends, side="right")
        first = lambda x: x - np.concatenate([[0], x[:-1]])
        edge_a, edge_b, edge = upto(end_a), upto(end_b), upto(both)
        width = max(self.wide, len(self.bytes_b))
        sign_a, sign_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        sign_a[last_a], sign_b[last_b] = 1, 2
        held = first(edge) > 0
        sign_b[last_b[edge[held] - 1]] = 3  # a segment's last group
        place_a = np.arange(len(a)) + np.concatenate([[0], last_b + 1])[group_a]
        place_b = np.arange(len(b)) + (last_a + 1)[group_b]
        codes = np.empty(len(a) + len(b), np.int64)
        codes[place_a], codes[place_b] = sign_a * width + a, sign_b * width + b
        lines = "".join(map(self.signs.__getitem__, codes.tolist())).split("\n")
        spelled = np.full(len(size), "", object)
        spelled[held] = lines[:-1]
        linked = b[last_b] * self.wide + a[last_a]
        n, start = first(edge)[order], (edge - first(edge))[order]
        return Aligned(np.concatenate([[0], np.cumsum(n)]), linked[runs(start, n)], first(edge_a)[order], first(edge_b)[order], good[order], spelled[order].tolist())


def runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] of them, then those of start[1], ..."""
    edge = np.cumsum(n)
    return np.arange(edge[-1] if len(n) else 0) + np.repeat(start - edge + n, n)


def kept_pair(files: tuple[bytes, bytes]) -> Pair:
    """The tokenizers of files that came with a function, kept for the next task of this worker."""
    kept = sys.modules.setdefault("_evalloom_pairs", types.ModuleType("_evalloom_pairs")).__dict__
    name = hashlib.sha256(b"".join(files)).hexdigest()
    if name not in kept:
        kept[name] = Pair(*files)
    return kept[name]


def aligned_chunk(pair: Pair, docs: list[int | None], texts: list[bytes], chunk: int, cells: int) -> Iterator[dict]:
    """The rows of ENCODED of one chunk."""
    index: defaultdict[str, int] = defaultdict()
    index.default_factory = index.__len__
    places = []
    for t in texts:
        found = pair.segments(" " + t.decode("utf-8", "replace")) if t else ()
        places.append(np.fromiter(map(index.__getitem__, found), np.int32, len(found)))
    index.default_factory = None
    seen = pair.encode(list(index)) if index else None
    del index
    rows, used, at = [], [], []
    sums = lambda x, where: int(x[where].sum())
    for i, where in enumerate(places):
        if not len(where) or not seen.good[where].all():
            rows.append({"doc_id": docs[i], "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": ""})
            continue
        sha, parts = hashlib.sha256(), where.tolist()
        for start in range(0, len(parts), 1 << 16):
            sha.update((";" * (start > 0) + ";".join(map(seen.spelled.__getitem__, parts[start : start + (1 << 16)]))).encode())
        n = seen.edge[where + 1] - seen.edge[where]
        links = int(n.sum())
        rows.append({"doc_id": docs[i], "n_a": sums(seen.n_a, where), "n_b": sums(seen.n_b, where), "n_groups": links, "n_links": links, "groups_sha256": sha.hexdigest()})
        pairs, counts = np.unique(seen.linked[runs(seen.edge[where], n)], return_counts=True)
        used.append((pairs, counts))
        at.append(i)
    yield {"chunk": chunk, "cell": -1, "n": len(rows), "rows": rows}
    if not used:
        return
    pairs, counts = (np.concatenate([x[k] for x in used]) for k in (0, 1))
    doc = np.repeat(np.array(at, np.int64), [len(x[0]) for x in used])
    cell = (pairs // pair.wide) % cells
    order = np.argsort(cell, kind="stable")  # by document within a cell
    cell, doc, pairs, counts = cell[order], doc[order], pairs[order], counts[order]
    edge = np.flatnonzero(np.diff(cell, prepend=-1))
    for start, stop in zip(edge, [*edge[1:], len(cell)], strict=True):
        own, sizes = np.unique(doc[start:stop], return_counts=True)
        yield {
            "chunk": chunk, "cell": int(cell[start]), "n": int(stop - start), "docs": own.astype(np.uint16).tobytes(), "sizes": sizes.astype(np.uint32).tobytes(),
            "pairs": pairs[start:stop].astype(np.uint32).tobytes(), "counts": counts[start:stop].astype(np.uint32).tobytes(),
        }


def read_files(path_a: str, path_b: str) -> tuple[bytes, bytes]:
    """A few MB that the functions take along."""
    with open(path_a, "rb") as a, open(path_b, "rb") as b:
        return a.read(), b.read()


def encoded(docs: DataFrame, cells: int, files: tuple[bytes, bytes]) -> DataFrame:
    """ENCODED of docs, written to the shared folder, so that texts are encoded once: for each chunk a row with the documents (cell -1) and a
    block of postings for each cell."""
    kind = to_arrow(ENCODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        pair, chunk = kept_pair(files), TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0

        def done() -> pa.RecordBatch:
            nonlocal chunk
            made = pa.RecordBatch.from_pylist(list(aligned_chunk(pair, ids, texts, chunk, cells)), kind)
            chunk += 1
            return made

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc)
                texts.append(t := text.as_py() or b"")
                held += len(t)
                if held >= CHUNK_BYTES or len(ids) >= CHUNK_ROWS:
                    yield done()
                    ids, texts, held = [], [], 0
                    trim()
        if ids:
            yield done()
        trim()

    return materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, ENCODED), "token-postings")


def to_arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


TOTALS = "cell int, n long, pairs binary, counts binary"


def merged(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs, ascending, and the sums of their counts."""
    p, c = np.concatenate(pairs), np.concatenate(counts)
    keys, where = np.unique(p, return_inverse=True)
    out = np.zeros(len(keys), np.int64)
    np.add.at(out, where, c)
    return keys, out


def numbers(raw: bytes | None, kind: type) -> np.ndarray:
    return np.frombuffer(raw or b"", kind)


class Sums:
    """A running sum by pair that merges what has come whenever it has doubled."""

    def __init__(self) -> None:
        self.pairs, self.counts, self.held, self.base = [], [], 0, 0

    def add(self, pairs: np.ndarray, counts: np.ndarray) -> None:
        self.pairs.append(pairs)
        self.counts.append(counts)
        self.held += len(pairs)
        if self.held > 2 * self.base + 65_536:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.pairs:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        one = merged(self.pairs, self.counts)
        self.pairs, self.counts, self.held, self.base = [one[0]], [one[1]], len(one[0]), len(one[0])
        return one


def task_totals(blocks: DataFrame) -> DataFrame:
    """TOTALS of the blocks that a task reads, before anything is shuffled."""
    kind = to_arrow(TOTALS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: defaultdict[int, Sums] = defaultdict(Sums)
        for batch in batches:
            for cell, pairs, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                sums[cell].add(numbers(pairs.as_py(), np.uint32), numbers(counts.as_py(), np.uint32))
        for cell, one in sums.items():
            pairs, counts = one.merge()
            yield pa.RecordBatch.from_pylist([{"cell": cell, "n": len(pairs), "pairs": pairs.tobytes(), "counts": counts.tobytes()}], kind)
        trim()

    return blocks.select("cell", "pairs", "counts").mapInArrow(run, TOTALS)


GIVEN = "chunk long, docs binary, best binary, sums binary"


def contributions(stream: DataFrame, wide: int) -> DataFrame:
    """GIVEN from a stream sorted by (cell, salt, kind): a cell's totals come first, then the blocks of documents."""
    kind = to_arrow(GIVEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums, known = None, Sums(), None
        for batch in batches:
            out = []
            columns = [batch.column(i) for i in range(8)]
            for cell, salt, is_block, chunk, docs, sizes, pairs, counts in zip(*(c.to_pylist() for c in columns[:4]), *columns[4:], strict=True):
                if key != (cell, salt):
                    key, sums, known = (cell, salt), Sums(), None
                own = numbers(pairs.as_py(), np.uint32)
                if not is_block:
                    sums.add(own, numbers(counts.as_py(), np.int64))
                    continue
                if known is None:
                    every, total = sums.merge()
                    side, first = np.unique(every // np.uint32(wide), return_index=True)  # pairs ascend by B id
                    most = np.maximum.reduceat(total, first) if len(first) else total
                    known = every, total, np.repeat(most, np.diff([*first, len(every)])) == total
                at = np.searchsorted(known[0], own)
                links, n = numbers(counts.as_py(), np.uint32).astype(np.int64), numbers(sizes.as_py(), np.uint32).astype(np.int64)
                start = np.cumsum(n) - n
                best, summed = np.add.reduceat(links * known[2][at], start), np.add.reduceat(links * known[1][at], start)
                out.append({"chunk": chunk, "docs": docs.as_py(), "best": best.astype(np.uint32).tobytes(), "sums": summed.tobytes()})
            if out:
                yield pa.RecordBatch.from_pylist(out, kind)
        trim()

    return stream.mapInArrow(run, GIVEN)


SUMMED = "chunk long, at int, n_best long, count_sum long"


def by_document(given: DataFrame) -> DataFrame:
    """SUMMED: the contributions of a document, summed in its chunk."""
    kind = to_arrow(SUMMED)

    def run(rows: pa.Table) -> pa.Table:
        docs = np.concatenate([numbers(x.as_py(), np.uint16) for x in rows["docs"]]).astype(np.int64)
        own = np.unique(docs)
        at = np.searchsorted(own, docs)
        out = []
        for name, size in (("best", np.uint32), ("sums", np.int64)):
            total = np.zeros(len(own), np.int64)
            np.add.at(total, at, np.concatenate([numbers(x.as_py(), size) for x in rows[name]]))
            out.append(total)
        return pa.table([np.full(len(own), rows["chunk"][0].as_py(), np.int64), own.astype(np.int32), *out], schema=kind)

    return given.groupBy("chunk").applyInArrow(run, SUMMED)


def salts_of(blocks: DataFrame, least: int = SALT_POSTINGS) -> dict[int, int]:
    """Into how many salts each cell that needs more than one is dealt; there are at most MAX_CELLS cells."""
    load = {r.cell: r.n for r in blocks.groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    share = max(least, -(-sum(load.values()) // max(1, len(load))))
    return {cell: -(-n // share) for cell, n in load.items() if n > share}


def align(docs: DataFrame, path_a: str = PATH_A, path_b: str = PATH_B, cells: int | None = None, salt_postings: int = SALT_POSTINGS) -> DataFrame:
    """For each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    cells = cells or min(MAX_CELLS, max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    files = read_files(path_a, path_b)
    wide = Pair(*files).wide
    made = encoded(docs, cells, files)
    blocks = made.where("cell >= 0")
    salts = salts_of(blocks, salt_postings)
    n = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in salts.items() for x in kv]), F.col("cell")), F.lit(1)) if salts else F.lit(1)
    nothing = F.lit(None).cast("binary")
    totals = task_totals(blocks).select("cell", F.explode(F.sequence(F.lit(0), n - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("chunk"), nothing.alias("docs"), nothing.alias("sizes"), "pairs", "counts")
    dealt = blocks.select("cell", F.pmod(F.hash("chunk"), n).alias("salt"), F.lit(1).alias("kind"), "chunk", "docs", "sizes", "pairs", "counts")
    stream = totals.union(dealt).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "kind")
    summed = by_document(contributions(stream, wide))
    each = made.where("cell = -1").select("chunk", F.posexplode("rows").alias("at", "r")).select("chunk", "at", "r.*")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return each.join(summed, ["chunk", "at"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def vocabulary_map(docs: DataFrame, path_a: str = PATH_A, path_b: str = PATH_B) -> DataFrame:
    """(a, b, n, best): how often each A id is linked with each B id, and whether none of the B id's other partners is more often."""
    files = read_files(path_a, path_b)
    wide = Pair(*files).wide
    made = encoded(docs, 16, files)
    kind = "a int, b int, n long"

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, counts in zip(batch.column(0), batch.column(1), strict=True):
                p = numbers(pairs.as_py(), np.uint32).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((p % wide).astype(np.int32)), pa.array((p // wide).astype(np.int32)), pa.array(numbers(counts.as_py(), np.int64))], ["a", "b", "n"])

    pairs = task_totals(made.where("cell >= 0")).select("pairs", "counts").mapInArrow(spread, kind).groupBy("a", "b").agg(F.sum("n").alias("n"))
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))
    out = materialize(pairs.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "token-map")
    discard(docs.sparkSession, made)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents").select("doc_id", "text"))
