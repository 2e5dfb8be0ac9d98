"""SimHash near-dedup with multi-index hashing.

A 64-bit fingerprint is cut into m segments. Fingerprints at r or fewer differing bits agree in one segment up to a small
ball: with r = m * q + a, one of the first a + 1 segments differs in at most q bits, or one of the others in at most
q - 1. So each different fingerprint enters one table row a segment, and probes the balls around its segments; those
that meet under a segment value are verified by their complete distance. m is chosen from the number of different
fingerprints, so that tables stay sparse at any size.

Rows that meet are dealt by segment value and worked off in sorted order; each task emits a spanning forest of the links it
verifies, never all pairs of a group, and components follow by alternating large-star and small-star rounds on
tables in the shared folder. A value under which more than HOT_KEY fingerprints meet is dealt again, by max_bits + 1 parts
of the bits outside its segment: two that link agree in one of these parts, so no link is lost and no task gets them all.

Defined cases: a text without a word (null, empty, white space) has fingerprint zero and links like any other; fewer
words than a shingle make one shingle; rows that share a doc_id are documents of their own; a null doc_id is ignored
as a smallest id, and a component of such rows only has a null id.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm._shared import discard, materialize, small_side, table

SHINGLE, MAX_BITS, SEED = 4, 4, 42
#: Buckets up to this many rows are compared by shifted arrays; larger ones by growing components.
SMALL_BUCKET = 48
#: Fingerprints under one value up to which they are dealt by it alone.
HOT_KEY = 50_000
#: Hot values up to which they are broadcast.
BROADCAST_HOT = 100_000
#: Row keys (doc_id and hashes of the text, 20 bytes each) up to which keep_one broadcasts them; beyond, it shuffles.
BROADCAST_IDS = 1_000_000


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """bytes.split and bytes.lower act on ASCII alone, as the contract's words and lower case do."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[:-width])]
    h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :], strict=True)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for part in range(0, len(h), 1 << 14):
        bits = np.unpackbits(h[part : part + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def row_key() -> list[Column]:
    """doc_id and 96 bits of hashes of the text: rows that agree in it hold the same text, so are of one component."""
    text = F.col("text").cast("binary")
    return [F.col("doc_id").cast("long").alias("_sh_id"), F.xxhash64(text).alias("_sh_a"), F.hash(text).alias("_sh_b")]


def fingerprints(docs: DataFrame, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, _sh_a, _sh_b) of each row; fp is the fingerprint as a signed long, the others are of row_key()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py() or b"", width, seed) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), b.column(2), b.column(3)], ["doc_id", "fp", "_sh_a", "_sh_b"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), *row_key()[1:])
    return rows.mapInArrow(run, "doc_id long, fp long, _sh_a long, _sh_b int")


def plan(n: int, max_bits: int = MAX_BITS, width: int = 64) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of each segment that is probed, at the least expected work for n fingerprints."""

    def segments(m: int) -> list[tuple[int, int, int]]:
        q, a = divmod(max_bits, m)
        cuts = [round(width * i / m) for i in range(m + 1)]
        return [(lo, hi - lo, r) for i, (lo, hi) in enumerate(itertools.pairwise(cuts)) if (r := q if i <= a else q - 1) >= 0]

    def ball(bits: int, r: int) -> float:
        return sum(1 if k == 0 else float(np.prod([(bits - i) / (i + 1) for i in range(k)])) for k in range(r + 1))

    def work(m: int) -> float:
        return sum((1 + ball(b, r) / 2) * (4 + n / 2**b) for _, b, r in segments(m))

    return segments(min(range(2, max_bits + 2), key=work))


def probes(fps: DataFrame, segments: list[tuple[int, int, int]]) -> DataFrame:
    """(key, fp): under each segment's value, and under the values of its ball that are smaller than its own. Of two
    fingerprints with different values, one has the smaller, so one of the two always meets the other."""
    def ball(value: Column, tag: Column, masks: list[int]) -> Column:
        around = F.transform(F.array(*map(F.lit, masks)).cast("array<long>"), lambda m: value.bitwiseXOR(m))
        return F.transform(F.filter(around, lambda x: x < value), lambda x: x.bitwiseOR(tag))

    keys = []
    for i, (first, bits, radius) in enumerate(segments):
        value, tag = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1)), F.lit(i << 48)
        keys.append(F.array(value.bitwiseOR(tag)))
        if masks := [sum(1 << b for b in flips) for k in range(1, radius + 1) for flips in itertools.combinations(range(bits), k)]:
            keys.append(ball(value, tag, masks))
    return fps.select(F.explode(F.concat(*keys)).alias("key"), "fp")


def forest(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the verified links among rows with the same key. keys are sorted."""
    left, right = [], []
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    big = sizes > SMALL_BUCKET
    small = np.repeat(~big, sizes)
    k, f = keys[small], fps[small]
    for d in range(1, int(sizes[~big].max(initial=1))):
        same = np.flatnonzero(k[d:] == k[:-d])
        if not len(same):
            break
        near = same[np.bitwise_count(f[same] ^ f[same + d]) <= max_bits]
        left.append(f[near])
        right.append(f[near + d])
    for s, n in zip(starts[big], sizes[big], strict=True):
        for a, b in grown(np.unique(fps[s : s + n]), max_bits):
            left.append(a)
            right.append(b)
    a, b = (np.concatenate(x) if x else np.empty(0, fps.dtype) for x in (left, right))
    return spanning(a, b)


def grown(rest: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what all links among rest connect, by growing components: quick where most of them link."""
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= max_bits
            if near.any():
                found, rest = rest[near], rest[~near]
                yield np.full(len(found), x), found
                front.extend(found)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the links (a, b) that join what the earlier ones had not joined."""
    keep, up = [], {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        if (p := root(x)) != (q := root(y)):
            up[max(p, q)] = min(p, q)
            keep.append(i)
    return a[keep], b[keep]


def links(fps: DataFrame, n: int, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links that connect what all links within max_bits of the n different fps connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of the last key, which may go on in the next batch

        def linked() -> Iterator[pa.RecordBatch]:
            if held:
                a, b = forest(*(np.concatenate(x) for x in zip(*held, strict=True)), max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            last = int(np.searchsorted(k, k[-1]))
            if last or held and held[-1][0][-1] != k[-1]:
                held.append((k[:last], f[:last]))
                yield from linked()
                held.clear()
            held.append((k[last:], f[last:]))
        yield from linked()

    segments = plan(n, max_bits)
    keyed = probes(fps, segments)
    hot = materialize(keyed.groupBy("key").count().where(F.col("count") > HOT_KEY).select("key"), "hot")
    found = hot.count()  # at most the rows over HOT_KEY
    if found:
        few = F.broadcast(hot) if found <= BROADCAST_HOT else hot
        keyed = keyed.join(few, "key", "left_anti").unionByName(dealt_again(keyed.join(few, "key", "left_semi"), segments, max_bits))
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long")


def dealt_again(keyed: DataFrame, segments: list[tuple[int, int, int]], max_bits: int) -> DataFrame:
    """(key, fp) of hot keys under keys of their own: the old one and one of max_bits + 1 parts of the bits outside its segment."""
    turned, free = F.lit(None).cast("long"), F.lit(None).cast("int")
    for i, (first, bits, _) in enumerate(segments):
        at = (first + bits) % 64
        here = F.shiftrightunsigned("key", 48) == i
        around = F.shiftrightunsigned("fp", at).bitwiseOR(F.shiftleft("fp", 64 - at)) if at else F.col("fp")
        turned, free = F.when(here, around).otherwise(turned), F.when(here, 64 - bits).otherwise(free)
    rows = keyed.select("key", "fp", turned.alias("_turned"), free.alias("_free"))
    parts = []
    for j in range(max_bits + 1):
        lo, hi = (F.floor(F.col("_free") * x / (max_bits + 1)).cast("int") for x in (j, j + 1))
        value = F.call_function("shiftrightunsigned", F.col("_turned"), lo).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), hi - lo) - 1)
        parts.append(F.xxhash64("key", F.lit(j), value))  # parts that share a hash only meet too often: links are verified
    return rows.select(F.explode(F.array(*parts)).alias("key"), "fp")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b) that is not its component's least; large-star and small-star rounds."""
    star = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    seen = last = None
    spark = edges.sparkSession
    for i in itertools.count():
        star = materialize(star, f"star{i}")
        if last:
            discard(spark, *last)
        now = tuple(star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            return star.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
        both = star.union(star.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = materialize(large.distinct(), f"large{i}")
        last = star, large
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = small.union(low).where("u <> v").distinct()


def placed(docs: DataFrame, width: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """fingerprints() of the rows, with root (of the component, also where all its ids are null) and component_id."""
    own = materialize(fingerprints(docs, width, seed), "fingerprints")
    different = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "different")
    edges = materialize(links(different.select("fp"), different.count(), max_bits), "links")
    found = components(edges)
    rooted = different.join(found, different.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    reach = materialize(rooted.join(ids, "root").select("fp", "root", "component_id"), "reach")
    discard(docs.sparkSession, different, edges, rooted)
    return own.join(reach, "fp")


def near_components(docs: DataFrame, width: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links of up to max_bits reach."""
    return placed(docs, width, max_bits, seed).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """One row of each component: of the smallest doc_id (null last), of rows that share it of the least hash of the text,
    of rows that share both any one. Columns of docs called `_sh_*` stay."""
    names, docs = docs.columns, docs.withColumnsRenamed({c: f"_kept{c}" for c in docs.columns if c.startswith("_sh_")})
    rows = placed(docs, **how).select("root", F.col("doc_id").alias("_sh_id"), "_sh_a", "_sh_b")
    rows = materialize(rows, "placed")
    key = ["_sh_id", "_sh_a", "_sh_b"]
    first = F.min(F.struct(F.isnull("_sh_id").alias("last"), *key)).alias("first")
    several = materialize(rows.groupBy("root").agg(first, F.count("*").alias("n")).where("n > 1").select("root", "first"), "several")
    of_several = rows.join(small_side(several, several.count()), "root")  # a table of its own, so that a shuffle join may split hot roots
    keeps = F.struct(F.isnull("_sh_id").alias("last"), *key).eqNullSafe(F.col("first"))
    # keys of rows that don't just stay: few beside the documents, so that texts need no shuffle while they are
    special = of_several.groupBy(*key).agg(F.max(keeps).alias("keeps"), F.count("*").alias("n")).where("NOT keeps OR n > 1")
    special = materialize(special, "special")
    few = special.count() <= BROADCAST_IDS
    many = special.where("keeps")
    again = many.limit(1).count()
    special, many = (x.select(*(F.col(c).alias(f"{c}_") for c in key)) for x in (special, many))
    if few:
        special, many = F.broadcast(special), F.broadcast(many)
    keyed = docs.select("*", *row_key())

    def meets(side: DataFrame) -> Column:
        return keyed["_sh_id"].eqNullSafe(side["_sh_id_"]) & (keyed["_sh_a"] == side["_sh_a_"]) & (keyed["_sh_b"] == side["_sh_b_"])

    out = keyed.join(special, meets(special), "left_anti")
    if again:
        out = out.unionByName(keyed.join(many, meets(many), "left_semi").dropDuplicates(key))
    return out.select(*[F.col(f"_kept{c}").alias(c) if c.startswith("_sh_") else F.col(c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
