import itertools
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from evalloom.llm import simhash


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split() if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits=4):
    left, out = dict(enumerate(fps)), [None] * len(fps)
    while left:
        front, group = [left.popitem()], []
        while front:
            i, f = front.pop()
            group.append(i)
            for j in [j for j, g in left.items() if (f ^ g).bit_count() <= bits]:
                front.append((j, left.pop(j)))
        for i in group:
            out[i] = group
    return out


def test_fingerprint_edge_cases():
    for t in ("", "  \n", "one", "One two three", "a b c d", "a b c d e f g", "É A\tb\x0bc\x0cd e" * 9, "x " * 70_000):
        assert simhash.fingerprint(t.encode()) == brute_fingerprint(t)


@pytest.mark.parametrize("n", [10, 200_000, 3_000_000, 10**9])
def test_plan_covers_all_pairs(n):
    segments = simhash.plan(n)
    slack = [r for _, _, r in segments]
    m = len(segments)
    assert sum(b for _, b, _ in segments) == 64 or m < 5
    # every way to spread 4 differing bits over all segments leaves one within its radius
    widths = simhash.plan(n)
    total = 64 // max(1, min(b for _, b, _ in widths))
    parts = max(total, m)
    for spread in itertools.product(range(5), repeat=m):
        if sum(spread) <= 4 and parts == m:
            assert any(s <= r for s, r in zip(spread, slack, strict=True))


def clustered(rng, n):
    fps = []
    while len(fps) < n:
        base = rng.getrandbits(64)
        fps.append(base)
        for _ in range(rng.choice([0, 0, 1, 3, 40])):
            x = rng.choice(fps[-5:])
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
            fps.append(x)
    return fps[:n]


@pytest.mark.parametrize("planned", [500, 5_000_000])
def test_components_match_brute_force(spark, monkeypatch, planned):
    rng = random.Random(planned)
    fps = sorted(set(clustered(rng, 700)))
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    edges = simhash.links(df, planned)
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    got = Counter(found.get(int(np.uint64(f).view(np.int64)), int(np.uint64(f).view(np.int64))) for f in fps)
    want = Counter(frozenset(g) for g in map(tuple, brute_components(fps)))
    assert sorted(got.values()) == sorted(want.values())
    groups = {}
    for f in fps:
        s = int(np.uint64(f).view(np.int64))
        groups.setdefault(found.get(s, s), set()).add(f)
    assert {frozenset(g) for g in groups.values()} == {frozenset(fps[i] for i in g) for g in brute_components(fps)}


def test_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(1, 120)] + [(500, 500 + i) for i in range(1, 90)]
    df = spark.createDataFrame(chain, "a long, b long")
    found = {r.node: r.root for r in simhash.components(df).collect()}
    assert all(found[i] == 1 for i in range(2, 121)) and all(found[500 + i] == 500 for i in range(1, 90))


def test_rows(spark):
    text = "the quick brown fox jumps over the lazy dog again and again until the evening comes and nobody is left to count them all"
    rows = [(7, text, 1), (3, text.upper(), 2), (3, text, 3), (9, None, 4), (8, "", 5), (11, "something else entirely", 6), (None, "lone null id here", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_components(docs).collect()), key=str)
    assert got == sorted([(7, 3), (3, 3), (3, 3), (9, 8), (8, 8), (11, 11), (None, None)], key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 8, 11, None], key=str)
    assert simhash.near_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("few", [10**6, 0])
def test_keep_one_of_each_component(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "BROADCAST_IDS", few)
    a, b, c = ("alpha beta gamma delta " * 9, "one two three four five six seven " * 5, "rain falls on the roof of the old house by the sea")
    rows = [(None, a), (None, b), (3, a), (3, c), (1, c), (None, c), (9, "x y"), (9, "x y"), (None, None), (None, ""), (4, "p q r"), (4, "s t u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text or "") for r in simhash.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([(3, a), (None, b), (1, c), (9, "x y"), (None, ""), (4, "p q r"), (4, "s t u")], key=str)
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    fps = [brute_fingerprint(r.text) for r in docs]
    comp = brute_components(fps)
    want = {r.doc_id: (f"{fps[i]:016x}", min(docs[j].doc_id for j in comp[i])) for i, r in enumerate(docs)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(spark, "/root/testdata/sf0.001").collect()} == want


@pytest.mark.parametrize("planned", [500, 5_000_000])
def test_hot_keys_lose_no_link(spark, monkeypatch, planned):
    monkeypatch.setattr(simhash, "HOT_KEY", 5)
    rng = random.Random(planned + 1)
    base, fps = rng.getrandbits(64), clustered(rng, 300)
    for _ in range(250):
        x = base
        for b in rng.sample(range(40, 64), rng.randint(0, 9)):
            x ^= 1 << b
        fps.append(x)
    fps = sorted(set(fps))
    signed = {f: int(np.uint64(f).view(np.int64)) for f in fps}
    found = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame([(x,) for x in signed.values()], "fp long"), planned)).collect()}
    groups = {}
    for f, x in signed.items():
        groups.setdefault(found.get(x, x), set()).add(f)
    assert {frozenset(g) for g in groups.values()} == {frozenset(fps[i] for i in g) for g in brute_components(fps)}
