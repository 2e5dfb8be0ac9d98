"""SentencePiece encoding and decoding by batched numpy Viterbi.

A text becomes words (a run of blanks and what follows it, where no piece of the model goes over that border). The
different words of a few MB of text are grouped by length, and all words of a length advance together: at each end
position the polynomial hashes of all substrings that end there probe the sorted keys of the pieces, and vectorised maxima
keep the best predecessor as a backpointer.

For unigram models a path's score is the sum of its pieces' scores. For BPE models the sum of scores doesn't give the
library's result; there a path scores 0 if each two neighbouring pieces are a fixed point of the merges, else minus
infinity. A sequence of pieces is the BPE of its text exactly if that holds for each neighbouring pair, so one path is
left at each position, and the ids equal the library's. Pairs are checked once by batched merges and kept in a table.

Defined cases: null and empty texts have no ids; characters without a piece become byte pieces (or unk); control strings in
a text are ordinary text; decoding drops the blank that encoding put in front. Texts are whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import re
import sys
import types
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm._shared import over_texts, table

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
BLANK, BASE, BITMAP, PAIRS = "▁", np.uint64(0x9E3779B97F4A7C15), 1 << 20, 1 << 21
UNK_PENALTY = 10.0
#: Characters of equal-length words that advance together; their tables take about 150 bytes each.
CELLS = 1 << 17
NOT_A_PIECE = -1


def wire_fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[i] & 127) << shift
            shift += 7
            i += 1
            if raw[i - 1] < 128:
                return value, i

    i = 0
    while i < len(raw):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = raw[i : i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            value, i = raw[i : i + n], i + n
        yield tag >> 3, value


@dataclass
class Model:
    """Pieces by id; keys sorted. Small enough (1-2 MB) to travel with a function."""

    pieces: list[str]
    scores: np.ndarray
    usable: np.ndarray
    byte_ids: np.ndarray | None
    unk_id: int
    bpe: bool
    dummy_prefix: bool = True
    splits: str = ""
    longest: int = 1
    keys: np.ndarray = field(default=None)
    key_ids: np.ndarray = field(default=None)
    bits: np.ndarray = field(default=None)
    hashes: np.ndarray = field(default=None)
    lengths: np.ndarray = field(default=None)

    def prepare(self) -> Model:
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.hashes = np.array([self.hash_of(p) for p in self.pieces], np.uint64)
        ids = np.flatnonzero(self.usable)
        keys = probe_key(self.hashes[ids], self.lengths[ids])
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], ids[order]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces share a hash")
        self.bits = np.zeros(BITMAP, bool)
        self.bits[(self.keys & np.uint64(BITMAP - 1)).astype(np.int64)] = True
        self.longest = int(self.lengths[ids].max(initial=1))
        text = [self.pieces[i] for i in ids]
        inner = {c for p in text if len(p) > 1 for c in p}
        if self.bpe and (lost := inner - set(text)):
            raise ValueError(f"characters of pieces that are no pieces: {sorted(lost)[:5]}")
        apart = "" if "\n" in inner else "\n"
        self.splits = rf"{BLANK}*[^{BLANK}{apart}]+|{BLANK}+" + (r"|\n" if apart else "") if not any(BLANK in p.lstrip(BLANK) for p in text) else (r"[^\n]+|\n" if apart else r"[\s\S]+")
        if self.bpe:
            self.usable = self.usable & self.whole(ids)
        return self

    @staticmethod
    def hash_of(text: str) -> np.uint64:
        h = 0
        for c in text:
            h = (h * int(BASE) + ord(c) + 1) & (2**64 - 1)
        return np.uint64(h)

    def whole(self, ids: np.ndarray) -> np.ndarray:
        """Which pieces the merges of their own characters make."""
        out = np.zeros(len(self.pieces), bool)
        for n in np.unique(self.lengths[ids]):
            own = ids[self.lengths[ids] == n]
            left = merged(self, chars_of([self.pieces[i] for i in own], int(n)))
            out[own] = [len(x) == 1 and x[0] == i for x, i in zip(left, own, strict=True)]
        return out


def probe_key(h: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    h = h ^ (np.asarray(n).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h ^ (h >> np.uint64(29))


def load(path: str = MODEL_PATH) -> Model:
    """The pieces of a SentencePiece model file whose normaliser leaves texts as they are."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return of_processor(sp)


def of_processor(sp) -> Model:
    kind, keeps = 1, {3: 1, 4: 1, 5: 1}
    for number, value in wire_fields(sp.serialized_model_proto()):
        if number == 2:
            kind = dict(wire_fields(value)).get(3, 1)
        elif number == 3:
            keeps |= dict(wire_fields(value))
    if keeps.get(2) or keeps[4] or not keeps[5] or kind not in (1, 2):
        raise ValueError("only unigram and BPE models with identity normalisation are supported")
    n = sp.get_piece_size()
    special = np.array([sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)])
    bytes_ = [i for i in range(n) if sp.is_byte(i)]
    return Model([sp.id_to_piece(i) for i in range(n)], np.array([sp.get_score(i) for i in range(n)]), ~special, np.array(bytes_) if len(bytes_) == 256 else None, sp.unk_id(), kind == 2, bool(keeps[3])).prepare()


def chars_of(words: list[str], n: int) -> np.ndarray:
    return np.array(words, f"U{n}").view(np.uint32).reshape(len(words), n).astype(np.uint64) + np.uint64(1)


def lookup(model: Model, keys: np.ndarray) -> np.ndarray:
    """Ids of the pieces with these probe keys, else NOT_A_PIECE."""
    out = np.full(len(keys), NOT_A_PIECE, np.int64)
    may = np.flatnonzero(model.bits[(keys & np.uint64(BITMAP - 1)).astype(np.int64)])
    if len(may):
        k = keys[may]
        at = np.minimum(np.searchsorted(model.keys, k), len(model.keys) - 1)
        out[may] = np.where(model.keys[at] == k, model.key_ids[at], NOT_A_PIECE)
    return out


def powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    for i in range(n):
        out[i + 1 : i + 2] = out[i : i + 1] * BASE  # as arrays, which wrap silently
    return out


def merged(model: Model, chars: np.ndarray) -> list[np.ndarray]:
    """The BPE ids of rows of characters that all are pieces: best score first, then leftmost."""
    rows, n = chars.shape
    ids = lookup(model, probe_key(chars.ravel(), 1)).reshape(rows, n)
    out, at, power = [None] * rows, np.arange(rows), powers(model.longest)
    while len(at):
        a, b = ids[:, :-1].ravel(), ids[:, 1:].ravel()
        size = model.lengths[a] + model.lengths[b]
        h = model.hashes[a] * power[model.lengths[b]] + model.hashes[b]
        got = lookup(model, probe_key(h, size)).reshape(len(at), -1)
        cost = np.where(got >= 0, -model.scores[got], np.inf)
        if not cost.shape[1]:
            for r, x in zip(at, ids, strict=True):
                out[r] = x
            break
        best = cost.argmin(axis=1)
        r = np.arange(len(at))
        more = np.isfinite(cost[r, best])
        for i in np.flatnonzero(~more):
            out[at[i]] = ids[i]
        ids, got, best, at = ids[more], got[more], best[more], at[more]
        if not len(at):
            break
        r = np.arange(len(at))
        ids[r, best] = got[r, best]
        keep = np.ones(ids.shape, bool)
        keep[r, best + 1] = False
        ids = ids[keep].reshape(len(at), -1)
    return out


class Encoder:
    """Encodes with one model; keeps the checked pairs."""

    def __init__(self, model: Model):
        self.model = model
        self.pair_key, self.pair_ok = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        self.split = re.compile(model.splits).findall
        self.power = powers(model.longest)
        self.floor = float(model.scores[model.usable].min(initial=0)) - UNK_PENALTY

    def pairs_ok(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of pieces the merges leave as they are."""
        code = a * len(self.model.pieces) + b
        slot = ((code.astype(np.uint64) * BASE) >> np.uint64(43)).astype(np.int64)  # 21 bits, as PAIRS
        new, known = self.pair_key[slot] != code, self.pair_ok[slot]
        if new.any():
            todo = np.unique(code[new])
            x, y = np.divmod(todo, len(self.model.pieces))
            ok = np.zeros(len(todo), bool)
            size = self.model.lengths[x] + self.model.lengths[y]
            for n in np.unique(size):
                own = np.flatnonzero(size == n)
                left = merged(self.model, chars_of([self.model.pieces[x[i]] + self.model.pieces[y[i]] for i in own], int(n)))
                ok[own] = [len(z) == 2 and z[0] == x[i] and z[1] == y[i] for z, i in zip(left, own, strict=True)]
            put = ((todo.astype(np.uint64) * BASE) >> np.uint64(43)).astype(np.int64)
            self.pair_key[put], self.pair_ok[put] = todo, ok
            found = ok[np.minimum(np.searchsorted(todo, code), len(todo) - 1)]
            return np.where(new, found, known)  # of two pairs with one slot, the later one stays in the table
        return known

    def viterbi(self, words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of words of n characters: ids from -2 down stand for characters without a piece."""
        model, rows = self.model, len(words)
        chars = chars_of(words, n)
        prefix = np.zeros((n + 1, rows), np.uint64)
        for i in range(n):
            prefix[i + 1] = prefix[i] * BASE + chars[:, i]
        best = np.full((n + 1, rows), -np.inf)
        best[0] = 0
        last = np.full((n + 1, rows), NOT_A_PIECE, np.int64)
        back = np.zeros((n + 1, rows), np.int32)
        for j in range(1, n + 1):
            sizes = range(min(j, model.longest), 0, -1)
            got = np.array([lookup(model, probe_key(prefix[j] - prefix[j - size] * self.power[size], size)) for size in sizes])
            may = (got >= 0) & np.isfinite(best[j - np.array(sizes)])
            may &= model.usable[got]
            left = may.sum(axis=0)
            for size, piece, here in zip(sizes, got, may, strict=True):
                i = j - size
                at = np.flatnonzero(here & (best[j] < 0)) if model.bpe else np.flatnonzero(here)
                if not len(at):
                    continue
                if model.bpe:
                    # one of the pieces that end here is right, so the last one left needs no check
                    ok = np.ones(len(at), bool)
                    doubt = np.flatnonzero((left[at] > 1) & (last[i, at] >= 0))
                    ok[doubt] = self.pairs_ok(last[i, at[doubt]], piece[at[doubt]])
                    left[at] -= 1
                    value = np.where(ok, 0.0, -np.inf)
                else:
                    value = best[i, at] + model.scores[piece[at]]
                better = value > best[j, at]
                at = at[better]
                best[j, at], last[j, at], back[j, at] = value[better], piece[at], size
            at = np.flatnonzero((got[-1] < 0) & np.isfinite(best[j - 1]))
            at = at if model.bpe or not len(at) else at[best[j - 1, at] + self.floor > best[j, at]]
            if len(at):
                best[j, at], last[j, at], back[j, at] = (0.0 if model.bpe else best[j - 1, at] + self.floor), -1 - chars[at, j - 1].astype(np.int64), 1
        out, count = np.zeros((rows, n), np.int64), np.zeros(rows, np.int64)
        place, at = np.full(rows, n), np.arange(rows)
        while len(at):
            p = place[at]
            out[at, n - 1 - count[at]] = last[p, at]
            count[at] += 1
            place[at] -= back[p, at]
            at = at[place[at] > 0]
        return out[np.arange(n) >= (n - count)[:, None]], count

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        lead = BLANK if self.model.dummy_prefix else ""
        index: defaultdict[str, int] = defaultdict()
        index.default_factory = index.__len__  # a new word gets the next number
        places = []
        for t in texts:
            words = self.split((lead + t).replace(" ", BLANK)) if t else []
            places.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
        index.default_factory = None  # it refers back to index, which only a full collection would free
        ends = np.cumsum([len(x) for x in places]).astype(np.int64)
        every = np.concatenate(places) if places else np.zeros(0, np.int32)
        del places
        by_size: dict[int, list[str]] = {}
        for w in index:
            by_size.setdefault(len(w), []).append(w)
        ids, counts, order = [], [], []
        for n, words in by_size.items():
            rows = max(1, CELLS // n)
            for start in range(0, len(words), rows):
                block = words[start : start + rows]
                x, c = self.viterbi(block, n)
                ids.append(x.astype(np.int32))
                counts.append(c)
                order.append(np.fromiter(map(index.__getitem__, block), np.int32, len(block)))
        n_words = len(index)
        del index, by_size
        if not ids:
            return [np.zeros(0, np.int32) for _ in texts]
        flat, count = self.spelled(np.concatenate(ids), np.concatenate(counts))
        place = np.empty(n_words, np.int64)
        place[np.concatenate(order)] = np.arange(n_words)
        start = np.cumsum(count) - count
        where = place[every]
        n = count[where]
        step = np.ones(int(n.sum()), np.int32)
        edge = np.cumsum(n)
        step[0], step[edge[:-1]] = start[where[0]], start[where[1:]] - (start[where[:-1]] + n[:-1] - 1)
        whole = flat.astype(np.int32)[np.cumsum(step, dtype=np.int64)]
        return np.split(whole, np.r_[0, edge][ends[:-1]])

    def spelled(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as their byte pieces, or as unk."""
        if ids.min(initial=0) >= 0:
            return ids, counts
        model, bad = self.model, ids < 0
        if model.byte_ids is None:
            return np.where(bad, model.unk_id, ids), counts
        raw = [chr(-2 - c).encode("utf-8", "replace") for c in ids[bad].tolist()]
        width = np.ones(len(ids), np.int64)
        width[bad] = [len(r) for r in raw]
        owner = np.repeat(np.arange(len(counts)), counts)
        flat = np.repeat(ids, width)
        flat[np.repeat(bad, width)] = model.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return flat, np.bincount(owner, width, len(counts)).astype(np.int64)


class Decoder:
    def __init__(self, model: Model):
        spelled = [p.replace(BLANK, " ").encode() if model.usable[i] or len(p) == 1 else b"" for i, p in enumerate(model.pieces)]
        for b, i in enumerate(model.byte_ids if model.byte_ids is not None else []):
            spelled[i] = bytes([b])
        spelled[model.unk_id] = " ⁇ ".encode()
        self.take, self.drop = spelled.__getitem__, model.dummy_prefix

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.take, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.drop and text.startswith(" ") else text


#: Bytes of text that are encoded at once: more of them repeat more words, but their words and ids take 25 times as much.
CHUNK_BYTES = 4 << 20


def tools(model: Model) -> tuple[Encoder, Decoder]:
    """The encoder and decoder of a model that came with a function. They stay with the worker process, so that the next
    task finds the pairs that this one checked; the place is a module of their own, as functions travel by value."""
    kept = sys.modules.setdefault("_evalloom_encoders", types.ModuleType("_evalloom_encoders")).__dict__
    name = f"model_{hash((len(model.pieces), model.keys.tobytes(), model.scores.tobytes())):x}"
    if name not in kept:
        kept[name] = Encoder(model), Decoder(model)
    return kept[name]


def encode_column(spark: SparkSession, path: str = MODEL_PATH):
    """The column function text -> array of ids."""
    model = load(path)

    def run(texts: list[bytes]) -> pa.Array:
        rows = tools(model)[0].encode([t.decode("utf-8", "replace") for t in texts])
        offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))

    return over_texts(run, "array<int>", CHUNK_BYTES)


def decode_column(spark: SparkSession, path: str = MODEL_PATH):
    """The column function array of ids -> text."""
    model = load(path)

    def run(batches):
        for ids in batches:
            decode = tools(model)[1].decode
            yield pa.array([decode(np.array(x.as_py() or [], np.int32)) for x in ids], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")


def round_trip_column(spark: SparkSession, path: str = MODEL_PATH):
    """The column function text -> n_tokens, SHA-256 of the ids (as little-endian int32) and of the decoded text, and
    whether decoding gives the text back: both directions in one pass, without moving the ids."""
    model = load(path)
    hexed = partial(hashlib.sha256, usedforsecurity=False)

    def run(texts: list[bytes]) -> pa.Array:
        encoder, decoder = tools(model)
        plain = [t.decode("utf-8", "replace") for t in texts]
        rows = encoder.encode(plain)
        back = [decoder.decode(r) for r in rows]
        columns = {
            "n_tokens": pa.array([len(r) for r in rows], pa.int64()),
            "ids_sha256": pa.array([hexed(r.astype("<i4").tobytes()).hexdigest() for r in rows], pa.string()),
            "decoded_sha256": pa.array([hexed(b.encode("utf-8", "replace")).hexdigest() for b in back], pa.string()),
            "round_trip": pa.array([a == b for a, b in zip(plain, back, strict=True)], pa.bool_()),
        }
        return pa.StructArray.from_arrays(list(columns.values()), list(columns))

    return over_texts(run, "struct<n_tokens: long, ids_sha256: string, decoded_sha256: string, round_trip: boolean>", CHUNK_BYTES)


def encoded(docs: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """docs, all columns, with _sp_ids."""
    return docs.withColumn("_sp_ids", encode_column(docs.sparkSession, path)(F.col("text")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", round_trip_column(spark)(F.col("text")).alias("r")).select("doc_id", "r.*")
