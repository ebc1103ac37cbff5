"""Language-model scores from an Elias-Fano n-gram trie in shards.

Words are 64-bit hashes; the vocabulary gives each a number and its exact count, and is the only part every task
maps. N-grams up to trigrams, none left out, are dealt to shards by their middle word: the one before the word
that is predicted. A middle word that has more tokens than a shard is split further by the word before it;
its bigrams, summed over the shards, are a file of their own. A task takes one shard: it counts the shard's n-grams
and writes its levels as one file, or maps that file and looks up the tokens dealt to it, whose sums per document are
then added up. So no task reads the whole trie, and a hot word is spread over many. The most frequent words
have the smallest numbers, so what is dealt packs well.

A shard's levels are monotone sequences in Elias-Fano form (low bits packed, high bits in unary): its middle words;
bigrams as middle word's position * V + number; contexts of two words, middle word first; trigrams as
context's position * V + number. The sequence of each context begins at a monotone pointer that the high bits give,
and an n-gram is looked up by the successor of its key relative to its context. Beside each n-gram stands
an 8-bit code of its smoothed log-probability, beside each context one of its back-off weight.

Probabilities are interpolated absolute discounting over add-one unigrams. All counts are taken over the
whole training fold.
"""

from __future__ import annotations

import json
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, filesystem, mix, put, table, word_hashes, work_path, written

END = np.uint64(0x5851F42D4C957F2D)  # the end token's hash
DISCOUNT = 0.75
PARCEL = 2_000_000  # tokens that are dealt together
TOP = 1 << 19  # words that are at least one in TOP tokens, so TOP at most, are numbered by frequency; the others come after, by rank in order of their hashes
U = np.uint64


class EliasFano:
    """A strictly increasing sequence of integers under `universe`, with search."""

    FIELDS = ("head", "low", "high", "zeros")

    def __init__(self, head, low, high, zeros):
        self.head, self.low, self.high, self.zeros = head, low, high, zeros
        self.n, self.bits = int(head[0]), int(head[1])

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        values = values.astype(U)
        words = np.zeros(n * bits // 64 + 2, U)
        if bits:
            low = values & U((1 << bits) - 1)
            at = np.arange(n, dtype=np.int64) * bits
            word, off = at >> 6, (at & 63).astype(U)
            np.bitwise_or.at(words, word, low << off)
            over = np.flatnonzero(off + U(bits) > U(64))
            np.bitwise_or.at(words, word[over] + 1, low[over] >> (U(64) - off[over]))
        high = (values >> U(bits)).astype(np.int64)
        ones = high + np.arange(n)
        size = n + (universe >> bits) + 2
        upper = np.zeros(size // 64 + 1, U)
        np.bitwise_or.at(upper, ones >> 6, U(1) << (ones & 63).astype(U))
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(upper).astype(np.int64))])[:-1]
        return cls(np.array([n, bits], np.int64), words, upper, zeros)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th zero of the high bits."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        rest, x, at = (k - self.zeros[word]).astype(np.int64), ~self.high[word], np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            c = np.bitwise_count(x & U((1 << width) - 1)).astype(np.int64)
            up = rest >= c
            rest -= np.where(up, c, 0)
            x = np.where(up, x >> U(width), x)
            at += np.where(up, width, 0)
        return (word << 6) + at

    def _run_end(self, at: np.ndarray) -> np.ndarray:
        """Where the run of ones that begins at a bit ends; -1 if that isn't within its word."""
        off = (at & 63).astype(U)
        x = ~(self.high[at >> 6] >> off)
        ones = np.bitwise_count((x & (~x + U(1))) - U(1)).astype(np.int64)
        return np.where(ones < 64 - off.astype(np.int64), at + ones, -1)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U)
        at = i * self.bits
        word, off = at >> 6, (at & 63).astype(U)
        out = self.low[word] >> off
        carried = np.where(off > 0, self.low[word + 1] << ((U(64) - off) & U(63)), U(0))
        return (out | carried) & U((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or -1: the successor in the key's bucket of equal high bits, if it is the key."""
        if not self.n or not len(keys):
            return np.full(len(keys), -1)
        keys = keys.astype(U)
        high = (keys >> U(self.bits)).astype(np.int64)
        before = np.where(high > 0, self._zero(np.maximum(high - 1, 0)), -1)
        lo, end = before + 1 - high, self._run_end(before + 1) - high
        if (far := np.flatnonzero(end < lo)).size:
            end[far] = self._zero(high[far]) - high[far]
        hi, low = end.copy(), keys & U((1 << self.bits) - 1)
        while (busy := np.flatnonzero(lo < hi)).size:
            mid = (lo[busy] + hi[busy]) >> 1
            less = self._low(mid) < low[busy]
            lo[busy] = np.where(less, mid + 1, lo[busy])
            hi[busy] = np.where(less, hi[busy], mid)
        ok = lo < end
        ok[ok] = self._low(lo[ok]) == low[ok]
        return np.where(ok, lo, -1)


def codes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit codes of the values and the 256 values they stand for: the means of equal steps between the extremes."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(256, np.float32)
    low, high = values.min(), values.max()
    code = np.minimum((values - low) * (256 / (high - low)), 255).astype(np.uint8) if high > low else np.zeros(len(values), np.uint8)
    sums, n = np.bincount(code, values, 256), np.bincount(code, minlength=256)
    return code, np.where(n > 0, sums / np.maximum(n, 1), 0).astype(np.float32)


def save_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: the head's length, a head of names, types and places, and the arrays."""
    places, parts, at = {}, [], 0
    for name, x in arrays.items():
        raw = np.ascontiguousarray(x).tobytes()
        places[name] = (x.dtype.str, len(x), at)
        parts += [raw, bytes(-len(raw) % 64)]
        at += len(raw) + len(parts[-1])
    head = json.dumps(places).encode()
    head += b" " * (-(len(head) + 8) % 64)
    put(uri, [struct.pack("<Q", len(head)), head, *parts])


def load_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays, mapped into memory where storage is mounted, else read."""
    store, path = filesystem(uri)
    if store.type_name == "local":
        raw = np.memmap(path, np.uint8, "r")
    else:
        with store.open_input_file(path) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    begin = 8 + int(raw[:8].view("<u8")[0])
    return {name: raw[begin + at : begin + at + n * np.dtype(kind).itemsize].view(kind) for name, (kind, n, at) in json.loads(bytes(raw[8:begin])).items()}


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 on, in the narrowest type, byte plane after byte plane, compressed."""
    out, press = [], zstandard.ZstdCompressor(1)
    for x in arrays:
        small = x.astype(np.min_scalar_type(int(x.max()))) if len(x) else np.empty(0, np.uint8)
        body = press.compress(small.view(np.uint8).reshape(len(x), small.itemsize).T.tobytes())
        out += [struct.pack("<BQQ", small.itemsize, len(x), len(body)), body]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at, press = [], 0, zstandard.ZstdDecompressor()
    while at < len(data):
        width, n, size = struct.unpack_from("<BQQ", data, at)
        at += struct.calcsize("<BQQ")
        planes = np.frombuffer(press.decompress(data[at : at + size], max_output_size=width * n), np.uint8).reshape(width, n)
        values = np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()
        out.append(values.astype(np.int32 if width < 4 else np.int64))
        at += size
    return out


class Vocabulary:
    """Numbers and counts of words, in shards by the word's hash; and the most frequent ones."""

    def __init__(self, folder: str):
        with (lambda s, p: s.open_input_file(p))(*filesystem(f"{folder}/meta.json")) as f:
            self.meta = json.loads(f.read())
        self.shift = U(64 - self.meta["shard_bits"])
        self.offsets, self.tokens = np.array(self.meta["offsets"], np.int64), self.meta["tokens"]
        self.top = self.meta["top"]
        self.size, self.total = self.top + self.meta["words"], self.tokens + self.meta["words"] + 1
        self.shards = [load_arrays(f"{folder}/words-{s}.bin") for s in range(len(self.offsets))]
        self.keys = [EliasFano(*(x[f] for f in EliasFano.FIELDS)) for x in self.shards]
        top = load_arrays(f"{folder}/words-top.bin")
        self.top_counts, order = top["counts"], np.argsort(top["words"])
        self.top_words, self.top_numbers = top["words"][order], order

    def by_shard(self, shard: np.ndarray):
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(len(self.offsets) + 1))
        return [(s, order[a:b]) for s, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each hash; -1: unknown."""
        words, inverse = np.unique(hashes, return_inverse=True)
        out = np.full(len(words), -1)
        if len(self.top_words):
            at = np.minimum(np.searchsorted(self.top_words, words), len(self.top_words) - 1)
            out = np.where(self.top_words[at] == words, self.top_numbers[at], -1)
        rest = np.flatnonzero(out < 0)
        shard = (words[rest] >> self.shift).astype(np.int64)
        for s, i in self.by_shard(shard):
            local = self.keys[s].find(words[rest[i]] - (U(s) << self.shift))
            out[rest[i]] = np.where(local >= 0, local + self.offsets[s] + self.top, -1)
        return out[inverse]

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """Training counts; 0 for -1 and the size."""
        words, inverse = np.unique(numbers, return_inverse=True)
        out = np.zeros(len(words), np.int64)
        top, rest = (words >= 0) & (words < self.top), np.flatnonzero((words >= self.top) & (words < self.size))
        out[top] = self.top_counts[words[top]]
        shard = np.searchsorted(self.offsets, words[rest] - self.top, "right") - 1
        for s, i in self.by_shard(shard):
            out[rest[i]] = self.shards[s]["counts"][words[rest[i]] - self.top - self.offsets[s]]
        return out[inverse]

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1.0) / self.total

    def splits(self, words: np.ndarray) -> np.ndarray:
        """Over how many shards the n-grams with this middle word are dealt."""
        return np.minimum(1 + self.counts(words) // self.meta["tokens_per_shard"], self.meta["parts"])

    def first_part(self, words: np.ndarray) -> np.ndarray:
        return (mix(words.astype(U) + U(1)) % U(self.meta["parts"])).astype(np.int64)

    def by_part(self, mid: np.ndarray, left: np.ndarray, right: np.ndarray, other: np.ndarray | None = None):
        """(shard, packed n-grams) of every shard that gets some; left: number + 1, or 0 for none.

        Without other, equal n-grams are one with their count; with it, it is packed in place of the count.
        """
        words, at = np.unique(mid, return_inverse=True)
        splits = self.splits(words)[at]
        part = (self.first_part(words)[at] + (mix(left.astype(U)) % splits.astype(U)).astype(np.int64)) % self.meta["parts"]
        context = at * (self.size + 1) + left
        order = np.lexsort((right, context, part) if other is None else (context, part))
        mid, left, right, part, context = (x[order] for x in (mid, left, right, part, context))
        fresh = np.append(True, context[1:] != context[:-1]) if len(context) else np.empty(0, bool)
        if other is None:
            each = np.flatnonzero(fresh | np.append(True, right[1:] != right[:-1]))
            other = np.diff(each, append=len(right))
            mid, left, right, part, fresh = (x[each] for x in (mid, left, right, part, fresh))
        else:
            other = other[order]
        cuts = np.searchsorted(part, np.arange(self.meta["parts"] + 1))
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if b > a:
                begins = a + np.flatnonzero(fresh[a:b])
                yield p, pack(np.diff(mid[begins], prepend=0), left[begins], np.diff(begins, append=b), right[a:b], other[a:b])


def grams(data: bytes) -> tuple[np.ndarray, ...]:
    """mid, left, right, other of by_part's packed n-grams."""
    steps, left, runs, right, other = unpack(data)
    return np.repeat(np.cumsum(steps, dtype=np.int64), runs), np.repeat(left, runs), right, other


@lru_cache(2)
def vocabulary(folder: str) -> Vocabulary:
    return Vocabulary(folder)


def tokens_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of texts, each text closed by the end token, and the texts' lengths."""
    each = [np.append(word_hashes(t), END) for t in texts]
    return np.concatenate(each), np.array([len(x) for x in each])


def text_groups(batch, column: int, chars: int = 1_000_000):
    """(first row, texts) of about chars characters."""
    group, first, size = [], 0, 0
    for i, t in enumerate(batch.column(column)):
        group.append(t := t.as_py())
        size += len(t or "")
        if size >= chars:
            yield first, group
            group, first, size = [], i + 1, 0
    if group:
        yield first, group


def count_unigrams(batches):
    """Words and their counts, merged in memory and handed on when they are many."""
    parts, size = [], 0

    def merged():
        words, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        each, at = np.unique(words, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(np.bincount(at, counts).astype(np.int64))], names=["word", "c"])

    for batch in batches:
        for _, texts in text_groups(batch, 0):
            parts.append(np.unique(tokens_of(texts)[0], return_counts=True))
            size += len(parts[-1][0])
            if size > PARCEL:
                yield merged()
                size = 0
    if parts:
        yield merged()


def write_words(folder: str, shard_bits: int):
    """Writes each shard of the vocabulary: its words in order, and their counts."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            shards = batch.column(0).to_numpy()
            for s in np.unique(shards):
                held.setdefault(int(s), []).append([batch.column(c).to_numpy()[shards == s] for c in ("word", "c")])
        for s, parts in held.items():
            word, c = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield write_word_shard(folder, s, shard_bits, word.view(U), c)

    return run


def write_word_shard(folder: str, shard: int, shard_bits: int, word: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(word)
    keys = EliasFano.build(word[order] - (U(shard) << U(64 - shard_bits)), 1 << (64 - shard_bits))
    save_arrays(f"{folder}/words-{shard}.bin", {f: getattr(keys, f) for f in EliasFano.FIELDS} | {"counts": c[order]})
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(c)], pa.int64())], names=["shard", "n"])


def contexts(vocabulary: Vocabulary, texts) -> tuple[np.ndarray, ...]:
    """Of each token of texts: its text's place, its number and those of the word before and of the one before that (-1: unknown, or none); and the texts' lengths."""
    hashes, lengths = tokens_of(texts)
    right, starts = vocabulary.numbers(hashes), np.zeros(len(hashes), bool)
    right = right.astype(np.int32 if vocabulary.size < 2**31 - 1 else np.int64)
    starts[np.cumsum(lengths)[:-1]] = True
    starts[:1] = True
    none = np.array([-1], right.dtype)
    mid = np.append(none, right[:-1])
    mid[starts] = -1
    left = np.append(none, mid[:-1])
    left[starts] = -1
    return np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), right, mid, left, lengths


def rows_of(found) -> pa.RecordBatch:
    """Batch of (parcel, part, data)."""
    parcel, part, data = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(parcel, pa.int64()), pa.array(part, pa.int32()), pa.array(data, pa.binary())], names=["parcel", "part", "data"])


def deal_grams(folder: str):
    """The n-grams of training texts, counted parcel by parcel."""

    def run(batches):
        model, held, size = vocabulary(folder), [], 0

        def deal():
            mid, left, right = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return rows_of([(0, p, data) for p, data in model.by_part(mid, left + 1, right)])

        for batch in batches:
            for _, texts in text_groups(batch, 0):
                _, right, mid, left, _ = contexts(model, texts)
                known = mid >= 0
                held.append((mid[known], left[known], right[known]))
                size += int(known.sum())
                if size >= PARCEL:
                    yield deal()
                    size = 0
        if size:
            yield deal()

    return run


SPLIT = "mid long, right long, c long"


def write_part(folder: str):
    """Counts a shard's n-grams and writes its levels; returns its share of the bigrams of words that are split over shards."""

    def run(batches):
        model, held = vocabulary(folder), {}
        for batch in batches:
            for p, data in zip(batch.column("part").to_pylist(), batch.column("data"), strict=True):
                held.setdefault(p, []).append(data.as_py())
        for p, blocks in held.items():
            mid, left, right, c = (np.concatenate(x) for x in zip(*map(grams, filter(None, blocks)), strict=True)) if any(blocks) else [np.empty(0, np.int64)] * 4
            blocks.clear()
            words, at = np.unique(mid, return_inverse=True)
            context = at * (model.size + 1) + left
            order = np.lexsort((right, context))
            context, right = context[order], right[order]
            each = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (right[1:] != right[:-1]))[: len(order)])
            c = np.add.reduceat(c[order], each) if len(each) else c
            at, left, right = at[order][each], left[order][each], right[each]
            split = model.splits(words) > 1
            pairs, sums = bigrams(model, at, right, c)
            save_arrays(f"{folder}/grams-{p}.bin", levels(model, words, split, pairs, sums, at, left, right, c))
            hot = split[pairs // model.size]
            yield pa.RecordBatch.from_arrays([pa.array(words[pairs[hot] // model.size].astype(np.int64)), pa.array(pairs[hot] % model.size), pa.array(sums[hot])], names=["mid", "right", "c"])

    return run


def bigrams(model: Vocabulary, at: np.ndarray, right: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs, where = np.unique(at * model.size + right, return_inverse=True)
    return pairs, np.bincount(where, c, len(pairs)).astype(np.int64)


def level(name: str, values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    keys = EliasFano.build(values, max(1, universe))
    return {f"{name}.{f}": getattr(keys, f) for f in EliasFano.FIELDS}


def coded(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    code, book = codes(np.log10(values))
    return {name: code, f"{name}.book": book}


def smoothed(model: Vocabulary, total: np.ndarray, of: np.ndarray, last: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of bigrams (place of the first word, number of the last, count), and the first words' back-off weights, from these words' counts."""
    kept = sums - DISCOUNT
    back = np.maximum(1 - np.bincount(of, kept, len(total)) / np.maximum(total, 1), 1e-9)
    return kept / total[of] + back[of] * model.probability(model.counts(last)), back


def levels(model: Vocabulary, words, split, pairs, sums, at, left, right, c) -> dict[str, np.ndarray]:
    """A shard's arrays from its n-grams (place of the middle word, left, right, count), in order, and its bigrams; those of split words are written elsewhere."""
    size, own = model.size, ~split[pairs // model.size]
    pairs, sums = pairs[own], sums[own]
    p2, b2 = smoothed(model, model.counts(words), pairs // size, pairs % size, sums)

    inner = left > 0
    heads, place = np.unique(at[inner] * (size + 1) + left[inner], return_inverse=True)
    kept, totals = c[inner] - DISCOUNT, np.bincount(place, c[inner], len(heads))
    b3 = np.maximum(1 - np.bincount(place, kept, len(heads)) / np.maximum(totals, 1), 1e-9)
    out = level("word", words, size) | level("two", pairs, len(words) * size) | level("head", heads, len(words) * (size + 1)) | level("three", place * size + right[inner], len(heads) * size)
    return out | coded("p2", p2) | coded("b2", b2) | coded("d3", kept / totals[place]) | coded("b3", b3)


def write_split(folder: str):
    """Writes the bigrams of each split word, whose rows (mid, right, c) come together, as a file."""

    def run(batches):
        model, held, word = vocabulary(folder), [], None

        def close():
            right, c = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(right)
            right, c = right[order], c[order]
            p2, b2 = smoothed(model, model.counts(np.array([word])), np.zeros(len(right), np.int64), right, c)
            save_arrays(f"{folder}/split-{word}.bin", level("two", right, model.size) | coded("p2", p2) | coded("b2", b2))
            return pa.RecordBatch.from_arrays([pa.array([word], pa.int64())], names=["mid"])

        for batch in batches:
            mid, right, c = (batch.column(i).to_numpy() for i in range(3))
            for w in np.unique(mid):
                if held and w != word:
                    yield close()
                word, own = int(w), mid == w
                held.append((right[own], c[own]))
        if held:
            yield close()

    return run


class Part:
    """A shard of the trie, or the bigrams of a split word."""

    def __init__(self, uri: str):
        x = load_arrays(uri)
        self.keys = {n: EliasFano(*(x[f"{n}.{f}"] for f in EliasFano.FIELDS)) for n in ("word", "two", "head", "three") if f"{n}.head" in x}
        self.codes = {n: (x[n], x[f"{n}.book"].astype(float)) for n in ("p2", "b2", "d3", "b3") if n in x}

    def value(self, name: str, at: np.ndarray, missing: np.ndarray | float) -> np.ndarray:
        """log10 at each place; missing where that is -1."""
        code, book = self.codes[name]
        return np.where(at >= 0, book[code[np.maximum(at, 0)]], missing) if len(code) else np.broadcast_to(missing, at.shape)

    def backed(self, p: np.ndarray, first: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
        """log10 of bigrams' probabilities: place of the first word (-1: none), number of the last, p without context."""
        return self.value("p2", found(self.keys["two"], first, last, size), p + self.value("b2", first, 0.0))

    def log_probs(self, folder: str, model: Vocabulary, mid: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """log10 of each word's probability; right: number, or the vocabulary's size if unknown; left: number + 1, or 0."""
        words, inverse = np.unique(mid, return_inverse=True)
        at = self.keys["word"].find(words)[inverse]
        p = np.log10(model.probability(model.counts(right)))
        split = model.splits(words) > 1
        hot = split[inverse]
        p[~hot] = self.backed(p[~hot], at[~hot], right[~hot], model.size)
        for i in np.flatnonzero(split):
            own = np.flatnonzero(inverse == i)
            p[own] = split_word(folder, int(words[i])).backed(p[own], np.zeros(len(own), np.int64), right[own], model.size)
        heads = found(self.keys["head"], np.where(left > 0, at, -1), left, model.size + 1)
        three = found(self.keys["three"], heads, right, model.size)
        p += self.value("b3", heads, 0.0)
        return np.where(three >= 0, np.log10(10 ** self.value("d3", three, -np.inf) + 10**p), p)


@lru_cache(64)
def split_word(folder: str, word: int) -> Part:
    return Part(f"{folder}/split-{word}.bin")


def found(level: EliasFano, context: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """Places of context * size + last; -1 where there is none, no context or no such word."""
    out, some = np.full(len(context), -1), np.flatnonzero((context >= 0) & (last < size))
    out[some] = level.find(context[some] * size + last[some])
    return out


def train(docs: DataFrame, folder: str, tokens_per_shard: int = 2_000_000, words_per_shard: int = 2_000_000, top_words: int = TOP) -> dict:
    """Builds the trie of docs' texts under folder (shared storage) and returns its meta data.

    Null texts count as empty ones: an end token each. Without documents the model has no words. Other columns of
    docs are ignored.
    """
    spark, texts = docs.sparkSession, docs.select("text")
    unigrams = written(texts.mapInArrow(count_unigrams, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")), "unigrams")
    total = unigrams.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tokens, words = int(total[0]), int(total[1])
    bits = max(1, (words // words_per_shard).bit_length())
    rows = unigrams.select(F.expr(f"CAST(shiftrightunsigned(word, {64 - bits}) AS INT)").alias("shard"), "word", "c")
    sizes = dict(rows.repartitionById(1 << bits, "shard").mapInArrow(write_words(folder, bits), "shard int, n long").collect())  # one number a shard
    offsets = [0]
    for s in range(1 << bits):
        offsets.append(offsets[-1] + sizes.get(s, 0))
        if s not in sizes:
            write_word_shard(folder, s, bits, np.empty(0, U), np.empty(0, np.int64))
    top = sorted(unigrams.where(F.col("c") * top_words >= tokens).collect(), key=lambda r: (-r.c, r.word))  # top_words at most, as their counts add up to no more than tokens
    save_arrays(f"{folder}/words-top.bin", {"words": np.array([r.word for r in top], np.int64).view(U), "counts": np.array([r.c for r in top], np.int64)})
    parts = 1 + tokens // tokens_per_shard
    meta = {"tokens": tokens, "words": words, "shard_bits": bits, "offsets": offsets[:-1], "parts": parts, "tokens_per_shard": tokens_per_shard, "top": top_words}
    put(f"{folder}/meta.json", [json.dumps(meta).encode()])

    dealt = texts.mapInArrow(deal_grams(folder), "parcel long, part int, data binary")
    every = spark.range(parts).select(F.lit(0).cast("long").alias("parcel"), F.col("id").cast("int").alias("part"), F.lit(b"").alias("data"))  # shards without n-grams are written too
    split = written(dealt.union(every).repartitionById(parts, "part").mapInArrow(write_part(folder), SPLIT), "split")
    split = split.groupBy("mid", "right").agg(F.sum("c").alias("c")).repartition("mid").sortWithinPartitions("mid")
    written(split.mapInArrow(write_split(folder), "mid long"), "split-words")
    return meta


def deal_tokens(folder: str):
    """Every token with a known word before it, dealt to the shards, and one row (part, data) of each parcel with its documents.

    The latter has id, whether it is null, tokens, known tokens, base score, and the score of the tokens without context.
    """

    def run(batches):
        model, at = vocabulary(folder), TaskContext.get().partitionId() << 24
        held, docs, size = [], [], 0

        def deal(parcel):
            mid, left, right, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            facts = [np.concatenate(x) for x in zip(*docs, strict=True)]
            held.clear()
            docs.clear()
            head = pack(*[x.view(U) if x.dtype == float else x.astype(np.int64).view(U) for x in facts])
            return rows_of([(parcel, parcel % model.meta["parts"], b"d" + head), *((parcel, p, b"t" + data) for p, data in model.by_part(mid, left, right, doc))])

        for batch in batches:
            for first, texts in text_groups(batch, 1):
                doc, right, mid, left, lengths = contexts(model, texts)
                begin, counts = np.append(0, np.cumsum(lengths)[:-1]), model.counts(right)
                logs, known = np.log10(model.probability(counts)), mid >= 0
                ids = batch.column(0).slice(first, len(texts))
                docs.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), lengths, np.add.reduceat(counts > 0, begin, dtype=np.int64), np.add.reduceat(logs, begin), np.add.reduceat(np.where(known, 0.0, logs), begin)))
                before = sum(len(x[0]) for x in docs) - len(texts)
                held.append((mid[known], left[known] + 1, np.where(right < 0, model.size, right)[known], doc[known] + before))
                size += len(right)
                if size >= PARCEL:
                    yield deal(at)
                    at, size = at + 1, 0
        if docs:
            yield deal(at)

    return run


def score_part(folder: str, tokens: int = 500_000):
    """Rows of documents as they are, and for each block of tokens the sums of its documents' log-probabilities, in single precision."""

    def run(batches):
        model, part, shard, held, size = vocabulary(folder), None, None, [], 0

        def judge():
            blocks = [grams(data) for _, data in held]
            p = shard.log_probs(folder, model, *(np.concatenate([b[i] for b in blocks]) for i in range(3)))
            out, at = [], 0
            for (parcel, _), (_, _, _, doc) in zip(held, blocks, strict=True):
                some, inverse = np.unique(doc, return_inverse=True)
                out.append((parcel, part, b"t" + pack(some, np.bincount(inverse, p[at : at + len(doc)]).astype(np.float32).view(np.uint32))))
                at += len(doc)
            held.clear()
            return rows_of(out)

        for batch in batches:
            for parcel, p, data in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if data[:1] == b"d":
                    yield rows_of([(parcel, p, data)])
                    continue
                if held and (p != part or size >= tokens):
                    yield judge()
                    size = 0
                if p != part:
                    part, shard = p, Part(f"{folder}/grams-{p}.bin")
                held.append((parcel, data[1:]))
                size += struct.unpack_from("<BQQ", data, 1)[1] * 4
        if held:
            yield judge()

    return run


SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def add_up(batches):
    """Documents of each parcel, from its rows, which come together."""

    def close(rows):
        ids, null, n, known, base, score = (x.astype(np.int64) for x in next(unpack(x[1:]) for x in rows if x[:1] == b"d"))
        base, score = base.view(float), score.view(float)
        for x in rows:
            if x[:1] == b"t":
                doc, sums = unpack(x[1:])
                score[doc] += sums.astype(np.uint32).view(np.float32)
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=null.astype(bool)), pa.array(n), pa.array(known), pa.array(base), pa.array(score)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    at, rows = None, []
    for batch in batches:
        for parcel, data in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            if rows and parcel != at:
                yield close(rows)
                rows = []
            at = parcel
            rows.append(data.as_py())
    if rows:
        yield close(rows)


def score(docs: DataFrame, folder: str, meta: dict) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row of docs.

    base_score sums log10 of add-one unigrams with exact counts, score those of the trie. A null text counts as empty: its
    end token alone. Rows that repeat are scored as often as they come; other columns are ignored. docs must be a scan
    of a stored table, which gives the same partitions each time, so a repeated task makes the same parcels.
    """
    rows = "parcel long, part int, data binary"
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(deal_tokens(folder), rows).repartitionById(meta["parts"], "part")
    return dealt.mapInArrow(score_part(folder), rows).repartition("parcel").sortWithinPartitions("parcel", "part").mapInArrow(add_up, SCORED)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    meta = train(docs.where(F.coalesce(crc_fold("doc_id", 7) != 2, F.lit(True))), folder := work_path(spark, "trie"))
    held_out = F.coalesce(crc_fold("doc_id", 7) == 2, F.lit(False))
    return score(docs, folder, meta).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(meta["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
