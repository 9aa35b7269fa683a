"""Language-model scoring with a sharded Elias-Fano n-gram trie.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased, and one end. Unigrams are smoothed by adding 0.1.
N-grams of two and three words count, of all words and alike at every size; nothing is pruned. Absolute discounting:
P(w|u,v) = max(c(u,v,w) - D, 0) / c(u,v) + rest(u,v) * P(w|v), likewise P(w|v) from c(v,w) and P(w), with rests so that all sums to 1. A text starts after ends.

The corpus is counted and scored by shards, not by one process. A batch of documents sends each shard the distinct n-grams of three words whose middle word
is of the shard: with them the shard knows every context of one and of two words that ends in that word, and its successors. It sums the counts of all
batches, builds its tries, and tells each batch in the order it was asked what an n-gram adds to its last word's unigram and how much of that is left;
the batch then scores its documents. A batch or a shard is of BATCH_BYTES of text or so, at any size of the corpus; an n-gram is one entry a batch however often it stands there.
Words are told apart by 64 bits of hash, the words around a middle word by BITS. N-grams travel as Elias-Fano code too.

A trie has contexts and the successors of each. Contexts, pointers and successors are monotone sequences in Elias-Fano code, discounted probabilities and rests are
quantised to bytes; all levels lie in one memory-mapped buffer (anonymous: no folder of an executor is shared). Queries go through it in blocks: a block of
contexts is decoded, its pointers give each context's range, and a successor is searched for within that range.

Null is empty text: its only token is the end. Repeated rows count as often as they stand and score alike. Without training text every count is 0.
A column of keep that has the name of a result gives way to it.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import chunks, mix, release, utf8, words

DISCOUNT, BITS, ORDER, BATCH_BYTES = 0.75, 23, 3, 8 << 20
#: Middle words of a message to a shard at most.
MIDDLES = 1 << 16
#: Elements between samples of an Elias-Fano sequence, and contexts that a query decodes at once.
EVERY, CONTEXTS = 4096, 1 << 15
END = np.uint64(0x5851F42D4C957F2D)
RESULT = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "mean_score")


class EliasFano:
    """A monotone sequence of integers below a bound: low bits as they are, high bits in unary. Every EVERYth place in the high bits is noted, so any range decodes alone."""

    def __init__(self, values: np.ndarray, bound: int):
        n = len(values)
        self.n, self.width = n, min(56, max(0, (max(1, bound) // max(1, n)).bit_length() - 1))
        values = values.astype(np.uint64)
        packed = []
        for i in range(0, n if self.width else 0, 1 << 16):
            each = np.unpackbits(values[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, : self.width]
            packed.append(np.packbits(each.ravel(), bitorder="little"))
        self.low = np.concatenate([*packed, np.zeros(8, np.uint8)])
        ones = (values >> np.uint64(self.width)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        self.high = np.packbits(high, bitorder="little")
        self.samples = np.append(ones[::EVERY], len(high)).astype("<u4" if len(high) < 1 << 32 else "<u8")

    def parts(self) -> list[np.ndarray]:
        return [self.low, self.high, self.samples.view(np.uint8)]

    def place(self, parts: list[np.ndarray]) -> None:
        """Takes the parts from elsewhere."""
        self.low, self.high, self.samples = parts[0], parts[1], parts[2].view(self.samples.dtype)

    def decode(self, a: int, b: int) -> np.ndarray:
        """The values a to b."""
        if a >= b:
            return np.zeros(0, np.uint64)
        first, last = a // EVERY, -(-b // EVERY)
        begin, end = int(self.samples[first]), int(self.samples[last]) if last < len(self.samples) else int(self.samples[-1])
        bits = np.unpackbits(self.high[begin >> 3 : -(-end >> 3)], bitorder="little")[begin & 7 :][: end - begin]
        ones = np.flatnonzero(bits)[a - first * EVERY : b - first * EVERY] + begin
        at = np.arange(a, b)
        out = (ones - at).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            place = at * self.width
            eight = np.ndarray(max(0, len(self.low) - 7), "<u8", self.low, strides=(1,))  # eight bytes from each byte
            out |= (eight[place >> 3] >> (place & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1)
        return out

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return np.array([self.decode(i, i + 1)[0] for i in np.atleast_1d(at).tolist()], np.int64)

    def tobytes(self) -> bytes:
        return np.array([self.n, self.width, len(self.low), len(self.high)], "<i8").tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def frombytes(cls, data: bytes) -> np.ndarray:
        """All values."""
        self = cls.__new__(cls)
        self.n, self.width, low, high = np.frombuffer(data, "<i8", 4).tolist()
        self.low, self.high = np.frombuffer(data, np.uint8, low, 32), np.frombuffer(data, np.uint8, high, 32 + low)
        self.samples = np.concatenate([np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[::EVERY], [8 * high]])
        return self.decode(0, self.n)


class Codebook:
    """log10 values as bytes; the steps are quantiles, so that common values lose little."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(np.quantile(values, np.linspace(0, 1, 256))) if len(values) else np.zeros(1)

    def codes(self, values: np.ndarray) -> np.ndarray:
        middle = (self.values[1:] + self.values[:-1]) / 2
        return np.searchsorted(middle, values).astype(np.uint8)


class Trie:
    """Contexts and their successors with discounted probabilities. pairs: context * size + word, sorted and distinct; total: of each context id; words are below size - 1."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, total: np.ndarray, size: int | None = None, discount: float = DISCOUNT):
        self.size = size = size or len(total) + 1
        seen = (counts > discount) & (pairs % size < size - 1)
        pairs, counts = pairs[seen], counts[seen]
        context = pairs // size
        start = np.flatnonzero(np.diff(context, prepend=-1))
        share = (counts - discount) / np.maximum(total[context], 1)
        used = np.add.reduceat(share, start) if len(start) else np.zeros(0)
        self.shares = Codebook(np.log10(share))
        codes = self.shares.codes(np.log10(share))
        rest = np.log10(np.maximum(1 - used, 1e-6))
        self.rests = Codebook(rest)
        rank = np.repeat(np.arange(len(start)), np.diff([*start, len(context)]))
        self.contexts = EliasFano(context[start], max(1, len(total)))
        self.pointers = EliasFano(np.array([*start, len(context)]), len(context) + 1)
        self.successors = EliasFano(rank * size + pairs % size, max(1, len(start)) * size)
        coded = (self.contexts, self.pointers, self.successors)
        levels = [*(x for c in coded for x in c.parts()), codes, self.rests.codes(rest)]
        self.bytes = sum(x.nbytes for x in levels)
        self.map = mmap.mmap(-1, max(1, self.bytes + 8 * len(levels)))
        placed, at = [], 0
        for level in levels:
            self.map[at : at + level.nbytes] = level.tobytes()
            placed.append(np.frombuffer(self.map, np.uint8, level.nbytes, at))
            at += -(-level.nbytes // 8) * 8
        for i, c in enumerate(coded):
            c.place(placed[3 * i : 3 * i + 3])
        self.codes, self.rest_codes = placed[9:]

    def find(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(discounted share, rest) of each pair, in ascending order; an unseen context has share 0 and rest 1."""
        share, rest = np.zeros(len(pairs), np.float32), np.ones(len(pairs), np.float32)
        asked = pairs // self.size
        for a in range(0, self.contexts.n, CONTEXTS):
            b = min(a + CONTEXTS, self.contexts.n)
            contexts, pointers = self.contexts.decode(a, b).astype(np.int64), self.pointers.decode(a, b + 1).astype(np.int64)
            own = np.arange(*np.searchsorted(asked, [contexts[0], contexts[-1] + 1]))
            node = np.searchsorted(contexts, asked[own])
            known = contexts[node] == asked[own]
            own, node = own[known], node[known]
            rest[own] = 10 ** self.rests.values[self.rest_codes[a + node]]
            found = self.successors.decode(int(pointers[0]), int(pointers[-1])).astype(np.int64)
            target = (a + node) * self.size + pairs[own] % self.size
            low, end = pointers[node] - pointers[0], pointers[node + 1] - pointers[0]
            high = end.copy()
            while (open_ := np.flatnonzero(low < high)).size:  # relative to each context's range
                middle = (low[open_] + high[open_]) >> 1
                less = found[middle] < target[open_]
                low[open_], high[open_] = np.where(less, middle + 1, low[open_]), np.where(less, high[open_], middle)
            hit = np.flatnonzero(low < end)
            hit = hit[found[low[hit]] == target[hit]]
            share[own[hit]] = 10 ** self.shares.values[self.codes[pointers[0] + low[hit]]]
        return share, rest


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts with the end after each, and the first token of each text (one more entry than texts)."""
    tokens, first = words(texts)
    return np.insert(tokens, first[1:], END), first + np.arange(len(first))


def _sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    start = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ keys.dtype.type(1))) if len(keys) else np.zeros(0, np.int64)
    return keys[start], np.add.reduceat(counts, start) if len(start) else counts


class Counter:
    """Sums counts by key in parts, so that little more than the distinct keys is held."""

    def __init__(self):
        self.keys, self.counts, self.parts, self.waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys.astype(np.uint64), counts.astype(np.int64)))
        self.waiting += len(keys)
        if self.waiting > max(1 << 20, len(self.keys)):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        if self.parts:
            self.keys, self.counts = _sum(np.concatenate([self.keys, *(k for k, _ in self.parts)]), np.concatenate([self.counts, *(c for _, c in self.parts)]))
            self.parts, self.waiting = [], 0
        return self.keys, self.counts


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Of each hash its shard; shards are ranges, so sorted hashes are sorted by shard."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _runs(sorted_: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.zeros(0, np.int64)


def _ranges(sorted_: np.ndarray) -> list[tuple[int, int]]:
    """The runs of equal values."""
    start = _runs(sorted_).tolist()
    return list(zip(start, [*start[1:], len(sorted_)][: len(start)], strict=True))


def _squeezed(values: np.ndarray) -> bytes:
    data = values.tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unsqueezed(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), kind)


def _order(rank: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by rank and key, beginnings of runs of equal ones in that order). Keys are of 2 * BITS bits."""
    if len(rank) and int(rank.max()) >> (64 - 2 * BITS):
        order = np.lexsort((key, rank))
        new = np.append(True, (np.diff(rank[order]) != 0) | (key[order][1:] != key[order][:-1]))
        return order, np.flatnonzero(new)
    whole = rank.astype(np.uint64) << np.uint64(2 * BITS) | key
    order = np.argsort(whole)
    return order, _runs(whole[order])


class Grams:
    """The distinct n-grams of three words of tokens (all texts of a batch), by middle word, first and last word."""

    def __init__(self, tokens: np.ndarray, first: np.ndarray):
        place = np.arange(len(tokens)) - np.repeat(first[:-1], np.diff(first))
        before = [np.full(len(tokens), END) for _ in range(2)]
        for back in (1, 2):
            before[back - 1][back:] = np.where(place[back:] >= back, tokens[:-back], END)
        self.words, self.of = np.unique(tokens, return_inverse=True)  # a middle word is a token: each stands before one, or is the end, where a text starts
        ends = int(np.searchsorted(self.words, END))
        rank = np.full(len(tokens), ends)
        rank[1:] = np.where(place[1:] >= 1, self.of[:-1], ends)
        short = np.uint64((1 << BITS) - 1)
        key = (before[1] & short) << np.uint64(BITS) | tokens & short
        order, start = _order(rank, key)
        self.rank, self.key = rank[order][start], key[order][start]
        self.place = np.empty(len(tokens), np.int64)
        self.place[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))


def _messages(grams: Grams, counts: np.ndarray, shards: int) -> list[tuple[int, int, bytes, bytes, bytes, bytes]]:
    """(shard, part, words, n-grams of each word, n-grams, counts): what a batch asks; parts of MIDDLES words at most."""
    shard = _shard(grams.words, shards)
    out = []
    for a, b in _ranges(shard):
        s = int(shard[a])
        for part, at in enumerate(range(a, b, MIDDLES)):
            end = min(at + MIDDLES, b)
            lo, hi = np.searchsorted(grams.rank, [at, end])
            runs = np.bincount(grams.rank[lo:hi] - at, minlength=end - at).astype(np.uint32)
            coded = EliasFano((grams.rank[lo:hi] - at).astype(np.uint64) << np.uint64(2 * BITS) | grams.key[lo:hi], (end - at) << 2 * BITS)
            base = grams.words[at : at + 1]
            words_ = EliasFano(grams.words[at:end] - base, int(grams.words[end - 1] - base[0]) + 1)
            out.append((s, part, base.tobytes() + words_.tobytes(), _squeezed(runs), coded.tobytes(), _squeezed(counts[lo:hi].astype(np.uint32))))
    return out


def _answers(asked: list[tuple[bytes, bytes, bytes, bytes]], longest: int = ORDER) -> list[tuple[bytes, bytes, bytes]]:
    """For each message: log10 of what an n-gram has beside its last word's unigram, log10 of what is left for that, and the count of each middle word."""
    names = [np.frombuffer(a[0], np.uint64, 1) + EliasFano.frombytes(a[0][8:]) for a in asked]
    runs = [_unsqueezed(a[1], np.uint32) for a in asked]
    grams = [EliasFano.frombytes(a[2]) for a in asked]
    middles, of = np.unique(np.concatenate(names), return_inverse=True)
    cut = np.cumsum([0, *(len(x) for x in names)])
    rank = np.concatenate([np.repeat(of[cut[i] : cut[i + 1]], n) for i, n in enumerate(runs)])
    key = np.concatenate(grams) & np.uint64((1 << 2 * BITS) - 1)
    order, start = _order(rank, key)
    each = np.diff(np.append(start, len(order)))
    count = np.concatenate([_unsqueezed(a[3], np.uint32) for a in asked]).astype(np.int64)[order]
    count = np.add.reduceat(count, start) if len(start) else count
    rank, key = rank[order][start], key[order][start].astype(np.int64)
    size, word = (1 << BITS) + 1, key & ((1 << BITS) - 1)
    # two words: the same last word after a middle word, whatever stands before
    pairs = rank * size + word
    by = np.argsort(pairs, kind="stable")
    begin = _runs(pairs[by])
    total = np.bincount(rank, count, len(middles)).astype(np.int64)
    two = Trie(pairs[by][begin], np.add.reduceat(count[by], begin) if len(begin) else count, total, size)
    share, rest = (np.repeat(x, np.diff(np.append(begin, len(by)))) for x in two.find(pairs[by][begin]))
    lower, left = np.empty(len(by), np.float32), np.empty(len(by), np.float32)
    lower[by], left[by] = share, rest
    share, rest = np.zeros(len(by), np.float32), np.ones(len(by), np.float32)
    if longest == 3:
        context = np.cumsum(np.append(False, (rank[1:] != rank[:-1]) | (key[1:] >> BITS != key[:-1] >> BITS))) if len(rank) else rank
        share, rest = Trie(context * size + word, count, np.bincount(context, count).astype(np.int64), size).find(context * size + word)
    with np.errstate(divide="ignore"):
        told = [np.log10(x).astype(np.float16) for x in (share + rest * lower, rest * left)]
    back = np.empty(len(order), np.int64)
    back[order] = np.repeat(np.arange(len(start)), each)
    out, at = [], 0
    for i, g in enumerate(grams):
        own = back[at : at + len(g)]
        at += len(g)
        out.append((_squeezed(told[0][own]), _squeezed(told[1][own]), _squeezed(total[of[cut[i] : cut[i + 1]]])))
    return out


def _table(rows: list[tuple], kinds: tuple[tuple[str, pa.DataType], ...]) -> pa.Table:
    return pa.table({c: pa.array([x[i] for x in rows], t) for i, (c, t) in enumerate(kinds)})


def score(docs: DataFrame, train: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), order: int = ORDER, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """id_col, the columns of keep, and n_tokens, n_known, train_tokens long, base_score, score and mean_score (score by token) double of each row.
    train: SQL condition of the rows that are learned from (null: not); order: words of the longest n-grams, two or three."""
    if order not in (2, 3):
        raise ValueError("n-grams are of two or three words")
    spark = docs.sparkSession
    docs = docs.withColumn("_train", F.coalesce(F.expr(train), F.lit(False))).withColumn("_text", F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    docs = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys((id_col, *keep)) if c not in (*RESULT, "_text", "_train", "_batch")), "_text", "_train")
    kept = [c for c in docs.columns if c not in ("_text", "_train")]
    size = docs.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // batch_bytes + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for batch in batches:
            texts = utf8(batch.filter(batch.column("_train")).column("_text"))
            for a, b in chunks(texts):
                seen.add(*np.unique(token_hashes(texts[a:b])[0], return_counts=True))
        keys, counts = seen.settle()
        shard = _shard(keys, shards)
        for a, b in _ranges(shard):
            yield pa.RecordBatch.from_pydict({"shard": [int(shard[a])], "keys": [keys[a:b].tobytes()], "n": [int(counts[a:b].sum())]}, pa.schema([("shard", pa.int64()), ("keys", pa.binary()), ("n", pa.int64())]))

    def total(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = Counter(), 0
        for part in parts:
            for k, c in zip(part.column("keys").to_pylist(), part.column("n").to_pylist(), strict=True):
                seen.add(np.frombuffer(k, np.uint64), np.zeros(len(k) // 8, np.int64))
                n += c
        yield pa.RecordBatch.from_pydict({"n": [n], "v": [len(seen.settle()[0])]}, pa.schema([("n", pa.int64()), ("v", pa.int64())]))

    counted = docs.mapInArrow(count, "shard bigint, keys binary, n bigint").groupBy("shard").applyInArrow(total, "n bigint, v bigint")
    n, v = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    release(spark)

    def tokens_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        texts, tokens, first, at = utf8(table.column("_text").combine_chunks()), [], [np.zeros(1, np.int64)], 0
        for a, b in chunks(texts):
            own, start = token_hashes(texts[a:b])
            tokens.append(own)
            first.append(start[1:] + at)
            at += len(own)
        return np.concatenate(tokens), np.concatenate(first)

    def ask(table: pa.Table) -> pa.Table:
        tokens, first = tokens_of(table)
        grams = Grams(tokens, first)
        trained = np.repeat(np.array(table.column("_train").to_pylist(), bool), np.diff(first))
        batch = table.column("_batch")[0].as_py()
        found = _messages(grams, np.bincount(grams.place, trained, len(grams.key)), shards)
        return _table([(batch, *x) for x in found], (("batch", pa.int64()), ("shard", pa.int64()), ("part", pa.int64()), *((c, pa.binary()) for c in ("words", "runs", "grams", "counts"))))

    def answer(asked: pa.Table) -> pa.Table:
        told = _answers(list(zip(*(asked.column(c).to_pylist() for c in ("words", "runs", "grams", "counts")), strict=True)), order)
        names = zip(*(asked.column(c).to_pylist() for c in ("batch", "shard", "part")), strict=True)
        return _table([(*x, *t) for x, t in zip(names, told, strict=True)], (("batch", pa.int64()), ("shard", pa.int64()), ("part", pa.int64()), *((c, pa.binary()) for c in ("a", "b", "c"))))

    def rate(table: pa.Table, told: pa.Table) -> pa.Table:
        tokens, first = tokens_of(table)
        grams = Grams(tokens, first)
        sent = np.lexsort([told.column(c).to_numpy() for c in ("part", "shard")]).tolist()
        beside, left, ones = (np.concatenate([_unsqueezed(parts[i], t) for i in sent]) for parts, t in ((told.column("a").to_pylist(), np.float16), (told.column("b").to_pylist(), np.float16), (told.column("c").to_pylist(), np.int64)))
        if (len(beside), len(ones)) != (len(grams.key), len(grams.words)):
            raise RuntimeError("a batch of documents is not the one that asked")
        c = ones[grams.of]
        p = (c + 0.1) / (n + 0.1 * (v + 1))
        own = (10 ** beside.astype(np.float64))[grams.place] + (10 ** left.astype(np.float64))[grams.place] * p
        start = first[:-1]
        known, base, model = (np.add.reduceat(x, start) for x in ((c > 0).astype(np.int64), np.log10(p), np.log10(own)))
        size = np.diff(first).astype(np.int64)
        made = (size, known, np.full(len(start), n, np.int64), base, model, model / size)
        return pa.table({**{c: table.column(c) for c in kept}, **dict(zip(RESULT, made, strict=True))})

    # The batch of a row is drawn: equal rows, however many, are dealt out; both uses read one exchange.
    grouped = docs.withColumn("_batch", F.floor(F.rand(20240611) * shards).cast("bigint"))
    asked = grouped.groupBy("_batch").applyInArrow(ask, "batch bigint, shard bigint, part bigint, words binary, runs binary, grams binary, counts binary")
    told = asked.groupBy("shard").applyInArrow(answer, "batch bigint, shard bigint, part bigint, a binary, b binary, c binary")
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, mean_score double"])
    return grouped.groupBy("_batch").cogroup(told.groupBy("batch")).applyInArrow(rate, schema)
