"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that starts anywhere else go.

Every window of LENGTH bytes is owned by one anchor, the KGRAM bytes in it of the least hash (ties: the first), so equal windows have equal anchors at
equal places and consecutive windows share one. An anchor stands for its run of windows: key is the anchor's hash, span that of all bytes of the run.
A key seen once settles that none of its windows is repeated, a span seen twice that all are; both are counts, combined before the shuffle. For
keys with several spans, the text around one example of each span is gathered by key, and the suffixes from the anchors are sorted both ways:
prefix polynomial hashes and binary search give common extensions, mergesort compares by them, and the extensions of
neighbours are verified byte by byte. Windows at the same place before the anchor are equal exactly if no neighbour between them has shorter extensions.
A key of more than HOT spans is not gathered: its windows are counted one by one by 128-bit hashes.

Null text is empty, and texts shorter than LENGTH keep everything. Rows of equal id and text count as often as they stand.
Spans are compared by 128 bits of hash.

Texts can also be sequences of words (``[^\\x20\\x09-\\x0D]+``) instead of bytes: a unit is then the word's 64-bit hash, and lengths and positions count words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import BYTE_VALUES, SPACE, chunks, mix, powers, prefix_hashes, release, scratch, span_hashes, stored, utf8

LENGTH, KGRAM, HOT = 400, 64, 20_000
#: Passages of over 50 words count whatever their bytes. Words of an anchor, where texts are sequences of words.
WORDS, WORD_KGRAM = 51, 8
#: Bytes of a unit: of a byte, and of a word's hash.
BYTE, WORD = 1, 8
#: Windows of a text that are looked at together; of a longer text, pieces overlap by LENGTH - 1 bytes.
PIECE = 4 << 20
#: Contexts that are sorted together, if no group is larger.
GATHER = 1024


def word_units(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, starts, ends) of the words of each text; case counts, spaces do not."""
    for a, b in chunks(texts):
        data = np.frombuffer(b" ".join(texts[a:b]) + b" ", np.uint8)
        edge = np.flatnonzero(np.diff(SPACE[data].view(np.int8), prepend=1))
        start, end = edge[0::2], edge[1::2]
        hashes = mix(span_hashes(prefix_hashes(BYTE_VALUES[data]), start, end) ^ (end - start).astype(np.uint64))
        at = np.cumsum([0, *(len(x) + 1 for x in texts[a:b])])
        first = np.searchsorted(start, at)
        for i in range(b - a):
            own = slice(first[i], first[i + 1])
            yield hashes[own], start[own] - at[i], end[own] - at[i]


def sequences(texts: list[bytes], unit: int) -> list[bytes]:
    """Texts as they are compared: their bytes, or the hashes of their words."""
    return texts if unit == BYTE else [hashes.tobytes() for hashes, _, _ in word_units(texts)]


def units(data: bytes, unit: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if unit == BYTE else np.uint64)


def unit_values(data: np.ndarray, unit: int) -> np.ndarray:
    return BYTE_VALUES[data] if unit == BYTE else data


class Anchors:
    """The anchors of texts: row, at (anchor), first and last (of its run of windows) as positions in the text, key and span."""

    def __init__(self, texts: list[bytes], length: int, kgram: int, unit: int = BYTE):
        parts = []
        for a, b in chunks(texts):
            if len(texts[a]) // unit > PIECE + length:  # alone in its range
                whole = texts[a]
                for at in range(0, len(whole) // unit - length + 1, PIECE):
                    parts.append(self._of([whole[at * unit : (at + PIECE + length - 1) * unit]], a, at, length, kgram, unit))
            else:
                parts.append(self._of(texts[a:b], a, 0, length, kgram, unit))
        self.row, self.at, self.first, self.last, self.key, self.span = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*parts, strict=True) if parts else [[]] * 6))

    @staticmethod
    def _of(texts: list[bytes], row: int, offset: int, length: int, kgram: int, unit: int) -> tuple[np.ndarray, ...]:
        none = np.zeros(0, np.int64)
        sizes = np.array([len(t) // unit for t in texts])
        if (sizes < length).all():
            return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
        data = units(b"".join(texts), unit)
        end = np.cumsum(sizes)
        begin = end - sizes
        values = unit_values(data, unit)
        near, far = prefix_hashes(values), prefix_hashes(values, 1)
        n, width = len(data) - kgram + 1, length - kgram + 1
        grams = mix((near[kgram:] - near[:-kgram]) * powers(n, 0, True))
        low = np.uint64((1 << 24) - 1)
        ranked = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
        ranked[:n] = (grams & ~low) | np.arange(n, dtype=np.uint64)
        blocks = ranked.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = np.concatenate([np.arange(b, e - length + 1) for b, e in zip(begin, end, strict=True) if e - b >= length])
        owner = (np.minimum(behind[starts], ahead[starts + width - 1]) & low).astype(np.int64)
        edge = np.flatnonzero(np.diff(owner, prepend=-1))
        first, last, at = starts[edge], starts[np.append(edge[1:], len(starts)) - 1], owner[edge]
        span = mix(span_hashes(far, first, last + length, 1) ^ mix(((at - first) << 24 | (at - last)).astype(np.uint64)))
        own = np.searchsorted(end, at, side="right")
        shift = offset - begin[own]
        return own + row, at + shift, first + shift, last + shift, grams[at], span


class Contexts:
    """Texts around anchors in groups: order by mergesort of suffixes, by hashes."""

    def __init__(self, group: np.ndarray, texts: list[bytes], before: np.ndarray, unit: int = BYTE):
        self.group, self.data, self.unit = group, b"".join(texts), unit
        sizes = np.array([len(t) // unit for t in texts])
        begin = np.cumsum(sizes) - sizes
        self.at, self.before, self.after = begin + before, before, sizes - before
        self.units = units(self.data, unit)
        self.prefix = prefix_hashes(unit_values(self.units, unit))
        self.inverse = powers(len(self.prefix), 0, True)

    def common(self, i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
        """Length of the common extension from the anchors of i and j, by binary search."""
        reach = self.before if back else self.after
        low, high = np.zeros(len(i), np.int64), np.minimum(reach[i], reach[j])
        a, b = self.at[i], self.at[j]
        while (low < high).any():
            middle = (low + high + 1) >> 1
            x, y = (a - middle, b - middle) if back else (a, b)
            same = (self.prefix[x + middle] - self.prefix[x]) * self.inverse[x] == (self.prefix[y + middle] - self.prefix[y]) * self.inverse[y]
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def less(self, i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
        reach = self.before if back else self.after
        n = self.common(i, j, back)
        ended = n >= np.minimum(reach[i], reach[j])
        step = -1 - n if back else n
        x, y = (self.units[np.clip(self.at[k] + step, 0, len(self.units) - 1)] for k in (i, j))
        return np.where(ended, (reach[i] < reach[j]) | (reach[i] == reach[j]) & (i < j), x < y)

    def order(self, back: bool) -> tuple[np.ndarray, np.ndarray]:
        """(suffixes in order, group by group; common extension of each with the one before it, -1 for the first of a group)."""
        n = len(self.group)
        order = np.arange(n)
        start = np.searchsorted(self.group, self.group)
        stop = np.searchsorted(self.group, self.group, side="right")
        place, width = order - start, 1
        while width < (stop - start).max(initial=1):
            run = place // width
            left = run % 2 == 0
            low = np.minimum(start + (run ^ 1) * width, stop)
            high = np.minimum(low + width, stop)
            base = low.copy()
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) >> 1
                mine, other, first = order[open_], order[middle], left[open_]
                less = self.less(np.where(first, other, mine), np.where(first, mine, other), back)
                right = np.where(first, less, ~less)
                low[open_], high[open_] = np.where(right, middle + 1, low[open_]), np.where(right, high[open_], middle)
            to = start + run // 2 * 2 * width + place % width + low - base
            merged = np.empty(n, np.int64)
            merged[to] = order
            order, width = merged, 2 * width
        common = np.full(n, -1)
        inner = np.flatnonzero(place[1:] > 0) + 1
        common[inner] = self.common(order[inner - 1], order[inner], back)
        if not self.verified(order, common, inner, back):
            return self.by_bytes(back)
        return order, common

    def suffix(self, i: int, back: bool) -> list[int]:
        at = self.at[i]
        return (self.units[at - self.before[i] : at][::-1] if back else self.units[at : at + self.after[i]]).tolist()

    def verified(self, order: np.ndarray, common: np.ndarray, inner: np.ndarray, back: bool) -> bool:
        """Whether the bytes of all common extensions are equal; false after a collision of hashes."""
        at, data = self.at * self.unit, self.data
        for a, b, n in zip(at[order[inner - 1]].tolist(), at[order[inner]].tolist(), (common[inner] * self.unit).tolist(), strict=True):
            if (data[a - n : a] != data[b - n : b]) if back else (data[a : a + n] != data[b : b + n]):
                return False
        return True

    def by_bytes(self, back: bool) -> tuple[np.ndarray, np.ndarray]:
        order = sorted(range(len(self.group)), key=lambda i: (self.group[i], self.suffix(i, back), i))
        common = []
        for k, i in enumerate(order):
            if not k or self.group[order[k - 1]] != self.group[i]:
                common.append(-1)
                continue
            a, b = self.suffix(order[k - 1], back), self.suffix(i, back)
            common.append(next((x for x, (c, d) in enumerate(zip(a, b, strict=False)) if c != d), min(len(a), len(b))))
        return np.array(order), np.array(common)


def repeated(group: np.ndarray, texts: list[bytes], most: np.ndarray, least: np.ndarray, length: int, unit: int = BYTE) -> list[list[tuple[int, int]]]:
    """For each context the ranges of l, first and last, for which its window of length units from l before the anchor equals another's of its group. Groups are sorted; most and least: the range of l that is its own."""
    contexts = Contexts(group, texts, most, unit)
    n = len(texts)
    sides = []
    for back in (False, True):
        order, common = contexts.order(back)
        sides.append((order, common))
    found = np.zeros((n, int(most.max()) + 3), bool)
    for l in range(int(least.min()), int(most.max()) + 1):
        own = np.flatnonzero((least <= l) & (l <= most))
        if len(own) < 2:
            continue
        pair = np.zeros(n, np.int64)
        for (order, common), need in zip(sides, (length - l, l), strict=True):
            kind = np.empty(n, np.int64)
            kind[order] = np.cumsum((common < need) | (common < 0))
            pair = pair * (n + 1) + kind
        pair = pair[own]
        order = np.argsort(pair, kind="stable")
        same = pair[order][1:] == pair[order][:-1]
        found[own[order[1:][same]], l + 1] = True
        found[own[order[:-1][same]], l + 1] = True
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    row, edge = np.nonzero(np.diff(found.view(np.int8), axis=1))
    for i, a, b in zip(row[0::2].tolist(), edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
        out[i].append((a, b - 1))
    return out


def _verdicts(docs: DataFrame, kinds: tuple[tuple[int, int, int], ...], hot: int) -> DataFrame:
    """(r1, r2, marks: array of unit, key, span, ranges - null if all windows are repeated). docs: r1, r2, text; kinds: unit, length and kgram of what is compared, each unit once."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    of = {unit: (length, kgram) for unit, length, kgram in kinds}

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column("text"))
            for unit, length, kgram in kinds:
                found = Anchors(sequences(texts, unit), length, kgram, unit)
                order = np.lexsort((found.span, found.key, found.row))
                row, key, span = found.row[order], found.key[order], found.span[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1]) | (span[1:] != span[:-1])
                start = np.flatnonzero(new)
                n = np.diff(np.append(start, len(row)))
                row = pa.array(row[start])
                made = [pa.array(np.full(len(start), unit)), pa.array(key[start].view(np.int64)), pa.array(span[start].view(np.int64)), batch.column("r1").take(row), batch.column("r2").take(row), pa.array(n)]
                yield pa.RecordBatch.from_arrays(made, ["unit", "key", "span", "r1", "r2", "n"])

    anchors = stored(docs.mapInArrow(emit, "unit bigint, key bigint, span bigint, r1 bigint, r2 bigint, n bigint"), "anchors")
    repeats = not docs.groupBy("r1", "r2").count().where("count > 1").isEmpty()
    spans = anchors.groupBy("unit", "key", "span").agg(F.sum("n").alias("n"), F.min(F.struct("r1", "r2")).alias("at"))
    of_key = {c: F.expr(f"{x} over (partition by unit, key)") for c, x in (("spans", "count(*)"), ("all", "sum(n)"), ("least", "min(n)"))}
    known = stored(spans.withColumns(of_key).where("all > 1").drop("all"), "spans")
    release(spark)
    wanted = known.where("spans > 1 and least = 1").groupBy("at.r1", "at.r2").agg(F.collect_list(F.struct("unit", "key", "span", "n", "spans")).alias("wanted"))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column("text"))
            for a in range(0, len(texts), 128):
                wants = batch.column("wanted").slice(a, 128).to_pylist()
                out: dict[str, list] = {c: [] for c in ("unit", "key", "span", "n", "spans", "most", "least", "around")}
                for unit, length, kgram in kinds:
                    some = sequences(texts[a : a + 128], unit)
                    found = Anchors(some, length, kgram, unit)
                    begin = np.searchsorted(found.row, np.arange(len(some) + 1))
                    for i, text in enumerate(some):
                        where = {}
                        for k in range(begin[i + 1] - 1, begin[i] - 1, -1):
                            where[int(found.key[k]), int(found.span[k])] = k
                        done = set()
                        for w in wants[i]:
                            if w["unit"] != unit:
                                continue
                            k = where[w["key"] & 0xFFFFFFFFFFFFFFFF, w["span"] & 0xFFFFFFFFFFFFFFFF]
                            if k in done:
                                continue
                            done.add(k)
                            for c in ("unit", "key", "span", "n", "spans"):
                                out[c].append(w[c])
                            out["most"].append(int(found.at[k] - found.first[k]))
                            out["least"].append(int(found.at[k] - found.last[k]))
                            out["around"].append(text[found.first[k] * unit : (found.last[k] + length) * unit])
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(c, pa.int64()) for c in ("unit", "key", "span", "n", "spans", "most", "least")] + [("around", pa.binary())]))

    schema = "unit bigint, key bigint, span bigint, n bigint, spans bigint, most bigint, least bigint, around binary"
    held_once = docs.join(wanted, ["r1", "r2"])
    contexts = (held_once.dropDuplicates(["r1", "r2"]) if repeats else held_once).mapInArrow(around, schema)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
            of_unit = table.column("unit").to_numpy()
            for unit in np.unique(of_unit).tolist():
                own = table.filter(pa.array(of_unit == unit))
                keys, spans_, n, most, least = (own.column(c).to_numpy() for c in ("key", "span", "n", "most", "least"))
                ranges = repeated(np.cumsum(np.diff(keys, prepend=keys[0]) != 0), own.column("around").to_pylist(), most, least, of[unit][0], unit)
                keep = [i for i, (r, c) in enumerate(zip(ranges, n, strict=True)) if r and c == 1]
                told = pa.array([[{"a": a, "b": b} for a, b in ranges[i]] for i in keep], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
                yield pa.RecordBatch.from_pydict({"unit": np.full(len(keep), unit), "key": keys[keep], "span": spans_[keep], "ranges": told})

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= GATHER:
                table = pa.Table.from_batches(held)
                ids = [table.column(c).to_numpy() for c in ("unit", "key")]
                before = np.flatnonzero((ids[0] != ids[0][-1]) | (ids[1] != ids[1][-1]))
                if len(before):
                    cut = int(before[-1]) + 1
                    yield from settle(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from settle(pa.Table.from_batches(held))

    ranged = "unit bigint, key bigint, span bigint, ranges array<struct<a:bigint,b:bigint>>"
    marks = [known.where("n > 1").select("unit", "key", "span", F.lit(None).cast("array<struct<a:bigint,b:bigint>>").alias("ranges"))]
    sizes = {(r[0], r[1]) for r in known.where("spans > 1 and least = 1").select("unit", (F.col("spans") > hot).alias("h")).distinct().collect()}
    if any(not h for _, h in sizes):
        marks.append(contexts.where(F.col("spans") <= hot).repartition(parts, "unit", "key").sortWithinPartitions("unit", "key", "span").mapInArrow(sort, ranged))
    marks += [_counted(contexts.where((F.col("spans") > hot) & (F.col("unit") == unit)), of[unit][0], unit) for unit, h in sorted(sizes) if h]
    found = marks[0]
    for m in marks[1:]:
        found = found.unionAll(m)
    found = stored(found, "marks")
    release(spark)
    held = anchors.select("unit", "key", "span", "r1", "r2")
    held = held.dropDuplicates() if repeats else held  # equal rows have the same anchors
    return held.join(found, ["unit", "key", "span"]).groupBy("r1", "r2").agg(F.collect_list(F.struct("unit", "key", "span", "ranges")).alias("marks"))


def _counted(contexts: DataFrame, length: int, unit: int) -> DataFrame:
    """(unit, key, span, ranges) of spans seen once, by counting every window; for keys of too many spans for one task."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, span, n, most, least, text in zip(*(batch.column(c).to_pylist() for c in ("key", "span", "n", "most", "least", "around")), strict=True):
                values = unit_values(units(text, unit), unit)
                start = np.arange(most - least + 1)
                l = most - start
                hashes = [mix(span_hashes(prefix_hashes(values, b), start, start + length, b) ^ mix(l.astype(np.uint64) + np.uint64(b))).view(np.int64) for b in (0, 1)]
                yield pa.RecordBatch.from_pydict({"key": np.full(len(l), key), "span": np.full(len(l), span), "n": np.full(len(l), n), "l": l, "h1": hashes[0], "h2": hashes[1]})

    each = contexts.mapInArrow(windows, "key bigint, span bigint, n bigint, l bigint, h1 bigint, h2 bigint")
    often = each.groupBy("key", "h1", "h2").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    found = each.where("n = 1").join(often, ["key", "h1", "h2"]).groupBy("key", "span").agg(F.collect_list(F.struct(F.col("l").alias("a"), F.col("l").alias("b"))).alias("ranges"))
    return found.select(F.lit(unit).cast("bigint").alias("unit"), "key", "span", "ranges")


def removed(text: bytes, marks: list[dict], length: int, kgram: int, unit: int = BYTE) -> np.ndarray:
    """Mask of the units that go, by the marks of that unit."""
    edge = np.zeros(len(text) // unit + 1, np.int64)
    by = {(m["key"] & 0xFFFFFFFFFFFFFFFF, m["span"] & 0xFFFFFFFFFFFFFFFF): m["ranges"] for m in marks if m["unit"] == unit}
    if by:
        found = Anchors([text], length, kgram, unit)
        for key, span, at, first, last in zip(found.key.tolist(), found.span.tolist(), found.at.tolist(), found.first.tolist(), found.last.tolist(), strict=True):
            if (key, span) not in by:
                continue
            ranges = by[key, span]
            for a, b in [(first, last)] if ranges is None else [(at - r["b"], at - r["a"]) for r in ranges]:
                edge[a] += 1
                edge[b + length] -= 1
    return np.cumsum(edge)[:-1] > 0


def removed_words(text: bytes, marks: list[dict], words: int) -> tuple[np.ndarray, int]:
    """(mask of the bytes of the words that go, and of the spaces between them; how many words go)."""
    mask = np.zeros(len(text), bool)
    if not any(m["unit"] == WORD for m in marks):
        return mask, 0
    hashes, start, end = next(word_units([text]))
    which = removed(hashes.tobytes(), marks, words, min(words, WORD_KGRAM), WORD)
    gone = np.diff(which.view(np.int8), prepend=0, append=0)
    for a, b in zip(np.flatnonzero(gone == 1).tolist(), np.flatnonzero(gone == -1).tolist(), strict=True):
        mask[start[a] : end[b - 1]] = True
    return mask, int(which.sum())


def _marked(docs: DataFrame, columns: list[str], made: str, row: Callable, length: int, kgram: int, hot: int, id_col: str, text_col: str, words: int = 0) -> DataFrame:
    """columns of docs and what row(text, mask or None of the bytes, mask of the words' bytes or None, words that go) makes of each. words: least words of a passage that goes whatever its length; 0: none."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    who = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    rest = F.struct(*(F.col(f"`{c}`") for c in columns)) if columns else F.struct(F.lit(1).alias("_"))
    rows = docs.select(F.xxhash64(who, text).alias("r1"), F.xxhash64(text, F.lit("rows")).alias("r2"), text.alias("text"), rest.alias("rest"))
    kinds = ((BYTE, length, kgram), *(((WORD, words, min(words, WORD_KGRAM)),) if words else ()))
    with scratch(docs.sparkSession) as kept:
        marks = kept(_verdicts(rows.select("r1", "r2", "text"), kinds, hot))
    joined = rows.join(marks, ["r1", "r2"], "left").select("rest", "text", "marks")
    fields = [docs.schema[c] for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column("text"))
            out = []
            for i, t in enumerate(texts):
                own = batch.column("marks")[i].as_py()
                out.append(row(t, removed(t, own, length, kgram), *removed_words(t, own, words)) if own else row(t, None, None, 0))
            parts = [pa.array(list(x)) for x in zip(*out, strict=True)] if out else []
            if not out:
                continue
            kept = batch.column("rest")
            yield pa.RecordBatch.from_arrays([*(kept.field(c) for c in columns), *parts], [*columns, *(x.split()[0] for x in made.split(", "))])

    return joined.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), made]))


def digests(docs: DataFrame, length: int = LENGTH, kgram: int = KGRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans (maximal removed runs) long and kept_sha256 string of each row, as the strings of length bytes have it; and
    n_passage_words long: how many of its words are in passages of that many words and more that stand more than once, however few their bytes."""

    def row(text: bytes, mask: np.ndarray | None, by_words: np.ndarray | None, n: int):
        if mask is None:
            return len(text), 0, 0, hashlib.sha256(text).hexdigest(), 0
        runs = int(np.count_nonzero(np.diff(mask.view(np.int8), prepend=0) == 1))
        return len(text), int(mask.sum()), runs, hashlib.sha256(np.frombuffer(text, np.uint8)[~mask].tobytes()).hexdigest(), n

    made = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passage_words bigint"
    return _marked(docs, [id_col], made, row, length, kgram, hot, id_col, text_col, words)


def dedup(docs: DataFrame, length: int = LENGTH, kgram: int = KGRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", out_col: str = "_kept", words: int = 0) -> DataFrame:
    """docs, each row with its remaining text in out_col, which replaces a column of that name; of characters that are cut in two nothing is left.
    words: a passage of so many words that stands more than once goes too, however few its bytes; 0: bytes alone count."""

    def row(text: bytes, mask: np.ndarray | None, by_words: np.ndarray | None, n: int):
        return (text.decode(errors="replace") if mask is None else np.frombuffer(text, np.uint8)[~(mask | by_words)].tobytes().decode(errors="ignore"),)

    return _marked(docs, [c for c in docs.columns if c != out_col], f"{out_col} string", row, length, kgram, hot, id_col, text_col, words)
