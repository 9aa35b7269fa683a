"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

A text's set holds 64-bit hashes of its distinct shingles of k words; texts of equal sets are one class. Two classes link when
100 * intersection >= percent * union. The lowest hashes of a set, a little more than the prefix in which two linked sets must share one, are its keys.
Linked sets then share as many keys as are spare, and one more; so each set leaves out as many of its most frequent keys as it has spare ones, and
those that nobody shares. Most texts have no key left.

1. Of each key's sets, those of a size band and the next are compared with the band's first, the one that has the most keys in common with others. In a
   group of near copies nearly all become one component at once.
2. Where a key's sets are still of several components, they go to tiles of a size band and its neighbour, those of many sets to several tiles of
   TILE rows a side; a tile compares bitmaps: bits that only one of two has bound their intersection from above. Of the pairs that pass, a tile
   proposes those that would join its components, the likeliest first. Keys of few sets give their pairs, told apart first, to the same bound,
   and each set proposes its likeliest partner.
3. What is proposed is compared exactly, on sorted arrays. Pairs that passed and were not proposed, and are still of different components, are compared too.

near_duplicates makes no list of pairs within a component; links does. Null texts, and texts without words, have an empty set and link with nothing; a text of fewer than k
words is one shingle. Repeated rows are copies, and a row counts whatever its id: null ids link as others do. Sets of different texts are told apart by 64 bits of
hash, and class ids of different sets are checked against 64 more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import chunks, components, dropped, mix, release, scratch, stored, utf8, words

#: Keys of up to FEW sets give their pairs as rows; those of more go to tiles of TILE rows a side.
FEW, TILE, FLUSH, PAIRS, BROADCAST_IDS = 64, 1024, 1 << 18, 1 << 16, 500_000
#: Bytes of keys of a bucket, and buckets that a batch is dealt to at once.
BUCKET_BYTES, WAYS = 8 << 20, 2048
_STEP = np.uint64(0xA0761D6478BD642F)


def shingle_sets(texts: list[bytes], k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes) of each text."""
    for a, b in chunks(texts):
        tokens, first = words(texts[a:b])
        n = max(0, len(tokens) - k + 1)
        hashes = np.zeros(n, np.uint64)
        for j in range(k):
            hashes = hashes * _STEP + tokens[j : j + n]
        hashes = mix(hashes)
        for i in range(b - a):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= k:
                yield a + i, np.unique(hashes[lo : hi - k + 1])
            elif hi > lo:
                whole = np.array([hi - lo], np.uint64)
                for t in tokens[lo:hi]:
                    whole = whole * _STEP + t
                yield a + i, mix(whole ^ np.uint64(0x1234567))
            else:
                yield a + i, hashes[:0]


def class_id(hashes: np.ndarray) -> int:
    """One number for a set."""
    return int(mix(mix(hashes).sum(keepdims=True) + np.uint64(len(hashes)))[0].view(np.int64))


def least_common(n: int, percent: int) -> int:
    """The least intersection of a set of n with any that it links to."""
    return -(-n * percent // 100)


def lengths(n: int, percent: int) -> tuple[int, int]:
    """(prefix, keys): two linked sets share an element of their prefixes, and 1 + keys - prefix of their keys."""
    p = n - least_common(n, percent) + 1
    return p, min(n, p + p // 4 + 1)


def bitmap(hashes: np.ndarray) -> bytes:
    """A power of two of bits, at least eight times as many as hashes, and 64: few of another set's elements hide behind it."""
    bits = max(64, 8 << (max(1, len(hashes)) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(hashes >> np.uint64(40)).astype(np.int64) & (bits - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def folded(bitmaps: list[bytes], size: int) -> np.ndarray:
    """Bitmaps as rows of size bytes; larger ones are folded, which keeps the bound."""
    out = np.zeros((len(bitmaps), size), np.uint8)
    for i, x in enumerate(bitmaps):
        out[i] = np.bitwise_or.reduce(np.frombuffer(x, np.uint8).reshape(-1, size), axis=0)
    return out.view(np.uint64)


def bounds(n: np.ndarray, maps: list[bytes], component: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For a row of left at a time: the rows of right, of different components, that it may link with by size and bit counts, and how much of their union they may share."""
    rows = folded(maps, min(len(x) for x in maps))
    for i in left.tolist():
        j = right[component[right] != component[i]]
        low, high = np.minimum(n[j], n[i]), np.maximum(n[j], n[i])
        j = j[100 * low >= percent * high]
        if not len(j):
            continue
        alone = np.bitwise_count(rows[i] & ~rows[j]).sum(axis=1, dtype=np.int64)
        others = np.bitwise_count(rows[j] & ~rows[i]).sum(axis=1, dtype=np.int64)
        bound = np.minimum(n[i] - alone, n[j] - others)
        union = n[i] + n[j] - bound
        fits = 100 * bound >= percent * union
        if fits.any():
            yield i, j[fits], bound[fits] / union[fits]


def forest(component: np.ndarray, a: np.ndarray, b: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Indexes of the pairs that join components which no likelier pair has joined."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    taken = []
    for i in np.argsort(-share, kind="stable").tolist():
        x, y = root(int(component[a[i]])), root(int(component[b[i]]))
        if x != y:
            parent[x] = y
            taken.append(i)
    return np.array(taken, np.int64)


def classes(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(row, id, n, class, check, bitmap, keys) of each row, stored; row: a hash of id and text."""
    schema = f"row bigint, id {docs.schema[id_col].dataType.simpleString()}, n bigint, class bigint, check bigint, bitmap binary, keys binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, name, check, maps, keys = [], [], [], [], []
            for _, hashes in shingle_sets(utf8(batch.column("text")), k):
                n.append(len(hashes))
                name.append(class_id(hashes))
                check.append(int(mix(hashes ^ _STEP).sum().view(np.int64)))
                maps.append(bitmap(hashes))
                keys.append(hashes[: lengths(len(hashes), percent)[1]].tobytes())
            made = [pa.array(x, t) for x, t in ((n, pa.int64()), (name, pa.int64()), (check, pa.int64()), (maps, pa.binary()), (keys, pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), *made], ["row", "id", "n", "class", "check", "bitmap", "keys"])

    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    named = stored(docs.select(F.xxhash64(text, id_).alias("row"), id_.alias("id"), text.alias("text")).mapInArrow(run, schema), "classes")
    if not named.groupBy("class").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b").isEmpty():
        raise ValueError("two different sets have one class id; choose another multiplier")
    return named


_PACKED = ("keys", "classes", "ns", "held")
_PACKED_SCHEMA = pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in _PACKED)])
_PACKED_DDL = "bucket bigint, keys binary, classes binary, ns binary, held binary"


def _packed(bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket that occurs, with its part of each column."""
    order = np.argsort(bucket, kind="stable")
    names, start = np.unique(bucket[order], return_index=True)
    end = np.append(start[1:], len(order))
    parts = [[x[order[s:e]].tobytes() for s, e in zip(start.tolist(), end.tolist(), strict=True)] for x in columns]
    return pa.RecordBatch.from_arrays([pa.array(names), *(pa.array(x, pa.binary()) for x in parts)], schema=_PACKED_SCHEMA)


def _unpacked(batch: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(batch.column(c).to_pylist()), t) for c, t in zip(_PACKED, (np.uint64, np.int64, np.int32, np.int32), strict=True)]


def _keys(named: DataFrame, ways: int = WAYS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(key, class, n, held): keys of two classes or more; held: about how many classes have the key; stored.

    Keys move packed by bucket. Of those that FLUSH keys or so hold of one key, two go to its bucket and show that it is shared; the others are shared for
    certain and go anywhere, so that a key of very many sets fills no bucket. More buckets than ways are dealt in two steps."""
    spark = named.sparkSession
    size = named.agg(F.coalesce(F.sum(F.octet_length("keys")), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * size // bucket_bytes + 1)
    coarse = -(-buckets // ways)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, done, turn = 0, set(), 0

        def flush() -> pa.RecordBatch:
            keys = np.frombuffer(b"".join(h[1] for h in held), np.uint64)
            counts = [len(h[1]) // 8 for h in held]
            names, ns = (np.repeat(np.array([h[i] for h in held]), counts) for i in (0, 2))
            order = np.lexsort((names, keys))
            keys, names, ns = keys[order], names[order], ns[order].astype(np.int32)
            start = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ np.uint64(1)))
            count = np.diff(np.append(start, len(keys)))
            place, often = np.arange(len(keys)) - np.repeat(start, count), np.repeat(count, count).astype(np.int32)
            bucket = (keys % np.uint64(buckets)).astype(np.int64)
            sure = place > 1
            bucket[sure] = -1 - (int(names[0]) + turn) % buckets
            return _packed(bucket // coarse, [keys, names, ns, often])

        for batch in batches:
            for name, n, keys in zip(*(batch.column(c).to_pylist() for c in ("class", "n", "keys")), strict=True):
                if name in done:
                    continue
                done.add(name)
                held.append((name, keys, n))
                size += len(keys) // 8
                if size >= FLUSH:
                    yield flush()
                    held, size, turn = [], 0, turn + 1
                    done.clear()
        if held:
            yield flush()

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.slice(i, 1)
                columns, at = _unpacked(own), own.column("bucket")[0].as_py()
                yield _packed((columns[0] % np.uint64(buckets)).astype(np.int64) if at >= 0 else np.full(len(columns[0]), at * coarse), columns)

    def group(table: pa.Table) -> pa.Table:
        keys, names, ns, held = _unpacked(table)
        order = np.lexsort((names, keys))
        keys, names = keys[order], names[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (names[1:] != names[:-1])
        keys, names, order = keys[new], names[new], order[new]
        start = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ np.uint64(1)))
        count = np.diff(np.append(start, len(keys)))
        often = np.maximum(np.repeat(count, count), held[order])
        keep = (np.repeat(count, count) > 1) | (table.column("bucket")[0].as_py() < 0)
        return pa.table({"key": keys[keep].view(np.int64), "class": names[keep], "n": ns[order][keep].astype(np.int64), "held": often[keep].astype(np.int64)})

    found = named.where("n > 0").select("class", "n", "keys").mapInArrow(emit, _PACKED_DDL)
    if coarse > 1:
        found = found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket").mapInArrow(finer, _PACKED_DDL)
    keys = stored(found.groupBy("bucket").applyInArrow(group, "key bigint, class bigint, n bigint, held bigint"), "keys")
    release(spark)
    return keys


def _fits(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _few_first(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it has up to BROADCAST_IDS rows (of a few numbers each)."""
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def _linked(pairs: DataFrame, docs: DataFrame, named: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of classes that link, by exact intersection; stored. The texts of one row of each class are read again and, if few are wanted, not shuffled."""
    wanted = _few_first(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column("text"))
            for at in range(0, len(texts), 128):
                out: tuple[list, list] = ([], [])
                for _, hashes in shingle_sets(texts[at : at + 128], k):
                    if len(hashes):
                        out[0].append(class_id(hashes))
                        out[1].append(hashes.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], ["class", "hashes"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                same = int(np.count_nonzero(x[at] == y))
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = _few_first(named.where("n > 0").select("class", "row").join(wanted, "class").groupBy("class").agg(F.min("row").alias("row")).select("row"))
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    texts = docs.select(F.xxhash64(text, id_).alias("row"), text.alias("text")).join(rows, "row", "left_semi").select("text")
    sets = texts.mapInArrow(run, "class bigint, hashes binary").dropDuplicates(["class"])
    both = pairs.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a").select("a", "b", "x", "y")
    links = stored(both.mapInArrow(meet, "a bigint, b bigint"), "links", small=True)
    release(docs.sparkSession)
    return links


def _bounded(pairs: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """(a, b, share): the pairs whose bitmaps allow a link; stored."""
    wanted = _few_first(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct())
    maps = named.where("n > 0").select("class", "n", "bitmap").join(wanted, "class", "left_semi").groupBy("class").agg(F.first("n").alias("n"), F.first("bitmap").alias("bitmap"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "x", "y")), strict=True):
                found = next(bounds(np.array([n, m]), [x, y], np.arange(2), np.array([0]), np.array([1]), percent), None)
                share.append(float(found[2][0]) if found else None)
            share = pa.array(share, pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), share], ["a", "b", "share"]).filter(share.is_valid())

    both = pairs.join(maps.toDF("b", "m", "y"), "b").join(maps.toDF("a", "n", "x"), "a").select("a", "b", "n", "m", "x", "y")
    return stored(both.mapInArrow(run, "a bigint, b bigint, share double"), "bounded", small=True)


def _tiled(rows: DataFrame, percent: int, tile: int, thin: bool) -> DataFrame:
    """(a, b, share, more): pairs that pass the bitmaps, distinct. thin: of each tile only those that join its components; more is the key of a tile where a, in a row
    without b, has pairs that were left out, else null.
    rows: key, class, component, n, bitmap of keys with several components."""
    own = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / percent)) + F.lit(1e-9)).cast("bigint")
    homes = rows.withColumn("band", own)
    both = homes.withColumn("home", F.lit(True)).unionByName(homes.withColumn("band", F.col("band") + 1).withColumn("home", F.lit(False)))
    sizes = both.groupBy("key", "band").agg(F.count("*").alias("rows"), F.min("component").alias("c1"), F.max("component").alias("c2"), F.max("home").alias("any")).where("rows > 1 and any and c1 <> c2").select("key", "band", F.ceil(F.col("rows") / tile).cast("int").alias("sides"))
    placed = both.join(sizes, ["key", "band"]).withColumn("side", F.pmod(F.xxhash64("class"), F.col("sides")).cast("int"))
    at = [F.col(c) for c in ("key", "band")]
    rest = [F.col(c) for c in ("side", "home", "class", "component", "n", "bitmap")]
    alone = placed.where("sides = 1").select(*at, F.lit(0).alias("i"), F.lit(0).alias("j"), *rest)  # one tile: no row is needed twice
    spread = placed.where("sides > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    tiles = alone.unionAll(spread.select(*at, F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), *rest))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("share", pa.float64()), ("more", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        place = ["key", "band", "i", "j"]

        def told(name: np.ndarray, x: np.ndarray, y: np.ndarray, share: np.ndarray) -> pa.RecordBatch:
            a, b = np.minimum(name[x], name[y]), np.maximum(name[x], name[y])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(share), pa.nulls(len(a), pa.int64())], schema=schema)

        def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
            ids = [table.column(c).to_numpy() for c in place]
            new = np.ones(table.num_rows, bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in ids], axis=0)
            start = np.append(np.flatnonzero(new), table.num_rows)
            name, comp, n, side, home = (table.column(c).to_numpy() for c in ("class", "component", "n", "side", "home"))
            maps = table.column("bitmap").to_pylist()
            for s, e in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
                if e - s < 2:
                    continue
                i, j = ids[2][s], ids[3][s]
                at = np.arange(e - s)
                left, right = at[home[s:e] & (side[s:e] == i)], at[side[s:e] == j]
                sides = [(left, right)] if i == j else [(left, right), (at[home[s:e] & (side[s:e] == j)], at[side[s:e] == i])]
                waiting, count, left_out = [], 0, np.zeros(e - s, bool)

                def joined(last: bool) -> Iterator[pa.RecordBatch]:
                    nonlocal waiting, count
                    x, y, share = (np.concatenate(w) for w in zip(*waiting, strict=True))
                    if thin:
                        taken = forest(comp[s:e], x, y, share)
                        left = np.ones(len(x), bool)
                        left[taken] = False
                        left_out[x[left]] = left_out[y[left]] = True
                        x, y, share = x[taken], y[taken], share[taken]
                    waiting, count = ([(x, y, share)], len(x)) if thin and not last else ([], 0)
                    if last or not thin:
                        yield told(name[s:e], x, y, share)

                for one, other in sides:
                    for x, y, share in bounds(n[s:e], maps[s:e], comp[s:e], one, other, percent):
                        waiting.append((np.full(len(y), x), y, share))
                        count += len(y)
                        if count > PAIRS:
                            yield from joined(False)
                if waiting:
                    yield from joined(True)
                if left_out.any():
                    again = name[s:e][left_out]
                    yield pa.RecordBatch.from_arrays([pa.array(again), pa.nulls(len(again), pa.int64()), pa.nulls(len(again), pa.float64()), pa.array(np.full(len(again), ids[0][s]))], schema=schema)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) > 2 * TILE:
                table = pa.Table.from_batches(held)
                ids = [table.column(c).to_numpy() for c in place]
                last = np.flatnonzero(np.any([x != x[-1] for x in ids], axis=0))
                if len(last):
                    yield from settle(table.slice(0, int(last[-1]) + 1))
                    held = table.slice(int(last[-1]) + 1).combine_chunks().to_batches()
        if held:
            yield from settle(pa.Table.from_batches(held))

    return tiles.repartition(parts, "key", "band", "i", "j").sortWithinPartitions("key", "band", "i", "j").mapInArrow(compare, "a bigint, b bigint, share double, more bigint").distinct()


def _star(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): the first of each key and size band, which shares most, with the rows of that band and the next that it may link to."""
    first = rows.groupBy("key", "band").agg(F.max(F.struct("shared", "class", "n")).alias("f")).select("key", "band", F.col("f.class").alias("first"), F.col("f.n").alias("first_n"))
    seen = rows.select("key", "class", "n", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"))
    met = seen.join(first, ["key", "band"]).where("class <> first").where(_fits("n", "first_n", percent))
    return met.select(F.least("first", "class").alias("a"), F.greatest("first", "class").alias("b")).distinct()


def _few(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) of one key and different components that may link by size. rows: of keys of at most FEW sets, so each has as many partners at most."""
    pair = rows.alias("x").join(rows.alias("y"), "key").where("x.component <> y.component and x.class < y.class").where(_fits("x.n", "y.n", percent))
    return pair.select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()


def _met(keys: DataFrame, percent: int) -> DataFrame:
    """(key, class, n, shared, band): the keys by which sets are met; stored."""
    n = F.col("n")
    # The keys of linked sets have 1 + keys - prefix in common, of the smaller one. So of its keys, the rarest first, each
    # needs only as many as leave fewer over; those that no other set has are the rarest, and need not be met.
    common = F.ceil(n * percent / 100)  # the least partner's size
    prefix = lambda x: x - F.ceil(x * percent / 100) + 1
    keys_of = lambda x: F.least(x, prefix(x) + F.floor(prefix(x) / 4) + 1)
    spare = keys_of(common) - prefix(common)
    ranked = keys.withColumn("rank", F.expr("row_number() over (partition by class order by held desc, key)")).withColumn("total", F.expr("count(*) over (partition by class)"))
    met = ranked.where(F.col("rank") > spare).withColumn("shared", F.col("total") / keys_of(n)).withColumn("band", F.floor(F.log(n) / F.log(F.lit(100 / percent)) + F.lit(1e-9)).cast("bigint"))
    return stored(met.select("key", "class", "n", "shared", "band"), "met")


def _owned(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with the component of their class: that of found, or the class itself."""
    return rows.join(_few_first(found.withColumnRenamed("node", "class")), "class", "left").withColumn("component", F.coalesce("component", "class"))


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """pairs (a, b, share) whose sides are of different components."""
    of = _few_first(found)
    sides = pairs.join(of.toDF("a", "ca"), "a", "left").join(of.toDF("b", "cb"), "b", "left")
    return sides.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "share")


def _grouped(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, few: int, tile: int) -> DataFrame:
    """(row, id, n, class, component) of each row; component: the least class that links lead to. Reads stored tables of the scratch it is called in."""
    spark = docs.sparkSession
    named = classes(docs, k, percent, id_col, text_col)
    keys = _keys(named)
    met = _met(keys, percent)
    dropped(keys)
    verified = lambda pairs: _linked(pairs, docs, named, k, percent, id_col, text_col)
    links = verified(_bounded(stored(_star(met, percent), "star", small=True), named, percent).select("a", "b"))
    found = components(links)
    owned = _owned(met, found)
    mixed = owned.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("rows")).where("c1 <> c2").select("key", "rows")
    rows = stored(owned.join(mixed, "key"), "mixed")
    release(spark)
    if not rows.isEmpty():
        maps = named.where("n > 0").groupBy("class").agg(F.first("bitmap").alias("bitmap"))
        large = rows.where(F.col("rows") > few).select("key", "class", "n", "component")
        passed = _bounded(stored(_few(rows.where(F.col("rows") <= few), percent), "few", small=True), named, percent)
        proposed = stored(_tiled(large.join(maps, "class"), percent, tile, thin=True), "proposed", small=True)
        release(spark)
        joins = proposed.where("more is null").select("a", "b")
        likeliest = [passed.groupBy(c).agg(F.max_by(F.struct("a", "b"), F.struct("share", "a", "b")).alias("p")).select("p.a", "p.b") for c in ("a", "b")]
        first = stored(likeliest[0].union(likeliest[1]).union(joins).distinct(), "first", small=True)
        links = links.union(verified(first))
        found = components(links)
        rest = _apart(passed.join(first, ["a", "b"], "left_anti"), found)
        more = proposed.where("more is not null").select(F.col("more").alias("key"), F.col("a").alias("class")).distinct()
        again = large.select("key", "class", "n").join(_few_first(more), ["key", "class"], "left_semi")
        if not again.isEmpty():
            rest = rest.union(_apart(_tiled(_owned(again, found).join(maps, "class"), percent, tile, thin=False).select("a", "b", "share"), found))
        rest = stored(rest.select("a", "b").distinct(), "rest", small=True)
        if not rest.isEmpty():
            links = links.union(verified(rest))
            found = components(links)
    return _owned(named.select("row", "id", "n", "class"), found)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", few: int = FEW, tile: int = TILE) -> DataFrame:
    """id_col, n_shingles long and component_id (the least id of a row that links lead to, nulls last; its own if none does) of each row."""
    with scratch(docs.sparkSession) as kept:
        grouped = _grouped(docs, k, percent, id_col, text_col, few, tile)
        least = grouped.where("n > 0").groupBy("component").agg(F.min("id").alias("component_id"))
        out = grouped.where("n > 0").join(least, "component").select("id", "n", "component_id").union(grouped.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
        return kept(out.toDF(id_col, "n_shingles", "component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", few: int = FEW, tile: int = TILE) -> DataFrame:
    """The rows of docs, all columns, of which one of each group of linked rows stays: that of the least id (nulls last; ties: of the least hash). Rows are told apart by id and text
    together, so a row goes only for its own text; of rows of one id and one text a single one stays. Rows without words stay, all of them."""
    row = F.xxhash64(F.col(f"`{text_col}`"), F.col(f"`{id_col}`"))
    with scratch(docs.sparkSession) as kept:
        grouped = stored(_grouped(docs, k, percent, id_col, text_col, few, tile).where("n > 0").select("row", "id", "component"), "grouped")
        first = grouped.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", "row")).alias("first"), F.count("*").alias("rows")).where("rows > 1").select("component", "first.row", F.col("rows"))
        gone = grouped.join(_few_first(first.select("component", F.col("row").alias("stays"))), "component").where("row <> stays").select("row").distinct()
        twice = grouped.groupBy("row").agg(F.count("*").alias("c")).where("c > 1").select("row")
        gone, twice = kept(gone), kept(twice)
    tag = "_jaccard_row"
    left = docs.withColumn(tag, row).join(_few_first(gone).withColumnRenamed("row", tag), tag, "left_anti")
    if twice.isEmpty():
        return left.select(*(F.col(f"`{c}`") for c in docs.columns))
    twice = _few_first(twice).withColumnRenamed("row", tag)
    single = left.join(twice, tag, "left_semi").dropDuplicates([tag])
    return left.join(twice, tag, "left_anti").unionByName(single).select(*(F.col(f"`{c}`") for c in docs.columns))


def links(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """Every link between different sets, those within a component too: a, b (the least ids of their rows) and a_rows, b_rows long. As many as
    the square of a group's distinct sets; rows of equal sets are not paired."""
    with scratch(docs.sparkSession) as kept:
        named = classes(docs, k, percent, id_col, text_col)
        maps = named.where("n > 0").groupBy("class").agg(F.first("bitmap").alias("bitmap"))
        rows = _met(_keys(named), percent).select("key", "class", "n", F.col("class").alias("component")).join(maps, "class")
        linked = _linked(stored(_tiled(rows, percent, tile, thin=False).select("a", "b").distinct(), "pairs"), docs, named, k, percent, id_col, text_col)
        each = named.where("n > 0").groupBy("class").agg(F.min("id").alias("id"), F.count("*").alias("rows"))
        out = linked.join(each.toDF("a", "x", "x_rows"), "a").join(each.toDF("b", "y", "y_rows"), "b")
        return kept(out.select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("x_rows").alias("a_rows"), F.col("y_rows").alias("b_rows")))
