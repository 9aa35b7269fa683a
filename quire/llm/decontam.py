"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may be found with up to k = floor(rate * n) edits. Cut into k + 1 pieces, at least one piece of
it stands unchanged wherever it is found, so an Aho-Corasick automaton of all pieces meets every place; around each, Myers' bit-parallel
distance (one machine word of any length a character) gives the least number of edits of the whole item against any part of the text.

Texts and items are compared in lower case with every run of white space as one space. Null and empty texts match nothing, nor do items that are null or empty.
A text that is repeated is reported for every row; of equal items each is reported. Ties in distance go to the earliest end.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

RATE = 0.08
#: Bytes of items that go to the workers at once; more are taken in turns.
BLOCK_BYTES = 8 << 20


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, rate: float = RATE) -> list[tuple[int, str]]:
    """(offset, piece): floor(rate * n) + 1 pieces of as equal length as can be."""
    n = int(rate * len(item)) + 1
    cut = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


class Pattern:
    """Myers' vectors of one item."""

    def __init__(self, item: str):
        self.n, self.all = len(item), (1 << len(item)) - 1
        self.of: dict[str, int] = defaultdict(int)
        for i, c in enumerate(item):
            self.of[c] |= 1 << i
        self.of = dict(self.of)

    def best(self, text: str) -> tuple[int, int]:
        """(distance, end) of the part of text nearest to the item, the earliest end of the least distance."""
        plus, minus, score, top = self.all, 0, self.n, 1 << (self.n - 1)
        least, end = self.n, 0
        for j, c in enumerate(text, 1):
            eq = self.of.get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            up = minus | (self.all & ~(xh | plus))
            down = plus & xh
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up = up << 1 & self.all
            down = down << 1 & self.all
            plus = down | (self.all & ~(xv | up))
            minus = up & xv
            if score < least:
                least, end = score, j
        return least, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        import ahocorasick

        self.items = [(i, t, int(rate * len(t))) for i, t in items]
        self.patterns: dict[int, Pattern] = {}
        self.machine = ahocorasick.Automaton()
        places = defaultdict(list)
        for k, (_, text, _) in enumerate(self.items):
            for at, piece in pieces(text, rate):
                places[piece].append((k, at))
        for piece, where in places.items():
            self.machine.add_word(piece, (len(piece), where))
        if places:
            self.machine.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, end, item length) of every item within its budget, in the order of items."""
        if not text or not self.items:
            return []
        near: dict[int, set[int]] = defaultdict(set)
        for last, (n, where) in self.machine.iter(text):
            for k, at in where:
                near[k].add(last - n + 1 - at)
        found = []
        for k in sorted(near):
            item, own, budget = self.items[k]
            best = (budget + 1, 0)
            covered = -1
            for start in sorted(near[k]):
                if start <= covered:
                    continue
                covered = start + 2 * budget  # one window holds all starts up to here
                low = max(0, start - budget)
                window = text[low : covered + budget + len(own) + budget]
                if own in window:
                    got = (0, window.index(own) + len(own))
                else:
                    if k not in self.patterns:
                        self.patterns[k] = Pattern(own)
                    got = self.patterns[k].best(window)
                best = min(best, (got[0], low + got[1]))
                if not best[0]:
                    break
            if best[0] <= budget:
                found.append((item, *best, len(own)))
        return found


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Items a block at a time; the driver holds one block."""
    block, size = [], 0
    for row in items.select(id_col, text_col).where(f"`{text_col}` is not null").toLocalIterator():
        text = plain(row[1])
        if not text:
            continue
        if block and size + len(text) * 4 > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row[0], text))
        size += len(text) * 4
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance int, end_char long, item_chars long): each row of docs and item within floor(rate * n) edits, with the end of the match in the compared text.
    Every block of items, each of BLOCK_BYTES at most, reads docs once. Where docs and items name their ids alike, the item's becomes item_id (or _item_id)."""
    item_name = item_id if item_id != doc_id else "item_id" if doc_id != "item_id" else "_item_id"
    schema = f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, `{item_name}` {items.schema[item_id].dataType.simpleString()}, distance int, end_char bigint, item_chars bigint"
    kinds = [None, to_arrow_type(items.schema[item_id].dataType), pa.int32(), pa.int64(), pa.int64()]
    out = None
    for block in _blocks(items, item_id, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, rate)
            for batch in batches:
                rows: tuple[list, ...] = ([], [], [], [], [])
                for i, text in enumerate(batch.column(1)):
                    for item, distance, end, n in matcher.find(plain(text.as_py())):
                        for column, value in zip(rows, (i, item, distance, end, n), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0], pa.int64())), *(pa.array(c, k) for c, k in zip(rows[1:], kinds[1:], strict=True))], names=[doc_id, item_name, "distance", "end_char", "item_chars"])

        found = docs.select(doc_id, text_col).mapInArrow(run, schema)
        out = found if out is None else out.unionAll(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE, text_col: str = "text") -> DataFrame:
    """The rows of docs within reach of no item; all columns, one pass over docs for each block of items."""
    for block in _blocks(items, "item_id", "text"):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(plain(t.as_py())) for t in batch.column(text_col)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def flagged(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """One row for each document: doc_id, contaminated boolean, items array of item ids found in it, distance (least, null if none)."""
    found = contaminated(docs, items, rate).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.min("distance").alias("distance"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), "distance")
