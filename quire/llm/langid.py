"""Language ID by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed greedily into the longest
phrases that occur in that text; the fewer phrases a symbol needs, the closer the language. Parsing reads the automaton as one table, or, where a language has
more than DENSE symbols, as its sorted steps: where a state has no step on a symbol, a phrase ends and the step starts again at the root. Blocks of
BLOCK symbols (no phrase crosses their ends) are parsed side by side, so numpy takes one symbol of thousands of blocks at once.

Symbols are lower-case letters, every letter of any script its own; anything else, in runs of any length, is one space. A letter that a language's text lacks is a phrase of its own.
Learned are whole languages of few documents and pieces from all over the texts of a share of the others, SAMPLE_SYMBOLS a language (fewer with more than 64 languages, so that the
whole model keeps its bound). Null texts and texts without a letter are ``und`` with score 0. The score is 1 - (phrases of the best language) / (phrases of the next), 1 if only one
language is known. Ties go to the language that comes first by name. Labels of null are not learned; with no labelled text everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import chunks

BLOCK = 256
#: Symbols of a language up to which its automaton is a table.
DENSE = 96
#: The bound on what is learned: documents of a language that are gathered, symbols of them that its automaton takes, symbols of all languages, and languages.
SAMPLE_DOCS, SAMPLE_SYMBOLS, ALL_SYMBOLS, LANGUAGES = 200, 40_000, 64 * 40_000, 4096


@dataclass
class Automaton:
    """The suffix automaton of a language. alphabet: its symbols; own: symbol of each of the model's symbols, or None if they are the same."""

    alphabet: int
    own: np.ndarray | None
    root: np.ndarray  # symbol -> next state * 2 + 1: a phrase starts
    table: np.ndarray | None  # state * alphabet + symbol -> next state * 2 + (1 if a phrase starts)
    keys: np.ndarray | None  # state * alphabet + symbol of each step, sorted
    to: np.ndarray | None

    def step(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Next state * 2 + (1 if a phrase starts)."""
        if self.own is not None:
            column = self.own[column]
        if self.table is not None:
            return self.table[state * self.alphabet + column]
        asked = state.astype(np.int64) * self.alphabet + column
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return np.where((self.keys[at] == asked) & (state > 0), self.to[at], self.root[column])


@dataclass
class Model:
    languages: list[str]
    symbols: np.ndarray  # code point -> symbol: 0 the space, 1 a letter that no language has, the last one (not in here) the padding
    tables: list[Automaton]


def symbol_table(texts: list[str]) -> np.ndarray:
    """Each letter gets a symbol, in the order of code points."""
    table = np.zeros(0x110000, np.uint32)
    letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    table[letters] = 1
    for i, c in enumerate(sorted({c for t in texts for c in t.lower() if c.isalpha()})):
        table[ord(c)] = 2 + i
    return table


def automaton(symbols: np.ndarray, alphabet: int) -> Automaton:
    """The automaton of symbols, of which alphabet - 1 is the padding."""
    own = None
    if alphabet > DENSE:
        have = np.unique(symbols[symbols > 1])
        own = np.ones(alphabet, np.int64)
        own[0], own[have], own[alphabet - 1] = 0, np.arange(len(have)) + 2, len(have) + 2
        symbols, alphabet = own[symbols], len(have) + 3
    steps: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols.tolist():
        new = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(steps)
                steps.append(dict(steps[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    root = np.ones(alphabet, np.int32)
    for c, to in steps[0].items():
        root[c] = to * 2 + 1
    root[alphabet - 1] = 0
    if alphabet > DENSE:
        edges = sorted((state * alphabet + c, to * 2) for state, each in enumerate(steps[1:], 1) for c, to in each.items()) or [(-1, 0)]
        return Automaton(alphabet, own, root, None, np.array([k for k, _ in edges], np.int64), np.array([to for _, to in edges], np.int32))
    table = np.tile(root, (len(steps), 1))
    for state, each in enumerate(steps[1:], 1):  # at the root a phrase starts with any step
        for c, to in each.items():
            table[state, c] = to * 2
    return Automaton(alphabet, own, root, table.ravel(), None, None)


def normalised(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each with its runs of spaces as one, and the first symbol of each text (one more entry than texts)."""
    lower = [x.lower() for x in texts]
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = table[points]
    first = np.cumsum([0, *map(len, lower)])
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    keep[first[:-1][first[:-1] < len(symbols)]] = True
    return symbols[keep], np.concatenate([[0], np.cumsum(keep)])[first]


def train(samples: dict[str, list[str]]) -> Model:
    """samples: labelled texts by language. Of each text an equal share is learned, whole texts if they are no longer."""
    languages = sorted(samples)
    most = min(SAMPLE_SYMBOLS, ALL_SYMBOLS // max(1, len(languages)))
    table = symbol_table([t for x in languages for t in samples[x]])
    alphabet = int(table.max()) + 2
    tables = []
    for language in languages:
        symbols, first = normalised(samples[language], table)
        left, parts = most, []
        for i, (a, b) in enumerate(sorted(zip(first[:-1].tolist(), first[1:].tolist(), strict=True), key=lambda x: x[1] - x[0])):  # what short texts leave goes to longer ones
            parts.append(symbols[a : min(b, a + left // (len(first) - 1 - i))])
            left -= len(parts[-1])
        tables.append(automaton(np.concatenate([*parts, np.zeros(1, table.dtype)]).astype(np.int64), alphabet))
    return Model(languages, table, tables)


def phrases(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(phrases by text and language, letters by text)."""
    symbols, first = normalised(texts, model.symbols)
    letters = np.diff(np.concatenate([[0], np.cumsum(symbols != 0)])[first])
    lengths = np.diff(first)
    blocks = -(-lengths // BLOCK)
    owner = np.repeat(np.arange(len(texts)), blocks)
    start = np.repeat(first[:-1], blocks) + BLOCK * (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    size = np.minimum(BLOCK, np.repeat(first[1:], blocks) - start)
    order = np.argsort(-size, kind="stable")
    start, size, owner = start[order], size[order], owner[order]
    padded = np.concatenate([symbols, np.full(BLOCK, int(model.symbols.max()) + 1, symbols.dtype)])
    counts = np.zeros((len(texts), len(model.languages)), np.int64)
    live = np.searchsorted(-size, -np.arange(BLOCK), side="left")  # blocks longer than t come first
    steps = [padded[start[: live[t]] + t].astype(np.int32) for t in range(BLOCK) if live[t]]
    for k, table in enumerate(model.tables):
        state = np.zeros(len(start), np.int32)
        started = np.zeros(len(start), np.int32)
        for column in steps:
            n = len(column)
            at = table.step(state[:n], column)
            started[:n] += at & 1
            state[:n] = at >> 1
        counts[:, k] = np.bincount(owner, started, len(texts)).astype(np.int64)
    return counts, letters


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Learns from the rows of df with a language and a text. All rows of small languages are learned; of larger ones a share, chosen by a hash of id and text,
    that leaves about SAMPLE_DOCS, and of each a piece from anywhere in its text, chosen by the same hash; equal rows count once. At most LANGUAGES languages are allowed."""
    lang, text, id_ = F.col(f"`{lang_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.col(f"`{id_col}`").cast("string")
    known = df.select(lang.alias("lang"), text.alias("t"), id_.alias("i")).where(F.col("lang").isNotNull() & (F.col("lang") != ""))
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not counts:
        return train({})
    most = min(SAMPLE_SYMBOLS, ALL_SYMBOLS // len(counts))
    each = spark_map({k: 4 * max(256, most // min(n, SAMPLE_DOCS)) for k, n in counts.items()})[F.col("lang")]
    share = spark_map({k: int((1 << 20) * min(1.0, SAMPLE_DOCS / n)) + 1 for k, n in counts.items()})[F.col("lang")]
    drawn = known.withColumn("h", F.xxhash64("i", "t", F.lit("langid")))
    piece = F.col("t").substr(F.pmod(F.shiftrightunsigned("h", 20), F.greatest(F.length("t") - each + 1, F.lit(1))).cast("int") + 1, each)
    drawn = drawn.select("lang", F.pmod("h", F.lit(1 << 20)).alias("p"), "i", piece.alias("t"))
    samples: dict[str, list[tuple]] = {}
    for row in drawn.where(F.col("p") < share).distinct().limit(4 * SAMPLE_DOCS * len(counts)).collect():
        samples.setdefault(row[0], []).append((row["p"], row["i"] or "", row["t"]))
    if missed := [k for k in counts if k not in samples]:  # few different rows, none drawn
        for row in drawn.where(F.col("lang").isin(missed)).groupBy("lang").agg(F.min(F.struct("p", "i", "t")).alias("r")).collect():
            samples[row[0]] = [(row["r"]["p"], row["r"]["i"] or "", row["r"]["t"])]
    return train({k: [t for _, _, t in sorted(v)] for k, v in samples.items()})


def spark_map(values: dict) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(v))))


def predict(df: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """df with the predicted language and its score, which replace columns of their names. The tables (under 31 MB a language, and 2 GB with any number of them; a tenth with few symbols) go to the workers as one broadcast."""
    df = df.drop(lang_out, score_out)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            texts = [x or "" for x in batch.column(text_col).to_pylist()]
            langs, scores = [], []
            for a, b in chunks([x.encode("utf-8", "surrogatepass") for x in texts], 3 << 20):
                if not own.languages:
                    langs += ["und"] * (b - a)
                    scores += [0.0] * (b - a)
                    continue
                counts, letters = phrases(own, texts[a:b])
                best = np.argmin(counts, axis=1)
                ordered = np.sort(counts, axis=1)
                score = 1 - ordered[:, 0] / np.maximum(ordered[:, 1], 1) if counts.shape[1] > 1 else np.ones(b - a)
                langs += [own.languages[i] if n else "und" for i, n in zip(best, letters, strict=True)]
                scores += np.where(letters > 0, score, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, lang_out, score_out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())]))


def held_out(bucket: Column) -> Column:
    return bucket == 2
