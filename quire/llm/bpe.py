"""Byte-level BPE encoding and decoding over Arrow batches.

Text is cut by the pattern, and within each piece the two neighbours that make the token of the
lowest rank merge first; the tiktoken library does both, for a whole text at once. Its expressions stop at runs
of a million white spaces, so a text of over ``WHOLE`` characters is cut here and goes to it piece by piece, with the
same ids. Decoding joins the bytes of a text before any character is read, so a character split over tokens comes back whole.
No piece of a text up to ``WHOLE`` is remembered, so the time of a text does not depend on the texts before it.

Null and empty texts have no tokens. Repeated rows give equal rows; other columns pass through, but for those that have a new column's name: it replaces them.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quire.llm.common import utf8

#: Characters of the longest text that tiktoken cuts.
WHOLE = 200_000
_coders: dict[str, Coder] = {}


class Coder:
    """Encodes and decodes; cache: the pieces of texts over WHOLE that are remembered."""

    def __init__(self, ranks: bytes, pattern: str, cache: int = 200_000):
        import tiktoken

        rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x.strip())}
        if missing := [b for b in range(256) if bytes([b]) not in rank]:
            raise ValueError(f"{len(missing)} bytes have no rank, {missing[0]} among them")
        self.model = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=rank, special_tokens={})
        self.lengths, self.shown = ([0] * (max(rank.values()) + 1) for _ in range(2))
        for k, v in rank.items():
            self.lengths[v], self.shown[v] = len(k), str(v)
        self.cut, self.piece = regex.compile(pattern).finditer, functools.lru_cache(cache)(self.model._encode_single_piece)

    def encode(self, text: str) -> list[int]:
        if len(text) <= WHOLE:
            return self.model.encode_ordinary(text)
        return list(chain.from_iterable(self.piece(x[0]) for x in self.cut(text)))

    def offsets(self, ids: list[int]) -> list[int]:
        """The byte at which each token starts."""
        return list(accumulate(map(self.lengths.__getitem__, ids[:-1]), initial=0)) if ids else []

    def listed(self, ids: list[int]) -> str:
        """Decimal ids, joined by commas."""
        return ",".join(map(self.shown.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        return self.model.decode_bytes(ids)


def coder(ranks: bytes, pattern: str) -> Coder:
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _coders:
        _coders[key] = Coder(ranks, pattern)
    return _coders[key]


def _named(df: DataFrame, names: list[str], source: str) -> DataFrame:
    """df without columns of these names, which the new ones replace."""
    if source in names:
        raise ValueError(f"{source} cannot be read and written at once")
    return df.drop(*names)


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", prefix: str = "bpe_", digests: bool = False) -> DataFrame:
    """df with ``ids`` array<int> and ``offsets`` array<int> (byte at which each token starts) under prefix; with digests instead
    ``n_tokens`` long, ``ids_sha256`` string and ``decoded_sha256`` string of the ids encoded and of the bytes decoded from them, which spares moving ids.

    ranks_path is read by the driver; the file of the vocabulary (under 10 MB, checked) goes to the workers.
    """
    size = os.path.getsize(ranks_path)
    if size > 10 << 20:
        raise ValueError(f"{ranks_path} has {size} bytes, over the 10 MB that are sent to workers")
    with open(ranks_path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    kinds = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()} if digests else {"ids": T.ArrayType(T.IntegerType()), "offsets": T.ArrayType(T.IntegerType())}
    names = [prefix + k for k in kinds]
    df = _named(df, names, text_col)
    types = [pa.int64(), pa.string(), pa.string()] if digests else [pa.list_(pa.int32())] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(ranks.value, pattern)
        for batch in batches:
            out = []
            for text in utf8(batch.column(text_col)):
                ids = code.encode(text.decode())
                out.append((len(ids), hashlib.sha256(code.listed(ids).encode()).hexdigest(), hashlib.sha256(code.decode(ids)).hexdigest()) if digests else (ids, code.offsets(ids)))
            made = [pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * len(types), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *names])
        code.piece.cache_clear()  # the worker lives on

    schema = T.StructType([*df.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds.values(), strict=True))])
    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "bpe_ids", out_col: str = "bpe_decoded") -> DataFrame:
    """df with the text of ids_col in out_col; bytes that are no UTF-8, as of ids cut off within a character, become U+FFFD. Null ids give null."""
    with open(ranks_path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    df = _named(df, [out_col], ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(ranks.value, pattern)
        for batch in batches:
            texts = [None if x is None else code.decode(x).decode(errors="replace") for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())]))
