"""The pipeline against plain versions of its stages, on rows with nulls, copies and extra columns."""

import base64
import hashlib
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from quire.llm import decontam, suffix
from tests.llm.test_operators import linked_plainly

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def removed(texts, length=400):
    """Texts without the bytes that a string of length bytes covers which starts twice."""
    data = [t.encode() for t in texts]
    seen: dict[bytes, int] = {}
    for b in data:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in data:
        gone = set()
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone.update(range(i, i + length))
        out.append(bytes(x for i, x in enumerate(b) if i not in gone).decode(errors="ignore"))
    return out


@pytest.fixture
def rows():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, item = prose(90), prose(30)
    texts = [prose(rng.randint(20, 150)) for _ in range(30)]
    texts += [prose(30) + " " + passage + " " + prose(30) for _ in range(4)]
    texts += [texts[0], texts[0], texts[1] + " more", prose(10) + " " + item.upper() + " " + prose(9), None, "", "123 456", "é"]
    return [(i, t, "en", "s", len(t or ""), f"x{i}") for i, t in enumerate(texts)], item


def test_stages_do_what_plain_versions_do(spark, tmp_path, rows):
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    docs, item = rows
    spark.createDataFrame(docs, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = [r for r in docs if any(c.isalpha() for c in r[1] or "")]
    first = {d: c for d, _, c in linked_plainly([r[:2] for r in kept], 5, 80)}
    kept = [r for r in kept if first[r[0]] == r[0]]
    assert len(kept) == 36
    texts = removed([r[1] for r in kept])
    assert sum(len(t) for t in texts) < sum(len(r[1]) for r in kept) - 1200
    clean = {r[0]: t for r, t in zip(kept, texts, strict=True) if decontam.plain(item) not in decontam.plain(t)}
    with open(tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = {}
    for d, t in clean.items():
        ids = plain.encode_ordinary(t)
        expected[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == expected


def test_stages_keep_columns_and_survive_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, "an item of the benchmark")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (spark.createDataFrame([], COLUMNS), spark.createDataFrame([(None, "a b c d e f", None, None, None, None), (1, None, "en", "s", 0, "x"), (2, "some words of text", "en", "s", 18, "y"), (2, "some words of text", "en", "s", 18, "y")], COLUMNS)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        assert docs.count() in (0, 2)
        assert corpus_pipeline.encode(spark, docs, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def without_repeated_words(texts, least):
    """Texts without the words, and the spaces between them, that least words cover which stand twice."""
    each = [list(re.finditer(r"[^\x20\x09-\x0D]+", t)) for t in texts]
    seen = Counter(tuple(m[0] for m in w[i : i + least]) for w in each for i in range(len(w) - least + 1))
    out = []
    for t, w in zip(texts, each, strict=True):
        gone = set()
        for i in range(len(w) - least + 1):
            if seen[tuple(m[0] for m in w[i : i + least])] > 1:
                gone.update(range(w[i].start(), w[i + least - 1].end()))
        out.append("".join(c for i, c in enumerate(t) if i not in gone))
    return out


def test_passages_of_over_fifty_short_words_go(spark, tmp_path):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghilmnoprstuvé") for _ in range(rng.randint(1, 3))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    around = lambda p: f"{prose(120)} !{rng.random()} {p} ?{rng.random()} {prose(90)}"
    least, fewer, wrapped = prose(51), prose(50), prose(64)
    assert len(wrapped.encode()) < suffix.LENGTH
    texts = [around(p) for p in (least, least, fewer, fewer, wrapped, wrapped.replace(" ", "\n"), least + " " + prose(9))] + [None, "", " \n"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in enumerate(texts)], COLUMNS)
    got = {r.doc_id: r.text for r in corpus_pipeline.suffix_dedup(spark, docs, str(tmp_path)).collect()}
    kept = without_repeated_words([t or "" for t in texts], 51)
    assert got == {i: None if t is None else kept[i] for i, t in enumerate(texts)}
    assert [least in (got[i] or "") for i in (0, 1, 6)] == [False] * 3 and fewer in got[2] and fewer in got[3]
    for hot in (0, 20_000):
        assert {r.doc_id: r._kept for r in suffix.dedup(docs, hot=hot, words=20).collect()} == dict(enumerate(without_repeated_words([t or "" for t in texts], 20)))
