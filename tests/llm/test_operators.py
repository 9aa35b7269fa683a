"""Each operator against a plain version of what it computes, with nulls, empty and long texts, repeated rows, empty tables and extra columns."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from quire.llm import bpe, decontam, jaccard, langid, licenses, lm, media, quality, suffix, urls

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def mixed(seed, n=120, words=60):
    """Near copies, shared passages, short, empty, null and repeated rows."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    line = [rng.choice(vocabulary) for _ in range(25)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 90))] for _ in range(10)]
    rows = []
    for i in range(n):
        x = rng.random()
        if x < 0.6:
            t = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            t += line[: rng.randint(0, 25)] if rng.random() < 0.3 else []
        elif x < 0.8:
            t = line + [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        elif x < 0.9:
            t = [rng.choice(vocabulary) for _ in range(rng.randint(0, 5))]
        else:
            t = None
        rows.append((i * 7 % 163, None if t is None else rng.choice([" ", "\n\t"]).join(t).title()))
    return rows + rows[:4]


def removed_plainly(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + length] for _, b in texts for i in range(len(b) - length + 1))
    out = []
    for d, b in texts:
        mask = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mask[i : i + length] = [True] * length
        runs = sum(m and not (i and mask[i - 1]) for i, m in enumerate(mask))
        out.append((d, len(b), sum(mask), runs, hashlib.sha256(bytes(x for x, m in zip(b, mask, strict=True) if not m)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("length", "kgram", "hot"), [(40, 8, 20_000), (40, 8, 0), (24, 6, 3)])
def test_suffix_dedup(spark, length, kgram, hot):
    rng = random.Random(length + hot)
    base = ["".join(rng.choice("abcdéf ") for _ in range(rng.randint(5, 300))) for _ in range(12)]
    rows = []
    for i in range(50):
        a, b, x = rng.choice(base), rng.choice(base), rng.random()
        edit = list(a)
        edit[rng.randrange(len(edit))] = "x"
        rows.append((i, a if x < 0.3 else "".join(edit) if x < 0.6 else a[rng.randint(0, len(a)) :][:90] + b[:70] if x < 0.85 else "ab" * rng.randint(0, 99) if x < 0.95 else rng.choice([None, ""])))
    rows += rows[:3]
    got = suffix.digests(spark.createDataFrame(rows, DOCS), length, kgram, hot).drop("n_passage_words").collect()
    assert sorted(map(tuple, got)) == removed_plainly(rows, length)


def test_suffix_dedup_keeps_columns_and_survives_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x" * 50, "a"), (2, None, "b"), (None, "y", None)], "doc_id long, text string, key string")
    got = {r.doc_id: (r.key, r._kept) for r in suffix.dedup(docs, 20, 5).collect()}
    assert got == {1: ("a", ""), 2: ("b", ""), None: (None, "y")}
    assert suffix.digests(spark.createDataFrame([], DOCS)).collect() == []


def test_suffix_order_falls_back_on_collisions():
    texts = [b"aabcx", b"aabcy", b"aabcx", b"zabc"]
    contexts = suffix.Contexts(np.zeros(4, np.int64), texts, np.array([1, 1, 1, 1]))
    for back in (False, True):
        order, common = contexts.order(back)
        plain, plain_common = contexts.by_bytes(back)
        assert order.tolist() == plain.tolist() and common.tolist() == plain_common.tolist()


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 500)
    rng = random.Random(1)
    text = bytes(rng.randrange(97, 103) for _ in range(3000))
    pieces = suffix.Anchors([text], 60, 10)
    covered = sorted(w for a, b in zip(pieces.first, pieces.last, strict=True) for w in range(a, b + 1))
    assert covered == list(range(len(text) - 59))


def test_media(spark):
    rows = [(1, "héllo"), (2, None), (3, ""), (4, "z" * 80_000), (4, "z" * 80_000)]
    got = media.digests(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 5
    for r in got:
        data = (dict(rows)[r.doc_id] or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    stored = media.store(spark.createDataFrame(rows, DOCS))
    columns = media.media_columns(stored).where("doc_id = 4").first()
    assert columns.media_codec == "raw " and columns.media_duration == columns.media_n_samples * 576 and len(columns.media_key_ranges) == -(-columns.media_n_samples // 16)
    assert media.store(stored).columns == stored.columns


def test_media_of_broken_containers(spark):
    whole = media.pack(media.pad(b"abc" * 900))
    rows = [(1, None), (2, b""), (3, whole[:300]), (4, b"\0\0\0\x02moov"), (5, whole)]
    got = {r.doc_id: r for r in media.media_columns(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert all(got[i].media_error and got[i].media_codec is None for i in (1, 2, 3, 4))
    assert got[5].media_error is None
    track = media.probe(whole)
    assert media.read(whole, track) == media.pad(b"abc" * 900)


def urls_plainly(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits, key=lambda x: len(x[0])) if fits else (None, None))


def test_url_rules(spark):
    rows = [None, "", "x", "http://A.COM", "http://a.com/", "HTTP://www.Example.com/en/1", "http://m.example.com/en/1?x", "http://b.net/es/1", "http://b.net/es", "http://net/fr/", "http://a.org/x/1#://", "a://://b", "http://notexample.com/en/1", "http://a.net?q=/es/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(rows)] + [(0, None)], "page_id long, url string")
    got = urls.judge(pages).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        host, path, rule, verdict = urls_plainly(rows[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or "allow")
    assert urls.judge(pages.limit(0)).collect() == []


def test_url_templates_are_rejected_by_purity(spark):
    pages = [(i, f"http://h.io/ads/{i}?{'bad' if i < 30 else ''}") for i in range(40)] + [(100 + i, f"http://h.io/news/{i}") for i in range(40)]
    rules = (("block", "h.io", "/ads/1"), ("block", "h.io", "/ads/2"), ("allow", "h.io", "/news/1"))
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), rules).collect()}
    assert got[35].verdict == "block" and got[35].template == "/ads/<number>" and got[35].purity == pytest.approx((22 + 4 * (22 + 4 * 24 / 37) / 26) / 26)
    assert got[102].verdict == "allow"


def test_url_branches_become_wildcards(spark):
    shapes = spark.createDataFrame([("h", [f"u{i}", "x"], 1, 0, 0) for i in range(30)] + [("g", ["a", "x"], 5, 3, 0), ("g", ["b", "x"], 5, 3, 0), ("g", ["c", "x"], 5, 0, 0)], "host string, shape array<string>, n long, blocked long, allowed long")
    got = {(r.host, r.shape[0]): r.template for r in urls.templates(shapes).collect()}
    assert {got["h", f"u{i}"] for i in range(30)} == {"/*/x"}
    assert got["g", "a"] == got["g", "b"] == "/{alike}/x" and got["g", "c"] == "/c/x"


def linked_plainly(rows, k, percent):
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append((d, frozenset([tuple(w)] if 0 < len(w) < k else (tuple(w[i : i + k]) for i in range(len(w) - k + 1)))))
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize(("k", "percent", "few", "tile"), [(4, 85, 16, 2048), (4, 85, 1, 2), (3, 70, 2, 3)])
def test_jaccard_join(spark, k, percent, few, tile):
    rows = mixed(k + few)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, DOCS), k, percent, few=few, tile=tile).collect()
    assert sorted(map(tuple, got)) == linked_plainly(rows, k, percent)


def test_jaccard_links_within_components(spark):
    rows = mixed(11)
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        s = frozenset([tuple(w)] if 0 < len(w) < 4 else (tuple(w[i : i + 4]) for i in range(len(w) - 3)))
        if s:
            sets.setdefault(s, []).append(d)
    exact = {frozenset([(min(x), len(x)), (min(y), len(y))]) for a, x in sets.items() for b, y in sets.items() if a != b and 100 * len(a & b) >= 85 * len(a | b)}
    got = [frozenset([(r.a, r.a_rows), (r.b, r.b_rows)]) for r in jaccard.links(spark.createDataFrame(rows, DOCS), 4, 85, tile=3).collect()]
    assert len(got) == len(set(got)) and set(got) == exact
    groups = Counter(c for _, c in {(min(x), c) for x in sets.values() for d, _, c in linked_plainly(rows, 4, 85) if d == min(x)})
    assert len(exact) > sum(n - 1 for n in groups.values())  # more than a tree of each component


def test_jaccard_join_of_nothing(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


@pytest.fixture(scope="module")
def vocabulary():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN


def test_bpe_is_what_tiktoken_gives(spark, vocabulary):
    import tiktoken

    path, pattern = vocabulary
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    alphabet = "aé字🙂 \n\t\r'sdLL019.,!\u00a0\u2028\u0301e"
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80)))) for i in range(300)] + [(900, None), (901, "ab" * 40_000), (902, "<|endoftext|>")]
    docs = documents(spark).select("doc_id", "text").union(spark.createDataFrame(rows, DOCS))
    coded = bpe.encode(docs, path, pattern)
    for r in bpe.decode(coded, path, pattern).collect():
        assert r.bpe_ids == plain.encode_ordinary(r.text or "")
        assert r.bpe_decoded == (r.text or "")
        assert len(r.bpe_offsets) == len(r.bpe_ids)
    r = bpe.encode(docs.where("doc_id = 3"), path, pattern, prefix="", digests=True).first()
    ids = plain.encode_ordinary(r.text)
    assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())


def test_bpe_of_split_characters(spark, vocabulary):
    path, pattern = vocabulary
    with open(path, "rb") as f:
        code = bpe.coder(f.read(), pattern)
    ids = code.encode("🙂")
    assert code.decode(ids).decode() == "🙂" and code.decode(ids[:1]).decode(errors="replace") != "🙂"
    small = bpe.Coder(open(path, "rb").read(), pattern, cache=3)
    text = "one two three four five one two six"
    assert [small.encode(text) for _ in range(3)] == [code.encode(text)] * 3


def merged_plainly(piece, ranks):
    """Ids of a piece: of all neighbours that make a token, the first of the lowest rank merge."""
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == 1 << 40:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[x] for x in parts]


def test_bpe_merges_plainly_and_remembers_no_pieces(vocabulary, monkeypatch):
    path, pattern = vocabulary
    with open(path, "rb") as f:
        data = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    code = bpe.Coder(data, pattern)
    rng = random.Random(5)
    texts = ["".join(rng.choice("aeinrst aé字🙂 \n\t\r'sdLL019.,!\u00a0\u2028\u0301") for _ in range(rng.randint(0, 120))) for _ in range(400)] + ["", "x" * 700, " " * 300 + "x", "<|endoftext|>"]
    expected = [[i for x in regex.findall(pattern, t) for i in merged_plainly(x.encode(), ranks)] for t in texts]
    assert [code.encode(t) for t in texts] == expected
    for t, ids in zip(texts, expected, strict=True):
        assert code.decode(ids) == t.encode() and code.listed(ids) == ",".join(map(str, ids))
        assert code.offsets(ids) == [len(code.decode(ids[:i])) for i in range(len(ids))]
    assert code.piece.cache_info().currsize == 0
    monkeypatch.setattr(bpe, "WHOLE", 0)
    assert [code.encode(t) for t in texts] == expected
    assert code.piece.cache_info().currsize > 0


def test_bpe_of_long_runs(vocabulary):
    path, pattern = vocabulary
    with open(path, "rb") as f:
        data = f.read()
    code = bpe.coder(data, pattern)
    for text in (" " * 1_200_000 + "x", "\n" * bpe.WHOLE, "a" * 300_000, "字" * 100_000 + " b" * 100_000):
        assert code.decode(code.encode(text)) == text.encode()
    one = code.encode(" ")
    assert code.encode(" " * bpe.WHOLE) == one * bpe.WHOLE and code.encode(" " * 1_200_000) == one * 1_200_000
    with pytest.raises(ValueError, match="no rank"):
        bpe.Coder(data[data.index(b"\n") + 1 :], pattern)


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    machine = quality.learn(docs.where(~held), labels.where(~held))
    got = quality.score(docs.where(held).join(labels, "doc_id"), machine).select("quality", "score", "predicted").collect()
    low, high = [r.score for r in got if not r.quality], [r.score for r in got if r.quality]
    assert np.mean([[h > x for h in high] for x in low]) > 0.95
    assert np.mean([r.predicted == r.quality for r in got]) > 0.88


def test_quality_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (4, "x" * 3_000_000)], DOCS)
    empty = quality.learn(docs, spark.createDataFrame([(1, None), (9, 1)], "doc_id long, quality int"))
    assert {r.score for r in quality.score(docs, empty).collect()} == {0.5}
    machine = quality.learn(docs, spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, quality int"))
    scores = {r.doc_id: r.score for r in quality.score(docs, machine).collect()}
    assert scores[1] == scores[2] < scores[3] and all(0 <= s <= 1 for s in scores.values())


def test_factorisation_identity():
    rng = np.random.default_rng(1)
    size = quality.BUCKETS + quality.BINS * len(quality.FIGURES)
    machine = quality.Machine(np.sort(rng.random((len(quality.FIGURES), quality.BINS - 1))), 0.3, rng.normal(size=size), rng.normal(size=(size, quality.RANK)))
    buckets, first, figures = quality.features([b"one two two three | !!", b""])
    bins = machine.bins(figures)
    got = machine.raw(buckets, first, bins)[0]
    for i in range(2):
        own = buckets[first[i] : first[i + 1]]
        x = np.concatenate([np.full(len(own), 1 / math.sqrt(max(1, len(own)))), np.ones(len(quality.FIGURES))])
        at = np.concatenate([own, bins[i]])
        pairs = sum(machine.factors[a] @ machine.factors[b] * x[p] * x[q] for p, a in enumerate(at) for q, b in enumerate(at) if p < q)
        assert got[i] == pytest.approx(0.3 + machine.weights[at] @ x + pairs)


def test_license_scan(spark):
    apache = licenses.TEMPLATES["Apache-2.0-header"]
    cut = apache.split()
    cut[12] = "changed"
    rows = [(1, "x y z " * 50 + "Released under the MIT license!" + " q" * 40), (2, "words " * 33 + apache + " more" * 9), (3, "a " * 17 + " ".join(cut)), (4, "nothing at all to see here"), (5, None), (6, "the mit"), (7, licenses.TEMPLATES["GPL-3.0"])]
    rows += [(7, rows[-1][1])]
    got = {(r.doc_id, r.license): r for r in licenses.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert set(got) == {(1, "MIT"), (2, "Apache-2.0"), (2, "Apache-2.0-header"), (3, "Apache-2.0"), (3, "Apache-2.0-header"), (7, "GPL-3.0")}
    assert got[2, "Apache-2.0-header"].containment == 1 and 0.8 <= got[3, "Apache-2.0-header"].containment < 1
    assert got[1, "MIT"].first_word == 150
    assert licenses.scan(spark.createDataFrame([], DOCS)).collect() == []


def test_license_scan_finds_every_notice(spark):
    docs = documents(spark)
    got = {r.doc_id for r in licenses.scan(docs).collect()}
    plain = {k: re.findall("[a-z0-9]+", v.lower()) for k, v in licenses.TEMPLATES.items()}
    for r in docs.select("doc_id", "text").collect():
        words = f" {' '.join(re.findall('[a-z0-9]+', r.text.lower()))} "
        assert (r.doc_id in got) == any(f" {' '.join(w)} " in words for w in plain.values())


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_lm_scores(spark):
    rows = [(i, t) for i, t in enumerate(["the cat sat on the mat", "the cat sat", "The Cat ran É", "", None, "dog"] * 20 + ["unseen words here", "x " * 5000])]
    rows += rows[:2]
    docs = spark.createDataFrame(rows, DOCS).withColumn("held", F.col("doc_id") % 10 == 0)
    tokens = {d: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None] for d, t in rows}
    seen = Counter(w for d, _ in rows if d % 10 for w in tokens[d])
    n, v = sum(seen.values()), len(seen)
    got = lm.score(docs, "not held", keep=("held",), order=2).collect()
    assert len(got) == len(rows)
    for r in got:
        own = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(seen[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), abs=1e-6)
    by = {r.doc_id: r for r in got}
    assert by[0].score > by[0].base_score
    pairs = Counter(p for d, _ in rows if d % 10 for p in zip([None, *tokens[d]], tokens[d], strict=False))
    exact = 0.0
    for u, w in zip([None, *tokens[1]], tokens[1], strict=False):
        base = (seen[w] + 0.1) / (n + 0.1 * (v + 1))
        rest = 1 - sum((pairs[u, x] - lm.DISCOUNT) / seen[u] for x in seen if pairs[u, x])
        exact += math.log10(max(pairs[u, w] - lm.DISCOUNT, 0) / seen[u] + rest * base)
    assert by[1].score == pytest.approx(exact, abs=0.02 * len(tokens[1]))


def test_lm_counts_rare_words_and_three_orders(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", f"once{i}"]) for _ in range(rng.randint(1, 12)))) for i in range(80)] + [(80, None)]
    docs = spark.createDataFrame(rows, DOCS)
    tokens = {d: [None, None, *re.findall(r"[^\x20\x09-\x0D]+", t or ""), None] for d, t in rows}
    counts = [Counter(tuple(tokens[d][i - k : i + 1]) for d, _ in rows if d % 10 for i in range(2, len(tokens[d]))) for k in range(3)]
    n, v = sum(counts[0].values()), len(counts[0])
    seen = [Counter() for _ in range(3)]
    kinds = [Counter() for _ in range(3)]
    for k in (1, 2):
        for g, c in counts[k].items():
            seen[k][g[:-1]] += c
            kinds[k][g[:-1]] += 1
    for r in lm.score(docs, "doc_id % 10 > 0", order=3).collect():
        own = tokens[r.doc_id]
        exact = 0.0
        for i in range(2, len(own)):
            p = (counts[0][own[i],] + 0.1) / (n + 0.1 * (v + 1))
            for k in (1, 2):
                g = tuple(own[i - k : i + 1])
                if seen[k][g[:-1]]:
                    p = max(counts[k][g] - lm.DISCOUNT, 0) / seen[k][g[:-1]] + lm.DISCOUNT * kinds[k][g[:-1]] / seen[k][g[:-1]] * p
            exact += math.log10(p)
        assert r.score == pytest.approx(exact, abs=0.02 * len(own))


def test_lm_of_many_batches_and_clashing_names(spark):
    rng = random.Random(5)
    rows = [(i % 50, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30)))) for i in range(300)] + [(None, None)] * 200
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("mine"))
    one = sorted((str(r.doc_id), r.n_tokens, r.base_score, r.score) for r in lm.score(docs, "doc_id % 10 > 0", batch_bytes=1 << 30).collect())
    many = sorted((str(r.doc_id), r.n_tokens, r.base_score, r.score) for r in lm.score(docs, "doc_id % 10 > 0", keep=("score",), batch_bytes=100).collect())
    assert len(one) == len(many) == 500
    for a, b in zip(one, many, strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=0.01)


def test_trie_is_smaller_than_plain_arrays():
    rng = np.random.default_rng(8)
    pairs = np.unique(rng.integers(0, 100_000 << 23, 1_000_000))
    trie = lm.Trie(pairs, np.ones(len(pairs), np.int64), np.bincount(pairs >> 23, minlength=100_000), 1 << 23)
    assert trie.bytes < 0.55 * 9 * len(pairs)
    share, rest = trie.find(pairs[::7])
    assert (share > 0).all() and (rest < 1).all()


def test_lm_without_training_rows(spark):
    got = lm.score(spark.createDataFrame([(1, "a b"), (2, None)], DOCS), "false").collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(1, 3, 0, 0), (2, 1, 0, 0)}
    assert lm.score(spark.createDataFrame([], DOCS), "true").collect() == []


def test_elias_fano_and_trie():
    rng = np.random.default_rng(3)
    for n, bound in ((0, 10), (1, 1), (500, 10**6), (500, 100), (20_000, 1 << 40)):
        values = np.sort(rng.integers(0, bound, n))
        coded = lm.EliasFano(values, bound)
        coded.place(coded.parts())
        assert coded[np.arange(n)].tolist() == coded.decode(0, n).tolist() == lm.EliasFano.frombytes(coded.tobytes()).tolist() == values.tolist()
    total = np.full(40, 1000)
    pairs = np.unique(rng.integers(0, 40 * 41, 300))
    counts = rng.integers(1, 9, len(pairs))
    trie = lm.Trie(pairs, counts, total)
    share, rest = trie.find(np.arange(40 * 41))
    known = dict(zip(pairs.tolist(), counts.tolist(), strict=True))
    for p in range(40 * 41):
        exact = max(known.get(p, 0) - lm.DISCOUNT, 0) / 1000 if p % 41 < 40 else 0
        assert share[p] == pytest.approx(exact, rel=0.02)
    for u in range(40):
        used = sum((known[p] - lm.DISCOUNT) / 1000 for p in known if p // 41 == u and p % 41 < 40)
        assert rest[u * 41] == pytest.approx(1 - used, rel=0.02)


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.held_out(F.crc32(F.col("doc_id").cast("string")) % 4)
    got = langid.predict(docs.where(held), langid.learn(docs.where(~held))).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98


def test_cross_parsing(spark):
    model = langid.train({"a": ["abcabcabd abc"], "b": ["xyzxyy xyz"]})
    texts = ["ABC abd", "xyz", None, "", "12 !", "q" * 600, "ab" + " \n\t" * 50 + "abd"]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score, r.lang) for r in langid.predict(docs, model).collect()}
    assert [got[i][0] for i in range(7)] == ["a", "b", "und", "und", "und", "a", "a"]
    assert got[2][1] == got[4][1] == 0 and got[5][1] == 0

    def plainly(text, train):
        n = i = 0
        while i < len(text):
            j = i + 1
            while j <= len(text) and text[i:j] in train:
                j += 1
            n += 1
            i = max(i + 1, j - 1)
        return n

    rng = random.Random(4)
    train = {k: "".join(rng.choice(s) for _ in range(200)) for k, s in (("p", "abc "), ("q", "abd "))}
    train = {k: re.sub(" +", " ", v) for k, v in train.items()}
    model = langid.train({k: [v] for k, v in train.items()})
    for _ in range(30):
        text = re.sub(" +", " ", "".join(rng.choice("abcde ") for _ in range(rng.randint(1, 200))))
        counts, _ = langid.phrases(model, [text])
        assert counts[0].tolist() == [plainly(text, train[k] + " ") for k in "pq"]
    assert {r.lang_pred for r in langid.predict(docs, langid.train({})).collect()} == {"und"}
    assert langid.train({}) and langid.learn(docs.where("false")).languages == []


def distance_plainly(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(last + (c != d), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_decontamination(spark):
    rng = random.Random(6)
    items = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(8, 90))).strip() for _ in range(8)] + ["", None]
    items.append(items[0])
    rows = []
    for i in range(60):
        t = list(rng.choice(items[:8]))
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(t))
            t[k : k + rng.randint(0, 1)] = rng.choice(["x", "", "yy"])
        rows.append((i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 60))) + " ".join(["", "".join(t).upper(), ""]) + "zz" * rng.randint(0, 9)))
    rows += [(100, None), (101, "")] + rows[:2]
    for rate in (0.05, 0.1, 0.2):
        got = sorted((r.doc_id, r.item_id, r.distance) for r in decontam.contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), rate).collect())
        exact = []
        for d, t in rows:
            for k, item in enumerate(items):
                plain = decontam.plain(item)
                if plain and (n := distance_plainly(plain, decontam.plain(t))) <= int(rate * len(plain)):
                    exact.append((d, k, n))
        assert got == sorted(exact)
    docs = spark.createDataFrame(rows, DOCS)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(docs, none).collect() == [] and decontam.clean(docs, none).count() == len(rows)


def test_decontamination_finds_copies_with_eight_percent_of_edits(spark):
    rng = random.Random(13)
    item = "".join(rng.choice("abcdefgh") for _ in range(100))
    docs = [(n, "zz " + "".join("x" if i % 12 == 5 and i < 12 * n else c for i, c in enumerate(item)) + " zz") for n in (0, 6, 8)]
    got = decontam.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.distance) for r in got) == [(0, 0), (6, 6), (8, 8)]


def test_columns_of_new_names_are_replaced(spark, vocabulary):
    docs = spark.createDataFrame([(1, "the text", "x", "y", 3.0, "z"), (None, None, None, None, None, None)], "doc_id long, text string, lang_pred string, _kept string, score double, a_b string")
    model = langid.train({"en": ["the text of it"], "de": ["der und die"]})
    got = langid.predict(docs, model).where("doc_id = 1").first()
    assert got.lang_pred == "en" and got.score != 3.0 and got.a_b == "z"
    assert quality.score(docs, quality.fit([], np.zeros((0, 12)), np.zeros(0))).where("doc_id = 1").first().score == 0.5
    assert {r._kept for r in suffix.dedup(docs).collect()} == {"the text", ""}
    assert bpe.encode(docs.withColumnRenamed("lang_pred", "bpe_ids"), *vocabulary).where("doc_id = 1").first().bpe_ids[0] >= 0
    with pytest.raises(ValueError, match="at once"):
        bpe.encode(docs.withColumnRenamed("text", "bpe_ids"), *vocabulary, text_col="bpe_ids")


def test_copies_without_ids_and_short_passages(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = " ".join(word() for _ in range(55))
    assert len(passage) < suffix.LENGTH
    rows = [(None, passage + " " + passage)] * 400 + [(i, " ".join(word() for _ in range(40)) + " " + passage + " " + word()) for i in range(3)]
    rows += [(10, " ".join(word() for _ in range(200))), (11, passage.rpartition(" ")[0].split(" ", 6)[6]), (12, None)]
    got = suffix.digests(spark.createDataFrame(rows, DOCS)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and sum(r.n_removed == r.n_bytes > 0 and r.n_passage_words == 110 for r in got if r.doc_id is None) == 400
    assert [by[i].n_passage_words for i in range(3)] == [55] * 3 and [by[i].n_removed for i in range(3)] == [0] * 3
    assert [by[i].n_passage_words for i in (10, 11, 12)] == [0, 0, 0]


def test_jaccard_links_rows_without_ids(spark):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    near = lambda i: " ".join([*base[:i], "other", *base[i + 1 :]])
    rows = [(None, near(119)), (7, near(0)), (9, near(118)), (None, "some other text of its own words"), (9, "a text that only shares an id with one")]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 7), (7, 7), (9, 7), (9, 9)]
    docs = spark.createDataFrame([*rows, rows[4], (3, None), (3, None)], DOCS).withColumn("_jaccard", F.lit(1))
    left = sorted((r.doc_id or -1, r.text or "") for r in jaccard.one_of_each(docs).collect())
    assert left == sorted([(-1, rows[3][1]), (7, rows[1][1]), (9, rows[4][1]), (3, ""), (3, "")])


def test_jaccard_deals_keys_in_two_steps(spark):
    rng = random.Random(6)
    sets = [[rng.randint(0, 400) for _ in range(60)] for _ in range(60)]
    rows = [(i, " ".join(f"w{x}" for x in s)) for i, s in enumerate(sets + [[*s[:-1], 999] for s in sets])]
    named = jaccard.classes(spark.createDataFrame(rows, DOCS), 2, 60, "doc_id", "text")
    plain = sorted((r.key, r["class"]) for r in jaccard._keys(named).collect())
    assert plain and plain == sorted((r.key, r["class"]) for r in jaccard._keys(named, ways=2, bucket_bytes=2000).collect())
    often = Counter(k for r in named.collect() for k in np.frombuffer(r["keys"], np.int64).tolist())
    assert {k for k, _ in plain} == {k for k, n in often.items() if n > 1} and len(plain) == sum(n for n in often.values() if n > 1)


def test_decontamination_without_hits_at_first_and_clashing_names(spark):
    rows = [(i, "clean words only") for i in range(3000)] + [(3000, "an item of the benchmark stands here in full")]
    items = spark.createDataFrame([("q", "an item of the benchmark")], "id string, text string")
    got = decontam.contaminated(spark.createDataFrame(rows, "id long, text string").coalesce(1), items, doc_id="id", item_id="id").collect()
    assert [(r.id, r.item_id, r.distance) for r in got] == [(3000, "q", 0)]


def test_language_id_of_many_scripts_and_languages(spark):
    rng = random.Random(17)
    scripts = {"ru": (0x430, 32), "el": (0x3B1, 24), "zh": (0x4E00, 900), "ja": (0x3041, 80), "ko": (0xAC00, 900), "en": (0x61, 26), "it": (0x61, 26)}
    words_ = {k: ["".join(chr(a + rng.randrange(n)) for _ in range(rng.randint(1, 5))) for _ in range(150)] for k, (a, n) in scripts.items()}
    text = lambda k, n: " ".join(rng.choice(words_[k]) for _ in range(n))
    rows = [(i, text(k, 60), k) for i, k in enumerate([*scripts] * 12)] + [(None, text("ru", 50), "ru")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    asked = spark.createDataFrame([(i, text(k, 12), k) for i, k in enumerate([*scripts] * 10)], "doc_id long, text string, lang string")
    assert all(r.lang == r.lang_pred and r.score > 0 for r in langid.predict(asked, model).collect())
    assert any(a.table is None for a in model.tables)
    many = {f"l{i:03}": [text("en", 3) + f" {''.join(chr(97 + (i * 7 + j * j) % 26) for j in range(12))}"] for i in range(100)}
    assert len(langid.train(many).languages) == 100


def test_sparse_and_dense_automata_agree(monkeypatch):
    rng = random.Random(2)
    train = {k: ["".join(rng.choice("abcde ") for _ in range(300))] for k in "pq"}
    texts = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 700))) for _ in range(20)]
    dense = langid.phrases(langid.train(train), texts)[0].tolist()
    monkeypatch.setattr(langid, "DENSE", 3)
    assert langid.phrases(langid.train(train), texts)[0].tolist() == dense


def test_purity_backs_off_along_the_tree(spark):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        parts = [rng.choice(["a", "b", "c"]) for _ in range(rng.randint(0, 4))]
        rows.append((f"h{i % 3}", "".join(f"/{p}" for p in parts), rng.randint(0, 3), rng.choice([0, 0, 2])))
    tree = spark.createDataFrame(rows, "host string, template string, blocked long, allowed long")
    got = {(r.host, r.template): r.purity for r in urls.purities(tree).collect()}

    def plainly(host, template):
        p, parts = urls.PRIOR, template.split("/")
        for k in range(1, len(parts) + 1):
            node = "/".join(parts[:k])
            below = [(b, a) for h, t, b, a in rows if h == host and (t == node or t.startswith(node + "/"))]
            p = (sum(b for b, _ in below) + urls.ALPHA * p) / (sum(a + b for b, a in below) + urls.ALPHA)
        return p

    assert len(got) == len({r[:2] for r in rows}) and all(v == pytest.approx(plainly(*k)) for k, v in got.items())
    pages = [(i, f"http://bad.net/es/x{i}") for i in range(40)] + [(100, "http://bad.net/other"), (101, "http://good.org/other"), (102, None)]
    judged = {r.page_id: (r.verdict, r.rule) for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("own")), keep=("page_id", "host")).collect()}
    assert judged[100] == ("block", None) and judged[101] == judged[102] == ("allow", None) and judged[0] == ("block", "net/es/")


def test_media_tables_of_two_tracks():
    whole = media.pack(media.pad(b"abc" * 900))
    boxes = {p: (a, b) for p, a, b in media.walk(whole, 0, len(whole))}
    moov, trak = next(k for k in boxes if k[-1] == b"moov"), next(k for k in boxes if k[-1] == b"trak")
    own = whole[boxes[trak][0] - 8 : boxes[trak][1]]
    empty = (8).to_bytes(4, "big") + b"trak"
    a, b = boxes[moov]
    for first, second in ((empty, own), (own, own)):
        inner = whole[a : boxes[trak][0] - 8] + first + second + whole[boxes[trak][1] : b]
        both = whole[: a - 8] + (len(inner) + 8).to_bytes(4, "big") + b"moov" + inner + whole[b:]
        track, alone = media.probe(both), media.probe(whole)
        assert (track.codec, track.duration, len(track.samples), track.keys) == (alone.codec, alone.duration, len(alone.samples), alone.keys)


def test_license_scan_of_whole_licences(spark):
    """Licences of up to 6,000 words with changed words, in texts of one and of many pieces: recall against plain containment, and nothing that plain containment refuses."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(3000)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    templates = {f"L{k:02d}": prose(n) for k, n in enumerate([5, 6, 9, 40, 41, 200, 450, 900, 1500, 2500, 4000, 6000])}
    rows, planted = [], set()
    for i in range(60):
        name = rng.choice(list(templates))
        body = [w if rng.random() > 0.03 * (i % 3) else "changed" for w in templates[name]]
        planted.add((i, name))
        rows.append((i, " ".join(prose(rng.choice([0, 10, 3000])) + body + prose(rng.choice([0, 50, 2600])))))
    rows += [(100, " ".join(prose(30_000) + templates["L03"] + prose(3000) + templates["L11"])), (101, " ".join(prose(20_000))), (102, None), (103, " ".join(templates["L04"] * 300))]
    planted |= {(100, "L03"), (100, "L11"), (103, "L04")}
    grams = lambda ws: {tuple(ws[a : a + 5]) for a in range(len(ws) - 4)}
    own, held = {k: grams(v) for k, v in templates.items()}, {i: grams((t or "").split()) for i, t in rows}
    true = {(i, k) for i in held for k in own if len(own[k] & held[i]) >= 0.8 * len(own[k])}
    found = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, DOCS), {k: " ".join(v) for k, v in templates.items()}).collect()}
    assert found <= true and len(planted & true & found) >= 0.97 * len(planted & true) and len(planted & true) > 30
    assert {(100, "L03"), (100, "L11"), (103, "L04")} <= found
