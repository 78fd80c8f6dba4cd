"""Alignment of tokenizers, the Pitman-Yor model and periodic runs against brute force and small odd cases."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from pagemill.llm import alignment, periodic, pitman_yor

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
B_SIZE = 32_000
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in all columns, empty and long texts, repeated rows, and columns named like results."""
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "word and " * 12_000), (4, "word and " * 12_000), (None, "a null key with some words"), (5, "ÄÖ é 漢字🙂\u0000x ▁y"), (None, None)]
    return spark.createDataFrame([(i, t, "x", "y", None, 7, 8) for i, t in rows], "doc_id long, text string, runs string, Pairs string, score string, n_a int, chunk int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, trains boolean")


# 11 alignment


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def byte_letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def aligned(libraries, text, letters=byte_letters()):
    """Ids, groups and links by the definition; None where there are no tokens."""
    if not text:
        return None
    a, b = libraries[0].encode(" " + text, add_special_tokens=False).ids, libraries[1].encode(text)
    spelled_a = [bytes(letters[c] for c in libraries[0].id_to_token(i)) for i in a]
    pieces = [libraries[1].id_to_piece(i) for i in b]
    spelled_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
    if not b"".join(spelled_a) == b"".join(spelled_b) == (" " + text).encode():
        return None
    ends_a, ends_b = np.cumsum([len(x) for x in spelled_a]).tolist(), np.cumsum([len(x) for x in spelled_b]).tolist()
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
        i, j = x, y
    links, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        links.append((a[i], b[j]))
        step_a, step_b = ends_a[i] <= ends_b[j], ends_b[j] <= ends_a[i]
        i, j = i + step_a, j + step_b
    return a, b, groups, links


def test_alignment_by_definition(libraries):
    rng = random.Random(1)
    with open(A_PATH, encoding="utf-8") as a, open(B_PATH, "rb") as b:
        aligner = alignment.Aligner(a.read(), b.read())
    letters = list("abcdeeethsinro     \n\n\t▁'\"0123=+é€漢字🙂ßøДж\u0000\u0085　 ") + ["<|endoftext|>", "<s>", "  ", "'s", " the", " \n "]
    for _ in range(25):
        rows = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(100)]
        rows += [None, "", " ", "  ", " a", "a ", "\n", "\n a", "a\n \nb", "a  b", "▁", "x" * 300]
        rng.shuffle(rows)
        n_a, n_b, n_groups, n_links, groups, pairs, counts = [x.to_pylist() for x in aligner.columns(rows)]
        for i, text in enumerate(rows):
            want = aligned(libraries, text)
            got = (n_a[i], n_b[i], n_groups[i], n_links[i], groups[i], dict(zip(pairs[i], counts[i])))
            if want is None:
                assert got == (0, 0, 0, 0, "", {}), repr(text)
            else:
                a, b, told, links = want
                assert got == (len(a), len(b), len(told), len(links), ";".join(told), dict(collections.Counter(x * B_SIZE + y for x, y in links))), repr(text)


@pytest.mark.parametrize("block", [alignment.BLOCK_PAIRS, 500])
@needs_tables
def test_op11(spark, docs, libraries, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_PAIRS", block)
    found = {k: aligned(libraries, t) for k, t in docs.items()}
    count = collections.Counter(p for x in found.values() if x for p in set(x[3]))
    best = collections.defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    rows = entry.queries()["op11_alignment"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = found[r.doc_id]
        if want is None:
            assert tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "")
        else:
            a, b, told, links = want
            numbers = (len(a), len(b), len(told), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links))
            assert tuple(r)[1:] == (*numbers, sha(";".join(told)))


def test_alignment_odd(odd, none):
    rows = alignment.align(odd, A_PATH, B_PATH).collect()
    assert len(rows) == 8 and {"runs", "score", "chunk", "pairs"} <= set(rows[0].asDict()) and "Pairs" not in rows[0].asDict()
    assert [r.n_a for r in rows if not r.text] == [0, 0, 0] and len({r.groups for r in rows if r.doc_id == 4}) == 1
    assert next(r for r in rows if r.doc_id == 5).n_a == 0  # its mark would be read as a blank
    empty = alignment.align(none, A_PATH, B_PATH)
    assert empty.count() == 0 and alignment.pair_counts(empty, B_SIZE).count() == 0


# 12 Pitman-Yor


def tokens(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


def is_held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


@pytest.mark.parametrize("sizes", [(pitman_yor.CHUNK_TOKENS, pitman_yor.BUCKET_PAIRS), (5000, 3000)])
@needs_tables
def test_op12(spark, docs, monkeypatch, sizes):
    """Counts and base by brute force; the model does better on held-out texts, and alike however the work is dealt."""
    monkeypatch.setattr(pitman_yor, "CHUNK_TOKENS", sizes[0])
    monkeypatch.setattr(pitman_yor, "BUCKET_PAIRS", sizes[1])
    texts = {k: tokens(t) for k, t in docs.items()}
    count = collections.Counter(w for k, t in texts.items() if not is_held(k) for w in t)
    n, v = sum(count.values()), len(count)
    rows = entry.queries()["op12_pitman_yor"](spark, SF).collect()
    assert len(rows) == len(docs)
    sums = collections.Counter()
    for r in rows:
        own = texts[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (is_held(r.doc_id), len(own), sum(w in count for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert r.score < 0
        if r.held_out:
            sums.update(score=r.score, base=r.base_score, tokens=r.n_tokens)
    assert 10 ** (-sums["score"] / sums["tokens"]) < 0.5 * 10 ** (-sums["base"] / sums["tokens"])


def test_probabilities_sum_to_one(spark):
    """The probabilities of all texts of up to two words, an unknown one included, add up to a little less than one where training texts have no more."""
    rng = random.Random(2)
    known = [f"w{i}" for i in range(8)]
    train = [" ".join(rng.choices(known, weights=range(1, 9), k=rng.randint(0, 2))) for _ in range(400)]
    words = [*sorted({w for t in train for w in t.split()}), "never"]
    probes = ["", *words, *[f"{u} {w}" for u in words for w in words]]
    df = spark.createDataFrame([(0, t, True) for t in train] + [(1, t, False) for t in probes], "id int, text string, trains boolean")
    mass = sum(10**r.score for r in pitman_yor.score_texts(df, "trains", keep=["id"]).collect() if r.id == 1)
    assert 0.9 < mass < 1


def test_seats_follow_the_posterior():
    """Tables of one dish with two customers: two tables in proportion to the opening weight over it and the other seat."""
    rng = np.random.default_rng(3)
    n, discount, parent = 20_000, 0.4, 0.3
    seats = pitman_yor.Seats(np.full(n, 2), np.arange(n), np.full(n, parent), n, discount, rng)
    for _ in range(5):
        seats.sweep()
    weight = (pitman_yor.CONCENTRATION + discount) * parent
    assert abs((seats.tables == 2).mean() - weight / (weight + 1 - discount)) < 0.015
    assert (seats.own == seats.tables).all()
    for rows, count, sat, sizes in seats.classes:
        assert (sizes.sum(1) == count).all() and ((sizes > 0).sum(1) == seats.tables[rows]).all()


def test_packed_arrays():
    for v in (np.array([], np.int64), np.array([3, 2]), np.arange(70_000), np.array([1.5, 2]), np.array([1.5], np.float32), np.array([2**40])):
        assert (pitman_yor.unpack(pitman_yor.pack(v)) == v).all()


def test_scores_odd(spark, odd, none):
    from pyspark.sql import functions as F

    rows = pitman_yor.score_texts(odd.withColumn("trains", F.when(F.col("doc_id") == 4, True)), "trains").collect()
    assert len(rows) == 8 and "score" in rows[0].asDict() and rows[0].asDict().keys() >= {"runs", "chunk", "n_a", "train_tokens"}
    assert sorted(r.n_tokens for r in rows) == [1, 1, 1, 1, 5, 7, 24_001, 24_001] and {r.train_tokens for r in rows} == {48_002}
    untrained = pitman_yor.score_texts(odd.withColumn("trains", F.lit(None).cast("boolean")), "trains", keep=["doc_id"]).collect()
    assert len(untrained) == 8 and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in untrained)
    assert pitman_yor.score_texts(none, "trains").count() == 0


# 13 periodic runs


def runs_by_definition(words):
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            begin = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - begin >= max(12, 2 * q):
                out.setdefault((begin, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_by_definition():
    rng = random.Random(3)
    for _ in range(40):
        rows = []
        for _ in range(40):
            kind, n = rng.random(), rng.randint(0, 130)
            words = [rng.choice("abcdefghijklmnopqrstuvwxyz"[:rng.choice([1, 2, 2, 3, 5, 26])]) for _ in range(n)]
            if kind < 0.5 and n:
                for _ in range(rng.randint(1, 3)):
                    a = rng.randrange(n)
                    p, m = 1 + rng.randrange(max(1, (n - a) // 2)), rng.randint(0, n - a)
                    words[a:a + m] = [words[a + i % p] for i in range(m)]
            if kind > 0.9:
                x, words = ["a"], ["b"]
                while len(words) < 150:
                    x, words = words, words + x
                words = words[:rng.randint(1, 150)]
            if 0.8 < kind < 0.85:
                words = (["a", "b"] * rng.randint(1, 20) + ["a"]) * 2 + ["b"] * rng.randint(0, 3)
            rows.append(" ".join(words))
        begins, (start, length, period), texts = periodic.runs_of_texts(rows)
        for text, done, i, j in zip(rows, texts, begins, begins[1:]):
            want = runs_by_definition(text.split())
            assert list(zip(start[i:j].tolist(), length[i:j].tolist(), period[i:j].tolist())) == sorted(want, key=lambda r: (r[0], r[2]))
            assert done == collapsed(text.split(), want)


def test_wavelet_matrix():
    rng = np.random.default_rng(4)
    values = rng.permutation(777)
    matrix = periodic.WaveletMatrix(values)
    low = rng.integers(0, 777, 500)
    high = np.minimum(777, low + rng.integers(1, 100, 500))
    bound = rng.integers(0, 778, 500)
    less = matrix.less(low, high, bound)
    assert less.tolist() == [int((values[i:j] < x).sum()) for i, j, x in zip(low, high, bound)]
    k = (rng.random(500) * (high - low)).astype(np.int64)
    assert matrix.nth(low, high, k).tolist() == [int(np.sort(values[i:j])[m]) for i, j, m in zip(low, high, k)]


@needs_tables
def test_op13(spark, docs):
    rows = entry.queries()["op13_runs"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        words = WORDS.findall(docs[r.doc_id] or "")
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if n > 4000:
            continue  # slow by definition
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = sorted(runs_by_definition(words), key=lambda x: (x[0], x[2]))
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        told = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        assert tuple(r)[1:] == (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(told), sha(collapsed(words, runs)))


def test_runs_odd(odd, none):
    rows = periodic.collapse_runs(odd).collect()
    assert len(rows) == 8 and {"Pairs", "score", "chunk"} <= set(rows[0].asDict())
    found = {r.doc_id: r for r in rows if r.doc_id}
    assert [found[i].collapsed for i in (1, 2, 3)] == ["", "", ""] and found[1].runs == []
    assert [tuple(x) for x in found[4].runs] == [(0, 24_000, 2)] and found[4].collapsed == "word and"
    assert periodic.collapse_runs(none).count() == 0
