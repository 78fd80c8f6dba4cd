"""The training-data operators against brute force, round trips and small cases with nulls, ties and clashing columns."""

import base64
import bz2
import collections
import gzip
import hashlib
import math
import os
import re
import zlib
from urllib.parse import quote

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import compare as harness
import corpus_pipeline
from pagemill.llm import decontaminate, jaccard, language, pieces, quality, queries, secrets, sharding, substring, url_rules, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in all columns, empty and long texts, repeated rows, and columns named like results."""
    long = "word " * 30_000
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, long), (4, long), (None, "a null key with some words in it"), (5, "ÄÖ é 漢字🙂\u0000x"), (6, "!!! 123"), (7, "a null key with some words in it")]
    out = [(i, t, None, None, None, "x", 7, "y", "z") for i, t in rows]
    return spark.createDataFrame(out, DOCS + ", ids string, size int, Shard string, keys string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# Registered queries


@needs_tables
@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.SQL])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in harness.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert harness.compare(spark, con, SF, name)[0] == "ok"


def test_registered():
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {n.split("_")[0] + "_" for n in names} and "pipeline" in names


# 1 SentencePiece


@pytest.fixture(scope="module")
def model():
    with open(MODEL, "rb") as file:
        return pieces.PieceModel(file.read())


def test_pieces_equal_library(model):
    rng = np.random.default_rng(1)
    letters = list("abcdeeethsinro  \n\t▁'\"0123=+é€漢字🙂\u0000<s>")
    cases = ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(3000)]
    cases += [x * k for k in (1, 2, 3, 5, 17, 64, 999) for x in (" ", "\n", "a", "the", "the ", "▁", "é")] + [" " * 50_000]
    for text in cases:
        ids = model.encode(text)
        assert ids.tolist() == model.library.encode(text), text[:60]
        assert model.decode(ids) == model.library.decode(model.library.encode(text))


@needs_tables
def test_op1(spark, docs, model):
    for r in entry.queries()["op1_pieces"](spark, SF).collect():
        ids = model.library.encode(docs[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(model.library.decode(ids)))


def test_pieces_odd(spark, odd, none, model):
    got = pieces.encode_pieces(odd, MODEL)
    assert "size" in got.columns and got.columns.count("ids") == 1
    rows = got.collect()
    assert len(rows) == 9 and all(r.ids == model.library.encode(r.text or "") for r in rows)
    assert pieces.encode_pieces(none, MODEL).count() == 0


# 2 substring dedup


def _passage(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(n))


def test_passages(spark):
    rng = np.random.default_rng(5)
    shared = [_passage(rng, 60) for _ in range(20)]
    rows, holders = [], collections.defaultdict(list)
    for i in range(120):
        text = _passage(rng, 80)
        if i < 60:
            cut = int(rng.integers(0, len(text)))
            text = text[:cut] + shared[i % 20] + text[cut:]
            holders[i % 20].append(i)
        rows.append((i, text))
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == set(range(60))
    for r in got:
        passage = shared[r.doc_id % 20]
        text = rows[r.doc_id][1]
        # A chunk that ends in the passage may have begun a few equal characters before it, not more.
        assert text[r.start : r.end] in passage or len(set(text[r.start : r.end]) - set(passage)) == 0
        assert r.first_key == holders[r.doc_id % 20][0] and r.first == (r.doc_id == r.first_key)
        assert r.end - r.start >= 128


def test_chunks_resist_shifts():
    rng = np.random.default_rng(6)
    text = _passage(rng, 3000)
    before, after = substring.chunks(text)[0], substring.chunks("é inserted " + text)[0]
    assert len(before) > 300 and len(set(before.tolist()) - set(after.tolist())) <= 6
    raw = np.frombuffer(text.encode(), np.uint8)
    want = [sum(int(substring.GEAR[raw[i - j]]) << j for j in range(min(substring.WINDOW, i + 1))) % (1 << 32) for i in range(200)]
    assert substring.gear_hashes(raw)[:200].tolist() == want


def test_passages_odd(odd, none):
    got = substring.repeated_passages(odd).collect()
    assert {r.doc_id for r in got} == {4} and all(r.first for r in got)  # a repeated row
    assert substring.repeated_passages(none).count() == 0


# 3 shards


@needs_tables
def test_op3(spark, docs):
    rows = entry.queries()["op3_shards"](spark, SF).collect()
    slots, sizes = collections.defaultdict(list), collections.Counter()
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert len(rows) == len(docs) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    most = max(len((t or "").encode()) + 1 for t in docs.values())
    assert max(sizes.values()) - min(sizes[s] for s in range(16)) <= 2 * most


def test_shards_hot_group(spark):
    """A third of all rows are equal texts: their group is cut, and stands together otherwise."""
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i} " + "x" * (i % 50)) for i in range(6000)]
    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    mean = sum(sizes.values()) / 8
    assert len(sizes) == 8 and max(abs(v - mean) for v in sizes.values()) < 120
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    spread = {r.shard for r in got if r.text == "the same text"}
    assert len(spread) <= 4 and max(spread) - min(spread) == len(spread) - 1


def test_shards_odd(spark, odd, none):
    got = sharding.shard_rows(odd, 4).collect()
    assert len(got) == 9 and sorted(r.size for r in got)[:2] == [1, 1]
    assert sharding.shard_rows(none, 4).count() == 0


# 4 archives


def test_archives(spark):
    big = "<p>" + "same " * 300 + "</p>"
    rows = [(i, f"http://a.b/{i} x\n", big if i % 3 == 0 else f"<p>{i}</p>" * (i % 400)) for i in range(900)]
    rows += [(5000, None, None), (5001, "", ""), (None, "u", big), (899_999, "é", "ü" * 999), (2, "u", "other"), (897, "again", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.archive_pages(pages)
    got = warc.read_archives(manifest).collect()
    assert len(got) == len(rows) == sum(r.records for r in manifest.collect())
    want = collections.Counter()
    for key, url, html in rows:
        raw = (html or "").encode()
        again = html == big and key != 897
        name = "" if key is None else str(key)
        want[f"<urn:page:{name}>", "revisit" if again else "response", "<urn:page:897>" if again else None, hashlib.sha1(raw).hexdigest(), len(raw), b"" if again else raw,
             None if url is None else url.replace(" ", "%20").replace("\n", "%0A")] += 1
    assert collections.Counter((r.id, r.kind, r.refers, r.digest, r.size, bytes(r.payload), r.uri) for r in got) == want
    assert warc.read_archives(warc.archive_pages(pages.limit(0))).count() == 0


def test_archive_dictionary_and_faults(tmp_path):
    import io

    archive = warc._Archive(str(tmp_path), "a.warc.zst")
    payloads = [f"<html><body>page {i} ".encode() * 40 for i in range(4000)]
    for i, p in enumerate(payloads):
        archive.add(warc.record("response", str(i), None, None, p, hashlib.sha1(p).hexdigest(), len(p)))
    archive.close()
    raw = (tmp_path / "a.warc.zst").read_bytes()
    assert int.from_bytes(raw[:4], "little") == warc.SKIPPABLE
    read = list(warc.frames(io.BytesIO(raw)))
    assert len(read) == 4000 and [warc.parse_record(f)["payload"] for f in read] == payloads
    with pytest.raises(warc.WarcError):
        list(warc.frames(io.BytesIO(raw[:-3])))
    good = read[0]
    for bad in (good.replace(b"page 0", b"page 1", 1), good[:-1], good + b"x", good.replace(b"WARC/1.1", b"WARC/9.9"), re.sub(rb"Content-Length: \d+", b"Content-Length: 7", good, count=1), good.replace(b"WARC-Date", b"WARC-Dote")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)


# 5 language


@needs_tables
def test_op5(spark):
    known = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    rows = entry.queries()["op5_language"](spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(known) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert held and sum(r.lang_pred == known[r.doc_id] for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_filters_hold_their_grams():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    masks = rng.integers(1, 8, 20_000).astype(np.uint64)
    filters = language.Filters(["a", "b", "c"], hashes, masks)
    assert not np.any(masks & ~filters.holding(hashes).astype(np.uint64))
    other = rng.integers(0, 1 << 63, 50_000).astype(np.uint64)
    assert np.all(np.abs(filters._counts(filters.holding(other)) / 50_000 - filters.false) < 0.01)
    assert np.all(filters.shares(other) < 0.01)


def test_language_odd(spark, odd, none):
    filters = language.learn(spark.createDataFrame([(i, "the word and others", "en") for i in range(5)] + [(9, "le mot et les autres", "fr"), (10, None, "de"), (None, "x y", None)], "doc_id long, text string, lang string"))
    assert filters.languages == ["en", "de", "fr"]
    got = language.identify(odd, filters).collect()
    by = {r.doc_id: r.lang_pred for r in got}
    assert len(got) == 9 and by[1] == by[2] == by[3] == by[6] == "und" and by[4] == "en"
    empty = language.learn(none)
    assert [r.lang_pred for r in language.identify(odd, empty).collect()] == ["und"] * 9
    assert language.identify(none, filters).count() == 0


# 6 decontamination


def test_hits(spark, monkeypatch):
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short item"), (3, None), (4, ""), (5, "ten eleven"), (None, "nameless words"), (2, "Short item"), (10, "one two three four five six seven eight nine ten")]
    rows = [(1, "x ONE two, three-four five six seven eight nine ten! y", "a"), (2, None, "b"), (3, "a short ITEM; short item", "c"), (4, "é nameless words, ten eleven", "d"), (5, "shorty item", "e"), (6, "nine ten eleven twelve " * 20_000, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    table = spark.createDataFrame(items, "item_id long, text string")
    want = {1: (12, ["1", "10"], [(2, 51)]), 2: (0, [], []), 3: (5, ["2"], [(2, 24)]), 4: (5, ["5"], [(2, 28)]), 5: (2, [], [])}
    for bound in (1 << 20, 60):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", bound)
        got = {r.doc_id: r for r in decontaminate.benchmark_hits(docs, table).collect()}
        for key, (n, names, spans) in want.items():
            r = got[key]
            assert (r.n_words, r.hit_items, [tuple(s) for s in r.hit_spans]) == (n, names, spans), (key, r)
        assert got[6].hit_items == ["5"] and sum(h.last - h.first + 1 for h in got[6].hit_words) == 40_000
    assert decontaminate.benchmark_hits(docs.limit(0), table).count() == 0
    assert all(not r.hit_items for r in decontaminate.benchmark_hits(docs, table.limit(0)).collect())


# 7 quality


def _measures(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = collections.Counter(win)
    hit = {i + j for i, x in enumerate(win) if n[x] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


@needs_tables
def test_op7(spark, docs):
    rows = entry.queries()["op7_quality"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = _measures(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and not (r.base_failed and r.kept)


def test_measures():
    rng = np.random.default_rng(3)
    for _ in range(400):
        text = "".join(rng.choice(list("abZ \n\t#é|"), rng.integers(0, 60)))
        got = quality.measures(text)
        assert (*got[:3], got[4], got[5]) == _measures(text) and got[6] == len(re.findall("[A-Z]", text)), text


def test_bound_is_exact():
    for n, k in ((50, 0), (50, 3), (400, 7), (10, 10), (2000, 31)):
        p = quality.upper_bound(k, n, 0.01)
        tail = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert p == 1.0 if k == n else tail == pytest.approx(0.01, rel=1e-6)


def test_cutoffs_reject_few_good(spark):
    plain = "these are some quite plain words that nobody would ever want to lose again %d"
    rows = [(i, plain % i) for i in range(4000)] + [(i, (plain % i).replace(" ", "## ")) for i in range(4000, 5000)]
    labels = [(i, 1, 0) for i in range(3000)] + [(i, 0, 0) for i in range(4000, 4500)] + [(None, 1, 0), (1, None, None), (4001, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.kept for r in quality.quality_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i] for i in range(4000)) and not any(got[i] for i in range(4000, 5000))
    none = quality.quality_rules(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert all(r.kept for r in none)


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_rules(odd, labels).collect()
    assert len(got) == 9 and {r.doc_id for r in got if r.base_failed} >= {1, 2, 3, 4}
    assert quality.quality_rules(none, labels).count() == 0


# 8 urls


def test_urls(spark, monkeypatch):
    rules = url_rules.RULES + [("", "/any/", "block"), ("b.example.org", "", "allow"), ("x.org", "/a", "allow"), ("x.org", "/a", "block"), (None, None, None)]
    urls = ["http://a.EXAMPLE.org/es/1?q", "https://example.org/en/1", "https://example.org/en/12/3", "http://example.org/en/2", "http://badexample.org/es/", "http://com/fr/x", "ftp://u.com/de/#f", "nohost/es/", None, "", "://x.org/ab", "http://x.org", "http://z.net/any/1", "http://c.b.example.org/es/1", "http://a.org?x=/es/", "http://q.net/an", "http://a//b://c/d"]
    want = [("example.org/es/", "block"), ("example.org/en/1", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("org/", "allow"), ("com/fr/", "allow"), ("com/de/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("x.org/a", "block"), (None, "allow"), ("/any/", "block"), ("b.example.org", "allow"), (None, "allow"), (None, "allow"), (None, "allow")]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, Rule string")
    for bound in (1 << 20, 200):
        monkeypatch.setattr(url_rules, "BLOCK_BYTES", bound)
        got = {r.page_id: r for r in url_rules.judge_urls(pages, spark.createDataFrame(rules, url_rules.SCHEMA)).collect()}
        assert [(got[i].rule, got[i].verdict) for i in range(len(urls))] == want
    assert (got[0].host, got[0].path) == ("a.example.org", "/es/1") and (got[16].host, got[16].path) == ("a", "//b://c/d") and (got[7].host, got[8].path) == ("", "")
    assert url_rules.judge_urls(pages.limit(0), spark.createDataFrame(rules, url_rules.SCHEMA)).count() == 0


# 9 Jaccard join


def _shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def _groups(rows, size, percent):
    sets = [(k, _shingles(t, size)) for k, t in rows]
    over = list(range(len(sets)))

    def top(i):
        while over[i] != i:
            i = over[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * (n := len(a & b)) >= percent * (len(a) + len(b) - n):
                over[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (k, _) in enumerate(sets):
        if k is not None:
            least[top(i)] = min(least.get(top(i), k), k)
    return sorted([(k, len(s), least.get(top(i))) for i, (k, s) in enumerate(sets)], key=str)


def _near_copies(rng, n, words, edits):
    base = [f"w{rng.integers(0, 60)}" for _ in range(words)]
    out = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.integers(0, edits + 1)):
            own[rng.integers(0, len(own))] = f"e{rng.integers(0, 9)}"
        out.append(" ".join(own[: len(own) - rng.integers(0, 3)]))
    return out


@pytest.mark.parametrize("percent", [85, 80, 60])
def test_groups(spark, percent):
    rng = np.random.default_rng(percent)
    texts = [t for words, edits in ((1, 1), (3, 1), (7, 1), (12, 2), (17, 2), (23, 2), (40, 3), (90, 6), (200, 10)) for t in _near_copies(rng, 28, words, edits)]
    texts += ["shared line of many words here " * 3 + t for t in texts[:40]] + ["", None, "  "]
    rows = [(int(k), t) for k, t in zip(rng.permutation(len(texts)) + 10, texts)] + [(None, texts[30]), (None, "alone without key words"), (3, texts[60]), (3, texts[60])]
    got = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, percent).collect()
    assert sorted([tuple(r) for r in got], key=str) == _groups(rows, 4, percent)


@needs_tables
def test_op9(spark, docs):
    got = sorted([tuple(r) for r in entry.queries()["op9_jaccard"](spark, SF).collect()], key=str)
    assert got == _groups(list(docs.items()), 4, 85)


def test_groups_odd(odd, none):
    got = jaccard.jaccard_groups(odd).collect()
    by = collections.Counter((r.doc_id, r.component_id) for r in got)
    assert by == {(1, 1): 1, (2, 2): 1, (3, 3): 1, (4, 4): 2, (None, 7): 1, (7, 7): 1, (5, 5): 1, (6, 6): 1}
    assert jaccard.jaccard_groups(none).count() == 0


def test_least_overlap_covers_all_pairs():
    for percent in (60, 80, 85, 95):
        law = jaccard.Threshold(percent)
        for n in range(1, 60):
            partners = [m for m in range(1, 120) if any(100 * k >= percent * (n + m - k) for k in range(min(n, m) + 1))]
            assert min(partners) == law.least(n) and all(law.overlap(n, m) == min(k for k in range(m + 1) if 100 * k >= percent * (n + m - k)) for m in partners)
            assert {law.overlap(n, m) for m in partners if m <= 40} == set(law.subset_sizes(n, 40))


# 10 secrets


def _plain(t):
    t = t or ""
    s = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.ASCII) if len(m[2]) >= 6]
    s += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(s + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24])


def _listed(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)


@needs_tables
def test_op10(spark, docs):
    for r in entry.queries()["op10_secrets"](spark, SF).collect():
        base = _plain(docs[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert r.base_sha256 == sha(_listed(base)) and set(filter(None, _listed(base).split(","))) <= set(r.spans.split(","))


def test_plain_matches_random():
    rng = np.random.default_rng(4)
    parts = ["token", "SECRET", "paſſwd", "apiKey", "api_key", " ", ":", "=", '"', "'", "abc", "deadbeef" * 3, "AKIA", "ABCDEFGH12345678", "é", "x", "\n", "."]
    for _ in range(4000):
        text = "".join(rng.choice(parts, rng.integers(0, 14)))
        assert secrets.plain_matches(text) == _plain(text), text


SECRET = 'password = "hunter2-hunter2"'


@pytest.mark.parametrize("wrap", [
    lambda s: quote(s, safe=""), lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: "".join(f"&#{ord(c)};" for c in s), lambda s: "".join(f"&#x{ord(c):x};" for c in s),
    lambda s: base64.b64encode(s.encode()).decode(), lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("="), lambda s: base64.b64encode(gzip.compress(s.encode())).decode(), lambda s: base64.b64encode(zlib.compress(s.encode())).decode(),
    lambda s: base64.b64encode(base64.b64encode(quote(s, safe="").encode())).decode(), lambda s: quote(base64.b64encode(gzip.compress(base64.b64encode(s.encode()))).decode(), safe=""),
])
def test_inner_layers(wrap):
    inner = wrap("é " + SECRET + " ü")
    text = f"some words {inner} and more"
    base, every = secrets.find_spans(text)
    assert base == _plain(text)
    found = [(a, b) for a, k, b in every if k == 0]
    assert found and all(11 <= a < b <= 11 + len(inner) for a, b in found)
    assert secrets.redacted(text, "#").startswith("some words ") and secrets.redacted(text, "#").endswith(" and more")
    assert "hunter2" not in secrets.redacted(text, "#")


def test_layer_places():
    text = "x " + quote(f"é {SECRET} z", safe="") + " y"
    (a, _, b), = [s for s in secrets.find_spans(text)[1] if s[1] == 0]
    assert text[a:b] == quote(SECRET[:-1], safe="")
    text = "q " + base64.b64encode(b"abc" + SECRET.encode() + b" tail").decode()
    (a, _, b), = [s for s in secrets.find_spans(text)[1] if s[1] == 0]
    assert base64.b64decode(text[a : a + (b - a) // 4 * 4]).decode().startswith("password")
    assert secrets.find_spans("%2525252541" * 50 + " %25" * 100)[1] == []  # ends


@pytest.mark.parametrize("wraps", [
    [lambda s: quote(s, safe="")] * 2, [lambda s: base64.b64encode(s.encode()).decode()] * 3, [lambda s: "".join(f"\\u{ord(c):04x}" for c in s)] * 2,
    [lambda s: base64.b64encode(gzip.compress(s.encode(), mtime=0)).decode()] * 2, [lambda s: quote(s, safe=""), lambda s: base64.b64encode(s.encode()).decode()],
    [lambda s: base64.b64encode(f"{quote(s, safe='')} {quote(s, safe='')}".encode()).decode()] * 2,
])
def test_secret_twice(wraps):
    runs = [w("é " + SECRET + " ü") for w in wraps]
    text = "one " + " two ".join(runs) + " three"
    at, spans = 0, [s for s in secrets.find_spans(text)[1] if s[1] == 0]
    for run in runs:
        at = text.index(run, at)
        assert any(at <= a < b <= at + len(run) for a, _, b in spans)
        at += len(run)
    out = secrets.redacted(text, "#")
    assert out.count("#") >= len(runs) and secrets.find_spans(out)[1] == []


def _b64(s):
    return base64.b64encode(s if isinstance(s, bytes) else s.encode()).decode()


LINES = "\n".join(re.findall(".{1,76}", _b64("some filling words " * 9 + SECRET + " more words" * 20)))
PACKED = gzip.compress((SECRET + "".join(map(str, range(200)))).encode(), mtime=0)


@pytest.mark.parametrize("text, part", [
    ("so password: %68unter2222 it is", "password: %68unter2222"), ('{"password": "\\u0068unter2222"}', 'password": "\\u0068unter2222'), ('{"api_key":"abc\\u003ddef"}', 'api_key":"abc\\u003ddef'),
    ("password %3D hunter2222", "password %3D hunter2222"), ("secret: token%3Ahunter2222", "token%3Ahunter2222"), ("token: passwd%3Ahunter2222", "passwd%3Ahunter2222"),
    ("name=Jos%E9&password%3Dhunter2222", "password%3Dhunter2222"), ("%00%1B%20password%3Dhunter2222", "password%3Dhunter2222"), ("q " + _b64(b"\xff\x00\x1b " + SECRET.encode()), None),
    (LINES, None), (LINES.replace("\n", "\r\n  "), None), ("> " + LINES.replace("\n", "\n> "), None), (LINES.replace("\n", "\\n"), None), ("\n".join(re.findall(".{1,64}", _b64(PACKED))), None),
    *[(f"https://example.com/{'a' * k}/{x}", None) for k in range(5) for x in (_b64(SECRET), _b64(PACKED))], ("da-ta_" + _b64("é " + SECRET), None), ("data:text/plain;base64," + _b64(SECRET), None),
    (_b64(gzip.compress(gzip.compress(zlib.compress(SECRET.encode())))), None), (_b64(b"abc\x00" + PACKED + b"tail"), None), (quote(PACKED), None), ("".join(f"\\x{c:02x}" for c in PACKED), None),
])
def test_whole_layers(text, part):
    got = {text[a:b] for a, k, b in secrets.find_spans(text)[1] if k == 0}
    assert part in got if part else got
    assert "hunter2" not in secrets.redacted(text, "#") and set(secrets.find_spans(text)[0]) <= set(secrets.find_spans(text)[1])
    assert not [s for s in secrets.find_spans(secrets.redacted(text, " # "))[1] if s[1] == 0]


def _filler(n):
    return np.random.default_rng(n).integers(0, 255, n, np.uint8).tobytes()


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress])
def test_large_packed_data(pack):
    large, blank = b" " * (17 << 20), b" " * (2 << 20)
    edge = b" " * (secrets.PIECE - 9)
    for data in (large + SECRET.encode(), SECRET.encode() + blank, edge + SECRET.encode() + blank, blank + quote(SECRET, safe="").encode() + b"\n" * 99, blank + _b64(PACKED).encode()):
        text = f"some {_b64(pack(data))} words"
        (a, _, b), = [s for s in secrets.find_spans(text)[1] if s[1] == 0]
        assert text[a:b] == text[5:-6].rstrip("=") and secrets.redacted(text, "#").rstrip("= words") == "some #"
    assert secrets.find_spans(f"some {_b64(pack(blank))} words")[1] == []


def test_large_packed_in_packed_data(monkeypatch):
    monkeypatch.setattr(secrets, "PIECE", 1 << 16)
    monkeypatch.setattr(secrets, "OVERLAP", 1 << 12)
    inner = _b64(gzip.compress(_filler(1 << 17) + b" " + SECRET.encode()))
    for run in (inner, "\n".join(re.findall(".{1,76}", inner)), "/aa/" + inner):
        text = "some " + _b64(gzip.compress(b"a line\n" * 30 + run.encode(), 1)) + " words"
        assert [s for s in secrets.find_spans(text)[1] if s[1] == 0]
    cut = _b64(gzip.compress(SECRET.encode() + _filler(1 << 16))[:-9000])
    assert [s for s in secrets.find_spans(cut)[1] if s[1] == 0]
    parts = gzip.compress(SECRET[:14].encode()) + gzip.compress(SECRET[14:].encode())
    assert [s for s in secrets.find_spans(_b64(parts))[1] if s[1] == 0] == [(0, 0, len(_b64(parts).rstrip("=")))]


def test_secrets_odd(odd, none):
    got = secrets.scan_secrets(odd).collect()
    assert len(got) == 9 and not any(r.all_spans for r in got)
    assert secrets.redact(odd).count() == 9 and secrets.scan_secrets(none).count() == 0


# Pipeline


@needs_tables
def test_pipeline(spark, docs, model):
    known = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()
    items = duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()
    kept = [(k, t) for k, t in known if t and any(c.isalpha() for c in t)]
    groups = {k: c for k, _, c in _groups(kept, 5, 80)}
    kept = [(k, t) for k, t in kept if groups[k] == k]
    bench = set()
    for (t,) in items:
        bench.update(w.decode() for w in decontaminate.windows(t, 10))

    def clean(t):
        lower = t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        joined = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)) + " "
        return not any(w in joined for w in bench)

    want = {}
    for k, t in kept:
        if clean(t):
            spans, out, at = secrets.find_spans(t)[1], [], 0
            for a, _, b in spans:
                if b > at:
                    out += ([t[at:a], "[SECRET]"] if a >= at else [])
                    at = b
            want[k] = model.library.encode("".join(out) + t[at:])
    got = {r.doc_id: (r.n_tokens, r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {k: (len(v), v) for k, v in want.items()}


def test_pipeline_odd(spark, odd, none, tmp_path):
    spark.createDataFrame([(1, "a test item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (odd.select(*DOCS.replace(" long", "").replace(" string", "").split(", ")), none):
        rows = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, str(tmp_path))
            assert rows.columns == table.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids"]
        rows.count()
