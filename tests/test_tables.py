import csv
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from pagemill.catalog import source_queries
from pagemill.operators import constraints as K
from pagemill.operators.joins import numbered
from pagemill.operators.links import resolve_redirects
from pagemill.plans import content as C, qa, seo, tracking
from pagemill.sources import framed, loads, readers, sinks, stores
from pagemill.streaming import jobs

L = F.lit


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(' title , body \nA,"x, y"\n , \nB,"two\nlines"\nC,d,extra\n')
    records, errors = readers.read_csv(spark, str(tmp_path))
    assert records.columns == ["title", "body"]
    assert sorted((r["title"], r["body"]) for r in records.collect()) == [("A", "x, y"), ("B", "two\nlines"), ("C", "d")]
    assert errors.count() == 1
    indexed = readers.with_index(records)
    assert sorted(r["source_index"] for r in indexed.collect()) == [0, 1, 2]


def test_csv_with_several_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("b,a\n9,8\n")
    (tmp_path / "c.csv").write_text('"c ""x""",a\n5,6\n')
    (tmp_path / "d.csv").write_text("a,b\n3,4\n")
    records, errors = readers.read_csv(spark, str(tmp_path))
    got = {(r["a"], r["b"], r['c "x"']) for r in records.collect()}
    assert got == {("1", "2", None), ("8", "9", None), ("6", None, "5"), ("3", "4", None)} and errors.count() == 0


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_csv_cut_by_many_tasks(spark, tmp_path, small_splits):
    """Random cells with quotes and line breaks, LF and CRLF, a path with blanks, several headers: as the standard reader has them."""
    rng, want = random.Random(5), {}
    (tmp_path / "a b").mkdir()
    for f, columns in enumerate((["id", "x", "long name"], ["id", "x", "long name"], ["x", "id"])):
        rows = []
        for i in range(60):
            cell = "".join(rng.choice(["a", "b", ",", '"', "\n", " ", '"\n"', "é", '""', ' ,"']) for _ in range(rng.randint(0, 30)))
            rows.append({"id": f"{f}-{i}", "x": cell, "long name": rng.choice(["", "q", "a\r\nb"])})
            want[f"{f}-{i}"] = (cell or None, (rows[-1]["long name"] or None) if f < 2 else None)
        with open(tmp_path / "a b" / f"x {f}.csv", "w", newline="") as file:
            file.write("\n \n" if f == 0 else "")
            out = csv.writer(file, lineterminator="\r\n" if f == 1 else "\n")
            out.writerow(columns)
            out.writerows([[r[c] for c in columns] for r in rows])
    assert spark.read.text(str(tmp_path / "a b")).rdd.getNumPartitions() > 9
    records, errors = readers.read_csv(spark, str(tmp_path / "a b"))
    assert {r["id"]: (r["x"], r["long name"]) for r in records.collect()} == want and errors.count() == 0


def test_csv_row_errors(spark, tmp_path, small_splits):
    (tmp_path / "e.csv").write_text('a,b\n1,2\n\n3\n4,5,6\n5" x,y\n7,"8\nrest,1\n' + "z,y\n" * 200)
    records, errors = readers.read_csv(spark, str(tmp_path / "e.csv"))
    assert sorted(tuple(r) for r in records.collect()) == [("1", "2"), ("3", None), ("4", "5"), ('5" x', "y")]
    found = errors.select("row", "message").distinct().collect()
    assert sorted(map(tuple, found)) == [(3, "Row does not match the header"), (4, "Row does not match the header"), (6, "Quoted field unterminated")]


@pytest.mark.parametrize("kind", ["array", "spread", "lines"])
def test_json_cut_by_many_tasks(spark, tmp_path, small_splits, kind):
    rng, entries = random.Random(6), []
    for i in range(80):
        s = "".join(rng.choice(["a", "{", "}", "[", "]", '"', "\\", ",", " ", "\n", "é"]) for _ in range(rng.randint(0, 20)))
        entries.append({"i": i, "s": s, "o": {"k": [{"z": s}, i]}})
        if kind != "lines" and rng.random() < 0.3:
            entries.append(rng.choice([5, "x}", [1, {"q": 1}], None]))
    text = "\n".join(map(json.dumps, entries)) if kind == "lines" else json.dumps(entries, indent=1 if kind == "spread" else None)
    (tmp_path / "j.json").write_text(text)
    items, errors = readers.json_entries(spark, str(tmp_path / "j.json"))
    assert sorted((json.loads(r["item"]) for r in items.collect()), key=lambda x: x["i"]) == [x for x in entries if isinstance(x, dict)]
    assert sorted(r["row"] for r in errors.collect()) == [i + 1 for i, x in enumerate(entries) if not isinstance(x, dict)]


@pytest.mark.parametrize("text, items, messages", [
    ("{}", 1, []), ("[]", 0, []), ("", 0, []), ("  [ ]  ", 0, []), ("5", 0, ["JSON must be an array of objects or an object"]),
    ("{oops", 0, ["Invalid JSON"]), ('[{"a":1},', 1, ["Invalid JSON"])])
def test_json_odd(spark, tmp_path, text, items, messages):
    (tmp_path / "k.json").write_text(text)
    found, errors = readers.json_entries(spark, str(tmp_path / "k.json"))
    assert found.count() == items and [r["message"] for r in errors.collect()] == messages


def test_audit_of_two_operations(spark):
    df = spark.createDataFrame([(1, "a b", "a"), (2, "z", "b")], "id int, t string, u string")
    one = K.search_replace(df, "t", "id", ["t", "u"], "a", "b", L(1))
    after = K.apply_audit(df, one, "id", ["t", "u"])
    both = one.unionByName(K.search_replace(after, "t", "id", ["t", "u"], "b", "c", L(2)))
    assert {tuple(r) for r in K.apply_audit(df, both, "id", ["t", "u"]).collect()} == {(1, "c c", "c"), (2, "z", "c")}


def test_patterns_are_checked_as_they_run(spark):
    from pagemill.operators.rules import valid_pattern

    assert valid_pattern(r"(?<n>x)+\k<n>") and valid_pattern("a|b") and not valid_pattern("(?P<n>x)") and not valid_pattern("(") and not valid_pattern("")


def test_json(spark, tmp_path):
    doc = {"data": {"rows": [{"a": {"b": 1}, "c": [1, 2]}, 5, {"a": {"b": 2}}]}}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    records, errors = readers.read_json(spark, str(tmp_path), "data.rows")
    assert records.columns == ["a.b", "c"]
    assert sorted(r["a.b"] for r in records.collect()) == [1, 2]
    assert [(r["row"], r["message"]) for r in errors.collect()] == [(2, "Row 2 is not an object")]
    bad = spark.createDataFrame([("{oops",)], "t string")
    assert readers.json_items(bad, "t")[1].first()["message"] == "Invalid JSON"


def test_recipe_store(spark, tmp_path):
    store = stores.RecipeStore(spark, str(tmp_path / "r"))
    store.create(spark.createDataFrame([("a", "one", "post", 0.8), ("b", "two", "post", 0.8)], "id string, name string, template_type string, confidence_threshold double"))
    store.update("a", name=L("uno"))
    store.delete("b")
    rows = store.list("post").collect()
    assert [(r["id"], r["name"], r["version"]) for r in rows] == [("a", "uno", 2)]
    store.touch("a")
    assert store.load("a").first()["last_used_at"] is not None


def test_session_store(spark, tmp_path):
    store = stores.SessionStore(spark, str(tmp_path / "s"))
    assert store.list_active().count() == 0
    store.create(spark.createDataFrame([("s1", "post", "csv"), ("s2", "post", "csv")], "id string, template_type string, source_type string"))
    store.save("s1", current_step=L("review"), approved_count=L(3))
    store.complete("s2")
    got = store.list_active().collect()
    assert [(r["id"], r["current_step"], r["approved_count"]) for r in got] == [("s1", "review", 3)]
    there = stores.to_session_fields(store.load("s1"))
    assert "currentStep" in there.columns and stores.to_session_columns(there).columns == store.load("s1").columns


def test_preset_store(spark, tmp_path):
    store = stores.PresetStore(spark, str(tmp_path / "p"))
    store.insert(spark.createDataFrame([("p1", "x", "post", "{}")], "id string, name string, template_type string, mapping_json string"))
    assert store.list("post").count() == 1
    store.delete("p1")
    assert store.list().count() == 0


def test_sinks(spark, tmp_path):
    issues = spark.createDataFrame([("/a", "seo", "m")], "url string, type string, message string")
    sinks.write_issues(issues, str(tmp_path / "i"))
    assert spark.read.json(str(tmp_path / "i")).first()["message"] == "m"
    sinks.write_urls(issues.select("url"), str(tmp_path / "u"))
    assert spark.read.text(str(tmp_path / "u")).first()["value"] == "/a"
    entries = spark.createDataFrame([("/%03d" % i, "<%d>" % i) for i in range(25)], "sort_key string, entry string")
    files = sinks.sitemap_files(entries, per_file=10).orderBy("file_no").collect()
    assert len(files) == 3 and files[0]["xml"].startswith('<?xml version="1.0"') and "<0>\n<1>" in files[0]["xml"] and "<24>" in files[2]["xml"]
    index = sinks.sitemap_index({"pages": sinks.sitemap_files(entries, per_file=10), "posts": sinks.sitemap_files(entries.limit(0))}, "https://e.com/", "2024-01-01").first()["xml"]
    assert [m for m in re.findall("<loc>(.*?)</loc>", index)] == [f"https://e.com/sitemap-pages{n}.xml" for n in ("", "-2", "-3")]


def test_numbered_with_a_hot_key(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 2).cast("string")).alias("k"))
    got = numbered(df, "k", "id", "n").collect()
    for k in ("hot", "0", "1"):
        assert [r["n"] for r in sorted(got, key=lambda r: r["id"]) if r["k"] == k] == list(range(1, sum(r["k"] == k for r in got) + 1))


def test_redirects(spark):
    df = spark.createDataFrame([("/a", "/b", True), ("/b", "/c", True), ("/x", "/y", True), ("/y", "/x", True), ("/off", "/z", False)], "from_path string, to_path string, enabled boolean")
    got = {r["from_path"]: (r["to_path"], r["hops"], r["is_cycle"]) for r in resolve_redirects(df).collect()}
    assert got["/a"] == ("/c", 2, False) and got["/b"] == ("/c", 1, False) and got["/x"] == ("/y", 1, True) and "/off" not in got
    long = spark.createDataFrame([(f"/{i}", f"/{i + 1}", True) for i in range(100)] + [("/in", "/x", True), ("/x", "/y", True), ("/y", "/x", True)], "from_path string, to_path string, enabled boolean")
    got = {r["from_path"]: (r["to_path"], r["hops"], r["is_cycle"]) for r in resolve_redirects(long).collect()}
    assert all(got[f"/{i}"] == ("/100", 100 - i, False) for i in range(100)) and got["/in"] == ("/x", 1, True) and len(got) == 103


def test_assign_ids(spark):
    got = K.assign_ids(spark.createDataFrame([(7,)], "n int"), spark.range(50).select(F.col("id").alias("k")), "n", "k").orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(8, 58))


def test_scan(spark):
    page = (
        '<html><head><title> </title><link rel="canonical" href="https://other.org/x"><meta name="robots" content="NOINDEX"></head><body><h1>a</h1><h1>b</h1>'
        '<img src="/i.png"><a href="tel:512-555-0100">c</a> call 512 555 0199 lorem ipsum <a href="/gone">g</a> recieve</body></html>'
    )
    crawl = spark.createDataFrame([("https://e.com/", 200, page), ("https://e.com/gone", 404, "<p>" + "x " * 40 + "</p>")], "url string, status int, html string")
    words = spark.createDataFrame([("recieve", "receive"), ("call", "cal")], "word string, correction string")
    allowed = spark.createDataFrame([("call",)], "word string")
    got = {(r["url"], r["message"]) for r in qa.scan(crawl, "https://e.com", "e.com", words, allowed).collect()}
    home = {m for u, m in got if u == "https://e.com/"}
    assert home == {
        "Missing page title", "Missing meta description", "Canonical domain mismatch: other.org does not match expected domain e.com", "Page contains noindex",
        "Missing og:title", "Missing og:description", "Missing og:image", "Multiple H1 tags found (2)", 'Found "Lorem Ipsum" text', "Image missing alt text: /i.png",
        "Visible phone number text may not match tel: link number. tel: 5125550100 visible: 5125550199", "Broken internal link: /gone returned 404",
        'Possible misspelling: "recieve" (did you mean "receive"?)',
    }
    assert ("https://e.com/gone", "Page returned status 404") in got


def test_json_ld(spark):
    content = json.dumps({"faq": {"items": [{"question": "<b>Q?</b>", "answer": "<p>A</p>"}, {"question": "", "answer": "x"}]}})
    routes = spark.createDataFrame(
        [("/a", "T", "https://e.com/a", "LocalBusiness", content, "page", '{"name":"Own"}'), ("/b", "P", "https://e.com/b", None, None, "post", None)],
        "path string, title string, url string, schema_type string, content string, route_type string, schema_data string",
    )
    settings = {"siteName": "S", "phoneNumber": "1", "addressLine1": "1 Main", "addressLine2": "Austin, TX 78701", "globalSchema": '[{"@type":"Org"}, 3]'}
    got = [(r["path"], json.loads(r["schema"])) for r in seo.json_ld(routes, settings, "path").orderBy("path", "schema_no").collect()]
    assert [(p, d["@type"]) for p, d in got] == [("/a", "LocalBusiness"), ("/a", "FAQPage"), ("/a", "Org"), ("/b", "Article"), ("/b", "Org")]
    assert got[0][1]["name"] == "Own" and got[0][1]["address"]["addressLocality"] == "Austin" and got[0][1]["address"]["addressRegion"] == "TX"
    assert got[1][1]["mainEntity"][0]["name"] == "Q?" and len(got[1][1]["mainEntity"]) == 1
    assert got[3][1]["mainEntityOfPage"]["@id"] == "https://e.com/b"


def test_faq_items_cascade(ev):
    def items(doc):
        return [p["question"] for p in ev(seo.faq_items(L(json.dumps(doc))))]

    pair = {"question": "q", "answer": "a"}
    assert items({"faq": {"enabled": False, "items": [pair]}, "faqs": [pair]}) == ["q"]
    assert items({"other": [pair, pair]}) == ["q", "q"]
    assert items({"other": [pair, 3]}) == []


def test_shared_sections(spark):
    pages = spark.createDataFrame(
        [("/about/", '{"cta":{"t":1}}', "published"), ("/contact/", '{"cta":{"t":0},"hero":{}}', "published"), ("/x/", '{"cta":{"t":0}}', "published")],
        "url_path string, content string, status string",
    )
    got = {r["url_path"]: json.loads(r["content"]) for r in C.lay_shared_sections(pages, C.shared_sections(pages)).collect()}
    assert got["/contact/"]["cta"] == {"t": 1} and got["/contact/"]["hero"] == {} and got["/x/"]["cta"] == {"t": 0}


def test_phone_rewrite(ev):
    raw = '<a href="tel:5125550100">512-555-0100</a> (512) 555-0100'
    assert ev(tracking.rewrite_page(L(raw), L("5125550100"), L("7375550199"))) == '<a href="tel:7375550199">737-555-0199</a> 737-555-0199'


def test_phone_mapping_prefers_known_original(spark):
    counts = spark.createDataFrame([(1, "111", 2, 0, 0, None), (1, "222", 1, 5, 1, 0)], "p int, digits string, in_links int, in_text int, first_link int, first_text int")
    known = spark.createDataFrame([(1, ["111"], "")], "p int, originals array<string>, last_swapped string")
    assert tuple(tracking.phone_mapping(counts, "p", known).first()) == (1, "111", "222")
    assert tuple(tracking.phone_mapping(counts, "p").first()) == (1, "222", "111")


def _stream(spark, folder, schema, frames):
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_a_file_is_cut_into_small_pieces(spark, tmp_path):
    """Pieces hold a bounded number of lines however much one task reads, and records that cross their edges stay whole."""
    rows = [(f"k{i}", "\n".join(f'line {j} "of", {i}' for j in range(i % 7))) for i in range(4000)]
    with open(tmp_path / "a.csv", "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([("key", "text"), *rows])
    units = framed.read_units(spark, str(tmp_path / "a.csv"), "\n")
    sizes = [r["count"] for r in units.groupBy(*framed.PIECE).count().collect()]
    assert len(sizes) > 1 and max(sizes) <= 1 << framed.PIECE_BITS and sum(sizes) == units.count()
    records, errors = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert sorted((r["key"], r["text"] or "") for r in records.collect()) == sorted(rows) and errors.isEmpty()


def test_json_arrays_as_one_list(spark, tmp_path):
    for i, text in enumerate(('[{"a":1},5,{"a":2}]', '[7,{"a":3}]', '[{"a":4},{"a":"}"},8]')):
        (tmp_path / f"part={i:03d}.json").write_text(text)
    items, errors = readers.json_entries(spark, str(tmp_path), one_list=True)
    assert items.count() == 5
    assert sorted(r["row"] for r in errors.collect()) == [2, 4, 8]
    assert sorted(r["row"] for r in readers.json_entries(spark, str(tmp_path))[1].collect()) == [1, 2, 3]


def test_json_array_errors_write_many_files(spark, tmp_path, monkeypatch):
    """The given table is written by many tasks, and its rows are numbered through all files."""
    monkeypatch.setattr(source_queries, "_FILE_ROWS", 10)
    d = spark.range(45).select(F.col("id").alias("doc_id"), F.concat(L("t{"), "id").alias("text"))
    d.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(source_queries, "_folder", lambda *_: f"{tmp_path}/out")
    got = sorted(int(r["message"].split()[1]) for r in source_queries.json_array_errors(spark, str(tmp_path)).collect())
    # Entries are the rows and, behind every third from the first, a number.
    assert got == [n + n // 3 + 2 for n in range(0, 45, 3)]
    assert spark.read.text(f"{tmp_path}/out").select("part").distinct().count() == 5


def test_streaming_import(spark, tmp_path):
    folder = str(tmp_path / "in")
    stream = _stream(spark, folder, "i int, slug string, title string", [[(1, "a", "A"), (2, "b", "B")], [(3, "a", "A2"), (4, "c", "C")]])
    where = {n: str(tmp_path / n) for n in ("target", "jobs", "items", "ck")}
    q = jobs.import_batches(stream, lambda d: d, where["target"], where["jobs"], where["items"], where["ck"], "slug", "i", "upsert", "post").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = {r["slug"]: r["title"] for r in jobs.loaded_rows(spark, where["target"], "slug").collect()}
    assert set(rows) == {"a", "b", "c"}
    done = spark.read.parquet(where["jobs"]).agg(F.sum("created_count"), F.sum("updated_count")).first()
    assert tuple(done) == (3, 1)


def test_import_retries_and_keeps_failed_rows(spark, tmp_path):
    """A sink that fails once is tried again; one that fails for a batch leaves its rows as failed, and later batches go on."""
    schema = "i int, slug string, title string"
    stream = _stream(spark, str(tmp_path / "in"), schema, [[(1, "a", "A")], [(2, "b", "B"), (3, "a", "A2")], [(4, "c", "C"), (5, "a", "A3")]])
    where = {n: str(tmp_path / n) for n in ("target", "jobs", "items", "ck")}
    tries, told = [], []

    def write(rows, path):
        batch = int(path.rsplit("=", 1)[1])
        tries.append(batch)
        if batch == 0 and tries.count(0) == 1 or batch == 1:
            raise OSError(f"no room for batch {batch}")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(path)

    query = jobs.import_batches(stream, lambda d: d, where["target"], where["jobs"], where["items"], where["ck"], "slug", "i", "upsert", "post", write=write, progress=told.append, compact_every=2)
    query.trigger(availableNow=True).start().awaitTermination(120)
    assert tries == [0, 0, 1, 1, 2]
    assert {r["slug"]: r["title"] for r in jobs.loaded_rows(spark, where["target"], "slug").collect()} == {"a": "A3", "c": "C"}
    assert [(t["batch_id"], t["created_count"], t["updated_count"], t["failed_count"]) for t in told] == [(0, 1, 0, 0), (1, 0, 0, 2), (2, 1, 1, 0)]
    lost = spark.read.parquet(where["items"]).where("status = 'failed'").collect()
    assert {r["slug"] for r in lost} == {"a", "b"} and {r["error_message"] for r in lost} == {"no room for batch 1"}
    assert {r["title"] for r in spark.read.parquet(where["target"] + "_failed").collect()} == {"B", "A2"}


def test_import_of_batches_without_rows(spark, tmp_path):
    """Batches without rows, also the first and those before a snapshot, leave folders without files; later rows are loaded all the same."""
    stream = _stream(spark, str(tmp_path / "in"), "i int, slug string, title string", [[], [], [], [(1, "a", "A"), (2, "b", "B")], [], [(3, "a", "A2")]])
    where = {n: str(tmp_path / n) for n in ("target", "jobs", "items", "ck")}
    told = []
    query = jobs.import_batches(stream, lambda d: d, where["target"], where["jobs"], where["items"], where["ck"], "slug", "i", "upsert", "post", progress=told.append, compact_every=2)
    query.trigger(availableNow=True).start().awaitTermination(120)
    assert {r["slug"]: r["title"] for r in jobs.loaded_rows(spark, where["target"], "slug").collect()} == {"a": "A2", "b": "B"}
    assert [(t["total_records"], t["created_count"], t["updated_count"], t["failed_count"]) for t in told] == [(0, 0, 0, 0)] * 3 + [(2, 2, 0, 0), (0, 0, 0, 0), (1, 0, 1, 0)]


def test_snapshots_hold_the_newest_rows(spark, tmp_path):
    """Reading through snapshots gives what reading all deltas gives, also for a batch that is repeated."""
    target = str(tmp_path / "t")
    for batch in range(5):
        rows = [(f"k{i}", f"{batch}", i % 3) for i in range(batch, 9)]
        spark.createDataFrame(rows, "slug string, title string, bucket int").write.partitionBy("bucket").parquet(f"{target}/deltas/batch_id={batch}")
    want = {f"k{i}": str(min(i, 4)) for i in range(9)}
    assert {r["slug"]: r["title"] for r in jobs.loaded_rows(spark, target, "slug").collect()} == want
    for before in (2, 4, 4):
        jobs.compact(spark, target, "slug", before)
    assert {r["slug"]: r["title"] for r in jobs.loaded_rows(spark, target, "slug").collect()} == want
    assert {r["slug"]: r["title"] for r in jobs.loaded_rows(spark, target, "slug", 2).collect()} == {f"k{i}": str(min(i, 1)) for i in range(9)}


def test_throttle_and_first_touch_as_folds(spark):
    from datetime import datetime, timedelta

    rng, t0 = random.Random(9), datetime(2024, 1, 1)
    rows, want = [], []
    for key in ("x", "y"):
        at, last = 0, None
        for _ in range(200):
            at += rng.choice([1, 100, 250, 499, 500, 501, 2000])
            rows.append((key, f"/{at}", t0 + timedelta(milliseconds=at)))
            if last is None or at - last >= 500:
                last = at
                want.append((key, t0 + timedelta(milliseconds=at)))
    df = spark.createDataFrame(rows, "s string, url string, at timestamp")
    assert sorted(map(tuple, jobs.throttled(df, "s", "at").collect())) == sorted(want)
    touches = spark.createDataFrame([("x", " ", t0), ("x", "/b", t0 + timedelta(minutes=1)), ("x", "/a", t0 + timedelta(minutes=1)), ("x", "/c", t0 + timedelta(hours=2))], df.schema)
    assert sorted(r["landing_page"] for r in jobs.first_touches(touches, "s", "url", "at").collect()) == ["/a", "/c"]


def test_repeated_redirects(spark):
    rules = spark.createDataFrame([(f"/{i}", f"/{i + 1}", True) for i in range(40)] * 2 + [("/0", "/9", True), ("/0", "/0a", False)], "from_path string, to_path string, enabled boolean")
    got = {r["from_path"]: (r["to_path"], r["hops"]) for r in resolve_redirects(rules).collect()}
    assert len(got) == 40 and resolve_redirects(rules).count() == 40 and got["/0"] == ("/40", 40)


def _collect(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def test_streaming_first_touch_and_throttle(spark, tmp_path):
    schema = "s string, url string, at timestamp"
    rows = [[("x", "/one", "2024-01-01 00:00:00.000"), ("y", "/two", "2024-01-01 00:00:00.200")], [("x", "/three", "2024-01-01 00:00:00.300"), ("x", "/f", "2024-01-01 00:00:00.600")]]
    from datetime import datetime

    rows = [[(s, u, datetime.fromisoformat(t)) for s, u, t in batch] for batch in rows]
    touched = _collect(jobs.first_touch_stream(_stream(spark, str(tmp_path / "a"), schema, rows), "s", "url", "at"), "touch")
    assert sorted(r["session"] for r in touched) == ["x", "y"]
    one = _stream(spark, str(tmp_path / "b"), schema, [sum(rows, [])])
    emitted = _collect(jobs.throttled_stream(one, "s", "at"), "thr")
    assert sorted((r["key"], r["emitted_ms"] % 1000) for r in emitted) == [("x", 0), ("x", 600), ("y", 200)]


def test_streaming_dedupe_and_debounce(spark, tmp_path):
    from datetime import datetime

    schema = "id int, body string, at timestamp"
    t0 = datetime(2024, 1, 1)
    rows = [[(1, "<p>Same words, more than twenty letters</p>", t0)], [(2, "same WORDS! more than twenty letters", t0), (3, "other", t0), (4, "other", t0), (5, None, t0), (6, None, t0)]]
    fresh = _collect(jobs.fresh_records(_stream(spark, str(tmp_path / "a"), schema, rows), "body", "at", "id"), "fresh")
    assert sorted(r["id"] for r in fresh) == [1, 3, 4, 5, 6]
    batch = spark.createDataFrame(sum(rows, [])[::-1], schema)
    assert sorted(r["id"] for r in jobs.fresh_records(batch, "body", "at", "id").collect()) == [1, 3, 4, 5, 6]
    saves = spark.createDataFrame([(1, "a", t0), (1, "b", t0.replace(microsecond=500000)), (1, "c", t0.replace(second=5))], schema)
    got = jobs.debounced(saves, "id", "at", F.col("body")).orderBy("first_change").collect()
    assert [(r["state"], r["changes"]) for r in got] == [("b", 2), ("c", 1)]
    assert jobs.live_counters(saves, "body").count() == 3
    from pyspark.sql import Observation

    jobs.observed(saves.withColumn("status", L("auto_approved")), "m", "status").count()
    assert Observation is not None


def test_load_modes(spark):
    target = spark.createDataFrame([("a", "old")], "slug string, title string")
    batch = spark.createDataFrame([(0, "a", "new"), (1, "b", "first"), (2, "b", "second"), (3, None, "x")], "i int, slug string, title string")

    def run(mode):
        return {r["row_index"]: r["status"] for r in loads.load_outcomes(target, batch, "slug", "i", mode).collect()}

    assert run("create") == {0: "failed", 1: "created", 2: "failed", 3: "failed"}
    assert run("skip_duplicates") == {0: "skipped", 1: "created", 2: "skipped", 3: "failed"}
    assert run("upsert") == {0: "updated", 1: "created", 2: "updated", 3: "failed"}
    assert run("update") == {0: "updated", 1: "failed", 2: "failed", 3: "failed"}
    done = loads.load_outcomes(target, batch, "slug", "i", "upsert")
    assert {r["slug"]: r["title"] for r in loads.load_target(target, batch, done, "slug", "i").collect()} == {"a": "new", "b": "second"}
