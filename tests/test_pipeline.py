import datetime as dt
import itertools
import json

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumeline.operators import discovery, summaries, views
from plumeline.operators.dedupe import dedupe
from plumeline.operators.normalize import canonical_articles
from plumeline.plans import pipeline as P
from plumeline.plans import queries
from plumeline.sources import documents as D
from plumeline.sources import registry as R
from plumeline.streaming import incremental

FEEDS = [
    {"id": "one", "name": "One", "category": "Tech / News", "feedUrl": "https://one.example/rss", "siteUrl": "https://one.example/", "language": "en", "enabled": True},
    {"id": "two", "name": "Two", "category": "Tech / News", "feedUrl": "https://two.example/atom", "siteUrl": "https://two.example/", "language": "ja", "enabled": True},
    {"id": "off", "name": "Off", "category": "Else", "feedUrl": "https://off.example/rss", "siteUrl": "https://off.example/", "language": "en", "enabled": False},
]
RSS = """<?xml version="1.0"?><rss version="2.0"><channel><item><title>  A first   piece </title>
<link>https://Example.com/story/?utm_medium=feed&amp;z=1&amp;b=2#top</link><description><![CDATA[<p>Some <b>bold</b> words.</p>]]></description>
<pubDate>Sat, 07 Mar 2026 09:00:00 +0900</pubDate><guid>g-1</guid><author>Ann</author><media:content url="https://img.example/1.png"/></item>
<item><title></title><link>https://example.com/untitled</link></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Second</title><link href="https://example.com/story?b=2&amp;z=1"/>
<id>tag:2</id><updated>2026-03-08T10:00:00Z</updated><summary>&lt;i&gt;A longer summary than before&lt;/i&gt; of it all</summary><author><name>Bob</name></author></entry></feed>"""
NOW = "2026-03-09T00:00:00.000Z"


def registry(spark, entries=FEEDS):
    return R.snake(spark.createDataFrame([tuple(e[f.name] for f in R.SCHEMA) for e in R.check_entries(entries)], R.SCHEMA))


def docs(spark, *rows):
    at = dt.datetime(2026, 3, 8, tzinfo=dt.UTC)
    return D.from_rows(spark, [(feed, xml, at, i) for i, (feed, xml) in enumerate(rows)])


def test_golden_rows(spark):
    rows = {r.feed_id: r for r in canonical_articles(docs(spark, ("one", RSS), ("two", ATOM)), registry(spark)).collect()}
    assert set(rows) == {"one", "two"}
    a, b = rows["one"], rows["two"]
    assert (a.title, a.url, a.summary, a.author, a.image_url, a.source_item_id) == ("A first piece", "https://Example.com/story/?utm_medium=feed&z=1&b=2#top", "Some bold words.", "Ann", "https://img.example/1.png", "g-1")
    assert a.published_at == dt.datetime(2026, 3, 7, 0, 0) and a.tags == [] and a.seen_in_feeds == ["one"]
    assert a.id == b.id and a.normalized_url == "https://example.com/story?b=2&z=1"
    assert (b.author, b.image_url, b.summary) == ("Bob", None, "A longer summary than before of it all")


def test_run_writes_and_dry_runs(spark, tmp_path):
    found = P.run(spark, registry(spark), docs(spark, ("one", RSS), ("two", ATOM)), NOW, str(tmp_path))
    assert (found["total_feeds"], found["enabled_feeds"], found["normalized_articles"], found["deduped_articles"], found["duplicates_collapsed"]) == (3, 2, 2, 1, 1)
    articles = json.loads((tmp_path / "articles.json").read_text())
    assert articles[0]["sourceId"] == "one" and articles[0]["summary"] == "A longer summary than before of it all" and articles[0]["sortAt"] == "2026-03-07T00:00:00.000Z"
    assert json.loads((tmp_path / "meta.json").read_text()) == {"generatedAt": NOW, "articleCount": 1, "sourceCount": 1, "categoryCount": 1}
    assert P.load_exports(spark, str(tmp_path))[0] == "ready"
    assert P.load_exports(spark, str(tmp_path / "none"))[0] == "missing-data"
    assert P.run(spark, registry(spark), docs(spark, ("one", RSS)), NOW)["dry_run"]


def test_update_keeps_going_and_refuses(spark):
    def fetch(url):
        if "two" in url:
            raise OSError("no route")
        return RSS

    found = P.update(spark, registry(spark), NOW, fetch=fetch)
    assert (found["attempted_feeds"], found["fetched_documents"], found["failed_feeds"], found["failed_ids"]) == (2, 1, 1, "two")
    assert found["failed_fetches"][0]["message"] == "no route"
    for entries, answer, reason in ((FEEDS, lambda u: " ", "no document"), (FEEDS[2:], lambda u: RSS, "no enabled")):
        with pytest.raises(D.PublishRefused, match=reason):
            P.update(spark, registry(spark, entries), NOW, fetch=answer)


@pytest.mark.parametrize("entries", [{}, ["x"], [FEEDS[0] | {"name": " "}], [FEEDS[0] | {"enabled": "true"}], [{k: v for k, v in FEEDS[0].items() if k != "language"}]])
def test_bad_registries(entries):
    with pytest.raises(R.RegistryError):
        R.check_entries(entries)


@pytest.mark.parametrize(("feed", "xml"), [("one", "  "), ("one", "<rdf/>"), ("ghost", RSS)])
def test_bad_documents_stop_the_run(spark, feed, xml):
    with pytest.raises(PySparkException):
        canonical_articles(docs(spark, (feed, xml)), registry(spark)).collect()


def test_category_collision(spark):
    entries = [FEEDS[0] | {"category": "C++"}, FEEDS[1] | {"category": "C#"}]
    with pytest.raises(P.CategoryCollision):
        P.run(spark, registry(spark, entries), docs(spark, ("one", RSS)), NOW)


def article(n, key="url:u", **more):
    base = {"doc_ord": n, "item_ord": 0, "id": f"i{n}", "feed_id": "f", "source_name": "s", "category": "c", "language": "en", "site_url": "x", "title": f"t{n}", "url": "u", "summary": None, "published_at": None,
            "fetched_at": dt.datetime(2026, 1, 1, 0, 0, n % 60), "author": None, "image_url": None, "tags": [], "source_item_id": None, "seen_in_feeds": [f"f{n}"], "normalized_url": "u", "dedupe_key": key}
    return base | more


ARTICLE = "doc_ord long, item_ord long, id string, feed_id string, source_name string, category string, language string, site_url string, title string, url string, summary string, published_at timestamp, fetched_at timestamp, author string, image_url string, tags array<string>, source_item_id string, seen_in_feeds array<string>, normalized_url string, dedupe_key string"


def fold(rows):
    """The ordered fold, step by step."""
    units = lambda text: len((text or "").encode("utf-16-le")) // 2
    score = lambda r: sum(bool(r[f]) for f in ("published_at", "author", "image_url", "summary")) + bool(r["tags"])
    acc = dict(rows[0])
    for b in rows[1:]:
        ka, kb = ((score(r), units(r["summary"])) for r in (acc, b))
        wins = ka > kb if ka != kb else acc["fetched_at"] <= b["fetched_at"]
        w, x = (acc, b) if wins else (b, acc)
        new = dict(w)
        for f in ("published_at", "author", "image_url", "source_item_id"):
            new[f] = w[f] or x[f]
        new["summary"] = x["summary"] if units(x["summary"]) > units(w["summary"]) else w["summary"] or x["summary"]
        new["fetched_at"] = min(acc["fetched_at"], b["fetched_at"])
        for f in ("tags", "seen_in_feeds"):
            new[f] = list(dict.fromkeys(v for v in w[f] + x[f] if v))
        acc = new
    return acc


def test_fold_depends_on_order_and_matches_the_model(spark):
    parts = [{"author": "A"}, {"image_url": "B"}, {"published_at": dt.datetime(2026, 2, 2), "image_url": "C"}, {"summary": "", "tags": ["", "x"]}]
    for order in itertools.permutations(range(4)):
        rows = [article(n, **parts[k], id=f"p{k}", fetched_at=dt.datetime(2026, 1, 1)) for n, k in enumerate(order)]
        got = dedupe(spark.createDataFrame(rows, ARTICLE)).collect()
        want = fold(rows)
        assert len(got) == 1 and got[0].merged == 4
        for f in ("id", "author", "image_url", "published_at", "tags", "seen_in_feeds"):
            assert getattr(got[0], f) == want[f], (order, f)


def test_rows_without_a_key_pass(spark):
    rows = [article(0, None), article(1, None), article(2), article(3)]
    assert dedupe(spark.createDataFrame(rows, ARTICLE)).count() == 3


def test_page_states(spark):
    public = summaries.public_articles(dedupe(canonical_articles(docs(spark, ("one", RSS)), registry(spark))))
    wanted = spark.createDataFrame([("",), ("one",), ("two",), ("nope",), (None,)], "wanted string")
    got = {r.wanted: r.state for r in views.page_state(wanted, registry(spark), public, "source_id").collect()}
    assert got == {"": "missing", None: "missing", "one": "ready", "two": "empty", "nope": "unknown"}


def test_search(spark):
    rows = [("1", "Spark tips", "Blog", ["data"], [], "2026"), ("2", "Other", "Spark weekly", [], ["tips"], "2026")]
    index = discovery.search_index(spark.createDataFrame(rows, "id string, title string, source_name string, source_tags array<string>, entry_tags array<string>, sort_at string"))
    got = {r.id: r.score for r in discovery.search(index, " SPARK  tips ").collect()}
    assert got["1"] > got["2"] > 0
    assert discovery.search(index, "  ").count() == 0 and discovery.search(index, "absent").count() == 0


def test_shelves_file():
    site, shelves = R.parse_shelves("site:\n  title: T\nshelves:\n  - id: it\n    title: 'IT'\n    description: d: e\n  - id: ai\n")
    assert site == {"title": "T"} and shelves == [{"id": "it", "title": "IT", "description": "d: e"}, {"id": "ai"}]
    with pytest.raises(R.RegistryError):
        R.parse_shelves("shelves\n")


def test_command_line_refuses(tmp_path):
    with pytest.raises(SystemExit):
        P.main(["--feeds"])
    with pytest.raises(SystemExit):
        P.main(["--feeds", "x", "--nope"])


def test_stream_folds_batches(spark, tmp_path):
    first, second = str(tmp_path / "in/a"), str(tmp_path / "in/b")
    docs(spark, ("one", RSS)).write.parquet(first)
    run = lambda: incremental.start(incremental.document_stream(spark, str(tmp_path / "in/*")), registry(spark), str(tmp_path / "state"), str(tmp_path / "ck")).awaitTermination()
    run()
    docs(spark, ("off", RSS.replace("piece", "other")), ("two", ATOM)).where(F.col("feed_id") == "two").write.parquet(second)
    run()
    state = incremental.read_state(spark, str(tmp_path / "state"), incremental.SCHEMA).collect()
    assert len(state) == 1 and sorted(state[0].seen_in_feeds) == ["one", "two"]


def entries(*numbers):
    return "<rss><channel>" + "".join(f"<item><title>t{n}</title><link>https://example.com/{n}</link><description>{'x' * n}</description></item>" for n in numbers) + "</channel></rss>"


def test_batches_rewrite_their_buckets_alone(spark, tmp_path):
    state, feeds = str(tmp_path / "state"), registry(spark)
    fold = lambda n, *rows: incremental.fold_batch(spark, state, docs(spark, *rows), n, feeds, 16)
    rows = lambda n=None: {r.url: (r.feed_id, tuple(r.seen_in_feeds), len(r.summary)) for r in incremental.read_state(spark, state, incremental.SCHEMA, n).collect()}
    first = fold(0, ("one", entries(*range(1, 60))))
    second = fold(1, ("two", entries(5, 70)))
    changed = {b for b in second if second[b] != first.get(b)}
    assert len(changed) <= 2 and set(second.values()) == {0, 1}
    whole = rows()
    assert len(whole) == 60 and whole["https://example.com/5"] == ("one", ("one", "two"), 5) and whole["https://example.com/70"][0] == "two"
    assert len(rows(0)) == 59  # what readers of the batch before still see
    assert fold(1, ("two", entries(5, 70))) == second and rows() == whole  # run again, as after a failure
    fold(2, ("one", entries(5)))
    fold(3, ("one", entries(80)))
    assert rows() == whole | {"https://example.com/80": ("one", ("one",), 80)}
    names = {p.name for p in (tmp_path / "state").iterdir() if not p.name.startswith(".")}
    assert {n for n in names if n.startswith("manifest")} == {"manifest-000000000002.json", "manifest-000000000003.json"}
    with pytest.raises(FileNotFoundError):
        fold(9, ("one", entries(1)))


def test_a_key_of_very_many_rows_folds_as_it_streams(spark):
    n = 300_000
    rows = spark.range(n).selectExpr(
        "id as doc_ord", "0L as item_ord", "concat('i', id) as id", "concat('f', id % 3) as feed_id", "'s' as source_name", "'c' as category", "'en' as language", "'x' as site_url", "concat('t', id) as title", "'u' as url",
        "if(id = 200000, 'the longest of all', 'short') as summary", "cast(null as timestamp) as published_at", "timestamp_seconds(1700000000 - id) as fetched_at", "if(id = 77, 'Ann', null) as author", "cast(null as string) as image_url",
        "array(concat('tag', id % 5)) as tags", "cast(null as string) as source_item_id", "array(concat('f', id % 3)) as seen_in_feeds", "'u' as normalized_url", "if(id < 299990, 'url:hot', concat('url:', id)) as dedupe_key",
    )
    found = dedupe(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Range (") == 1
    by_key = {r.dedupe_key: r for r in found.collect()}
    hot = by_key["url:hot"]
    assert len(by_key) == 11 and hot.merged == n - 10 and (hot.doc_ord, hot.author, hot.summary) == (0, "Ann", "the longest of all")
    assert sorted(hot.tags) == [f"tag{k}" for k in range(5)] and sorted(hot.seen_in_feeds) == ["f0", "f1", "f2"] and hot.fetched_at == dt.datetime.fromtimestamp(1700000000 - (n - 11), dt.UTC).replace(tzinfo=None)


def test_random_folds_match_the_model(spark):
    import random

    rng, rows, want = random.Random(4), [], {}
    for key in range(40):
        mine = []
        for k in range(rng.choice([1, 1, 2, 3, 9])):
            mine.append(article(len(rows) + k, f"url:{key}", author=rng.choice([None, "", "A", "B"]), image_url=rng.choice([None, "i"]), summary=rng.choice([None, "", "s", "lo\U0001f600ng", "longer"]), tags=rng.choice([[], ["x"], ["y", "", "x"]]),
                                published_at=rng.choice([None, dt.datetime(2026, 2, rng.randrange(1, 9))]), fetched_at=dt.datetime(2026, 1, 1, 0, rng.randrange(3)), source_item_id=rng.choice([None, "n"])))
        rows += mine
        want[f"url:{key}"] = (len(mine), fold([r | {"summary": r["summary"]} for r in mine]))
    got = {r.dedupe_key: r for r in dedupe(spark.createDataFrame(rng.sample(rows, len(rows)), ARTICLE)).collect()}
    assert got.keys() == want.keys()
    for key, (n, row) in want.items():
        assert got[key].merged == n
        for f in ("id", "fetched_at", "published_at", *(("tags", "seen_in_feeds", "summary", "author", "image_url") if n > 1 else ())):
            assert (getattr(got[key], f) or None) == (row[f] or None), (key, f)


def test_ranks_meet_nowhere(spark):
    import random

    from plumeline.operators.ranking import ranked, ranked_few

    rng = random.Random(1)
    rows = spark.createDataFrame([(f"i{n}", rng.randrange(5)) for n in range(500)], "id string, score long").repartition(7)
    order = (F.desc("score"), F.asc("id"))
    got = ranked(rows, *order)
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in ranked_few(rows, *order).collect()}
    assert ranked(rows.limit(0), *order).count() == 0


def test_postings_find_what_a_scan_finds(spark, tmp_path):
    import random

    from plumeline.operators import postings as PO

    rng = random.Random(2)
    words = ["spark", "tips", "été", "weekly", "straße", "data", "日本語", "a", "bc"]
    rows = [(str(n), " ".join(rng.choice(words) for _ in range(rng.randrange(6))), rng.choice(words), [rng.choice(words)], [], str(n)) for n in range(300)]
    index = discovery.search_index(spark.createDataFrame(rows, "id string, title string, source_name string, source_tags array<string>, entry_tags array<string>, sort_at string")).persist()
    PO.write(index, str(tmp_path / "postings"))
    postings, counts = PO.read(spark, str(tmp_path / "postings")), PO.read_sizes(spark, str(tmp_path / "postings"))
    texts = [r.search_text for r in index.collect()]
    queries = ["", "zz", "bc", "a bc", "nothere", "STRASSE", "日本語 tips"]
    for _ in range(25):
        text = rng.choice([t for t in texts if len(t) > 8])
        at = rng.randrange(len(text) - 4)
        queries.append(text[at : at + rng.randrange(2, 12)])
    for q in queries:
        want = {tuple(r) for r in discovery.search(index, q).collect()}
        assert {tuple(r) for r in PO.indexed_search(index, postings, counts, q).collect()} == want, q
    assert PO.candidates(postings, counts, "weekly straße").count() < 100
    assert PO.candidates(postings, counts, "bc") is None
    assert "PartitionFilters: [bucket" in PO._of(postings, ["wee", "eek"])._jdf.queryExecution().executedPlan().toString()


def test_tag_page_has_an_article_once(spark, tmp_path):
    """Rows 33, 66 and 132 have neither URL, item nor date, and one source and title, so one id; 99 is of another source."""
    rows = [(33, "The same title", "en", "src1"), (66, "The same title", "en", "src1"), (132, "The same title", "fr", "src1"), (99, "The same title", "en", "src2"), (5, "the same title", "en", "src1"), (165, "Another title", "en", "src1")]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    for name in ("nation", "region"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet/*.parquet'")
    got = sorted(tuple(r) for r in queries.QUERIES["tag_page"](spark, path).collect())
    assert len(got) == 3 and got == sorted(con.execute(queries.ORACLE_SQL["tag_page"]).fetchall())


def test_tag_page_by_either_tags(spark):
    rows = [("a", "1", ["Ｔech"], ["tech "]), ("b", "2", ["Other"], ["TECH"]), ("c", "3", [], []), ("d", "4", ["technical"], []), ("a", "1", [], ["tech"])]
    articles = spark.createDataFrame(rows, "id string, sort_at string, source_tags array<string>, entry_tags array<string>")
    assert sorted(tuple(r) for r in discovery.tag_page(articles, "tech").collect()) == [("a", "1"), ("b", "2")]
