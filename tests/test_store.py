"""Operators that SQL on the driver's tables cannot show whole: small fixtures with odd rows."""

import numpy as np
from pyspark.sql import functions as F

from pressloom.functions import text
from pressloom.operators import crawl, dedup, pages, review, search, select, stories
from pressloom.plans import story_plans
from pressloom.sources import snapshots

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_the_first_row_of_a_new_key_comes_in(spark):
    table = spark.createDataFrame([(1, "old")], "k int, v string")
    new = spark.createDataFrame([(1, "x"), (2, "b"), (2, "a"), (None, "n"), (3, None)], "k int, v string")
    assert rows_of(dedup.inserted(table, new, "k", ["v"])) == [(1, "old"), (2, "a"), (3, None)]
    assert rows_of(dedup.inserted(table.limit(0), new.limit(0), "k", ["v"])) == []


def test_titles_of_null_sources_and_ids_stay(spark):
    items = spark.createDataFrame([(1, None, "a rather long title"), (2, None, "A rather long title!"), (None, "s", "another long title"), (3, "s", None), (4, "s", "")], "id long, slug string, title string")
    assert sorted(r.id or 0 for r in dedup.first_titles(items).collect()) == [0, 1, 3, 4]


def test_keyed_updates_set_nulls_and_unknown_keys_change_nothing(spark):
    table = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    changes = spark.createDataFrame([(1, None), (9, "z")], "k int, v string")
    assert rows_of(dedup.updated(table, changes, "k")) == [(1, None, "x"), (2, "b", "y")]


def test_highlights_of_any_characters(spark):
    rows = spark.createDataFrame([("C++ and a(b [x] \\\\ end", )], "t string")
    shown = lambda q: rows.select(search.highlighted("t", q).alias("s")).first().s
    assert shown("") == rows.first().t and shown("  ") == rows.first().t
    assert shown("c++ a(b") == "<em>C++</em> and <em>a(b</em> [x] \\\\ end"
    assert shown("nd") == rows.first().t and shown("[x] and") == "C++ <em>and</em> a(b <em>[x]</em> \\\\ end"


def test_contexts_stop_at_the_first_part_that_does_not_fit(spark):
    hits = spark.createDataFrame([("a", 1, "x" * 50), ("a", 2, "y" * 60), ("a", 3, "z"), ("b", 1, "w" * 200)], "k string, r int, part string")
    assert [(r.k, r.r) for r in search.context(hits, "r", "part", ["k"], most=100).collect()] == [("a", 1)]


def test_run_outcomes_by_precedence(spark):
    schema = "slug string, url string, title string, content string, error string, published_at string, seq int"
    long, t = "x" * 100, "a long enough title"
    tried = [
        ("s", "u1", t, long, None, "2024", 1), ("s", "u1", "another long title", long, None, "2024", 2), ("s", "u2", "Another long title", long, None, "2024", 3),
        ("s", "u3", t.upper(), long, None, "2024", 4), ("s", "u4", "other title here", long, "404", None, 5), ("s", "u5", t, "short", None, "2024", 6),
        ("s", "u6", t, long, None, None, 7), ("s", "known", "fresh title here", long, None, "2024", 8), (None, "u7", t, long, None, "2024", 9), ("s", "u8", "tiny", long, None, "2024", 10), ("s", "u9", "tiny", long, None, "2024", 11),
    ]
    known = spark.createDataFrame([("s", "known", "k")], "slug string, url string, title string")
    found = {r.seq: r.outcome for r in dedup.outcomes(spark.createDataFrame(tried, schema), known).collect()}
    assert found == {1: "inserted", 2: "skipped_duplicate", 3: "inserted", 4: "skipped_duplicate", 5: "dead_link", 6: "failed", 7: "skipped_no_date", 8: "skipped_duplicate", 9: "inserted", 10: "inserted", 11: "inserted"}


def test_error_classes_and_excerpts(spark):
    lines = "By Ann Writer, who is known to all of our readers\n# heading that is long enough to be taken as such\nThis line is the first that says something, at last."
    assert spark.createDataFrame([(lines,)], "t string").select(text.excerpt(F.col("t")).alias("e")).first().e == lines.split("\n")[2]


def test_pages_in_full(spark):
    html = """<html><head><meta property="og:title" content="OG"><meta name="author" content="by Ann 1-2-2024"><meta property="article:published_time" content="2024-01-05T10:00:00Z">
<meta property="og:image" content="https://i.example/1.png"></head><body><div class="menu">menu words</div><div class="story-body"><p>""" + "word " * 60 + """</p><div class="share">share it</div></div>
<a href="/news/2024/01/first-story-here">The first story here #1</a><a href="https://h.example/news/2024/01/first-story-here#top">The first story, again</a><a href="/category/x/y/z">A list of all categories</a>
<a href="/news/a/b.pdf">A document to download</a><a href="https://other.example/a/b/c">Another host's long story</a><a href="/short/one/two">short</a><a href="/one">Only one segment here</a><a href="/n/m/o?x=1">read more about all this</a></body></html>"""
    page = spark.createDataFrame([(1, "https://h.example/page", html), (2, "https://h.example/2012/03/04/x", "<p>tiny"), (3, None, None), (4, "u", "")], "page_id long, url string, html string")
    found = {r.page_id: r for r in pages.extracted(page).withColumn("at", F.unix_seconds("published_at")).collect()}
    assert (found[1].title, found[1].author, found[1].at, found[1].image_url, found[1].error) == ("OG", "Ann", 1704448800, "https://i.example/1.png", None)
    assert found[1].content == " ".join(["word"] * 60)
    assert (found[2].title, found[2].content, found[2].error) == (None, "tiny", "empty") and found[2].at == 1330799400
    assert all(found[k].content is None and found[k].error == "empty" and found[k].links == [] for k in (3, 4))
    assert [(r.position, r.href, r.text) for r in pages.links(pages.extracted(page)).collect()] == [(0, "https://h.example/news/2024/01/first-story-here", "The first story here #1")]
    allowed = pages.links(pages.extracted(page), allow=[r"^/(one|n/m)"])
    assert sorted(r.href for r in allowed.collect()) == ["https://h.example/one"]
    hrefs = ["http://h.example/news/1?x=2#c", "/news/1/", "/sports.php?id=3", "/newsletter/a/b", "/a/b/c/d"]
    plain = spark.createDataFrame([(1, "http://h.example/", "".join(f'<a href="{h}">A text of ten and more</a>' for h in hrefs))], "page_id long, url string, html string")
    assert sorted((r.position, r.href) for r in pages.links(pages.extracted(plain), plain=True).collect()) == [(0, "https://h.example/news/1"), (2, "https://h.example/sports.php")]


def test_archives_end_and_feeds_are_read(spark, tmp_path):
    rows = [("s", i, n, new) for i, (n, new) in enumerate([(5, 5), (5, 0), (5, 0), (5, 1), (5, 0), (5, 0), (5, 0), (5, 5)])] + [("t", 0, 5, 5), ("t", 1, 0, 0), ("t", 2, 5, 5)] + [("u", 0, 3, 3)]
    seen = crawl.visited(spark.createDataFrame(rows, "slug string, i int, links int, new int"), ["slug"])
    assert rows_of(seen.groupBy("slug").count()) == [("s", 7), ("t", 2), ("u", 1)]
    feed = "<rss><channel><item><title>A &amp; B</title><link>https://a.example/1</link><pubDate>Tue, 04 Feb 2025 14:39:00 +0530</pubDate><description>&lt;img src='https://i.example/x.png'&gt;</description></item><item><guid>g2</guid></item><item><title>old</title><link>l</link><pubDate>Tue, 04 Feb 2020 14:39:00 GMT</pubDate></item><item><title>no link</title></item></channel></rss>"
    (tmp_path / "feed.xml").write_text(feed)
    assert [tuple(r) for r in crawl.read_feed(spark, str(tmp_path / "feed.xml")).collect()] == [("A & B", "https://a.example/1", "Tue, 04 Feb 2025 14:39:00 +0530", "<img src='https://i.example/x.png'>", "https://i.example/x.png"), ("Untitled", "g2", None, None, None)]


def test_snapshots_are_listed_and_pulled(spark, tmp_path):
    table = spark.createDataFrame([(1, "a")], "k int, v string")
    for now, label in (("2024-01-01 00:00:00", None), ("2024-01-02 00:00:00", "nightly"), ("2024-01-03 00:00:00", None)):
        snapshots.push({"articles": table, "index_postings": table}, str(tmp_path), now, label)
    assert snapshots.latest(spark, str(tmp_path)) == "store-20240103-000000" and snapshots.latest(spark, str(tmp_path), "nightly") == "store-nightly-20240102-000000"
    listed = snapshots.listing(spark, str(tmp_path)).collect()
    assert len(listed) == 6 and {(r.table, r.type) for r in listed} == {("articles", "store"), ("index_postings", "index")}
    assert rows_of(snapshots.pull(spark, str(tmp_path), "articles", "store-20240103-000000")) == [(1, "a")]
    snapshots.to_csv(table, f"{tmp_path}/csv")
    assert [p.read_text() for p in (tmp_path / "csv").glob("*.csv")] == ["k,v\n1,a\n"]
    snapshots.replaced(table.limit(0), f"{tmp_path}/csv2")
    assert spark.read.parquet(f"{tmp_path}/csv2").count() == 0


def test_samples_repeat_themselves(spark):
    rows = spark.range(1000)
    first = [r.id for r in select.sample(rows, 10, "id").collect()]
    assert first == [r.id for r in select.sample(rows.repartition(7), 10, "id").collect()] and len(set(first)) == 10
    assert select.sample(rows.limit(0), 10, "id").count() == 0


def test_entities_and_episodes(spark):
    said = "The talks began. In Paris, Ann Lee met Bob Ray and the Green Party there."
    rows = spark.createDataFrame([(1, "t", said, "en")], "id long, title string, content string, language string")
    assert review.flow(rows).first().entities == ["Paris", "Ann Lee", "Bob Ray", "Green Party"]
    only = review.flow(rows, categorize_only=True).first()
    assert only.review is None and not only.persisted and only.category == "politics"


def test_a_clustering_run_equals_the_sequential_reading(spark):
    """Every window's vectors folded in order, each cluster matched to the stories and to those opened before it."""
    fresh, known = story_plans.run_parts(spark, SF)
    stories_, new = [(r.story, np.array(r.vector)) for r in known.orderBy("rank").collect()], {}
    wanted = {}
    by = {}
    for r in fresh.orderBy("block", "latest", "vec_id").collect():
        by.setdefault(r.block, []).append((r.vec_id, np.array(r.embedding, float)))
    for block, rows in by.items():
        numbers = stories.greedy([v for _, v in rows], 0.3)
        opened = []
        for c in sorted(set(numbers)):
            head = next(v for (_, v), n in zip(rows, numbers, strict=True) if n == c)
            best, best_sim = None, 0.0
            for name, w in stories_ + opened:
                if (s := round(float(np.asarray(head, float) @ np.asarray(w, float)), 6)) > best_sim:
                    best, best_sim = name, s
            if best_sim < 0.35:
                best = f"new-{block}-{c}"
                opened.append((best, head))
            new[block, c] = best
        for (i, _), n in zip(rows, numbers, strict=True):
            wanted[i] = (block, n, new[block, n])
    from pressloom.plans import catalog

    assert {r.vec_id: (r.block, r.cluster, r.story) for r in catalog.QUERIES["cluster_run"](spark, SF).collect()} == wanted
    assert stories.greedy([], 0.5) == []


def test_functions_under_sql_names(spark):
    from pressloom.functions.register import register

    names = register(spark)
    assert {"normalize_text", "normalize_title", "detect_language", "cosine"} <= set(names)
    rows = spark.createDataFrame([("  AT&amp;T   Café! ",), ("සහ word",), (None,), ("",)], "t string")
    rows.createOrReplaceTempView("said")
    found = spark.sql("SELECT t, normalize_text(t) AS n, normalize_title(t) AS k, detect_language(t) AS l FROM said").collect()
    wanted = rows.select("t", text.normalized(F.col("t")).alias("n"), text.title_key(F.col("t")).alias("k"), text.detect_language(F.col("t")).alias("l")).collect()
    assert [tuple(r) for r in found] == [tuple(r) for r in wanted]
    assert spark.sql("SELECT cosine(array(0.6D, 0.8D), array(0.6D, 0.8D)) AS c, url_host('https://h.example/a?b') AS h").first() == (1.0, "h.example")
