"""Every registered query against its DuckDB oracle on the smallest tables, and the others against plain Python."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pressloom.functions import text
from pressloom.operators import dedup, pages, review, selectors, stories
from pressloom.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or isinstance(value, float) and value != value:
        return None
    if isinstance(value, (float, np.floating)):
        return round(float(value), 6)
    return value.item() if hasattr(value, "item") else value


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_oracle(spark, duck, name):
    found, wanted = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLE[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_greedy_clusters_follow_the_fold(spark):
    wanted = {}
    rows = catalog.dated_vectors(spark, SF).orderBy("block", F.desc_nulls_last("published_at"), "vec_id").collect()
    for block in {r.block for r in rows}:
        centroids = []
        for r in rows:
            if r.block != block:
                continue
            v = np.array(r.embedding, float)
            sims = [c @ v for c, _ in centroids]
            k = int(np.argmax(sims)) if sims and max(sims) >= 0.3 else len(centroids)
            if k == len(centroids):
                centroids.append((v, 1))
            else:
                c, n = centroids[k]
                c = (c * n + v) / (n + 1)
                centroids[k] = (c / np.linalg.norm(c), n + 1)
            wanted[r.vec_id] = (block, k)
    assert {r.vec_id: (r.block, r.cluster) for r in catalog.QUERIES["greedy_clusters"](spark, SF).collect()} == wanted
    assert stories.greedy(np.zeros((0, 3)), 0.5) == []


def test_pages_are_read_without_chrome(spark):
    html = (
        "<html><head><title>T &amp; x</title><script>no</script></head><body><nav>menu</nav><div class='ad'>buy</div>"
        "<article><h1>Head\n line</h1><p>" + "word " * 60 + "</p><p>two<br>three</p></article>"
        "<a href='/a'>a long enough link</a><a href='/a'>a long enough link</a><a href='/b'>short</a><footer>foot</footer></body></html>"
    )
    page = spark.createDataFrame([(1, "https://h.example/", html)], "page_id long, url string, html string")
    r = pages.extracted(page).first()
    assert r.title == "Head line"
    assert r.content == "Head line\n" + " ".join(["word"] * 60) + "\ntwo\nthree"
    assert [(x.href, x.text) for x in pages.links(pages.extracted(page), allow=["^/a"]).collect()] == [("https://h.example/a", "a long enough link")]
    found = catalog.QUERIES["html_articles"](spark, SF)
    assert found.count() == spark.read.parquet(f"{SF}/pages.parquet").count() and found.where("content is null").count() == 0
    assert catalog.QUERIES["html_links"](spark, SF).columns == ["page_id", "position", "href", "text"]


def test_exact_clusters_fold_all_vectors_in_the_order_of_publication(spark, duck):
    order = duck.execute(f"WITH {catalog.ARTICLES_SQL} SELECT vec_id, embedding FROM embeddings LEFT JOIN articles ON id = vec_id ORDER BY published_at DESC NULLS LAST, vec_id").fetchall()
    wanted, centroids = {}, []
    for i, v in order:
        v = np.array(v, float)
        best, best_sim = None, 0.0
        for k, (c, _) in enumerate(centroids):
            if c @ v > best_sim:
                best, best_sim = k, c @ v
        if best is not None and best_sim >= 0.3:
            c, n = centroids[best]
            c = (c * n + v) / (n + 1)
            centroids[best] = (c / np.linalg.norm(c), n + 1)
        else:
            best = len(centroids)
            centroids.append((v, 1))
        wanted[i] = best
    assert {r.vec_id: r.cluster for r in catalog.QUERIES["greedy_clusters_exact"](spark, SF).collect()} == wanted
    blocked = {r.vec_id: (r.block, r.cluster) for r in catalog.QUERIES["greedy_clusters"](spark, SF).collect()}
    print("clusters: blocked", len(set(blocked.values())), "exact", len(centroids))
    assert len(centroids) < len(set(blocked.values()))


def test_titles_are_composed_before_their_key(spark):
    """A decomposed title has its composed copy's key, and not that of the title without accents."""
    rows = [(1, "s", "Caf\u00e9 r\u00e9sum\u00e9 daily"), (2, "s", "Cafe\u0301 re\u0301sume\u0301 daily"), (3, "s", "Cafe resume daily"), (4, "s", None)]
    items = spark.createDataFrame(rows, "id long, slug string, title string")
    assert sorted(r.id for r in dedup.first_titles(items).collect()) == [1, 3, 4]
    assert sorted(r.id for r in dedup.without_known_titles(items, items.where("id = 2")).collect()) == [3, 4]
    assert [r.k for r in items.orderBy("id").select(text.title_key(items.title).alias("k")).collect()] == ["caf\u00e9r\u00e9sum\u00e9daily"] * 2 + ["caferesumedaily", None]


def test_language_by_frequent_words(spark):
    """Mostly Latin texts are Sinhala if one of their first 50 words is a frequent Sinhala word."""
    fill = ["latin"] * 200
    at = lambda k, word="\u0dc3\u0dc4": " ".join(fill[:k] + [word] + fill[k:])
    said = {at(0): "si", at(49): "si", at(50): "en", at(3, "x\u0dc3\u0dc4"): "en", " \n" + at(49).replace(" ", "\u2003"): "si", "word " * 40 + "\u0d85\u0daf": "si", "latin only": "en", "": "en", None: "en"}
    rows = spark.createDataFrame([(t,) for t in said], "t string")
    assert {r.t: r.found for r in rows.select("t", text.detect_language(rows.t).alias("found")).collect()} == said


def test_excerpts_lose_blanks_and_no_digits_at_the_ends_of_their_line(spark):
    line = "0997 is how this line begins, and it ends with 1000"
    rows = spark.createDataFrame([(line,), (f"short\n  {line}  \nrest",), (f"1{line}1",)], "t string")
    assert [r.e for r in rows.select(text.excerpt(rows.t).alias("e")).collect()] == [line, line, f"1{line}1"]
    twice = spark.createDataFrame([("t", f"{line}\n  {line}", "en"), ("t", f"0{line}\n{line}", "en")], "title string, content string, language string")
    found = review.reviewed(twice).select(F.col("review.issues.type").alias("i")).collect()
    assert ["duplicate_content" in r.i for r in found] == [True, False]


def test_references_that_are_cut_off_stay_as_they_are(spark):
    """A heading cut in the middle of a reference; browsers would resolve it, as the readers do unless told not to."""
    body = "<p>" + "a &amp; b &lt;i&gt; " * 20 + "</p>"
    html = f"<html><head><title>T &amp</title><script>a &amp b</script></head><body><article><h1>Q &amp;&amp; A &notit; &nosuch; &#65; &#x42; &amp</h1>{body}</article><a href='/x?a=1&copy=2'>link</a></body></html>"
    page = spark.createDataFrame([(1, "https://h.example/", html)], "page_id long, url string, html string")
    assert pages.extracted(page).first().title.endswith("&nosuch; A B &")
    found = pages.extracted(page, whole=True).first()
    assert found.title == "Q && A &notit; &nosuch; A B &amp"
    assert found.links[0].href == "/x?a=1&copy=2" and "a & b <i>" in found.content
    cut = selectors.extracted(page, selectors.cascades(spark), F.lit("s"), whole=True).first()
    assert cut.title == found.title and "a & b <i>" in cut.content
