"""Pruned similarity search, text vectors and selector cascades against plain Python."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressloom.operators import pages, selectors, similar, stories, vectors
from pressloom.plans import catalog

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(rows)], "id long, v array<double>")


def brute(queries, rows, itself=False):
    found = []
    for q in queries:
        sims = [(-round(float(np.dot(rows[q], v)), 6), i) for i, v in enumerate(rows) if v is not None and (itself or i != q)] if rows[q] is not None else []
        if sims:
            found.append((q, min(sims)[1], -min(sims)[0]))
    return sorted(found, key=repr)


def test_the_nearest_is_exact_and_most_pivots_are_passed_over(spark, monkeypatch):
    monkeypatch.setattr(similar, "VECTORS", 16)
    monkeypatch.setattr(similar, "QUERIES", 4)
    random = np.random.default_rng(7)
    centres = random.normal(size=(12, 24))
    rows = [c / np.linalg.norm(c) for c in (centres[k % 12] + 0.15 * random.normal(size=24) for k in range(600))]
    rows += [rows[3], rows[3], np.zeros(24), None, 3 * rows[5], -rows[7]]
    df, report = table(spark, rows), {}
    asked = df.where("id % 5 = 0 or id > 590")
    found = rows_of(similar.nearest(asked, df, "id", "v", pivots=40, report=report))
    assert [(q, i) for q, i, _ in found] == [(q, i) for q, i, _ in brute([r.id for r in asked.collect()], rows)]
    assert np.allclose([c for *_, c in found], [c for *_, c in brute([r.id for r in asked.collect()], rows)], atol=1e-6)
    assert report["visited"] < report["pairs"] / 3
    same = rows_of(similar.best_of(asked, df, "id", "v", itself=True, pivots=7))
    assert [(q, i) for q, i, _ in same] == [(q, i) for q, i, _ in brute([r.id for r in asked.collect()], rows, itself=True)]


def test_one_vector_for_most_rows_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(similar, "VECTORS", 8)
    rows = [[1.0, 0.0]] * 90 + [[0.0, 1.0], [0.6, 0.8]]
    df = table(spark, rows)
    assert rows_of(similar.nearest(df, df, "id", "v")) == brute(range(92), rows)
    assert similar.nearest(df, df.limit(0), "id", "v").count() == 0 and similar.nearest(df.limit(0), df, "id", "v").count() == 0
    assert similar.nearest(df.where("id = 3"), df.where("id = 3"), "id", "v").count() == 0


def test_bounds_hold_for_every_member():
    random = np.random.default_rng(1)
    rows, asked = random.normal(size=(500, 6)) * random.uniform(0, 3, size=(500, 1)), random.normal(size=(50, 6))
    pivots = similar.choose(rows, 20)
    angle, length = similar.angles(rows, pivots)
    home = np.argmin(angle, axis=1)
    members = np.array([[f(x[home == k]) for k in range(20)] for f, x in ((np.min, np.min(angle, axis=1)), (np.max, np.min(angle, axis=1)), (np.min, length), (np.max, length))])
    bound = similar.bounds(*similar.angles(asked, pivots), members)
    for k in range(20):
        assert (asked @ rows[home == k].T).max(axis=1) == pytest.approx((asked @ rows[home == k].T).max(axis=1)) and ((asked @ rows[home == k].T).max(axis=1) <= bound[:, k]).all()


def test_text_vectors_and_pairs(spark):
    said = ["sun rain sun", "Rain, sun; SUN!", "rain wind", "wind " * 40, "", None, "snow ice", "snow ice fog", "lone"] + ["rain common"] * 5
    docs = spark.createDataFrame(list(enumerate(said)), "id long, t string")
    found = {r.id: {b: w for b, w in r.vector} for r in vectors.tf_idf(docs, F.col("t")).collect()}
    assert set(found) == set(range(len(said))) and found[4] == found[5] == {}
    words = [Counter("".join(c if c.isalnum() else " " for c in (t or "").lower()).split()) for t in said]
    idf = {w: math.log((1 + len(said)) / (1 + sum(w in x for x in words))) + 1 for x in words for w in x}
    plain = [{w: n * idf[w] for w, n in x.items()} for x in words]
    plain = [{w: v / math.sqrt(sum(y * y for y in x.values())) for w, v in x.items()} for x in plain]
    assert [sorted(found[i].values()) for i in range(len(said))] == [pytest.approx(sorted(x.values())) for x in plain]
    members, pairs = vectors.alike(vectors.tf_idf(docs, F.col("t")), 0.3)
    heads = dict(rows_of(members))
    assert heads == {i: next(j for j, y in enumerate(plain) if y == pytest.approx(x)) for i, x in enumerate(plain) if x}
    dots = {(a, b): sum(v * plain[b].get(w, 0) for w, v in plain[a].items()) for a in set(heads.values()) for b in set(heads.values()) if a < b}
    assert [(a, b) for a, b, _ in rows_of(pairs)] == sorted(p for p, d in dots.items() if d >= 0.3) and len(rows_of(pairs)) > 2
    assert all(c == pytest.approx(dots[a, b], abs=1e-6) for a, b, c in rows_of(pairs))
    flat = [r.v for r in vectors.tf_idf(docs, F.col("t")).select(vectors.dense(F.col("vector"), 16).alias("v")).collect()]
    assert all(len(v) == 16 and (not any(v) or sum(x * x for x in v) == pytest.approx(1)) for v in flat) and sum(map(any, flat)) == len(heads)


def test_vectors_of_candidates_are_not_shuffled(spark):
    """They go once with each of their prefix's buckets, so what is dealt out grows with the texts, not with the candidates."""
    said = [f"{'same words here for all of them'} w{k % 40} w{k % 41} w{k}" for k in range(200)] + ["", "one", "w1 w2 w3"]
    docs = spark.createDataFrame(list(enumerate(said)), "id long, t string")
    table_ = vectors.tf_idf(docs, F.col("t")).cache()
    plain = {r.id: {x.bucket: x.weight for x in r.vector} for r in table_.collect()}
    _, pairs = vectors.alike(table_, 0.2)
    dots = {(a, b): round(sum(v * plain[b].get(w, 0) for w, v in plain[a].items()), 6) for a in plain for b in plain if a < b}
    assert rows_of(pairs) == sorted(((a, b, c) for (a, b), c in dots.items() if c >= 0.2), key=repr) and len(rows_of(pairs)) > 20
    assert str(pairs._jdf.queryExecution().optimizedPlan()).count("Join ") == 1


PAGE = """<html><head><meta property="og:title" content="OG"><meta name="author" content=""><title>Head</title></head><body><div class="top menu">skip</div>
<main><div class="wide content" id="story"><p>one</p><figure>pic<figcaption>cap</figcaption></figure><p>two</p><div id="x_google_ads_1">ad</div><span class="my-social-bar">share</span></div></main>
<div class="post-date"> 2024-02-03 </div><a rel="author" href="/a">Ann Lee</a><time datetime="2024-01-05T10:00:00Z">then</time><article><h1 class="big"></h1><h1>Second</h1><img src="/i.png"></article></body></html>"""


def test_selectors_find_what_they_say(spark):
    nodes = spark.createDataFrame([(PAGE,)], "html string").select(selectors.nodes("html").alias("p"))
    rules = lambda *s: spark.createDataFrame([([selectors.steps(x) for x in s],)], f"s array<array<{selectors.STEP}>>")
    asked = ["h1", "h1.big", "article h1", "main .content p", ".wide.content#story", '[rel="author"]', "time[datetime]", '[class*="social"]', '[id*="google_ads"]', "html body main div p", "p p", "nosuch", "a[rel]", "div#story.wide"]
    found = nodes.crossJoin(rules(*asked)).select(F.transform("s", lambda c: F.transform(selectors.selected(F.col("p.nodes"), c), lambda n: n["tag"])).alias("t")).first().t
    assert found == [["h1", "h1"], ["h1"], ["h1", "h1"], ["p", "p"], ["div"], ["a"], ["time"], ["span"], ["div"], ["p", "p"], [], [], ["a"], ["div"]]
    for bad in ("", "a > b", "a:hover", "*"):
        with pytest.raises(ValueError):
            selectors.steps(bad)


def test_cascades_by_source(spark, monkeypatch):
    monkeypatch.setattr(selectors, "REGION", 5)
    table_ = selectors.cascades(spark, {"own": {"title": ["title"], "content": [".nosuch", "#story"], "date": [".post-date"]}})
    rows = spark.createDataFrame([(1, "https://h/1", PAGE, "own"), (2, "https://h/2", PAGE, "other"), (3, "https://h/3", PAGE, None), (4, "u", None, "own"), (5, "u", "", None), (6, "u", "<p>no body", "own"), (1, "https://h/1", PAGE, "own")], "page_id long, url string, html string, site string")
    found = [r.asDict() for r in selectors.extracted(rows, table_, F.col("site")).orderBy("page_id").collect()]
    assert found[0] == found[1]
    own, other, none = found[1], found[2], found[3]
    assert (own["title"], own["author"], own["date_text"], own["content"], own["image_url"]) == ("Head", "Ann Lee", "2024-02-03", "onepictwo", "/i.png")
    assert (other["title"], other["author"], other["date_text"]) == ("OG", "Ann Lee", "2024-01-05T10:00:00Z")
    assert other["content"] == "Second" and none == other | {"page_id": 3, "url": "https://h/3", "source": None}
    assert [(f["title"], f["content"]) for f in found[4:]] == [(None, None), (None, None), (None, "no body")]
    assert own["published_at"] is not None


def test_pages_are_parsed_once(spark):
    for name in ("html_links", "page_hrefs", "html_articles", "page_parts"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1, name
    plan = catalog.QUERIES["title_dedup"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    first = plan.split("Initial Plan")[0]
    assert first.count("ArrowEvalPython") == 1 and first.count("FileScan") == 1
    assert pages.read(None)["links"] == []


def test_the_screened_fold_is_the_plain_fold():
    """Copies, moved centroids within one chunk, several slabs, zeros; the fold held every centroid whole and compared each vector with all."""
    rng = np.random.default_rng(7)
    sparse = np.abs(rng.normal(size=(6000, 60))) * (rng.random((6000, 60)) < 0.1)
    copies = rng.normal(size=(1500, 12))
    copies[rng.random(1500) < 0.5] = copies[0]
    for vs, least in ((sparse, 0.9), (sparse[:1500], 0.1), (copies, 0.5), (copies, -0.5)):
        length = np.linalg.norm(vs, axis=1, keepdims=True)
        vs = vs / np.where(length > 0, length, 1.0)
        wanted, centroids, sizes = [], np.zeros(vs.shape), []
        for v in vs:
            sims = centroids[: len(sizes)] @ v
            k = int(np.argmax(sims)) if sizes and sims.max() >= least and sims.max() > 0 else len(sizes)
            if k == len(sizes):
                centroids[k] = v
                sizes.append(1)
            else:
                sizes[k] += 1
                c = (centroids[k] * (sizes[k] - 1) + v) / sizes[k]
                centroids[k] = c / np.linalg.norm(c)
            wanted.append(k)
        fold = stories.Fold(least)
        assert fold.add_all(vs) == wanted and fold.sizes == sizes
    assert all(slab.dtype == np.float32 for slab in fold.slabs)  # beside the exact ones, which have no zeros


@pytest.mark.parametrize("module, reader", [(pages, "parts"), (selectors, "nodes")])
def test_few_pages_are_held_as_objects_at_once(monkeypatch, module, reader):
    """All pages of a batch used to be."""
    import types

    import pyarrow as pa

    made, runs = [], []
    seen = types.SimpleNamespace(**{n: getattr(pa, n) for n in dir(pa) if not n.startswith("_")})
    seen.array = lambda rows, kind: made.append(len(rows)) or pa.array(rows, kind)
    monkeypatch.setattr(module, "pa", seen)
    monkeypatch.setattr(module.F, "arrow_udf", lambda f, kind: runs.append(f) or types.SimpleNamespace(asNondeterministic=lambda: lambda c: c))
    getattr(module, reader)("html")
    every = runs[0](pa.array(["<h1>a</h1>", None] * 200))
    assert len(every) == 400 and max(made) <= 64 and every[0].is_valid
    assert len(runs[0](pa.array([], pa.string()))) == 0
