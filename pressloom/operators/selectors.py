"""Parts of pages by selector cascades, one cascade a source, evaluated as array expressions.

A small reader turns a page into its text and an array of elements in document order:
each has its tag, id, classes and attributes, the number of its last descendant, and
the range of the text that it covers. So "is inside" compares two numbers, and an element's
text is a slice. A cascade is data: a row of a table with, for every part of an article, the
selectors to try in order. Pages meet their source's row, and higher-order functions
find the first element of each selector, its text or attribute, and what is left of a
region without chrome.

Selectors are a tag, #id, .class, [name], [name="value"] and [name*="value"] in any
combination, and blanks between those for "inside". The reader closes what a page leaves open where an
enclosing element ends, as no browser would in every case.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.functions import dates
from pressloom.operators.pages import AUTHOR_METAS, DATE_METAS, PACKED, REGION, VOID, terminated

PARTS = ("title", "author", "date", "content", "image")
# The selectors that are tried where a source has none of its own.
DEFAULTS = {
    "title": ["h1.entry-title", "h1.article-title", "h1.post-title", "article h1", ".article-header h1", "h1"],
    "author": [".author-name", ".byline", ".article-author", ".writer-name", '[rel="author"]', ".post-author"],
    "date": ["time[datetime]", ".publish-date", ".article-date", ".post-date", ".entry-date", ".date", ".news-datestamp"],
    "content": [
        ".news-content", "#DivNewsContent", ".story-body", "article .entry-content", ".article-body", ".article-content", ".story-text", ".inner-content", ".entry-content", ".post-content",
        ".content-area", "#article-body", ".inner-fontstyle", "article", "main .content",
    ],
    "image": [".article-image img", "article img", ".featured-image img"],
}
# What is taken out of a region before its text is read.
CHROME = [
    "script", "style", "noscript", "iframe", "nav", "header", "footer", "aside", ".navbar", ".navigation", ".menu", ".google-auto-placed", ".adsbygoogle", '[id*="google_ads"]', '[class*="social"]',
    '[class*="sharethis"]', ".st-total", ".share-buttons", ".comments-section", "#aiSummaryBox", ".ai-quickread-box", ".ai-quickread", ".ai-qr-title", ".ai-qr-subtitle", ".ai-quickread-badge",
    ".ai-quickread-hide", ".ai-quickread-loading", ".fotorama", "figure figcaption",
]
BODY = "body"

NODE = "struct<no:int,last:int,tag:string,id:string,classes:array<string>,attrs:map<string,string>,begin:int,end:int>"
STEP = "struct<tag:string,id:string,classes:array<string>,attrs:array<struct<name:string,op:string,value:string>>>"
_KEYS = "struct<tags:array<string>,ids:array<string>,classes:array<string>,names:array<string>>"


class _Nodes(HTMLParser):
    """A page's text, and its elements in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.size, self.nodes, self.open = [], 0, [], []

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in reversed(attrs)}
        node = {"no": len(self.nodes), "last": len(self.nodes), "tag": tag, "id": given.get("id"), "classes": given.get("class", "").split(), "attrs": list(given.items()), "begin": self.size, "end": self.size}
        self.nodes.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if any(n["tag"] == tag for n in self.open):
            while self.close_last()["tag"] != tag:
                pass

    def handle_data(self, data):
        self.text.append(data)
        self.size += len(data)

    def close_last(self):
        node = self.open.pop()
        node["last"], node["end"] = len(self.nodes) - 1, self.size
        return node


def read(html: str | None, whole: bool = False) -> dict:
    """(text, nodes) of a page; null and empty pages have none. ``whole``: ``terminated`` references only."""
    reader = _Nodes()
    reader.feed(terminated(html or "") if whole else html or "")
    reader.close()
    while reader.open:
        reader.close_last()
    return {"text": "".join(reader.text), "nodes": reader.nodes}


def nodes(html: Column | str, whole: bool = False) -> Column:
    """The text and elements of whole pages, each page read once."""
    ints, text = pa.int32(), pa.string()
    node = pa.struct([("no", ints), ("last", ints), ("tag", text), ("id", text), ("classes", pa.list_(text)), ("attrs", pa.map_(text, text)), ("begin", ints), ("end", ints)])
    kind = pa.struct([("text", text), ("nodes", pa.list_(node))])

    def run(pages: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([read(p.as_py(), whole) for p in pages.slice(k, PACKED)], kind) for k in range(0, max(1, len(pages)), PACKED)])

    return F.arrow_udf(run, f"struct<text:string,nodes:array<{NODE}>>").asNondeterministic()(html)


_PIECE = re.compile(r"""([\w-]+)|#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:(\*?=)["']?([^"'\]]*)["']?)?\]""")


def steps(selector: str) -> list[dict]:
    """A selector as what its nested elements must have, outermost first; others than stated above are refused."""
    found = []
    for word in re.findall(r"(?:\[[^\]]*\]|\S)+", selector):
        at, step = 0, {"tag": None, "id": None, "classes": [], "attrs": []}
        while at < len(word):
            m = _PIECE.match(word, at)
            if not m or m[1] and at:
                raise ValueError(f"not a selector that is known: {selector}")
            tag, key, name, attr, op, value = m.groups()
            if tag:
                step["tag"] = tag.lower()
            elif key:
                step["id"] = key
            elif name:
                step["classes"].append(name)
            else:
                step["attrs"].append({"name": attr.lower(), "op": op or "", "value": value or ""})
            at = m.end()
        found.append(step)
    if not found:
        raise ValueError("an empty selector")
    return found


def cascades(spark: SparkSession, own: Mapping[str, Mapping[str, Sequence[str]]] | None = None, defaults: Mapping[str, Sequence[str]] = DEFAULTS) -> DataFrame:
    """(source, one array of selectors a part, keys): a row a source of ``own``, and one of the ``defaults`` with a null source.

    A source's parts that it does not name are the defaults'. ``keys`` has what any of its
    selectors asks for, so that a page's other elements are passed over at once.
    """
    rows = []
    for source, parts in [(None, {}), *(own or {}).items()]:
        if unknown := set(parts) - set(PARTS):
            raise ValueError(f"no parts of an article: {sorted(unknown)}")
        made = {p: [steps(s) for s in parts.get(p, defaults[p])] for p in PARTS}
        every = [s for selectors in made.values() for chain in selectors for s in chain]
        # an element is kept by the first thing that a step asks for
        keys = {"tags": set(), "ids": set(), "classes": set(), "names": set()}
        for s in every:
            if s["id"]:
                keys["ids"].add(s["id"])
            elif s["classes"]:
                keys["classes"].add(s["classes"][0])
            elif s["tag"]:
                keys["tags"].add(s["tag"])
            else:
                keys["names"].add(s["attrs"][0]["name"])
        rows.append((source, *(made[p] for p in PARTS), {k: sorted(v) for k, v in keys.items()}))
    return spark.createDataFrame(rows, f"source string, {', '.join(f'{p} array<array<{STEP}>>' for p in PARTS)}, keys {_KEYS}")


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _fits(node: Column, step: Column) -> Column:
    """Whether an element has what a step asks for."""

    def has(a: Column) -> Column:
        value = F.try_element_at(node["attrs"], a["name"])
        return F.coalesce(F.when(a["op"] == "=", value == a["value"]).when(a["op"] == "*=", F.contains(value, a["value"])).otherwise(value.isNotNull()), F.lit(False))

    tag, key = (step[c].isNull() | F.coalesce(node[c] == step[c], F.lit(False)) for c in ("tag", "id"))
    return tag & key & (F.size(F.array_except(step["classes"], node["classes"])) == 0) & F.forall(step["attrs"], has)


def selected(elements: Column, chain: Column) -> Column:
    """The elements that a selector finds, in document order: those of its last step that are inside one of the step before, and so on."""

    def inner(outer: Column, step: Column) -> Column:
        inside = lambda n: F.exists(outer, lambda o: (o["no"] < n["no"]) & (n["no"] <= o["last"]))
        return F.filter(elements, lambda n: _fits(n, step) & inside(n))

    first = F.filter(elements, lambda n: _fits(n, chain[0]))
    return F.aggregate(F.slice(chain, 2, F.greatest(F.lit(0), F.size(chain) - 1)), first, inner)


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\x{A0}\x{FEFF}]+|[\s\x{A0}\x{FEFF}]+$", "")


def _chrome(n: Column, elements: Column) -> Column:
    """CHROME as one test of an element."""
    simple = [steps(s) for s in CHROME]
    one = [c[0] for c in simple if len(c) == 1]
    tags = [s["tag"] for s in one if s["tag"]]
    ids = [s["id"] for s in one if s["id"]]
    classes = [c for s in one for c in s["classes"]]
    parts = [(a["name"], a["value"]) for s in one for a in s["attrs"]]
    out = n["tag"].isin(tags) | F.coalesce(n["id"].isin(ids), F.lit(False)) | F.arrays_overlap(n["classes"], F.array(*map(F.lit, classes)))
    for name, value in parts:
        out = out | F.coalesce(F.contains(F.try_element_at(n["attrs"], F.lit(name)), F.lit(value)), F.lit(False))
    around = lambda tag: F.exists(elements, lambda o: (o["tag"] == tag) & (o["no"] < n["no"]) & (n["no"] <= o["last"]))
    for outer, inner in (c for c in simple if len(c) == 2):
        out = out | ((n["tag"] == inner["tag"]) & around(outer["tag"]))
    return out


def _without(text: Column, node: Column, chrome: Column) -> Column:
    """The text of an element without that of the chrome inside it."""
    begin = F.struct(node["begin"].alias("at"), F.lit("").alias("said"))

    def skip(state: Column, c: Column) -> Column:
        said = F.concat(state["said"], F.when(c["begin"] > state["at"], text.substr(state["at"] + 1, c["begin"] - state["at"])).otherwise(F.lit("")))
        return F.struct(F.greatest(state["at"], c["end"]).alias("at"), said.alias("said"))

    inside = F.filter(chrome, lambda c: (node["no"] < c["no"]) & (c["no"] <= node["last"]))
    rest = lambda s: F.concat(s["said"], F.when(node["end"] > s["at"], text.substr(s["at"] + 1, node["end"] - s["at"])).otherwise(F.lit("")))
    return _trimmed(F.aggregate(inside, begin, skip, rest))


def extracted(pages: DataFrame, cascades: DataFrame, source: Column, now: str = "9000-01-01 00:00:00", whole: bool = False) -> DataFrame:
    """(page_id, url, source, title, author, date_text, published_at, content, image_url) of pages(page_id, url, html) by their source's cascade.

    A page of a source without a row of its own is read by the defaults. The title is that
    of the first selector whose first element has text, else og:title. An author is a
    meta's, else as the title. date_text is a meta, else the first datetime attribute of
    the date selectors' elements, else the first text. The content is the text without chrome of the first selector whose
    first element has more than REGION characters of it, else of the body. Empty parts are
    null; a null page has none. The date goes through the waterfall. With ``whole``, only ``terminated`` references are resolved.
    """
    known = cascades.where("source is not null").select(F.col("source").alias("_known"))
    named = pages.select("page_id", "url", "html", source.alias("source"))
    named = named.join(known, F.col("source") == F.col("_known"), "left")
    rules = cascades.select(F.col("source").alias("_of"), F.struct(*PARTS).alias("_rules"), "keys")
    met = named.join(rules, F.col("_known").eqNullSafe(F.col("_of"))).select("page_id", "url", "source", "_rules", "keys", nodes("html", whole).alias("_page"))
    every, keys = F.col("_page.nodes"), F.col("keys")

    def asked(n: Column) -> Column:
        return F.array_contains(keys["tags"], n["tag"]) | F.coalesce(F.array_contains(keys["ids"], n["id"]), F.lit(False)) | F.arrays_overlap(n["classes"], keys["classes"]) | F.arrays_overlap(F.map_keys(n["attrs"]), keys["names"])

    body = F.get(F.filter(every, lambda n: n["tag"] == BODY), 0)
    whole = F.struct(F.lit(-1).alias("no"), F.size(every).alias("last"), F.lit(0).alias("begin"), F.length("_page.text").alias("end"))
    area = F.when(body.isNotNull(), F.struct(*(body[c].alias(c) for c in ("no", "last", "begin", "end")))).otherwise(whole)
    metas = F.transform(F.filter(every, lambda n: n["tag"] == "meta"), lambda n: F.struct(or_else(F.try_element_at(n["attrs"], F.lit("property")), F.try_element_at(n["attrs"], F.lit("name"))).alias("name"), F.try_element_at(n["attrs"], F.lit("content")).alias("said")))
    # a generator between the reader and what is made of it: nothing above is computed again for each part
    parts = F.struct(F.col("_page.text").alias("text"), F.filter(every, asked).alias("nodes"), F.filter(every, lambda n: _chrome(n, every)).alias("chrome"), F.filter(metas, lambda m: m["said"] != "").alias("metas"), area.alias("body"))
    page = met.select("page_id", "url", "source", "_rules", F.explode(F.array(parts)).alias("p"))
    p, rules = F.col("p"), F.col("_rules")
    one_meta = lambda name: F.try_element_at(F.filter(p["metas"], lambda m: m["name"] == name), F.lit(-1))["said"]
    meta = lambda *names: F.coalesce(*map(one_meta, names))
    heads = lambda part: F.transform(rules[part], lambda chain: F.get(selected(p["nodes"], chain), 0))
    text_of = lambda n: _trimmed(p["text"].substr(n["begin"] + 1, n["end"] - n["begin"]))
    first = lambda values: F.get(F.filter(values, lambda v: F.coalesce(v != "", F.lit(False))), 0)
    said = lambda part: first(F.transform(heads(part), text_of))
    attr = lambda part, name: first(F.transform(heads(part), lambda n: _trimmed(F.try_element_at(n["attrs"], F.lit(name)))))
    region = F.get(F.filter(F.transform(heads("content"), lambda n: F.when(n.isNotNull(), _without(p["text"], n, p["chrome"]))), lambda v: F.coalesce(F.length(v) > REGION, F.lit(False))), 0)
    date_text = F.coalesce(meta(*DATE_METAS), attr("date", "datetime"), said("date"))
    content = F.nullif(F.coalesce(region, _without(p["text"], p["body"], p["chrome"])), F.lit(""))
    found = page.select(
        "page_id",
        "url",
        "source",
        F.coalesce(said("title"), F.nullif(meta("og:title"), F.lit(""))).alias("title"),
        F.coalesce(meta(*AUTHOR_METAS), said("author")).alias("author"),
        date_text.alias("date_text"),
        content.alias("content"),
        F.coalesce(meta("og:image"), attr("image", "src")).alias("image_url"),
    )
    at = dates.waterfall(F.col("date_text"), F.col("date_text"), F.col("url"), F.coalesce("content", F.lit("")), None, now)
    return found.withColumn("published_at", at)


def or_else(*choices: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in choices))
