"""Articles and links from raw HTML: a small reader per page finds the parts, columns decide what counts.

The reader walks a page once and returns its candidates (metas, headings, times,
regions of text, links, images) as a struct. Which of them is the title, the date or the
content, and which links lead to articles, is said in column expressions over it.
"""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.functions import dates, text
from pressloom.operators.select import path_and_query

# Elements whose text is no content, and classes that mark chrome.
SKIPPED = {"script", "style", "noscript", "iframe", "nav", "header", "footer", "aside", "figcaption"}
CHROME = {"ad", "ads", "navbar", "navigation", "menu", "google-auto-placed", "adsbygoogle", "share", "share-buttons", "social", "sharethis", "st-total", "comments", "comments-section", "fotorama"}
VOID = {"br", "img", "meta", "link", "input", "hr"}
BLOCKS = {"p", "div", "h1", "h2", "h3", "li", "tr", "article", "section", "br", "blockquote"}
# Metas and classes that name a page's parts, in the order in which they count.
DATE_METAS = ["article:published_time", "og:article:published_time", "datePublished", "publishedTime", "dateModified", "modifiedTime"]
AUTHOR_METAS = ["author", "article:author"]
CONTENT_CLASSES = ["news-content", "story-body", "entry-content", "article-body", "article-content", "story-text", "inner-content", "post-content", "content-area"]
AUTHOR_CLASSES = ["author-name", "byline", "article-author", "writer-name", "post-author"]
DATE_CLASSES = ["publish-date", "article-date", "post-date", "entry-date", "date", "news-datestamp"]
#: Pages that are held as Python objects at once.
PACKED = 64
#: A region of more cleaned characters than this is the content.
REGION = 200
#: Lengths of a link's text, and the least number of path segments of a link that no allow list names.
LINK_TEXT = (10, 300)
SEGMENTS = 3
# Links that lead to lists or media, and texts that say nothing.
LIST_LINKS = r"(?i)/(category|tag|page|author|wp-content|feed|login)/"
MEDIA_LINKS = r"(?i)\.(jpg|jpeg|png|gif|svg|webp|pdf)$"
# The paths of the source whose links are normalised.
PLAIN_PATHS = r"/(news|sports)[/.]"
GENERIC_TEXT = r"(?i)^(වැඩි විස්තර|more|comments|\(\d+\)|read more)"

_NAMED = {c: k for k, c in enumerate(CONTENT_CLASSES)}
_ROLES = {**{c: ("author", k) for k, c in enumerate(AUTHOR_CLASSES)}, **{c: ("date", k) for k, c in enumerate(DATE_CLASSES)}}


class _Reader(HTMLParser):
    """Collects a page's parts; what an open element adds to is known when it opens, so text is put without looking at the stack."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple] = []  # (tag, skips, region begun or None, sink before)
        self.skipping = 0
        self.parts: list[str] = []  # the body's text; regions are ranges of it
        self.regions: list[tuple[int, int, int]] = []  # (rank, first part, past the last part)
        self.heading, self.title, self.links, self.metas = [], [], [], {}
        self.named: dict[tuple[str, int], str] = {}
        self.time = self.image = None
        self.sink = self.parts
        self.link = None

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        classes = (given.get("class") or "").split()
        if tag == "a" and given.get("href"):
            self.link = (given["href"], [])
        elif tag == "meta" and (name := given.get("property") or given.get("name")) and given.get("content"):
            self.metas[name] = given["content"]
        elif tag == "time" and given.get("datetime") and not self.time:
            self.time = given["datetime"].strip()
        elif tag == "img" and given.get("src") and not self.image and any(t == "article" for t, *_ in self.open):
            self.image = given["src"]
        if tag in VOID:
            if tag in BLOCKS:
                self.put("\n")
            return
        skip = tag in SKIPPED or bool(CHROME.intersection(classes))
        if tag in BLOCKS:
            self.put("\n")
        rank = min((_NAMED[c] for c in classes if c in _NAMED), default=len(CONTENT_CLASSES) if tag == "article" else None)
        role = min((_ROLES[c] for c in classes if c in _ROLES), default=None)
        self.open.append((tag, skip, (rank, len(self.parts)) if rank is not None else None, self.sink, role))
        self.skipping += skip
        if tag == "title" and not self.title:
            self.sink = self.title
        elif tag == "h1" and not "".join(self.heading).strip() and not self.skipping:
            self.sink = self.heading
        elif role and role not in self.named:
            self.named[role] = self.sink = []

    def handle_endtag(self, tag):
        if tag == "a" and self.link:
            self.links.append((self.link[0], " ".join("".join(self.link[1]).split())))
            self.link = None
        if any(t == tag for t, *_ in self.open):
            while self.open:
                t, skip, region, self.sink, _ = self.open.pop()
                self.skipping -= skip
                if region:
                    self.regions.append((region[0], region[1], len(self.parts)))
                if t == tag:
                    break
        if tag in BLOCKS:
            self.put("\n")

    def handle_data(self, data):
        if self.link:
            self.link[1].append(data)
        self.put(data.replace("\n", " "))

    def put(self, data):
        if self.sink is not self.parts:
            self.sink.append(data)
        if self.sink is not self.title and not self.skipping:
            self.parts.append(data)


def _clean(parts: list[str]) -> str:
    lines = (" ".join(x.split()) for x in "".join(parts).split("\n"))
    return "\n".join(x for x in lines if x)


PARTS = "heading string, title string, metas map<string,string>, author string, date string, time string, image string, regions array<string>, body string, links array<struct<href string, text string>>"


# what has no references, and every & with the name or number and semicolon that may follow it
_REFERENCE = re.compile(r"(<(script|style)\b.*?</\2)|&(#\d+;|#x[\da-f]+;|[a-z][a-z\d]*;)?", re.I | re.S)


def terminated(html: str) -> str:
    """A page of which only whole references, with a known name and a semicolon, are still such: browsers also read some without it, as in a text cut in the middle of one."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] or (m[3] or "").startswith("#") or m[3] in html5 else "&amp;" + (m[3] or ""), html)


def read(html: str | None, whole: bool = False) -> dict:
    """A page's candidates; regions are the cleaned content areas in the order in which they count, chrome left out. ``whole``: ``terminated`` references only."""
    reader = _Reader()
    reader.feed(terminated(html or "") if whole else html or "")
    reader.close()
    while reader.open:
        _, _, region, _, _ = reader.open.pop()
        if region:
            reader.regions.append((region[0], region[1], len(reader.parts)))
    first = {}
    for rank, begin, end in sorted(reader.regions):
        first.setdefault(rank, _clean(reader.parts[begin:end]))
    role = lambda kind: next((_clean(t) for (k, _), t in sorted(reader.named.items()) if k == kind and _clean(t)), None)
    return {
        "heading": _clean(reader.heading) or None,
        "title": _clean(reader.title) or None,
        "metas": list(reader.metas.items()),
        "author": role("author"),
        "date": role("date"),
        "time": reader.time,
        "image": reader.image,
        "regions": list(first.values()),
        "body": _clean(reader.parts) or None,
        "links": [{"href": h, "text": t} for h, t in reader.links],
    }


def parts(html: Column | str, whole: bool = False) -> Column:
    """The candidates of whole pages as a struct; null and empty pages have none."""
    kind = pa.struct(
        [("heading", pa.string()), ("title", pa.string()), ("metas", pa.map_(pa.string(), pa.string())), *((c, pa.string()) for c in ("author", "date", "time", "image")), ("regions", pa.list_(pa.string())), ("body", pa.string()), ("links", pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())])))]
    )

    def run(pages: pa.Array) -> pa.Array:
        # what was read is packed every few pages: as Python objects it takes many times its size
        return pa.concat_arrays([pa.array([read(p.as_py(), whole) for p in pages.slice(k, PACKED)], kind) for k in range(0, max(1, len(pages)), PACKED)])

    # a page is walked once: what is not deterministic is not copied into the filters that the optimizer infers
    return F.arrow_udf(run, "struct<" + PARTS.replace(" map<", ":map<").replace(" array<", ":array<").replace(" string", ":string") + ">").asNondeterministic()(html)


def extracted(pages: DataFrame, now: str = "9000-01-01 00:00:00", feed_date: Column | None = None, whole: bool = False) -> DataFrame:
    """pages(page_id, url, html) as articles: title, author, published_at, content, image_url, excerpt, error, and the page's links.

    The title is the first heading, else og:title, else the page's title. The content is
    the first region of over REGION characters, else the body, without byline and
    dateline. The date goes through the waterfall of meta, selected text, url, text and feed.
    A page whose content has under 100 characters is an error of the kind empty. With
    ``whole``, only ``terminated`` references are resolved.
    """
    p = F.col("_p")
    meta = lambda *names: F.coalesce(*(F.try_element_at(p["metas"], F.lit(n)) for n in names))
    region = F.get(F.filter(p["regions"], lambda x: F.length(x) > REGION), 0)
    raw = F.coalesce(region, p["body"], F.lit(""))
    found = pages.select("page_id", "url", parts("html", whole).alias("_p"))
    said = F.coalesce(meta(*DATE_METAS), p["time"], p["date"])
    where = F.coalesce(F.get(p["regions"], 0), p["body"], F.lit(""))
    at = dates.waterfall(said, said, F.col("url"), where, feed_date, now)
    author = F.coalesce(text.clean_author(F.coalesce(meta(*AUTHOR_METAS), p["author"])), text.byline(raw))
    content = text.without_byline(raw)
    return found.select(
        "page_id",
        "url",
        F.coalesce(p["heading"], meta("og:title"), p["title"]).alias("title"),
        author.alias("author"),
        at.alias("published_at"),
        F.nullif(content, F.lit("")).alias("content"),
        F.coalesce(meta("og:image"), p["image"]).alias("image_url"),
        text.excerpt(content).alias("excerpt"),
        text.error_class(F.lit(200), F.length(raw)).alias("error"),
        p["links"].alias("links"),
    )


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _absolute(links: Column, url: Column) -> Column:
    """A page's links as (position, href, text, inner): absolute, without fragment; the page's host is found once, a link's form once."""
    scheme_of = F.regexp_extract(url, "^([a-z]+:)", 1)
    host_of = F.regexp_extract(url, r"^([a-z]+://[^/?#]*)", 1)

    def resolved(page: Column) -> Column:
        def one(link: Column, k: Column) -> Column:
            href = link["href"]
            whole = F.when(F.startswith(href, F.lit("//")), F.concat(page["scheme"], href)).when(F.startswith(href, F.lit("/")), F.concat(page["host"], href)).otherwise(href)
            return F.struct(k.alias("position"), F.substring_index(whole, "#", 1).alias("href"), link["text"].alias("text"))

        inner = lambda x: F.struct(x["position"].alias("position"), x["href"].alias("href"), x["text"].alias("text"), F.startswith(x["href"], page["host"]).alias("inner"))
        return F.transform(F.transform(links, one), inner)

    return _let(F.struct(scheme_of.alias("scheme"), host_of.alias("host")), resolved)


def all_links(found: DataFrame) -> DataFrame:
    """(page_id, url, position, href, text): every link of extracted pages, absolute and without its fragment."""
    return found.select("page_id", "url", F.explode(_absolute(F.col("links"), F.col("url"))).alias("l")).select("page_id", "url", "l.position", "l.href", "l.text")


def links(found: DataFrame, allow: list[str] | None = None, plain: bool = False) -> DataFrame:
    """(page_id, position, href, text): the links of extracted pages that lead to articles, the first of equal ones.

    They stay on the page's host, have a text of LINK_TEXT characters that says something,
    lead to no list or media, and match one of ``allow`` by path and query or, without such a
    list, have SEGMENTS path segments. ``plain`` is for a source whose articles are all
    below PLAIN_PATHS: links elsewhere go, and the others become https without query and final slash.
    """

    def leads(link: Column) -> Column:
        href, said = link["href"], link["text"]
        some = link["inner"] & F.length(said).between(*LINK_TEXT) & ~said.rlike(GENERIC_TEXT) & ~href.rlike(LIST_LINKS) & ~href.rlike(MEDIA_LINKS)
        if allow:
            return some & path_and_query(href).rlike("|".join(allow))
        return some & href.rlike(PLAIN_PATHS) if plain else some & (F.size(F.filter(F.split(text.url_path(href), "/"), lambda x: x != "")) >= SEGMENTS)

    some = found.select("page_id", F.explode(F.filter(_absolute(F.col("links"), F.col("url")), leads)).alias("l")).select("page_id", "l.position", "l.href", "l.text")
    if plain:
        bare = F.substring_index(F.regexp_replace("href", "^http:", "https:"), "?", 1)
        some = some.withColumn("href", F.regexp_replace(bare, "/$", ""))
    return some.groupBy("page_id", "href").agg(F.min(F.struct("position", "text")).alias("m")).select("page_id", "m.position", "href", "m.text")
