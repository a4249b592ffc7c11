"""The text, date and vector functions under SQL names."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from pressloom.functions import text
from pressloom.operators import pages


def _analyzed(columns: dict[str, DataType], least: int, given: tuple[AnalyzeArgument, ...]) -> AnalyzeResult:
    """The result of a table function of ``least`` strings or one more; anything else is refused when the query is analysed."""
    if not least <= len(given) <= least + 1 or any(not isinstance(a.dataType, StringType) or a.isTable for a in given):
        raise ValueError(f"{least} or {least + 1} strings are expected")
    return AnalyzeResult(StructType([StructField(c, kind) for c, kind in columns.items()]))


class HtmlLinks:
    """html_links(html, url[, allow]): the links of a page that lead to articles, by the rules of ``pages.links``."""

    @staticmethod
    def analyze(*given: AnalyzeArgument) -> AnalyzeResult:
        return _analyzed({"position": LongType(), "href": StringType(), "text": StringType()}, 2, given)

    def eval(self, page: str | None, url: str | None, allow: str | None = None) -> Iterator[tuple]:
        host = re.match(r"[a-z]+://[^/?#]*", url or "")
        host, seen = host[0] if host else "", set()
        for k, link in enumerate(pages.read(page)["links"]):
            href, said = link["href"], link["text"]
            if href.startswith("//"):
                href = host.split("//")[0] + href
            elif href.startswith("/"):
                href = host + href
            href = href.split("#")[0]
            if not href.startswith(host) or not pages.LINK_TEXT[0] <= len(said) <= pages.LINK_TEXT[1] or re.search(pages.GENERIC_TEXT, said) or re.search(pages.LIST_LINKS, href) or re.search(pages.MEDIA_LINKS, href):
                continue
            rest = href[len(host) :]
            rest = rest if rest.startswith("/") else "/" + rest
            leads = re.search(allow, rest) if allow else sum(map(bool, rest.split("?")[0].split("/"))) >= pages.SEGMENTS
            if leads and href not in seen:
                seen.add(href)
                yield k, href, said


class HtmlExtract:
    """html_extract(html): title, content, author, date and image of a page, as the page has them; one row, of nulls where it has none."""

    @staticmethod
    def analyze(*given: AnalyzeArgument) -> AnalyzeResult:
        return _analyzed(dict.fromkeys(("title", "content", "author", "date", "image_url"), StringType()), 1, given[:1] if len(given) == 1 else ())

    def eval(self, page: str | None) -> Iterator[tuple]:
        found = pages.read(page)
        metas = dict(found["metas"])
        first = lambda names: next((metas[n] for n in names if n in metas), None)
        content = next((r for r in found["regions"] if len(r) > pages.REGION), found["body"])
        yield (
            found["heading"] or metas.get("og:title") or found["title"],
            content,
            first(pages.AUTHOR_METAS) or found["author"],
            first(pages.DATE_METAS) or found["time"] or found["date"],
            metas.get("og:image") or found["image"],
        )


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL and returns their names.

    compose_text, unescape_html: Arrow functions. normalize_text, normalize_title,
    detect_language, url_host, url_path, cosine: SQL expressions over built-in functions and these.
    html_links, html_extract: table functions for lateral joins.
    """
    tables = {"html_links": HtmlLinks, "html_extract": HtmlExtract}
    for name, table in tables.items():
        spark.udtf.register(name, F.udtf(table))

    def compose(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())

    def unescape(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else html.unescape(t) for t in texts.to_pylist()], pa.string())

    spark.udf.register("compose_text", F.arrow_udf(compose, "string"))
    spark.udf.register("unescape_html", F.arrow_udf(unescape, "string"))
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    mended = "unescape_html(compose_text(t))"
    for bad, good in text.MOJIBAKE.items():
        mended = f"replace({mended}, {quoted(bad)}, {quoted(good)})"
    first = f"slice(split(regexp_replace(t, {quoted('^' + text.SPACES)}, ''), {quoted(text.SPACES)}), 1, {text.FIRST_WORDS})"
    sinhala = f"length(regexp_replace(substring(t, 1, {text.SAMPLE}), {quoted(r'[^\x{0D80}-\x{0DFF}]')}, '')) > 0.1 * length(substring(t, 1, {text.SAMPLE}))"
    made = {
        "normalize_text(t STRING) RETURNS STRING": f"trim(regexp_replace({mended}, {quoted(text.SPACES)}, ' '))",
        "normalize_title(t STRING) RETURNS STRING": rf"regexp_replace(lower(compose_text(t)), {quoted(r'[^\p{L}\p{N}_\x{200C}\x{200D}]')}, '')",
        "detect_language(t STRING) RETURNS STRING": f"CASE WHEN coalesce(t, '') = '' THEN 'en' WHEN {sinhala} OR arrays_overlap({first}, array({', '.join(map(quoted, text.SINHALA))})) THEN 'si' ELSE 'en' END",
        "url_host(u STRING) RETURNS STRING": f"regexp_extract(u, {quoted(r'^[a-z]+://([^/?#]*)')}, 1)",
        "url_path(u STRING) RETURNS STRING": f"regexp_extract(u, {quoted(r'^[a-z]+://[^/?#]*([^?#]*)')}, 1)",
        "cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    }
    for head, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return ["compose_text", "unescape_html", *(h.split("(")[0] for h in made), *tables]
