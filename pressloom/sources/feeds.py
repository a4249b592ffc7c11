"""News feeds as a Spark data source: ``spark.read.format("feed")`` and ``spark.readStream.format("feed")``.

Reads RSS 2.0 items and Atom entries of the XML files of a folder, a file to a
partition, in any store that pyarrow reaches. Filters on ``published`` are taken by the
batch reader: entries out of their range are not given to Spark. A stream's offset is
the last file by time and name.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from xml.etree import ElementTree

import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from pressloom.operators.crawl import FEED_YEAR

SCHEMA = "title string, link string, pub_date string, description string, image_url string, published timestamp, file string"
_IMAGE = re.compile(r"src=['\"](https?://[^'\"]+)['\"]", re.IGNORECASE)
_RANGE = {GreaterThan: lambda x, y: x > y, GreaterThanOrEqual: lambda x, y: x >= y, LessThan: lambda x, y: x < y, LessThanOrEqual: lambda x, y: x <= y}


def _bare(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _time(said: str | None) -> tuple[datetime | None, bool]:
    """(a mail or ISO date in UTC, whether it is a mail date); none for others."""
    for parse, mail in ((parsedate_to_datetime, True), (datetime.fromisoformat, False)):
        try:
            found = parse((said or "").strip())
            return found.replace(tzinfo=found.tzinfo or UTC).astimezone(UTC), mail
        except (ValueError, TypeError, OverflowError):
            pass
    return None, False


def entries(data: bytes) -> Iterator[tuple]:
    """The rows of a feed's text but their file; what follows a fault in the text is not read."""
    try:
        for _, element in ElementTree.iterparse(io.BytesIO(data), events=("end",)):
            if _bare(element.tag) in ("item", "entry"):
                yield from _entry(element)
                element.clear()
    except ElementTree.ParseError:
        return


def _entry(element: ElementTree.Element) -> Iterator[tuple]:
    """One row, or none: without a link or id, or dated before FEED_YEAR by a mail date."""
    said: dict[str, str] = {}
    for child in element:
        name = _bare(child.tag)
        if name == "link" and child.get("href"):
            value = child.get("href") if child.get("rel", "alternate") == "alternate" else ""
        else:
            value = "".join(child.itertext()).strip()
        if value:
            said.setdefault(name, value)
    link = said.get("link") or said.get("guid") or said.get("id")
    date = said.get("pubDate") or said.get("published") or said.get("updated") or said.get("date")
    published, mail = _time(date)
    if not link or mail and published.year < FEED_YEAR:
        return
    about = said.get("description") or said.get("summary") or said.get("content")
    image = _IMAGE.search(about or "")
    yield said.get("title", "Untitled"), link, date, about, image and image[1], published


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (pyarrow.fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[int, str]]:
    """(time of change, path) of a folder's feeds, or of one file, in order."""
    store, where = _open(path)
    info = store.get_file_info(where)
    found = [info] if info.type == pyarrow.fs.FileType.File else store.get_file_info(pyarrow.fs.FileSelector(where, recursive=True))
    return sorted((f.mtime_ns or 0, f.path) for f in found if f.type == pyarrow.fs.FileType.File and (f is info or f.extension in ("xml", "rss", "atom")))


class _Reading:
    """What both readers share."""

    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("a feed needs a path")
        self.path, self.filters = options["path"], []

    def read(self, partition: _File) -> Iterator[tuple]:
        store = _open(self.path)[0]
        with store.open_input_stream(partition.path) as data:
            for row in entries(data.read()):
                if all(row[5] is not None and _RANGE[type(f)](row[5], f.value.replace(tzinfo=f.value.tzinfo or UTC)) for f in self.filters):
                    yield (*row, partition.path)


class _Batch(_Reading, DataSourceReader):
    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if type(f) in _RANGE and f.attribute == ("published",) and isinstance(f.value, datetime):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[_File]:
        return [_File(p) for _, p in _files(self.path)]


class _Stream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"time": -1, "file": ""}

    def latestOffset(self) -> dict:
        found = _files(self.path)
        return {"time": found[-1][0], "file": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[_File]:
        low, high = ((o["time"], o["file"]) for o in (start, end))
        return [_File(p) for t, p in _files(self.path) if low < (t, p) <= high]


class Feed(DataSource):
    """Option ``path``: a folder, searched with those below it, or one file."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format ``feed`` known to a session, and lets its readers take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Feed)
