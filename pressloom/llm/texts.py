"""Helpers of the operators that read texts in Python: long texts by pieces, and names for columns of their own."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters (or bytes) of a text that are split at once.
PIECE = 1 << 20
_SPACE = {str: re.compile(r"\s"), bytes: re.compile(rb"[\x20\x09-\x0D]")}


def pieces[T: (str, bytes)](text: T, size: int = PIECE) -> Iterator[T]:
    """A text cut at white space into parts of about ``size``; ``split()`` finds the same words in the parts as in the whole."""
    space, at = _SPACE[type(text)], 0
    while at < len(text):
        cut = space.search(text, at + size)
        end = cut.start() if cut else len(text)
        yield text[at:end] if at or cut else text
        at = end


def free_name(docs: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``docs`` has it in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def own(name: str) -> Column:
    """The column of exactly this name, whatever its characters."""
    return F.col("`" + name.replace("`", "``") + "`")
