"""Byte-level BPE through a sentencepiece model serialised from a rank file.

A rank file lists the vocabulary as base64 bytes and merge rank. Every byte is
mapped to one printable character, every vocabulary entry becomes a piece of such
characters scored by its negative rank, and the normaliser is the identity, so
sentencepiece's best-score merges are the lowest-rank merges. Texts are split by the
pattern first and each pre-token is encoded by itself; decoding looks the ids up in
the inverse table. The serialised model (a few MB, fixed by the vocabulary) is all
that is broadcast.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import accumulate, chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Bytes of encoded pre-tokens in each of the two generations that a worker remembers besides those of the texts at hand.
REMEMBERED = 20_000_000
#: Bytes that an entry takes beside its pre-token and ids.
ENTRY = 150
#: Pre-tokens of more characters are not remembered.
LONGEST = 256
#: Characters of texts that are encoded together.
CHUNK = 1 << 20
#: The vocabulary must fit a broadcast.
LARGEST_VOCABULARY = 1_000_000


def byte_characters() -> list[str]:
    """The character of each byte: itself where printable, else from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protobuf field: varint, 32-bit float or length-delimited."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value & (1 << 64) - 1)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(vocabulary: Sequence[bytes]) -> bytes:
    """A serialised sentencepiece BPE model; piece 0 is unknown, piece rank+1 is the vocabulary's."""
    letters = byte_characters()
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)]
    pieces += [_field(1, "".join(letters[b] for b in token).encode()) + _field(2, float(-rank)) for rank, token in enumerate(vocabulary)]
    trainer = _field(3, 2) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary of a rank file, by rank; ranks must be 0, 1, 2 and so on."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    if sorted(ranks) != list(range(len(ranks))) or len(ranks) > LARGEST_VOCABULARY:
        raise ValueError(f"{path}: not a gapless vocabulary of at most {LARGEST_VOCABULARY} ranks")
    return [ranks[i] for i in range(len(ranks))]


def plain_pattern(pattern: str) -> str | None:
    """``pattern`` for the standard library's ``re``, over characters up to U+FFFF: \\p{L}, \\p{N}, \\s and \\S as ranges.

    None where the pattern holds anything that the two engines might read differently.
    """
    low = "".join(chr(i) for i in range(1 << 16) if not 0xD800 <= i < 0xE000)

    def ranges(of: str) -> str:
        return "".join(f"\\u{ord(m[0][0]):04x}-\\u{ord(m[0][-1]):04x}" for m in regex.finditer(of + "+", low))

    out, inside = [], False
    for m in regex.finditer(r"(?s)\\[pP]\{[^}]*\}|\\.|\(\?[:=!]|\(\?|\[\^?|.", pattern):
        part = m[0]
        if part in (r"\p{L}", r"\p{N}", r"\s"):
            out.append(ranges(part) if inside else f"[{ranges(part)}]")
        elif part == r"\S" and not inside:
            out.append(f"[^{ranges(chr(92) + 's')}]")
        elif (part[0] == "\\" and (part[1].isalnum() or len(part) > 2)) or part == "(?":
            return None
        else:
            inside = part.startswith("[") or (inside and part != "]")
            out.append(part)
    return "".join(out)


class Splitter:
    """The pre-tokens of a text: its matches of ``pattern``, found by ``re`` where that gives the same, else by ``regex``."""

    def __init__(self, pattern: str):
        self.full = regex.compile(pattern)
        plain = plain_pattern(pattern)
        self.plain = None if plain is None else re.compile(plain)

    def _of(self, text: str):
        fits = self.plain is not None and (text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text))
        return self.plain if fits else self.full

    def __call__(self, text: str) -> list[str]:
        return self._of(text).findall(text)

    def parts(self, text: str, size: int) -> Iterator[list[str]]:
        """The same, ``size`` pre-tokens at a time."""
        found = (m[0] for m in self._of(text).finditer(text))
        while part := list(islice(found, size)):
            yield part


class Codec:
    """Encodes and decodes in one Python worker.

    Encoded pre-tokens are remembered in two generations of REMEMBERED bytes: a full one
    replaces the older, and what of the older is met again moves on, so frequent ones stay.
    """

    def __init__(self, vocabulary: tuple[bytes, ...], pattern: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(vocabulary))
        self.vocabulary = vocabulary
        # entries that are no UTF-8 are no pre-tokens
        texts = ((token.decode(errors="replace"), token, rank) for rank, token in enumerate(vocabulary))
        self.whole = {text: rank.to_bytes(4, "little") for text, token, rank in texts if text.encode() == token}
        self.split = Splitter(pattern)
        self.letters = dict(enumerate(byte_characters()))
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = self.extra = 0

    def _learn(self, tokens: set[str]) -> None:
        """A pre-token that is itself in the vocabulary is its own id; the rest are merged, all in one call."""
        recent, new = self.recent, tokens.difference(self.recent)
        for held in (self.older, self.whole):
            met = {t: held[t] for t in new if t in held}
            recent.update(met)
            new.difference_update(met)
        if new:
            # no UTF-8 text has a byte 255
            raw = b"\xff".join([t.encode() for t in new]).decode("latin-1").translate(self.letters).split(self.letters[255])
            found = self.pieces.encode(raw, num_threads=1)
            data = (np.fromiter(chain.from_iterable(found), "<i4") - 1).tobytes()
            ends = [4 * n for n in accumulate(map(len, found))]
            recent.update(zip(new, [data[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
            self.extra += sum(map(len, new)) + len(data)
        self.held = len(recent) * ENTRY + self.extra

    def _ids(self, lists: list[list[str]]) -> list[bytes]:
        """The ids of lists of pre-tokens, each as the bytes of 32-bit integers."""
        tokens = set().union(*lists)
        self._learn(tokens)
        get = self.recent.__getitem__
        out = [b"".join(map(get, own)) for own in lists]
        if self.held > REMEMBERED:
            self.older, self.recent, self.held, self.extra = self.recent, {}, 0, 0
            for token in [t for t in self.older if len(t) > LONGEST]:
                del self.older[token]
        return out

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, as the bytes of 32-bit integers; texts are taken in groups of about CHUNK characters, longer ones in parts."""
        group, size = [], 0
        for text in texts:
            text = text or ""
            if size + len(text) > CHUNK and group:
                yield from self._ids(group)
                group, size = [], 0
            if len(text) > CHUNK:
                yield b"".join(chain.from_iterable(self._ids([part]) for part in self.split.parts(text, CHUNK // 4)))
            else:
                group.append(self.split(text))
                size += len(text)
        if group:
            yield from self._ids(group)

    def decode(self, ids: np.ndarray) -> bytes:
        get = self.vocabulary.__getitem__
        return b"".join(b"".join(map(get, ids[at : at + CHUNK].tolist())) for at in range(0, len(ids), CHUNK))


@lru_cache(maxsize=1)
def _codec(vocabulary: tuple[bytes, ...], pattern: str) -> Codec:
    return Codec(vocabulary, pattern)


class ByteBPE:
    """Column functions for one rank file, read once on the driver.

    path: a rank file; pattern: the split into pre-tokens, each encoded separately.
    Null and empty texts have no ids; null ids decode to empty bytes; an id outside
    the vocabulary is an error. No special tokens exist, so their strings are text.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, pattern: str = public_tokenizers.PATTERN):
        self.vocabulary = spark.sparkContext.broadcast(tuple(read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))))
        self.pattern = pattern

    def encode(self, text: Column | str) -> Column:
        """The ids of whole texts, array<int>."""
        vocabulary, pattern = self.vocabulary, self.pattern

        def run(texts: pa.Array) -> pa.Array:
            ids = list(_codec(vocabulary.value, pattern).encode(t.as_py() for t in texts))
            offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)))
            flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))])
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)

        return F.arrow_udf(run, "array<int>")(text)

    def decode(self, ids: Column | str) -> Column:
        """The bytes that ids stand for."""
        vocabulary, pattern = self.vocabulary, self.pattern

        def run(ids: pa.Array) -> pa.Array:
            codec = _codec(vocabulary.value, pattern)
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            if len(flat) and not 0 <= flat.min() <= flat.max() < len(codec.vocabulary):
                raise ValueError("an id outside the vocabulary")
            ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            return pa.array([codec.decode(flat[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())

        return F.arrow_udf(run, "binary")(ids)

    def count(self, text: Column | str) -> Column:
        """The number of ids of whole texts, without the ids themselves."""
        vocabulary, pattern = self.vocabulary, self.pattern

        def run(texts: pa.Array) -> pa.Array:
            codec = _codec(vocabulary.value, pattern)
            return pa.array([len(ids) // 4 for ids in codec.encode(t.as_py() for t in texts)], pa.int64())

        return F.arrow_udf(run, "long")(text)
