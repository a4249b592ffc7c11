"""Byte-level BPE against the tiktoken library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_support import ODD, docs_of

from pressloom.llm import bpe, catalog

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = bpe.read_ranks(PATH)
ENC = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(VOCABULARY)}, special_tokens={})
CODEC = bpe.Codec(VOCABULARY, public_tokenizers.PATTERN)


def ids_of(text):
    return np.frombuffer(next(CODEC.encode([text])), "<i4")


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text_encodes_as_tiktoken_and_decodes_back(text):
    ids = ids_of(text)
    assert ids.tolist() == ENC.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text(st.characters(max_codepoint=127)), st.text(" \n\t\x1c\x85\u2028\u3000a\u00e9\u4e001\u00bd.'s")))
def test_both_engines_split_alike(text):
    wanted = regex.findall(public_tokenizers.PATTERN, text)
    assert CODEC.split(text) == wanted
    assert [t for part in CODEC.split.parts(text, 3) for t in part] == wanted


def test_patterns_that_engines_may_read_differently_stay_with_regex():
    assert bpe.plain_pattern(r"\p{Lu}+") is None and bpe.plain_pattern(r"(?i:a)|\w") is None and bpe.plain_pattern(r"[^\S]") is None
    assert bpe.Codec(tuple(VOCABULARY), r"\p{Lu}|.").split("aB") == ["a", "B"]


def test_generations_and_long_texts_change_no_ids(monkeypatch):
    """With memory for a few pre-tokens and groups of a few characters the ids stay the same."""
    monkeypatch.setattr(bpe, "REMEMBERED", 2000)
    monkeypatch.setattr(bpe, "CHUNK", 64)
    codec = bpe.Codec(tuple(VOCABULARY), public_tokenizers.PATTERN)
    texts = [None, "", *(f"Some word{k % 7} and thing{k} " * (k % 5) for k in range(200)), "y" * 1000, "\n \n  x" * 300]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == ENC.encode_ordinary(text or "")
    assert len(codec.recent) + len(codec.older) < 60


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = ENC.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_query_over_odd_and_real_texts(spark, tmp_path, real):
    odd = [*ODD, "<|endoftext|>", "ab" * 20_000, "▁ ▁▁ <unk> <0x41>"]
    docs_of(spark, odd).withColumnRenamed("n_chars", "ids").write.parquet(f"{tmp_path}/documents.parquet")
    check(catalog.QUERIES["op3_byte_bpe"](spark, str(tmp_path)).collect(), dict(enumerate(odd)))
    check(catalog.QUERIES["op3_byte_bpe"](spark, "/root/testdata/sf0.001").collect(), {r.doc_id: r.text for r in real.collect()})
    docs_of(spark, []).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert catalog.QUERIES["op3_byte_bpe"](spark, f"{tmp_path}/empty").count() == 0


def test_an_unknown_id_is_an_error_and_gaps_are_refused(tmp_path):
    with pytest.raises(IndexError):
        CODEC.decode(ids_of("a") + 60_000)
    (tmp_path / "ranks").write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(tmp_path / "ranks"))
