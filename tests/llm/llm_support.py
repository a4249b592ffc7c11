"""Fixtures and helpers of these tests."""

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, schema=SCHEMA, ids=None):
    ids = ids if ids is not None else list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", f"src{k % 3}", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], schema)


#: Null, empty, blank, control characters, several scripts, repeats, very long.
ODD = [None, "", " \t\n\x0b\x0c\r", "one", "a b c", "\x00 nul\x1f", "été ñandú über 日本語 😀", "a b c", "Word " * 3000, "x" * 100_000, "a b c", "</s>[INST] \\e \\l <|turn:x|> <|end|>\n"]
