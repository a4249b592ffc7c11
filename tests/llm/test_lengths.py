"""Length histograms against plain counting."""

from llm_support import ODD, docs_of
from pyspark.sql import functions as F

from pressloom.llm import bpe, catalog, lengths


def brute(ns):
    return {
        x: (ns.count(x), sum(n >= x for n in ns), sum(n for n in ns if n >= x), sum(n <= x for n in ns), sum(n for n in ns if n <= x), sum(min(n, x) for n in ns), sum(n <= x for n in ns) / len(ns))
        for x in set(ns)
    }


def rows_of(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_suffix_sums_over_many_blocks(spark):
    ns = [0, 0, 1, 5, 255, 256, 256, 257, 5000, 100_000, 5000, 70]
    df = lengths.context_limits(lengths.histogram(spark.createDataFrame([(n,) for n in [*ns[:-1], 70]], "block long"), F.col("block")))
    assert rows_of(df) == brute(ns)
    wanted = [0, 3, 256, 4999, 10**6]
    got = {r.wanted: (r.total_truncated, r.docs_over) for r in lengths.at_limits(df, wanted).collect()}
    assert got == {x: (sum(min(n, x) for n in ns), sum(n > x for n in ns)) for x in wanted}
    for q in (0.01, 0.5, 0.9, 1.0):
        assert lengths.quantile(df, q).first().length == min(x for x in ns if sum(n <= x for n in ns) >= q * len(ns))


def test_nulls_count_as_zero_and_no_rows_give_none(spark):
    df = lengths.histogram(spark.createDataFrame([(None,), (0,), (2,)], "n long"), F.col("n"))
    assert {tuple(r) for r in df.collect()} == {(0, 2), (2, 1)}
    assert lengths.context_limits(lengths.histogram(spark.createDataFrame([], "n long"), F.col("n"))).count() == 0


def test_query_counts_whole_texts(spark, tmp_path):
    import public_tokenizers
    import tiktoken

    docs_of(spark, ODD).write.parquet(f"{tmp_path}/documents.parquet")
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert rows_of(catalog.QUERIES["op8_lengths"](spark, str(tmp_path))) == brute([len(enc.encode_ordinary(t or "")) for t in ODD])
