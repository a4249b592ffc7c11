"""Quality counts against the contract in plain Python, and the threshold table."""

import random
import re
from collections import Counter

from llm_support import ODD, docs_of
from pyspark.sql import functions as F

from pressloom.llm import catalog, quality_rules


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    repeated = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want = counts(texts[r.doc_id])
        assert tuple(r[k] for k in catalog.QUALITY_COLUMNS) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)


def test_query_over_odd_and_real_texts(spark, tmp_path, real):
    rng = random.Random(4)
    odd = [*ODD, *(" ".join(rng.choices("abcd", k=n)) for n in (3, 4, 10, 100, 400)), "x y z " * 30 + "tail", "a\na\n \nb\na", "a b c d " * 2, "a a a a"]
    docs_of(spark, odd).withColumnRenamed("n_chars", "n_words").write.parquet(f"{tmp_path}/documents.parquet")
    check(catalog.QUERIES["op5_quality_rules"](spark, str(tmp_path)).collect(), dict(enumerate(odd)))
    check(catalog.QUERIES["op5_quality_rules"](spark, "/root/testdata/sf0.001").collect(), {r.doc_id: r.text for r in real.collect()})
    docs_of(spark, []).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert catalog.QUERIES["op5_quality_rules"](spark, f"{tmp_path}/empty").count() == 0


def test_colliding_prefixes_fall_back_to_pairs(spark):
    low = [1, 2, 3, 1, 2, 3, 9]  # all in one prefix, so only the low bits tell them apart
    df = spark.createDataFrame([(low,), ([5 << 40, 6 << 40, 5 << 40],), ([],)], "k array<long>")
    assert [r.n for r in df.select(quality_rules._repeat_words(F.col("k")).alias("n")).collect()] == [8, 5, 0]


def test_table_is_one_expression_without_python(spark):
    clean = "The house of the rising sun is in the town and it was built for the people that live by the river. " + " ".join(f"word{i} of item{i}" for i in range(30))
    docs = docs_of(spark, [clean, clean.upper(), " | ".join(clean.split()), "\n".join(["Same line of the text"] * 9 + [clean])])
    judged = quality_rules.metrics(docs).select("doc_id", quality_rules.broken().alias("b"), quality_rules.verdict().alias("v"))
    got = {r.doc_id: (list(r.b), r.v) for r in judged.collect()}
    assert got[0] == ([], True) and got[1][0] == ["stop_words"] and got[2][0] == ["symbols"] and "repeated_lines" in got[3][0]
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    kept = quality_rules.keep(docs)
    assert [r.doc_id for r in kept.collect()] == [0] and kept.columns == docs.columns


def test_columns_of_clashing_names_stay(spark):
    """Columns named like the operator's own, in any case of letters, come through unchanged."""
    docs = docs_of(spark, [" ".join(f"the w{k}" for k in range(45)), "x", None, ""])
    names = ["_counts", "_W_words", "_w_lines", "_w_keys", "n_words", "a.b"]
    wide = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    kept = quality_rules.keep(wide, rules=())
    assert kept.columns == wide.columns and [tuple(r[n] for n in names) for r in kept.collect()] == [tuple(f"{n}0" for n in names)]
    counted = quality_rules.metrics(wide, out="c").orderBy("doc_id").collect()
    assert [r.c.n_words for r in counted] == [90, 1, 0, 0] and all(r[n] == f"{n}{r.doc_id}" for r in counted for n in names)
