"""License scans against every window of every text."""

import regex
from llm_support import ODD, docs_of

from pressloom.llm import catalog, licenses


def brute(texts, templates, containment=licenses.CONTAINMENT):
    out = {}
    sets = licenses.classes([len(licenses.shingles(t)) for t in templates.values()], containment)
    for i, text in texts.items():
        words = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
        grams = [" ".join(words[k : k + 5]) for k in range(len(words) - 4)]
        for name, template in templates.items():
            wanted = set(licenses.shingles(template))
            c = sets[len(wanted)]
            held = [(len(wanted & set(grams[s : s + c.window])) / len(wanted), s) for s in range(0, len(grams), c.step)]
            held = [x for x in held if x[0] >= containment]
            if held:
                out[i, name] = (max(held)[0], min(s for _, s in held), len(held))
    return out


def got(df):
    return {(r[0], r.license): (r.containment, r.first_word, r.n_windows) for r in df.collect()}


def test_scan_finds_whole_and_changed_notices(spark):
    mit, gpl = licenses.TEMPLATES["mit"], licenses.TEMPLATES["gpl-or-later"]
    filler = " ".join(f"filler{i}" for i in range(300))
    texts = [
        *ODD,
        *(f"{filler} {t} {filler}" for t in licenses.TEMPLATES.values()),
        mit.replace("sublicense", "relicense"),
        " ".join(mit.split()[: len(mit.split()) // 2]),
        gpl.upper() + filler + gpl,
        "license " * 2000,
        "released under the mit license",
        "released under the mit licence",
    ]
    docs = docs_of(spark, texts).withColumnRenamed("n_chars", "license")
    found = licenses.scan(docs).withColumnRenamed("id", "doc_id")
    assert got(found) == brute(dict(enumerate(texts)), licenses.TEMPLATES)
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()


def test_anchors_never_exclude_a_match():
    for name, text in licenses.TEMPLATES.items():
        words = set(licenses.anchors({name: text}))
        left = [s for s in licenses.shingles(text) if not words & set(s.split())]
        assert words and len(left) < licenses.CONTAINMENT * len(licenses.shingles(text))


def test_query_on_real_texts_and_none(spark, real, tmp_path):
    assert got(catalog.QUERIES["op9_licenses"](spark, "/root/testdata/sf0.001")) == brute({r.doc_id: r.text for r in real.collect()}, licenses.TEMPLATES)
    docs_of(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert catalog.QUERIES["op9_licenses"](spark, str(tmp_path)).count() == 0
