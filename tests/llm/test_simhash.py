"""SimHash components against all pairs of fingerprints."""

import random
from itertools import combinations

import numpy as np
import xxhash
from llm_support import ODD, docs_of

from pyspark.sql import functions as F

from pressloom.llm import catalog, components, joins, simhash
from pressloom.llm import texts as texts_module


def slow_fingerprint(text, words):
    found = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        found = found.replace(c, " ")
    found = [w for w in found.split(" ") if w]
    if not found:
        return 0
    grams = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def expected(texts, words=4, radius=4):
    fps = {i: slow_fingerprint(t, words) for i, t in texts.items()}
    near = [(a, b) for a, b in combinations(sorted(fps), 2) if (fps[a] ^ fps[b]).bit_count() <= radius]
    return {i: (f"{fps[i]:016x}", c) for i, c in groups(near, list(fps)).items()}


def test_query_over_odd_and_real_texts(spark, tmp_path, real):
    docs_of(spark, ODD).withColumnRenamed("n_chars", "fp").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in catalog.QUERIES["op1_simhash"](spark, str(tmp_path)).collect()}
    assert got == expected(dict(enumerate(ODD)))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in catalog.QUERIES["op1_simhash"](spark, "/root/testdata/sf0.001").collect()}
    assert got == expected({r.doc_id: r.text for r in real.collect()})
    docs_of(spark, []).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert catalog.QUERIES["op1_simhash"](spark, f"{tmp_path}/empty").count() == 0


def test_the_masks_cover_every_pair_within_the_radius():
    rng, table = random.Random(3), [m & (1 << 64) - 1 for m in simhash.masks(4)]
    assert len(table) == 31
    for _ in range(3000):
        differ = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(differ & m == 0 for m in table)


def test_links_of_clusters_and_large_buckets(spark, monkeypatch):
    """A hot bucket is compared by pairs of blocks; components are those of all pairs."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(5)
    fps = set()
    for base in rng.integers(0, 1 << 63, 12):
        for _ in range(25):
            flips = rng.choice(64, rng.integers(0, 4), replace=False)
            fps.add(int(base) ^ sum(1 << int(b) for b in flips))
    fps |= {int(x) << 40 for x in rng.integers(0, 1 << 20, 100)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4)
    got = [tuple(r) for r in links.collect()]
    mask = (1 << 64) - 1
    assert all(((a ^ b) & mask).bit_count() <= 4 for a, b in got)
    near = [(a, b) for a, b in combinations(sorted(signed), 2) if ((a ^ b) & mask).bit_count() <= 4]
    assert groups(got, signed) == groups(near, signed)


def test_components_of_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(7, 7), (None, 3), (200, 199), (199, 200)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    clean = [(a, b) for a, b in links if a is not None and a != b]
    assert got == groups(clean, {x for p in clean for x in p})
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_document_of_each_group_stays(spark):
    rows = [*ODD, *ODD[3:5]]
    docs = docs_of(spark, rows, ids=[*range(len(ODD)), None, 3])
    kept = simhash.drop_near_duplicates(docs, similar=False)
    assert kept.columns == docs.columns
    texts = {k: t for k, t in enumerate(ODD)}
    wanted = expected(texts, words=5)
    # the last row gives the component of document 4 a smaller id
    assert sorted(r.doc_id for r in kept.collect()) == sorted(3 if c == 4 else c for c in {c for _, c in wanted.values()})


def shingles(text, words=5):
    found = text.split()
    return {" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))}


def edited(words, edits, rng):
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"edit{rng.randint(0, 10**6)}"
    return out


def test_similar_texts_are_grouped_and_others_are_not(spark):
    """Copies with a shingle similarity of 0.83 or more meet; those below 0.6 and texts that share a passage do not."""
    rng, texts, wanted = random.Random(11), [], []
    passage = [f"w{rng.randint(0, 400)}" for _ in range(80)]
    for k in range(60):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(60, 600))]
        texts += [" ".join(base), " ".join(edited(base, max(1, len(base) // 90) if k % 2 else len(base) // 12, rng))]
    texts += [" ".join([f"w{rng.randint(0, 400)}" for _ in range(300)] + passage) for _ in range(40)]
    grams = [shingles(t) for t in texts]
    for a, b in combinations(range(len(texts)), 2):
        share = len(grams[a] & grams[b]) / len(grams[a] | grams[b])
        if share >= 0.83:
            wanted.append((a, b))
        else:
            assert share < 0.6 or share > 0.75
    docs = docs_of(spark, [*texts, *ODD, texts[1]])
    got = {r.id: r.component_id for r in simhash.group_documents(docs, words=5, similar=True).collect()}
    assert len(wanted) > 25 and all(got[a] == got[b] for a, b in wanted)
    far = [(a, b) for a, b in combinations(range(len(texts)), 2) if got[a] == got[b] and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) < 0.65]
    assert not far
    assert got[len(texts) + len(ODD)] == got[1]
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({*got.values()})


def test_similar_texts_in_a_large_bucket(spark, monkeypatch):
    """Hundreds of edited copies of one text, more than a block holds, form one group."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 400)}" for _ in range(400)]
    texts = [" ".join(edited(base, 1 + k % 3, rng)) for k in range(200)]
    assert {r.component_id for r in simhash.group_documents(docs_of(spark, texts), words=5, similar=True).collect()} == {0}


def test_similar_texts_of_the_tables(spark):
    """Of the pairs of different texts at 0.8 or more, nine in ten share a group."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r.text or "", r.doc_id)
    grams, met = {i: shingles(t.lower()) for t, i in texts.items() if t.split()}, {}
    for i, own in grams.items():
        for g in sorted(own, key=xxhash.xxh64_intdigest)[:12]:
            met.setdefault(g, []).append(i)
    near = {(a, b) for found in met.values() for a, b in combinations(sorted(found), 2) if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])}
    got = {r.id: r.component_id for r in simhash.group_documents(docs, words=5, similar=True).collect()}
    found = [p for p in near if got[p[0]] == got[p[1]]]
    print(len(found), "of", len(near))
    assert len(near) >= 40 and len(found) >= 0.9 * len(near)


def shared(a, b):
    return len(a & b) / len(a | b)


def test_texts_below_the_similarity_are_not_linked(spark, monkeypatch):
    """Between 0.7 and 0.9 a pair shares a group exactly if its shingles' similarity is 0.8 or more, in one block or in several."""
    rng, texts = random.Random(23), []
    for k in range(90):
        base = [f"p{k}w{rng.randint(0, 400)}" for _ in range(200)]
        copy = list(base)
        for at in range(6, 6 + 11 * (2 + k % 6), 11):
            copy[at] = f"edit{k}x{at}"
        texts += [" ".join(base), " ".join(copy)]
    grams = [shingles(t) for t in texts]
    near = {k: shared(grams[k], grams[k + 1]) for k in range(0, len(texts), 2)}
    wanted = {k: s >= 0.8 for k, s in near.items()}
    assert sum(0.7 < s < 0.8 for s in near.values()) >= 20 and sum(0.8 <= s < 0.9 for s in near.values()) >= 20
    # a chain: each text is similar to the next, its ends are not; and two groups that only candidates connect
    words, chain = [f"c{k}" for k in range(300)], []
    for k in range(8):
        words[10 + 30 * k] = f"new{k}"
        words[20 + 30 * k] = f"other{k}"
        chain.append(" ".join(words))
    sides, base = [], [f"s{k}" for k in range(200)]
    for k in range(40):
        side = list(base)
        for at in range(6, 6 + 11 * 5 * (k % 2), 11):
            side[at] = f"side{at}"
        side[-1] = f"own{k}"
        sides.append(" ".join(side))
    assert shared(shingles(chain[0]), shingles(chain[-1])) < 0.8 and 0.7 < shared(shingles(sides[0]), shingles(sides[1])) < 0.8
    every = texts + chain + sides
    for block in (simhash.BLOCK, 4):
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = {r.id: r.component_id for r in simhash.group_documents(docs_of(spark, every), words=5, similar=True, radius=0).collect()}
        assert {k: got[k] == got[k + 1] for k in near} == wanted
        assert len({got[k] for k in range(len(texts), len(texts) + 8)}) == 1
        assert [got[len(texts) + 8 + k] - got[len(texts) + 8] for k in range(40)] == [k % 2 for k in range(40)]


def test_columns_of_clashing_names_stay_and_long_texts_are_read_by_pieces(spark, monkeypatch):
    rows = docs_of(spark, ["a b c d e f g", "a b c d e f g", None, "other words than these are here"])
    names = ["_near_id", "_NEAR_hash", "fp", "representative", "n", "a.b"]
    wide = rows.withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    kept = simhash.drop_near_duplicates(wide)
    assert kept.columns == wide.columns
    assert sorted((r.doc_id, *(r[n] for n in names)) for r in kept.collect()) == [(i, *(f"{n}{i}" for n in names)) for i in (0, 2, 3)]
    texts = ["", "one", "two words", "a b c d", "A b c d e", " x\ty\nz " * 40, "\u00e9t\u00e9 \u65e5\u672c " * 30]
    whole = [simhash.shingle_hashes(t, w).tolist() for t in texts for w in (1, 4, 5)]
    monkeypatch.setattr(simhash, "pieces", lambda t: texts_module.pieces(t, 7))
    assert [simhash.shingle_hashes(t, w).tolist() for t in texts for w in (1, 4, 5)] == whole


def test_pieces_have_the_words_of_the_whole():
    for text in ["", " ", "abc", "  a bb\tccc\x0bd\u2003e " * 20, "x" * 500 + " y"]:
        for size in (1, 3, 50):
            parts = list(texts_module.pieces(text, size))
            assert "".join(parts) == text and [w for p in parts for w in p.split()] == text.split()
            raw = text.encode()
            assert [w for p in texts_module.pieces(raw, size) for w in p.split()] == raw.split()


def test_hot_keys_are_met_by_broadcast(spark, monkeypatch):
    """A key with most of all rows and many rare ones, null keys and an empty table; components with a hub."""
    monkeypatch.setattr(joins, "HOT", 100)
    monkeypatch.setattr(components, "HOT", 100)
    rows = spark.createDataFrame([(1, i) for i in range(5000)] + [(k, k) for k in range(2, 300)] + [(None, -1)], "k long, v long")
    table = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    found = joins.join_skewed(rows, table, "k", "n", 5299)
    assert "BroadcastHashJoin" in found._jdf.queryExecution().toString()
    assert found.columns == ["k", "v", "top"] and found.count() == 5298
    assert found.where("k = 1 and top = 4999").count() == 5000 and found.where("k > 1 and top = k").count() == 298
    assert joins.join_skewed(rows.limit(0), table.limit(0), "k", "n", 0).count() == 0
    rng = random.Random(4)
    pairs = [(7, i) for i in range(100, 900)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(300)] + [(100, 1000)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == groups([p for p in pairs if p[0] != p[1]], sorted({x for p in pairs if p[0] != p[1] for x in p}))
