"""Hard negatives, the Jaccard join and the ranked search against brute force and their SQL; topics at any partitioning."""

from collections import Counter

import duckdb
import numpy as np
import pytest
from test_operators import SF, near_brute

from sparksheet.llm import lexical, mixing, negatives, parity, queries
from sparksheet.llm.hashing import shingle_sets


@pytest.mark.parametrize("name", ["op11_negatives", "op12_jaccard", "op13_lexical"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_sql(spark, name, sf):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    want = duck.execute(queries.ORACLES[name]).fetchall()
    got = queries.QUERIES[name](spark, f"/root/testdata/{sf}").collect()
    assert sorted(want) == sorted(tuple(r) for r in got) and want


def negatives_brute(rows, every=50):
    """rows: (id, label, whole vector)."""
    out = []
    for a, label, v in rows:
        if a % every:
            continue
        scored = sorted((-int(v @ w), i, other) for i, other, w in rows if i != a)
        for p, i, _ in [x for x in scored if x[2] == label][:5]:
            fit = [(s, j) for s, j, other in scored if other != label and 50 * -p <= 100 * -s <= 95 * -p][:3]
            out += [(a, i, k + 1, j, -p, -s) for k, (s, j) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [4096, 40])
def test_negatives_of_odd_rows(spark, block_rows):
    """Lengths of many buckets, short and null vectors, null labels, ties, repeated rows, clashing column names."""
    r = np.random.default_rng(1)
    rows = [(i, int(i % 3), [float(x) for x in r.normal(0, 1 + i % 5, 6)]) for i in range(300)]
    rows += [(i, 0, [1.0] * 6) for i in range(300, 310)] + [(310, None, [1.0] * 6), (311, 0, None), (312, 1, [float("nan")] * 6), (313, 1, [2.0]), (314, 2, []), (None, 1, [1.0] * 6)]
    pad = lambda x: np.floor(256 * np.array(x + [0.0] * (6 - len(x)))).astype(int)
    want = negatives_brute([(i, g, pad(x)) for i, g, x in rows if i is not None and g is not None and x is not None and not any(map(np.isnan, x))], every=10)
    df = spark.createDataFrame([(*x, 0, "y") for x in rows + rows[:20]], "vec_id long, label int, embedding array<double>, bucket int, Query string")
    got = negatives.mine(df, every=10, block_rows=block_rows, query_rows=5)
    assert sorted(tuple(x) for x in got.collect()) == want and want
    assert negatives.mine(df.limit(0)).collect() == []


def test_negatives_prune(spark):
    """Groups of ten labels each, within the groups a label's vectors are nearest: negatives come from the own group, most products are never made."""
    r = np.random.default_rng(5)
    v = np.repeat(r.normal(0, 1, (20, 32)), 100, axis=0) + np.repeat(0.28 * r.normal(0, 1, (200, 32)), 10, axis=0) + 0.05 * r.normal(0, 1, (2000, 32))
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    rows = [(i, i // 10 % 10) for i in range(2000)]
    df = spark.createDataFrame([(i, g, [float(x) for x in v[i]]) for i, g in rows], "vec_id long, label int, embedding array<float>")
    made = spark.sparkContext.accumulator(0)
    got = negatives.mine(df, every=20, block_rows=250, made=made)
    assert sorted(tuple(x) for x in got.collect()) == negatives_brute([(i, g, np.floor(256 * v[i].astype(float)).astype(int)) for i, g in rows], every=20)
    assert 0 < made.value < 0.4 * 100 * 2000


def test_negatives_beyond_doubles(spark):
    r = np.random.default_rng(2)
    rows = [(i, i % 2, [float(x) for x in r.integers(-(10**6), 10**6, 4)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    want = negatives_brute([(i, g, np.array([256 * int(x) for x in v], object)) for i, g, v in rows], every=10)
    assert sorted(tuple(x) for x in negatives.mine(df, every=10).collect()) == want and want


def test_sketches_meet_every_link(spark):
    """Sets at the edge of the similarity meet, whatever else shares their chunks, and their sketches never differ in more bits than the sets in shingles."""
    r = np.random.default_rng(7)
    sets, links = [], []
    common = [r.integers(0, 2**64, 60, dtype=np.uint64) for _ in range(3)]
    for n in [*range(1, 40), 63, 64, 127, 128, 300, 1023, 1025, 4000]:
        for i in range(8):
            a = np.unique(np.concatenate([r.integers(0, 2**64, n, dtype=np.uint64), common[i % 3][: n // 2]]))
            m = parity.most_apart(len(a), len(a), 85)
            b = np.unique(np.concatenate([r.permutation(a)[int(r.integers(0, m + 1)) :], r.integers(0, 2**64, int(r.integers(0, m + 1)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            bits = int(np.bitwise_count((parity.sketch(a) ^ parity.sketch(b)).view(np.uint64)).sum())
            assert bits <= len(a) + len(b) - 2 * both
            if 0 < both < max(len(a), len(b)) and 100 * both >= 85 * (len(a) + len(b) - both):
                links.append((len(sets), len(sets) + 1))
            sets += [a, b]
    rows = [(int(k), f) for f, s in enumerate(sets) for k in parity.entries_of(s, 85).view(np.int64)]
    each = spark.createDataFrame(rows, "key long, f long")
    classes = spark.createDataFrame([(f, len(s)) for f, s in enumerate(sets)], "f long, n long")
    met = {}
    for x in parity.meeting(each, classes, 85).collect():
        met.setdefault(x["f"], set()).add(x["key"])
    assert len(links) > 60 and all(met.get(a, set()) & met.get(b, set()) for a, b in links) and sum(map(len, met.values())) < 0.5 * len(rows)


def test_jaccard_of_families_and_odd_rows(spark):
    """A family of near copies, of which many are apart from one another, texts that share a long passage, and odd rows."""
    r = np.random.default_rng(3)
    base, shared = [f"w{i}" for i in r.integers(0, 5000, 150)], [f"p{i}" for i in range(60)]
    rows = []
    for i in range(90):
        w = list(base)
        for p in r.choice(150, r.integers(0, 7), replace=False):
            w[p] = f"x{r.integers(0, 10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(shared + [f"y{x}" for x in r.integers(0, 10**6, 5 + i % 9)])) for i in range(60)]
    rows += [(200, ""), (201, "A b"), (202, "a B"), (203, "a b c d e"), (204, " ".join(shared) + " "), (205, " ".join(base * 80))]
    want = near_brute(rows, 4, 85)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows] + [(201, "A b", "x", 1), (None, "a b", "x", 1), (206, None, "x", 1)], "doc_id long, text string, key string, F int")
    got = parity.jaccard_groups(df).collect()
    assert len(got) == len(rows) + 3
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got if x["doc_id"] not in (None, 206)} == want
    assert [(x["n_shingles"], x["component_id"]) for x in got if x["doc_id"] in (None, 206)] in ([(1, None), (0, 206)], [(0, 206), (1, None)])
    assert parity.jaccard_groups(df.limit(0)).collect() == []


def test_jaccard_looks_through_its_chunks_part_by_part(spark, monkeypatch):
    """No step shuffles all chunks at once, copies in several tasks are one set, and the parts together are all that sets share."""
    r = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    made = [" ".join([*base[:180], *(f"x{i}" for i in r.integers(0, 10**6, 1 + i % 12))]) for i in range(60)]
    rows = list(enumerate(made * 3))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    seen, cut = [], parity.cut
    monkeypatch.setattr(parity, "cut", lambda t: seen.append(cut(t)) or seen[-1])
    monkeypatch.setattr(parity, "discard", lambda *t: None)
    got = {x["doc_id"]: x["component_id"] for x in parity.jaccard_groups(df).collect()}
    assert got == {k: c for k, (_, c) in near_brute(rows, 4, 85).items()}
    parts = [{(x["key"], x["f"]): x["held"] for x in t.collect()} for t in seen if "held" in t.columns]
    sets = {parity.set_hash(s): s for s in shingle_sets(made, 4)}
    many = Counter(k for s in sets.values() for k in parity.entries_of(s, 85).view(np.int64).tolist())
    want = {(k, f): many[k] for f, s in sets.items() for k in parity.entries_of(s, 85).view(np.int64).tolist() if many[k] > 1}
    assert {k: n for p in parts for k, n in p.items()} == want and sum(map(len, parts)) == len(want)
    assert len(parts) >= 4 and max(map(len, parts)) < 0.5 * len(want)


@pytest.mark.parametrize("size", [dict(), dict(shard_postings=200, item_terms=7), dict(most_terms=0), dict(most_terms=0, shard_postings=90)])
def test_search_of_odd_rows(spark, size):
    """Ties among repeated texts, null and empty texts and ids, repeated items, terms that no document has; by brute force."""
    import math
    import re

    r = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)] + ["É", "漢字", "x9"]
    docs = [(i, " ".join(words[j] for j in np.minimum(r.geometric(0.07, r.integers(1, 40)) - 1, 62))) for i in range(150)]
    docs += [(200 + i, "w1 w2 w50 W50") for i in range(30)] + [(300, None), (301, ""), (302, " --- "), (None, "w1 w1 É"), (303, "w3 " * 5000)]
    items = [(1, "w1 w50 w50"), (2, "W2, É!"), (3, "nowhere"), (4, None), (5, "w0 w1 w2 w3 w4 w5 w6 漢字 x9"), (5, "w50"), (2, "W2, É!"), (None, "w1")]
    terms = lambda t: [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    counts = [(i, terms(t)) for i, t in docs]
    n, total = sum(1 for _, t in counts if t), sum(len(t) for _, t in counts)
    weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(1 for _, t in counts if w in t) + 1))) for w in {w for _, t in counts for w in t}}
    want = []
    for item, texts in ((1, ["w1 w50 w50"]), (2, ["W2, É!"]), (5, ["w0 w1 w2 w3 w4 w5 w6 漢字 x9", "w50"])):
        asked = [w for t in texts for w in terms(t) if w in weight]
        scored = sorted((-sum(weight[w] * (10**9 * t.count(w) // (1000 * t.count(w) + 8 * (25 + 75 * len(t) * n // total))) for w in asked), i) for i, t in counts if i is not None and t)
        want += [(item, k + 1, i, -s) for k, (s, i) in enumerate([x for x in scored if x[0] < 0][:10])]
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, ID int, terms int").repartition(3)
    q = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, I int")
    assert sorted(tuple(x) for x in lexical.rank_documents(d, q, **size).collect()) == sorted(want)
    assert lexical.rank_documents(d.limit(0), q).collect() == [] and lexical.rank_documents(d, q.limit(0)).collect() == []


def test_range_maxima_prune():
    """Tables answer every interval; of many documents only few are scored for an item of rare terms."""
    r = np.random.default_rng(6)
    terms, places, impacts = r.integers(0, 50, 4000).astype(np.int64), r.integers(0, 3000, 4000), r.integers(1, 10**6, 4000)
    keep = np.unique(terms * 3000 + places, return_index=True)[1]
    x = lexical.Postings(terms[keep], places[keep], impacts[keep], 3000)
    for lo, hi in r.integers(x.first[3], x.first[4] + 1, (200, 2)):
        at, most = x.largest(np.array([min(lo, hi)]), np.array([max(lo, hi)]))
        assert most[0] == x.impacts[min(lo, hi) : max(lo, hi)].max(initial=0)
    scored = []
    weights = np.array([5, 1, 7])
    where, scores = x.best(np.array([3, 9, 20]), weights, 10, scored.append)
    full = np.zeros(3000, np.int64)
    for t, w in zip((3, 9, 20), weights, strict=True):
        own = x.keys[x.first[t] : x.first[t + 1]] - t * 3000
        full[own] += w * x.impacts[x.first[t] : x.first[t + 1]]
    want = np.lexsort((np.arange(3000), -full))[:10]
    assert where.tolist() == want.tolist() and scores.tolist() == full[want].tolist() and sum(scored) < 120


def test_mixing_at_any_partitioning(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {tuple(sorted(tuple(r) for r in mixing.mix(docs.repartition(n) if n else docs).collect())) for n in (0, 1, 7, 64)}
    assert len(seen) == 1


def test_pipeline_keeps_the_callers_columns(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"n_lines": F.lit(7), "Removed": F.lit("mine"), "n_removed": F.col("doc_id")})
    got = corpus_pipeline.line_dedup(spark, docs, SF)
    assert got.schema == docs.schema or [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
    assert got.where("n_lines <> 7 or Removed <> 'mine' or n_removed <> doc_id").isEmpty() and got.count() == docs.count()


def test_chunks_of_different_shingles_never_meet():
    """Sets without a common shingle share empty chunks alone, however many they are."""
    r = np.random.default_rng(5)
    sets = [np.sort(r.integers(0, 2**64, 180, np.uint64)) for _ in range(3000)]
    keys = [parity.chunk_keys(s, parity.band_of(180), 85) for s in sets]
    found, held = np.unique(np.concatenate(keys), return_counts=True)
    empty = parity.chunk_keys(np.zeros(0, np.uint64), parity.band_of(180), 85)
    assert len(keys[0]) == len(empty) > 20 and set(found[held > 1].tolist()) <= set(empty.tolist())
    # One shingle more or less changes one chunk.
    assert all((parity.chunk_keys(np.delete(s, i), parity.band_of(180), 85) != k).sum() == 1 for s, k in zip(sets[:20], keys, strict=False) for i in (0, 90, 179))
