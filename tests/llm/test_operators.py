"""Each operator against brute force on small real tables, and on rows that are null, empty, equal or very long."""

import hashlib
import re
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparksheet.llm import langid, licenses, lines, media, mixing, neardup, packing, quality, secrets, topk
from sparksheet.llm.graphs import components
from sparksheet.llm.queries import op7_secrets, op10_licenses, tokenizer_path

SF = "/root/testdata/sf0.001"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, equal rows, clashing names."""
    long = "lorem ipsum dolor sit amet " * 3000
    rows = [(1, None, "s", None, "x"), (2, "", None, "en", "x"), (3, "same text of some words that is long enough", "s", "en", None), (3, "same text of some words that is long enough", "s", "en", None), (4, "same text of some words that is long enough", "s", "en", None), (5, long, "s", "fr", "x"), (6, "é ß 漢字́ <|endoftext|> It's x", "t", "de", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, f string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def test_media(docs, texts, odd, none):
    for r in media.png_features(media.to_png(docs)).collect():
        raw = texts[r["doc_id"]].encode()
        want = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
    got = media.png_features(media.to_png(odd)).collect()
    assert len(got) == 7 and len({r["feature"] for r in got if r["doc_id"] in (3, 4)}) == 1
    assert media.png_features(media.to_png(none)).collect() == []


def test_png_filters_and_damage():
    kinds = np.array([0, 1, 2, 3, 4, 4, 3, 3, 1, 4, 2, 0], np.uint8)
    body = np.random.default_rng(1).integers(0, 256, (len(kinds), 16), dtype=np.uint8)
    out = media.unfilter(kinds, body).astype(int)
    for i, kind in enumerate(kinds):
        for j in range(16):
            a, b, c = out[i, j - 1] if j else 0, out[i - 1, j] if i else 0, out[i - 1, j - 1] if i and j else 0
            p = a + b - c
            paeth = min((a, b, c), key=lambda v: abs(p - v))  # noqa: B023  ties to the first
            assert out[i, j] == (int(body[i, j]) + [0, a, b, (a + b) // 2, paeth][kind]) % 256
    png = media.encode_png(bytes(range(256)) * 9)
    assert media.decode_png(png).tobytes() == bytes(range(256)) * 9
    with pytest.raises(ValueError):
        media.decode_png(png[:40] + b"\0" + png[41:])


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_packing(request, table):
    from tokenizers import Tokenizer

    df, tok = request.getfixturevalue(table), Tokenizer.from_file(tokenizer_path())
    got = packing.pack(packing.tokenize(df, tokenizer_path())).toPandas()
    want = []
    for r in df.collect():
        ids = np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [0], np.uint32)
        want += [(r["doc_id"], i, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for i, at in enumerate(range(0, len(ids), 2048))]
    assert sorted(want) == sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))
    for _, x in got.sort_values("offset").groupby("sequence_id"):
        assert (x["offset"] == x["length"].cumsum() - x["length"]).all() and x["length"].sum() <= 2048
    if len(got):
        assert got["sequence_id"].nunique() <= got["length"].sum() / 2048 + 2


def test_packing_over_many_tasks(spark):
    """As few sequences as there can be, up to a thousandth, however many tasks pack."""
    r = np.random.default_rng(1)
    sizes = np.concatenate([r.lognormal(5, 1, 20000).astype(int) % 2048 + 1, np.full(2000, 2048), r.integers(1100, 1500, 2000)])
    df = spark.createDataFrame([(int(n),) for n in sizes], "length long").repartition(64)
    got = packing.pack(df).toPandas()
    assert sorted(got["length"]) == sorted(sizes)
    for _, x in got.sort_values("offset").groupby("sequence_id"):
        assert (x["offset"] == x["length"].cumsum() - x["length"]).all() and x["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= 1.001 * sizes.sum() / 2048 + 1


def near_brute(texts, width, least=80):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(AZ))
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return {i: (len(s), label[i]) for i, s in sets.items()}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(docs, texts, width):
    want = near_brute(texts.items(), width)
    for r in neardup.near_duplicates(docs, width).collect():
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_of_a_family_and_odd_rows(spark, odd, none):
    r = np.random.default_rng(3)
    base = [f"w{i}" for i in r.integers(0, 5000, 120)]
    rows = []
    for i in range(90):
        w = list(base)
        for p in r.choice(120, r.integers(0, 9), replace=False):
            w[p] = f"x{r.integers(0, 10**6)}"
        rows.append((i, " ".join(w)))
    want = near_brute(rows, 5)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == want
    got = {(x["doc_id"], x["component_id"], x["kept"]) for x in neardup.near_duplicates(odd).collect()}
    assert got == {(1, 1, True), (2, 2, True), (3, 3, True), (4, 3, False), (5, 5, True), (6, 6, True)}
    assert neardup.near_duplicates(none).collect() == []


@pytest.mark.parametrize("name", ["op6_neardup", "op8_topk"])
def test_against_sql(spark, name):
    from sparksheet.llm import queries

    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = duck.execute(queries.ORACLES[name]).fetchall()
    got = queries.QUERIES[name](spark, SF).collect()
    assert sorted(want) == sorted(tuple(r) for r in got) and want


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 2), (7, 7)], "a long, b long")
    assert {(r["node"], r["label"]) for r in components(links).collect()} == {(5, 2), (4, 2), (3, 2), (2, 2), (9, 8), (8, 8)}


def test_edit_distance():
    r, xs, ys = np.random.default_rng(7), [], []
    for _ in range(3000):
        x = "".join(r.choice(list("abé𝒳"), r.integers(0, 45)))
        y = list(x)
        for _ in range(r.integers(0, 8)):
            y[(i := int(r.integers(0, len(y) + 1))) : i + int(r.integers(0, 2))] = list("ab"[: r.integers(0, 3)])
        xs.append(x)
        ys.append("".join(y))
    want = np.array([distance(x, y) for x, y in zip(xs, ys, strict=True)])
    for most in (0, 1, 2, 5, 31):
        assert (lines.edits_within(xs, ys, most, cells=5000) == (want <= most)).all()
    with pytest.raises(ValueError):
        lines.edits_within(["a"], ["b"], 32)


@pytest.mark.parametrize(("threshold", "wide"), [(1, 32), (1, 2), (2, 32)])
def test_lines(spark, docs, odd, none, threshold, wide):
    r = np.random.default_rng(5)
    base = "the quick brown fox jumps over the lazy dog"
    made = []
    for i in range(60):
        s = list(base)
        for _ in range(r.integers(0, 3)):
            s[r.integers(0, len(s))] = "xyz"[r.integers(0, 3)]
        made.append((i, "".join(s) + f"\nshort\n\n \t\nshor{i % 3}\n" + base[: 30 + i % 12]))
    df = spark.createDataFrame(made, "doc_id long, text string").union(docs.limit(40).selectExpr("doc_id + 1000", "text"))
    rows = sorted((x["doc_id"], k, s) for x in df.collect() for k, s in enumerate((x["text"] or "").split("\n")) if s.strip())
    different = sorted({s for *_, s in rows})
    label = {s: s for s in different}
    pairs = [(a, b) for i, a in enumerate(different) for b in different[i + 1 :] if min(len(a), len(b)) >= 20 and abs(len(a) - len(b)) <= threshold and distance(a, b) <= threshold]
    for _ in range(len(different)):
        before = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    seen, gone = set(), set()
    for i, k, s in rows:
        if label[s] in seen:
            gone.add((i, k))
        seen.add(label[s])
    got = lines.dedup_lines(df, threshold, wide=wide).collect()
    assert {(x["doc_id"], k) for x in got for k in x["removed"]} == gone
    whole = {x["doc_id"]: x["text"] for x in df.collect()}
    for x in got:
        assert x["text"] == "\n".join(s for k, s in enumerate(whole[x["doc_id"]].split("\n")) if k not in set(x["removed"]))
    assert sorted((x["doc_id"], x["n_removed"]) for x in lines.dedup_lines(odd).collect())[2:5] == [(3, 0), (3, 0), (4, 1)]
    assert lines.dedup_lines(none).collect() == []


def test_lines_of_clashing_columns_and_many_lines(spark):
    many = "\n".join(f"line number {i:06d} of a very long text" for i in range(0, 10**6, 11))
    df = spark.createDataFrame([(1, many, 7, 8, 9), (2, many + "\none more line that is its own", 7, 8, 9)], "doc_id long, text string, _id int, _gone int, gone int")
    got = {r["doc_id"]: r for r in lines.dedup_lines(df).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["text"] == "one more line that is its own" and (got[2]["_id"], got[2]["_gone"], got[2]["gone"]) == (7, 8, 9)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_lines_of_shifted_digits(spark):
    """More than `wide` lines of one template, whose rests without a character agree though the lines are two edits apart."""
    head, r = "the total amount of this order comes to: ", np.random.default_rng(9)
    made = []
    for _ in range(12):
        mid = "".join(r.choice(list("0123456789"), 6))
        x, y = r.choice(list("0123456789"), 2, replace=False)
        made += [f"{z}{mid}" for z in "0123456789"[: r.integers(1, 4)]] + [mid + x, mid + y] + [mid] * int(r.integers(0, 2)) + [mid[:3] + mid[2] + mid[3:]]
    made = sorted({head + m for m in made} | {head + "aab", head + "acb"})
    label = list(range(len(made)))
    near = [(i, j) for i in range(len(made)) for j in range(i) if distance(made[i], made[j]) <= 1]
    for _ in made:
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    got = lines.dedup_lines(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).collect()
    assert len(made) > 32 and {x["doc_id"] for x in got if x["removed"]} == {i for i, k in enumerate(label) if k < i}


def test_secrets(spark, texts, odd, none):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    for r in op7_secrets(spark, SF).collect():
        t = texts[r["doc_id"]]
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        shown = ",".join(f"{secrets.KINDS[k]}:{a}:{z}" for a, k, z in sorted(spans))
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
    assert len(secrets.find_secrets(odd).collect()) == 7 and secrets.find_secrets(none).collect() == []


def test_secret_network_held_out():
    r = np.random.default_rng(2)
    word = lambda a, n: "".join(r.choice(list(a), n))
    made = [(secrets.windows(f"key is {word('0123456789abcdef', 32)} ok", 7, 39)[0], 1.0) for _ in range(300)] + [(secrets.windows(f"mail me at {word('abcdefghij', 12)}.example.com now", 11, 35)[0], 0.0) for _ in range(300)]
    x, y = secrets.codes([w for w, _ in made]), np.array([k for _, k in made])
    net, held = secrets.Network(), np.arange(600) % 3 == 0
    net.fit(x[~held], y[~held])
    net.calibrate(x[held], y[held], 0.99)
    hit = net.scores(x[held]) >= net.threshold
    assert hit[y[held] == 1].mean() >= 0.98 and hit[y[held] == 0].mean() <= 0.05


def test_secret_recall_on_documents(spark):
    """Learned from the documents' own findings, the threshold keeps the asked share of the held-out ones, and all of them at 1."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = secrets.sample(df, "text", 500)
    for recall in (0.8, 0.99, 1.0):
        net = secrets.train(got, recall)
        assert net.recall >= recall and 0 < net.threshold <= 1


def test_secret_threshold_keeps_recall_below_one_half():
    """Positives that look like most negatives score low; the threshold follows them down."""
    r = np.random.default_rng(6)
    word = lambda a: "".join(r.choice(list(a), 20))
    x = secrets.codes([secrets.windows(f"it is {word('0123456789')} ok", 6, 26)[0] for _ in range(100)] + [secrets.windows(f"it is {word('abcdefghij')} ok", 6, 26)[0] for _ in range(520)])
    y = np.repeat([1.0, 0.0], [120, 500])
    net = secrets.Network()
    net.fit(x, y)
    net.calibrate(x, y, 0.99)
    assert net.threshold < 0.5 and (net.scores(x)[y == 1] >= net.threshold).mean() >= 0.99


def test_secrets_of_few_characters(spark):
    """Values under 16 characters or with other signs are scored, and each finding's own value is what is learned from."""
    r = np.random.default_rng(8)
    word = lambda a, n: "".join(r.choice(list(a), n))
    mixed, low = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789", "etaoinshrdlu"
    made = [" ".join(word(low, r.integers(4, 11)) for _ in range(30)) + f" password: {word(mixed, 11)} " + " ".join(word(low, r.integers(4, 11)) for _ in range(9)) for _ in range(200)]
    made += [f"use pwd: Tr0ub4dor9x then {word(low, 8)}", "run it with --passphrase q7RtY2mZ here", 'set password: p@s5!W#4rD9 there', "nothing to be seen around here"]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    net = secrets.Network()
    net.threshold = 0.0
    got = {x["doc_id"]: [made[x["doc_id"]][s["from"] : s["to"]] for s in x["spans"] if s["kind"] == "network"] for x in secrets.add_network(df, net).collect()}
    assert "Tr0ub4dor9x" in got[200] and "q7RtY2mZ" in got[201] and "p@s5!W#4rD9" in got[202] and "nothing" in got[203]
    negatives, positives = secrets.sample(df, "text", 150)
    assert len(negatives) == len(positives) == 150 and all(b"\0" not in w[0][24:35] and w[0][35:72] == bytes(37) for w in positives)
    net = secrets.train([negatives, positives])
    assert net.recall >= 0.99 and 0 < net.precision <= 1
    long = "key token: " + "k" * 60 + "Q9" * 20
    t = secrets.Texts([made[0], long, "a:b=c'pass@word/x1'"])
    values = [t.codes[lo:hi].size for lo, hi in t.values.tolist()]
    assert values == [11, 100] and len([x for _, x in t.windows(t.values[1:]) for _ in x]) == 3
    net, best = secrets.Network(), np.zeros(len(t.free))
    for own, x in t.windows(t.free):
        np.maximum.at(best, own, net.scores(x))
    texts = [made[0], long, "a:b=c'pass@word/x1'"]
    for (lo, hi), p in zip(t.free.tolist(), best, strict=True):
        k = int(np.searchsorted(t.start, lo, "right")) - 1
        z = net.raw(secrets.codes(secrets.windows(texts[k], lo - int(t.start[k]), hi - int(t.start[k])))).max()
        assert abs(1 / (1 + np.exp(-z)) - p) < 1e-5


def test_secrets_are_learned_from_all_candidates(spark):
    """Every finding and every other candidate of every task is counted, the threshold is by all findings, and scores from the texts are those of the windows."""
    r = np.random.default_rng(12)
    word = lambda a, n: "".join(r.choice(list(a), n))
    made = [f"{word('etaoinshrdlu', 9)} token={word('ABCDEFGH23456789', 14)} {word('etaoinshrdlu', 7)} \0 {word('xyz', 60)}" for _ in range(2600)]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)
    t = secrets.Texts(made)
    net, positives, negatives = secrets.learn(df, "text", secrets.ROUNDS)
    assert (positives, negatives) == (2600, len(t.free)) and negatives > 5000
    best = np.full(len(t.free), 0.0)
    for own, x in t.windows(t.free):
        np.maximum.at(best, own, net.scores(x))
    assert np.abs(1 / (1 + np.exp(-net.best(t, t.free))) - best).max() < 1e-5
    z = net.best(t, t.values)
    least, bins = secrets.least_score(df, "text", net, 0.9)
    step = 1 / secrets.BINS / 4096
    assert sum(bins.values()) == 2600 and (z >= least).sum() >= 0.9 * 2600 > (z >= least + step).sum() - 1
    found = secrets.find_secrets(df).select("spans.score").collect()
    assert len(found) == 2600 and all(0 <= s <= 1 for x in found for s in x["score"])
    assert (net.best(t, t.free) >= least).mean() < 0.05


def test_secret_scores_share_the_texts_convolution():
    """Scores from the texts are those of the windows at bodies of every length, at a third of their CPU time at most."""
    r = np.random.default_rng(14)
    word = lambda n: "".join(r.choice(list("etaoinshrdluABC0123456789"), n))
    odd = [f"{'é ' * (n % 3)}{word(n)}{'!' * (n % 7)} {word(6)}\0" for n in range(1, 160)] + ["", word(48), word(96), word(43), "x" * 49, "k:" * 99]
    many = [" ".join(word(n) for n in r.integers(2, 12, 200)) for _ in range(200)]
    net, spent = secrets.Network(3), []
    for made in (odd, many):
        t = secrets.Texts(made)
        spent = [[], []]
        for _ in range(3):
            at, best = time.process_time(), np.full(len(t.free), 0.0)
            for own, x in t.windows(t.free):
                np.maximum.at(best, own, net.scores(x))
            middle = time.process_time()
            z = net.best(t, t.free)
            spent[0].append(middle - at)
            spent[1].append(time.process_time() - middle)
        assert len(z) > 300 and np.abs(1 / (1 + np.exp(-z)) - best).max() < 1e-5
    assert min(spent[1]) < min(spent[0]) / 3


def test_secret_network_steps_follow_the_gradient():
    """A step's gradients are the differences of the loss, for every kind of weight."""
    r = np.random.default_rng(15)
    word = lambda n: "".join(r.choice(list("abcdef0123 é"), n))
    x = secrets.codes([secrets.windows(word(90), int(lo), int(lo) + 6 + int(n))[0] for lo, n in zip(r.integers(0, 40, 30), r.integers(0, 42, 30), strict=True)])
    y, weight, net = (np.arange(30) % 3 == 0).astype(float), r.uniform(0.01, 0.1, 30), secrets.Network()
    net.p["b"] += 0.05
    moments = net.moments()
    was = {k: v.copy() for k, v in net.p.items()}
    net.step(x, y, weight, moments)
    net.p = was
    loss = lambda: float((weight * (np.logaddexp(0, net.raw(x)) - y * net.raw(x))).sum())
    for k, v in net.p.items():
        for i in r.choice(v.size, min(v.size, 60), replace=False):
            old, both = v.flat[i], []
            for d in (1e-6, -1e-6):
                v.flat[i] = old + d
                both.append(loss())
            v.flat[i] = old
            assert abs((both[0] - both[1]) / 2e-6 - 10 * moments[k][0].flat[i]) < 1e-6


def test_secret_fixed_detectors_by_their_patterns():
    """Quick looks ahead of the patterns leave no finding out."""
    r = np.random.default_rng(16)
    parts = ["AKIA", "AKIAAKIA", "0123456789abcdef" * 2, "deadbeef", "F00D", "toKEN", "to\u212aen", "Api_Key", "aPIkey", "rapid", "PASSWD", "password", "secret", "'", '"', " ", " ", ":", "=", "x" * 5, "hunter2hunter2", "ABCDEFGH01234567", "\u0130", "\ud800", "é", "\0", "\n"]
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    kinds = set()
    for _ in range(6000):
        t = "".join(r.choice(parts, r.integers(1, 12)))
        spans = [(m.start(), 0, m.end(), *m.span(2)) for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end(), *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end(), *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert secrets.detect(t) == sorted(spans)
        kinds |= {x[1] for x in spans}
    assert kinds == {0, 1, 2}


def test_licenses(spark, texts, odd, none):
    for r in op10_licenses(spark, SF).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r["doc_id"]].translate(AZ))
        at = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and 0 <= r["score"] <= 1
    one = spark.createDataFrame([(1, "Foo. Permission is hereby granted, free of charge, to any really lucky person obtaining a copy of this software and associated documentation files bar")], "doc_id long, text string")
    assert [s["label"] for s in licenses.scan_licenses(one).first()["spans"]] == ["mit"]
    assert len(licenses.scan_licenses(odd).collect()) == 7 and licenses.scan_licenses(none).collect() == []


def test_license_chains_and_repeats(spark):
    """A text that repeats a template of repeated words is one long chain of diagonals: it is cut, not dropped.  Equal rows keep their rows."""
    df = spark.createDataFrame([(1, "x " + "la li lo " * 60)] * 2 + [(2, "la li lo"), (3, None)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], len(r["spans"])) for r in licenses.scan_licenses(df, templates=[("song", "la li lo la li lo la li lo la li lo")], slip=3).collect())
    assert got[:2] == [(1, 181, got[0][2])] * 2 and got[0][2] > 5 and got[2:] == [(2, 3, 0), (3, 0, 0)]
    for s in licenses.scan_licenses(df, templates=[("song", "la li lo la li lo la li lo la li lo")], slip=3).first()["spans"]:
        assert s["last"] - s["first"] + 1 <= 36 and s["score"] == 1


def test_license_spans_by_brute_force(spark):
    """Templates with words dropped, inserted and changed between other words, against voting done plainly."""
    r, rows = np.random.default_rng(2), []
    known = licenses.TEMPLATES[1:9]
    for i in range(60):
        w = known[i % len(known)][1].split()
        for _ in range(i % 4):
            w[(j := int(r.integers(0, len(w)))) : j + int(r.integers(0, 2))] = ["other"] * int(r.integers(0, 2))
        rows.append((i, " ".join([f"w{x}" for x in r.integers(0, 50, 12)] + w + [f"w{x}" for x in r.integers(0, 50, 9)])))
    got = {x["doc_id"]: {(s["template"], s["first"], s["last"], round(s["score"], 9)) for s in x["spans"]} for x in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates=known).collect()}
    for i, text in rows:
        w, want = text.split(), set()
        for t, (_, template) in enumerate(known):
            p = template.split()
            hits = sorted((a - b, a, b) for a in range(len(w) - 2) for b in range(len(p) - 2) if w[a : a + 3] == p[b : b + 3])
            runs = []
            for h in hits:
                if runs and h[0] - runs[-1][-1][0] <= 2:
                    runs[-1].append(h)
                else:
                    runs.append([h])
            for x in runs:
                score = len({b for *_, b in x}) / (len(p) - 2)
                if score >= 0.6:
                    want.add((t, min(a for _, a, _ in x), max(a for _, a, _ in x) + 2, round(score, 9)))
        assert got[i] == want


def test_license_templates_of_few_words(spark):
    df = spark.createDataFrame([(1, "Public Domain public domain, public domain: do wtfpl it"), (2, "domain public"), (3, "mit license now")], "doc_id long, text string")
    known = [("mit", "mit license now"), ("pd", "public domain"), ("wtfpl", "WTFPL"), ("none", "...")]
    got = {r["doc_id"]: [(s["label"], s["template"], s["first"], s["last"], s["score"]) for s in r["spans"]] for r in licenses.scan_licenses(df, templates=known).collect()}
    assert got == {1: [("pd", 1, i, i + 1, 1.0) for i in (0, 2, 4)] + [("wtfpl", 2, 7, 7, 1.0)], 2: [], 3: [("mit", 0, 0, 2, 1.0)]}


def test_top_k(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(0, 1 + i % 7, 8)]) for i in range(400)] + [(400, [1.0] * 8), (401, [1.0] * 8), (402, None), (403, [float("nan")] * 8), (404, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = {i: np.floor(1024 * np.array(x + [0.0] * (8 - len(x)))).astype(int) for i, x in rows if x is not None and not any(map(np.isnan, x))}
    want = [(q, k + 1, i, -s) for q in v if q % 100 == 0 for k, (s, i) in enumerate(sorted((-int(v[q] @ v[i]), i) for i in v if i != q)[:10])]
    for block in (4096, 32):
        assert sorted(tuple(x) for x in topk.top_k(df, block_rows=block, query_rows=2).collect()) == sorted(want)
    assert topk.top_k(df.limit(0)).collect() == []


def test_top_k_prunes(spark):
    """Vectors of one length about fifty centres: most groups and most vectors of the others are never multiplied."""
    r = np.random.default_rng(5)
    centres = r.normal(0, 1, (50, 32))
    v = np.repeat(centres, 40, axis=0) + 0.05 * r.normal(0, 1, (2000, 32))
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<float>")
    seen = spark.sparkContext.accumulator(0)
    got = sorted(tuple(x) for x in topk.top_k(df, every=20, products=seen).collect())
    w = np.floor(1024 * v.astype(np.float32).astype(float)).astype(int)
    want = [(q, k + 1, i, -s) for q in range(0, 2000, 20) for k, (s, i) in enumerate(sorted((-int(w[q] @ w[i]), i) for i in range(2000) if i != q)[:10])]
    assert got == sorted(want) and 0 < seen.value < 0.1 * 100 * 2000


def test_mixing(docs, odd, none):
    got = mixing.mix(docs).toPandas()
    topic = F.when(F.length("text") > 900, "long").otherwise("short")
    table = mixing.mix(docs, driver_cells=0, rounds=4, close=1.0, topic=topic).toPandas()
    few = mixing.mix(docs, rounds=4, close=1.0, topic=topic).toPandas()
    assert np.allclose(few.sort_values("doc_id")["p"], table.sort_values("doc_id")["p"])
    assert len(got) == docs.count() and got["p"].between(0, 1 + 1e-9).all()
    assert len(mixing.mix(odd).collect()) == 7 and mixing.mix(none).collect() == []


@pytest.mark.parametrize("asked", [None, {"lang": {"en": 0.5, "de": 0.2}}])
def test_mixing_meets_its_targets(spark, asked):
    """Recomputed from the rows: every marginal of the expected tokens is at its target, and no probability over 1."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix(df, targets=asked).toPandas()
    got["w"] = got["p"] * got["tokens"]
    assert got["p"].max() <= 1 + 1e-9 and got["topic"].nunique() > 6 and 0.2 * got["tokens"].sum() < got["w"].sum() <= 0.8 * got["tokens"].sum() + 1
    for d in mixing.DIMS:
        size = got.groupby(d)["tokens"].sum()
        goal = pd.Series({k: (asked[d].get(k, n / size.sum()) if asked and d in asked else n**0.7) for k, n in size.items()})
        assert (got.groupby(d)["w"].sum() / got["w"].sum() - goal / goal.sum()).abs().max() <= 1.001e-3
    sure, never = got[got["p"] >= 1 - 1e-9], got[(got["p"] <= 1e-9) & (got["tokens"] > 0)]
    assert sure["keep"].all() and not never["keep"].any() and abs(got["keep"].mean() - got["p"].mean()) < 0.05


def test_topics_tell_vocabularies_apart(spark):
    r = np.random.default_rng(3)
    rows = [(i, " ".join(f"{'abc'[i % 3]}{k}" for k in r.integers(0, 60, 40))) for i in range(150)]
    got = mixing.with_topics(spark.createDataFrame(rows, "id long, t string"), topics=6).toPandas()
    assert got["topic"].nunique() >= 3 and got.assign(of=got["id"] % 3).groupby("topic")["of"].nunique().eq(1).mean() >= 0.8


def test_raking_meets_targets():
    at = [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])]
    w = mixing.rake(at, np.array([100.0, 50.0, 80.0, 120.0]), [np.array([0.5, 0.5]), np.array([0.4, 0.6])], 200.0)
    assert np.allclose(np.bincount(at[0], w), [100, 100]) and np.allclose(np.bincount(at[1], w), [80, 120], rtol=1e-3)


def test_quality_held_out(spark, docs, odd, none):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.classify(big, labels.where("doc_id % 3 > 0")).toPandas().merge(labels.where("doc_id % 3 = 0").toPandas(), on="doc_id")
    assert ((got["p_quality"] >= 0.5) == (got["quality"] == 1)).mean() >= 0.88
    assert len(quality.classify(odd, labels).collect()) == 7 and quality.classify(none, labels).collect() == []
    assert all(r["keep"] for r in quality.classify(docs, labels.limit(0)).collect())


def test_site_evidence_by_brute_force(spark):
    """Shares of a document's site without its own label, shrunk path to host to all, recomputed row by row."""
    r = np.random.default_rng(4)
    x = pd.DataFrame({"id": range(400), "host": [f"h{i}" for i in r.integers(0, 9, 400)]})
    x["path"] = x["host"] + "/" + pd.Series([str(i) for i in r.integers(0, 3, 400)])
    x["own_n"] = r.integers(0, 3, 400).clip(0, 1)
    lean = x["host"].str[1:].astype(int) / 10 + 0.05
    x["own_y"], x["own_z"] = [(x["own_n"] * (r.random(400) < p)).astype(float) for p in (lean, 0.1)]
    got, means = quality.site_evidence(spark.createDataFrame(x))
    got = got.toPandas().set_index("id")

    def strength(site, parent, c):
        s = x[x["own_n"] > 0].groupby([parent, site] if parent else site)[["own_n", c]].sum().reset_index()
        s["of"] = s[parent] if parent else 0
        n, chance, room, level, total = 0.0, 0.0, 0.0, 0.0, 0.0
        for _, g in s.groupby("of"):
            m = g[c].sum() / g["own_n"].sum()
            total += (g["own_n"] * (g[c] / g["own_n"] - m) ** 2).sum()
            chance += (len(g) - 1) * m * (1 - m)
            room += g["own_n"].sum() - (g["own_n"] ** 2).sum() / g["own_n"].sum()
            level += g["own_n"].sum() * m * (1 - m)
            n += g["own_n"].sum()
        between = (total - chance) / room
        return float(np.clip((level / n - between) / max(between, 1e-9), 1, 10_000))

    logit = lambda p: np.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    for c in ("y", "z"):
        mean = x[f"own_{c}"].sum() / x["own_n"].sum()
        assert abs(means[c] - mean) < 1e-12
        kh, kp = strength("host", None, f"own_{c}"), strength("path", "host", f"own_{c}")
        for row in x.itertuples():
            other = x[x["id"] != row.id]
            host, path = other[other["host"] == row.host], other[other["path"] == row.path]
            h = (host[f"own_{c}"].sum() + kh * mean) / (host["own_n"].sum() + kh)
            p = (path[f"own_{c}"].sum() + kp * h) / (path["own_n"].sum() + kp)
            assert abs(got.loc[row.id, f"site_{c}"] - (logit(p) - logit(mean))) < 1e-9


def test_language_evidence_by_brute_force(spark):
    """All four kinds of evidence recomputed row by row, each row's own text left out of the counts."""
    r, langs = np.random.default_rng(1), ["aa", "bb", "cc"]
    grams = np.log(r.dirichlet(np.ones(4096), 3))
    rows = []
    for i in range(120):
        host = ["", "x.one.org", "y.one.org", "two.net"][i % 4]
        rows.append((i, " ".join(r.choice(["alpha", "beta", "gamma", "delta"], i % 7)), ["aa", "bb", "zz", None][r.integers(0, 4)], ["cc", "", "org"][r.integers(0, 3)], host, host[-7:]))
    df = spark.createDataFrame(rows, "k long, t string, declared string, address string, host string, domain string")
    got = {x["k"]: x for x in langid.identify(df, langs, grams, ["k"]).collect()}
    like = np.array([0.2 * (grams @ langid.letter_grams(t)) if t.strip() else np.zeros(3) for _, t, *_ in rows])
    like -= like.max(axis=1, keepdims=True)
    soft = np.exp(like) / np.exp(like).sum(axis=1, keepdims=True)
    g = (soft.sum(axis=0) + 1) / (soft.sum(axis=0) + 1).sum()
    of = lambda x: "" if not x else x if x in langs else "*"
    known = [[of(x[2]), x[3], x[5], x[4]] for x in rows]

    def share(i, c, prior):
        same = [j for j in range(len(rows)) if j != i and known[j][c] == known[i][c]]
        return (soft[same].sum(axis=0) + 5 * prior) / (len(same) + 5)

    for i in range(len(rows)):
        z = like[i].copy()
        for c in (0, 1):
            z += np.log(share(i, c, g) / g) if known[i][c] else 0
        prior = share(i, 2, g) if known[i][2] else g
        z += np.log(share(i, 3, prior) if known[i][3] else prior)
        p = np.exp(z) / np.exp(z).sum()
        assert got[i]["lang"] == langs[int(z.argmax())] and abs(got[i]["p"] - p.max()) < 1e-9


def test_language_held_out(spark):
    """Documents judged by grams of the other half, without their given language."""
    from sparksheet.llm.queries import op1_langid

    got = op1_langid(spark, "/root/testdata/sf0.01").where("doc_id is not null").select("doc_id", F.col("lang").alias("found"))
    both = got.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").where("length(text) > 100").toPandas()
    assert (both["found"] == both["lang"]).mean() > 0.95


def test_language(spark, docs, odd, none):
    langs, grams = langid.learn(docs, "lang", "text")
    pages = langid.of_pages(spark.read.parquet(f"{SF}/pages.parquet"))
    got = langid.identify(pages, langs, grams, ["page_id"]).toPandas()
    assert (got["lang"] == got["declared"]).mean() > 0.9 and got["p"].between(0, 1).all()
    blank = spark.createDataFrame([(1, None, None), (2, "https://a.example.de/x", "")], "page_id long, url string, html string")
    assert len(langid.identify(langid.of_pages(blank), langs, grams, ["page_id"]).collect()) == 2
    assert langid.identify(langid.of_pages(blank.limit(0)), langs, grams, ["page_id"]).collect() == []
    assert pd.isna(langid.identify(langid.of_pages(blank), [], np.zeros((0, 4096)), ["page_id"]).toPandas()["lang"]).all()
