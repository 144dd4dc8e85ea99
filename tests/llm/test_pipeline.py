"""The pipeline's stages, each against brute force on what the one before kept, and run() against the stages."""

import zlib
from collections import Counter

import numpy as np
import pytest
from test_operators import SF, near_brute

import corpus_pipeline
from sparksheet.llm import lines, mixing, quality
from sparksheet.llm.common import cut, table
from sparksheet.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage was given and returned."""
    out, docs = {}, table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        given, docs = docs, cut(stage(spark, docs, SF))
        out[name] = (given, docs)
    return out


def test_quality(spark, stages):
    given, kept = stages["quality"]
    judged = quality.classify(given, table(spark, SF, "labels")).toPandas()
    assert set(rows(kept)) == set(judged.loc[(judged["p_quality"] >= 0.5) & (judged["p_toxic"] < 0.5), "doc_id"]) and kept.columns == COLUMNS


def test_lines(stages):
    given, kept = stages["lines"]
    before, after = rows(given), rows(kept)
    each = sorted((i, k, s) for i, r in before.items() for k, s in enumerate((r["text"] or "").split("\n")) if s.strip())
    different = sorted({s for *_, s in each}, key=len)
    label, at = {s: s for s in different}, 0
    links = []
    for i, s in enumerate(different):
        while len(different[at]) < len(s) - 1:
            at += 1
        if len(s) >= 20:
            links += [(s, different[at + j]) for j in np.flatnonzero(lines.edits_within([s] * (i - at), different[at:i], 1)) if len(different[at + j]) >= 20]
    for _ in different:
        was = dict(label)
        for x, y in links:
            label[x] = label[y] = min(label[x], label[y])
        if was == label:
            break
    seen, gone = set(), {}
    for i, k, s in each:
        if label[s] in seen:
            gone.setdefault(i, set()).add(k)
        seen.add(label[s])
    assert set(before) == set(after) and gone
    for i, r in before.items():
        text = "\n".join(s for k, s in enumerate((r["text"] or "").split("\n")) if k not in gone.get(i, ()))
        assert (after[i]["text"] or "") == text and after[i]["n_chars"] == (len(text) if i in gone else r["n_chars"])


def test_near_duplicates(stages):
    given, kept = stages["near_duplicates"]
    before = rows(given)
    component = near_brute([(i, r["text"] or "") for i, r in before.items()], 5)
    assert set(rows(kept)) == {i for i, (_, c) in component.items() if c == i} and all(rows(kept)[i] == before[i] for i in rows(kept))


def test_mixing(stages):
    given, kept = stages["mixing"]
    mixed = mixing.mix(given).toPandas()
    assert set(rows(kept)) == set(mixed.loc[mixed["keep"], "doc_id"]) and 0 < len(rows(kept)) < len(rows(given))
    mixed["w"] = mixed["p"] * mixed["tokens"]
    for d in mixing.DIMS:
        goal = mixed.groupby(d)["tokens"].sum() ** 0.7
        assert (mixed.groupby(d)["w"].sum() / mixed["w"].sum() - goal / goal.sum()).abs().max() <= 1.001e-3


def test_packing_and_run(spark, stages):
    from tokenizers import Tokenizer

    given, packed = stages["packing"]
    tok, want = Tokenizer.from_file(tokenizer_path()), Counter()
    for r in rows(given).values():
        ids = np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [0], np.uint32)
        want.update((r["doc_id"], at, zlib.crc32(ids[at : at + 2048].tobytes())) for at in range(0, len(ids), 2048))
    shown = lambda df: Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in df.collect())
    assert shown(packed) == want
    assert shown(corpus_pipeline.run(spark, SF)) == want
    x = packed.toPandas()
    assert (x.groupby("sequence_id")["length"].sum() <= 2048).all() and x["sequence_id"].nunique() <= x["length"].sum() / 2048 + 2


def test_a_task_has_one_python_worker_at_a_time(spark, monkeypatch):
    """Pieces are written down before they are packed, ids that go before they are joined; workers get few rows at once in the stages' own jobs."""
    batch, seen, plan = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, lambda df: df._jdf.queryExecution().toString()
    given, docs, tokenize = spark.conf.get(batch), table(spark, SF, "documents").limit(20), corpus_pipeline.packing.tokenize

    def noted(*args, **options):
        seen["rows"] = spark.conf.get(batch)
        return tokenize(*args, **options)

    monkeypatch.setattr(corpus_pipeline.packing, "tokenize", noted)
    monkeypatch.setattr(corpus_pipeline.packing, "pack", lambda pieces: pieces)
    pieces = corpus_pipeline.pack_sequences(spark, docs, SF)
    assert "MapInArrow" not in plan(pieces) and pieces.count() >= 20
    assert int(seen["rows"]) <= 2000 and spark.conf.get(batch) == given
    out = tokenize(docs, tokenizer_path(spark)).select("doc_id")
    assert "MapInArrow" in plan(out) and "MapInArrow" not in plan(corpus_pipeline._without(docs, out))
