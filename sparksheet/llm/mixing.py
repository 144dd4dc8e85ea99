"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells by source, language and topic; a cell's size is its tokens (words).  The cells' weights are
raked in turn to target shares of each marginal until they fit; no cell gets more than its tokens, so that a weight
over its tokens is a probability to keep a document.  Cells at that bound stay there while the others take up the
rest.  Where the asked total of tokens cannot meet the targets to `close`, it is lowered to the largest that can; targets
that no total can meet (for want of cells) are met as nearly as the rounds allow, and `marginals` says how nearly.
Every document is then kept or not by its own probability and a hash of its id (the same on every run).

Topics, unless the caller has their own, are learned from all documents: each becomes a random projection of the words it
holds, weighted by how few documents hold them (counted over all), in whole numbers.  Spherical k-means groups these: it starts
from `pool` different vectors (those of the smallest hashes), and its rounds are sums of whole numbers, so topics, and with
them the result, are the same however the rows are partitioned and in whatever order they come.

The cells are one grouped aggregation.  Up to `driver_cells` of them are raked on the driver; more stay a table and
are raked by one grouped aggregation for each marginal and round: the same arithmetic, at any number of cells.

Defined cases: null categories are one category; null and empty texts have no tokens, the topic "(none)", and are kept;
targets are normalised over the categories that occur, categories without a target keep their share; rows of equal id
share their draw; an empty table gives no rows; other columns may be carried along and may have any names but the result's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, discard, text_of, tidily
from .hashing import batches_of, word_hashes

DIMS = ("source", "lang", "topic")
#: Words fall into this many classes by hash; a text's vector has AXES numbers.
CLASSES, AXES = 1 << 15, 24
#: Vectors of length 1 have whole components of this size.
UNIT = 1 << 14


def _classes(texts: list[str]):
    """For each text of a slice the classes of its words, one for each word."""
    for lo, hi in batches_of(texts):
        raw = [t.encode("utf-8", "surrogatepass") + b"\n" for t in texts[lo:hi]]
        ends = np.cumsum([len(r) for r in raw]) - 1
        words, owner = word_hashes(b"".join(raw), ends)
        first = np.searchsorted(owner, np.arange(len(raw) + 1))
        at = (words % np.uint64(CLASSES)).astype(np.int32)
        for x, y in zip(first[:-1], first[1:], strict=True):
            yield at[x:y]


def document_counts(texts: DataFrame) -> np.ndarray:
    """How many texts hold each class of words, over all texts (t); last, how many texts there are."""

    def run(batches):
        n = np.zeros(CLASSES + 1, np.int64)
        for b in chunks(batches):
            for c in _classes(b.column(0).to_pylist()):
                n[np.unique(c)] += 1
                n[CLASSES] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], names=["c", "n"])

    out = np.zeros(CLASSES + 1)
    for r in texts.select("t").mapInArrow(tidily(run), "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).collect():  # CLASSES rows at most
        out[r["c"]] = r["n"]
    return out


def vectors(docs: DataFrame) -> DataFrame:
    """docs with t replaced by tokens long and x array<int>: the text's words and its vector of length UNIT (null without words)."""
    n = document_counts(docs)
    weight = np.log((1 + n[CLASSES]) / (1 + n[:CLASSES]))
    axes = np.random.default_rng(5).standard_normal((CLASSES, AXES)).astype(np.float32) * weight.astype(np.float32)[:, None]
    keep = [c for c in docs.columns if c != "t"]

    def run(batches):
        for b in chunks(batches):
            tokens, xs = [], []
            for c in _classes(b.column(b.schema.get_field_index("t")).to_pylist()):
                tokens.append(len(c))
                x = axes[np.unique(c)].sum(axis=0) if len(c) else None
                size = 0 if x is None else float(np.sqrt((x * x).sum()))
                xs.append(np.rint(x * (UNIT / size)).astype(np.int32) if size else None)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(k)) for k in keep] + [pa.array(tokens, pa.int64()), pa.array(xs, pa.list_(pa.int32()))], names=keep + ["tokens", "x"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "t")
    return docs.mapInArrow(tidily(run), f"{kinds}, tokens long, x array<int>")


def assigned(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centre, the first of equally near ones, and their product; products of whole numbers this small are exact."""
    like = x.astype(float) @ centres.T.astype(float)
    return like.argmax(axis=1), like.max(axis=1)


def sums_of(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Each centre's vectors added up."""
    sums = np.zeros(centres.shape, np.int64)
    np.add.at(sums, assigned(x, centres)[0], x)
    return sums


def moved(centres: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The centres of such sums; one without vectors stays where it is."""
    size = np.sqrt((sums.astype(float) ** 2).sum(axis=1, keepdims=True))
    return np.where(size > 0, np.rint(sums * UNIT / np.maximum(size, 1)), centres).astype(np.int64)


def seeds(pool: np.ndarray, k: int, starts: int = 20, rounds: int = 12) -> np.ndarray:
    """k centres of the pool: the best of some starts, each of vectors far apart, moved to the middle of those nearest to them."""
    best = (-np.inf, pool[:k])
    for start in range(starts if len(pool) > k else 0):
        draw = np.random.default_rng(start)
        now = pool[[draw.integers(len(pool))]]
        while len(now) < k:
            far = np.maximum(UNIT * UNIT - assigned(pool, now)[1], 0)
            now = np.vstack([now, pool[np.searchsorted(far.cumsum(), draw.random() * far.sum(), side="right").clip(0, len(pool) - 1)]])
        for _ in range(rounds):
            now = moved(now, sums_of(pool, now))
        fit = float(assigned(pool, now)[1].sum())
        if fit > best[0]:
            best = (fit, now)
    return best[1]


def centres_of(made: DataFrame, topics: int, rounds: int = 8, pool: int = 512) -> np.ndarray:
    """Whole centres (length UNIT) of the vectors x."""
    usable = made.where("x is not null").select("x")
    some = usable.distinct().orderBy(F.xxhash64("x"), "x").limit(pool).collect()
    now = seeds(np.array([r["x"] for r in some], np.int64).reshape(len(some), AXES), topics)
    for _ in range(rounds if len(now) else 0):
        centres = now

        def run(batches, centres=centres):
            sums = sum((sums_of(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, AXES).astype(np.int64), centres) for b in batches), np.zeros(centres.shape, np.int64))
            topic, axis = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(topic), pa.array(axis), pa.array(sums[topic, axis])], names=["topic", "axis", "n"])

        sums = np.zeros(centres.shape, np.int64)
        for r in usable.mapInArrow(run, "topic long, axis long, n long").groupBy("topic", "axis").agg(F.sum("n").alias("n")).collect():  # topics * AXES rows at most
            sums[r["topic"], r["axis"]] = r["n"]
        now = moved(centres, sums)
        if (now == centres).all():
            break
    return now


def with_topics(docs: DataFrame, topics: int = 12) -> DataFrame:
    """docs (.., t) with tokens and topic instead of t."""
    made = cut(vectors(docs))
    centres = centres_of(made, topics)
    if not len(centres):
        return made.withColumn("topic", F.lit("(none)")).drop("x")
    fit = F.array(*[F.aggregate(F.zip_with("x", F.lit([int(v) for v in c]), lambda a, b: a.cast("long") * b), F.lit(0).cast("long"), lambda s, v: s + v) for c in centres])
    best = F.array_position(fit, F.array_max(fit))
    return made.withColumn("topic", F.when(F.col("x").isNotNull(), F.concat(F.lit("t"), (best - 1).cast("string"))).otherwise("(none)")).drop("x")


def misfit(at: list[np.ndarray], w: np.ndarray, targets: list[np.ndarray]) -> float:
    """The largest difference of a marginal's share from its target."""
    total = max(w.sum(), 1e-300)
    return max((float(np.abs(np.bincount(d, weights=w, minlength=len(g)) / total - g).max(initial=0)) for d, g in zip(at, targets, strict=True)), default=0.0)


def rake(at: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray], total: float, rounds: int = 200, close: float = 1e-9) -> np.ndarray:
    """Cell weights: at[d] is each cell's category in marginal d, targets[d] the categories' shares of total."""
    w = tokens * min(1.0, total / max(tokens.sum(), 1e-300))
    for _ in range(rounds):
        before = w
        for d, goal in zip(at, targets, strict=True):
            now = np.bincount(d, weights=w, minlength=len(goal))
            w = np.minimum(w * np.divide(goal * total, now, out=np.ones_like(goal), where=now > 0)[d], tokens)
        if np.abs(w - before).max(initial=0) <= close * max(total, 1):
            break
    return w


def rake_within(at: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray], total: float, rounds: int = 500, close: float = 1e-3) -> np.ndarray:
    """Weights at the largest total up to the asked one that meets the targets to `close`; as near as can be if none does."""
    w = rake(at, tokens, targets, total, rounds)
    if misfit(at, w, targets) <= close:
        return w
    low, high, found = 0.0, total, None
    for _ in range(14):
        half = (low + high) / 2
        tried = rake(at, tokens, targets, half, rounds)
        if misfit(at, tried, targets) <= close:
            low, found = half, tried
        else:
            high = half
    return w if found is None else found


def rake_table(cells: DataFrame, targets: list[DataFrame], total: float, rounds: int = 200, close: float = 1e-9) -> DataFrame:
    """The same as a table: cells (DIMS, tokens), targets[d] (DIMS[d], goal) -> cells with w."""
    size = cells.agg(F.sum("tokens")).first()[0] or 0
    now = cut(cells.withColumn("w", F.col("tokens") * min(1.0, total / max(size, 1e-300))))
    for _ in range(rounds):
        before = now.select(*DIMS, F.col("w").alias("was"))
        x = now
        for d, goal in zip(DIMS, targets, strict=True):
            sums = x.groupBy(d).agg(F.sum("w").alias("now")).join(goal, d, "left")
            factor = sums.select(d, F.when(F.col("now") > 0, F.col("goal") * total / F.col("now")).otherwise(1.0).alias("factor"))
            x = x.join(factor, d).withColumn("w", F.least(F.col("w") * F.col("factor"), "tokens")).drop("factor")
        now, old = cut(x), now
        moved = (now.join(before, list(DIMS)).agg(F.max(F.abs(F.col("w") - F.col("was")))).first()[0] or 0)
        discard(old)
        if moved <= close * max(total, 1):
            break
    return now


def rake_table_within(cells: DataFrame, targets: list[DataFrame], total: float, rounds: int = 200, close: float = 1e-3) -> DataFrame:
    """rake_within as a table."""

    def fits(raked: DataFrame) -> bool:
        return max(r["off"] or 0 for r in marginals(raked, targets).agg(F.max("off").alias("off")).collect()) <= close

    raked = rake_table(cells, targets, total, rounds)
    low, high, found = 0.0, total, raked if fits(raked) else None
    for _ in range(14 if found is None else 0):
        half = (low + high) / 2
        tried = rake_table(cells, targets, half, rounds)
        if fits(tried):
            low, found = half, tried
        else:
            high = half
    return raked if found is None else found


def marginals(raked: DataFrame, targets: list[DataFrame]) -> DataFrame:
    """dim, category, goal, got (shares), off: how far each marginal of raked cells (DIMS, w) is from its target."""
    out = None
    for d, goal in zip(DIMS, targets, strict=True):
        whole = raked.agg(F.sum("w").alias("all"))
        got = raked.groupBy(d).agg(F.sum("w").alias("w")).join(F.broadcast(whole)).join(goal, d)
        part = got.select(F.lit(d).alias("dim"), F.col(d).alias("category"), "goal", (F.col("w") / F.when(F.col("all") > 0, F.col("all"))).alias("got"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("off", F.abs(F.coalesce("got", F.lit(0.0)) - F.col("goal")))


def plan(cells: DataFrame, share: float, power: float, asked: dict[str, dict], rounds: int = 500, close: float = 1e-3, driver_cells: int = 100_000) -> tuple[DataFrame, list[DataFrame]]:
    """Raked cells (DIMS, tokens double, w) and the targets (DIMS[d], goal) they were raked to."""
    spark = cells.sparkSession
    n, size = cells.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    total = share * (size or 0)
    goals = []
    for d in DIMS:
        sums = cells.groupBy(d).agg(F.sum("tokens").alias("size"))
        own = F.pow("size", F.lit(power)) if not asked.get(d) else F.coalesce(*([F.create_map(*[F.lit(x) for kv in asked[d].items() for x in kv])[F.col(d)]]), F.col("size") / max(size or 1, 1))
        goals.append(sums.select(d, own.cast("double").alias("goal")))
    if n > driver_cells:
        sums = [g.agg(F.sum("goal")).first()[0] for g in goals]
        goals = [cut(g.withColumn("goal", F.col("goal") / (s or 1))) for g, s in zip(goals, sums, strict=True)]
        return rake_table_within(cells, goals, total, rounds, close), goals
    x = cells.toPandas().sort_values(list(DIMS), ignore_index=True)  # sums in one order, whatever the partitions
    at, wanted, small = [], [], []
    for d, g in zip(DIMS, goals, strict=True):
        g = g.toPandas().sort_values(d, ignore_index=True)
        at.append(g[d].searchsorted(x[d]).astype(int) if len(g) else np.zeros(0, int))
        wanted.append((g["goal"] / max(g["goal"].sum(), 1e-300)).to_numpy())
        small.append(spark.createDataFrame(list(zip(g[d], map(float, wanted[-1]), strict=True)), f"{d} string, goal double"))
    x["w"] = rake_within(at, x["tokens"].to_numpy(), wanted, total, rounds, close)
    kinds = "source string, lang string, topic string, tokens double, w double"
    return spark.createDataFrame(list(x[[*DIMS, "tokens", "w"]].itertuples(index=False, name=None)), kinds), small


def mix(df: DataFrame, share: float = 0.8, power: float = 0.7, targets: dict[str, dict] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, topics: int = 12, seed: int = 17, driver_cells: int = 100_000, rounds: int = 500, close: float = 1e-3) -> DataFrame:
    """id_col, source, lang, topic, tokens long, p double (probability), keep boolean for each row of df.

    share: of all tokens, at most; power: unless targets are given, a category's target goes with this power of its size."""
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("(none)"))
    docs = df.select(F.col(f"`{id_col}`").alias("id"), name(source_col).alias("source"), name(lang_col).alias("lang"), *([F.coalesce(topic, F.lit("(none)")).alias("topic")] if topic is not None else []), text_of(text_col).alias("t"))
    if topic is None:
        docs = with_topics(docs, topics)
    else:
        docs = docs.withColumn("tokens", F.regexp_count("t", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")).drop("t")
    docs = cut(docs)  # ids and counts only
    cells = cut(docs.groupBy(*DIMS).agg(F.sum("tokens").cast("double").alias("tokens")))
    raked, _ = plan(cells, share, power, targets or {}, rounds, close, driver_cells)
    p = raked.select(*DIMS, F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(1.0).alias("p"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id").cast("string")), 11) / float(2**53)
    out = docs.join(p, list(DIMS))
    return out.select(F.col("id").alias(id_col), *DIMS, "tokens", "p", ((F.col("tokens") == 0) | (draw < F.col("p"))).alias("keep"))
