"""Exact top-k inner products by norm-bucketed retrieval, on vectors whose components become floor(1024 * x).

Vectors are grouped by length (geometric buckets), and in each bucket by their strongest coordinate and its sign; large
groups are cut into blocks of about `block_rows`.  Every query first meets a block or a few of the longest vectors that
share its own strongest coordinate; the k-th score found there bounds what any answer must reach.  From it follows, for
every query and every group, the cosine a candidate needs at least.  A group of which no length and no value of its
coordinate can give that is not visited: the query is not even sent there.  In a block, candidates are pruned by their
length and, where the cosine needed is `steep`, by the ranges that it leaves them in the query's strongest coordinates.
What remains is verified by its inner product, computed exactly (in integers of any size where doubles could round).

Queries and blocks meet in tiles of at most `query_rows` by about `block_rows` vectors, so that no group grows with the
table.  What visits the driver is one row for each bucket and coordinate.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part; shorter vectors
count as filled with zeros; a row is never its own candidate, and rows of equal id count as one row in this;
ties go to the smaller id; an empty table gives no rows.  Scores beyond 64 bits raise OverflowError.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

OUT = "query_id long, vec_id long, score long"
#: How many of a query's strongest coordinates prune.
FOCUS = 4


def taking_part(df: DataFrame, id_col: str, vec_col: str, every: int, base: float) -> DataFrame:
    """id, v (as given), asked (whether it is a query), and of what the vector becomes: norm, bucket (of lengths), side (its
    strongest coordinate from 1, with its sign; 0 for a vector of zeros), share (that coordinate by the norm)."""
    x = F.col(f"`{vec_col}`")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), x.alias("v")).where(F.col("id").isNotNull() & F.coalesce(fine_of("v"), F.lit(False)))
    # Doubles from 2**52 on are whole already.
    whole = lambda c: F.when(F.abs(c) < float(2**52), F.floor(c).cast("double")).otherwise(c)
    rows = rows.withColumn("w", F.transform("v", lambda c: whole(1024 * c.cast("double"))))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("w", F.lit(0.0), lambda a, c: a + c * c))).withColumn("top", F.array_max(F.transform("w", lambda c: F.abs(c))))
    at = lambda c: F.array_position("w", c).cast("int")
    side = F.when(F.coalesce(F.col("norm"), F.lit(0.0)) == 0, 0).when(at(F.col("top")) > 0, at(F.col("top"))).otherwise(-at(-F.col("top")))
    bucket = F.when(F.col("norm") > 0, F.greatest(F.floor(F.log("norm") / float(np.log(base))), F.lit(-10_000))).otherwise(-10_000).cast("int")
    rows = rows.withColumns({"side": side, "bucket": bucket})
    return rows.select("id", "v", (F.col("id") % every == 0).alias("asked"), "norm", "bucket", "side", F.when(F.col("side") == 0, 0.0).otherwise(F.signum(F.col("side").cast("double")) * F.col("top") / F.col("norm")).alias("share"))


def fine_of(name: str) -> Column:
    return F.forall(F.col(name), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))


def whole(vectors, dims: int) -> np.ndarray:
    """floor(1024 * x) as doubles, filled with zeros to dims."""
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(1024 * out)


def exact_products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """v @ q as integers."""
    most = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(1, len(q))
    if most < 2**53:
        return np.rint(v @ q).astype(np.int64)
    ints = [int(x) for x in q.tolist()]
    return np.array([sum(int(a) * b for a, b in zip(row, ints, strict=True)) for row in v.tolist()], dtype=np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def reach(size: np.ndarray, x: np.ndarray, cell: dict) -> np.ndarray:
    """The most that products with vectors of a cell can be: of queries with norms `size` of which x is the share of the cell's coordinate."""
    lo, hi = np.arccos(np.clip([cell["high"], cell["low"]], -1, 1))
    own = np.arccos(np.clip(x, -1, 1))
    apart = np.maximum(np.maximum(lo - own, own - hi), 0)
    return size * cell["norm"] * np.maximum(np.cos(apart), 0) * (1 + 1e-9) + 1e-6


def search(queries: pd.DataFrame, rows: pd.DataFrame, k: int, steep: float = 0.5) -> tuple[pd.DataFrame, int]:
    """The k best of rows (id, v) for each query (query, asked, bound; bound null: none known yet), and how many products that took."""
    out, made = [], 0
    if len(queries) and len(rows):
        dims = max(max(map(len, queries["asked"])), max(map(len, rows["v"])), 1)
        q, v = whole(queries["asked"], dims), whole(rows["v"], dims)
        lengths = np.sqrt((v * v).sum(axis=1))
        order = np.argsort(-lengths, kind="stable")
        v, lengths, ids = v[order], lengths[order], rows["id"].to_numpy()[order]
        angles = np.arccos(np.clip(v / np.maximum(lengths, 1e-300)[:, None], -1, 1)).T.copy()
        for i, (name, bound) in enumerate(zip(queries["query"].tolist(), queries["bound"].tolist(), strict=True)):
            n, some = len(v), None
            size = float(np.sqrt((q[i] * q[i]).sum()))
            if bound is not None and bound == bound and bound > 0:
                # length pruning: |q| |v| must reach the bound
                n = int(np.searchsorted(-lengths * size * (1 + 1e-9), -bound, side="right")) if size else 0
                need = bound / (size * lengths[0]) if size and lengths[0] else 2.0
                if n and steep <= need <= 1 + 1e-9:
                    # coordinate pruning: a cosine of `need` leaves each coordinate a range about the query's own
                    some, room = np.arange(n), np.arccos(min(1.0, need)) + 1e-6
                    for f in np.argsort(-np.abs(q[i]))[:FOCUS]:
                        some = some[np.abs(angles[f, some] - np.arccos(np.clip(q[i, f] / size, -1, 1))) <= room]
            cand, own = (v[:n], ids[:n]) if some is None else (v[some], ids[some])
            made += len(own)
            scores = exact_products(q[i], cand)
            keep = own != name
            if bound is not None and bound == bound:
                keep &= scores >= bound
            scores, own = scores[keep], own[keep]
            at = best(scores, own, k)
            out += [(name, int(a), int(b)) for a, b in zip(own[at], scores[at], strict=True)]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64"), made


def top_k(df: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, base: float = 1.1, block_rows: int = 4096, query_rows: int = 4096, products=None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by `every`, the k best other rows.  products: an accumulator for the number of products made."""
    spark = df.sparkSession
    rows = cut(taking_part(df, id_col, vec_col, every, base))
    kind = df.schema[vec_col].dataType.simpleString()
    # At most two rows for each coordinate and bucket; there are about 15,000 buckets at most, as doubles have a largest and a smallest power.
    cells = [r.asDict() for r in rows.groupBy("bucket", "side").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm"), F.min("share").alias("low"), F.max("share").alias("high")).collect()]
    if not cells:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cells.sort(key=lambda c: (-c["bucket"], c["side"]))
    first: dict[int, list[int]] = {}
    for i, c in enumerate(cells):
        c["blocks"] = -(-c["n"] // block_rows)
        first.setdefault(c["side"], [])
        if sum(cells[j]["n"] for j in first[c["side"]]) <= k:
            first[c["side"]].append(i)
    place = spark.createDataFrame([(c["bucket"], c["side"], i, c["blocks"]) for i, c in enumerate(cells)], "bucket int, side int, cell int, blocks int")
    blocked = rows.join(F.broadcast(place), ["bucket", "side"]).select("id", "v", "cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    queries = rows.where("asked").select(F.col("id").alias("query"), "v", "side")

    def tiles(asked: DataFrame, whole_cells: bool) -> DataFrame:
        """asked (query, v, bound, cell) with the cells' first blocks, or with all."""
        visits = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        known = spark.createDataFrame([(i, cells[i]["blocks"] if whole_cells else 1, -(-n // query_rows)) for i, n in visits.items()] or [(-1, 1, 1)], "cell int, last int, parts int")
        left = asked.join(F.broadcast(known), "cell").select("query", F.col("v").alias("asked"), "bound", "cell", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("last") - 1)).alias("block"))
        right = blocked.join(F.broadcast(known), "cell").where("block < last").select("id", "v", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            found, made = search(a, b, k)
            if products is not None:
                products.add(made)
            return found

        key = ["cell", "block", "part"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, OUT)

    def visiting(frames):
        """Of queries (query, v, bound) and the cells that can hold an answer one row each."""
        for x in frames:
            n = max([*map(len, x["v"]), *(abs(c["side"]) for c in cells), 1])
            q = whole(x["v"], n)
            size = np.sqrt((q * q).sum(axis=1))
            bound = x["bound"].to_numpy(float)
            unit = q / np.maximum(size, 1e-300)[:, None]
            for i, c in enumerate(cells):
                most = reach(size, unit[:, abs(c["side"]) - 1], c) if c["side"] else np.zeros(len(x))
                yield x[~(most < bound)].assign(cell=i)

    ranked = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda x: x.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    starts = spark.createDataFrame([(side, i) for side, them in first.items() for i in them], "side int, cell int")
    some = queries.join(F.broadcast(starts), "side").select("query", "v", F.lit(None).cast("double").alias("bound"), "cell")
    bounds = cut(top(tiles(some, whole_cells=False)).where(F.col("rank") == k).select(F.col("query_id").alias("query"), F.col("score").cast("double").alias("bound")))
    known = queries.select("query", "v").join(bounds, "query", "left")
    found = top(tiles(known.mapInPandas(visiting, f"query long, v {kind}, bound double, cell int"), whole_cells=True))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
