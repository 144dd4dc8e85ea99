"""Hard negatives by length buckets and coordinate pruning, on vectors whose components become floor(scale * x).

Vectors are grouped by length (geometric buckets) and, in each bucket, by their strongest coordinate and its sign; large groups
are cut into blocks of about `block_rows`.  A block holds its vectors' shares of each coordinate in sorted lists.  What an anchor looks for has a least product, which by the block's largest
length becomes a least cosine; it leaves each coordinate a range of values about the anchor's own.  The lists of the anchor's
strongest (focus) coordinates give the candidates of each range, their intersection is verified by exact products.

First every anchor meets one block of its own group among the rows of its label: the score of its last positive found there bounds
what the others must reach; it visits the groups whose lengths and shares of their coordinate can give that.  Then it meets rows of other labels: a
positive's negatives have scores from `low` to `high` percent of its own; one block first, whose third best in
each range bounds the visits to the rest.  What a first block gave is kept and not computed again.  Anchors and blocks
meet in tiles of at most about `query_rows` by `block_rows`, so that no group grows with the table; nothing visits the driver.

Defined cases: rows whose label, id or vector is null, or whose vector holds null, NaN or infinite components, take no part; shorter
vectors count as filled with zeros; rows equal in id, label and vector count once; other rows of an anchor's id are never
its positives or negatives, and each of them is mined if the id is asked; ties go to the smaller id; a positive with a score
below 0 has no range and no negatives; an empty table gives no rows.  Scores beyond 64 bits raise OverflowError.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut
from .topk import best, exact_products, fine_of

#: How many of an anchor's strongest coordinates prune.
FOCUS = 8
FOUND = "query long, id long, score long"
PICKED = "query long, place int, id long, score long"


def taking_part(df: DataFrame, id_col: str, vec_col: str, label_col: str, every: int, scale: int, base: float) -> DataFrame:
    """id, label, v (as given), query (a hash of these for anchors, else null), and of what the vector becomes: norm, bucket (of lengths), side (its
    strongest coordinate from 1, with its sign; 0 for a vector of zeros) and share (that coordinate by the norm)."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vec_col}`").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine_of("v"), F.lit(False))).distinct()
    # Doubles from 2**52 on are whole already.
    whole = lambda c: F.when(F.abs(c) < float(2**52), F.floor(c).cast("double")).otherwise(c)
    rows = rows.withColumn("w", F.transform("v", lambda c: whole(scale * c.cast("double"))))
    rows = rows.withColumns({"norm": F.sqrt(F.aggregate("w", F.lit(0.0), lambda a, c: a + c * c)), "top": F.array_max(F.transform("w", lambda c: F.abs(c)))})
    at = lambda c: F.array_position("w", c).cast("int")
    side = F.when(F.coalesce(F.col("norm"), F.lit(0.0)) == 0, 0).when(at(F.col("top")) > 0, at(F.col("top"))).otherwise(-at(-F.col("top")))
    bucket = F.when(F.col("norm") > 0, F.greatest(F.floor(F.log("norm") / float(np.log(base))), F.lit(-10_000))).otherwise(-10_000).cast("int")
    rows = rows.withColumns({"bucket": bucket, "side": side, "query": F.when(F.pmod("id", F.lit(every)) == 0, F.xxhash64("id", "label", "v"))})
    return rows.withColumn("share", F.when(F.col("side") == 0, 0.0).otherwise(F.signum(F.col("side").cast("double")) * F.col("top") / F.col("norm"))).drop("w", "top")


def whole_parts(vectors, scale: int, dims: int) -> np.ndarray:
    """floor(scale * x) as doubles, filled with zeros to dims."""
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(scale * out)


class Block:
    """A block's vectors with their shares of each coordinate in sorted lists."""

    def __init__(self, w: np.ndarray):
        self.w = w
        norms = np.sqrt((w * w).sum(axis=1))
        self.longest = float(norms.max(initial=0))
        shares = (w / np.maximum(norms, 1e-300)[:, None]).T
        self.order = np.argsort(shares, axis=1, kind="stable")
        self.shares = np.take_along_axis(shares, self.order, axis=1)

    def candidates(self, q: np.ndarray, least: float) -> np.ndarray | None:
        """Places of the vectors whose product with q can reach `least`; None: any can."""
        size = float(np.sqrt((q * q).sum()))
        if least <= 0:
            return None
        if least > size * self.longest * (1 + 1e-9):
            return np.zeros(0, int)
        room = np.arccos(min(1.0, least / (size * self.longest))) + 1e-6
        focus = np.argsort(-np.abs(q))[:FOCUS]
        own = np.arccos(np.clip(q[focus] / size, -1, 1))
        low, high = np.cos(np.minimum(own + room, np.pi)) - 1e-9, np.cos(np.maximum(own - room, 0)) + 1e-9
        spans = [(f, np.searchsorted(self.shares[f], a), np.searchsorted(self.shares[f], b, side="right")) for f, a, b in zip(focus, low, high, strict=True)]
        if all(hi - lo == len(self.w) for _, lo, hi in spans):
            return None
        met = np.zeros(len(self.w), np.int8)
        for f, lo, hi in spans:
            met[self.order[f, lo:hi]] += 1
        return np.flatnonzero(met == len(spans))


def products(queries: pd.DataFrame, rows: pd.DataFrame, scale: int, made):
    """For each query (query, own, asked, least: null if unknown) the ids and products of a block's rows (id, v) that can and do reach its least."""
    if not len(queries) or not len(rows):
        return
    dims = max(max(map(len, queries["asked"])), max(map(len, rows["v"])), 1)
    q, block, ids = whole_parts(queries["asked"], scale, dims), Block(whole_parts(rows["v"], scale, dims)), rows["id"].to_numpy()
    n = 0
    for i, (own, least) in enumerate(zip(queries["own"].tolist(), queries["least"].tolist(), strict=True)):
        known = least is not None and least == least
        some = block.candidates(q[i], least) if known else None
        some = np.arange(len(ids)) if some is None else some
        scores = exact_products(q[i], block.w[some])
        n += len(some)
        keep = (ids[some] != own) & ((scores >= least) if known else True)
        yield i, some[keep], scores[keep]
    if made is not None:
        made.add(n)


def framed(names: list[str], parts: list[tuple]) -> pd.DataFrame:
    """One frame of many parts: tuples of columns, of which the last is an array and others are arrays or one value for all its rows."""
    sizes = [len(p[-1]) for p in parts]
    columns = [np.concatenate([np.broadcast_to(p[i], n) for p, n in zip(parts, sizes, strict=True)]) if parts else np.zeros(0, np.int64) for i in range(len(names))]
    return pd.DataFrame(dict(zip(names, columns, strict=True)))


def tiles(visits: DataFrame, blocks: DataFrame, key: list[str], query_rows: int, meet, out: str) -> DataFrame:
    """meet(visits, rows) for each block (by key) and at most about query_rows of its visits."""
    load = visits.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("parts"))
    left = visits.join(load, key).withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int"))
    right = blocks.join(load, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own, though both sides stem from the same rows
    by = [*key, "part"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(meet, out)


def in_blocks(rows: DataFrame, key: list[str], block_rows: int) -> tuple[DataFrame, DataFrame]:
    """rows with their block of the cell (key), and the cells: key, blocks, longest, low and high (shares of the cell's coordinate)."""
    facts = [F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"), F.max("norm").alias("longest"), F.min("share").alias("low"), F.max("share").alias("high")]
    cells = cut(rows.groupBy(*key).agg(*facts))
    return rows.join(cells.select(*key, "blocks"), key).withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int")).drop("blocks", "share"), cells


def within_reach(scale: int) -> Column:
    """Whether the product of an anchor (asked, norm) with a vector of the cell (side, low, high, longest) can reach `least`."""
    at = F.abs("side")
    # Vectors shorter than the cell's coordinate have none of it.
    own = F.when((at > 0) & (at <= F.size("asked")), F.floor(scale * F.get("asked", at - 1).cast("double")).cast("double")).otherwise(0.0)
    angle = lambda x: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))
    x = angle(own / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0))
    apart = F.greatest(angle(F.col("high")) - x, x - angle(F.col("low")), F.lit(0.0))
    return F.col("norm") * F.col("longest") * F.greatest(F.cos(apart), F.lit(0.0)) * (1 + 1e-9) + 1e-6 >= F.col("least")


def visiting(asked: DataFrame, cells: DataFrame, on: list[str], scale: int) -> tuple[DataFrame, DataFrame]:
    """First visits (one block of the own cell), and all others to cells that can give `least` (null: unknown); asked: query, own, norm, bucket, side, first (own cell's block) and more."""
    first = asked.withColumn("block", F.col("first"))
    met = asked.withColumnsRenamed({"bucket": "home", "side": "home_side"})
    # Without a label there are two cells at most for each coordinate and each of some 15,000 buckets: doubles have a largest and a smallest power.
    met = met.join(cells, on) if on else met.join(F.broadcast(cells))
    met = met.where(F.col("least").isNull() | within_reach(scale))
    other = (F.col("bucket") != F.col("home")) | (F.col("side") != F.col("home_side")) | (F.col("block") != F.col("first"))
    rest = met.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where(other)
    return first, rest.drop("home", "home_side", "blocks", "longest", "low", "high")


def mine(df: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", base: float = 1.1, block_rows: int = 4096, query_rows: int = 2048, made=None) -> DataFrame:
    """anchor_id, positive_id, rank int, negative_id, positive_score, negative_score: for each row whose id is divisible by `every` and
    each of its `positives` best rows of the same label the `negatives` best rows of other labels whose score is from low to high
    percent of the positive's.  made: an accumulator for the number of products."""
    rows = cut(taking_part(df, id_col, vec_col, label_col, every, scale, base))
    anchors = rows.where("query is not null").select("query", F.col("id").alias("own"), F.col("v").alias("asked"), "norm", "label", "bucket", "side")
    hashed = lambda: F.pmod(F.xxhash64(F.lit(7), F.col("query")), F.col("blocks")).cast("int")

    def meet_own(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out, ids, names = [], b["id"].to_numpy(), a["query"].tolist()
        for i, at, scores in products(a, b, scale, made):
            top = best(scores, ids[at], positives)
            out.append((names[i], ids[at[top]], scores[top]))
        return framed(["query", "id", "score"], out)

    # Positives: cells by label, bucket and coordinate.
    key = ["label", "bucket", "side"]
    blocks, cells = in_blocks(rows.select("id", "v", "norm", "share", "label", "bucket", "side"), key, block_rows)
    asked = anchors.join(cells.select(*key, "blocks"), key).withColumn("first", hashed()).drop("blocks").withColumn("least", F.lit(None).cast("double"))
    by_score = W.partitionBy("query").orderBy(F.desc("score"), "id")
    begun = cut(tiles(visiting(asked, cells, ["label"], scale)[0], blocks, [*key, "block"], query_rows, meet_own, FOUND))
    bounds = begun.withColumn("place", F.row_number().over(by_score)).where(F.col("place") == positives).select("query", F.col("score").cast("double").alias("least"))
    rest = visiting(asked.drop("least").join(bounds, "query", "left"), cells, ["label"], scale)[1]
    found = begun.unionByName(tiles(rest, blocks, [*key, "block"], query_rows, meet_own, FOUND))
    top = cut(found.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= positives))

    # Negatives: cells by bucket and coordinate; each anchor has as many ranges as positives.
    hundreds, rest = F.expr("score div 100"), F.expr("score % 100")  # so that no product leaves 64 bits
    lo, hi = low * hundreds + F.ceil(low * rest / 100), high * hundreds + F.floor(high * rest / 100)
    ranges = top.where("score >= 0").select("query", "place", lo.alias("lo"), hi.alias("hi"))

    def wanted(ranges: DataFrame) -> DataFrame:
        return ranges.where("lo <= hi").groupBy("query").agg(F.min("lo").cast("double").alias("least"), F.collect_list(F.struct("place", "lo", "hi")).alias("ranges"))

    def meet_others(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out, ids, labels = [], b["id"].to_numpy(), b["label"].to_numpy()
        names, own_labels, asked_ranges = a["query"].tolist(), a["label"].tolist(), a["ranges"].tolist()
        for i, at, scores in products(a, b, scale, made):
            other = labels[at] != own_labels[i]
            at, scores = at[other], scores[other]
            for r in asked_ranges[i]:
                inside = (scores >= r["lo"]) & (scores <= r["hi"])
                own, top = ids[at[inside]], scores[inside]
                if len(top):
                    pick = best(top, own, negatives)
                    out.append((names[i], r["place"], own[pick], top[pick]))
        return framed(["query", "place", "id", "score"], out)

    key = ["bucket", "side"]
    blocks, cells = in_blocks(rows.select("id", "v", "norm", "share", "label", "bucket", "side"), key, block_rows)
    at_home = anchors.join(cells.select(*key, "blocks"), key).withColumn("first", hashed()).drop("blocks")
    in_range = W.partitionBy("query", "place").orderBy(F.desc("score"), "id")
    begun = cut(tiles(visiting(at_home.join(wanted(ranges), "query"), cells, [], scale)[0], blocks, [*key, "block"], query_rows, meet_others, PICKED))
    least = begun.withColumn("rank", F.row_number().over(in_range)).where(F.col("rank") == negatives).select("query", "place", F.col("score").alias("third"))
    raised = ranges.join(least, ["query", "place"], "left").select("query", "place", F.greatest("lo", "third").alias("lo"), "hi")
    rest = visiting(at_home.join(wanted(raised), "query"), cells, [], scale)[1]
    picked = begun.unionByName(tiles(rest, blocks, [*key, "block"], query_rows, meet_others, PICKED)).withColumn("rank", F.row_number().over(in_range)).where(F.col("rank") <= negatives)
    of = top.select("query", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = picked.select("query", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(of, ["query", "place"]).join(anchors.select("query", F.col("own").alias("anchor_id")), "query")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
