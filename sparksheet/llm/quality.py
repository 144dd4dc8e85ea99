"""Quality and toxicity by hierarchical empirical Bayes.

A document's own evidence is a naive-Bayes score over hashed words and character shapes (features with a clear
chi-square only), learned from a bounded sample of labelled documents (`train_rows`, the smallest hashes of their
ids; two thirds fit, a third calibrates).  Sites add theirs: over all labelled documents, grouped by path, host and
in total, a path's share of ones is shrunk toward its host's and a host's toward the global one, each as strongly as
the spread of paths about their host's share, and of hosts about the global one, says (method of moments).  A
document's own labels do not count for its site.  Log odds add up, weighted by one logistic fit over both on the held
third, so that the sum is calibrated.

Defined cases: null texts count as empty; null hosts or paths are sites of their own; unlabelled documents and
documents of unlabelled sites get the shrunk (at last the global) prior; without labels all keep (p_quality 1,
p_toxic 0); rows of equal id are scored each on its own; several labels of one document count each.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of
from .evidence import GRAMS, feature_counts, features, logistic, odds, scored

EDGE = 1e-6


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, parent: Column, ones: str) -> float:
    """How many documents a parent's share is worth as its groups' prior: by the spread of their shares about it beyond what chance explains; 1 to 10,000."""
    n, x = F.col("n").cast("double"), F.col(ones)
    per = groups.groupBy(parent.alias("parent")).agg(F.sum(n).alias("n"), F.sum(x).alias("x"), F.count(F.lit(1)).alias("k"), F.sum(x * x / n).alias("xx"), F.sum(n * n).alias("nn"))
    m = F.col("x") / F.col("n")
    got = per.agg(F.sum("n").alias("n"), F.sum(F.col("xx") - F.col("n") * m * m).alias("s"), F.sum((F.col("k") - 1) * m * (1 - m)).alias("chance"), F.sum(F.col("n") - F.col("nn") / F.col("n")).alias("room"), F.sum(F.col("n") * m * (1 - m)).alias("level")).first()
    if not got["n"] or not got["room"] or got["room"] <= 0:
        return 10_000.0
    between = (got["s"] - got["chance"]) / got["room"]
    return float(np.clip((got["level"] / got["n"] - between) / max(between, 1e-9), 1, 10_000))


def site_evidence(own: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """own (host, path, own_n, own_y, own_z: a document's labels, how many and their sums; ..) with site_y and site_z, what the
    other documents of its site make of its log odds; and the labels' means, none without labels."""
    by_path = cut(own.where("own_n > 0").groupBy("host", "path").agg(*[F.sum(f"own_{c}").alias(c) for c in ("n", "y", "z")]))
    by_host = by_path.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "y", "z")])
    everything = by_host.agg(*[F.sum(c).alias(c) for c in ("n", "y", "z")]).first()
    if not everything["n"]:
        return own, {}
    rename = lambda x, side: x.select(F.col(side), *[F.col(c).alias(f"{side}_{c}") for c in ("n", "y", "z")])
    full = own.join(rename(by_path, "path"), "path", "left").join(rename(by_host, "host"), "host", "left")
    others = lambda side, c: F.coalesce(F.col(f"{side}_{c}") - F.col(f"own_{c}"), F.lit(0.0))
    means, site = {c: everything[c] / everything["n"] for c in ("y", "z")}, {}
    for c, mean in means.items():
        k_host, k_path = _strength(by_host, F.lit(0), c), _strength(by_path, F.col("host"), c)
        h = (others("host", c) + k_host * mean) / (others("host", "n") + k_host)
        site[c] = _logit((others("path", c) + k_path * h) / (others("path", "n") + k_path)) - _logit(F.lit(mean))
    return full.select(*own.columns, site["y"].alias("site_y"), site["z"].alias("site_z")), means


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_cols: tuple[str, ...] = ("lang",), good: str = "quality", bad: str = "toxic", train_rows: int = 30_000, cutoff: float = 0.5) -> DataFrame:
    """id_col, host, path, p_quality, p_toxic (doubles), keep boolean for each row of df."""
    host = F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("\0"))
    path = F.concat_ws("/", host, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in path_cols])
    docs = df.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"), text_of(text_col).alias("t"))
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{good}`").cast("double").alias("y"), F.col(f"`{bad}`").cast("double").alias("z")).dropna()
    sample = cut(known.orderBy(F.xxhash64("id"), "id", "y", "z").limit(train_rows).withColumn("held", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(3)) == 0))
    # At most train_rows small rows.
    learn = docs.select("id", "t").join(F.broadcast(sample.where("not held")), "id").select("y", "z", "t")
    counts = feature_counts(learn).toPandas()
    total = sample.where("not held").agg(F.count(F.lit(1)), F.sum("y"), F.sum("z")).first()
    weights = np.zeros((9 * GRAMS, 2))
    for i, c in enumerate(("y", "z")):
        weights[counts["feature"].to_numpy(int), i] = odds(counts["n"].to_numpy(), counts[c].to_numpy(), total[0], total[i + 1] or 0)
    kind = df.schema[id_col].dataType.simpleString()
    own = cut(scored(docs, f"id {kind}, host string, path string", lambda t: tuple(weights[features(t)].sum(axis=0)), ["good", "bad"]))
    labelled = known.groupBy("id").agg(F.count(F.lit(1)).alias("own_n"), F.sum("y").alias("own_y"), F.sum("z").alias("own_z"))
    own = own.join(labelled, "id", "left").fillna(0, ["own_n", "own_y", "own_z"])
    full, means = site_evidence(own)
    if not means:
        return own.select(F.col("id").alias(id_col), "host", "path", F.lit(1.0).alias("p_quality"), F.lit(0.0).alias("p_toxic"), F.lit(True).alias("keep"))
    # At most train_rows small rows.
    held = full.join(F.broadcast(sample.where("held")), "id").select("good", "bad", "site_y", "site_z", "y", "z").toPandas()
    p = {}
    for c, name in (("y", "good"), ("z", "bad")):
        mean = means[c]
        if len(held):
            a, s, b = logistic(held[[name, f"site_{c}"]].to_numpy(float), held[c].to_numpy(float))
        else:
            a, s, b = 1.0, 1.0, float(np.log(max(mean, EDGE) / max(1 - mean, EDGE)))
        sum_of = a * F.col(name) + s * F.col(f"site_{c}") + b
        p[c] = 1 / (1 + F.exp(-F.least(F.greatest(sum_of, F.lit(-50.0)), F.lit(50.0))))
    return full.select(F.col("id").alias(id_col), "host", "path", p["y"].alias("p_quality"), p["z"].alias("p_toxic")).withColumn("keep", (F.col("p_quality") >= cutoff) & (F.col("p_toxic") < cutoff))
