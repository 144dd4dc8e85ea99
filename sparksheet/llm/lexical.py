"""Ranked lexical search by range-maximum tables over posting lists, best interval first.

One pass over the texts keeps of each document its length and the query terms it holds.  Documents are dealt into shards of about
`shard_postings` postings.  In a shard, documents stand in order of their ids, and each term's posting list is an array of impacts
(what one occurrence of weight 1 in a query adds to the score) in that order; a sparse table over it answers where in any
interval its largest impact stands.  For an item, the answers of its terms, times their weights, sum to a bound of what any document
of an interval can score.  The search starts with the whole shard, takes the intervals of highest bound, scores the document at
which the weightiest of their maxima stands, and splits them there, until no interval left can beat the k-th score found.
The shards' k best then meet by item.

Items are the stated query set: they are sent to every shard, in parts of about `item_terms` terms.  Up to `most_terms` different
query terms (8 bytes each) are sent to the tasks that read texts; beyond, these write all their terms and a join keeps the asked ones.

Defined cases: null and empty texts have no terms, count nowhere and are never returned; documents with a null id count, but
are not returned; repeated documents are documents of their own, with one rank each; repeated item rows count once, different
texts of one item id are read as one text; items with a null id take no part; other columns are ignored; empty tables give no
rows.  Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import chunks, cut, text_of, tidily
from .hashing import TERM, batches_of, word_hashes

SATURATION, LENGTH_SHARE = 8, 75


def occurrences(df: DataFrame, id_col: str, text_col: str, wanted: np.ndarray | None = None) -> DataFrame:
    """id, n (terms with repeats), terms (different ones, of the wanted hashes if given), tfs (how often each occurs)."""

    def run(batches):
        for b in chunks(batches):
            texts = b.column(1).to_pylist()
            for lo, hi in batches_of(texts):
                parts = [t.encode("utf-8", "surrogatepass") + b"\n" for t in texts[lo:hi]]
                ends = np.cumsum([len(p) for p in parts]) - 1
                words, owner = word_hashes(b"".join(parts), ends, TERM)
                n = np.bincount(owner, minlength=hi - lo)
                if wanted is not None:
                    some = wanted[np.minimum(np.searchsorted(wanted, words), len(wanted) - 1)] == words if len(wanted) else np.zeros(len(words), bool)
                    words, owner = words[some], owner[some]
                order = np.lexsort((words, owner))
                words, owner = words[order], owner[order]
                first = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])])) if len(words) else np.zeros(0, int)
                tfs = np.diff(np.append(first, len(words)))
                at = pa.array(np.searchsorted(owner[first], np.arange(hi - lo + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (words[first].view(np.int64), tfs.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), *lists], names=["id", "n", "terms", "tfs"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("t"))
    return rows.mapInArrow(tidily(run), "id long, n long, terms array<long>, tfs array<long>")


class Postings:
    """A shard's posting lists end to end, each in order of the documents' places, with one sparse table over all."""

    def __init__(self, terms: np.ndarray, places: np.ndarray, impacts: np.ndarray, documents: int):
        self.documents = documents
        self.terms, own = np.unique(terms, return_inverse=True)
        keys = own.astype(np.int64) * documents + places
        order = np.argsort(keys, kind="stable")
        self.keys, self.impacts = keys[order], impacts[order].astype(np.int64)
        self.first = np.searchsorted(self.keys, np.arange(len(self.terms) + 1) * documents)
        longest = int(np.diff(self.first).max(initial=1))
        table = [np.arange(len(keys), dtype=np.int32)]
        for j in range(longest.bit_length() - 1):
            left, right = table[-1][: -(1 << j)], table[-1][1 << j :]
            best = table[-1].copy()
            best[: len(left)] = np.where(self.impacts[left] >= self.impacts[right], left, right)
            table.append(best)
        self.table = np.stack(table)
        self.level = np.zeros(longest + 1, np.int8)
        for j in range(1, longest.bit_length()):
            self.level[1 << j :] = j

    def largest(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in each [lo, hi) of a list its largest impact stands (the first of equal ones), and that impact (0 in an empty interval)."""
        some = hi > lo
        lo, hi = np.where(some, lo, 0), np.where(some, hi, 1)
        j = self.level[hi - lo]
        a, b = self.table[j, lo], self.table[j, hi - (1 << j.astype(np.int64))]
        at = np.where(self.impacts[a] >= self.impacts[b], a, b)
        return at, np.where(some, self.impacts[at], 0)

    def best(self, asked: np.ndarray, weights: np.ndarray, k: int, scored=None) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents for one item, ties to the smaller place.  scored: told how many documents were scored."""
        t = np.minimum(np.searchsorted(self.terms, asked), max(len(self.terms) - 1, 0))
        held = self.terms[t] == asked if len(self.terms) else np.zeros(len(asked), bool)
        t, weights = t[held], weights[held]
        places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(t):
            return places, scores
        base, ts = t * self.documents, np.arange(len(t))

        def bounded(lo, hi, start):
            """The intervals (rows of lo, hi by term) that can still hold an answer, with bounds and the documents to split them at."""
            at, most = self.largest(lo, hi)
            most = most * weights
            bound, top = most.sum(axis=1), most.argmax(axis=1)
            split = self.keys[at[np.arange(len(at)), top]] - base[top]
            may = (bound > 0) & able(bound, start)
            return [x[may] for x in (bound, start, split, lo, hi)]

        def able(bound, start):
            return (bound > scores[-1]) | ((bound == scores[-1]) & (start < places[-1])) if len(scores) == k else np.ones(len(bound), bool)

        open_ = bounded(self.first[t][None, :], self.first[t + 1][None, :], np.zeros(1, np.int64))
        width = 8
        while len(open_[0]):
            pick = np.argpartition(-open_[0], width - 1)[:width] if len(open_[0]) > width else np.arange(len(open_[0]))
            _, start, split, lo, hi = (x[pick] for x in open_)
            rest = np.ones(len(open_[0]), bool)
            rest[pick] = False
            goal = base + split[:, None]
            p = np.searchsorted(self.keys, goal)
            hit = (p < hi) & (self.keys[np.minimum(p, len(self.keys) - 1)] == goal)
            found = (np.where(hit, self.impacts[np.minimum(p, len(self.keys) - 1)], 0) * weights).sum(axis=1)
            if scored:
                scored(len(pick))
            places, scores = np.append(places, split), np.append(scores, found)
            order = np.lexsort((places, -scores))[:k]
            places, scores = places[order], scores[order]
            more = bounded(np.concatenate([lo, p + hit]), np.concatenate([p, hi]), np.concatenate([start, split + 1]))
            rest &= able(open_[0], open_[1])
            open_ = [np.concatenate([x[rest], y]) for x, y in zip(open_, more, strict=True)]
            width = min(2 * width, 1024)
        return places, scores


def search(docs: pd.DataFrame, items: pd.DataFrame, k: int) -> pd.DataFrame:
    """item_id, doc_id, score: the k best documents (id, m, terms, tfs) of a shard for each item (item_id, asked, weights)."""
    out = []
    if len(docs) and len(items):
        docs = docs.sort_values("id", kind="stable")
        sizes = docs["terms"].map(len).to_numpy()
        places = np.repeat(np.arange(len(docs)), sizes)
        tf, m = np.concatenate(docs["tfs"].to_list()).astype(np.int64), docs["m"].to_numpy()
        lists = Postings(np.concatenate(docs["terms"].to_list()), places, (1_000_000_000 * tf) // (1000 * tf + SATURATION * m[places]), len(docs))
        ids = docs["id"].to_numpy()
        for item, asked, weights in zip(items["item_id"], items["asked"], items["weights"], strict=True):
            where, scores = lists.best(np.asarray(asked), np.asarray(weights), k)
            out += [(item, ids[p], s) for p, s in zip(where.tolist(), scores.tolist(), strict=True)]
    return pd.DataFrame(out, columns=["item_id", "doc_id", "score"]).astype("int64")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_postings: int = 500_000, item_terms: int = 200_000, most_terms: int = 1_000_000) -> DataFrame:
    """item_id long, rank int (from 1), doc_id long, score long: each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    texts = items.select(F.col(f"`{item_col}`").alias("i"), text_of(item_text_col).alias("t")).where("i is not null").distinct()
    each = occurrences(texts, "i", "t").select("id", F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
    asked = cut(each.groupBy(F.col("id").alias("item_id"), F.col("x.terms").alias("term")).agg(F.sum("x.tfs").alias("times")))
    terms = cut(asked.select("term").distinct())
    wanted = None
    if terms.count() <= most_terms:
        wanted = np.sort(terms.toPandas()["term"].to_numpy(np.int64).view(np.uint64))
    held = cut(occurrences(docs, id_col, text_col, wanted).where("n > 0").withColumn("row", F.monotonically_increasing_id()))
    documents, length = held.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not documents:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if wanted is None:
        some = held.select("row", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("row", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf")).join(terms, "term", "left_semi")
        lists = some.groupBy("row").agg(F.collect_list(F.struct("term", "tf")).alias("x")).select("row", F.col("x.term").alias("terms"), F.col("x.tf").alias("tfs"))
        held = cut(held.select("id", "n", "row").join(lists, "row"))
    postings = held.agg(F.sum(F.size("terms")).alias("n"), F.count(F.lit(1))).first()["n"] or 0
    df = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2.0 * documents + 2) / (2 * F.col("df") + 1)))
    weighed = cut(asked.join(df, "term").groupBy("item_id").agg(F.collect_list("term").alias("asked"), F.collect_list(F.col("times") * weight).alias("weights")))
    size = weighed.agg(F.sum(F.size("asked"))).first()[0] or 0
    shards, parts = max(1, -(-postings // shard_postings)), max(1, -(-size // item_terms))
    m = F.expr(f"{100 - LENGTH_SHARE} + (({LENGTH_SHARE} * n * {documents}) div {length})")
    left = held.where("id is not null and size(terms) > 0").select("id", m.alias("m"), "terms", "tfs", F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    right = weighed.withColumns({"part": F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int"), "shard": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))})

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return search(a, b, k)

    found = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInPandas(meet, "item_id long, doc_id long, score long")
    order = W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
