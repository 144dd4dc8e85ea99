"""MinHash near-duplicates by a multi-index Hamming join.

Each text becomes the set of its distinct word shingles, each set 32 minima of 16 bits.  A signature is split into
8 chunks of 4 values.  By pigeonhole, two signatures with at most 15 differing values have a chunk with at most one
difference, so every chunk is entered under its 4 ways of leaving one value out: all pairs under that distance meet.
(At similarity 0.8 two signatures miss each other in all chunks with a probability of about one in a million.)
Pairs that meet are tested by signature distance and by set sizes, then confirmed on their full sets.

Equal sets are one class from the start.  Entries that many classes share are not expanded into pairs: first every
class meets the entry's smallest and largest one, then its most central one (of which most shingles are held by others
too); classes then connected need no more comparison.  Classes still apart in an entry meet each other only where
their overlap can suffice: it is bounded by the shingles that many of them hold, counted in groups by hash, and by those
few hold that the pair shares.  So all links between components are found without expanding a group into pairs.

Defined cases: texts without words, null texts and rows with a null id are linked with nothing (component: own id);
repeated rows are one class; an empty table gives no rows; other columns are ignored.  Shingles, sets and classes are
compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, text_of, tidily
from .graphs import components
from .hashing import batches_of, mix, shingle_sets

VALUES, CHUNK = 32, 4
PACKED = [f"s{i}" for i in range(VALUES // 4)]
_SEEDS = mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Beyond this many differing values of 32 a pair of similarity 0.8 is practically out (one in 10**8).
FAR = 20
#: Shingles that fewer classes hold are looked up class by class; in a group of near copies they mark each copy's own changes.
FEW = 8
#: The others are counted in this many groups: near copies that changed different places fall short in different ones.
GROUPS = 32


def signature(s: np.ndarray) -> np.ndarray:
    """32 minima of a set, 16 bits of each, packed into 8 longs."""
    least = np.full(VALUES, np.uint64(2**64 - 1))
    for lo in range(0, len(s), 4096):
        x = (s[lo : lo + 4096, None] ^ _SEEDS) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        least = np.minimum(least, x.min(axis=0))
    return mix(least).astype(np.uint16).view(np.int64)


def signatures(df: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """id, n (set size), f (the set's hash; null for an empty one), s0.. (the packed signature)."""

    def run(batches):
        for b in chunks(batches, 2000):
            texts = b.column(1).to_pylist()
            n, f, packed = [], [], []
            for lo, hi in batches_of(texts):
                for s in shingle_sets(texts[lo:hi], width):
                    n.append(len(s))
                    f.append(set_hash(s) if len(s) else None)
                    packed.append(signature(s))
            grid = np.stack(packed)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(f, pa.int64()), *[pa.array(grid[:, i]) for i in range(len(PACKED))]], names=["id", "n", "f", *PACKED])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("t"))
    return rows.mapInArrow(tidily(run), "id long, n long, f long, " + ", ".join(f"{p} long" for p in PACKED))


def set_hash(s: np.ndarray) -> int:
    x = np.array([np.bitwise_xor.reduce(mix(s)), s.sum(dtype=np.uint64), len(s)], np.uint64)
    return int(mix(x[:1] ^ mix(x[1:2] + mix(x[2:]))).view(np.int64)[0])


def sets_of(df: DataFrame, width: int) -> DataFrame:
    """(id, t) -> f, words (the full set)."""

    def run(batches):
        for b in chunks(batches, 500):
            texts = b.column(1).to_pylist()
            for lo, hi in batches_of(texts):
                sets = shingle_sets(texts[lo:hi], width)
                yield pa.RecordBatch.from_arrays([pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["f", "words"])

    return df.mapInArrow(tidily(run), "f long, words array<long>")


def _value(i: int, side: str = "") -> Column:
    return F.shiftrightunsigned(F.col(f"{side}{PACKED[i // 4]}"), 16 * (i % 4)).bitwiseAND(0xFFFF)


def entries(classes: DataFrame) -> DataFrame:
    """key, f: each chunk of each signature with one of its values left out."""
    keys = []
    for c in range(VALUES // CHUNK):
        for out in range(CHUNK):
            key = F.lit(c * CHUNK + out).cast("long")
            for i in (i for i in range(CHUNK) if i != out):
                key = F.shiftleft(key, 16).bitwiseOR(_value(c * CHUNK + i))
            keys.append(key)
    return classes.select("f", F.explode(F.array(*keys)).alias("key"))


def _differing(a: str, b: str) -> Column:
    """How many of the 32 values differ: each long holds four, and the lowest bit of each says whether any of its 16 bits differs."""

    def of(p: str) -> Column:
        x = F.col(f"{a}{p}").bitwiseXOR(F.col(f"{b}{p}"))
        for by in (8, 4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, by))
        return F.bit_count(x.bitwiseAND(0x0001000100010001))

    return sum((of(p) for p in PACKED), F.lit(0))


def _close(a: str, b: str) -> Column:
    """Signature distance at most FAR."""
    return _differing(a, b) <= FAR


def _sizes_fit(a: str, b: str, least: int) -> Column:
    """Whether the sizes allow the similarity."""
    return 100 * F.least(f"{a}n", f"{b}n") >= least * F.greatest(f"{a}n", f"{b}n")


def _as(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{side}{c}") for c in df.columns])


def _both(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) with the facts of both sides."""
    return pairs.join(_as(facts, "a_"), F.col("a") == F.col("a_f")).join(_as(facts, "b_"), F.col("b") == F.col("b_f"))


def _apart(members: DataFrame) -> DataFrame:
    """(key, f, label): the members of entries that hold more than one component."""
    keys = members.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    return members.join(keys, "key", "left_semi")


def _shared_shingles(members: DataFrame, sets: DataFrame) -> DataFrame:
    """f, w, df: the shingles that at least two of the members (f) hold, and how many hold them."""
    each = sets.join(members.select("f").distinct(), "f", "left_semi").select("f", F.explode("words").alias("w"))
    held = each.groupBy("w").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    return each.join(held, "w")


def _overlaps(members: DataFrame, sets: DataFrame) -> DataFrame:
    """f, rare, groups: how many of a class's shingles fewer than FEW (but at least two) of the members hold, and, in GROUPS groups by hash, how many at least FEW hold."""
    many = F.col("df") >= FEW
    counts = [F.count(F.when(many & (F.pmod("w", F.lit(GROUPS)) == i), 1)).cast("int") for i in range(GROUPS)]
    return _shared_shingles(members, sets).groupBy("f").agg(F.count(F.when(~many, 1)).alias("rare"), F.array(*counts).alias("groups"))


def _few(members: DataFrame, sets: DataFrame) -> DataFrame:
    """a < b, k: pairs of different components that share k shingles which fewer than FEW members hold."""
    each = cut(_shared_shingles(members, sets).where(F.col("df") < FEW).select("f", "w").join(members, "f"))
    pairs = _as(each, "a_").join(_as(each, "b_"), (F.col("a_w") == F.col("b_w")) & (F.col("a_f") < F.col("b_f")) & (F.col("a_label") != F.col("b_label")))
    return pairs.groupBy(F.col("a_f").alias("a"), F.col("b_f").alias("b")).agg(F.count(F.lit(1)).alias("k"))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda s, x: s + x)


def _enough(k: Column, least: int, rare: bool = False) -> Column:
    """Whether two sets' overlap can reach the similarity: group by group it is at most the smaller number of common
    shingles, and besides them the rare ones they share (k; with rare=True all that the poorer one has)."""
    common = _sum(F.zip_with("a_groups", "b_groups", lambda x, y: F.least(x, y)))
    more = F.least("a_rare", "b_rare") if rare else k
    return (100 + least) * (common + more) >= least * (F.col("a_n") + F.col("b_n"))


def _common(side: str = "") -> Column:
    """How many shingles of a class are held by many."""
    return _sum(F.col(f"{side}groups"))


def _fits(least: int) -> Column:
    """Whether a class's common shingles alone can reach the similarity with any other: the other's size is at least `least` percent of its own."""
    return 100 * _common() >= least * F.col("n")


def _spare(least: int, side: str = "") -> Column:
    """What a class's other shingles leave of the difference that a pair may have, (n_a + n_b) * (100 - least) / (100 + least).
    Sets that share no others differ in all of them, so a pair's spares sum to 0 or more: one side's is not negative."""
    return (100 - least) * F.col(f"{side}n") - (100 + least) * (F.col(f"{side}n") - _common(side))


def near_duplicates(df: DataFrame, width: int = 5, least: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles long, component_id long, kept boolean for each row of df: linked are documents with
    100 * intersection >= least * union of their shingle sets; kept is the smallest id of each component."""
    base = cut(signatures(df, width, id_col, text_col))
    classes = cut(classes_of(base))
    each = entries(classes)
    ends = each.groupBy("key").agg(F.min("f").alias("low"), F.max("f").alias("high"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    shared = cut(each.join(ends, "key"))
    out = grouped(df, base, classes, shared, _close, width, least, id_col, text_col)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def classes_of(base: DataFrame) -> DataFrame:
    """The different sets of base (id, n, f, packed signature), each with its smallest id."""
    return base.where("f is not null and id is not null").groupBy("f").agg(F.min("id").alias("id"), F.max("n").alias("n"), *[F.max(p).alias(p) for p in PACKED])


def grouped(df: DataFrame, base: DataFrame, classes: DataFrame, shared: DataFrame, close: Callable[[str, str], Column], width: int, least: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, component_id for each row of base.  shared (key, f, low, high, rows): the entries in which linked classes meet, with
    their smallest and largest class; close: whether the signatures of two sides (prefixes of columns) allow a link."""
    may_link = lambda: _sizes_fit("a_", "b_", least) & close("a_", "b_")
    facts = classes.select("f", "n", *PACKED)
    involved = shared.select("f").distinct().join(classes.select("f", "id"), "f")
    texts = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("t"))
    owners = cut(involved.select("id").distinct())  # of known size, so that few are sent to the texts
    sets = cut(sets_of(texts.join(owners, "id", "left_semi"), width).join(involved.select("f"), "f", "left_semi").dropDuplicates(["f"]))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of near pairs (a, b) those whose full sets reach the similarity."""
        full = pairs.join(_as(sets, "a_"), F.col("a") == F.col("a_f")).join(_as(sets, "b_"), F.col("b") == F.col("b_f"))
        both = F.size(F.array_intersect("a_words", "b_words"))
        return full.where(100 * both >= least * (F.size("a_words") + F.size("b_words") - both)).select("a", "b")

    stars = shared.select(F.col("low").alias("a"), F.col("f").alias("b")).unionByName(shared.select(F.col("f").alias("a"), F.col("high").alias("b"))).where("a <> b").distinct()
    near = _both(stars, facts).where(may_link()).select("a", "b")
    links = cut(confirmed(near))
    label = cut(components(links))
    # What is still apart in an entry of three or more classes meets the entry's most central class first.
    labelled = lambda x: x.join(label.withColumnRenamed("node", "f"), "f", "left").withColumn("label", F.coalesce("label", "f"))
    wide = shared.where("rows > 2").select("key", "f")
    rest = cut(_apart(labelled(wide)))
    sets = cut(sets.join(rest.select("f").distinct(), "f", "left_semi"))  # no others are needed from here on
    facts = cut(_overlaps(rest, sets).join(facts, "f"))
    able = cut(rest.select("key", "f").join(facts, "f"))
    centre = able.groupBy("key").agg(F.max(F.struct((_common() + F.col("rare")) / F.col("n"), "f")).alias("c")).select("key", F.col("c.f").alias("b"))
    second = able.select("key", "f").join(centre, "key").where("f <> b").select(F.col("f").alias("a"), "b").distinct()
    more = cut(confirmed(_both(second, facts).where(may_link() & _enough(F.lit(0), least, rare=True)).select("a", "b")))
    # Components so far are stars about their labels: these stand for their links.
    as_links = lambda x: x.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    label = cut(components(as_links(label).unionByName(more)))
    # Then classes of different components meet if their overlap can suffice: through the shingles that many
    # share, or through those that few share, where a pair has some.
    last = cut(labelled(able.select("key", "f")))
    left = cut(_apart(last.select("key", "f", "label")).join(facts, "f"))
    fit = cut(_apart(left.where(_fits(least))))
    main = fit.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(F.max(F.struct("k", "label")).alias("top")).select("key", F.col("top.label").alias("main"))
    fit = cut(fit.join(main, "key").select("key", "f", "label", "n", (F.col("label") != F.col("main")).alias("minor"), _spare(least).alias("spare"), "groups", *PACKED))
    # Cheap tests stand first.
    cheap = (F.col("a_label") != F.col("b_label")) & (F.col("a_minor") | F.col("b_minor")) & (F.col("a_spare") + F.col("b_spare") >= 0)
    dear = _enough(F.lit(0), least) & close("a_", "b_")
    met = _as(fit.where("spare >= 0"), "a_").join(_as(fit, "b_"), (F.col("a_key") == F.col("b_key")) & cheap & dear)
    few = _few(left.select("f", "label").distinct(), sets)
    close = _both(few, facts).where(_enough(F.col("k"), least) & may_link()).select("a", "b")
    final = met.select(F.least("a_f", "b_f").alias("a"), F.greatest("a_f", "b_f").alias("b")).unionByName(close).distinct()
    more = cut(confirmed(final))
    if not more.isEmpty():
        label = components(as_links(label).unionByName(more))
    named = classes.select("f", "id").join(label.withColumnRenamed("node", "f"), "f", "left").select("f", "id", F.coalesce("label", "f").alias("label"))
    least_id = named.groupBy("label").agg(F.min("id").alias("component"))
    of_class = named.join(least_id, "label").select("f", "component")
    out = base.select("id", "n", F.when(F.col("id").isNotNull(), F.col("f")).alias("f")).join(of_class, "f", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
