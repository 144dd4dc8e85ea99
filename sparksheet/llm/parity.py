"""Jaccard join of documents' word shingles by parity sketches.

A document's set of shingles is cut into k chunks by a hash of each shingle, and each chunk is kept as the parity of its shingles' 64-bit
hashes: each shingle flips its own pattern of bits.  A shingle that one of two sets lacks changes one chunk, and the similarity
allows a pair of sizes (x, y) at most d = (x + y) * (100 - least) / (100 + least) different shingles.  The number of chunks grows with the sets:
documents of one size band (sizes up to a power of two, or to three quarters of one) have k, a fifth over the most differences in the band.
Of two linked sets at most d chunks differ, so k - d are equal: by pigeonhole, if each enters its d + 1 chunks
that come first in an order which all share, they meet in one of them.  That order is by how many documents have the
chunk, the rarest first: what many have by a common passage is not entered, and a document of which d + 1
chunks are its own meets no other.  Chunks of different shingles are told apart at any number of documents (but for one pair in 2**64), so
documents do not meet by chance more often the more there are.  A document whose larger partners can lie in the next band enters there too, as cut for that band.

The chunks are looked through in PARTS parts by their hash, one after the other, so that only one part of them is on its way at a time; what
one set has alone goes before the next part begins.  A task writes the chunks of a set that it has several times once; what several tasks write is told by the set's hash.

Documents that meet are parted where their sizes leave a gap that no link bridges, tested by sizes and by a sketch of 512 bits, then verified on their full sets.  Equal sets are one class
from the start, and entries that many classes share are not expanded into pairs (`neardup.grouped`).

Defined cases: texts without words, null texts and rows with a null id are linked with nothing (component: own id);
repeated rows are one class; an empty table gives no rows; other columns are ignored.  Shingles, sets and classes are
compared by 64-bit hashes.  least must be 76 or more: a smaller similarity reaches beyond the next band.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import chunks, cut, discard, text_of, tidily
from .hashing import batches_of, mix, shingle_sets
from .neardup import PACKED, classes_of, grouped, set_hash

SKETCH_BITS = 64 * len(PACKED)
#: So many parts of all chunks, by their hash: each is shuffled by itself.
PARTS = 4
KEYS = [f"keys{i}" for i in range(PARTS)]


def most_apart(x: int, y: int, least: int) -> int:
    """The most shingles in which linked sets of x and y shingles differ."""
    return (100 - least) * (x + y) // (100 + least)


def band_of(n: int) -> int:
    """Bands of sizes in order: those of b bits, below three quarters of 2**b (even), or from there (odd)."""
    b = n.bit_length()
    return 2 * b + (4 * n >= 3 << b)


def largest(band: int) -> int:
    b = band // 2
    return (1 << b) - 1 if band % 2 else ((3 << b) - 1) // 4


def chunk_keys(s: np.ndarray, band: int, least: int) -> np.ndarray:
    """The chunks of a set (sorted hashes) as cut for a band, each as a hash of band, place and parity, of which the last bit tells whether the band is odd."""
    k = -(-6 * (most_apart(largest(band), largest(band), least) + 1) // 5)
    chunk = ((s >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)  # sorted, as s is
    starts = np.flatnonzero(np.diff(chunk, prepend=-1))
    bits = np.zeros(k, np.uint64)
    bits[chunk[starts]] = np.bitwise_xor.reduceat(mix(s), starts)
    keys = mix(bits ^ mix(np.arange(k, dtype=np.uint64) + np.uint64(band << 48)))
    return keys & ~np.uint64(1) | np.uint64(band & 1)


def entries_of(s: np.ndarray, least: int) -> np.ndarray:
    """The chunks of a set in its own band and, where larger partners can lie there, in the next.  A set whose partners could only equal it has none."""
    n = len(s)
    band, reach = band_of(n), 100 * n // least
    out = [chunk_keys(s, band, least)] if most_apart(n, min(reach, largest(band)), least) else []
    if reach > largest(band) and most_apart(n, reach, least):
        out.append(chunk_keys(s, band + 1, least))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def parts_of(keys: np.ndarray) -> list[np.ndarray]:
    """Entries in PARTS parts by their first bits."""
    part = (keys >> np.uint64(32)) * np.uint64(PARTS) >> np.uint64(32)
    return [keys[part == i].view(np.int64) for i in range(PARTS)]


def skipped(n: Column, key: Column, least: int) -> Column:
    """How many of a set's k chunks in the band of an entry are not entered: all but the first d + 1."""
    bits = F.length(F.bin(n))
    power = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)
    odd = F.when(4 * n >= 3 * power(bits), 1).otherwise(0)
    band = 2 * bits + odd + F.when(F.pmod(key, F.lit(2)) == odd, 0).otherwise(1)
    top = power(F.floor(band / 2).cast("int"))
    high = F.when(band % 2 == 1, top - 1).otherwise(F.floor((3 * top - 1) / 4).cast("long"))
    apart = lambda x, y: F.floor((100 - least) * (x + y) / (100 + least)).cast("long")  # noqa: E731  far below 2**53
    d = apart(n, F.least(F.floor(100 * n / least).cast("long"), high))
    return F.ceil(6 * (apart(high, high) + 1) / 5).cast("long") - d - 1


def several(each: DataFrame) -> DataFrame:
    """each (key, f): chunks of sets, repeated where several tasks have a set -> key, f, held: those that several sets have, once for each set, and how many have them."""
    # A chunk's share of all rows is at most that of one document in one of its many chunks.
    before = F.lag("f").over(W.partitionBy("key").orderBy("f"))
    once = each.select("key", "f", before.alias("before")).where("before is null or before <> f")
    return once.select("key", "f", F.count(F.lit(1)).over(W.partitionBy("key")).alias("held")).where("held > 1")


def meeting(each: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """each (key, f): all chunks of all sets -> the entries in which sets meet, as by `met`."""
    return met(several(each), classes, least)


def met(held: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """held (key, f, held): the chunks that several sets have -> key, f, low, high, rows: the entries in which sets meet, with their smallest and largest set
    (where sizes forbid a link to one of these, the set itself stands there)."""
    held = held.join(classes.select("f", "n"), "f")
    place = F.row_number().over(W.partitionBy("f", F.pmod("key", F.lit(2))).orderBy(F.desc("held"), "key"))
    entered = held.withColumn("place", place).where(F.col("place") > skipped(F.col("n"), F.col("key"), least)).select("key", "f", "n")
    # By size: where the next set is too large for the one before it, another entry begins.
    in_order = W.partitionBy("key").orderBy("n", "f")
    gap = F.when(100 * F.lag("n").over(in_order) < least * F.col("n"), 1).otherwise(0)
    runs = entered.withColumn("gap", gap).select("key", "f", "n", F.sum("gap").over(in_order).alias("run"))
    ends = W.partitionBy("key", "run")
    found = runs.select("key", "run", "f", "n", F.min(F.struct("f", "n")).over(ends).alias("low"), F.max(F.struct("f", "n")).over(ends).alias("high"), F.count(F.lit(1)).over(ends).alias("rows")).where("rows > 1")
    fits = lambda x: F.when(100 * F.least("n", x["n"]) >= least * F.greatest("n", x["n"]), x["f"]).otherwise(F.col("f"))
    return found.select(F.xxhash64("key", "run").alias("key"), "f", fits(F.col("low")).alias("low"), fits(F.col("high")).alias("high"), "rows")


def sketch(s: np.ndarray) -> np.ndarray:
    """The parity sketch of 512 bits as 8 longs."""
    odd = np.bincount((s & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketches(df: DataFrame, width: int, least: int, id_col: str, text_col: str) -> DataFrame:
    """id, n (set size), f (the set's hash; null for an empty one), s0.. (the sketch), keys0.. (its entries in PARTS parts, empty where the task had the set in an earlier row)."""

    def run(batches):
        had: set[int] = set()
        for b in chunks(batches, 500):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            n, f, packed, keys = [], [], [], []
            for lo, hi in batches_of(texts):
                for s in shingle_sets(texts[lo:hi], width):
                    own = set_hash(s) if len(s) else None
                    new = own is not None and ids[len(n)] is not None and own not in had
                    if new:
                        had.add(own)
                    n.append(len(s))
                    f.append(own)
                    packed.append(sketch(s))
                    keys.append(parts_of(entries_of(s, least)) if new else [[]] * PARTS)
            grid = np.stack(packed)
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(f, pa.int64()), *[pa.array(grid[:, i]) for i in range(len(PACKED))], *[pa.array(k, pa.list_(pa.int64())) for k in zip(*keys, strict=True)]]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "f", *PACKED, *KEYS])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("t"))
    return rows.mapInArrow(tidily(run), "id long, n long, f long, " + ", ".join([*(f"{p} long" for p in PACKED), *(f"{k} array<long>" for k in KEYS)]))


def close(least: int):
    """Whether the 512-bit sketches of two sides differ in no more bits than a link allows shingles."""

    def of(a: str, b: str) -> Column:
        apart = sum((F.bit_count(F.col(f"{a}{p}").bitwiseXOR(F.col(f"{b}{p}"))) for p in PACKED), F.lit(0))
        return (100 + least) * apart <= (100 - least) * (F.col(f"{a}n") + F.col(f"{b}n"))

    return of


def jaccard_groups(df: DataFrame, width: int = 4, least: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles long, component_id long for each row of df: linked are documents with 100 * intersection >= least * union
    of their shingle sets."""
    if least < 76:
        raise ValueError("least must be 76 or more")
    full = cut(sketches(df, width, least, id_col, text_col))
    base = cut(full.drop(*KEYS))
    classes = cut(classes_of(base))
    held = [cut(several(full.select("f", F.explode(k).alias("key")))) for k in KEYS]
    discard(full)  # the entries are the larger part of it
    shared = cut(met(reduce(DataFrame.unionByName, held), classes, least))
    discard(*held)
    out = grouped(df, base, classes, shared, close(least), width, least, id_col, text_col)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id")
