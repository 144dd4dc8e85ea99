"""Line dedup by a segment-partition edit join.

Two lines within `threshold` edits: cut one into threshold + 1 segments, and the other holds one of them unchanged, at
most `threshold` places off.  So every different line of at least `min_chars` characters is entered under its segments
(with length and segment number), and every such line probes the substrings that can match a segment of a line of its own or
a smaller length; the places to probe follow from the edits left on either side.  Lines that meet are verified with a
banded bit-parallel edit distance.  Hashes of all segments and substrings come from one rolling hash over a batch.

Entries that more than `wide` lines share are not expanded into pairs.  Each of their lines is entered again under what
remains of it without one character, and the place of that character.  Lines with the same rest and place differ by at
most this one character, so all of them are linked to the smallest; a line that is itself such a rest is linked to all
lines it remains of.  These are all pairs at one edit, up to links that follow.  This holds for threshold 1, the default;
with a larger threshold wide entries are compared pair by pair (exact, but quadratic in an entry).

Shorter lines are repeats only of equal ones: one edit makes another word of them.  Blank lines (nothing but blanks and
control characters) part paragraphs and always stay.

Linked lines and equal lines are one class, equal ones being told by a hash of 64 bits; the first row of a class (smallest
id, then line) stays, later lines go.

Defined cases: null texts count as empty; a text of which all lines go becomes empty, its
row stays; rows of equal id are one owner, each losing its own repeats; rows with a null id stay as they are; an empty
table gives no rows; other columns stay, but those named n_lines, n_removed or removed are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, free_name, text_of, tidily
from .graphs import components
from .hashing import Rolling, batches_of, mix


def _grid(texts: list[str], width: int, fill: int) -> np.ndarray:
    """Texts as rows of code points, filled up to width."""
    out = np.full((len(texts), width), fill, np.uint32)
    sizes = np.array([len(t) for t in texts])
    out[np.arange(width) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def edits_within(xs: list[str], ys: list[str], most: int, cells: int = 1 << 19) -> np.ndarray:
    """For each pair (x, y) whether its edit distance is at most `most`, by banded bit-parallel columns, many pairs at once.

    Each pair has one 64-bit word for each kind of difference between neighbouring cells.  Its highest bit is the cell
    `most` rows below the diagonal, and with every column the band moves down a row.  The distance is followed along the
    band's lower edge to the last row of x, and along that row to the last column."""
    if not 0 <= most <= 31:
        raise ValueError("a threshold of 0 to 31 edits")
    m, n = np.array([len(x) for x in xs], np.int64), np.array([len(y) for y in ys], np.int64)
    out = np.zeros(len(xs), bool)
    near = np.flatnonzero(np.abs(m - n) <= most)
    near = near[np.argsort(n[near], kind="stable")]
    one, top, lo = np.uint64(1), np.uint64(63), 0
    while lo < len(near):
        hi = lo + 1
        while hi < len(near) and (hi + 1 - lo) * (n[near[hi]] + 1) <= cells:
            hi += 1
        at, lo = near[lo:hi], hi
        rows, columns = m[at], n[at]
        width = int(columns.max())
        x = np.pad(_grid([xs[i] for i in at], width + most, 0xFFFFFFFF), ((0, 0), (most, most + 1)), constant_values=0xFFFFFFFF)
        y = _grid([ys[i] for i in at], width, 0xFFFFFFFE)
        x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
        distance = np.where(rows > 0, np.minimum(rows, most), columns)
        plus, minus = np.full(len(at), np.uint64((~0 << (63 - most)) & (2**64 - 1))), np.zeros(len(at), np.uint64)
        for j in range(width):
            same = np.zeros(len(at), np.uint64)
            for k in range(2 * most + 1):
                same |= (x[j + k] == y[j]).astype(np.uint64) << np.uint64(63 - 2 * most + k)
            level = (((same & plus) + plus) ^ plus) | same | minus
            up, down = minus | ~(level | plus), level & plus
            place = np.clip(63 - (j + most - (rows - 1)), 0, 63).astype(np.uint64)
            step = np.where(j < rows - most, (level >> top ^ one).astype(np.int64), (up >> place & one).astype(np.int64) - (down >> place & one).astype(np.int64))
            distance += np.where((j < columns) & (rows > 0), step, 0)
            plus, minus = down | ~(level >> one | up), (level >> one) & up
        out[at] = distance <= most
    return out


def plan(threshold: int) -> list[tuple[int, int, int]]:
    """What a line probes besides its own segments: (how much shorter the other line is, segment, shift of its place)."""
    out = []
    for less in range(threshold + 1):
        for i in range(threshold + 1):
            for shift in range(max(-i, less - (threshold - i)), min(i, less + (threshold - i)) + 1):
                if (less, shift) != (0, 0):
                    out.append((less, i, shift))
    return out


class Lines:
    """The lines of some texts as spans of one array of code points."""

    def __init__(self, texts: list[str]):
        self.codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.hi = np.flatnonzero(self.codes == 10)
        self.lo = np.concatenate([[0], self.hi[:-1] + 1]).astype(np.int64)
        counts = np.array([t.count("\n") + 1 for t in texts])
        self.text = np.repeat(np.arange(len(texts)), counts)
        self.number = np.arange(len(self.lo)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.roll = Rolling(self.codes)

    def hashes(self) -> np.ndarray:
        return mix(self.roll.raw(self.lo, self.hi) ^ mix((self.hi - self.lo).astype(np.uint64)))

    def blank(self) -> np.ndarray:
        """Whether a line has no character beyond U+0020."""
        shown = np.concatenate([[0], np.cumsum(self.codes > 32)])
        return shown[self.hi] == shown[self.lo]

    def segments(self, less: int, i: int, shift: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Each line's key for segment i of lines that are `less` shorter, read `shift` places off, and whether that lies inside the line."""
        size = self.hi - self.lo - less
        lo = self.lo + size * i // (threshold + 1) + shift
        hi = self.lo + size * (i + 1) // (threshold + 1) + shift
        fits = (lo >= self.lo) & (hi <= self.hi) & (size > threshold)
        raw = self.roll.raw(np.where(fits, lo, self.lo), np.where(fits, hi, self.lo))
        return mix(raw ^ mix(size.astype(np.uint64) * np.uint64(64) + np.uint64(i))), fits


def line_rows(df: DataFrame, threshold: int, min_chars: int) -> DataFrame:
    """id, line, f (the line's hash), e0.. (its segments), p0.. (its probes; null where there is none) of all lines that are not blank.
    Those of fewer than min_chars characters have neither segments nor probes."""
    probes = plan(threshold)
    names = ["f", *[f"e{i}" for i in range(threshold + 1)], *[f"p{i}" for i in range(len(probes))]]

    def run(batches):
        for b in chunks(batches, 1000):
            texts = b.column(1).to_pylist()
            for lo, hi in batches_of(texts):
                x = Lines(texts[lo:hi])
                keep = np.flatnonzero(~x.blank())
                short = (x.hi - x.lo)[keep] < min_chars
                cols = [pa.array(x.hashes()[keep].view(np.int64))]
                for k in [(0, i, 0) for i in range(threshold + 1)] + probes:
                    keys, fits = x.segments(*k, threshold)
                    cols.append(pa.array(keys[keep].view(np.int64), mask=short | ~fits[keep]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(x.text[keep] + lo)), pa.array(x.number[keep].astype(np.int32)), *cols], names=["id", "line", *names])

    return df.mapInArrow(tidily(run), "id long, line int, " + ", ".join(f"{n} long" for n in names))


def texts_of(docs: DataFrame) -> DataFrame:
    """(id, t) -> f, s: the lines and their hashes."""

    def run(batches):
        for b in chunks(batches, 1000):
            texts = b.column(1).to_pylist()
            for lo, hi in batches_of(texts):
                f = Lines(texts[lo:hi]).hashes().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(f), pa.array([s for t in texts[lo:hi] for s in t.split("\n")])], names=["f", "s"])

    return docs.mapInArrow(tidily(run), "f long, s string")


def without_one(members: DataFrame) -> DataFrame:
    """(f, s) -> f, v, place: for each place the hash of the line without its character there, as `Lines.hashes` has it."""

    def run(batches):
        for b in chunks(batches, 200):
            fs, vs, places = [], [], []
            for k, (f, s) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                a = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
                roll, n = Rolling(a), len(a)
                at = np.arange(n)
                joined = roll.raw(np.zeros(n, np.int64), at) + roll.raw(at + 1, np.full(n, n)) * roll.power[at]
                fs.append(np.full(n, f, np.int64))
                vs.append(mix(joined ^ mix(np.array([n - 1], np.uint64))).view(np.int64))
                places.append(at.astype(np.int32))
                if k + 1 == b.num_rows or sum(map(len, fs)) > 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (fs, vs, places)], names=["f", "v", "place"])
                    fs, vs, places = [], [], []

    return members.select("f", "s").mapInArrow(tidily(run), "f long, v long, place int")


def verified(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Of pairs (a, b) those within the threshold."""
    left, right = texts.select(F.col("f").alias("a"), F.col("s").alias("x")), texts.select(F.col("f").alias("b"), F.col("s").alias("y"))
    full = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def run(batches):
        for b in chunks(batches, 4000):
            hit = edits_within(b.column(2).to_pylist(), b.column(3).to_pylist(), threshold)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(hit))

    return full.mapInArrow(tidily(run), "a long, b long")


def dedup_lines(df: DataFrame, threshold: int = 1, min_chars: int = 20, wide: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with text_col without its repeated lines, and n_lines int, n_removed int, removed array<int> (line numbers from 0)."""
    key_col = F.col(f"`{id_col}`").cast("long")
    docs = df.select(key_col.alias("id"), text_of(text_col).alias("t")).where("id is not null")
    rows = cut(line_rows(docs, threshold, min_chars))
    names = [c for c in rows.columns if c not in ("id", "line", "f")]
    different = cut(rows.groupBy("f").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in names]))
    segments, probes = [c for c in names if c[0] == "e"], [c for c in names if c[0] == "p"]
    entered = different.select("f", F.lit(True).alias("own"), F.explode(F.array(*segments)).alias("key"))
    probing = different.select("f", F.lit(False).alias("own"), F.explode(F.array(*probes)).alias("key"))
    each = entered.unionByName(probing).where("key is not null")
    sizes = each.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max("own").alias("owned"), F.min("f").alias("x"), F.max("f").alias("y")).where("rows > 1 and owned and x <> y").select("key", "rows")
    shared = cut(each.join(sizes, "key"))
    involved = shared.select("f").distinct().join(different.select("f", "id"), "f")
    texts = docs.join(involved.select("id").distinct(), "id", "left_semi")
    texts = cut(texts_of(texts).join(involved.select("f"), "f", "left_semi").dropDuplicates(["f"]))
    narrow, broad = shared.where(F.col("rows") <= wide), shared.where(F.col("rows") > wide)
    side = lambda x, n: x.select(F.col("key"), F.col("f").alias(n))
    meet = lambda x: side(x, "a").join(side(x.where("own"), "b"), "key").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = meet(narrow)
    if threshold == 1:
        members = broad.select("f").distinct().join(texts, "f")
        again = cut(without_one(members))
        hubs = again.groupBy("v", "place").agg(F.min("f").alias("a"), F.max("f").alias("z")).where("a <> z").select("v", "place", "a")
        swapped = again.join(hubs, ["v", "place"]).where("a <> f").select("a", F.col("f").alias("b"))
        longer = again.join(members.select(F.col("f").alias("v")), "v").select(F.least("f", "v").alias("a"), F.greatest("f", "v").alias("b"))
        pairs = pairs.unionByName(swapped).unionByName(longer)
    else:
        pairs = pairs.unionByName(meet(broad))
    label = cut(components(verified(pairs.distinct(), texts, threshold)))
    named = different.select("f", "id", "n").join(label.withColumnRenamed("node", "f"), "f", "left").select("f", "id", "n", F.coalesce("label", "f").alias("label"))
    repeated = named.groupBy("label").agg(F.min("id").alias("owner"), F.sum("n").alias("n")).where("n > 1")
    member = named.select("f", "label").join(repeated.select("label", "owner"), "label")
    found = rows.select("id", "line", "f").join(member, "f")
    # In the owner's own text the first line of the class stays; in other texts none does.
    stays = found.where("id = owner").groupBy("id", "label").agg(F.min("line").alias("first"))
    gone = found.join(stays, ["id", "label"], "left").where("first is null or line > first")
    mine, gone_of = free_name(df, "id"), free_name(df, "gone")
    removed = gone.groupBy(F.col("id").alias(mine)).agg(F.array_sort(F.collect_set("line")).alias(gone_of))
    out = df.join(removed, key_col == F.col(mine), "left").drop(mine)
    lost, parts, none = F.col(gone_of), F.split(text_of(text_col), "\n", -1), F.array().cast("array<int>")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), lost)
    kept = F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")
    return out.withColumns({"n_lines": F.size(parts), "n_removed": F.coalesce(F.size(lost), F.lit(0)), "removed": F.coalesce(lost, none), text_col: F.when(lost.isNotNull(), kept).otherwise(F.col(f"`{text_col}`"))}).drop(gone_of)
