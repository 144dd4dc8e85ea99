"""Best-fit packing of tokenised documents into sequences of fixed length.

Tokens: every document's ids by the given tokenizer without special tokens, then the id 0; only documents
longer than a sequence are cut.  Packing is hierarchical: each partition packs its pieces best-fit and emits
the bins that are nearly full; underfull bins go up a tree, where the pieces of those of `fan_in` partitions
(then of groups) are items again and packed best-fit once more, until one group is left.  After a best-fit
round at most one bin of a group is half empty or more, and bins with much room mean that no small pieces are
left to fill them; so of each group the emptiest bins go up, as long as they hold `carry` pieces at most: what
one task of the tree reads is bounded by fan_in * carry pieces at any size of input.

Defined cases: null and empty texts are one piece of one token (the 0); equal rows are packed each on its own;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import array
import os
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, chunks, cut, text_of, tidily

#: Byte-level BPE shows bytes as characters: printable ones as they are, the rest as characters from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(_SHOWN))}
#: Words of which lower case, composition and character class are the same for every library.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")

MOST_WORDS = 220_000


class WordIds(dict):
    """Blank-separated piece of text -> its ids as little-endian bytes.  No token of the vocabulary spans a blank, so whole texts are looked up piece by piece; the most frequent pieces come first and stay, and beyond `most` entries nothing more is kept (it is computed each time)."""

    def __init__(self, path: str, most: int = MOST_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.words = Tokenizer.from_file(path), most, {}
        self.shape = _word_vocabulary(self.tokenizer)
        self[""] = b""

    def __missing__(self, piece: str) -> bytes:
        if self.shape and _PLAIN.fullmatch(piece) and "<|" not in piece:
            ids = b"".join([self._word(w) for w in _PARTS.findall(piece.lower())])
        else:
            ids = array.array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        if len(self) < self.most:
            self[piece] = ids
        return ids

    def _word(self, word: str) -> bytes:
        if (ids := self.words.get(word)) is None:
            shown = word.encode().decode("latin-1").translate(_BYTES)
            ids = array.array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()
            if len(self.words) < self.most:
                self.words[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


def _word_vocabulary(tokenizer) -> bool:
    """Whether the shortcut for plain words fits this tokenizer: tested on words that take every branch of it."""
    for w in ("It's", "we'll", "Ärger,", "x2y", "--a--", "naïve-ÿß", "'''s"):
        shown = [x.encode().decode("latin-1").translate(_BYTES) for x in _PARTS.findall(w.lower())]
        if [t.id for x in shown for t in tokenizer.model.tokenize(x)] != tokenizer.encode(w, add_special_tokens=False).ids:
            return False
    return True


_known: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, most: int = MOST_WORDS) -> WordIds:
    """One for each worker process, kept between its tasks.  A path that this machine lacks is looked up among the files shipped with the job (SparkContext.addFile)."""
    if (path, most) not in _known:
        _known[path, most] = WordIds(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), most)
    return _known[path, most]


PIECES = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]


def tokenize(df: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", ids: bool = False, keep: bool = True, most: int = MOST_WORDS) -> DataFrame:
    """Pieces of at most `capacity` tokens: id_col, piece, start, length, ids_crc32, and with ids=True their ids.
    keep=False: workers forget the tokenizer and its words with each task, which leaves their memory to what runs beside and after it.
    most: of how many words and blank-separated pieces a worker keeps the tokens; others are computed each time."""
    kind = df.schema[id_col].dataType.simpleString()
    step = 4 * capacity

    def run(batches):
        known = word_ids(tokenizer, most)
        for b in chunks(batches):
            index, rows, parts = [], [], []
            for i, s in enumerate(b.column(1)):
                got = known.text(s.as_py()) + b"\0\0\0\0"
                for at in range(0, len(got), step):
                    part = got[at : at + step]
                    index.append(i)
                    rows.append((at // step, at // 4, len(part) // 4, zlib.crc32(part)))
                    if ids:
                        parts.append(np.frombuffer(part, np.uint32).astype(np.int32))
            out = batch(PIECES, list(zip(*rows, strict=True)))
            columns = [b.column(0).take(pa.array(index)), *out.columns] + ([pa.array(parts, pa.list_(pa.int32()))] if ids else [])
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, *out.schema.names] + ["ids"] * ids)
        if not keep:
            _known.pop((tokenizer, most), None)

    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return df.select(F.col(f"`{id_col}`"), text_of(text_col).alias("t")).mapInArrow(tidily(run), schema)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit by falling size: the bin and the offset of each item, and the fill of each bin.  Bins are found by their room in a bit set."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets, fill = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        if fit := rooms >> size:
            room = size + (fit & -fit).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            k, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = k, fill[k]
        fill[k] += size
        if left := room - size:
            by_room[left].append(k)
            rooms |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


def pack(pieces: DataFrame, capacity: int = 2048, size_col: str = "length", slack: int = 0, block: int = 200_000, fan_in: int = 16, carry: int = 20_000) -> DataFrame:
    """pieces with sequence_id long, offset long (gapless from 0 in each sequence).  Sizes must lie in 1..capacity.  Bins with at most `slack` room are full."""
    names = pieces.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    schema = f"{kinds}, sequence_id long, offset long, _group long, _open boolean"

    def packed(x: pd.DataFrame, first_id: int, group: int) -> tuple[pd.DataFrame, int]:
        bins, offsets, fill = best_fit(x[size_col].to_numpy(), capacity)
        emptiest = np.argsort(fill, kind="stable")
        up = np.zeros(len(fill), bool)
        up[emptiest[np.cumsum(np.bincount(bins, minlength=len(fill))[emptiest]) <= carry]] = True
        return x.assign(sequence_id=first_id + bins, offset=offsets, _group=group, _open=(up & (fill < capacity - slack))[bins]), len(fill)

    def first(frames):
        base, task, held, n = 0, TaskContext.get().partitionId(), [], 0

        def flush():
            nonlocal base
            x, made = packed(pd.concat(held, ignore_index=True), (task << 36) + base, task)
            base += made
            return x

        for x in frames:
            held.append(x)
            if (n := n + len(x)) >= block:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    def again(level: int):
        def merge(key, x: pd.DataFrame) -> pd.DataFrame:
            return packed(x.drop(columns="_up"), (level << 56) + (int(key[0]) << 28), int(key[0]))[0]

        return merge

    done, rest, level = [], cut(pieces.mapInPandas(tidily(first), schema)), 0
    groups = (rest.agg(F.max("_group")).first()[0] or 0) + 1
    while groups > 1:
        done.append(rest.where("not _open"))
        groups, level = -(-groups // fan_in), level + 1
        up = rest.where("_open").withColumn("_up", F.floor(F.col("_group") / fan_in))
        rest = cut(up.groupBy("_up").applyInPandas(again(level), schema))
    for x in done:
        rest = rest.unionByName(x)
    return rest.select(*[F.col(f"`{n}`") for n in names], "sequence_id", "offset")
