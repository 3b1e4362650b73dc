"""Best-fit packing of documents into sequences, improved by swaps between underfull bins."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from math import ceil
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import cut, sliced

CAPACITY = 4096
END_ID = 1
#: Pieces that are packed together; parts of this size are packed side by side.
PART_ROWS = 20000
#: Bins with more free places than this are opened again and packed with those of other parts.
SLACK = 16
#: Distinct chunks whose ids a task remembers, and the longest that it remembers.
CACHE_CHUNKS, CACHE_CHARS = 800_000, 64

#: A comma or dot that ends a chunk after a letter.
_POINT = re.compile(rb"([a-z])([,.])\s")


#: Texts that a tokenizer must encode as their chunks.
_PROBES = ["The Quick, brown. Fox's  caf\u00e9\n\n\ttab-end.", "A.B,c d ..1,2 3.5 word, Word. (x) #y @z", "  leading and trailing \n", "STRASSE stra\u00dfe \u4e2d\u6587, \u043c\u0438\u0440. e\u0301t\u00e9", "a\u00a0b \u2028 c\x0bd\x0ce"]


class ChunkIds(dict):
    """Little-endian ids of blank-separated chunks, each encoded once while it is remembered."""

    def __init__(self, tokenizer: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.model = Tokenizer.from_file(tokenizer)
        # Byte-level vocabularies write a byte as a character: printable ones as themselves, others from 256 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in own]
        self.written = dict(zip(own, map(chr, own), strict=True)) | {b: chr(256 + i) for i, b in enumerate(others)}
        self.tokenize = self.model.model.tokenize
        self.letters = all(self._word(x) == self._any(x) for x in ("the", "wordlike", "\u00e9t\u00e9", "stra\u00dfe", "\u4e2d\u6587", "\u043c\u0438\u0440"))
        #: Whether the tokenizer is one whose ids of a text are those of its chunks; if not, texts are encoded whole.
        self.chunked = True
        self.chunked = all(self.ids(x) == self._any(x) for x in _PROBES)

    def _any(self, text: str) -> bytes:
        ids = self.model.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        """Ids of a lower-case word of letters in composed form, from the vocabulary's merges alone."""
        mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.written)
        ids = [x.id for x in self.tokenize(mapped)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, chunk: bytes) -> bytes:
        word = chunk.decode("utf-8", "replace")
        plain = self.letters and word.isalpha() and word == word.lower() and is_normalized("NFC", word)
        found = self._word(word) if plain else self._any(word)
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_CHUNKS:
                self.clear()
            self[chunk] = found
        return found

    def ids(self, text: str) -> bytes:
        """Ids of a whole text.

        Where blanks never join tokens, capitals of ASCII are lower-cased by the tokenizer too, and a comma or dot after
        a letter is a token of its own, the ids are those of the chunks in turn.
        """
        if not self.chunked:
            return self._any(text.encode("utf-8", "replace").decode())
        chunks = _POINT.sub(rb"\1 \2 ", text.encode("utf-8", "replace").lower()).split()
        return b"".join(map(self.__getitem__, chunks))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row of docs; null texts count as empty.

    Tokenizers of lower-case words without blanks encode chunk by chunk, others whole texts; which it is, is tried out
    on a few texts. The file is read where the tasks run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = ChunkIds(tokenizer), np.array([END_ID], "<u4").tobytes()
        for batch in sliced(batches):
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = coder.ids(text or "") + end
                n = len(ids) // 4
                for i, start in enumerate(range(0, n, capacity)):
                    stop = min(n, start + capacity)
                    for k, v in zip(out, (doc_id, i, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=list(out))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indexes: longest first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    by_free: dict[int, list[int]] = defaultdict(list)
    some = 0  # bit f is set if a bin has f places left
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = some >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            at = by_free[free].pop()
            if not by_free[free]:
                some &= ~(1 << free)
            bins[at].append(i)
        else:
            free, at = capacity, len(bins)
            bins.append([i])
        if free > size:
            by_free[free - size].append(at)
            some |= 1 << (free - size)
    return bins


def _improve(near: list[list[int]], size: list[int], capacity: int) -> bool:
    """Make one move among bins that increases the squared fill; False if there is none.

    From the emptiest bin on, each document in turn is moved to the bin it fills best, or exchanged for one
    smaller document, or for two that are smaller together, of a bin that then is fuller.
    """
    fill = np.array([sum(size[i] for i in b) for b in near])
    free = capacity - fill
    ones = [(size[i], b, (i,)) for b, members in enumerate(near) for i in {size[i]: i for i in members}.values()]
    pairs = []
    for b, members in enumerate(near):
        kinds: dict[int, list[int]] = defaultdict(list)
        for i in members:
            kinds[size[i]].append(i)
        for x, own in kinds.items():
            pairs += [(x + y, b, (own[0], other[x == y])) for y, other in kinds.items() if y > x or (y == x and len(own) > 1)]
    offers = [((), np.zeros(len(near), np.int64), np.arange(len(near)))]
    for kind in (ones, pairs):
        offers.append(([x[2] for x in kind], np.array([x[0] for x in kind], np.int64), np.array([x[1] for x in kind], np.int64)))
    for a in np.argsort(fill, kind="stable").tolist():
        for i in sorted(near[a], key=lambda x: -size[x]):
            best = None
            for back, given, b in offers:
                if not len(b):
                    continue
                gain = size[i] - given  # what b gains and a loses
                grows = (gain > 0) & (gain <= free[b]) & (fill[b] - fill[a] + gain > 0) & (b != a)
                if grows.any():
                    k = int(np.argmax(np.where(grows, 2 * gain * (fill[b] - fill[a] + gain), -1)))
                    step = int(2 * gain[k] * (fill[b[k]] - fill[a] + gain[k]))
                    if best is None or step > best[0]:
                        best = (step, int(b[k]), back[k] if len(back) else ())
            if best:
                _, b, returned = best
                near[a] = [x for x in near[a] if x != i] + list(returned)
                near[b] = [x for x in near[b] if x not in returned] + [i]
                return True
    return False


class _Search:
    """The same moves as _improve(), one after the other: after a move only what its two bins bear on is worked out again.

    Of a bin's offers (nothing, one document, or two) the smallest that leaves it within the capacity is best, as a larger
    gain is always the larger step; so a document's best move to a bin is one search among the bin's sorted offers.
    """

    def __init__(self, bins: list[list[int]], size: np.ndarray, capacity: int) -> None:
        self.bins, self.size, self.capacity = bins, size, capacity
        self.docs = np.array(sorted(i for b in bins for i in b), np.int64)
        self.at = np.full(len(size), -1)
        for b, members in enumerate(bins):
            self.at[members] = b
        self.fill = np.array([int(size[b].sum()) for b in bins], np.int64)
        offers = [self._offers(b) for b in range(len(bins))]
        self.keys = np.concatenate([x + b * self._wide for b, x in enumerate(offers)])
        #: Documents that may have a move: all at first, later those for which a changed bin has one.
        self.able = np.zeros(len(size), bool)
        self.able[self.docs] = True

    @property
    def _wide(self) -> int:
        return 4 * self.capacity

    def _offers(self, b: int) -> np.ndarray:
        """The sums that bin b can give, in order."""
        own, counts = np.unique(self.size[self.bins[b]], return_counts=True)
        one, two = np.triu_indices(len(own), 1)
        return np.unique(np.concatenate([[0], own, own[one] + own[two], 2 * own[counts > 1]])).astype(np.int64)

    def _seek(self, i: int) -> int | None:
        """The bin that document i's best move is to, if it has one."""
        x, a = int(self.size[i]), int(self.at[i])
        bins, free = np.arange(len(self.bins)) * self._wide, self.capacity - self.fill
        place = np.minimum(np.searchsorted(self.keys, bins + np.maximum(0, x - free)), len(self.keys) - 1)
        gain = x - (self.keys[place] - bins)
        step = np.where((gain > 0) & (gain <= free), gain * (self.fill - self.fill[a] + gain), 0)
        step[a] = 0
        best = int(step.argmax())
        return best if step[best] > 0 else None

    def _meet(self, b: int) -> None:
        """Mark the documents of other bins that have a move to bin b, which has changed."""
        offers, free, docs = self._segment(b), self.capacity - self.fill[b], self.docs
        x = self.size[docs]
        place = np.searchsorted(offers, np.maximum(0, x - free))
        gain = x - offers[np.minimum(place, len(offers) - 1)]
        fits = (place < len(offers)) & (gain > 0) & (gain <= free) & (self.fill[b] - self.fill[self.at[docs]] + gain > 0)
        self.able[docs[fits & (self.at[docs] != b)]] = True

    def _segment(self, b: int) -> np.ndarray:
        lo, hi = np.searchsorted(self.keys, [b * self._wide, (b + 1) * self._wide])
        return self.keys[lo:hi] - b * self._wide

    def move(self) -> bool:
        """Make one move, of the largest document that has one in the emptiest bin that has any; False if none is left."""
        able = self.docs[self.able[self.docs]]
        order = able[np.lexsort((-self.size[able], self.at[able], self.fill[self.at[able]]))].tolist()
        for i in order:
            b = self._seek(i)
            if b is not None:
                break
            self.able[i] = False
        else:
            return False
        a, x = int(self.at[i]), int(self.size[i])
        offers = self._segment(b)
        given = int(offers[np.searchsorted(offers, max(0, x - (self.capacity - int(self.fill[b]))))])
        back = self._giving(b, given)
        self.bins[a] = [k for k in self.bins[a] if k != i] + back
        self.bins[b] = [k for k in self.bins[b] if k not in back] + [i]
        self.at[i], self.at[back] = b, a
        self.fill[a] += given - x
        self.fill[b] += x - given
        for c in (a, b):
            lo, hi = np.searchsorted(self.keys, [c * self._wide, (c + 1) * self._wide])
            self.keys = np.concatenate([self.keys[:lo], self._offers(c) + c * self._wide, self.keys[hi:]])
        self.able[self.bins[a] + self.bins[b]] = True
        for c in (a, b):
            self._meet(c)
        return True

    def _giving(self, b: int, given: int) -> list[int]:
        if not given:
            return []
        by_size: dict[int, list[int]] = defaultdict(list)
        for k in self.bins[b]:
            by_size[int(self.size[k])].append(k)
        if given in by_size:
            return [by_size[given][0]]
        y = next(y for y in by_size if given - y in by_size and (given != 2 * y or len(by_size[y]) > 1))
        return [by_size[y][0], by_size[given - y][1 if given == 2 * y else 0]]


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indexes of lengths, none over capacity: best fit, then swaps of a local search.

    The search ends when the bins are as few as the lengths' sum allows, or when no move between two bins is left that
    increases the squared fill. Full bins have none.
    """
    size, bins = np.asarray(lengths, np.int64), best_fit(lengths, capacity)
    least = ceil(int(size.sum()) / capacity)
    if len(bins) <= least:
        return bins
    open_ = [b for b in bins if size[b].sum() < capacity]
    full = [b for b in bins if size[b].sum() == capacity]
    search = _Search(open_, size, capacity)
    left = len(bins)
    while left > least and search.move():
        left = len(full) + sum(map(bool, search.bins))
    return full + [b for b in search.bins if b]


def _packed(rows: DataFrame, n_parts: int, level: int, capacity: int) -> DataFrame:
    """rows with bin and offset; bins are numbered apart over parts and levels."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        lengths = pdf["length"].to_numpy()
        number, offset, free = (np.zeros(len(pdf), np.int64) for _ in range(3))
        for b, members in enumerate(pack(lengths, capacity)):
            own = np.array(members)
            ends = np.cumsum(lengths[own])
            number[own], offset[own], free[own] = b, ends - lengths[own], capacity - ends[-1]
        base = (level << 56) + (int(pdf["part"].iloc[0]) << 24)
        return pdf.drop(columns="part").assign(sequence_id=base + number, offset=offset, free=free)

    part = F.pmod(F.xxhash64("doc_id", "piece", F.lit(level)), F.lit(n_parts)).cast("int")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, free long"
    return rows.withColumn("part", part).groupBy("part").applyInPandas(one, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces are dealt evenly over parts by a hash and packed there; bins with more than SLACK places left are opened
    again, and their pieces, dealt anew, are packed in fewer parts. That ends with the level that has one part, or that
    has closed less than a tenth of its pieces: no part ever holds more than about PART_ROWS. An empty document is one
    piece of its end mark; repeated rows are packed each; a null doc_id is kept; other columns of docs are dropped.
    An empty table gives an empty result.
    """
    rows = cut(pieces(docs, tokenizer, capacity), "pieces")
    done, level, left = None, 0, None
    while True:
        n = rows.count()
        n_parts = max(1, ceil(n / PART_ROWS))
        table = cut(_packed(rows, n_parts, level, capacity), "packed")
        # Lengths that don't combine, as many copies of one over half the capacity, are left by any number of levels.
        last = n_parts == 1 or (left is not None and 10 * n > 9 * left)
        full = table if last else table.where(F.col("free") <= SLACK)
        done = full if done is None else done.unionByName(full)
        if last:
            return done.drop("free")
        rows = table.where(F.col("free") > SLACK).select("doc_id", "piece", "start", "length", "ids_crc32")
        level, left = level + 1, n
