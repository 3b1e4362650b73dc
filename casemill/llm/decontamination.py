"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import sliced

SHINGLE = 5
CONTAINMENT = 0.8
#: Hash functions of a signature; each is a band of its own (the windows are few times an item's size).
HASHES = 64
#: Items, and bytes of their texts, in one pass over the documents; a larger benchmark takes several passes.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 64_000_000
#: Shingles in a smallest window's half; size classes are this times powers of two.
LEAST_CLASS = 8
#: Distinct words whose hashes a task remembers.
CACHE_WORDS = 1_000_000

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_DRAWS = np.random.Generator(np.random.PCG64(8))
_A = _DRAWS.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _DRAWS.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_FILTER_BITS = 22


class WordHashes(dict):
    """XXH64 of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def word_hashes(text: str | None, known: WordHashes) -> np.ndarray:
    """Hashes of a text's words: runs of ASCII letters and digits, lower-cased, and of characters above ASCII."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def joined(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k words in turn; none for k of 0."""
    h = np.zeros(max(0, len(w) - k + 1) if k else 0, np.uint64)
    for i in range(k if len(h) else 0):
        h = (h ^ w[i : len(w) - k + 1 + i]) * _STEP
        h ^= h >> np.uint64(29)
    return h


def shingles(text: str | None, known: WordHashes) -> np.ndarray:
    """Hashes of every SHINGLE words in turn (fewer words: of them all; none: empty)."""
    w = word_hashes(text, known)
    return joined(w, min(SHINGLE, len(w)))


def size_class(n: int) -> int:
    """The class of an item of n shingles: class c holds sizes up to LEAST_CLASS << c."""
    return max(0, ceil(np.log2(n / LEAST_CLASS))) if n > LEAST_CLASS else 0


def _table(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, their owners, and which leading bits there are."""
    order = np.argsort(keys, kind="stable")
    mask = np.zeros(1 << _FILTER_BITS, bool)
    mask[keys >> np.uint64(64 - _FILTER_BITS)] = True
    return keys[order], owner[order], mask


def _owners(table: tuple[np.ndarray, np.ndarray, np.ndarray], values: np.ndarray) -> list[np.ndarray]:
    keys, owner, mask = table
    values = np.unique(values[mask[values >> np.uint64(64 - _FILTER_BITS)]])
    low, high = np.searchsorted(keys, values, "left"), np.searchsorted(keys, values, "right")
    return [owner[a:b] for a, b in zip(low, high, strict=True) if b > a]


class Index:
    """MinHash signatures of a block of items by size class, and the items' exact shingles.

    Items of few shingles (the least class) are looked up by the shingles themselves. short: items of fewer than
    SHINGLE words are looked up among a document's runs of as many words, else only in documents of just their words.
    """

    def __init__(self, items: list[tuple[int, str | None]], short: bool = True) -> None:
        known = WordHashes()
        self.ids, self.sets, self.sizes, self.classes, self.short = [], [], [], {}, {}
        by_class: dict[int, list[int]] = {}
        by_words: dict[int, list[int]] = {}
        for item_id, text in items:
            w = word_hashes(text, known)
            k = min(SHINGLE, len(w))
            own = np.unique(joined(w, k))
            if not len(own):
                continue
            if k < SHINGLE and short:
                by_words.setdefault(k, []).append(len(self.ids))
            else:
                by_class.setdefault(size_class(len(own)), []).append(len(self.ids))
            self.ids.append(item_id)
            self.sets.append(own)
        for k, members in by_words.items():
            self.short[k] = _table(np.concatenate([self.sets[i] for i in members]), np.array(members))
        for c, members in by_class.items():
            if c == 0:
                self.classes[c] = _table(np.concatenate([self.sets[i] for i in members]), np.repeat(np.array(members), [len(self.sets[i]) for i in members]))
                continue
            mins = np.concatenate([(self.sets[i][None, :] * _A[:, None] + _B[:, None]).min(1) for i in members])
            self.classes[c] = _table(mins ^ np.tile(_B, len(members)), np.repeat(np.array(members), HASHES))

    def candidates(self, h: np.ndarray) -> np.ndarray:
        """Items that share a minimum with a window of a document's shingles h.

        A class of items of up to u shingles is compared with windows of 2u shingles, u apart, so that each place
        of an item is whole in one. A window's minima are those of two neighbouring blocks, and a larger class's
        blocks are pairs of a smaller one's.
        """
        found, top = _owners(self.classes[0], h) if 0 in self.classes else [], max(self.classes, default=0)
        if not top:
            return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        step = LEAST_CLASS << top
        per_call = max(1, (1 << 14) // step) * step
        for at in range(0, len(h), per_call):
            part = h[at : at + per_call + 2 * step]  # the last window reaches over the seam
            mins = np.minimum.reduceat(part[None, :] * _A[:, None] + _B[:, None], np.arange(0, len(part), LEAST_CLASS), axis=1)
            for c in range(top + 1):
                if c:
                    mins = np.minimum.reduceat(mins, np.arange(0, mins.shape[1], 2), axis=1)
                if not c or c not in self.classes:
                    continue
                windows = np.minimum(mins[:, :-1], mins[:, 1:]) if mins.shape[1] > 1 else mins
                found += _owners(self.classes[c], (windows ^ _B[:, None]).ravel())
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)

    def matches(self, text: str | None, known: WordHashes, least: float) -> list[tuple[int, int, int]]:
        """(item id, shared shingles, item's shingles) of the items contained in a text by at least the given share."""
        w = word_hashes(text, known)
        h, out = joined(w, min(SHINGLE, len(w))), []
        for k, table in self.short.items():
            out += [(self.ids[i], 1, 1) for x in _owners(table, joined(w, k)) for i in x.tolist()]
        near = self.candidates(h) if len(h) else []
        if not len(near):
            return out
        own = np.unique(h)
        for i in near:
            at = np.searchsorted(own, self.sets[i])
            shared = int((own[np.minimum(at, len(own) - 1)] == self.sets[i]).sum())
            if shared >= least * len(self.sets[i]):
                out.append((self.ids[i], shared, len(self.sets[i])))
        return out


def contained(docs: DataFrame, items: DataFrame, least: float = CONTAINMENT, short: bool = False) -> DataFrame:
    """Pairs doc_id, item_id, n_shared, n_item, containment with at least the given share of the item's shingles.

    Items (item_id, text) are taken in blocks of a bounded size, each of which goes to every task of one pass over
    docs; nothing is shuffled and no document leaves its task. Texts of fewer than five words have one shingle, all
    their words; with short such an item is found wherever its words stand in a row, else only in a document of no
    other words. Null, empty and wordless texts match nothing. Repeated rows on either side give a pair each; a
    null id stays in its pairs; other columns are dropped; an empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, n_shared int, n_item int"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    held = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n_blocks = max(ceil(held["n"] / BLOCK_ITEMS), ceil(held["bytes"] / BLOCK_BYTES))
    found = spark.createDataFrame([], schema)
    for block in range(n_blocks):
        own = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block
        index = Index([(x["item_id"], x["text"]) for x in wanted.where(own).collect()], short)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            known = WordHashes()
            for batch in sliced(batches):
                rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in index.matches(t, known, least)]
                columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "n_shared", "n_item"])

        found = found.union(texts.mapInArrow(run, schema))
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def drop_contaminated(docs: DataFrame, items: DataFrame, least: float = CONTAINMENT, short: bool = False) -> DataFrame:
    """The rows of docs that contain no item, columns unchanged; each row is judged by its own text, whatever its doc_id."""
    text = F.col("text").cast("string")
    # Equal texts hold the same items: a text's hash stands for the row.
    bad = contained(docs.select(F.xxhash64(text).alias("doc_id"), "text"), items, least, short).select(F.col("doc_id").alias("_bad")).distinct()
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64(text).alias("_bad"))
    return marked.join(bad, "_bad", "left_anti").select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
