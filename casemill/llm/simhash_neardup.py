"""SimHash near-duplicates: a binary trie of fingerprints joined with itself under a Hamming budget."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import components, cut, forget, map_batches

SHINGLE = 4
BUDGET = 4
SEED = 42
#: Fingerprints in one trie; larger ones are split into chunks that are joined pairwise.
TRIE_ROWS = 2048
#: Fingerprints that one call of the traversal holds, of as many tries as fit.
TASK_ROWS = 16384

#: Words of a shingle, and least Jaccard similarity in fifths, of near copies that keep_one() finds beside the budget.
COPY_SHINGLE = 5
FIFTHS = 4
#: Bands of MinHash values and values in a band: a similarity of 0.8 is missed with (1 - 0.8 ** 4) ** 24, 3 in a million.
BANDS = 24
BAND_ROWS = 4

#: Classes of shingles, by 64 in a long, whose parities rule out pairs of texts before these are looked at.
PARITIES = 1024
_PARITY = [f"odd{i}" for i in range(PARITIES // 64)]

_FACTORS = np.random.Generator(np.random.PCG64(SEED)).integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 values of a text's word shingles; 0 for a text without words or null."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = len(words)
    joined = b" ".join(words)
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lengths) + np.arange(n)
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip((ends - lengths)[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    values = np.array(hashes, np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(values), 65536):
        part = values[at : at + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint's 64 bits as a signed long, for every row."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), each, "doc_id long, fp long")


def trie_pairs(fp: np.ndarray, frontier: tuple[np.ndarray, ...], budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of fingerprints that differ in at most budget bits.

    fp: unsigned fingerprints, sorted and distinct within each trie. frontier: first and end index of the two
    nodes of each pair to begin with; a pair of equal nodes stands for a trie against itself. All node pairs of
    a level are advanced together: each node is split at the level's bit, crossing children cost one bit, pairs
    over the budget and empty nodes are dropped, and pairs of single leaves are compared at once.
    """
    al, ah, bl, bh = frontier
    err = np.zeros(len(al), np.int8)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for bit in range(63, -1, -1):
        if not len(al):
            break
        ones = np.concatenate([[0], np.cumsum((fp >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)]).astype(np.int32)
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        own = (al == bl) & (ah == bh)
        children = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1)]
        other = ~own
        children.append((am[other], ah[other], bl[other], bm[other], err[other] + 1))
        kept = []
        for a0, a1, b0, b1, e in children:
            ok = (a1 > a0) & (b1 > b0) & (e <= budget) & ~((a0 == b0) & (a1 - a0 == 1))
            single = ok & (a1 - a0 == 1) & (b1 - b0 == 1)
            if single.any():
                a, b = a0[single], b0[single]
                near = np.bitwise_count(fp[a] ^ fp[b]) <= budget
                found.append((a[near], b[near]))
            ok &= ~single
            kept.append([x[ok] for x in (a0, a1, b0, b1, e)])
        al, ah, bl, bh, err = (np.concatenate(x) for x in zip(*kept, strict=True))
    if not found:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n indices over pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _tries(rows: dict[str, np.ndarray], budget: int) -> pa.RecordBatch | None:
    """A spanning forest of the links within the given whole tries, as pairs of ids."""
    order = np.lexsort((rows["fp"].view(np.uint64), rows["side"], rows["tile"], rows["key"]))
    rows = {k: v[order] for k, v in rows.items()}
    n = len(order)
    side, new = rows["side"], np.ones(n, bool)
    new[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["tile"][1:] != rows["tile"][:-1])
    first = np.flatnonzero(new)
    end = np.append(first[1:], n)
    zeros = np.add.reduceat((side == 0).astype(np.int64), first)
    two = (rows["tile"][first] >> 32) != (rows["tile"][first] & 0xFFFFFFFF)
    mid = first + zeros
    frontier = (first, np.where(two, mid, end), np.where(two, mid, first), end)
    some = (frontier[1] > frontier[0]) & (frontier[3] > frontier[2]) & (end - first > 1)
    a, b = trie_pairs(rows["fp"].view(np.uint64), tuple(x[some].astype(np.int32) for x in frontier), budget)
    label = forest(n, a, b)
    at = np.flatnonzero(label != np.arange(n))
    if not len(at):
        return None
    return pa.RecordBatch.from_arrays([pa.array(rows["id"][at]), pa.array(rows["id"][label[at]])], names=["a", "b"])


def blocks_needed(n: int, budget: int) -> int:
    """How many equal blocks a linked pair is sought by: the fewest that leave TRIE_ROWS of n random fingerprints to a value, 4 at most."""
    more = 1
    while more < 4 and n > TRIE_ROWS << (64 * more // (budget + more)):
        more += 1
    return more


def _leading(budget: int, more: int) -> list[Column]:
    """A key for each choice of so many of budget + more blocks of bits: the choice's number and the chosen bits."""
    count = budget + more
    edges = [round(64 * i / count) for i in range(count + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    keys = []
    for i, chosen in enumerate(combinations(masks, more)):
        mask = sum(chosen)
        bits = F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
        # One block of up to 32 bits is its own key; wider choices are hashed, and a clash only adds comparisons.
        keys.append(F.shiftrightunsigned(bits, edges[i]) + F.lit(i << 58) if more == 1 else F.xxhash64(F.lit(i), bits))
    return keys


def links(points: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within budget bits; points: distinct fp with an id each.

    The trie's top is shared out by Spark: of budget + more blocks of bits at least more are equal in a linked pair, so
    each choice of more blocks in turn leads the bits, and every value of them is one trie in one task. more is 1, and
    as much larger as the number of fingerprints asks for, so that values stay rare enough at any size. A value with
    more than TRIE_ROWS fingerprints all the same is split into chunks; every pair of chunks is joined, each in its own
    group. A task returns a spanning forest, never all pairs. budget: 15 at most.
    """
    if budget == 0:  # points are distinct
        return points.where(F.lit(False)).select(F.col("id").alias("a"), F.col("id").alias("b"))
    keyed = points.select("id", "fp", F.explode(F.array(*_leading(budget, blocks_needed(points.count(), budget)))).alias("key"))
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > TRIE_ROWS)
    chunks = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / F.lit(TRIE_ROWS)).cast("int")
    own = F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), chunks).cast("int"))
    tiles = keyed.join(large, "key", "left").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    low, high = F.least("own", "other").cast("long"), F.greatest("own", "other").cast("long")
    tiles = tiles.select("key", (F.shiftleft(low, 32) + high).alias("tile"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).cast("long").alias("side"), "fp", "id")
    names = ["key", "tile", "side", "fp", "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: np.empty(0, np.int64) for k in names}
        for batch in batches:
            held = {k: np.concatenate([held[k], batch.column(i).to_numpy(zero_copy_only=False)]) for i, k in enumerate(names)}
            if len(held["key"]) < TASK_ROWS:
                continue
            last = (held["key"] == held["key"][-1]) & (held["tile"] == held["tile"][-1])
            out = _tries({k: v[~last] for k, v in held.items()}, budget) if not last.all() else None
            held = {k: v[last] for k, v in held.items()}
            if out is not None:
                yield out
        if len(held["key"]) and (out := _tries(held, budget)) is not None:
            yield out

    return tiles.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """doc_id, fp, component_id of every row of docs (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id reachable over links of at most budget differing bits. Null and wordless
    texts have fingerprint 0 and are linked like any other; a repeated doc_id gives a row each time; a null doc_id
    keeps its row, with component_id of its fingerprint's component (null if no member has an id). An empty table
    gives an empty result.
    """
    marked = cut(fingerprints(docs, shingle), "fingerprints")
    label = _roots(marked, budget)
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("id")).join(label, "fp").groupBy("root").agg(F.min("id").alias("component_id"))
    return marked.join(label.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _roots(marked: DataFrame, budget: int) -> DataFrame:
    """fp and the smallest fingerprint of its component, for every fingerprint of marked, with an id or without."""
    points = cut(marked.select("fp").distinct(), "points")
    rooted = components(cut(links(points.select("fp", F.col("fp").alias("id")), budget), "links"), "neardup")
    return cut(points.join(rooted, points["fp"] == rooted["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")), "roots")


def shingles(text: str | None, shingle: int = COPY_SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of a text's word shingles, sorted; one shorter shingle of a text of fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64)
    size = min(shingle, len(words))
    if not size:
        return hashes
    rolled = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        rolled = (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - size + 1 + i]
    rolled = (rolled ^ (rolled >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(rolled ^ (rolled >> np.uint64(32)))


def bands(text: str | None) -> np.ndarray:
    """A hash of each band of a text's MinHash values; none of a text without words."""
    found = shingles(text)
    if not len(found):
        return np.empty(0, np.int64)
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        np.minimum(least, (found[at : at + 4096, None] * _FACTORS).min(0), out=least)
    rows = np.ascontiguousarray(least.reshape(BANDS, BAND_ROWS))
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(rows)], np.uint64).view(np.int64)


def parities(text: str | None) -> tuple[int, np.ndarray]:
    """How many distinct shingles a text has, and whether they are odd in number, by classes, one bit each."""
    found = shingles(text)
    odd = np.bincount((found % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return len(found), np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _may_be_alike() -> Column:
    """Whether numbers and parities of shingles allow two texts (other's columns end in _b) to be alike.

    A shingle that one text has and the other lacks changes one bit, and alike texts have a ninth of their shingles of these at most.
    """
    apart = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(f"{x}_b"))) for x in _PARITY), F.lit(0))
    sized = 5 * F.least("n", "n_b") >= FIFTHS * F.greatest("n", "n_b")
    return sized & ((5 + FIFTHS) * apart <= (5 - FIFTHS) * (F.col("n") + F.col("n_b")))


def alike(a: str | None, b: str | None) -> bool:
    """Whether two texts' shingles have a Jaccard similarity of FIFTHS / 5 or more."""
    x, y = shingles(a), shingles(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 5 * both >= FIFTHS * (len(x) + len(y) - both)


def copies(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the roots of texts that are alike though of different roots; rows: at, text; known: at, root.

    Of the texts that share a band each is first compared with one, the band's centre, so a large group of near copies
    costs a comparison a text and band. Only texts whose component isn't the centre's are then compared with the
    band's other texts of other components, as far as their sketches, which are bounds, allow them to be alike.
    """

    def banded(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = [bands(x) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["at", "keys"])

    def sketched(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [parities(x) for x in batch.column(1).to_pylist()]
        odd = np.array([x for _, x in found], np.int64).reshape(-1, len(_PARITY))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), *[pa.array(x) for x in odd.T]], names=["at", "n", *_PARITY])

    def verified(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = [alike(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def alike_roots(pairs: DataFrame) -> DataFrame:
        """The root pairs of those text pairs (a, b, ra, rb) that are alike."""
        text = lambda at, name: rows.select(F.col("at").alias(at), F.col("text").alias(name))
        both = pairs.join(text("a", "ta"), "a").join(text("b", "tb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"), "ta", "tb")
        return cut(map_batches(both, verified, "a long, b long").distinct(), "copies")

    found = map_batches(rows, banded, "at long, keys array<bigint>").join(known, "at").select("at", "root", F.explode("keys").alias("key"))
    found = cut(found, "copy-bands")
    centres = found.groupBy("key").agg(F.min("at").alias("c"), F.min_by("root", "at").alias("rc"), F.count("*").alias("m")).where(F.col("m") > 1)
    met = cut(found.join(centres, "key"), "copy-bands")
    forget(found)
    to_centre = met.where(F.col("root") != F.col("rc")).select(F.col("c").alias("a"), F.col("at").alias("b"), F.col("rc").alias("ra"), F.col("root").alias("rb")).distinct()
    first = alike_roots(to_centre)
    joined = cut(components(first, "copies"), "copies")
    top = lambda name, t: joined.select(F.col("node").alias(name), F.col("root").alias(t))
    placed = met.where(F.col("m") > 2).join(top("root", "t"), "root", "left").join(top("rc", "tc"), "rc", "left")
    placed = cut(placed.select("key", "at", "root", F.coalesce("t", "root").alias("t"), F.coalesce("tc", "rc").alias("tc")), "copy-bands")
    forget(met)
    # Of a band whose texts are all of the centre's component nothing is left to compare.
    left = placed.join(placed.where(F.col("t") != F.col("tc")).select("key").distinct(), "key", "left_semi")
    known = map_batches(rows.join(left.select("at").distinct(), "at", "left_semi").select("at", "text"), sketched, ", ".join(f"{x} long" for x in ("at", "n", *_PARITY)))
    left = cut(left.join(known, "at"), "copy-bands")
    other = left.select("key", F.col("at").alias("b"), F.col("root").alias("rb"), F.col("t").alias("tb"), *[F.col(x).alias(f"{x}_b") for x in ("n", *_PARITY)])
    apart = left.where(F.col("t") != F.col("tc")).select("key", F.col("at").alias("a"), F.col("root").alias("ra"), F.col("t").alias("ta"), "n", *_PARITY)
    more = apart.join(other, "key").where((F.col("ta") != F.col("tb")) & _may_be_alike()).select("a", "b", "ra", "rb").distinct()
    return first.union(alike_roots(more))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """One row of docs of each component, the one of the smallest doc_id, nulls last; columns unchanged.

    Links are at most budget differing bits, or a Jaccard similarity of 0.8 or more on shingles of five words.
    Rows are told apart though they share an id or have none.
    """
    rows = cut(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("at")), "neardup-rows")
    marked = cut(fingerprints(rows.select(F.col("at").alias("doc_id"), "row.text"), shingle), "fingerprints")
    ids = rows.select("at", F.col("row.doc_id").cast("long").alias("id"))
    texts = rows.select("at", F.col("row.text").cast("string").alias("text"))
    near = cut(marked.join(_roots(marked, budget), "fp").select(F.col("doc_id").alias("at"), "root"), "roots")
    # Equal texts share a root: one of each fingerprint and text stands for all.
    one = near.join(texts.select("at", F.xxhash64("text").alias("h")), "at").groupBy("root", "h").agg(F.min("at").alias("at")).select("at", "root")
    joined = components(cut(copies(texts.join(one, "at", "left_semi"), one), "copies"), "copies")
    over = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
    placed = near.join(over, "root", "left").select("at", F.coalesce("top", "root").alias("root")).join(ids, "at")
    kept = placed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at")).alias("best")).select("best.at")
    return rows.join(kept, "at", "left_semi").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
