"""Packing of lengths that don't combine: parts stay bounded, and swaps lower the number of bins."""

from __future__ import annotations

import numpy as np
import pandas as pd

from casemill.llm import packing as P


def frame(spark, lengths):
    rows = pd.DataFrame({"doc_id": np.arange(len(lengths)), "piece": 0, "start": 0, "length": lengths, "ids_crc32": 0}).astype({"piece": "int32"})
    return spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")


def test_no_part_takes_all(spark, monkeypatch):
    monkeypatch.setattr(P, "PART_ROWS", 100)
    draw = np.random.Generator(np.random.PCG64(1))
    lengths = draw.integers(2100, 4080, 2000)
    monkeypatch.setattr(P, "pieces", lambda docs, tokenizer, capacity: frame(spark, lengths))
    pack = P.pack

    def watched(own, capacity=P.CAPACITY):
        if len(own) > 300:
            raise AssertionError(f"{len(own)} rows in a part")
        return pack(own, capacity)

    monkeypatch.setattr(P, "pack", watched)
    rows = P.pack_documents(None, "").collect()
    bins = pd.DataFrame([(x["sequence_id"], x["length"]) for x in rows]).groupby(0)[1].sum()
    assert len(rows) == 2000 and len(bins) == 2000 and bins.max() <= 4096


def test_swaps_beat_best_fit():
    fewer = 0
    for seed in range(12):
        draw = np.random.Generator(np.random.PCG64(seed))
        lengths = draw.integers(18, 45, 90)
        bins, first = P.pack(lengths, 100), P.best_fit(lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(90)) and all(lengths[b].sum() <= 100 for b in bins) and len(bins) <= len(first)
        fewer += len(bins) < len(first)
    assert fewer >= 1


def test_swaps_of_like_lengths():
    lengths = np.random.Generator(np.random.PCG64(0)).integers(1000, 1501, 1500)
    assert len(P.pack(lengths)) < len(P.best_fit(lengths, P.CAPACITY))


def test_tokenizers_of_other_kinds_encode_whole_texts():
    import public_tokenizers

    for name, chunked in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        coder = P.ChunkIds(public_tokenizers.path(name))
        assert coder.chunked == chunked
        for text in ("", "Two words", " a  b\n\nc.", "Ünï, CODE. x,y"):
            ids = coder.model.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(coder.ids(text), "<u4").tolist() == ids


def test_no_improving_move_is_left():
    for low, high, n, capacity in ((1000, 1501, 900, 4096), (700, 1401, 700, 4096), (18, 45, 200, 100), (1, 100, 150, 100)):
        lengths = np.random.Generator(np.random.PCG64(3)).integers(low, high, n)
        bins = P.pack(lengths, capacity)
        assert sorted(i for b in bins for i in b) == list(range(n)) and all(lengths[b].sum() <= capacity for b in bins)
        least = -(-int(lengths.sum()) // capacity)
        assert len(bins) == least or not P._improve([list(b) for b in bins], [int(x) for x in lengths], capacity)


def test_small_sets_against_all_packings():
    """On few documents the fewest bins by trying all ways; the search is at most one bin above it, and mostly on it."""

    def fewest(left, bins, best):
        if not left:
            return min(best, len(bins))
        if len(bins) >= best:
            return best
        for k in range(len(bins)):
            if bins[k] + left[0] <= 30:
                best = fewest(left[1:], [*bins[:k], bins[k] + left[0], *bins[k + 1 :]], best)
        return fewest(left[1:], [*bins, left[0]], best)

    over = 0
    for seed in range(20):
        lengths = np.sort(np.random.Generator(np.random.PCG64(seed)).integers(4, 20, 10))[::-1]
        over += len(P.pack(lengths, 30)) - fewest(lengths.tolist(), [], 10)
    assert 0 <= over <= 2
