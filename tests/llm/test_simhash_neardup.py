"""SimHash near-duplicates against brute force."""

from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from casemill.llm import simhash_neardup as S
from tests.llm.frames import awkward, documents, empty, prose


def slow_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps, budget):
    best = list(ids)
    while True:
        new = [min(best[j] for j in range(len(ids)) if bin(fps[i] ^ fps[j]).count("1") <= budget) for i in range(len(ids))]
        if new == best:
            return best
        best = new


@pytest.mark.parametrize("text", [None, "", " ", "One", "one two three four", "A b C d E f g", prose(5, 300), "ÀB çd Éf gh ij"])
def test_fingerprint(text):
    assert S.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("budget", [0, 2, 4])
def test_links_and_components(spark, budget):
    draw = np.random.Generator(np.random.PCG64(budget))
    centres = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [int(c) ^ (1 << int(draw.integers(64))) ^ (1 << int(draw.integers(64))) for c in centres for _ in range(6)]
    fps = sorted({int(c) for c in centres} | set(near) | {0, (1 << 64) - 1, 1 << 63})
    frame = spark.createDataFrame([(i, f - (1 << 64) if f >= 1 << 63 else f) for i, f in enumerate(fps)], "id long, fp long")
    rooted = {x["node"]: x["root"] for x in S.components(S.links(frame, budget), "t").collect()}
    assert [rooted.get(i, i) for i in range(len(fps))] == slow_components(list(range(len(fps))), fps, budget)


def test_split_tries_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(S, "TRIE_ROWS", 5)
    monkeypatch.setattr(S, "TASK_ROWS", 16)
    fps = [(3 << 40) + i for i in range(0, 160, 3)]  # all in one block value
    frame = spark.createDataFrame(list(enumerate(fps)), "id long, fp long")
    rooted = {x["node"]: x["root"] for x in S.components(S.links(frame, 2), "t").collect()}
    assert [rooted.get(i, i) for i in range(len(fps))] == slow_components(list(range(len(fps))), fps, 2)


def test_trie_pairs_are_all_pairs():
    draw = np.random.Generator(np.random.PCG64(3))
    fp = np.unique(np.concatenate([draw.integers(0, 1 << 63, 100, dtype=np.uint64), np.arange(60, dtype=np.uint64)]))
    one = np.array([0], np.int32)
    a, b = S.trie_pairs(fp, (one, one + len(fp), one, one + len(fp)), 3)
    got = sorted((min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True))
    assert got == [(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if bin(int(fp[i] ^ fp[j])).count("1") <= 3]


def test_awkward(spark):
    rows = S.near_duplicates(awkward(spark)).collect()
    assert len(rows) == awkward(spark).count()
    by = {x["doc_id"]: x for x in rows if x["doc_id"] is not None}
    assert by[0]["fp"] == by[1]["fp"] == by[2]["fp"] == 0 and by[2]["component_id"] == 0
    assert by[5]["component_id"] == by[4]["component_id"] == by[7]["component_id"] == 4
    assert {x["component_id"] for x in rows if x["doc_id"] is None} == {0, 4}
    assert S.near_duplicates(empty(spark)).count() == 0


def test_keep_one(spark):
    docs = awkward(spark)
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert {5, 7, 1, 2} & {x["doc_id"] for x in kept.collect()} == set()
    assert S.keep_one(empty(spark)).count() == 0
    same = documents(spark, [prose(7, 90)] * 5)
    assert [x["doc_id"] for x in S.keep_one(same).collect()] == [0]


def test_rows_under_null_and_shared_ids(spark):
    a, b, c, d = (prose(60 + i, 90) for i in range(4))
    rows = [(None, a), (None, b), (1, c), (1, c), (1, d), (None, c)]
    docs = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "doc_id long, text string, n int")
    kept = sorted(x["n"] for x in S.keep_one(docs).collect())
    assert len(kept) == 4 and {0, 1, 4} < set(kept) and len({2, 3} & set(kept)) == 1


def test_chain_over_a_null_id(spark, monkeypatch):
    fps = {"x": 0, "y": 0b1111, "z": 0b11111111}
    monkeypatch.setattr(S, "fingerprints", lambda docs, shingle: spark.createDataFrame([(1, fps["x"]), (None, fps["y"]), (2, fps["z"])], "doc_id long, fp long"))
    assert [x["component_id"] for x in S.near_duplicates(documents(spark, ["x"])).collect()] == [1, 1, 1]


def test_keep_one_of_all_near_copies(spark):
    texts = []
    for seed, n in enumerate([60, 90, 150, 300]):
        words = prose(80 + seed, n).split()
        texts += [" ".join(words), " ".join(["new"] * (n // 10) + words), " ".join(words + prose(90 + seed, n // 2).split())]
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    near = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) or bin(slow_fingerprint(texts[i]) ^ slow_fingerprint(texts[j])).count("1") <= 4
    expected = [i for i in range(len(texts)) if not any(near(i, j) for j in range(i))]
    assert any(bin(slow_fingerprint(texts[i]) ^ slow_fingerprint(texts[i + 1])).count("1") > 4 for i in range(0, 12, 3))
    assert sorted(x["doc_id"] for x in S.keep_one(documents(spark, texts)).collect()) == expected == [0, 2, 3, 5, 6, 8, 9, 11]
