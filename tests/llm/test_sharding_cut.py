"""Sharding: linked documents come together, and hot lines and groups change nothing."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import functions as F

from casemill.llm import sharding as S
from tests.llm.frames import documents, prose


def cut_pairs(texts, shard):
    """Pairs of rows that share a line of 20 characters or more, and how many of them are apart, by brute force."""
    by = defaultdict(set)
    for d, t in texts.items():
        for line in t.split("\n"):
            if len(line) >= S.LINE_CHARS:
                by[line].add(d)
    pairs = {(a, b) for own in by.values() for a in own for b in own if a < b}
    return len(pairs), sum(shard[a] != shard[b] for a, b in pairs)


def families(n, size):
    return {f * size + i: f"{prose(f, 12)} family line\n{prose(1000 + f * size + i, 30)}" for f in range(n) for i in range(size)}


def test_linked_documents_come_together(spark):
    texts = families(60, 5)
    docs = documents(spark, [texts[d] for d in sorted(texts)])
    start = {x["doc_id"]: x["shard"] for x in S.assign(docs, rounds=0).collect()}
    end = {x["doc_id"]: x["shard"] for x in S.assign(docs).collect()}
    pairs, before = cut_pairs(texts, start)
    _, after = cut_pairs(texts, end)
    assert pairs == 600 and before > 0.85 * pairs and after < 0.7 * before
    sizes = [sum(s == k for s in end.values()) for k in range(S.SHARDS)]
    assert max(sizes) - min(sizes) <= 1


def test_hot_lines_and_groups(spark, monkeypatch):
    texts = [f"a line that very many documents have\n{prose(i, 20)}" for i in range(120)] + ["the same text again and again"] * 200 + [prose(5000 + i, 20) for i in range(80)]
    docs = documents(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("doc_id")))
    for hub, bucket in ((5_000, 10_000), (10, 8)):
        monkeypatch.setattr(S, "HUB_NODES", hub)
        monkeypatch.setattr(S, "BUCKET_ROWS", bucket)
        rows = S.assign(docs).collect()
        by = defaultdict(list)
        for x in rows:
            by[x["shard"]].append(x["slot"])
        assert len(rows) == 400 and len(by) == 16 and all(sorted(v) == list(range(25)) for v in by.values())


def test_parts_of_a_hub_hear_the_same_vote(spark, monkeypatch):
    texts = {i: f"one line that all documents of this table share\n{prose(i, 20)}" for i in range(64)}
    docs = documents(spark, [texts[d] for d in sorted(texts)])
    whole = sorted((x["doc_id"], x["shard"], x["slot"]) for x in S.assign(docs).collect())
    monkeypatch.setattr(S, "HUB_NODES", 5)
    assert sorted((x["doc_id"], x["shard"], x["slot"]) for x in S.assign(docs).collect()) == whole


def test_groups_stay_whole(spark):
    """30 copies in shards of 100 rows are in one shard; two large groups and many small ones each stay together."""
    texts = ["thirty copies of this"] * 30 + [f"pair {i // 2}" for i in range(600)] + ["ninety copies"] * 90 + ["a third of all, more than a shard"] * 500
    texts += [f"own text {i} {prose(i, 8)}" for i in range(1600 - len(texts))]
    by = defaultdict(lambda: defaultdict(int))
    for x in S.assign(documents(spark, texts)).collect():
        by[texts[x["doc_id"]]][x["shard"]] += 1
    assert all(len(by[t]) == 1 for t in by if not t.startswith("a third")) and len(by["thirty copies of this"]) == 1
    assert 5 <= len(by["a third of all, more than a shard"]) <= 16


def test_no_group_of_the_given_documents_is_split(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = S.assign(docs).join(docs.select("doc_id", "text"), "doc_id")
    split = found.groupBy("text").agg(F.count("*").alias("n"), F.countDistinct("shard").alias("shards")).where("n > 1 and shards > 1")
    assert split.count() == 0


def test_large_groups_first():
    assert S._placed_first([(1, 60), (2, 60), (3, 60), (4, 40)], [100, 100]) == ({1: 0, 2: 1, 4: 0}, [0, 40])
