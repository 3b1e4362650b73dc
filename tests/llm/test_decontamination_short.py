"""Decontamination by word lists: short items inside long documents, rows under null and shared ids."""

from __future__ import annotations

import re

from casemill.llm import decontamination as D
from tests.llm.frames import documents, prose


def words(text):
    return [w for w in re.split("[^a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def slow(texts, items, least=0.8):
    """Pairs by word lists alone."""
    out = set()
    for d, t in texts.items():
        w = words(t)
        for i, u in items.items():
            x = words(u)
            k = min(5, len(x))
            own = {tuple(x[j : j + k]) for j in range(len(x) - k + 1)} if x else set()
            held = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
            if own and len(own & held) >= least * len(own):
                out.add((d, i))
    return out


def test_items_of_any_size_inside_long_documents(spark):
    items = {n: prose(900 + n, n) for n in [*range(1, 13), 20, 33, 70]} | {100: None, 101: "...", 102: "One-Word", 103: "zzz"}
    texts = {}
    for n, (i, u) in enumerate(items.items()):
        w = prose(n, 106).split()
        texts[i] = " ".join([*w[: 3 * n], (u or "").upper(), *w[3 * n :]])
        texts[1000 + i] = " ".join(w)
    texts |= {5000: items[4], 5001: items[1], 5002: None, 5003: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in D.contained(docs, bench, short=True).collect()}
    expected = slow(texts, items)
    assert got == expected and {(n, n) for n in (*range(1, 13), 20, 33, 70, 102)} <= got
    kept = sorted(x["doc_id"] for x in D.drop_contaminated(docs, bench, short=True).collect())
    assert kept == sorted(set(texts) - {d for d, _ in expected})


def test_rows_are_judged_by_their_own_texts(spark):
    item = prose(77, 30)
    rows = [(None, "clean " + prose(1, 40)), (None, item + " and more"), (3, item), (3, "another clean " + prose(2, 40))]
    docs = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "doc_id long, text string, n int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(x["n"] for x in D.drop_contaminated(docs, bench).collect()) == [0, 3]


def test_blocks_by_bytes_find_the_same(spark, monkeypatch):
    items = {i: prose(300 + i, 40) for i in range(20)}
    texts = [prose(i, 50) + " " + items[i % 20] for i in range(40)]
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    whole = sorted(map(str, D.contained(documents(spark, texts), bench).collect()))
    monkeypatch.setattr(D, "BLOCK_BYTES", 1000)
    assert sorted(map(str, D.contained(documents(spark, texts), bench).collect())) == whole and len(whole) >= 40
