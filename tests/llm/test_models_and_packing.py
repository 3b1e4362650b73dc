"""Packing, classifiers, sharding, decontamination and HTML extraction."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from casemill.llm import decontamination as D
from casemill.llm import html_blocks as B
from casemill.llm import html_extraction as H
from casemill.llm import packing as P
from casemill.llm import quality_classifier as C
from casemill.llm import sharding as S
from casemill.llm import toxicity as T
from tests.llm.frames import awkward, documents, empty, prose

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def check_packed(rows, texts):
    model, bins = Tokenizer.from_file(TOKENIZER), defaultdict(list)
    pieces = defaultdict(list)
    for x in rows:
        bins[x["sequence_id"]].append((x["offset"], x["length"]))
        pieces[x["doc_id"]].append((x["piece"], x["start"], x["length"], x["ids_crc32"]))
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end and length > 0
            end += length
        assert end <= P.CAPACITY
    for doc_id, text in texts.items():
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert sorted(pieces[doc_id]) == [(i, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for i, s in enumerate(range(0, len(ids), 4096))]
    return len(bins), -(-sum(x["length"] for x in rows) // P.CAPACITY)


def test_packing_round_trip(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    n, least = check_packed(P.pack_documents(docs, TOKENIZER).collect(), {x["doc_id"]: x["text"] for x in docs.collect()})
    assert n <= least * 1.02 + 1


def test_packing_in_parts(spark, monkeypatch):
    monkeypatch.setattr(P, "PART_ROWS", 40)
    texts = {i: prose(i, 20 + 37 * (i % 23)) for i in range(200)}
    n, least = check_packed(P.pack_documents(documents(spark, list(texts.values())), TOKENIZER).collect(), texts)
    assert n <= least + 2


def test_packing_awkward(spark):
    docs = awkward(spark)
    texts = {x["doc_id"]: x["text"] for x in docs.collect() if x["doc_id"] not in (None, 4)}
    rows = P.pack_documents(docs, TOKENIZER).collect()
    check_packed(rows, texts)
    assert sum(x["piece"] == 0 for x in rows) == docs.count()
    assert P.pack_documents(empty(spark), TOKENIZER).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_local_search(seed):
    draw = np.random.Generator(np.random.PCG64(seed))
    lengths = draw.integers(1, 60, 150)
    bins = P.pack(lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(150))
    assert all(lengths[b].sum() <= 100 for b in bins) and len(bins) <= len(P.best_fit(lengths, 100))
    assert P.pack(np.array([60, 60, 40, 40], np.int64), 100) and P.pack(np.empty(0, np.int64), 100) == []


def test_swaps_empty_a_bin():
    size, near = [50, 40, 30, 30, 28, 22], [[0, 1], [2, 3, 4], [5]]
    before = sum(sum(size[i] for i in b) ** 2 for b in near)
    while P._improve(near, size, 100):
        after = sum(sum(size[i] for i in b) ** 2 for b in near)
        assert after > before and all(sum(size[i] for i in b) <= 100 for b in near)
        before = after
    assert sum(map(bool, near)) == 2


def labelled(spark):
    draw = np.random.Generator(np.random.PCG64(1))
    texts = [prose(i, 60) for i in range(300)]
    toxic = [int(draw.random() < 0.4) for _ in texts]
    texts = [t + " you awful nitwit " + prose(i, 20) if y else t for i, (t, y) in enumerate(zip(texts, toxic, strict=True))]
    grade = [i % 4 for i in range(300)]
    texts = [t + " fine" * 0 + " gradeword" * 0 + " " + " ".join(["splendid"] * g) for t, g in zip(texts, grade, strict=True)]
    return documents(spark, texts), spark.createDataFrame([(i, g, y) for i, (g, y) in enumerate(zip(grade, toxic, strict=True))], "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    rows = T.score(docs, T.train(docs, labels)).join(labels, "doc_id").collect()
    held = [x for x in rows if x["held_out"]]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in rows)
    assert sum(x["predicted"] == x["toxic"] for x in held) >= 0.95 * len(held)
    wrong = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {x["doc_id"]: x["score"] for x in T.score(docs, T.train(docs, wrong)).collect()}
    assert again == {x["doc_id"]: x["score"] for x in rows}  # held-out labels teach nothing
    kept = {x["doc_id"] for x in T.drop_toxic(docs, labels).collect()}
    assert kept == {x["doc_id"] for x in rows if not x["predicted"]}


def test_classifiers_awkward(spark):
    docs, labels = awkward(spark), labelled(spark)[1]
    for table in (labels, labels.limit(0), labels.where("toxic = 1 and quality = 1"), labels.select("doc_id", F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))):
        scored = T.score(docs, T.train(docs, table)).collect()
        assert len(scored) == docs.count() and all(0 <= x["score"] <= 1 for x in scored)
        assert C.grade(docs, C.train(docs, table)).count() == docs.count()
    none = T.train(docs, labels.limit(0))
    assert T.score(empty(spark), none).count() == 0 and none.score("x") < 0.5
    assert T.drop_toxic(docs, labels.limit(0)).columns == docs.columns
    same = {x["doc_id"]: x["score"] for x in T.score(docs, T.train(docs, labels)).where("doc_id < 2").collect()}
    assert same[0] == same[1]  # null and empty alike


def test_ordinal():
    draw = np.random.Generator(np.random.PCG64(2))
    latent = draw.normal(0, 1, 600)
    rows = [np.unique(np.append(np.flatnonzero(draw.random(30) < 1 / (1 + np.exp(-2 * z))), 40)).astype(np.int32) for z in latent]
    grade = np.searchsorted([-0.8, 0.0, 0.9], latent) + 1
    model = C.fit(rows, grade, width=41)
    assert (np.diff(model.thresholds) > 0).all() and model.grades.tolist() == [1, 2, 3, 4]
    score = np.array([model.weights[r].sum() / np.sqrt(len(r)) for r in rows])
    assert np.corrcoef(score, latent)[0, 1] > 0.8


def test_sharding(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = S.assign(docs).collect()
    texts = {x["doc_id"]: x["text"] for x in docs.collect()}
    by = defaultdict(list)
    for x in rows:
        by[x["shard"]].append(x["slot"])
        data = (texts[x["doc_id"]] or "").encode()
        assert (x["size"], x["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
    assert sorted(x["doc_id"] for x in rows) == sorted(texts)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    groups = defaultdict(set)
    for x in rows:
        groups[texts[x["doc_id"]]].add(x["shard"])
    assert sum(len(v) > 1 for v in groups.values()) <= 0.1 * len(groups)


def test_sharding_awkward(spark):
    docs = awkward(spark)
    many = docs.unionByName(spark.range(200).select(F.col("id").alias("doc_id"), F.lit("same text again and again").alias("text")), allowMissingColumns=True)
    for df in (docs, many, empty(spark)):
        rows = S.assign(df).collect()
        counts = [sum(x["shard"] == s for x in rows) for s in range(16)]
        assert len(rows) == df.count() and max(counts) - min(counts) <= 1
        assert len({(x["shard"], x["slot"]) for x in rows}) == len(rows)


def slow_contained(texts, items):
    known, out = D.WordHashes(), set()
    for d, t in texts.items():
        own = set(D.shingles(t, known).tolist())
        for i, u in items.items():
            wanted = set(D.shingles(u, known).tolist())
            if wanted and len(wanted & own) >= 0.8 * len(wanted):
                out.add((d, i))
    return out


def test_decontamination(spark):
    items = {i: prose(500 + i, n) for i, n in enumerate((4, 5, 6, 12, 30, 70, 140, 400))} | {90: None, 91: "", 92: items_text()}
    texts = {i: prose(i, 300 + 90 * i) for i in range(30)}
    for i, u in items.items():
        if u:
            w = texts[i % 30].split()
            texts[i % 30] = " ".join([*w[: 7 * i + 3], u, *w[7 * i + 3 :]])
            half = u.split()
            texts[(i + 9) % 30] += " " + " ".join(half[: len(half) // 2])
            texts[(i + 15) % 30] += " " + " ".join(half[: int(len(half) * 0.95)]).upper() + "!"
    texts[77] = items[0]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in D.contained(docs, bench).collect()}
    assert got == slow_contained(texts, items) and (77, 0) in got and len(got) > 10
    kept = {x["doc_id"] for x in D.drop_contaminated(docs, bench).collect()}
    assert kept == set(texts) - {d for d, _ in got}


def items_text():
    return "Ein Satz, der äußerst selten vorkommt: über zwölf Boxkämpfer jagt Viktor!"


def test_decontamination_awkward(spark, monkeypatch):
    docs = awkward(spark)
    items = docs.select(F.col("doc_id").alias("item_id"), "text")
    assert D.contained(docs, items.limit(0)).count() == 0 and D.contained(empty(spark), items).count() == 0
    whole = sorted(map(str, D.contained(docs, items).collect()))
    assert D.drop_contaminated(docs, items.where("item_id = 100")).count() == docs.count() - 1
    monkeypatch.setattr(D, "BLOCK_ITEMS", 7)  # several passes find the same
    assert sorted(map(str, D.contained(docs, items).collect())) == whole


PAGES = [
    ('<html><head><title>t</title></head><body><nav><a href="x">Home</a></nav><article><h1>Head &amp; line</h1><p>One  <b>bold</b>\n text that goes on for a while here.<p>Two &lt;b&gt; more words in it.<script>var t="</p>";</script></article><footer>end</footer>', "Head & line\nOne bold text that goes on for a while here.\nTwo <b> more words in it."),
    ("", ""), (None, ""), ("<nav><ul><li><a href=a>Menu</a></li></ul></nav>", ""),
]


def test_html(spark):
    pages = spark.createDataFrame([(i, "u", h, "x") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    rows = {x["page_id"]: x for x in H.extract(pages).collect()}
    for i, (_, text) in enumerate(PAGES):
        assert rows[i]["text"] == text and rows[i]["n_chars"] == len(text)
    assert H.extract(pages.limit(0)).count() == 0
    deep = spark.createDataFrame([(None, None, "<div>" * 3000 + "deep text" + "<p>word</p>" * 3000), (None, None, "<p" + "<" * 500)], "page_id long, url string, html string")
    assert H.extract(deep).count() == 2


def test_html_held_out(spark, small):
    draw, right, n = np.random.Generator(np.random.PCG64(123)), 0, 0
    for _ in range(60):
        page, labels = H.generated_page(draw)
        blocks = B.leaf_blocks(page)
        assert len(blocks) == len(labels)
        p = H.label(H.trained(), [B.vectors(blocks, {}, {})])[0]
        right, n = right + int(((p >= 0.5) == np.array(labels)).sum()), n + len(labels)
    assert right >= 0.97 * n


def test_lstm_gradient():
    draw = np.random.Generator(np.random.PCG64(5))
    w = {k: draw.normal(0, 0.3, s) for k, s in (("fx", (B.WIDTH, 64)), ("fh", (16, 64)), ("fb", 64))}
    x, mask = draw.normal(0, 0.3, (2, 3, B.WIDTH)), np.array([[1.0, 1, 1], [1, 1, 0]])
    aim = draw.normal(0, 1, (2, 3, 16)) * mask[:, :, None]
    value = lambda: float((H._run(w, "f", x, mask, False)[0] * aim).sum())
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    H._back(w, "f", x, H._run(w, "f", x, mask, True)[1], aim, grads)
    for k, at in (("fx", (3, 20)), ("fh", (2, 40)), ("fb", 5)):
        w[k][at] += 1e-2
        up = value()
        w[k][at] -= 2e-2
        assert (up - value()) / 2e-2 == pytest.approx(grads[k][at], rel=0.05, abs=1e-3)
        w[k][at] += 1e-2
