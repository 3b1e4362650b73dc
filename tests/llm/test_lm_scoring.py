"""The language model: counts by counting, gradients by differences, probabilities word by word."""

from __future__ import annotations

from collections import Counter
from math import exp, log, log10, tanh
from zlib import crc32

import numpy as np
import pytest

from casemill.llm import gru, lm_scoring
from tests.llm.frames import awkward, documents, empty, prose


def slow_words(text):
    lowered = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    words = "".join(" " if x in " \t\n\x0b\x0c\r" else x for x in lowered).split(" ")
    return [*(w for w in words if w), ""]


def slow_base(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) of rows (doc_id, text)."""
    held = lambda d: d is not None and crc32(str(d).encode()) % 10 == 0
    counts = Counter(w for d, t in rows if not held(d) for w in slow_words(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, t in rows:
        words = slow_words(t)
        out.append((d, held(d), len(words), sum(w in counts for w in words), n, sum(log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)))
    return out


def slow_score(model, ids):
    """Natural log probability of ids, one word and one number at a time."""
    p, h = model.p, model.hidden
    state, given, total = [0.0] * h, model.opening, 0.0
    sig = lambda x: 1 / (1 + exp(-x))
    norm = lambda xs: log(sum(exp(x) for x in xs))
    for wanted in ids:
        a = [float(sum(p["emb"][given, i] * p["wx"][i, j] for i in range(h)) + p["bias"][j]) for j in range(3 * h)]
        u = [float(sum(state[i] * p["wh"][i, j] for i in range(h))) for j in range(3 * h)]
        z, r = [sig(a[j] + u[j]) for j in range(h)], [sig(a[h + j] + u[h + j]) for j in range(h)]
        new = [tanh(a[2 * h + j] + r[j] * u[2 * h + j]) for j in range(h)]
        state = [(1 - z[j]) * new[j] + z[j] * state[j] for j in range(h)]
        out = [float(sum(state[i] * p["cw"][i, k] for i in range(h)) + p["cb"][k]) for k in range(p["cb"].size)]
        k = wanted // gru.WORDS_OF_CLASS if wanted < model.n_words else wanted - model.n_words + model.n_word_classes
        total += out[k] - norm(out)
        if wanted < model.n_words:
            own = [float(sum(state[i] * p["ww"][k, i, j] for i in range(h)) + p["wb"][k, j]) for j in range(gru.WORDS_OF_CLASS)]
            total += own[wanted % gru.WORDS_OF_CLASS] - norm(own)
        given = wanted
    return total


def _small(words=100, singles=3, hidden=4):
    draw = np.random.default_rng(1)
    model = gru.Gru(draw.uniform(1, 9, words), draw.uniform(1, 9, singles), 0, hidden)
    for k in ("cw", "ww", "bias"):
        model.p[k] = draw.normal(0, 0.3, model.p[k].shape).astype(np.float32)
    return model, [draw.integers(0, words + singles, n) for n in (1, 5, 40, 16, 17, 0, 3)]


@pytest.mark.parametrize("lanes", [1, 3, 512])
def test_scores_by_numbers(lanes):
    model, docs = _small()
    got = dict(model.scores(enumerate(docs), lanes))
    assert got.keys() == {i for i, x in enumerate(docs) if len(x)}
    assert all(abs(x - slow_score(model, docs[i])) < 1e-3 for i, x in got.items())


def test_gradients_by_differences(monkeypatch):
    """What a window of training would subtract is the loss's slope."""
    model, _ = _small(70, 2)
    docs = [(0, np.array([3, 69, 71, 70, 5, 3])), (1, np.array([1, 2])), (2, np.array([9]))]
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    slopes = {}

    def keep(name, gradient, rows=slice(None)):
        slopes.setdefault(name, np.zeros(model.p[name].shape))[rows] += gradient

    monkeypatch.setattr(model, "_update", keep)
    model.train(iter(docs), 2)
    loss = lambda: -sum(slow_score(model, ids) for _, ids in docs) / (gru.TRAIN_LANES * gru.STEPS)
    places = {"emb": [(3, 1), (0, 0), (71, 2)], "wx": [(0, 5), (3, 11)], "wh": [(1, 2), (2, 7), (3, 10)], "bias": [(0,), (6,), (9,)], "cw": [(1, 0), (2, 3)], "cb": [(1,)], "ww": [(0, 1, 3), (1, 2, 5)], "wb": [(0, 9)]}
    for name, own in places.items():
        for at in own:
            before = model.p[name][at]
            model.p[name][at] = before + 1e-4
            up = loss()
            model.p[name][at] = before - 1e-4
            slope = (up - loss()) / 2e-4
            model.p[name][at] = before
            assert abs(slope - slopes[name][at]) < 1e-3 * max(abs(slope), 1e-3), (name, at)


def _checked(got, rows):
    key = lambda x: (str(x[0]), x[2], x[5])
    own = sorted((tuple(x)[:6] for x in got), key=key)
    for a, b in zip(own, sorted(slow_base(rows), key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5]))
    assert all(x["score"] <= 0 and np.isfinite(x["score"]) for x in got)


def test_given_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = lm_scoring.score(docs, lm_scoring.train(docs)).collect()
    _checked(got, [(x["doc_id"], x["text"]) for x in docs.collect()])


def test_words_outside_the_lexicon(spark, monkeypatch):
    """With few frequent words the rest is looked up by the join; the sum is the same as with all known."""
    rows = [(i, prose(i % 40, 60) + f" Only{i}") for i in range(80)]
    docs = documents(spark, [t for _, t in rows])
    monkeypatch.setattr(lm_scoring, "VOCABULARY", 50)
    model = lm_scoring.train(docs)
    full = {x["doc_id"]: x["score"] for x in lm_scoring.score(docs, model).collect()}
    monkeypatch.setattr(lm_scoring, "FREQUENT", 60)
    monkeypatch.setattr(lm_scoring, "LONGEST", 6)
    known, least = lm_scoring.lexicon(lm_scoring.counted(docs.where(~lm_scoring.held_out())))
    assert 1 < len(known.words) <= 61 and known.n == model.lexicon.n
    few = lm_scoring.train(docs)
    got = lm_scoring.score(docs, few).collect()
    _checked(got, rows)
    assert few.rest.count() > 100 and full.keys() == {x["doc_id"] for x in got}


def test_probabilities_add_up(spark):
    """All words of the counts and one unseen word in each class have the whole probability."""
    docs = documents(spark, [prose(i, 30) for i in range(60)])
    model = lm_scoring.train(docs)
    lex, net = model.lexicon, model.lexicon.model()
    net.load(model.weights)
    state = np.random.default_rng(2).normal(0, 0.5, (1, net.hidden)).astype(np.float32)
    whole = sum(exp(float(net.log_probabilities(state, np.array([i]))[0])) for i in range(lex.size + lm_scoring.CLASSES))
    assert abs(whole - 1) < 1e-4
    inside = np.bincount(lex.classes[lex.size :], 10 ** lex.inside[lex.size :], lm_scoring.CLASSES) + 0.1 / lex.class_total()
    assert np.allclose(inside, 1)


def test_learns_more_than_counts(spark):
    """Documents in two languages with their own words: the state tells which."""
    texts = [" ".join(prose(5 + i % 2 * 1000, 400).split()[(i * 7) % 300 :][:80]) for i in range(600)]
    got = lm_scoring.score(documents(spark, texts), lm_scoring.train(documents(spark, texts))).collect()
    held = [x for x in got if x["held_out"]]
    assert len(held) > 30 and sum(x["score"] for x in held) > 0.9 * sum(x["base_score"] for x in held)


def test_awkward(spark):
    docs = awkward(spark)
    got = lm_scoring.score(docs, lm_scoring.train(docs)).collect()
    _checked(got, [(x["doc_id"], x["text"]) for x in docs.select("doc_id", "text").collect()])
    assert lm_scoring.score(empty(spark), lm_scoring.train(empty(spark))).count() == 0


def test_mean_of_many_models(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "FAN", 3)
    rows = [(i, i + 1, np.full(5, i, np.float32).tobytes()) for i in range(20)]
    got = lm_scoring._averaged(spark.createDataFrame(rows, "task long, n long, weights binary"))
    assert np.allclose(got, sum(i * (i + 1) for i in range(20)) / sum(range(1, 21)))


def test_weights_learn_from_every_training_document(spark, monkeypatch):
    """However large the corpus: the rounds' words together are all training words."""
    docs = spark.range(9000).selectExpr("id as doc_id", f"repeat('{prose(3, 30)} ', 10) as text")
    learnt, averaged = [], lm_scoring._averaged

    def noted(models):
        models = lm_scoring.cut(models, "noted")
        learnt.append(models.agg({"n": "sum"}).first()[0] or 0)
        return averaged(models)

    monkeypatch.setattr(lm_scoring, "_averaged", noted)
    model = lm_scoring.train(docs)
    assert sum(learnt) == model.lexicon.n > 2_400_000


def test_read_once_for_both(spark):
    docs = documents(spark, [prose(i, 40) for i in range(50)])
    both = {x["doc_id"]: x for x in lm_scoring.trained_and_scored(docs).collect()}
    _checked(both.values(), [(i, prose(i, 40)) for i in range(50)])
