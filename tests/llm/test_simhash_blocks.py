"""Wider block keys lose no link either."""

from __future__ import annotations

import numpy as np
import pytest

from casemill.llm import simhash_neardup as S
from tests.llm.test_simhash_neardup import slow_components


def test_blocks_grow_with_the_number():
    assert [S.blocks_needed(n, 4) for n in (0, 10**6, 10**8, 10**10, 10**14)] == [1, 1, 2, 3, 4]
    assert all(S.TRIE_ROWS << (64 * m // (4 + m)) >= n for n, m in ((10**6, 1), (10**8, 2), (10**10, 3)))


@pytest.mark.parametrize("more", [1, 2, 3])
def test_links_by_several_blocks(spark, monkeypatch, more):
    monkeypatch.setattr(S, "blocks_needed", lambda n, budget: more)
    draw = np.random.Generator(np.random.PCG64(more))
    centres = [int(c) for c in draw.integers(0, 1 << 63, 30, dtype=np.uint64)]
    near = [c ^ sum(1 << int(b) for b in draw.choice(64, 4, replace=False)) for c in centres for _ in range(5)]
    fps = sorted({*centres, *near, 0, (1 << 64) - 1})
    frame = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "id long, fp long")
    rooted = {x["node"]: x["root"] for x in S.components(S.links(frame, 4), "t").collect()}
    assert [rooted.get(i, i) for i in range(len(fps))] == slow_components(list(range(len(fps))), fps, 4)


def test_copies_through_centres(spark):
    """Texts that share bands with a centre they are not like: every pair of 0.8 is found by other means than the centre."""
    from tests.llm.frames import prose

    texts = []
    for seed in range(6):
        words = prose(200 + seed, 100).split()
        # A chain: each is like the next, the first and the last are not alike.
        texts += [" ".join(words[:80] + words[80 : 80 + k] + prose(300 + 10 * seed + k, 20 - k).split()) for k in (0, 4, 8, 12, 16, 20)]
        texts += [" ".join(["put", *words])]
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    n = len(texts)
    near = {(i, j) for i in range(n) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    root = list(range(n))
    for _ in range(n):
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    rows = spark.createDataFrame(list(enumerate(texts)), "at long, text string")
    known = rows.select("at", (rows["at"] + 1000).alias("root"))
    got = {x["node"] - 1000: x["root"] - 1000 for x in S.components(S.copies(rows, known), "t").collect()}
    assert [got.get(i, i) for i in range(n)] == root and len(near) > 20


def test_sketches_keep_alike_texts_and_few_others(spark):
    """Sizes and parities let every pair of 0.8 through, and next to none of 0.5, though they may share bands."""
    draw, texts, names = np.random.Generator(np.random.PCG64(5)), [], [f"w{i}" for i in range(5000)]
    base = list(draw.choice(names, 400))
    for i in range(40):  # ends of their own, of 10 to 400 words
        texts.append(" ".join([*base, *draw.choice(names, 10 * (i + 1))]))
    found = [S.parities(x) for x in texts]
    rows = spark.createDataFrame([(i, n, *map(int, odd)) for i, (n, odd) in enumerate(found)], ["at", "n", *S._PARITY])
    other = rows.select(*[rows[c].alias(f"{c}_b") for c in rows.columns])
    got = {tuple(x) for x in rows.join(other, rows["at"] < other["at_b"]).where(S._may_be_alike()).select("at", "at_b").collect()}
    wanted = {(i, j) for j in range(40) for i in range(j) if S.alike(texts[i], texts[j])}
    assert wanted and wanted <= got and len(got) < 2 * len(wanted) + 10
    assert S.parities(None)[0] == 0 and not S.parities("")[1].any()
