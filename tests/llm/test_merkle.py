"""The Merkle manifest against hash trees built row by row."""

from __future__ import annotations

from hashlib import sha256
from itertools import groupby
from zlib import crc32

import pytest

from casemill.llm import merkle

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def _h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    doc_id, source, lang, n_chars, text = row
    return _h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def _tree(nodes, fanout):
    """Root, and the siblings (left, right) of each node on its way up."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [list(range(i, min(len(nodes), i + fanout))) for i in range(0, len(nodes), fanout)]
        for run in runs:
            for k in run:
                for leaf in owners[k]:
                    paths[leaf].append(("".join(nodes[j] for j in run if j < k), "".join(nodes[j] for j in run if j > k)))
        nodes, owners = [_h(*[nodes[k] for k in run]) for run in runs], [[x for k in run for x in owners[k]] for run in runs]
    return nodes[0], paths


def slow_manifest(rows, fanout=2):
    order = lambda r: (r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or 0, _leaf(r))
    groups = [list(g) for _, g in groupby(sorted(rows, key=order), key=lambda r: r[2])]
    trees = [_tree([_leaf(r) for r in g], fanout) for g in groups]
    root, crown = _tree([t[0] for t in trees], fanout)
    out = []
    for g, (subroot, paths), top in zip(groups, trees, crown, strict=True):
        for r, path in zip(g, paths, strict=True):
            tampered = r[0] is not None and crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            node = _leaf((*r[:3], r[3] + 1, r[4])) if tampered else _leaf(r)
            for left, right in path + top:
                node = _h(left, node, right)
            out.append((r[0], _leaf(r), subroot, root, _h(*[a + b for a, b in path + top]), node, node == root))
    return out


def _sorted(rows):
    return sorted(map(tuple, rows), key=str)


ROWS = [(i * i * 977 % 100_003, f"s{i % 3}", ["de", "en", None, "é", ""][min(i % 9, 4)], None if i % 11 == 0 else i, None if i % 13 == 0 else "x" * (i % 40)) for i in range(300)]
ODD = [(None, None, None, None, None), (None, None, None, None, None), (5, "s", "en", 1, "t"), (5, "s", "en", 1, "t"), (5, "s", "en", 1, "u"), (-3, "s", "en", 1, "t"), (2**62, "s", "fr", 1, "long " * 40_000)]


@pytest.mark.parametrize(("fanout", "most"), [(2, 4), (3, 9), (2, 4096)])
def test_manifest(spark, monkeypatch, fanout, most):
    monkeypatch.setattr(merkle, "BUCKET_ROWS", most)
    rows = ROWS + ODD
    df = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "'x' AS rank", "'y' AS leaf")
    got = merkle.manifest(df, fanout, most).collect()
    assert _sorted(got) == _sorted(slow_manifest(rows, fanout))
    assert {x["verified"] for x in got} == {True, False}


def test_ranks_of_crowded_keys(spark):
    """Very many equal ids among scattered ones: prefixes are refined past what the crowded ones share."""
    keys = [("a", f"{x:08x}") for x in [*range(200), *range(10**6, 10**9, 10**7), 4 * 10**9]] + [("b", "7" * n + ".") for n in range(1, 30)]
    got = merkle.ranked(spark.createDataFrame(keys, "tree string, key string"), 5).collect()
    for tree in "ab":
        own = sorted(k for t, k in keys if t == tree)
        assert {x["key"]: x["rank"] for x in got if x["tree"] == tree} == {k: i for i, k in enumerate(own)}
        assert {x["n"] for x in got if x["tree"] == tree} == {len(own)}


def test_equal_rows_have_places_of_their_own(spark):
    rows = [(7, "s", "en", 3, "abc")] * 50 + [(8, "s", "en", 3, "abc")]
    got = merkle.manifest(spark.createDataFrame(rows, COLUMNS), 2, 8).collect()
    assert _sorted(got) == _sorted(slow_manifest(rows))


def test_empty(spark):
    assert merkle.manifest(spark.createDataFrame([], COLUMNS)).count() == 0
