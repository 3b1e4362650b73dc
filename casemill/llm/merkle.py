"""Merkle manifest of a dataset: hash trees over the rows of each group, proofs, and what tampered rows fold to.

Ranks come from a trie over the digits of the ids: histograms of digit prefixes, refined where a prefix holds many rows,
give each prefix its first rank, and only the rows of one prefix are ever sorted together. The digits of a rank in the
base of the fanout are a node's place in its hash tree; nodes that share all digits but the last few, the longest common
prefix first, are reduced to their ancestor by one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from math import ceil, log
from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import cut, forget

FANOUT = 2
#: Rows of a digit prefix that are sorted together.
BUCKET_ROWS = 4096
#: Nodes that are reduced by one task, about.
BLOCK_NODES = 4096
#: Hexadecimal digits that a histogram is refined by.
STEP = 2

#: Siblings on a node's way up: digests to its left and to its right, level by level.
PATH = "array<struct<left: string, right: string>>"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def _leaf(n_chars: Column) -> Column:
    """Digest of a row's fields: `-` for a null, else the length in bytes, a colon and the value."""
    fields = [F.col("doc_id").cast("string"), F.col("source"), F.col("lang"), n_chars.cast("string"), F.col("text")]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in fields]).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree, key, leaf, changed of every row.

    tree orders the languages, nulls first and then by bytes; key orders a tree's rows by doc_id (nulls first), then by
    leaf. changed is the leaf of a tampered row, null if the row isn't one.
    """
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("1"), F.hex(F.col("lang").cast("binary"))), F.lit("0")).alias("tree"),
        _leaf(F.col("n_chars")).alias("leaf"),
        F.when(tampered, _leaf(F.col("n_chars") + 1)).alias("changed"),
        F.monotonically_increasing_id().alias("at"),
    )
    # Ids as unsigned numbers; equal rows are told apart by their place, which the written table fixes.
    digits = F.coalesce(F.concat(F.lit("1"), _hex(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)).cast("long")))), F.lit("0" * 17))
    return found.select("doc_id", "tree", F.concat(digits, "leaf", F.lower(_hex(F.col("at")))).alias("key"), "leaf", "changed")


def _hex(n: Column) -> Column:
    return F.lpad(F.hex(n), 16, "0")


def _shared(low: Column, high: Column) -> Column:
    """Characters that two texts share at their beginning."""
    same = lambda i: F.substring(low, F.lit(1), i) == F.substring(high, F.lit(1), i)
    return F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(low), F.length(high)))), same))


def _digits(n: int, most: int) -> int:
    """Digits of a key that spread n rows over prefixes of about most rows."""
    return STEP * ceil(log(n / most, 16**STEP)) if n > most else 0


def ranked(rows: DataFrame, most: int = BUCKET_ROWS) -> DataFrame:
    """rows (tree, key, ...) with rank, from 0 by key in the tree, and n, the tree's rows.

    Keys are unique in a tree and none is the beginning of another: where their lengths differ, a mark ends them.

    Prefixes are counted; those with more than most rows are counted again with further digits, past the ones
    that all their rows share. A prefix's first rank is its parent's plus what its elder siblings, at most 256, hold.
    An empty table gives an empty result.
    """
    trees = cut(rows.groupBy("tree").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")), "merkle-trees")
    ends = trees.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).first()
    first = len(commonprefix([ends["low"] or "", ends["high"] or ""]))
    depth = first + _digits(ends["n"] or 0, most)
    open_, placed, small, depths = rows, [], [], []
    while True:
        here = open_.withColumn("prefix", F.substring("key", 1, depth))
        found = cut(here.groupBy("tree", "prefix").agg(F.count("*").alias("size"), F.min("key").alias("low"), F.max("key").alias("high")), "merkle-prefixes")
        placed.append(here)
        small.append(found.where(F.col("size") <= most).select("tree", "prefix", "size"))
        depths.append(depth)
        heavy = found.where(F.col("size") > most)
        alike = heavy.agg(F.min(_shared(F.col("low"), F.col("high")))).first()[0]
        if alike is None:
            break
        open_ = here.join(heavy.select("tree", "prefix"), ["tree", "prefix"], "left_semi")
        depth += STEP * max(1, ceil((alike + STEP - depth) / STEP))
    buckets = _union(small)
    starts = trees.select("tree", F.substring("low", 1, first).alias("prefix"), F.lit(0).cast("long").alias("start"))
    if depths[-1] == first:
        starts = buckets.select("tree", "prefix", F.lit(0).cast("long").alias("start"))
    for d in range(first + STEP, depths[-1] + 1, STEP):
        level = buckets.groupBy("tree", F.substring("prefix", 1, d).alias("child")).agg(F.sum("size").alias("size"))
        level = level.withColumn("prefix", F.substring("child", 1, d - STEP))
        elder = F.expr("coalesce(sum(size) OVER (PARTITION BY tree, prefix ORDER BY child ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
        level = level.withColumn("elder", elder)
        starts = level.join(starts, ["tree", "prefix"]).select("tree", F.col("child").alias("prefix"), (F.col("start") + F.col("elder")).alias("start"))
    starts = cut(starts.join(trees.select("tree", "n"), "tree"), "merkle-starts")
    own = F.expr("row_number() OVER (PARTITION BY tree, prefix ORDER BY key) - 1")
    return _union([x.join(starts, ["tree", "prefix"]) for x in placed]).withColumn("rank", F.col("start") + own).drop("prefix", "start")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def _levels(n: int, fanout: int, most: int) -> int:
    """Levels from n nodes to one, at most those to one node of each whole block."""
    levels, left, block = 0, n, 1
    while left > 1 and block * fanout <= most:
        left, levels, block = -(-left // fanout), levels + 1, block * fanout
    return levels


def tiers(nodes: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The nodes and so many levels above them; the last run of a level may be shorter, even one node."""
    found = [nodes]
    for _ in range(levels):
        below = found[-1]
        found.append([digest(*below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return found


def siblings(found: list[list[str]], i: int, fanout: int) -> Iterator[dict[str, str]]:
    """The digests left and right of node i and of its ancestors, level by level."""
    for level in found[:-1]:
        first = i - i % fanout
        yield {"left": "".join(level[first:i]), "right": "".join(level[i + 1 : first + fanout])}
        i //= fanout


def _block_size(fanout: int, most: int) -> int:
    return fanout ** _levels(most, fanout, most)


def _parents(nodes: DataFrame, fanout: int, most: int) -> DataFrame:
    """Each block of nodes (tree, rank, n, digest) reduced to one: the nodes of the next round."""
    size = _block_size(fanout, most)

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        n = int(pdf["n"].iloc[0])
        (top,) = tiers(pdf["digest"].tolist(), _levels(n, fanout, most), fanout)[-1]
        return pd.DataFrame({"tree": [pdf["tree"].iloc[0]], "rank": [int(pdf["rank"].iloc[0]) // size], "n": [-(-n // size)], "digest": [top]})

    blocks = nodes.select("tree", "rank", "n", "digest").withColumn("block", F.expr(f"rank div {size}"))
    return blocks.groupBy("tree", "block").applyInPandas(up, "tree string, rank long, n long, digest string")


def _paths(nodes: DataFrame, above: DataFrame, fanout: int, most: int) -> DataFrame:
    """tree, rank, path of nodes, given those of their blocks' tops (tree, rank, path)."""
    size = _block_size(fanout, most)

    def down(pdf: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", ignore_index=True)
        found = tiers(pdf["digest"].tolist(), _levels(int(pdf["n"].iloc[0]), fanout, most), fanout)
        rest = list(top["path"].iloc[0])
        return pd.DataFrame({"tree": pdf["tree"], "rank": pdf["rank"], "path": [[*siblings(found, i, fanout), *rest] for i in range(len(pdf))]})

    blocks = nodes.select("tree", "rank", "n", "digest").withColumn("block", F.expr(f"rank div {size}"))
    tops = above.select("tree", F.col("rank").alias("block"), "path")
    return blocks.groupBy("tree", "block").cogroup(tops.groupBy("tree", "block")).applyInPandas(down, f"tree string, rank long, path {PATH}")


def _climbed(nodes: DataFrame, fanout: int, most: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each round and the trees' tops (tree, rank 0, n 1, digest)."""
    n, size, rounds = nodes.agg(F.max("n")).first()[0] or 1, _block_size(fanout, most), []
    while n > 1:
        rounds.append(nodes)
        nodes, n = cut(_parents(nodes, fanout, most), "merkle-nodes"), -(-n // size)
    return rounds, nodes


def manifest(docs: DataFrame, fanout: int = FANOUT, most: int = BLOCK_NODES) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    docs: doc_id (integer), source, lang, n_chars, text; any may be null, and other columns are ignored. Each language
    is a tree (null is one of its own, and comes first); rows stand in it by doc_id, nulls first, and rows of one doc_id
    by their leaf. Equal rows are equal leaves, each with a place and a proof of its own. A null doc_id is never
    tampered. An empty table gives an empty result. Only the root and counts reach the driver.
    """
    rows = cut(leaves(docs), "merkle-leaves")
    placed = cut(ranked(rows).select("doc_id", "tree", "rank", "n", F.col("leaf").alias("digest"), "changed"), "merkle-ranks")
    forget(rows)
    rounds, tops = _climbed(placed, fanout, most)
    # The trees' own tree: its leaves are the subroots, in the order of the trees. A dot, below all digits, ends a name.
    crowns = tops.select(F.col("tree").alias("own"), F.lit("").alias("tree"), F.concat("tree", F.lit(".")).alias("key"), "digest")
    crown = cut(ranked(crowns).select("own", "tree", "rank", "n", "digest"), "merkle-crown")
    crown_rounds, summit = _climbed(crown.select("tree", "rank", "n", "digest"), fanout, most)
    root = summit.first()
    paths = summit.select("tree", "rank", F.array().cast(PATH).alias("path"))
    for nodes in reversed(crown_rounds):
        paths = _paths(nodes, paths, fanout, most)
    above = crown.join(paths.select("rank", "path"), "rank").select(F.col("own").alias("tree"), F.lit(0).cast("long").alias("rank"), "path", F.col("digest").alias("subroot"))
    above = cut(above, "merkle-paths")
    subroots = above.select("tree", "subroot")
    for nodes in reversed(rounds[1:]):
        above = _paths(nodes, above, fanout, most)
    return _proofs(placed, above.join(subroots, "tree") if len(rounds) > 1 else above, root["digest"] if root else "", fanout, most)


def _proofs(placed: DataFrame, above: DataFrame, root: str, fanout: int, most: int) -> DataFrame:
    """The rows with their proofs, each block by itself: above holds the path and subroot of each block's top."""
    size = _block_size(fanout, most)

    def prove(pdf: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", ignore_index=True)
        found = tiers(pdf["digest"].tolist(), _levels(int(pdf["n"].iloc[0]), fanout, most), fanout)
        rest = list(top["path"].iloc[0])
        tail = "".join(x["left"] + x["right"] for x in rest)
        proofs, folded = [], []
        for i, (leaf, changed) in enumerate(zip(pdf["digest"], pdf["changed"], strict=True)):
            own = list(siblings(found, i, fanout))
            proofs.append(digest("".join(x["left"] + x["right"] for x in own), tail))
            node = changed if isinstance(changed, str) else leaf
            for x in [*own, *rest]:
                node = digest(x["left"], node, x["right"])
            folded.append(node)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "leaf": pdf["digest"], "subroot": top["subroot"].iloc[0], "root": root, "proof_sha256": proofs, "folded_root": folded, "verified": [x == root for x in folded]})

    blocks = placed.withColumn("block", F.expr(f"rank div {size}"))
    tops = above.select("tree", F.col("rank").alias("block"), "path", "subroot")
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return blocks.groupBy("tree", "block").cogroup(tops.groupBy("tree", "block")).applyInPandas(prove, schema)


_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)),
 lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1))))"""
_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"


def _leaf_sql(n_chars: str) -> str:
    return f"sha256({' || '.join(_FIELD.format(x) for x in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


#: DuckDB's version: levels one by one, the parts of a proof joined in their order.
SQL = f"""WITH RECURSIVE b AS (SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf,
  CASE WHEN xor(4294967295, {_CRC.format("doc_id::VARCHAR")}) % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} END AS changed FROM documents),
 l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM b),
 t AS (SELECT lang, 0 AS lev, i, leaf AS h, n FROM l UNION ALL
  SELECT lang, lev + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY lang, lev, i // 2, n),
 s AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
 u AS (SELECT 0 AS lev, i, h, n FROM s UNION ALL SELECT lev + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY lev, i // 2, n),
 p AS (SELECT lang, lev, i, n, h FROM t WHERE n > 1),
 f AS (SELECT doc_id, lang, i, 0 AS lev, leaf, coalesce(changed, leaf) AS node, '' AS proof, n FROM l UNION ALL
  SELECT f.doc_id, f.lang, f.i // 2, f.lev + 1, f.leaf, sha256(CASE WHEN p.h IS NULL THEN f.node WHEN f.i % 2 = 0 THEN f.node || p.h ELSE p.h || f.node END), f.proof || coalesce(p.h, ''), (f.n + 1) // 2
  FROM f LEFT JOIN p ON p.lang IS NOT DISTINCT FROM f.lang AND p.lev = f.lev AND p.i = xor(f.i, 1) WHERE f.n > 1),
 g AS (SELECT f.doc_id, f.leaf, f.node, f.proof, s.h AS subroot, s.i, s.n, 0 AS lev FROM f JOIN s ON f.lang IS NOT DISTINCT FROM s.lang WHERE f.n = 1),
 k AS (SELECT * FROM g UNION ALL
  SELECT k.doc_id, k.leaf, sha256(CASE WHEN u.h IS NULL THEN k.node WHEN k.i % 2 = 0 THEN k.node || u.h ELSE u.h || k.node END), k.proof || coalesce(u.h, ''), k.subroot, k.i // 2, (k.n + 1) // 2, k.lev + 1
  FROM k LEFT JOIN u ON u.lev = k.lev AND u.i = xor(k.i, 1) WHERE k.n > 1)
 SELECT doc_id, leaf, subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = (SELECT h FROM u WHERE n = 1) AS verified FROM k WHERE n = 1"""
