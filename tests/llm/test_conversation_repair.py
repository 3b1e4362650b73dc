"""Repairs against a recursion over all edits of each conversation."""

from __future__ import annotations

import random
import re
from functools import cache
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from casemill.llm import conversation_repair as R

COLUMNS = "conv_id long, turn long, role string, text string"
BLANK = r"[\x20\x09-\x0D]"


def _place(place, initial):
    """Where a turn leads in `(s?(ua)+)?`, or None."""
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((place, initial))


def slow_audit(rows):
    """Cheapest (cost, audit) by recursion over rows and places; rows are (initial, must go, truncated)."""

    @cache
    def best(i, place, inserted):
        ways = [(0, "")] if i == len(rows) and place in ("", "a") else []
        if i < len(rows):
            initial, must_go, truncated = rows[i]
            steps = [("D", place, 3)]
            if not must_go:
                steps += [("K", _place(place, initial), truncated), *[("R", _place(place, x), 2 + truncated) for x in "ua"]]
            for edit, then, cost in steps:
                if then is not None:
                    c, rest = best(i + 1, then, 0)
                    ways.append((c + cost, edit + rest))
        for x in "ua" if inserted < 4 else "":
            if _place(place, x):
                c, rest = best(i, _place(place, x), inserted + 1)
                ways.append((c + 2, "I" + rest))
        return min(ways, default=(10**9, ""))

    return best(0, "", 0)


def slow_repair(rows):
    out, conversations = [], {}
    for conv, turn, role, text in rows:
        own = conversations.setdefault(conv, [])
        fate = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own += [(turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
    for conv, own in conversations.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0))
        seen, marked, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            bare = re.sub(BLANK + r"+\Z", "", text)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            marked.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
        cost, audit = slow_audit(tuple(marked))
        lines, place, at = [], "", 0
        for edit in audit:
            _, role, text = (None, "", "") if edit == "I" else own[at]
            at += edit != "I"
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if place == "u" else "user"
            place = role[0]
            lines.append(f"{role}:{text}")
        turns = {t for t, _, _ in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [x[0] for x in marked]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, n, longest):
    draw, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "cut off", " \t", "", "Why?  ", "so. then", "é…", "Fine.\n", None]
    for conv in range(n):
        for turn in range(draw.randint(1, longest)):
            role = draw.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""])
            text = draw.choice(texts) if draw.random() < 0.6 else f"{draw.random()}."
            rows.append((conv if conv else None, turn * draw.choice([1, 1, 1, 2]) * 100 + turn if draw.random() < 0.95 else turn * 1000 + 7, role, text))
    # One row a turn: what rows of one turn come after is not given.
    return list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())


def got_of(df):
    return sorted((tuple(x) for x in R.repair(df).collect()), key=str)


@pytest.mark.parametrize("bits", [8, 2])
def test_against_recursion(spark, monkeypatch, bits):
    """With two bits most conversations are cut into pieces of four rows."""
    monkeypatch.setattr(R, "PIECE_BITS", bits)
    rows = made(3, 60, 14)
    df = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 AS at", "2 AS head", "3 AS copies")
    assert got_of(df) == slow_repair(rows)


def test_given_table(spark, small):
    df = spark.read.parquet(f"{small}/conversations.parquet")
    assert got_of(df) == slow_repair([tuple(x) for x in df.select("conv_id", "turn", "role", "text").collect()])


def test_dropped_and_empty(spark):
    gone = next(i for i in range(1000) if crc32(f"{i}:0".encode()) % 20 == 0)
    (row,) = R.repair(spark.createDataFrame([(gone, 0, "user", "Hi.")], COLUMNS)).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())
    assert R.repair(spark.createDataFrame([], COLUMNS)).count() == 0


def test_hot_conversation_of_equal_rows(spark, monkeypatch):
    """A third of all rows are one conversation; its rows without a turn are equal, and lie in several partitions."""
    monkeypatch.setattr(R, "PIECE_BITS", 3)
    rows = [(1, None, "user", "Same.")] * 90 + [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(80)] + made(5, 20, 9)[9:]
    got = {x[0]: x for x in got_of(spark.createDataFrame(rows, COLUMNS).repartition(4))}
    want = {x[0]: x for x in slow_repair([x for x in rows if x[0] == 1])}
    assert got[1] == want[1]


def test_order_inside_a_turn_is_the_same_in_pieces(spark, monkeypatch):
    rows = [(7, t // 3, random.Random(t).choice(["user", "assistant"]), f"{t}.") for t in range(60)]
    df = spark.createDataFrame(rows, COLUMNS)
    whole = got_of(df)
    monkeypatch.setattr(R, "PIECE_BITS", 2)
    assert got_of(df.withColumn("x", F.lit(1))) == whole
