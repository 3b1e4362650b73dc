"""Cheapest repair of conversations whose turns were damaged, by a lazily determinised weighted automaton.

A conversation's rows are symbols: their role's initial and their fault. Edits are the arcs of an automaton over four
places (nothing yet, after a system turn, after a user turn, after an assistant turn). The costs of the cheapest ways
to the four places, less the least of them, are one state of the determinised automaton; states come up as they are
needed and stand in a transition table, so that costs are a scan of the table. Arcs on a cheapest way (tight ones) are
marked from the end, and the audit takes the ASCII-least of them from the beginning.

A conversation of few rows is solved in one row. Longer ones are cut into pieces: what a piece does to the four costs is a
small matrix, the matrices of a conversation are folded, and each piece is then solved by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import cut, sliced

#: Pieces have at most 2 ** PIECE_BITS rows; conversations of no more rows are solved whole.
PIECE_BITS = 8
#: Conversations of an Arrow batch that are held at a time.
BATCH_CONVERSATIONS = 64

BLANK = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NEVER = 1 << 40

Vector = tuple[int, ...]


def _after(place: int) -> int:
    """Where a user or assistant turn, whichever may come, leads."""
    return ASSISTANT if place == USER else USER


def _arcs(symbol: str) -> list[tuple[int, int, str, int]]:
    """(from, to, edit, cost) over a row: initial s, u, a or another (o), capital if truncated; x must be deleted."""
    found = [(p, p, "D", DELETE) for p in range(4)]
    if symbol != "x":
        extra, initial = TRUNCATED * symbol.isupper(), symbol.lower()
        for p in range(4):
            fits = {"s": p == START, "u": p != USER, "a": p == USER}.get(initial, False)
            if fits:
                found.append((p, SYSTEM if initial == "s" else _after(p), "K", extra))
            found.append((p, _after(p), "R", REROLE + extra))
    return found


ARCS = {x: _arcs(x) for x in "suaoSUAOx"}


def _closed(costs: list[int]) -> list[int]:
    """Costs with insertions before the next row."""
    costs = list(costs)
    costs[USER] = min(costs[USER], *[costs[p] + INSERT for p in (START, SYSTEM, ASSISTANT)])
    costs[ASSISTANT] = min(costs[ASSISTANT], costs[USER] + INSERT)
    return costs


FIRST: Vector = tuple(_closed([0, NEVER, NEVER, NEVER]))
#: Costs from the four places to an end, when no row is left.
LAST: Vector = (0, 2 * INSERT, INSERT, 0)


class Determinised:
    """States (cost vectors less their least entry), numbered as they come up, and the transitions worked out so far."""

    def __init__(self) -> None:
        self.vectors: list[Vector] = []
        self.numbers: dict[Vector, int] = {}
        self.table: list[dict[str, tuple[int, int]]] = []
        self.marks: dict[tuple[int, str, int], int] = {}

    def state(self, costs: list[int] | Vector) -> tuple[int, int]:
        """The state of a cost vector, and what was taken off."""
        least = min(costs)
        vector = tuple(min(NEVER, x - least) if x < NEVER else NEVER for x in costs)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.table.append({})
        return self.numbers[vector], least

    def step(self, state: int, symbol: str) -> tuple[int, int]:
        found = self.table[state].get(symbol)
        if found is None:
            old, new = self.vectors[state], [NEVER] * 4
            for p, q, _, cost in ARCS[symbol]:
                new[q] = min(new[q], old[p] + cost)
            found = self.table[state][symbol] = self.state(_closed(new))
        return found

    def scan(self, costs: Vector, symbols: str) -> tuple[list[int], int]:
        """The states before each row and after the last, and all that was taken off."""
        state, total = self.state(costs)
        states = [state]
        for symbol in symbols:
            state, least = self.step(state, symbol)
            total += least
            states.append(state)
        return states, total

    def after(self, costs: Vector, symbols: str) -> Vector:
        states, total = self.scan(costs, symbols)
        return tuple(min(NEVER, x + total) for x in self.vectors[states[-1]])

    def tight(self, state: int, symbol: str, ahead: int) -> int:
        """The places (bits) before a row from which a cheapest way goes on to the marked places after it."""
        key = (state, symbol, ahead)
        if key not in self.marks:
            old, (number, least) = self.vectors[state], self.step(state, symbol)
            new, marked = self.vectors[number], 0
            for p, q, _, cost in ARCS[symbol]:
                if ahead >> q & 1 and old[p] < NEVER and old[p] + cost == new[q] + least:
                    marked |= 1 << p
            for p in (USER, ASSISTANT, USER, START, SYSTEM):
                if marked >> _after(p) & 1 and old[p] + INSERT == old[_after(p)]:
                    marked |= 1 << p
            self.marks[key] = marked
        return self.marks[key]

    def audits(self, costs: Vector, symbols: str, ends: int, last: bool) -> dict[int, tuple[int, str]]:
        """For each place on a cheapest way before the rows: the place after them, and the ASCII-least edits.

        ends: the places after the rows that lie on a cheapest way; last: whether the conversation ends there.
        """
        states, _ = self.scan(costs, symbols)
        marks = [ends]
        for state, symbol in zip(states[-2::-1], symbols[::-1], strict=True):
            marks.append(self.tight(state, symbol, marks[-1]))
        marks.reverse()
        return {p: self._audit(p, states, symbols, marks, last) for p in range(4) if marks[0] >> p & 1}

    def _audit(self, place: int, states: list[int], symbols: str, marks: list[int], last: bool) -> tuple[int, str]:
        edits, at = [], 0
        while at < len(symbols) or (last and place not in (START, ASSISTANT)):
            old, choices = self.vectors[states[at]], []
            if at < len(symbols):
                number, least = self.step(states[at], symbols[at])
                new = self.vectors[number]
                choices = [(edit, q, 1) for p, q, edit, cost in ARCS[symbols[at]] if p == place and marks[at + 1] >> q & 1 and old[p] + cost == new[q] + least]
            q = _after(place)
            if marks[at] >> q & 1 and old[place] + INSERT == old[q]:
                choices.append(("I", q, 0))
            edit, place, taken = min(choices)
            edits.append(edit)
            at += taken
        return place, "".join(edits)


def symbols_of(roles: list[str], texts: list[str], seen: set[tuple[str, str]]) -> str:
    """A symbol per row; seen takes the rows' roles and texts. x also for blank rows."""
    out = []
    for role, text in zip(roles, texts, strict=True):
        bare = text.rstrip(BLANK)
        if not bare or (role, text) in seen:
            out.append("x")
            continue
        seen.add((role, text))
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        out.append(initial if bare[-1] in ".!?" else initial.upper())
    return "".join(out)


def repaired(place: int, audit: str, roles: list[str], texts: list[str]) -> Iterator[str]:
    """The lines `role:text` that edits leave, from a place on."""
    rows = iter(zip(roles, texts, strict=True))
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K" and role[:1] == "s":
            place = SYSTEM
        else:
            place = _after(place)
            if edit != "K":
                role = "user" if place == USER else "assistant"
        yield f"{role}:{text}"


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies (0, 1 or 2) of every row after damage, drawn by a hash of conversation and turn.

    Null roles and texts are one space, as are null ids and turns in what is hashed.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text, role = name("text"), name("role")
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"),
    )


FIELDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _solved(auto: Determinised, rows: list[dict]) -> dict:
    """The result of a conversation held whole, its rows in order."""
    rows = [x for x in rows for _ in range(x["copies"])]
    roles, texts = [x["role"] for x in rows], [x["text"] for x in rows]
    symbols = symbols_of(roles, texts, set())
    costs = auto.after(FIRST, symbols)
    cost = min(costs[START], costs[ASSISTANT])
    _, audit = auto.audits(FIRST, symbols, _ends(costs, LAST, cost), True)[START]
    turns = {x["turn"] for x in rows} - {None}
    n_blank = sum(not x.strip(BLANK) for x in texts)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        "blank": n_blank,
        "duplicate": symbols.count("x") - n_blank,
        "truncated": sum(x.isupper() for x in symbols),
        "illegal": _illegal([x[:1] for x in roles]),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": sha256("\n".join(repaired(START, audit, roles, texts)).encode("utf-8", "replace")).hexdigest(),
    }


def _ends(costs: Vector, to_go: Vector, total: int) -> int:
    return sum(1 << p for p in range(4) if costs[p] + to_go[p] == total)


def _short(rows: DataFrame, kind: str) -> DataFrame:
    """Results of conversations of few rows, each gathered in one row."""
    order = F.struct("turn", "role", F.xxhash64("text").alias("_h"), "text", "copies")
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("copies") > 0, order))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Determinised()
        for batch in sliced(batches, BATCH_CONVERSATIONS):
            out = pa.Table.from_pylist([_solved(auto, x) for x in batch.column(1).to_pylist()]).to_batches()
            for part in out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *part.columns], names=["conv_id", *part.schema.names])

    return gathered.mapInArrow(run, f"conv_id {kind}, {FIELDS}")


def _symbol() -> Column:
    bare = F.rtrim(F.col("text"), F.lit(BLANK))
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    return F.when(bare == "", "x").when(F.substring(bare, -1, 1).isin(".", "!", "?"), initial).otherwise(F.upper(initial))


def _after_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds what each piece makes of the four costs: the costs after it from each place alone."""
    auto = Determinised()
    for batch in batches:
        effects = [[x for p in range(4) for x in auto.after(tuple(0 if q == p else NEVER for q in range(4)), symbols)] for symbols in batch.column("symbols").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(effects, pa.list_(pa.int64()))], names=[*batch.schema.names, "effect"])


def _times(costs: Vector, effect: list[int]) -> Vector:
    return tuple(min(NEVER, *[costs[p] + int(effect[4 * p + q]) for p in range(4)]) for q in range(4))


def _folded(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each piece of a conversation: the costs before it, the places of cheapest ways after it, and the whole cost."""
    pdf = pdf.sort_values("head", ignore_index=True)
    before, to_go = [FIRST], [LAST]
    for effect in pdf["effect"]:
        before.append(_times(before[-1], effect))
    for effect in pdf["effect"][::-1]:
        back = [min(to_go[-1][q] + int(effect[4 * p + q]) for q in range(4)) for p in range(4)]
        user = min(back[USER], back[ASSISTANT] + INSERT)
        to_go.append((min(back[START], user + INSERT), min(back[SYSTEM], user + INSERT), user, min(back[ASSISTANT], back[USER] + INSERT)))
    total = min(before[-1][START], before[-1][ASSISTANT])
    ends = [_ends(a, b, total) for a, b in zip(before[1:], to_go[-2::-1], strict=True)]
    return pd.DataFrame({"head": pdf["head"], "costs": [list(x) for x in before[:-1]], "ends": ends, "last": pdf.index == len(pdf) - 1, "cost": total})


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the place after the piece and the audit, for each place before it; -1 and null where no cheapest way is."""
    auto = Determinised()
    for batch in batches:
        exits, audits = [], []
        for x in batch.to_pylist():
            found = auto.audits(tuple(x["costs"]), x["symbols"], x["ends"], x["last"])
            exits.append([found.get(p, (-1, None))[0] for p in range(4)])
            audits.append([found.get(p, (-1, None))[1] for p in range(4)])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("head"), pa.array(exits, pa.list_(pa.int32())), pa.array(audits, pa.list_(pa.string()))], names=["conv_id", "head", "exits", "audits"])


def _walked(pdf: pd.DataFrame) -> pd.DataFrame:
    """The place before each piece of a conversation."""
    pdf = pdf.sort_values("head", ignore_index=True)
    place, places = START, []
    for exits in pdf["exits"]:
        places.append(place)
        place = int(exits[place])
    return pd.DataFrame({"head": pdf["head"], "place": places})


def _long(rows: DataFrame, kind: str) -> DataFrame:
    """Results of conversations of any number of rows, no more than a piece of which is ever held at once.

    Only the fold of a conversation's pieces is one group: 16 numbers for 2 ** PIECE_BITS rows. An audit is one text, of less
    than 2 ** 31 characters and at least one a row, so a fold has less than 2 ** 31 / 2 ** PIECE_BITS pieces. SHA-256 reads
    a conversation's repaired pieces in order, as a stream.
    """
    rows = cut(rows.where(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copy", "copies"), "repair-long")
    # The last key spreads equal rows, whose order is all the same.
    order = ["conv_id", "turn", "role", F.xxhash64("text"), F.monotonically_increasing_id()]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select("conv_id", "turn", "role", "text", *[x.alias(f"_o{i}") for i, x in enumerate(order[3:])])
    by = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "_o0", "_o1")]
    placed = cut(keyed.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_o0", "_o1").withColumn("at", F.monotonically_increasing_id()), "repair-placed")
    placed = placed.withColumn("piece", F.shiftright("at", PIECE_BITS)).withColumn("symbol", _symbol())
    first = placed.where(F.col("symbol") != "x").groupBy("conv_id", "role", F.sha2(F.col("text").cast("binary"), 256).alias("_same")).agg(F.min("at").alias("at"))
    light = placed.select("conv_id", "piece", "at", "turn", "symbol", F.substring("role", 1, 1).alias("initial"))
    marked = light.join(first.select("at", F.lit(True).alias("first")), "at", "left")
    repeated = (F.col("symbol") != "x") & F.col("first").isNull()
    marked = marked.withColumns({"blank": F.col("symbol") == "x", "duplicate": repeated, "symbol": F.when(repeated, "x").otherwise(F.col("symbol"))})
    listed = F.sort_array(F.collect_list(F.struct("at", "symbol", "initial")))
    pieces = marked.groupBy("conv_id", "piece").agg(F.min("at").alias("head"), listed.alias("_all"), F.count_if("blank").alias("blank"), F.count_if("duplicate").alias("duplicate"))
    pieces = pieces.select("conv_id", "piece", "head", "blank", "duplicate", F.array_join(F.transform("_all", lambda x: x["symbol"]), "").alias("symbols"), F.transform("_all", lambda x: x["initial"]).alias("initials"))
    pieces = cut(pieces.mapInArrow(_after_symbols, f"conv_id {kind}, piece long, head long, blank long, duplicate long, symbols string, initials array<string>, effect array<long>"), "repair-pieces")
    fold = cut(pieces.groupBy("conv_id").applyInPandas(_folded, "head long, costs array<long>, ends int, last boolean, cost long"), "repair-fold")
    ways = cut(pieces.select("conv_id", "head", "symbols").join(fold, "head").select("conv_id", "head", "symbols", "costs", "ends", "last").mapInArrow(_ways, f"conv_id {kind}, head long, exits array<int>, audits array<string>"), "repair-ways")
    places = ways.select("conv_id", "head", "exits").groupBy("conv_id").applyInPandas(_walked, "head long, place int")
    ways = ways.join(places, "head").select("head", "place", F.get("audits", F.col("place")).alias("audit"))

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, BATCH_CONVERSATIONS):
            lines = [list(repaired(x["place"], x["audit"], [r["role"] for r in x["rows"]], [r["text"] for r in x["rows"]])) for x in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("conv_id", "head", "audit", "cost", "symbols", "initials", "blank", "duplicate")], pa.array(lines, pa.list_(pa.string()))], names=["conv_id", "head", "audit", "cost", "symbols", "initials", "blank", "duplicate", "lines"])

    whole = placed.groupBy("conv_id", "piece").agg(F.min("at").alias("head"), F.sort_array(F.collect_list(F.struct("at", "role", "text"))).alias("rows"))
    known = pieces.drop("conv_id", "piece", "effect").join(ways, "head").join(fold.select("head", "cost"), "head")
    schema = f"conv_id {kind}, head long, audit string, cost long, symbols string, initials array<string>, blank long, duplicate long, lines array<string>"
    mended = whole.join(known, "head").mapInArrow(mend, schema)
    found = mended.repartition("conv_id").sortWithinPartitions("conv_id", "head").mapInArrow(_hashed, f"conv_id {kind}, {FIELDS.replace('gaps long, ', '')}")
    turns = rows.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    joined = found.alias("f").join(turns.alias("t"), F.col("f.conv_id").eqNullSafe(F.col("t.conv_id")))
    return joined.select("f.conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), *[f"f.{x.split()[0]}" for x in FIELDS.split(", ")[1:]])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The results of conversations whose pieces come in order, hashed as they come."""
    now, state, audit = None, None, []

    def done() -> pa.RecordBatch:
        state["audit"], state["repaired_sha256"] = "".join(audit), state.pop("hash").hexdigest()
        state.pop("initial"), state.pop("lines")
        return pa.RecordBatch.from_arrays([pa.array([now[0]], kind), *[pa.array([v], pa.string() if isinstance(v, str) else pa.int64()) for v in state.values()]], names=["conv_id", *state])

    for batch in sliced(batches, BATCH_CONVERSATIONS):
        kind = batch.schema.field("conv_id").type
        for x in batch.to_pylist():
            if now != [x["conv_id"]]:
                if now:
                    yield done()
                now, audit = [x["conv_id"]], []
                state = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": x["cost"], "audit": "", "repaired_sha256": "", "hash": sha256(), "initial": [], "lines": False}
            state["blank"] += x["blank"]
            state["duplicate"] += x["duplicate"]
            state["truncated"] += sum(s.isupper() for s in x["symbols"])
            state["illegal"] += _illegal([*state["initial"], *x["initials"]])
            state["initial"] = x["initials"][-1:]
            audit.append(x["audit"])
            for line in x["lines"]:
                state["hash"].update((b"\n" if state["lines"] else b"") + line.encode("utf-8", "replace"))
                state["lines"] = True
    if now:
        yield done()


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    conversations: conv_id, turn, role, text; any may be null, and other columns are ignored. Rows of one turn come in the
    order of role and of a hash of the text; a null conv_id is a conversation of its own. One whose rows are all dropped
    has zeros, an empty audit and the empty text's hash. Repeated rows are rows. An empty table gives an empty result.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = damaged(conversations)
    sizes = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"))
    many = cut(sizes.where(F.col("n") > 1 << PIECE_BITS).select(F.col("conv_id").alias("many")), "repair-many")
    if many.isEmpty():
        return _short(rows, kind)
    same = F.col("conv_id").eqNullSafe(F.col("many"))
    return _short(rows.join(many, same, "left_anti"), kind).unionByName(_long(rows.join(many, same, "left_semi"), kind))
