"""Generalised LR repair of the turn structure of conversations.

The role grammar is ``conversation -> system pairs | pairs | nothing``, ``pairs -> pairs pair |
pair``, ``pair -> user assistant``. Its LR tables are worked out here from the productions. A
conversation is read row by row against a graph-structured stack: each live stack top
holds the least (cost, audit) that leads to it and a link to the top it came from, and equal tops
are merged by that order. Edits are weighted: keep 0, rerole 3, delete 4, insert 3; an
undeleted truncated row costs 3 more; blank and duplicate rows must go.

Three facts keep this small and exact:

- Audits of equal cost that used up the same rows are never prefixes of each other, so the order
  of two audits is the order of their first difference, and a merge can be final.
- A top that costs over 7 more than a top after a user turn or a whole pair never wins: that one
  reaches the same continuation by inserting one turn (3) and deleting one row (4).
- What one row does to a set of live tops depends on relative costs and order only, so it is worked
  out once per worker and looked up afterwards.

Rows are range-sorted by conversation and turn and gathered into blocks of bounded size. A
conversation inside one block is finished there. A longer one is a chain of blocks: each block
works out its cheapest way from every top to every top, a fold over those small tables picks the
tops between blocks, and the blocks then apply their edits on their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillworks.llm.common import Scratch, staged

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
PRODUCTIONS = (("C", "sP"), ("C", "P"), ("C", ""), ("P", "PT"), ("P", "T"), ("T", "ua"))
NEVER = INSERT + DELETE
BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20
SPACES = r"\x20\x09-\x0D"
RESULT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


class Tables:
    """LR states of the role grammar; a stack is a tuple of states, its last the top."""

    def __init__(self):
        start = self._closed({(-1, 0)})
        self.states, self.moves, todo = [start], {}, [0]
        while todo:
            at = todo.pop()
            for symbol in sorted({self._next(item) for item in self.states[at]} - {None}):
                kernel = {(p, dot + 1) for p, dot in self.states[at] if self._next((p, dot)) == symbol}
                to = self._closed(kernel)
                if to not in self.states:
                    self.states.append(to)
                    todo.append(len(self.states) - 1)
                self.moves[at, symbol] = self.states.index(to)

    @staticmethod
    def _rule(p: int) -> tuple[str, str]:
        return PRODUCTIONS[p] if p >= 0 else ("start", "C")

    def _next(self, item: tuple[int, int]) -> str | None:
        right = self._rule(item[0])[1]
        return right[item[1]] if item[1] < len(right) else None

    def _closed(self, items: set) -> frozenset:
        items = set(items)
        while True:
            heads = {self._next(item) for item in items}
            more = {(p, 0) for p, (left, _) in enumerate(PRODUCTIONS) if left in heads} - items
            if not more:
                return frozenset(items)
            items |= more

    def _reduced(self, stack: tuple[int, ...], p: int) -> tuple[int, ...]:
        left, right = self._rule(p)
        below = stack[: len(stack) - len(right)]
        return (*below, self.moves[below[-1], left])

    def shift(self, stack: tuple[int, ...], symbol: str) -> tuple[int, ...] | None:
        """The stack after a terminal, with every reduction that nothing competes with; None if it does not fit."""
        to = self.moves.get((stack[-1], symbol))
        if to is None:
            return None
        stack = (*stack, to)
        while len(self.states[stack[-1]]) == 1:
            ((p, dot),) = self.states[stack[-1]]
            if p < 0 or dot < len(self._rule(p)[1]):
                break
            stack = self._reduced(stack, p)
        return stack

    def accepts(self, stack: tuple[int, ...]) -> bool:
        """Whether reductions at the end of input lead to the whole conversation."""
        while (-1, 1) not in self.states[stack[-1]]:
            done = [p for p, dot in self.states[stack[-1]] if p >= 0 and dot == len(self._rule(p)[1])]
            if not done:
                return False
            stack = self._reduced(stack, done[0])
        return True


LR = Tables()


def _tops() -> tuple[list, dict, list, list]:
    """Tops that can be met, one stack for each; what a terminal does to them; which accept; which never lose by over 7."""
    stacks, step, todo = {0: (0,)}, {}, [0]
    while todo:
        top = todo.pop(0)
        for symbol in "sua":
            stack = LR.shift(stacks[top], symbol)
            if stack is not None:
                step[top, symbol] = stack[-1]
                if stack[-1] not in stacks:
                    stacks[stack[-1]] = stack
                    todo.append(stack[-1])
    names = list(stacks)
    number = {top: i for i, top in enumerate(names)}
    steps = {(number[top], symbol): number[to] for (top, symbol), to in step.items()}
    accepting = [i for i, top in enumerate(names) if LR.accepts(stacks[top])]
    system = steps[0, "s"]
    return names, steps, accepting, [i for i in range(len(names)) if i not in (0, system)]


# Equal tops accept the same continuations whatever lies below, so one stack stands for all.
TOPS, STEPS, ACCEPTING, SAFE = _tops()

# A live set: (cost above the least, top), listed in the order of the audits. A row's kind is "D" where it must go,
# else its initial s, u, a or "?", followed by "-" where it is truncated.
Live = tuple[tuple[int, int], ...]


def _inserted(top: int, limit: int = 2) -> list[tuple[int, int]]:
    """Tops reached by 0 to ``limit`` insertions and how many; the grammar allows one role at each, more never pay."""
    out = [(top, 0)]
    for k in range(1, limit + 1):
        fits = [s for s in ROLES if (out[-1][0], s) in STEPS]
        out.append((STEPS[out[-1][0], fits[0]], k))
    return out


_ADVANCED = Scratch()


def advanced(live: Live, kind: str) -> tuple[int, Live, tuple]:
    """One row: what the least cost grows by, the new live set, and for each new top (place of its old top, letters)."""
    known = _ADVANCED.get((live, kind))
    if known is None:
        known = _ADVANCED[live, kind] = _advance(live, kind)
    return known


def _advance(live: Live, kind: str) -> tuple[int, Live, tuple]:
    best: dict[int, tuple] = {}
    late = TRUNCATED if kind.endswith("-") else 0
    for rank, (cost, old) in enumerate(live):
        for top, k in _inserted(old):
            edits = [(top, DELETE, "D")]
            if kind[0] != "D":
                if (top, kind[0]) in STEPS:
                    edits.append((STEPS[top, kind[0]], KEEP + late, "K"))
                edits += [(STEPS[top, s], REROLE + late, "R") for s in ROLES if (top, s) in STEPS]
            for to, more, letter in edits:
                found = (cost + k * INSERT + more, rank, "I" * k + letter)
                if to not in best or found < best[to]:
                    best[to] = found
    least = min(found[0] for found in best.values())
    bound = min((found[0] for top, found in best.items() if top in SAFE), default=1 << 60) + NEVER
    kept = sorted(((found[1], found[2], top, found[0]) for top, found in best.items() if found[0] <= bound))
    return least, tuple((cost - least, top) for _, _, top, cost in kept), tuple((rank, letters) for rank, letters, _, _ in kept)


def ended(live: Live) -> tuple[int, int, str]:
    """The end of input: what the least cost grows by, the place of the winner among the live tops, its last insertions."""
    found = [
        (cost + k * INSERT, rank, "I" * k) for rank, (cost, old) in enumerate(live) for top, k in _inserted(old) if top in ACCEPTING
    ]
    return min(found)


class Run:
    """The rows of one block read from one top, or a conversation's from the start."""

    def __init__(self, kinds: list[str], top: int = 0):
        self.cost, self.live, self.back = 0, ((0, top),), []
        for kind in kinds:
            more, self.live, back = advanced(self.live, kind)
            self.cost += more
            self.back.append(back)

    def audit(self, place: int, tail: str = "") -> str:
        letters = [tail]
        for back in reversed(self.back):
            place, last = back[place]
            letters.append(last)
        return "".join(reversed(letters))


def repaired(roles: list[str], texts: list[str], audit: str, top: int = 0) -> list[tuple[str, str]]:
    """Role and text of the rows that an audit leaves of a block that begins at ``top``."""
    out, at = [], 0
    for letter in audit:
        if letter != "D":
            symbol = roles[at][:1] if letter == "K" else next(s for s in ROLES if (top, s) in STEPS)
            top = STEPS[top, symbol]
            out.append((roles[at] if letter == "K" else ROLES[symbol], "" if letter == "I" else texts[at]))
        at += letter != "I"
    return out


def as_lines(rows: list[tuple[str, str]]) -> bytes:
    return "\n".join(f"{role}:{text}" for role, text in rows).encode()


# --- damage and faults ------------------------------------------------------


def or_space(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` after the drill: a fixed twentieth each is dropped (no copies), emptied,
    stripped of ``.!?``, repeated (two copies) or given to the user. Null roles and texts become one space."""
    draw = F.pmod(F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")), F.lit(20))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), or_space("role").alias("role"), or_space("text").alias("text"), draw.alias("draw")
    )
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("draw") == 0, 0).when(F.col("draw") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.cast("long").alias("copies"))


def faulty(turns: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text, copies`` with equal ones added up, and ``repeats``: how many of the copies
    come after an equal role and text, ``blank`` and ``truncated``. Null turns come first.

    Copies are added up before anything moves, so a row repeated very often is one row. What was
    said more than once is found by digests alone; Spark sends that table whole where it is small.
    """
    said = F.sha2(F.to_json(F.struct("role", "text")), 256)
    heard = turns.where("copies > 0").select(F.col("conv_id").alias("_conv"), said.alias("_same"), F.col("turn").alias("_turn"), "copies")
    again = heard.groupBy("_conv", "_same").agg(F.sum("copies").alias("_n"), F.min(F.struct("_turn")).alias("_first")).where("_n > 1")
    again = staged(again.select("_conv", "_same", "_first._turn"), "said-again")
    rows = turns.where("copies > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("_said", said)
    joined = rows.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_said") == F.col("_same")), "left")
    first = F.col("turn").eqNullSafe(F.col("_turn")).cast("long")
    body = F.regexp_replace("text", f"[{SPACES}]+\\z", "")
    return joined.select(
        "conv_id",
        "turn",
        "role",
        "text",
        "copies",
        F.when(F.col("_same").isNull(), 0).otherwise(F.col("copies") - first).alias("repeats"),
        (~F.col("text").rlike(f"[^{SPACES}]")).alias("blank"),
        (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("truncated"),
    )


# --- blocks -----------------------------------------------------------------

FEW = "blank, duplicate, truncated, illegal".split(", ")
BLOCKS = (
    "conv_id long, place long, block long, alone boolean, rows long, blank long, duplicate long, truncated long, illegal long, "
    "first_initial string, last_initial string, first_turn long, last_turn long, least_turn long, turns long, "
    "cost long, audit string, sha string, kinds array<string>, roles array<string>, texts array<string>, ways array<array<long>>"
)


class Block:
    """Neighbouring rows of one conversation."""

    def __init__(self, conv: int | None, place: int, number: int):
        self.conv, self.place, self.number = conv, place, number
        self.kinds, self.roles, self.texts, self.turns, self.bytes = [], [], [], [], 0

    def add(self, kind: str, role: str, text: str, turn: int | None) -> None:
        self.kinds.append(kind)
        self.roles.append(role)
        self.texts.append(text)
        self.turns.append(turn)
        self.bytes += len(role) + len(text)

    def row(self, alone: bool, texts: bool) -> dict:
        initials = [role[:1] for role in self.roles]
        known = [t for t in self.turns if t is not None]
        out = {
            "conv_id": self.conv,
            "place": self.place,
            "block": self.number,
            "alone": alone,
            "rows": len(self.kinds),
            "blank": self.kinds.count("Db"),
            "duplicate": self.kinds.count("Dd"),
            "truncated": sum(kind.endswith("-") for kind in self.kinds),
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            "first_initial": initials[0],
            "last_initial": initials[-1],
            "first_turn": self.turns[0],
            "last_turn": self.turns[-1],
            "least_turn": known[0] if known else None,
            "turns": len(set(known)),
        }
        if alone:
            run = Run(self.kinds)
            more, place, tail = ended(run.live)
            audit = run.audit(place, tail)
            rows = repaired(self.roles, self.texts, audit)
            out |= {"cost": run.cost + more, "audit": audit, "sha": hashlib.sha256(as_lines(rows)).hexdigest()}
            return out | {"roles": [r for r, _ in rows], "texts": [t for _, t in rows]} if texts else out
        ways = []
        for top in range(len(TOPS)):
            run = Run(self.kinds, top)
            ways += [[top, to, run.cost + cost, rank] for rank, (cost, to) in enumerate(run.live)]
        return out | {"kinds": self.kinds, "roles": self.roles, "texts": self.texts, "ways": ways}


def _kind(blank: bool, repeated: bool, truncated: bool, role: str) -> str:
    if blank or repeated:
        return "Db" if blank else "Dd"
    return (role[:1] if role[:1] in ("s", "u", "a") else "?") + ("-" if truncated else "")


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Block, bool]]:
    """Blocks of sorted rows, and whether a block is surely a whole conversation: the first and the last
    conversation of a range may go on in the ranges beside it."""
    place, block, number, whole = TaskContext.get().partitionId(), None, 0, False
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "turn", "role", "text", "copies", "repeats", "blank", "truncated")]
        for conv, turn, role, text, copies, repeats, blank, truncated in zip(*columns):
            for copy in range(copies):
                if block is not None and conv != block.conv:
                    yield block, whole
                    block, whole = None, True
                elif block is not None and (len(block.kinds) >= BLOCK_ROWS or block.bytes >= BLOCK_BYTES):
                    yield block, False
                    block, whole = None, False
                if block is None:
                    block, number = Block(conv, place, number), number + 1
                block.add(_kind(blank, copy >= copies - repeats, truncated, role), role, text, turn)
    if block is not None:
        yield block, False


def _rows(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    out, size, schema = [], 0, _arrow(BLOCKS)
    for block, alone in _blocks(batches):
        out.append(block.row(alone, texts))
        size += block.bytes if texts or not alone else 0
        if len(out) >= 2000 or size >= BLOCK_BYTES:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


CHOSEN = "conv_id long, place long, block long, entry int, exit int, tail string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _fold(table: pa.Table) -> pa.Table:
    """One conversation of several blocks, as one row of small tables per block: the tops between its blocks and its figures."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["place"], r["block"]))
    live, cost, backs = ((0, 0),), 0, []
    for row in rows:
        best = {}
        ways: dict[int, list] = {}
        for entry, to, price, rank in row["ways"]:
            ways.setdefault(entry, []).append((to, price, rank))
        for place, (have, top) in enumerate(live):
            for to, price, rank in ways[top]:
                found = (have + price, place, rank, top)
                if to not in best or found < best[to]:
                    best[to] = found
        least = min(found[0] for found in best.values())
        kept = sorted((found[1], found[2], to, found[0], found[3]) for to, found in best.items())
        live, cost = tuple((price - least, to) for _, _, to, price, _ in kept), cost + least
        backs.append([(place, entry, to) for place, _, to, _, entry in kept])
    more, place, tail = ended(live)
    between = []
    for back in reversed(backs):
        place, entry, to = back[place]
        between.append((entry, to))
    between.reverse()
    illegal, turns = sum(r["illegal"] for r in rows), sum(r["turns"] for r in rows)
    for left, right in zip(rows, rows[1:]):
        illegal += left["last_initial"] + right["first_initial"] not in ("su", "ua", "au")
        turns -= left["last_turn"] is not None and left["last_turn"] == right["first_turn"]
    known = [r["least_turn"] for r in rows if r["least_turn"] is not None]
    figures = {
        "gaps": rows[-1]["last_turn"] - known[0] + 1 - turns if known else 0,
        **{name: sum(r[name] for r in rows) for name in FEW[:3]},
        "illegal": illegal,
        "cost": cost + more,
    }
    out = [
        {"conv_id": r["conv_id"], "place": r["place"], "block": r["block"], "entry": entry, "exit": to, "tail": tail if r is rows[-1] else "", **figures}
        for r, (entry, to) in zip(rows, between)
    ]
    return pa.Table.from_pylist(out, _arrow(CHOSEN))


def _arrow(ddl: str) -> pa.Schema:
    """An Arrow schema of the few types used here."""
    kinds = {
        "long": pa.int64(),
        "int": pa.int32(),
        "string": pa.string(),
        "boolean": pa.bool_(),
        "array<string>": pa.list_(pa.string()),
        "array<array<long>>": pa.list_(pa.list_(pa.int64())),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in (column.split() for column in ddl.split(", "))])


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, str, list[tuple[str, str]]]]:
    """Each block of a chain with its part of the audit and its repaired rows."""
    for batch in batches:
        for row in batch.to_pylist():
            run = Run(row["kinds"], row["entry"])
            letters = run.audit([top for _, top in run.live].index(row["exit"]), row["tail"])
            yield row, letters, repaired(row["roles"], row["texts"], letters, row["entry"])


def _summed_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains in order, streamed to one row each; the texts of one block are held at a time."""
    open_one = None
    for row, letters, rows in _applied(batches):
        if open_one is None or row["conv_id"] != open_one["conv_id"]:
            if open_one is not None:
                yield _closed(open_one, audit, hashed)
            open_one, audit, hashed, begun = {name: row[name] for name in ("conv_id", "gaps", *FEW, "cost")}, [], hashlib.sha256(), False
        audit.append(letters)
        if rows:
            hashed.update(b"\n" * begun + as_lines(rows))
            begun = True
    if open_one is not None:
        yield _closed(open_one, audit, hashed)


def _closed(figures: dict, audit: list[str], hashed) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([figures | {"audit": "".join(audit), "repaired_sha256": hashed.hexdigest()}], _arrow(RESULT))


TURNS = "conv_id long, before long, roles array<string>, texts array<string>"


def _spelled_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains in order, streamed: the repaired rows of each block and how many the conversation has before it."""
    conv, before = object(), 0
    for row, _, rows in _applied(batches):
        if row["conv_id"] != conv:
            conv, before = row["conv_id"], 0
        out = {"conv_id": conv, "before": before, "roles": [r for r, _ in rows], "texts": [t for _, t in rows]}
        before += len(rows)
        yield pa.RecordBatch.from_pylist([out], _arrow(TURNS))


def _read(turns: DataFrame, texts: bool) -> tuple[DataFrame, DataFrame]:
    """Blocks that are whole conversations, and the blocks of chains with their tops, sorted for streaming."""
    order = ["conv_id", "turn", "role", "text"]
    rows = faulty(turns).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = staged(rows.mapInArrow(partial(_rows, texts=texts), BLOCKS), "turn-blocks")
    chained = blocks.where("NOT alone")
    small = chained.select(
        "conv_id", "place", "block", *FEW, "first_initial", "last_initial", "first_turn", "last_turn", "least_turn", "turns", "ways"
    )
    chosen = staged(small.groupBy("conv_id").applyInArrow(_fold, CHOSEN), "turn-chains")
    bodies = chained.select("place", "block", "kinds", "roles", "texts")
    return blocks.where("alone"), chosen.join(bodies, ["place", "block"]).repartition("conv_id").sortWithinPartitions("conv_id", "place", "block")


def repair(turns: DataFrame) -> DataFrame:
    """The cheapest repair of every conversation of ``conv_id, turn, role, text, copies``, as ``RESULT``.

    Rows are taken by turn (null first), then role and text. A null conv_id is a conversation of
    its own. Roles are judged by their first character; an empty role fits nowhere. Repeated rows are
    duplicates after the first. Conversations without rows give none; an empty table gives none.
    Extra columns are not read. A conversation's audit is one value of the result; besides it a task
    holds one block of at most 4,096 rows, or 4 MB of text and one row, and a small table per block.
    """
    whole, chains = _read(turns, texts=False)
    gaps = F.coalesce(F.col("last_turn") - F.col("least_turn") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    done = whole.select("conv_id", gaps, *FEW, "cost", "audit", F.col("sha").alias("repaired_sha256"))
    return done.unionByName(chains.mapInArrow(_summed_up, RESULT))


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired rows themselves: ``conv_id, place, role, text``; places count from 0, inserted texts are empty.

    Takes the columns that :func:`repair` takes, with the same results for nulls, repeated rows and empty tables.
    """
    whole, chains = _read(turns, texts=True)
    blocks = whole.select("conv_id", F.lit(0).cast("long").alias("before"), "roles", "texts").unionByName(chains.mapInArrow(_spelled_out, TURNS))
    rows = blocks.select("conv_id", "before", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "row"))
    return rows.select("conv_id", (F.col("before") + F.col("at")).alias("place"), F.col("row.roles").alias("role"), F.col("row.texts").alias("text"))


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """Every conversation after the drill of :func:`damaged`, repaired; one that lost all its rows has zeros."""
    found = repair(damaged(conversations)).withColumnRenamed("conv_id", "_conv")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    empty = hashlib.sha256(b"").hexdigest()
    return joined.na.fill(0, ["gaps", *FEW, "cost"]).na.fill({"audit": "", "repaired_sha256": empty})
