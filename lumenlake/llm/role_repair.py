"""Conversation repair by generalised LR parsing of the roles, with weighted edits.

Roles must read `(s?(ua)+)?`. An SLR table of that grammar is made once. A parse keeps
all stacks at once as a graph: a stack node is a state over the node below it, equal
nodes are one, and stacks that share their lower part share its nodes. Before each turn
any stack may insert a turn; then the turn is kept, given another role or deleted. Stacks
with equal tops are merged by the smallest (cost, audit).

A conversation may be longer than a task should read. Turns are therefore sorted over
range partitions, which cut long conversations; a part that does not begin a
conversation is parsed from every stack that can be before it, and the parts are then
joined in order by their (entry, exit) costs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import discard, stored
from lumenlake.operators.ordering import skew_safe_lookup

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
# Added for a truncated turn that stays.
TRUNCATED_COST = 1
ROLES = {"u": "user", "a": "assistant"}
# Start symbol first; $ ends the input.
GRAMMAR = [("G", "C"), ("C", ""), ("C", "B"), ("C", "sB"), ("B", "Bua"), ("B", "ua")]
FOLLOW = {"G": "$", "C": "$", "B": "$u"}
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
# Bytes of repaired text that one row holds on its way to the digest of a conversation that was cut.
PIECE = 1 << 20


class Node(NamedTuple):
    """A stack of the graph: an LR state over the node below."""

    state: int
    below: int


class RoleParser:
    """SLR parser of the role grammar whose stacks are numbered nodes of one graph; node 0 is the empty stack."""

    def __init__(self, grammar: Sequence[tuple[str, str]] = tuple(GRAMMAR)):
        self.rules = list(grammar)
        self.states = [self._closure({(0, 0)})]
        self.moves: dict[tuple[int, str], int] = {}
        for number, items in enumerate(self.states):  # grows while it is read
            for symbol in sorted({self.rules[r][1][dot] for r, dot in items if dot < len(self.rules[r][1])}):
                after = self._closure({(r, dot + 1) for r, dot in items if self.rules[r][1][dot:dot + 1] == symbol})
                if after not in self.states:
                    self.states.append(after)
                self.moves[number, symbol] = self.states.index(after)
        self.nodes = [Node(0, -1)]
        self.numbers = {self.nodes[0]: 0}
        self.after: list[dict[str, int]] = []
        self.accepts: list[bool] = []
        for number in range(1 << 16):
            if number == len(self.nodes):
                break
            self.after.append({s: n for s in "sua" if (n := self._shift(number, s)) is not None})
            self.accepts.append(self._shift(number, "$") is not None)
        # Stacks that some roles lead to; the others only stand within a reduction.
        self.stacks = [0]
        for number in self.stacks:  # grows while it is read
            self.stacks.extend(n for n in dict.fromkeys(self.after[number].values()) if n not in self.stacks)

    def _closure(self, items: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        wait = list(items)
        while wait:
            rule, dot = wait.pop()
            nxt = self.rules[rule][1][dot:dot + 1]
            for new in ((i, 0) for i, (left, _) in enumerate(self.rules) if left == nxt):
                if new not in items:
                    items.add(new)
                    wait.append(new)
        return frozenset(items)

    def _node(self, state: int, below: int) -> int:
        node = Node(state, below)
        if node not in self.numbers:
            self.numbers[node] = len(self.nodes)
            self.nodes.append(node)
        return self.numbers[node]

    def _shift(self, number: int, symbol: str) -> int | None:
        """The stack after all reductions that `symbol` calls for and its shift; None if the roles cannot go on like this."""
        while True:
            state = self.nodes[number].state
            if (state, symbol) in self.moves:
                return self._complete(self._node(self.moves[state, symbol], number))
            done = [r for r, dot in self.states[state] if dot == len(self.rules[r][1]) and symbol in FOLLOW[self.rules[r][0]]]
            if not done:
                return None
            left, right = self.rules[done[0]]
            if left == "G":
                return number
            for _ in right:
                number = self.nodes[number].below
            number = self._node(self.moves[self.nodes[number].state, left], number)

    def _complete(self, number: int) -> int:
        """Reductions that need no next symbol are made at once, so that stacks stay short and alike."""
        while True:
            items = self.states[self.nodes[number].state]
            if len(items) != 1 or (item := next(iter(items)))[1] < len(self.rules[item[0]][1]):
                return number
            left, right = self.rules[item[0]]
            if left in ("C", "G"):
                return number
            for _ in right:
                number = self.nodes[number].below
            number = self._node(self.moves[self.nodes[number].state, left], number)

    def next_role(self, number: int) -> str:
        """The role that an inserted or reroled turn gets on this stack."""
        return next(s for s in "ua" if s in self.after[number])


PARSER = RoleParser()


class Part:
    """Cheapest edits of a run of turns from one stack to every stack.

    Live stacks are held as {stack: (cost, rank)}; the rank orders the audits so far.
    Those end with the turn just read, so none is the beginning of another, and a longer
    audit is ordered by the rank of its beginning first. Two bytes a turn and live stack
    are all that is kept to read the audits backwards.
    """

    def __init__(self, entry: int):
        self.live = {entry: (0, 0)}
        self.steps: list[bytes] = []

    def _inserted(self) -> dict[int, tuple[int, int, str, int]]:
        """Stacks with turns inserted after the last one read: {stack: (cost, rank, inserts, old stack)}."""
        found = {s: (cost, rank, "", s) for s, (cost, rank) in self.live.items()}
        wait = list(found)
        while wait:
            at = wait.pop()
            cost, rank, letters, old = found[at]
            for role in ROLES:
                to = PARSER.after[at].get(role)
                new = (cost + COST[INSERT], rank, letters + INSERT, old)
                if to is not None and (to not in found or new < found[to]):
                    found[to] = new
                    wait.append(to)
        return found

    def read(self, initial: str, must_go: bool, truncated: bool) -> None:
        """One more turn."""
        best: dict[int, tuple[int, int, str, int]] = {}
        extra = TRUNCATED_COST if truncated else 0
        for at, (cost, rank, letters, old) in self._inserted().items():
            edits = [(at, DELETE, COST[DELETE])]
            if not must_go:
                after = PARSER.after[at]
                edits += [(after[r], REROLE, COST[REROLE] + extra) for r in ROLES if r in after]
                if initial in after:
                    edits.append((after[initial], KEEP, COST[KEEP] + extra))
            for to, letter, more in edits:
                new = (cost + more, rank, letters + letter, old)
                if to not in best or new < best[to]:
                    best[to] = new
        order = {audit: i for i, audit in enumerate(sorted({v[1:3] for v in best.values()}))}
        self.live = {s: (v[0], order[v[1:3]]) for s, v in best.items()}
        step = bytearray(2 * len(PARSER.nodes))
        for s, (_, _, letters, old) in best.items():
            step[2 * s], step[2 * s + 1] = old, 4 * (len(letters) - 1) + "KRDI".index(letters[-1])
        self.steps.append(bytes(step))

    def audit(self, stack: int) -> str:
        """The edits that lead to a live stack."""
        out = []
        for step in reversed(self.steps):
            inserts, letter = divmod(step[2 * stack + 1], 4)
            out.append(INSERT * inserts + "KRDI"[letter])
            stack = step[2 * stack]
        return "".join(reversed(out))

    def exits(self, entry: int) -> list[dict]:
        return [{"entry": entry, "exit": s, "cost": cost, "audit": self.audit(s)} for s, (cost, _) in self.live.items()]


def closing(stack: int) -> list[int]:
    """Stacks passed by the fewest inserted turns that end the conversation well, the last one accepting."""
    path = [stack]
    while not PARSER.accepts[path[-1]]:
        path.append(PARSER.after[path[-1]][PARSER.next_role(path[-1])])
    return path


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) of `conversations` with planted faults, chosen by crc32 of `conv_id:turn` modulo 20.

    0 drops the turn, 1 empties its text, 2 takes the full stops, ! and ? out of it, 3
    repeats it, 4 makes its role `user`. Null roles, texts and (within the hashed string)
    ids and turns count as one space. Other columns are dropped.
    """
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col(conv_col).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), blank))
    text = F.coalesce(F.col(text_col).cast("string"), blank)
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                                F.coalesce(F.col(role_col).cast("string"), blank).alias("role"), text.alias("text"),
                                F.pmod(F.crc32(name), F.lit(20)).alias("kind")).where("kind <> 0")
    return rows.select(
        "conv", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def _placed(rows: DataFrame, scratch: list[str]) -> DataFrame:
    """The turns in order: `block` is a range partition, `seq` the place in it."""
    shown = F.rtrim(F.col("text"), F.lit(BLANKS))
    order: list[str | Column] = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("opening"), F.col("digest"), F.col("any")]
    return stored(
        rows.select("conv", "turn", "role", "text", F.substring("text", 1, 64).alias("opening"), F.md5("text").alias("digest"),
                    (shown == "").alias("blank"), (~F.substring(shown, -1, 1).isin(".", "!", "?")).alias("open_end"),
                    # Equal turns are one like the other; the number only lets the sort split many of them.
                    F.monotonically_increasing_id().alias("any"))
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .select("conv", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("seq"), "turn", "role", "text", "digest",
                "blank", "open_end"), scratch)


def _repeats(turns: DataFrame, scratch: list[str]) -> DataFrame:
    """(block, seq) of turns whose role and text were there before in their conversation."""
    # Joins need a key without nulls.
    narrow = turns.where("NOT blank").select(
        F.coalesce(F.concat(F.lit("#"), F.col("conv").cast("string")), F.lit("")).alias("name"), "role", "digest", "block", "seq")
    keys = ["name", "role", "digest"]
    several = stored(narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.min("seq").alias("first")).where("rows > 1"), scratch)
    # A row's number holds its partition in the high bits, so numbers follow the order of all turns.
    return skew_safe_lookup(narrow, several, keys, "seq", several, "rows").where("seq > first").select("block", "seq")


def _parts(conv_type: str) -> tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str]:
    """Counts and edits of each conversation's part in each block; rows come sorted by (block, seq), the mark of a repeat first."""
    schema = (f"conv {conv_type}, block int, blank long, duplicate long, truncated long, illegal long, first string, last string, "
              "low long, high long, turns long, exits array<struct<entry:int,exit:int,cost:long,audit:string>>")
    arrow = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, marked, out, conv_arrow = None, None, None, [], None

        def flush() -> Iterator[pa.RecordBatch]:
            columns = list(zip(*out))
            kinds = [conv_arrow, pa.int32(), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 3, arrow]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        def close() -> None:
            exits = [e for p, entry in zip(part["parses"], part["entries"]) for e in p.exits(entry)]
            out.append((*now, *part["counts"], part["first"], part["last"], part["low"], part["high"], part["turns"], exits))

        for batch in batches:
            conv_arrow = batch.column("conv").type
            columns = [batch.column(c).to_pylist() for c in ("conv", "block", "seq", "mark", "turn", "initial", "blank", "open_end")]
            for conv, block, seq, mark, turn, initial, blank, open_end in zip(*columns):
                if mark:
                    marked = (block, seq)
                    continue
                if part is None or (conv, block) != now:
                    if part is not None:
                        close()
                    # Only the first conversation of a block can have begun before it.
                    entries = PARSER.stacks if now is None or now[1] != block else [0]
                    now = (conv, block)
                    part = {"parses": [Part(e) for e in entries], "entries": entries, "counts": [0, 0, 0, 0], "first": initial,
                            "last": None, "low": None, "high": None, "turns": 0}
                again = not blank and marked == (block, seq)
                cut = not blank and not again and open_end
                counts = part["counts"]
                counts[0] += blank
                counts[1] += again
                counts[2] += cut
                counts[3] += part["last"] is not None and part["last"] + initial not in ("su", "ua", "au")
                if turn is not None and turn != part["high"]:
                    part["low"] = turn if part["low"] is None else part["low"]
                    part["high"] = turn
                    part["turns"] += 1
                part["last"] = initial
                for parse in part["parses"]:
                    parse.read(initial, blank or again, cut)
            if len(out) > 5000:
                yield from flush()
                out.clear()
        if part is not None:
            close()
        if out:
            yield from flush()

    return run, schema


def _join_parts(conv_type: str) -> tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str]:
    """Entry stack and audit of each part, and the sums of its conversation in the last one; rows come sorted by (conv, block)."""
    sums = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = f"conv {conv_type}, block int, parts int, entry int, edits string, {', '.join(f'{c} long' for c in sums)}, audit string"
    names = [c.split()[0] for c in schema.split(", ")]

    def chosen(parts: list[dict]) -> Iterator[tuple]:
        paths = {0: (0, "", ())}
        for p in parts:
            after: dict[int, tuple] = {}
            for e in p["exits"]:
                if e["entry"] in paths:
                    cost, audit, way = paths[e["entry"]]
                    new = (cost + e["cost"], audit + e["audit"], (*way, (e["entry"], e["audit"])))
                    if e["exit"] not in after or new[:2] < after[e["exit"]][:2]:
                        after[e["exit"]] = new
            paths = after
        cost, audit, way = min((cost + COST[INSERT] * (len(closing(s)) - 1), audit + INSERT * (len(closing(s)) - 1), way)
                               for s, (cost, audit, way) in paths.items())
        total = {c: sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
        total["illegal"] += sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(parts, parts[1:]))
        dated = [p for p in parts if p["low"] is not None]
        total["turns"] -= sum(a["high"] == b["low"] for a, b in zip(dated, dated[1:]))
        gaps = dated[-1]["high"] - dated[0]["low"] + 1 - total["turns"] if dated else 0
        used = 0
        for i, (p, (entry, edits)) in enumerate(zip(parts, way)):
            last = i == len(parts) - 1
            used += len(edits)
            mine = edits + audit[used:] if last else edits
            values = (gaps, *[total[c] for c in sums[1:5]], cost, audit) if last else (None,) * 7
            yield (p["conv"], p["block"], len(parts), entry, mine, *values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[dict] = []
        for batch in batches:
            out = []
            for p in batch.to_pylist():
                if parts and parts[-1]["conv"] != p["conv"]:
                    out.extend(chosen(parts))
                    parts = []
                parts.append(p)
            conv_arrow = batch.column("conv").type
            if out:
                yield _columns(out, conv_arrow, names)
        if parts:
            yield _columns(list(chosen(parts)), conv_arrow, names)

    def _columns(rows: list[tuple], conv_arrow: pa.DataType, names: list[str]) -> pa.RecordBatch:
        kinds = [conv_arrow, *[pa.int32()] * 3, pa.string(), *[pa.int64()] * 6, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run, schema


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, block, parts, edit, role, text) of every turn after repair; rows come sorted by (block, seq), a part's edits before its turns.

    A row without a role closes each part.
    """
    state: list = []

    def turn(letter: str, role: str | None, text: str) -> Iterator[tuple]:
        conv, block, parts, stack = state[0]
        if letter == DELETE:
            return
        initial = role[:1] if letter == KEEP else PARSER.next_role(stack)
        state[0] = (conv, block, parts, PARSER.after[stack][initial])
        yield conv, block, parts, letter, role if letter == KEEP else ROLES[initial], text

    def inserts() -> Iterator[tuple]:
        while state[2] < len(state[1]) and state[1][state[2]] == INSERT:
            state[2] += 1
            yield from turn(INSERT, None, "")

    def end() -> Iterator[tuple]:
        if state:
            yield from inserts()
            yield (*state[0][:3], None, None, None)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv", "block", "parts", "entry", "edits", "role", "text")]
        for conv, block, parts, entry, edits, role, text in zip(*columns):
            if edits is not None:
                yield from end()
                state[:] = [(conv, block, parts, entry), edits, 0]
            else:
                yield from inserts()
                letter = state[1][state[2]]
                state[2] += 1
                yield from turn(letter, role, text)
    yield from end()


def _turn_rows(conv_type: str) -> tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str]:
    """The repaired turns."""
    schema = f"conv {conv_type}, block int, place long, edit string, role string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[pa.DataType] = []

        def typed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                seen[:] = [batch.column("conv").type]
                yield batch

        out: list[tuple] = []
        for place, (conv, block, _, edit, role, text) in enumerate(_edited(typed())):
            if edit is not None:
                out.append((conv, block, place, edit, role, text))
            if len(out) == 5000:
                yield _rows_of(out, seen[0], schema)
                out = []
        if out:
            yield _rows_of(out, seen[0], schema)

    return run, schema


def _rows_of(rows: list[tuple], conv_arrow: pa.DataType, schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, conv_arrow if name == "conv" else kinds[kind])
                                       for c, (name, kind) in zip(zip(*rows), fields)], names=[f[0] for f in fields])


def _digests(conv_type: str) -> tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str]:
    """The digest of each conversation that lies in one block; of the others the repaired text in pieces."""
    schema = f"conv {conv_type}, block int, piece int, data binary, sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[pa.DataType] = []

        def typed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                seen[:] = [batch.column("conv").type]
                yield batch

        out: list[tuple] = []
        lines, size, piece, digest, first = [], 0, 0, hashlib.sha256(), True
        for conv, block, parts, edit, role, text in _edited(typed()):
            if edit is not None:
                # Every line carries the newline before it, so that pieces can be put together.
                line = f"\n{role}:{text}".encode()
                if parts == 1:
                    digest.update(line[1:] if first else line)
                    first = False
                else:
                    lines.append(line)
                    size += len(line)
                    if size > PIECE:
                        out.append((conv, block, piece, b"".join(lines), None))
                        lines, size, piece = [], 0, piece + 1
            else:
                out.append((conv, block, piece, b"".join(lines), digest.hexdigest() if parts == 1 else None))
                lines, size, piece, digest, first = [], 0, 0, hashlib.sha256(), True
            if len(out) > 1000 or sum(len(o[3]) for o in out[-1:]) > PIECE:
                yield _rows_of(out, seen[0], schema)
                out = []
        if out:
            yield _rows_of(out, seen[0], schema)

    return run, schema


def _whole_digests(conv_type: str) -> tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str]:
    """One digest per conversation; rows come sorted by (conv, block, piece)."""
    schema = f"conv {conv_type}, sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, first = None, None, True
        for batch in batches:
            out = []
            for conv, data, known in zip(*[batch.column(c).to_pylist() for c in ("conv", "data", "sha256")]):
                if digest is not None and conv != now:
                    out.append((now, digest.hexdigest()))
                    digest = None
                if known:
                    out.append((conv, known))
                    continue
                if digest is None:
                    now, digest, first = conv, hashlib.sha256(), True
                digest.update(data[1:] if first and data else data)
                first = first and not data
            if out:
                yield _rows_of(out, batch.column("conv").type, schema)
            conv_arrow = batch.column("conv").type
        if digest is not None:
            yield _rows_of([(now, digest.hexdigest())], conv_arrow, schema)

    return run, schema


class Repair(NamedTuple):
    """What a repair gives: sums per conversation, and the input of the last pass over the texts."""

    sums: DataFrame
    edits: DataFrame
    conv_type: str

    def turns(self) -> DataFrame:
        """(conv, block, place, edit, role, text) of every turn after repair; (block, place) is its order."""
        return self.edits.mapInArrow(*_turn_rows(self.conv_type))

    def digests(self) -> DataFrame:
        """(conv, sha256): SHA-256 of the repaired `role:text` lines, joined by newlines."""
        pieces = self.edits.mapInArrow(*_digests(self.conv_type))
        return pieces.repartition("conv").sortWithinPartitions("conv", "block", "piece").mapInArrow(*_whole_digests(self.conv_type))


def repair(rows: DataFrame) -> Repair:
    """Cheapest edits of each conversation of `rows` (conv, turn, role, text without null roles and texts).

    Turns count in the order of `turn`, nulls first; ties follow role, the first 64
    characters of the text and its MD5. `sums` has one row per conversation with `gaps`
    (turn numbers left out), the numbers of `blank`, `duplicate` and `truncated` turns (the
    first that holds counts), of `illegal` neighbouring roles, `cost` and `audit`: the edits
    of smallest cost, Keep, Rerole, Delete and Insert by their initials, of equal ones the
    ASCII-least. A null conversation id is one conversation. Repeated rows are duplicates.
    An audit and the digest of one conversation are a value of one row, so their length
    is bounded by what a row may hold; everything else of a long conversation is split.
    The tables that the results read stay in the shared checkpoint folder.
    """
    conv_type = rows.schema["conv"].dataType.simpleString()
    scratch: list[str] = []
    turns = _placed(rows, kept := [])
    marks = _repeats(turns, scratch).select(F.lit(None).cast(conv_type).alias("conv"), "block", "seq", F.lit(True).alias("mark"))
    narrow = turns.select("conv", "block", "seq", F.lit(False).alias("mark"), "turn", F.substring("role", 1, 1).alias("initial"), "blank", "open_end")
    marked = narrow.unionByName(marks, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "seq", F.col("mark").desc())
    parts = stored(marked.mapInArrow(*_parts(conv_type)), scratch)
    joined = stored(parts.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(*_join_parts(conv_type)), kept)
    sums = joined.where("audit IS NOT NULL").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    # The edits of a part go before its turns.
    starts = turns.groupBy("conv", "block").agg(F.min("seq").alias("seq"))
    heads = joined.select(F.struct("conv", "block").alias("part"), "parts", "entry", "edits").join(
        starts.select(F.struct("conv", "block").alias("part"), "seq"), "part").select("part.conv", "part.block", "seq", "parts", "entry", "edits")
    texts = turns.select("conv", "block", "seq", "role", "text").unionByName(heads, allowMissingColumns=True)
    edits = texts.repartition("block").sortWithinPartitions("block", "seq", F.col("edits").isNull())
    discard(rows.sparkSession, scratch)
    return Repair(sums, edits, conv_type)


def repair_damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Damages `conversations` and repairs them: one row per original `conv_id`, with the sums of `repair` and `repaired_sha256`.

    A conversation without a turn after the damage has zeros, an empty audit and the
    digest of nothing. An empty table gives an empty one; other columns are ignored.
    """
    done = repair(damage(conversations, conv_col, turn_col, role_col, text_col))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = conversations.select(F.col(conv_col).alias("conv")).distinct()
    rows = every.unionByName(done.sums, allowMissingColumns=True).unionByName(done.digests(), allowMissingColumns=True)
    return rows.groupBy(F.col("conv").alias("conv_id")).agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("sha256"), F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
