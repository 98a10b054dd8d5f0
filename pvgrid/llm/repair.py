"""Repair of a conversation's structure by the cheapest edits, found by a Viterbi search that emits as it goes.

A conversation's turns, in order, are edited until their roles' initials spell an optional ``s`` and then ``ua`` again
and again, or nothing. Keeping a turn costs nothing, giving it the role user or assistant 3, deleting it 4, putting in
an empty turn 3, and a truncated turn that isn't deleted 3 more; blank and repeated turns must be deleted. Of equally
cheap edits the ones whose initials (D, I, K, R) come first as text are taken.

The search keeps one survivor for each of four states (nothing yet, after s, after u, after a), the first two only as
long as they may still win. Survivors are tips of
a tree of edits with reference counts: a branch without survivors is freed, and the stem that all survivors share is
emitted. Survivors of equal cost are compared by their complete strings of edits; the order of the survivors' strings
is carried from step to step, so no string is read again. (Strings that reach one state by the same turns have different
costs if one starts with the other, so the order decided at a state is the order of the whole strings.)

Scale: turns are sorted by conversation and place over all tasks, so a conversation with a third of all turns is
spread over a third of them. A conversation that lies within one task and has at most ``BLOCK_ROWS`` turns is finished
there. All others leave as blocks: for each state a block may be entered in, its cheapest edits to each state it may be
left in. One task then chains a conversation's blocks as it did turns, and emits and forgets each block's turns when
the survivors agree on them; this part can't be split, as the digest of a conversation needs its turns in order. It
holds one block and those not agreed on; survivors that never agree hold all. Repeated turns are found by an
aggregation with one row for each repeated pair of role and text.

Defined cases: a null role or text is one space; an empty role or one of another initial fits nowhere. Turns without
number come first; equal numbers are ordered by role, then by SHA-256 of the text; rows equal in everything
are interchangeable. Turns with a null conversation are one conversation. A conversation whose turns are all deleted has the empty
text as repaired text. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pvgrid.llm.common import map_arrow, stage

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: A block has at most so many turns and characters of text, or one turn.
BLOCK_ROWS, BLOCK_CHARS = 1000, 1 << 20
#: Conversations of at most so many turns share results by the kinds of their turns.
SHORT = 12

START, S, U, A = range(4)
AFTER = {START: U, S: U, U: A, A: U}
STRICT = 1 << 40
_WHITE = " \t\n\x0b\x0c\r"


# -- survivors ---------------------------------------------------------------

class _Node:
    """Edits that follow their parent's; ``refs`` counts children and survivors."""

    __slots__ = ("parent", "edits", "what", "refs", "kids")

    def __init__(self, parent: _Node | None, edits: str, what: object) -> None:
        self.parent, self.edits, self.what, self.refs, self.kids = parent, edits, what, 0, []
        if parent:
            parent.refs += 1
            parent.kids.append(self)


def _release(node: _Node) -> None:
    """Give up a reference and free what nothing refers to any more."""
    node.refs -= 1
    while node.refs == 0 and node.parent:
        parent = node.parent
        parent.kids.remove(node)
        parent.refs -= 1
        node = parent


def _order(a: str, b: str) -> int:
    """Negative if ``a`` comes first. If one is the other and inserts, the size is their number, else ``STRICT``."""
    if a == b:
        return 0
    if b.startswith(a):
        return len(a) - len(b)
    if a.startswith(b):
        return len(a) - len(b)
    return -STRICT if a < b else STRICT


def _extend(order: int, s: str, t: str) -> int:
    """Order of P + s and Q + t, where ``order`` is that of P and Q."""
    if abs(order) == STRICT:
        return order
    return _order(s, "I" * -order + t) if order <= 0 else _order("I" * order + s, t)


class Survivors:
    """The cheapest edits to each state; ``settled`` gives those that all survivors share."""

    def __init__(self, entry: int = START) -> None:
        self.root = _Node(None, "", None)
        self.root.refs = 1
        self.cost: list[int | None] = [None] * 4
        self.tip: list[_Node | None] = [None] * 4
        self.cost[entry], self.tip[entry] = 0, self.root
        self.order = {(entry, entry): 0}

    def advance(self, moves: Iterable[tuple[int, int, str, int]], what: object = None) -> None:
        """One step; a move is (from, to, edits, cost), and every state that survives has a move."""
        best: list[tuple[int, int, str] | None] = [None] * 4
        for origin, to, edits, cost in moves:
            base = self.cost[origin]
            if base is None:
                continue
            cost += base
            now = best[to]
            if now is None or cost < now[0] or (
                    cost == now[0] and _extend(self.order[origin, now[1]], edits, now[2]) < 0):
                best[to] = (cost, origin, edits)
        # nothing kept yet, or only the system's turn: after a, the same edits do but for that turn's deletion
        for state, more in ((START, DELETE), (S, 0)):
            if best[A] and best[state] and best[state][0] > best[A][0] + more:
                best[state] = None
        old = [tip for tip in self.tip if tip]
        alive = [k for k in range(4) if best[k]]
        self.order = {(p, q): _extend(self.order[best[p][1], best[q][1]], best[p][2], best[q][2]) for p in alive for q in alive}
        tips: list[_Node | None] = [None] * 4
        for k in alive:
            cost, origin, edits = best[k]
            tips[k] = _Node(self.tip[origin], edits, what) if edits else self.tip[origin]
            tips[k].refs += 1
        self.cost = [b and b[0] for b in best]
        self.tip = tips
        for node in old:
            _release(node)

    def insert(self) -> None:
        """Let empty turns follow."""
        self.advance(INSERTS)

    def finish(self) -> int:
        """Give up all but the best whole conversation; its cost."""
        if self.cost[A] is not None and (self.cost[START] is None or (self.cost[A], self.order[A, START]) < (self.cost[START], 0)):
            last = A
        else:
            last = START
        cost = self.cost[last]
        self.advance([(last, last, "", 0)])
        return cost

    def settled(self) -> Iterator[tuple[str, object]]:
        """(edits, what they are made on) that all survivors share, and forget them."""
        while self.root.refs == 1 and self.root.kids:
            self.root = self.root.kids[0]
            self.root.parent = None
            yield self.root.edits, self.root.what

    def strings(self) -> list[str | None]:
        """Each survivor's edits since the last that were settled."""
        out: list[str | None] = []
        for tip in self.tip:
            parts = []
            while tip and tip.parent:
                parts.append(tip.edits)
                tip = tip.parent
            out.append("".join(reversed(parts)) if tip else None)
        return out


STAY = [(k, k, "", 0) for k in range(4)]
INSERTS = STAY + [(k, AFTER[k], "I", INSERT) for k in range(4)] + [(k, AFTER[AFTER[k]], "II", 2 * INSERT) for k in (START, S)]


def _kind(role: str, forced: bool, truncated: bool) -> str:
    """A letter for what may be done with a turn: its initial, capital if truncated, ``-`` if it must go."""
    if forced:
        return "-"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial.upper() if truncated else initial


def _moves(kind: str) -> list[tuple[int, int, str, int]]:
    moves = [(k, k, "D", DELETE) for k in range(4)]
    if kind == "-":
        return moves
    extra = TRUNCATED if kind.isupper() else 0
    moves += [(k, AFTER[k], "R", REROLE + extra) for k in range(4)]
    keep = {"s": [(START, S)], "u": [(START, U), (S, U), (A, U)], "a": [(U, A)], "o": []}[kind.lower()]
    return moves + [(k, to, "K", extra) for k, to in keep]


MOVES = {kind: _moves(kind) for kind in "suaoSUAO-"}


@lru_cache(1 << 16)
def _short(kinds: str) -> tuple[int, str]:
    """Cost and edits of a short conversation."""
    return _whole(kinds)


def _whole(kinds: str) -> tuple[int, str]:
    search = Survivors()
    search.insert()
    out = []
    for kind in kinds:
        search.advance(MOVES[kind])
        search.insert()
        out += [edits for edits, _ in search.settled()]
    cost = search.finish()
    return cost, "".join(out + [edits for edits, _ in search.settled()])


def cheapest(kinds: str) -> tuple[int, str]:
    """Cost and edits for turns of the given kinds."""
    return _short(kinds) if len(kinds) <= SHORT else _whole(kinds)


def block_moves(kinds: str, entries: Iterable[int]) -> list[tuple[int, int, str, int]]:
    """The cheapest edits of a block from each state to each, as moves."""
    moves = []
    for entry in entries:
        search, done = Survivors(entry), []
        for kind in kinds:
            search.advance(MOVES[kind])
            search.insert()
            done += [edits for edits, _ in search.settled()]
        done = "".join(done)
        moves += [(entry, to, done + rest, search.cost[to]) for to, rest in enumerate(search.strings()) if rest is not None]
    return moves


# -- what a conversation gives -----------------------------------------------

class _Counts:
    """Faults and turn numbers, joined in order."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.initial = None

    def add(self, turn: int | None, role: str, fault: str | None) -> None:
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        self.next_to(role)
        self.numbers(turn, turn, 0 if turn is None else 1)
        self.initial = role[:1]

    def next_to(self, role: str) -> None:
        self.illegal += self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au")

    def numbers(self, first: int | None, last: int | None, turns: int) -> None:
        if first is not None:
            self.turns += turns - (first == self.last)
            self.first, self.last = first if self.first is None else self.first, last

    def fields(self) -> list:
        return [self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.first, self.last]

    def join(self, fields: list, roles: list[str]) -> None:
        blank, duplicate, truncated, illegal, turns, first, last = fields
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        self.illegal += illegal
        self.next_to(roles[0])
        self.numbers(first, last, turns)
        self.initial = roles[-1][:1]

    def gaps(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1 - self.turns


class _Repaired:
    """Takes edits in order; gives the string of edits, the digest and, if asked, the repaired turns."""

    def __init__(self, listed: bool) -> None:
        self.audit, self.digest, self.state, self.n = bytearray(), hashlib.sha256(), START, 0
        self.listed = [] if listed else None

    def take(self, edits: str, rows: Iterable[tuple[str, str]]) -> None:
        self.audit += edits.encode()
        rows = iter(rows)
        for edit in edits:
            role, text = ("", "") if edit == "I" else next(rows)
            if edit == "D":
                continue
            if edit == "K":
                self.state = {"s": S, "u": U, "a": A}[role[:1]]
            else:
                self.state = AFTER[self.state]
                role = "user" if self.state == U else "assistant"
            self.digest.update((("\n" if self.n else "") + role + ":" + text).encode())
            if self.listed is not None:
                self.listed.append((self.n, edit, role, text))
            self.n += 1


def _schema(conv: T.DataType) -> T.StructType:
    long, text = T.LongType(), T.StringType()
    return T.StructType([
        T.StructField("conv", conv),
        T.StructField("summary", T.StructType([
            *(T.StructField(c, long) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
            T.StructField("audit", text), T.StructField("repaired_sha256", text)])),
        T.StructField("turn", T.StructType([T.StructField("place", long), T.StructField("edit", text), T.StructField("role", text),
                                            T.StructField("text", text)])),
        T.StructField("block", T.StructType([
            T.StructField("part", long), T.StructField("no", long), T.StructField("counts", T.ArrayType(long)),
            T.StructField("origins", T.ArrayType(long)), T.StructField("ends", T.ArrayType(long)),
            T.StructField("edits", T.ArrayType(text)), T.StructField("costs", T.ArrayType(long)),
            T.StructField("roles", T.ArrayType(text)), T.StructField("texts", T.ArrayType(text))]))])


class _Rows:
    """Rows of the schema above, given out in batches of bounded size."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, conv: object, size: int, **part: dict) -> None:
        self.rows.append({"conv": conv, **part})
        self.size += 200 + size

    def batches(self, all_left: bool = False) -> Iterator[pa.RecordBatch]:
        if self.rows and (all_left or self.size > 4 << 20):
            yield pa.RecordBatch.from_pylist(self.rows, schema=self.schema)
            self.rows, self.size = [], 0

    def conversation(self, conv: object, counts: _Counts, cost: int, repaired: _Repaired) -> None:
        self.turns(conv, repaired)
        self.add(conv, len(repaired.audit), summary={
            "gaps": counts.gaps(), "blank": counts.blank, "duplicate": counts.duplicate, "truncated": counts.truncated,
            "illegal": counts.illegal, "cost": cost, "audit": repaired.audit.decode(),
            "repaired_sha256": repaired.digest.hexdigest()})

    def turns(self, conv: object, repaired: _Repaired) -> None:
        for place, edit, role, text in repaired.listed or ():
            self.add(conv, len(text), turn={"place": place, "edit": edit, "role": role, "text": text})
        if repaired.listed:
            repaired.listed.clear()


def _scan(schema: T.StructType, listed: bool):
    """Sorted turns to finished conversations, and to blocks of those that may go on in another task or are long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(to_arrow_schema(schema))
        part, no = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        conv, chars, entries, none = None, 0, range(4), True

        def flush(ended: bool) -> None:
            nonlocal held, chars, entries, no
            counts, kinds = _Counts(), ""
            for turn, role, _, fault in held:
                counts.add(turn, role, fault)
                kinds += _kind(role, fault in ("blank", "duplicate"), fault == "truncated")
            if ended and entries is None:  # the whole conversation is here
                repaired = _Repaired(listed)
                cost, edits = cheapest(kinds)
                repaired.take(edits, ((role, text) for _, role, text, _ in held))
                out.conversation(conv, counts, cost, repaired)
            else:
                moves = block_moves(kinds, range(4))
                out.add(conv, chars + sum(len(m[2]) + 16 for m in moves), block={
                    "part": part, "no": no, "counts": counts.fields(), "origins": [m[0] for m in moves], "ends": [m[1] for m in moves],
                    "edits": [m[2] for m in moves], "costs": [m[3] for m in moves], "roles": [h[1] for h in held],
                    "texts": [h[2] for h in held]})
                no += 1
                entries = range(4)
            held, chars = [], 0

        for batch in batches:
            for name, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if none or name != conv:
                    if held:
                        flush(True)
                    # only the first conversation of a task may have begun in another
                    conv, entries, none = name, range(4) if none else None, False
                elif len(held) >= BLOCK_ROWS or chars + len(text) > BLOCK_CHARS:
                    flush(False)
                held.append((turn, role, text, fault))
                chars += len(text)
                yield from out.batches()
        if held:
            flush(False)
        yield from out.batches(True)

    return run


def _chain(schema: T.StructType, listed: bool):
    """A conversation's blocks, in order, to the finished conversation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(to_arrow_schema(schema))
        conv, counts, search, repaired = None, None, None, None

        def settle() -> None:
            for edits, block in search.settled():
                repaired.take(edits, zip(block["roles"], block["texts"]) if block else ())
            out.turns(conv, repaired)

        def finish() -> None:
            cost = search.finish()
            settle()
            out.conversation(conv, counts, cost, repaired)

        for batch in batches:
            for name, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if search is None or name != conv:
                    if search:
                        finish()
                    conv, counts, search, repaired = name, _Counts(), Survivors(), _Repaired(listed)
                    search.insert()
                counts.join(block["counts"], block["roles"])
                search.advance(zip(block["origins"], block["ends"], block["edits"], block["costs"]),
                               {"roles": block["roles"], "texts": block["texts"]})
                settle()
                yield from out.batches()
        if search:
            finish()
        yield from out.batches(True)

    return run


# -- on Spark ----------------------------------------------------------------

def find_faults(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, key, row, fault): a turn's first fault of blank, duplicate, truncated, or null."""
    text = F.coalesce(F.col(text_col), F.lit(" "))
    rows = stage(turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
                              F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), text.alias("text"), F.sha2(text, 256).alias("key"),
                              F.monotonically_increasing_id().alias("row")), "turns")
    seen = stage(rows.groupBy("conv", "role", "key").agg(F.count("*").alias("n"), F.min(F.struct("turn", "row")).alias("first"))
                 .where("n > 1").selectExpr("conv AS c", "role AS r", "key AS k", "first.row AS first_row"), "repeated-turns")
    bare = F.rtrim("text", F.lit(_WHITE))
    fault = (F.when(bare == "", "blank").when(F.col("row") != F.col("first_row"), "duplicate")
             .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated"))
    same = rows["conv"].eqNullSafe(seen["c"]) & (rows["role"] == seen["r"]) & (rows["key"] == seen["k"])
    return rows.join(seen, same, "left").select("conv", "turn", "role", "text", "key", "row", fault.alias("fault"))


def _repaired(turns: DataFrame, listed: bool, *columns: str) -> DataFrame:
    found = find_faults(turns, *columns)
    schema = _schema(found.schema["conv"].dataType)
    order = ["conv", "turn", "role", "key", "row"]
    parts = stage(map_arrow(found.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text", "fault"),
                            _scan(schema, listed), schema), "repaired")
    blocks = (parts.where("block IS NOT NULL").select("conv", "block").repartition("conv")
              .sortWithinPartitions("conv", "block.part", "block.no"))
    return parts.where("block IS NULL").select("conv", "summary", "turn").unionByName(
        map_arrow(blocks, _chain(schema, listed), schema).select("conv", "summary", "turn"))


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """One row per conversation: gaps, faults, illegal neighbours, cost, edits (``audit``) and digest of the repaired turns."""
    return (_repaired(turns, False, conv_col, turn_col, role_col, text_col).where("summary IS NOT NULL")
            .select(F.col("conv").alias(conv_col), "summary.*"))


def repaired_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """The turns of the repaired conversations: (conversation, place, edit, role, text)."""
    return (_repaired(turns, True, conv_col, turn_col, role_col, text_col).where("turn IS NOT NULL")
            .select(F.col("conv").alias(conv_col), "turn.*"))
