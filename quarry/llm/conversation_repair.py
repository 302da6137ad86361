"""Cheapest repair of a conversation's structure by Four-Russians block tables.

A repaired conversation's role initials are ``(s?(ua)+)?``.  Its automaton has four
states (0 nothing yet, 1 after s, 2 after u, 3 after ua), so the cost of the
rest of a conversation is a vector of four numbers.  Less its least number it is one
of a few dozen vectors.  For every block of ``BLOCK`` turn symbols and every such
vector right of the block, tables hold

* the vector left of the block and what was subtracted (the cost),
* the state right of the block for every state left of it, on the chosen path.

Conversations are processed from the end by one lookup a block.  The chosen edits are
then read from the front: each block is expanded backward from the vector at its right
end, and at every turn the ASCII-least edit that keeps the least cost is taken
(D < I < K < R), so ties are settled as the whole string would settle them.

Tables compose, so a conversation that spans several partitions (or more than
``STRETCH`` turns) is cut in stretches: each is summed up as one composed table, the few
summaries of a conversation give every stretch its vector at the right and its state at the
left, and stretches are then traced on their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACES, buckets_for, worker_state, write_table
from quarry.llm.conversations import BLOB, digest_in_order, range_sorted, turn_key

BLOCK = 4
STRETCH, STRETCH_CHARS = 4096, 8_000_000
#: Costs of the edits, and of keeping a turn that ends in mid-sentence.
REROLE, DELETE, INSERT, UNENDED = 2, 3, 2, 1
#: Symbols of a turn: 2 * (its initial's place in "sua", 3 for others) + (it is truncated), or one of these two.
GONE, PAD, SYMBOLS = 8, 9, 10
#: State after s, u, a in each state; the state after the only letter that may be inserted or written there, and its role.
_AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_NEXT = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")
_END = (0, 4, 2, 0)
_LEGAL = {"su", "ua", "au"}


def _left(symbol: int, right: tuple) -> tuple:
    """Costs of the rest in each state, from before a turn's symbol, given those after it."""
    if symbol == PAD:
        return right
    cost = []
    for q in range(4):
        best = DELETE + right[q]
        if symbol != GONE:
            kind, unended = "sua-"[symbol // 2], symbol % 2 * UNENDED
            best = min(best, REROLE + unended + right[_NEXT[q]], unended + right[_AFTER[q][kind]] if kind in _AFTER[q] else best)
        cost.append(best)
    for _ in range(3):  # inserted turns before it
        cost = [min(c, INSERT + cost[_NEXT[q]]) for q, c in enumerate(cost)]
    return tuple(cost)


def _edits(symbol: int, right: tuple, state: int) -> tuple[str, int]:
    """The ASCII-least cheapest edits from a state up to and with one turn, and the state after it."""
    cost, out = _left(symbol, right), ""
    while True:
        if cost[state] == DELETE + right[state]:
            return out + "D", state
        if cost[state] == INSERT + cost[_NEXT[state]]:
            out, state = out + "I", _NEXT[state]
            continue
        kind, unended = "sua-"[symbol // 2], symbol % 2 * UNENDED
        if kind in _AFTER[state] and cost[state] == unended + right[_AFTER[state][kind]]:
            return out + "K", _AFTER[state][kind]
        return out + "R", _NEXT[state]


class Tables:
    """``step``/``paid``/``after`` by symbol and vector, and the same by block of ``BLOCK`` symbols."""

    def __init__(self):
        self.vectors, ids = [_END], {_END: 0}
        step, paid = {}, {}
        for v in self.vectors:  # grows until no new vector appears
            for s in range(SYMBOLS):
                left = _left(s, v)
                low = min(left)
                left = tuple(c - low for c in left)
                if left not in ids:
                    ids[left] = len(self.vectors)
                    self.vectors.append(left)
                step[s, ids[v]], paid[s, ids[v]] = ids[left], low
        n = len(self.vectors)
        self.step = np.array([[step[s, v] for v in range(n)] for s in range(SYMBOLS)], np.int16)
        self.paid = np.array([[paid[s, v] for v in range(n)] for s in range(SYMBOLS)], np.int64)
        self.edits = {(s, v, q): _edits(s, r, q) for s in range(SYMBOLS - 1) for v, r in enumerate(self.vectors) for q in range(4)}
        after = np.array([[[q if s == PAD else self.edits[s, v, q][1] for q in range(4)] for v in range(n)] for s in range(SYMBOLS)], np.int8)
        # blocks, from their last symbol on: a block's number has its first symbol in the highest place
        self.block_step, self.block_paid, self.block_after = self.step, self.paid, after
        for _ in range(BLOCK - 1):
            m = len(self.block_step)
            self.block_paid = (self.block_paid[None] + self.paid[:, self.block_step]).reshape(-1, n)
            ahead = after[:, self.block_step]  # state after the new first symbol
            self.block_after = np.take_along_axis(np.broadcast_to(self.block_after, (SYMBOLS, m, n, 4)), ahead.astype(np.int64), 3).reshape(-1, n, 4)
            self.block_step = self.step[:, self.block_step].reshape(-1, n)

    def blocks(self, symbols: bytes) -> list[int]:
        padded = symbols + bytes([PAD]) * (-len(symbols) % BLOCK)
        digits = np.frombuffer(padded, np.uint8).reshape(-1, BLOCK).astype(np.int64)
        return (digits @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))).tolist()

    def summary(self, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
        """For every vector right of a stretch: the vector left of it, and the states right of it by the state left."""
        n = len(self.vectors)
        vector, state = np.arange(n), np.tile(np.arange(4, dtype=np.int8), (n, 1))
        for b in reversed(self.blocks(symbols)):
            state = np.take_along_axis(state, self.block_after[b][vector].astype(np.int64), 1)
            vector = self.block_step[b][vector]
        return vector, state

    def trace(self, symbols: bytes, right: int = 0, state: int = 0, ends: bool = True) -> tuple[int, list[str]]:
        """Cost of a stretch from vector ``right`` (numbered) up to its first turn, and the edits of each turn from ``state``;
        with ``ends`` also those after the last one."""
        blocks, at = self.blocks(symbols), [right]
        cost = 0
        for b in reversed(blocks):
            cost += int(self.block_paid[b, at[-1]])
            at.append(int(self.block_step[b, at[-1]]))
        cost += self.vectors[at[-1]][state]
        out = []
        for k in range(len(blocks)):
            part = symbols[k * BLOCK:(k + 1) * BLOCK]
            inside = [at[len(blocks) - 1 - k]]  # vectors right of each turn, from the last one back
            for s in part[:0:-1]:
                inside.append(int(self.step[s, inside[-1]]))
            for s, v in zip(part, reversed(inside)):
                edits, state = self.edits[s, v, state]
                out.append(edits)
        if ends:
            tail = ""
            while state in (1, 2):
                tail, state = tail + "I", _NEXT[state]
            out.append(tail)
        return cost, out


def tables() -> Tables:
    return worker_state("repair tables", Tables)


def paid(symbols: bytes, edits: list[str]) -> int:
    """What a stretch's edits cost."""
    every = "".join(edits)
    unended = sum(s % 2 for s, some in zip(symbols, edits) if some[-1:] != "D" and s < GONE)
    return DELETE * every.count("D") + INSERT * every.count("I") + REROLE * every.count("R") + UNENDED * unended


def apply_edits(edits: list[str], roles: list[str], texts: list[str], state: int = 0) -> tuple[list[str], list[str]]:
    """Roles and texts of the repaired turns."""
    out_roles, out_texts = [], []
    for i, some in enumerate(edits):
        for e in some:
            if e == "D":
                continue
            kept = e == "K"
            role = roles[i] if kept else _ROLE[state]
            out_roles.append(role)
            out_texts.append("" if e == "I" else texts[i])
            state = _AFTER[state][role[:1]] if kept else _NEXT[state]
    return out_roles, out_texts


# ---------------------------------------------------------------- stretches
_STRETCH = ("conv_id long, part int, stretch int, whole boolean, symbols binary, roles array<string>, texts array<string>, audit string, cost long, "
            "blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, "
            "low_turn long, high_turn long, turns long")
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), *[pa.int64()] * 5, pa.string(), pa.string(), *[pa.int64()] * 3]
_NAMES = [c.split()[0] for c in _STRETCH.split(", ")]


class _Stretch:
    """Turns of one conversation as they come in order."""

    def __init__(self, conv_id, number: int):
        self.conv_id, self.number = conv_id, number
        self.symbols, self.roles, self.texts, self.chars = bytearray(), [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None

    def add(self, turn, role: str, text: str, repeated: bool) -> None:
        last = text.rstrip(SPACES)[-1:]
        unended = False
        if not last:
            self.blank += 1
        elif repeated:
            self.duplicate += 1
        elif unended := last not in ".!?":
            self.truncated += 1
        if self.roles and self.roles[-1][:1] + role[:1] not in _LEGAL:
            self.illegal += 1
        at = "sua".find(role[0]) if role else -1
        self.symbols.append(GONE if not last or repeated else 2 * (at if at >= 0 else 3) + unended)
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)

    def row(self, part: int, whole: bool) -> tuple:
        roles, texts, audit, cost = self.roles, self.texts, None, None
        first, last = (roles[0][:1], roles[-1][:1]) if roles else (None, None)
        if whole:
            cost, edits = tables().trace(bytes(self.symbols))
            roles, texts = apply_edits(edits, roles, texts)
            audit = "".join(edits)
        return (self.conv_id, part, self.number, whole, bytes(self.symbols), roles, texts, audit, cost, self.blank, self.duplicate, self.truncated, self.illegal,
                first, last, self.low, self.high, self.turns)


def _stretches(batches: Iterator[pa.RecordBatch]):
    """Rows (conv_id, turn, key, kind, role, text) in order; kind 0: the conversation exists, 1: the next row repeats an earlier turn, 2: a turn."""
    part, rows, now, first, before, marked = TaskContext.get().partitionId(), [], None, True, None, None

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)

    for b in batches:
        for lo in range(0, b.num_rows, 1000):
            for conv_id, turn, key, kind, role, text in zip(*(c.to_pylist() for c in b.slice(lo, 1000).columns)):
                if now is None:
                    now = _Stretch(conv_id, 0)
                elif conv_id != now.conv_id:
                    # a partition's first and last conversation may go on in another one
                    rows.append(now.row(part, not first and now.number == 0))
                    now, first, before = _Stretch(conv_id, 0), False, None
                elif len(now.roles) >= STRETCH or now.chars >= STRETCH_CHARS:
                    rows.append(now.row(part, False))
                    now = _Stretch(conv_id, now.number + 1)
                if kind == 1:
                    marked = conv_id, turn, key
                elif kind == 2:
                    this = conv_id, turn, key
                    now.add(turn, role, text, this == before or this == marked)
                    before = this
            if sum(len(r[5]) for r in rows) > 4000:
                yield batch()
                rows.clear()
    if now is not None:
        rows.append(now.row(part, False))
    if rows:
        yield batch()


def _summaries(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        found = [tables().summary(s) for s in b.column("symbols").to_pylist()]
        rest = [n for n in b.schema.names if n != "symbols"]
        vectors, states = (pa.array([x[k].astype(t).tobytes() for x in found], pa.binary()) for k, t in enumerate(("<i2", "i1")))
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in rest), vectors, states], names=[*rest, "vectors", "states"])


def _settle(summaries: pa.Table) -> pa.Table:
    """Of one conversation's summaries: the vector right of every stretch, the state left of it, and what its border adds."""
    rows, vector = sorted(summaries.to_pylist(), key=lambda r: (r["part"], r["stretch"])), 0
    for r in reversed(rows):
        r["right"], vector = vector, int(np.frombuffer(r["vectors"], "<i2")[vector])
    state, initial, turn = 0, None, None
    for i, r in enumerate(rows):
        r["state"], r["ends"] = state, i == len(rows) - 1
        state = int(np.frombuffer(r["states"], "i1").reshape(-1, 4)[r["right"], state])
        r["more_illegal"] = r["less_turns"] = 0
        if r["first_initial"] is not None:
            r["more_illegal"] = int(initial is not None and initial + r["first_initial"] not in _LEGAL)
            initial = r["last_initial"]
        if r["low_turn"] is not None:
            r["less_turns"] = int(turn is not None and r["low_turn"] == turn)
            turn = r["high_turn"]
    return pa.Table.from_pylist([{n: r[n] for n in _SETTLED.names} for r in rows], _SETTLED)


_SETTLED = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("stretch", pa.int32()), ("right", pa.int32()), ("state", pa.int32()), ("ends", pa.bool_()),
                      ("more_illegal", pa.int64()), ("less_turns", pa.int64())])


def _traced(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        for lo in range(0, b.num_rows, 20):
            rows = b.slice(lo, 20).to_pylist()
            for r in rows:
                _, edits = tables().trace(r["symbols"], r["right"], r["state"], r["ends"])
                r["cost"], r["audit"] = paid(r["symbols"], edits), "".join(edits)
                r["roles"], r["texts"] = apply_edits(edits, r["roles"], r["texts"], r["state"])
                r["illegal"] += r["more_illegal"]
                r["turns"] -= r["less_turns"]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(_NAMES, _TYPES)], names=_NAMES)


# ---------------------------------------------------------------- the operator
def repair(rows: DataFrame) -> DataFrame:
    """Cheapest repair of conversations (conv_id, turn, role, text): a row per stretch of turns, written.

    Turns go by number (null first), those of one number by :func:`turn_key`.  A turn is blank
    (no character but white space), else duplicate (its role and text stood earlier in
    the conversation), else truncated (its last character but white space is not one of ``.!?``).
    A blank or duplicate turn must go.  Columns: conv_id, part, stretch (their order), whole (the one stretch
    of its conversation), roles and texts (repaired), audit (the edits' initials), cost, blank, duplicate,
    truncated, illegal (borders to the turn before included), low_turn, high_turn, turns (distinct numbers,
    those shared with the stretch before not counted again).

    A null role or text counts as empty; a null conv_id is a conversation of its own.  Rows whose column
    ``exists_only`` (if given) is true are no turns but keep their conversation in the result.  Other
    columns are not read.  An empty table gives no rows.  Memory is bounded by a stretch (``STRETCH`` turns or
    ``STRETCH_CHARS`` characters and one turn more); rows equal in all columns stand in one partition."""
    no_turn = F.coalesce(F.col("exists_only"), F.lit(False)) if "exists_only" in rows.columns else F.lit(False)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.when(~no_turn, F.col("turn")).cast("long").alias("turn"),
                       F.when(no_turn, 0).otherwise(2).alias("kind"), F.when(~no_turn, F.coalesce("role", F.lit(""))).alias("role"), F.when(~no_turn, F.coalesce("text", F.lit(""))).alias("text"))
    rows = rows.select("conv_id", "turn", turn_key(F.col("role"), F.col("text")).alias("key"), "kind", "role", "text")
    # a mark before every turn whose content has a smaller turn number in its conversation
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    narrow = rows.where("kind = 2").select("conv_id", "turn", "key")
    spread = narrow.groupBy("conv_id", "key").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select(
        F.col("conv_id").alias("__c"), F.col("key").alias("__k"), "first")
    later = narrow.join(spread, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("key") == F.col("__k"))).where(place > F.col("first"))
    marks = later.select("conv_id", "turn", "key", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    found = write_table(range_sorted(rows.unionByName(marks), ("conv_id", "turn", "key"), ("kind",), buckets_for(rows)).mapInArrow(_stretches, _STRETCH), "stretches")
    # conversations that reach a partition's border, or are long
    parts = found.where("NOT whole")
    summed = parts.select("conv_id", "part", "stretch", "symbols", "first_initial", "last_initial", "low_turn", "high_turn").mapInArrow(
        _summaries, "conv_id long, part int, stretch int, first_initial string, last_initial string, low_turn long, high_turn long, vectors binary, states binary")
    settled = summed.groupBy("conv_id").applyInArrow(_settle, "conv_id long, part int, stretch int, right int, state int, ends boolean, more_illegal long, less_turns long")
    settled = settled.select(F.col("conv_id").alias("__c"), F.col("part").alias("__p"), F.col("stretch").alias("__s"), "right", "state", "ends", "more_illegal", "less_turns")
    at = F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("part") == F.col("__p")) & (F.col("stretch") == F.col("__s"))
    traced = write_table(parts.join(settled, at).drop("__c", "__p", "__s").mapInArrow(_traced, _STRETCH), "traced")
    return found.where("whole").unionByName(traced).drop("symbols", "first_initial", "last_initial")


def _blobs(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        for lo in range(0, b.num_rows, 20):
            out = []
            for conv_id, part, stretch, roles, texts in zip(*(c.to_pylist() for c in b.slice(lo, 20).columns)):
                data = "\n".join([f"{r}:{t}" for r, t in zip(roles, texts)]).encode()
                out += [(conv_id, part, stretch, k // BLOB, data[k:k + BLOB]) for k in range(0, len(data), BLOB)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))],
                                                 names=["conv_id", "part", "stretch", "slice", "blob"])


def report(repaired: DataFrame) -> DataFrame:
    """A row per conversation of :func:`repair`: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    The digest is of the repaired turns as ``role:text``, joined by newlines.  Conversations of one stretch
    need no exchange."""
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    gaps = F.coalesce(F.col("high_turn") - F.col("low_turn") + 1 - F.col("turns"), F.lit(0))
    lines = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t))
    whole = repaired.where("whole").select("conv_id", gaps.alias("gaps"), *counts, "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
    rest = repaired.where("NOT whole")
    total = rest.groupBy("conv_id").agg(
        F.max("high_turn").alias("high_turn"), F.min("low_turn").alias("low_turn"), F.sum("turns").alias("turns"), *[F.sum(c).alias(c) for c in counts],
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "stretch", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    blobs = rest.select("conv_id", "part", "stretch", "roles", "texts").mapInArrow(_blobs, "conv_id long, part int, stretch int, slice int, blob binary")
    digests = digest_in_order(blobs, "conv_id", ("part", "stretch"), b"\n").withColumnRenamed("conv_id", "__c")
    total = total.join(digests, F.col("conv_id").eqNullSafe(F.col("__c")), "left").select(
        "conv_id", gaps.alias("gaps"), *counts, "audit", F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    return whole.unionByName(total)


def damage(rows: DataFrame) -> DataFrame:
    """Faults planted in conversations by the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes
    ``.!?`` out, 3 repeats it, 4 makes its role user.  Nulls become one blank; dropped rows come back as ``exists_only``."""
    blank = F.lit(" ")
    at = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    text = F.coalesce("text", blank)
    text = F.when(at == 1, "").when(at == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(at == 4, "user").otherwise(F.coalesce("role", blank))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (at == 0).alias("exists_only"),
                       F.explode(F.when(at == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
