"""Repair of conversations by lazy weighted determinisation of the grammar of roles.

What a suffix of a conversation costs from each state of the grammar is a vector of four numbers. Such vectors, less their minimum,
are the states of an automaton that reads rows from the last to the first; its transitions are worked out once each and kept in a
table, so that a row is a look-up. The costs known, a trace against that direction follows the arcs that keep to them and takes the
least letter of each, which gives the least audit of all cheapest ones.
"""

from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import shuffle_parts, written

#: What edits cost: a row deleted, its role changed, an empty row put in, a truncated row left.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: Rows and characters of a piece of a conversation.
PIECE_ROWS, PIECE_CHARS = 16_384, 4 << 20
_BLANK = " \t\n\x0b\x0c\r"
_ROLES = {"s": 0, "u": 1, "a": 2}
_NAMES = {2: "user", 3: "assistant"}
# States of s?(ua)+ or nothing: 0 at the start, 1 behind s, 2 behind u, 3 behind a. Where a kept role leads, and where a made one does.
_KEEP = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
_NEXT = (2, 2, 3, 2)
_FAR = 1 << 60


def _settled(v: list[int]) -> list[int]:
    """Costs with rows put in at this place where that is cheaper."""
    for _ in range(3):
        v = [min(v[q], INSERT + v[_NEXT[q]]) for q in range(4)]
    return [min(x, _FAR) for x in v]


#: What the end of a conversation costs.
END = _settled([0, _FAR, _FAR, 0])


def _before(v: list[int], symbol: int) -> list[int]:
    """Costs before a row, of those behind it. Symbol 0 must go; 1 + 2 * role + truncated may stay."""
    out = [DELETE + x for x in v]
    if symbol:
        role, cut = (symbol - 1) // 2, TRUNCATED * ((symbol - 1) % 2)
        for q in range(4):
            out[q] = min(out[q], REROLE + cut + v[_NEXT[q]])
            if (q, role) in _KEEP:
                out[q] = min(out[q], cut + v[_KEEP[q, role]])
    return _settled(out)


class Automaton:
    """States and transitions as far as rows have asked for them."""

    def __init__(self):
        self.vectors: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.table: dict[tuple[int, int], tuple[int, int]] = {}
        self.arcs: dict[tuple[int, int, int], tuple[str, int]] = {}

    def state(self, v) -> tuple[int, int]:
        """Number of the state of a vector, and the minimum that was taken from it."""
        low = min(v)
        key = tuple(x - low if x < _FAR else _FAR for x in v)
        if key not in self.number:
            self.number[key] = len(self.vectors)
            self.vectors.append(key)
        return self.number[key], low

    def scan(self, symbols, end: int) -> tuple[list[int], int]:
        """States from behind the last row to before the first, and the sum of what was taken from them."""
        table, states, total, at = self.table, [end], 0, end
        for symbol in reversed(symbols):
            found = table.get((at, symbol))
            if found is None:
                found = table[at, symbol] = self.state(_before(list(self.vectors[at]), symbol))
            at, low = found
            total += low
            states.append(at)
        return states, total

    def _arc(self, after: int, symbol: int, q: int) -> tuple[str, int]:
        """Least letters that keep to the costs from state q before a row to behind it."""
        w, letters = self.vectors[after], ""
        v = _before(list(w), symbol)
        while True:
            role, cut = (symbol - 1) // 2, TRUNCATED * ((symbol - 1) % 2)
            if v[q] == DELETE + w[q]:
                return letters + "D", q
            if v[q] == INSERT + v[_NEXT[q]]:
                letters, q = letters + "I", _NEXT[q]
            elif symbol and (q, role) in _KEEP and v[q] == cut + w[_KEEP[q, role]]:
                return letters + "K", _KEEP[q, role]
            else:
                return letters + "R", _NEXT[q]

    def trace(self, symbols, states: list[int], q: int) -> tuple[list[str], int]:
        """Letters per row from state q on; states are those of scan."""
        arcs, out, behind = self.arcs, [], len(states) - 2
        for i, symbol in enumerate(symbols):
            key = (states[behind - i], symbol, q)
            found = arcs.get(key)
            if found is None:
                found = arcs[key] = self._arc(*key)
            letters, q = found
            out.append(letters)
        return out, q


def _closing(q: int) -> str:
    """Rows put in behind the last one."""
    return {1: "II", 2: "I"}.get(q, "")


def _emit(letters: list[str], rows: list[tuple], q: int) -> list[tuple[str, str]]:
    """Role and text of the rows that an audit leaves, from state q on; letters beyond the rows are of rows put in."""
    out = []
    for own, row in itertools.zip_longest(letters, rows):
        for letter in own:
            if letter == "D":
                continue
            if letter == "K":
                q = _KEEP[q, _ROLES[row[1][:1]]]
                out.append((row[1], row[2]))
            else:
                q = _NEXT[q]
                out.append((_NAMES[q], "" if letter == "I" else row[2]))
    return out


def _faults(rows: list[tuple], repeated) -> tuple[bytearray, list[int]]:
    """Symbols of rows (turn, role, text), and how many are blank, duplicate, truncated and illegal beside their neighbour.

    repeated(place, row) tells whether a row's role and text were seen before.
    """
    symbols, counts, last = bytearray(), [0, 0, 0, 0], None
    for place, row in enumerate(rows):
        role, text = row[1], row[2].rstrip(_BLANK)
        first = role[:1]
        if last is not None and last + first not in ("su", "ua", "au"):
            counts[3] += 1
        last = first
        if not text:
            counts[0] += 1
            symbols.append(0)
        elif repeated(place, row):
            counts[1] += 1
            symbols.append(0)
        else:
            cut = text[-1] not in ".!?"
            counts[2] += cut
            symbols.append(1 + 2 * _ROLES.get(first, 3) + cut)
    return symbols, counts


def _seen():
    known = set()

    def repeated(_, row) -> bool:
        size = len(known)
        known.add(row[1:])
        return len(known) == size

    return repeated


def _gap(low, high, different: int) -> int:
    return 0 if low is None else min(high - low + 1 - different, (1 << 63) - 1)


def _text(rows: list[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in rows)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _whole(own: Automaton, rows: list[tuple]) -> tuple[list, list[tuple[str, str]]]:
    """gaps, blank, duplicate, truncated, illegal, cost and audit of a whole conversation, and its repaired rows."""
    symbols, counts = _faults(rows, _seen())
    end, low = own.state(END)
    states, total = own.scan(symbols, end)
    letters, q = own.trace(symbols, states, 0)
    letters.append(_closing(q))
    turns = {row[0] for row in rows if row[0] is not None}
    gaps = _gap(min(turns), max(turns), len(turns)) if turns else 0
    return [gaps, *counts, low + total + own.vectors[states[-1]][0], "".join(letters)], _emit(letters, rows, 0)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0 to 2) of each row, with nulls of role and text as one blank.

    The crc32 of `conv_id:turn` (a null id or turn: one blank) modulo 20 decides: 0 drops a row, 1 empties its text, 2 takes its
    sentence ends, 3 repeats it, 4 makes it the user's.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    text = told("text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), told("role").alias("role"), text.alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


_RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
_TYPES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_STAGE = f"conv_id long, part int, no int, turns array<long>, roles array<string>, texts array<string>, {_TYPES}, repaired_sha256 string"


def _arrow(spec: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in spec.split(", "))])


def _batches(rows, spec: str, size: int = 2_000, chars: int = PIECE_CHARS):
    """Tuples as record batches; the second of each pair says how many characters the tuple has."""
    schema, held, sum_ = _arrow(spec), [], 0
    for row, weight in rows:
        held.append(row)
        sum_ += weight
        if len(held) >= size or sum_ >= chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, sum_ = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _pieces(batches, with_rows: bool, piece_rows: int):
    """Sorted rows of a partition: finished conversations, and pieces of those that may go on in the partitions beside it or are
    longer than a piece."""
    own, part, number = Automaton(), TaskContext.get().partitionId(), itertools.count()
    none = [None] * (len(_RESULT) + 1)
    rows, chars, name, edge = [], 0, None, True

    def piece():
        return (name, part, next(number), [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], *none), chars

    def whole():
        values, left = _whole(own, rows)
        lists = ([r[0] for r in left], [r[1] for r in left]) if with_rows else (None, None)
        return (name, None, None, None, *lists, *values, _sha(_text(left))), len(values[-1]) + (chars if with_rows else 0)

    any_row = False
    for batch in batches:
        for conv, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns)):
            if any_row and conv != name:
                yield piece() if edge else whole()
                rows, chars, edge = [], 0, False
            any_row, name = True, conv
            for _ in range(copies):
                if len(rows) >= piece_rows or chars >= PIECE_CHARS:
                    yield piece()
                    rows, chars, edge = [], 0, True
                rows.append((turn, role, text))
                chars += len(text) + len(role)
    if any_row:
        yield piece()


_SUMMARY = "conv_id long, part int, no int, symbols binary, counts array<long>, turn_stats array<long>, initials array<string>, costs array<long>"


def _summaries(batches):
    """Of each piece: symbols, counts of faults, (first, last, different) turns, first and last initial, and the costs of 4 states
    before it for each of 4 states behind it."""
    own = Automaton()
    units = [own.state(_settled([0 if k == q else _FAR for k in range(4)])) for q in range(4)]
    for batch in batches:
        for conv, part, no, turns, roles, texts, firsts in zip(*(c.to_pylist() for c in batch.columns)):
            rows, new = list(zip(turns, roles, texts)), set(firsts or ())
            symbols, counts = _faults(rows, lambda place, _, new=new: place not in new)
            known = [t for t in turns if t is not None]
            stats = [known[0], known[-1], len(set(known))] if known else []
            costs = []
            for state, low in units:
                states, total = own.scan(symbols, state)
                costs += [min(_FAR, low + total + x) for x in own.vectors[states[-1]]]
            yield (conv, part, no, bytes(symbols), counts, stats, [roles[0][:1], roles[-1][:1]] if rows else [], costs), len(symbols)


_AFTER = "part int, no int, after array<long>"


def _behind(batches):
    """Pieces of conversations from the last to the first: what is behind each costs, from each state."""
    name, at = None, None
    for batch in batches:
        for conv, part, no, costs in zip(*(c.to_pylist() for c in batch.columns)):
            if at is None or conv != name:
                name, at = conv, END
            yield (part, no, at), 1
            at = [min(_FAR, *(at[k] + costs[4 * k + q] for k in range(4))) for q in range(4)]


_ENDS = f"conv_id long, first long, roles array<string>, texts array<string>, last boolean, {_TYPES}, repaired_sha256 string"


def _joined(batches, with_rows: bool):
    """Pieces of conversations in order: audits, digests and counts carried from piece to piece."""
    own, name, state = Automaton(), None, None

    def close(state):
        tail = _emit([_closing(state["q"])], [None], state["q"])
        state["audit"].append(_closing(state["q"]))
        for role, text in tail:
            state["digest"].update(((b"\n" if state["n"] else b"") + f"{role}:{text}".encode()))
            state["n"] += 1
        values = [_gap(state["low"], state["high"], state["different"]), *state["counts"], state["cost"], "".join(state["audit"])]
        return (name, state["n"] - len(tail), [r for r, _ in tail], [t for _, t in tail], True, *values, state["digest"].hexdigest()), len(values[-1])

    for batch in batches:
        for conv, roles, texts, turns, symbols, counts, stats, initials, after in zip(*(c.to_pylist() for c in batch.columns)):
            if state is not None and conv != name:
                yield close(state)
                state = None
            end, low = own.state(after)
            states, total = own.scan(symbols, end)
            if state is None:
                cost = low + total + own.vectors[states[-1]][0]
                name, state = conv, {"q": 0, "audit": [], "digest": hashlib.sha256(), "n": 0, "counts": [0, 0, 0, 0], "cost": cost, "low": None, "high": None, "different": 0, "initial": None}
            letters, q = own.trace(symbols, states, state["q"])
            left = _emit(letters, list(zip(turns, roles, texts)), state["q"])
            if left:
                state["digest"].update(((b"\n" if state["n"] else b"") + _text(left).encode()))
            if with_rows:
                yield (conv, state["n"], [r for r, _ in left], [t for _, t in left], False, *[None] * 8), sum(len(t) for t in texts)
            state["q"] = q
            state["n"] += len(left)
            state["audit"].append("".join(letters))
            state["counts"] = [a + b for a, b in zip(state["counts"], counts)]
            if initials:
                if state["initial"] is not None and state["initial"] + initials[0] not in ("su", "ua", "au"):
                    state["counts"][3] += 1
                state["initial"] = initials[1]
            if stats:
                state["different"] += stats[2] - (state["high"] == stats[0])
                state["low"], state["high"] = stats[0] if state["low"] is None else state["low"], stats[1]
    if state is not None:
        yield close(state)


def _mapped(df: DataFrame, run, spec: str, **options) -> DataFrame:
    return df.mapInArrow(lambda batches: _batches(run(batches, **options), spec), spec)


def _repair(conversations: DataFrame, with_rows: bool, piece_rows: int) -> tuple[DataFrame, DataFrame]:
    """Finished conversations of _pieces, and the ends of those in pieces."""
    order = ["conv_id", "turn", "role", "text"]
    rows = damaged(conversations)
    dealt = rows.repartitionByRange(shuffle_parts(conversations.sparkSession), *order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    stage = written(_mapped(dealt, _pieces, _STAGE, with_rows=with_rows, piece_rows=piece_rows), "conversations")
    done, open_ = stage.where("part IS NULL"), stage.where("part IS NOT NULL").select("conv_id", "part", "no", "turns", "roles", "texts")
    each = open_.select("conv_id", "part", "no", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "row"))
    digest = F.sha2(F.concat_ws("\x00", F.col("row.roles"), F.col("row.texts")).cast("binary"), 256)
    first = each.groupBy("conv_id", digest.alias("digest")).agg(F.min(F.struct("part", "no", "place")).alias("at"))
    firsts = first.groupBy("at.part", "at.no").agg(F.collect_list("at.place").cast("array<long>").alias("firsts"))  # the rows of a piece at most
    summary = written(_mapped(open_.join(firsts, ["part", "no"], "left").select("conv_id", "part", "no", "turns", "roles", "texts", "firsts"), _summaries, _SUMMARY), "conversation-pieces")
    backward = summary.select("conv_id", "part", "no", "costs").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("no"))
    after = _mapped(backward, _behind, _AFTER)
    pieces = open_.join(summary.drop("conv_id", "costs"), ["part", "no"]).join(after, ["part", "no"])
    forward = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no").select("conv_id", "roles", "texts", "turns", "symbols", "counts", "turn_stats", "initials", "after")
    return done, _mapped(forward, _joined, _ENDS, with_rows=with_rows)


def repair(conversations: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """A row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 after damaged().

    Rows are in the order of turn (nulls first); those of one turn in that of role and text, and copies follow one another. A null
    conv_id is a conversation of its own, a null role or text one blank, an empty role's initial nothing, which no grammar takes.
    A conversation without rows after the damage has zeros, an empty audit and the digest of nothing. Columns of other names
    aren't read. An empty table gives no rows. gaps beyond 63 bits count as the largest number.

    One shuffle deals rows out by ranges of their order, so that a conversation that holds a third of all rows is many tasks'. A task
    finishes the conversations that lie within it and are at most a piece; of the others (two a task, and long ones) it writes
    pieces, whose costs are matrices that a second pass strings together. The digest of a conversation is a chain over its bytes, so
    that its pieces then pass through one task in their order, one at a time in memory, with the audit, which is one cell.
    """
    done, ends = _repair(conversations, False, piece_rows)
    columns = ["conv_id", *_RESULT, "repaired_sha256"]
    return done.select(*columns).unionByName(ends.where("last").select(*columns))


def repaired_turns(conversations: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """The repaired conversations themselves: conv_id, place (from 0), role, text; those of repair() in the same order."""
    done, ends = _repair(conversations, True, piece_rows)

    def rows(df: DataFrame, first: Column) -> DataFrame:
        return df.select("conv_id", first.alias("first"), F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "row")).select("conv_id", (F.col("first") + F.col("at")).alias("place"), F.col("row.roles").alias("role"), F.col("row.texts").alias("text"))

    return rows(done, F.lit(0).cast("long")).unionByName(rows(ends, F.col("first")))
