"""Conversation structure repair as a min-plus matrix product.

A repaired conversation's roles follow `(s?(ua)+)?`: maybe a system turn, then user and assistant in turn.  The pattern is an automaton of four states:
nothing yet, after s, after u, after a.  Each turn is a 4 x 4 matrix whose entry (i, j) is the cheapest way (cost, audit) to go from state i to state j
by keeping, reroling or deleting the turn, after any insertions (the insert closure).  Matrices are multiplied with minimum for sum and addition of
costs and concatenation of audits for product; equal costs go to the audit that is least in ASCII.  Two audits of one entry and one cost have equally many letters,
so neither is a prefix of the other, the order is kept by concatenation, and the product is associative: it may be taken as a tree, and in parts.

1. Rows are range-partitioned by conversation, turn, role and text and sorted, so a long conversation lies across several partitions.  Every partition is
   streamed.  A conversation that begins and ends inside one and holds at most HOLD bytes is repaired there, its matrices multiplied as a balanced tree.
2. All others go the long way: equal rows are counted first, so a row that stands a million times is one; earliest places of role and text tell duplicates;
   rows are range-partitioned again, each partition reduces its run of each conversation to one element, and elements are multiplied in rounds, FAN neighbouring
   partitions at a time, until one is left.  The audit is then read beside the rows in order, one after another, for the hash, which is a chain by nature; a task
   holds one audit and one row there, never a conversation's texts.

Faults: a row is blank without any character but space and 09-0D; else duplicate if its role and text stand earlier in the conversation; else truncated if its last such
character is none of `.!?`.  Keep costs 0, Rerole 3, Delete 4 and is required for blank and duplicate rows, Insert 3, and a truncated row that stays adds 3.

Cases: null roles and texts count as one space, a null conv_id is a conversation of its own, null turns come first; rows of one turn are in order of role, then text;
equal rows are duplicates after the first; a conversation without rows has zeros, an empty audit and the hash of the empty text; an empty table gives an empty result;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, ready

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after s, after u, after a.  Steps: from state, role, to state.
STEPS = ((0, "s", 1), (0, "u", 2), (1, "u", 2), (2, "a", 3), (3, "u", 2))
#: States in which a conversation may end.
FINAL = (0, 3)
#: Bytes of texts of one conversation that a task holds.
HOLD = 16 << 20
#: Neighbouring partitions whose elements are multiplied together in one round.
FAN = 16
BLANKS = " \t\n\x0b\x0c\r"
OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
NAMES = [x.split()[0] for x in OUT.split(", ")]

Entry = tuple[int, str] | None
Matrix = tuple[tuple[Entry, ...], ...]


def _least(entries: list[Entry]) -> Entry:
    return min((e for e in entries if e is not None), default=None)


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product; audits are put together only for the cheapest ways."""
    columns = list(zip(*b))
    out = []
    for row in a:
        line: list[Entry] = []
        for column in columns:
            ways = [(x[0] + y[0], x, y) for x, y in zip(row, column) if x is not None and y is not None]
            if not ways:
                line.append(None)
                continue
            cost = min(w[0] for w in ways)
            line.append((cost, min(x[1] + y[1] for c, x, y in ways if c == cost)))
        out.append(tuple(line))
    return tuple(out)


UNIT: Matrix = tuple(tuple((0, "") if i == j else None for j in range(4)) for i in range(4))


def _closure() -> Matrix:
    """Any number of insertions; a fourth can only come back to a state."""
    once = [[(0, "") if i == j else None for j in range(4)] for i in range(4)]
    for i, role, j in STEPS:
        if role != "s":
            once[i][j] = _least([once[i][j], (INSERT, "I")])
    once = tuple(map(tuple, once))
    return reduce(times, [once] * 3)


INSERTS = _closure()
#: What fault a row has: none, blank, duplicate, truncated.
SOUND, BLANK, DUPLICATE, CUT = range(4)


@lru_cache(maxsize=None)
def turn_matrix(initial: str, fault: int) -> Matrix:
    """Insert closure, then the turn itself; initial is s, u, a, or anything else for other roles."""
    own: list[list[Entry]] = [[(DELETE, "D") if i == j else None for j in range(4)] for i in range(4)]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT else 0
        for i, role, j in STEPS:
            ways = [own[i][j]]
            if role == initial:
                ways.append((KEEP + more, "K"))
            if role != "s":
                ways.append((REROLE + more, "R"))
            own[i][j] = _least(ways)
    return times(INSERTS, tuple(map(tuple, own)))


@lru_cache(maxsize=1 << 15)
def _short_product(kinds: tuple[tuple[str, int], ...]) -> Matrix:
    if len(kinds) == 1:
        return turn_matrix(*kinds[0])
    return times(_short_product(kinds[: len(kinds) // 2]), _short_product(kinds[len(kinds) // 2 :]))


def tree(matrices: list[Matrix]) -> Matrix:
    """The product of neighbouring pairs, then of pairs of those, and so on."""
    if not matrices:
        return UNIT
    while len(matrices) > 1:
        pairs = [times(a, b) for a, b in zip(matrices[::2], matrices[1::2])]
        matrices = pairs + matrices[len(pairs) * 2 :]
    return matrices[0]


def product(kinds: list[tuple[str, int]]) -> Matrix:
    """Product of the turns' matrices; products of eight neighbours are kept, as few kinds of them are common."""
    return tree([_short_product(tuple(kinds[i : i + 8])) for i in range(0, len(kinds), 8)])


def power(matrix: Matrix, n: int) -> Matrix:
    out = UNIT
    while n:
        if n & 1:
            out = times(out, matrix)
        matrix = times(matrix, matrix)
        n >>= 1
    return out


def cheapest(matrix: Matrix) -> tuple[int, str]:
    """Cost and audit of the whole conversation, insertions after its last turn included."""
    row = times(matrix[:1], INSERTS)[0]
    return _least([row[j] for j in FINAL])


@dataclass
class Element:
    """What is known of a run of a conversation's rows; elements of neighbouring runs add up."""

    rows: int
    faults: list[int]  # by fault
    illegal: int
    first: str
    last: str
    low: int | None
    high: int | None
    turns: int
    matrix: Matrix

    def __add__(self, other: Element) -> Element:
        if not self.rows or not other.rows:
            return self if self.rows else other
        border = int(self.last + other.first not in ("su", "ua", "au"))
        turns = self.turns + other.turns - int(self.high is not None and self.high == other.low)
        faults = [x + y for x, y in zip(self.faults, other.faults)]
        low, high = (self.low if self.low is not None else other.low), (other.high if other.high is not None else self.high)
        return Element(self.rows + other.rows, faults, self.illegal + other.illegal + border, self.first, other.last, low, high, turns, times(self.matrix, other.matrix))

    def summary(self) -> tuple[list[int], int, str]:
        """gaps, blank, duplicate, truncated, illegal; cost; audit."""
        cost, audit = cheapest(self.matrix)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [gaps, *self.faults[1:], self.illegal], cost, audit


def empty() -> Element:
    return Element(0, [0] * 4, 0, "", "", None, None, 0, UNIT)


def _kind(role: str, fault: int) -> tuple[str, int]:
    initial = role[:1]
    return initial if initial in ("s", "u", "a") else "", fault


def element(rows: list[tuple[int | None, str, int, int]]) -> Element:
    """Of rows (turn, role, fault, n) in order, each standing n times, all but the first of which are duplicates unless blank."""
    out = empty()
    faults, illegal, last, low, high, turns = [0] * 4, 0, None, None, None, 0
    matrices: list[Matrix] = []
    kinds: list[tuple[str, int]] = []
    for turn, role, fault, n in rows:
        kinds.append(_kind(role, fault))
        faults[fault] += 1
        initial = role[:1]
        if last is not None and last + initial not in ("su", "ua", "au"):
            illegal += 1
        if n > 1:
            again = BLANK if fault == BLANK else DUPLICATE
            faults[again] += n - 1
            illegal += n - 1  # a role is never followed by itself
            if n <= 8:
                kinds += [_kind(role, again)] * (n - 1)
            else:
                matrices += [product(kinds), power(turn_matrix(*_kind(role, again)), n - 1)]
                kinds = []
        last = initial
        if turn is not None:
            turns += turn != high
            low, high = (turn if low is None else low), turn
    if not rows:
        return out
    if kinds:
        matrices.append(product(kinds))
    return Element(sum(r[3] for r in rows), faults, illegal, rows[0][1][:1], last, low, high, turns, tree(matrices))


class Writer:
    """Hash of the repaired rows, which are given in order, by the audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place = audit, 0, 0
        self.offset = (len(audit) - audit.count("D")) % 2  # an odd number of turns is led by the system's
        self.hash = hashlib.sha256()

    def _line(self, role: str | None, text: str) -> None:
        if role is None:
            role = "assistant" if (self.place - self.offset) % 2 else "user"
        self.hash.update(("\n" * (self.place > 0) + role + ":" + text).encode())
        self.place += 1

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._line(None, "")
            self.at += 1

    def row(self, role: str, text: str, n: int = 1) -> None:
        for _ in range(n):
            self._inserted()
            edit = self.audit[self.at]
            self.at += 1
            if edit != "D":
                self._line(role if edit == "K" else None, text)

    def digest(self) -> str:
        self._inserted()
        return self.hash.hexdigest()


def damage_of(conv_id: Column, turn: Column) -> Column:
    key = F.concat(F.coalesce(conv_id.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    return F.crc32(key.cast("binary")) % 20


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: the rows with their damage, each standing n times; dropped rows stand 0 times, so that their conversation is known."""
    kind = F.col("damage")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        damage_of(F.col("conv_id"), F.col("turn")).alias("damage"),
    )
    text = F.when(kind < 2, F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 0, F.lit("")).when(kind == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv_id", F.when(kind != 0, F.col("turn")).alias("turn"), role.alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"))


def plain(conversations: DataFrame) -> DataFrame:
    """The same without damage."""
    nothing = F.lit(" ")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", nothing).alias("role"), F.coalesce("text", nothing).alias("text"), F.lit(1).cast("long").alias("n"))


def own_fault(text: str) -> int:
    """The fault that a text has by itself."""
    end = text.rstrip(BLANKS)
    return BLANK if not end else SOUND if end[-1] in ".!?" else CUT


ORDER = ["conv_id", "turn", "role", "text"]


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns])


def _held(batches: Iterator[pa.RecordBatch], hold: int) -> Iterator[tuple[int | None, list | None, bool]]:
    """(conv_id, its rows or None if they are too long to hold, whether it stands at an end of the partition) of each conversation of a sorted partition."""
    own, rows, size, first = None, None, 0, True
    begun = False
    for conv, turn, role, text, n in _runs(batches, [*ORDER, "n"]):
        if not begun or conv != own:
            if begun:
                yield own, rows, first
                first = False
            own, rows, size, begun = conv, [], 0, True
        if n and rows is not None:
            size += len(text) + len(role) + 64
            rows.append((turn, role, text, n))
            if size > hold:
                rows = None
    if begun:
        yield own, rows, True


def repair(rows: DataFrame, *, hold: int = HOLD) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation; rows: conv_id, turn, role, text, n."""
    ready(rows.sparkSession)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for conv, own, edge in _held(batches, hold):
            if own is None or edge:
                out.append({"conv_id": conv, "long": True})
            else:
                seen: set[tuple[str, str]] = set()
                known = []
                for turn, role, text, n in own:
                    fault = own_fault(text)
                    if fault != BLANK and (role, text) in seen:
                        fault = DUPLICATE
                    seen.add((role, text))
                    known.append((turn, role, fault, n))
                numbers, cost, audit = element(known).summary()
                writer = Writer(audit)
                for _, role, text, n in own:
                    writer.row(role, text, n)
                out.append(dict(zip(NAMES, [conv, *numbers, cost, audit, writer.digest()])) | {"long": False})
            if len(out) >= 1024:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = pa.schema([*[(n, pa.string() if n in NAMES[-2:] else pa.int64()) for n in NAMES], ("long", pa.bool_())])
    dealt = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    first = materialise(dealt.mapInArrow(whole, f"{OUT}, long boolean"), "conversations-whole")
    long = materialise(first.filter("long").select("conv_id").distinct(), "conversations-long")
    done = first.filter("NOT long").select(*NAMES)
    if long.isEmpty():
        return done
    left = rows.join(long.withColumnRenamed("conv_id", "long_id"), F.col("conv_id").eqNullSafe(F.col("long_id")), "left_semi")
    return done.unionByName(_long_way(materialise(left, "conversations-left")))


def _with_faults(rows: DataFrame) -> DataFrame:
    """Equal rows counted together, each with its fault."""
    rows = rows.groupBy(*ORDER).agg(F.sum("n").alias("n"))
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    digest = F.sha2(F.col("text").cast("binary"), 256)
    rows = materialise(rows.withColumn("digest", digest).withColumn("end", F.substring(end, -1, 1)), "conversations-counted")
    # Null turns come first, as in the order of the rows.
    first = F.min(F.struct("turn"))["turn"]
    earliest = rows.filter("n > 0 AND end <> ''").groupBy("conv_id", "role", "digest").agg(first.alias("earliest"), F.count(F.lit(1)).alias("places"))
    earliest = materialise(earliest.filter("places > 1").select(*[F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "digest")], "earliest"), "conversations-earliest")
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    again = F.col("_role").isNotNull() & ~F.col("turn").eqNullSafe(F.col("earliest"))
    fault = F.when(F.col("end") == "", BLANK).when(again, DUPLICATE).when(F.col("end").isin(".", "!", "?"), SOUND).otherwise(CUT)
    return rows.join(earliest, same, "left").select(*ORDER, "n", fault.cast("int").alias("fault"))


def _long_way(rows: DataFrame) -> DataFrame:
    rows = materialise(_with_faults(rows), "conversations-faults")
    part = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("payload", pa.binary())])
    PART = "conv_id long, part long, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        own, begun, held = None, False, []
        stack: list[tuple[int, Element]] = []  # elements of 2**level chunks, as a counter in binary

        def push() -> None:
            level, one = 0, element(held)
            held.clear()
            while stack and stack[-1][0] == level:
                one = stack.pop()[1] + one
                level += 1
            stack.append((level, one))

        def flush() -> pa.RecordBatch:
            push()
            total = reduce(Element.__add__, [e for _, e in stack])
            stack.clear()
            return pa.RecordBatch.from_pylist([{"conv_id": own, "part": at, "payload": pickle.dumps(total)}], schema=part)

        for conv, turn, role, fault, n in _runs(batches, ["conv_id", "turn", "role", "fault", "n"]):
            if begun and conv != own:
                yield flush()
            own, begun = conv, True
            if n:
                held.append((turn, role, fault, n))
                if len(held) >= 512:
                    push()
        if begun:
            yield flush()

    def multiply(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        total = reduce(Element.__add__, [pickle.loads(x) for x in table["payload"].to_pylist()])
        return pa.table({"conv_id": table["conv_id"][:1], "part": pa.array([table["part"][0].as_py() // FAN], pa.int64()), "payload": pa.array([pickle.dumps(total)], pa.binary())})

    ordered = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    parts = materialise(ordered.select("conv_id", "turn", "role", "fault", "n").mapInArrow(run, PART), "conversations-parts")
    while parts.groupBy("conv_id").count().filter("count > 1").limit(1).count():
        parts = materialise(parts.groupBy("conv_id", F.floor(F.col("part") / FAN).alias("_group")).applyInArrow(multiply, PART), "conversations-parts")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                numbers, cost, audit = pickle.loads(payload).summary()
                out.append(dict(zip(NAMES, [conv, *numbers, cost, audit])))
            yield pa.RecordBatch.from_pylist(out, schema=settled)

    settled = pa.schema([(n, pa.string() if n == "audit" else pa.int64()) for n in NAMES[:-1]])
    audits = materialise(parts.select("conv_id", "payload").mapInArrow(settle, OUT.rpartition(", ")[0]), "conversations-audits")

    # The audit stands before the rows of its conversation; texts are read one after another.
    nothing = F.lit(None)
    stream = audits.select("conv_id", F.lit(0).alias("side"), nothing.cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(1).cast("long").alias("n"))
    stream = stream.unionByName(rows.filter("n > 0").select("conv_id", F.lit(1).alias("side"), "turn", "role", "text", "n"))
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "side", *ORDER[1:])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, writer = None, None
        hashed = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
        for conv, side, role, text, n in _runs(batches, ["conv_id", "side", "role", "text", "n"]):
            if side == 0:
                if writer is not None:
                    yield pa.RecordBatch.from_pylist([{"conv_id": own, "repaired_sha256": writer.digest()}], schema=hashed)
                own, writer = conv, Writer(text)
            else:
                writer.row(role, text, n)
        if writer is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": own, "repaired_sha256": writer.digest()}], schema=hashed)

    hashes = stream.mapInArrow(write, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "_id")
    return audits.join(hashes, F.col("conv_id").eqNullSafe(F.col("_id"))).select(*NAMES)


def _more(entry: str, cost: str | int, letter: str) -> str:
    """SQL of an entry (ten digits of cost, then the audit) with one more edit."""
    return f"(lpad(CAST(CAST(substr({entry}, 1, 10) AS BIGINT) + {cost} AS VARCHAR), 10, '0') || substr({entry}, 11) || '{letter}')"


def _oracle_sql() -> str:
    closed2 = "least(v2, {}, {}, {})".format(*(_more(v, INSERT, "I") for v in ("v0", "v1", "v3")))

    def enter(states: list[str], initial: str) -> str:
        ways = [f"CASE WHEN r.initial = '{initial}' THEN {_more(c, f'({KEEP} + r.more)', 'K')} ELSE {_more(c, f'({REROLE} + r.more)', 'R') if initial != 's' else 'NULL'} END" for c in states]
        return f"CASE WHEN r.fault IN ({SOUND}, {CUT}) THEN least({', '.join(ways)}) END" if len(ways) > 1 else f"CASE WHEN r.fault IN ({SOUND}, {CUT}) THEN {ways[0]} END"

    crc = "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(k) + 1), lambda i: [CAST(ascii(substr(k, i, 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda c, v: xor(xor(c, v) >> 1, (xor(c, v) & 1) * 3988292384)))"
    return rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hit AS (SELECT *, {crc} % 20 AS damage FROM keyed),
hurt AS (SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN damage = 1 THEN '' WHEN damage = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN damage = 3 THEN 2 ELSE 1 END)) FROM hit WHERE damage <> 0)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS t FROM hurt),
judged AS (SELECT *, substr(role, 1, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ended,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY t) AS nth FROM placed),
faulty AS (SELECT *, CASE WHEN ended = '' THEN {BLANK} WHEN nth > 1 THEN {DUPLICATE} WHEN right(ended, 1) IN ('.', '!', '?') THEN {SOUND} ELSE {CUT} END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY t) AS before FROM judged),
rows_ AS (SELECT *, CASE WHEN fault = {CUT} THEN {TRUNCATED} ELSE 0 END AS more FROM faulty),
ids AS (SELECT DISTINCT conv_id FROM conversations),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS t, '0000000000' AS v0, CAST(NULL AS VARCHAR) AS v1, CAST(NULL AS VARCHAR) AS v2, CAST(NULL AS VARCHAR) AS v3 FROM ids
  UNION ALL
  SELECT conv_id, t, {_more('v0', DELETE, 'D')}, least({_more('v1', DELETE, 'D')}, s), least({_more('c2', DELETE, 'D')}, u), least({_more('c3', DELETE, 'D')}, a)
  FROM (SELECT w.conv_id, r.t, w.v0, w.v1, w.c2, w.c3, {enter(['w.v0'], 's')} AS s, {enter(['w.v0', 'w.v1', 'w.c3'], 'u')} AS u, {enter(['w.c2'], 'a')} AS a
    FROM (SELECT *, least(v3, {_more('c2', INSERT, 'I')}) AS c3 FROM (SELECT *, {closed2} AS c2 FROM walk)) w
    JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.t = w.t + 1)),
last AS (SELECT conv_id, least(v0, v3, {_more('v2', INSERT, 'I')}, {_more(_more('v0', INSERT, 'I'), INSERT, 'I')}, {_more(_more('v1', INSERT, 'I'), INSERT, 'I')}) AS best
  FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY t DESC) = 1),
cheap AS (SELECT conv_id, CAST(substr(best, 1, 10) AS BIGINT) AS cost, substr(best, 11) AS audit FROM last),
letters AS (SELECT conv_id, audit, i, substr(audit, i, 1) AS edit, length(replace(audit, 'D', '')) % 2 AS led,
    length(replace(substr(audit, 1, i), 'I', '')) AS t, length(replace(substr(audit, 1, i), 'D', '')) - 1 AS p FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS i FROM cheap)),
lines AS (SELECT l.conv_id, l.p, CASE WHEN edit = 'K' THEN r.role WHEN (p - led) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE r.text END AS line
  FROM letters l LEFT JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.t = l.t WHERE edit <> 'D'),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY p) AS whole FROM lines GROUP BY conv_id),
per AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
    count(*) FILTER (WHERE fault = {BLANK}) AS blank, count(*) FILTER (WHERE fault = {DUPLICATE}) AS duplicate, count(*) FILTER (WHERE fault = {CUT}) AS truncated,
    count(*) FILTER (WHERE t > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM ids i LEFT JOIN per ON per.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN cheap ON cheap.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM i.conv_id
"""


ORACLE_SQL = _oracle_sql()
