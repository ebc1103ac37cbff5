"""Repairing the structure of conversations: cheapest edits that make their roles alternate.

The grammar's strings are an optional s and then ua, any number of times. Wagner-Fischer tables align a
conversation's turns with the targets of every length at once: without the s, each target is the end of one of two alternating
strings, so a table over the ends of both holds all of them, and a row's place before it is a target's first s. Cells
further off the diagonal than the incumbent cost allows (two a deleted turn, five an inserted one) are left out, as Ukkonen
does; a first narrow band gives the incumbent. Of all lengths that cost least, the backtraced audits are compared.

Turns are sorted by one range shuffle and come as blocks of at most BLOCK. A conversation inside one block is finished there. One
over several blocks, or at the edge of a partition, goes on by block: the costs from every state of the grammar
to every other, the least cost from each block's end on, the audits from every state, and last the states in order.
What one task holds of a conversation is a block, some numbers per block, and its audit, which is one value.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import table, written

BLOCK = 1024
DELETE, INSERT, REROLE, CUT_SHORT = 2, 5, 1, 5
FIRST_COST = 10  # the band tried first
NEVER = 1 << 40
#: States: nothing put out yet, after s, after a, after u. A conversation may end in the first or the third.
START, HEAD, EVEN, ODD = range(4)
ENDS = np.array([0, NEVER, 0, NEVER])
WANTED = {START: "u", HEAD: "u", EVEN: "u", ODD: "a"}
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
MARK = re.compile(r"[^\x20\x09-\x0D]")
BLANK, COPY, SHORT, FINE = range(4)


def faults(roles: list[str], texts: list[str], later: set[int] = frozenset()) -> list[int]:
    """Each turn's first fault; later are turns known to repeat one of an earlier block."""
    seen, out = set(), []
    for i, turn in enumerate(zip(roles, texts, strict=True)):
        end = turn[1].rstrip(" \t\n\v\f\r")[-1:]
        out.append(BLANK if not end else COPY if turn in seen or i in later else FINE if end in ".!?" else SHORT)
        seen.add(turn)
    return out


class Alignment:
    """Tables of a block's turns against all targets of a band. last: the block ends the conversation, so turns may be inserted after it."""

    def __init__(self, initials: list[str], kinds: list[int], last: bool):
        self.initials, self.n, self.last = initials, len(initials), last
        self.free = [k in (FINE, SHORT) for k in kinds]
        self.extra = [CUT_SHORT if k == SHORT else 0 for k in kinds]
        self.heads = [i for i in range(self.n) if self.free[i] and initials[i] == "s"]

    def fill(self, cost: int) -> None:
        """cells[i][x][k]: turns i.. against d letters of which the last is u (x = 0) or a (1), where k = d - (n - i) + cost // DELETE."""
        n, self.cost, self.down = self.n, cost, cost // DELETE
        width = self.down + cost // INSERT + 1
        k = np.arange(width)
        cells = np.full((n + 1, 2, width), NEVER)
        d = k - self.down
        cells[n] = np.where(d < 0, NEVER, d * INSERT if self.last else np.where(d > 0, NEVER, 0))
        ramp = k * INSERT
        ends_u = np.stack([k % 2 == 1, k % 2 == 0])  # by parity of k alone; the row's own parity turns it
        for i in range(n - 1, -1, -1):
            least = max(0, self.down - (n - i))  # the k of d = 0
            row = np.full((2, width), NEVER)
            row[:, :-1] = cells[i + 1][:, 1:] + DELETE
            if self.free[i]:
                wants_u = ends_u ^ bool((n - i - self.down) % 2)
                step = self.extra[i] + REROLE * (wants_u != (self.initials[i] == "u")) if self.initials[i] in ("u", "a") else self.extra[i] + REROLE
                met = cells[i + 1] + step
                if self.down >= n - i:
                    met[:, least] = NEVER
                np.minimum(row, met, out=row)
            row[:, :least] = NEVER
            cells[i] = np.minimum(np.minimum.accumulate(row - ramp, axis=1) + ramp, NEVER)
            cells[i][:, :least] = NEVER
        self.cells = cells

    def lengths(self, i: int, letter: str, x: int) -> tuple[np.ndarray, np.ndarray]:
        """Lengths above 0 of targets that begin with letter and end with u (x = 0) or a (1), and their costs from turn i on."""
        low = 1 if (letter == "u") == (x == 0) else 2
        d = np.arange(low, self.n - i + self.cost // INSERT + 1, 2)
        at = d - (self.n - i) + self.down
        return d[at >= 0], self.cells[i][x][at[at >= 0]]

    def choices(self, state: int):
        """(exit state, fixed start of the audit, turn, x, lengths, costs) of all targets from a state; no length: all the rest deleted."""
        n = self.n
        nothing = np.zeros(1, np.int64)
        yield state, "", 0, None, nothing, nothing + DELETE * n
        for x, out in ((0, ODD), (1, EVEN)):
            yield (out, "", 0, x, *self.lengths(0, WANTED[state], x))
        if state == START:
            for i in self.heads:
                before, paid = "D" * i + "K", DELETE * i + self.extra[i]
                yield HEAD, before, i + 1, None, nothing, nothing + paid + DELETE * (n - i - 1)
                for x, out in ((0, ODD), (1, EVEN)):
                    d, costs = self.lengths(i + 1, "u", x)
                    yield out, before, i + 1, x, d, costs + paid

    def matrix(self) -> np.ndarray:
        """Least costs from every state to every other."""
        cost = FIRST_COST
        most = DELETE * self.n + 2 * INSERT + CUT_SHORT
        while True:
            self.fill(cost)
            out = np.full((4, 4), NEVER)
            for state in range(4):
                for left, _, _, _, _, costs in self.choices(state):
                    if len(costs):
                        out[state, left] = min(out[state, left], costs.min())
            worst = max((int(x) for x in out[:, (ODD, EVEN)].ravel()), default=0)
            if cost >= most or worst <= cost:
                return out
            cost = min(most, max(worst, cost) if worst < NEVER else 4 * cost)

    def best(self, state: int, ahead: np.ndarray) -> tuple[int, str, int]:
        """Least cost from a state, with what comes after the block (ahead, by exit state), its audit and its exit state."""
        offset = int(ahead.min())
        most = DELETE * self.n + 2 * INSERT + CUT_SHORT
        cost = getattr(self, "cost", None)
        if cost is None:
            self.fill(cost := FIRST_COST)
        while True:
            found = [(int((costs + ahead[left]).min()), left, *rest, costs + ahead[left]) for left, *rest, costs in self.choices(state) if len(costs)]
            least = min(f[0] for f in found)
            if cost >= most or least - offset <= cost:
                break
            self.fill(cost := min(most, least - offset))
        ties = [(before + self.trace(i, x, int(d)), left) for total, left, before, i, x, ds, costs in found if total == least for d in ds[costs == least]]
        return least, *min(ties)

    def trace(self, i: int, x: int | None, d: int) -> str:
        """The least of the cheapest audits from turn i on against d letters: at each cell the first of D, I, K, R that costs no more."""
        if x is None:
            return "D" * (self.n - i)
        out, k, cells = [], d - (self.n - i) + self.down, self.cells
        while i < self.n or d:
            now = cells[i][x][k]
            if i < self.n and k + 1 < cells.shape[2] and cells[i + 1][x][k + 1] + DELETE == now:
                out.append("D")
                i, k = i + 1, k + 1
            elif d and k and cells[i][x][k - 1] + INSERT == now:
                out.append("I")
                d, k = d - 1, k - 1
            else:
                letter = "ua"[x] if d % 2 else "au"[x]
                out.append("K" if self.initials[i] == letter else "R")
                i, d = i + 1, d - 1
        return "".join(out)


def apply(audit: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str], int]:
    """Roles and texts that an audit leaves, and the state after it."""
    out, i = ([], []), 0
    for edit in audit:
        if edit != "D":
            letter = WANTED[state]
            head = edit == "K" and state == START and roles[i][:1] == "s"
            out[0].append(roles[i] if edit == "K" else ROLES[letter])
            out[1].append("" if edit == "I" else texts[i])
            state = HEAD if head else ODD if letter == "u" else EVEN
        i += edit != "I"
    return *out, state


class Summary:
    """What is told of a conversation, taken up block by block."""

    def __init__(self):
        self.low = self.high = None
        self.turns = self.illegal = self.cost = self.written = 0
        self.kinds, self.end, self.audits, self.digest = [0] * 4, None, [], hashlib.sha256()

    def add(self, turns, roles, kinds, audit: str, kept_roles, kept_texts) -> None:
        for t in turns:
            if t is not None and t != self.high:
                self.low = t if self.low is None else self.low
                self.high = t
                self.turns += 1
        for role, kind in zip(roles, kinds, strict=True):
            self.illegal += self.end is not None and self.end + role[:1] not in LEGAL
            self.end = role[:1]
            self.kinds[kind] += 1
        self.audits.append(audit)
        for role, text in zip(kept_roles, kept_texts, strict=True):
            self.digest.update((("\n" if self.written else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.written += 1

    def row(self, cost: int) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return gaps, *self.kinds[:3], self.illegal, cost, "".join(self.audits), self.digest.hexdigest()


TOLD = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TOLD_KINDS = [pa.int64()] * 6 + [pa.string()] * 2
_LISTS = "turns array<long>, roles array<string>, texts array<string>"
_LIST_KINDS = [pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]


def names_of(schema: str) -> list[str]:
    return re.findall(r"(\w+) (?:array<)?\w+>?(?:,|$)", schema)


def batch_of(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def values(batch: pa.RecordBatch) -> list[list]:
    return [batch.column(i).to_pylist() for i in range(batch.num_columns)]


def in_batches(rows, kinds, schema: str, size: int = 500):
    """Batches of an iterator of rows, at most size rows or some megabytes of text each."""
    names, held, chars = names_of(schema), [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(x) for c in row if isinstance(c, list) for x in c if isinstance(x, str))
        if len(held) >= size or chars > 4_000_000:
            yield batch_of(held, kinds, names)
            held, chars = [], 0
    if held:
        yield batch_of(held, kinds, names)


def whole(turns, roles, texts) -> tuple[tuple, tuple]:
    """The summary of a conversation held at once, and its turns after repair."""
    kinds = faults(roles, texts)
    cost, audit, _ = Alignment([r[:1] for r in roles], kinds, True).best(START, ENDS)
    kept = apply(audit, START, roles, texts)[:2]
    told = Summary()
    told.add(turns, roles, kinds, audit, *kept)
    return told.row(cost), ([*range(len(kept[0]))], *kept)


def sweep(id_kind, schema: str, block: int, with_turns: bool):
    """Finishes the conversations that lie inside a sorted partition; the others come out as blocks of turns (open)."""

    def rows(batches):
        part = TaskContext.get().partitionId()
        number, current, begun, split, held = part << 33, None, False, part > 0, ([], [], [])

        def out(closed: bool):
            nonlocal number, held
            number += 1
            lists, held = held, ([], [], [])
            if closed:
                told, after = whole(*lists)
                return current, number, False, *(after if with_turns else (None,) * 3), *told
            return current, number, True, *lists, *[None] * 8

        for batch in batches:
            for conv, turn, role, text, present in zip(*values(batch), strict=True):
                if not begun or conv != current:
                    if begun:
                        yield out(not split)
                        split = False
                    current, begun = conv, True
                if present:
                    if len(held[0]) == block:
                        split = True
                        yield out(False)
                    for x, y in zip(held, (turn, role, text), strict=True):
                        x.append(y)
        if begun:
            yield out(False)

    return lambda batches: in_batches(rows(batches), [id_kind, pa.int64(), pa.bool_(), *_LIST_KINDS, *_TOLD_KINDS], schema)


def swept(rows: DataFrame, block: int, with_turns: bool) -> DataFrame:
    kind = rows.schema["conv"].dataType
    order = ["conv", "turn", "role", "head", "hash", "scan"]
    keyed = rows.withColumns({"head": F.substring("text", 1, 256), "hash": F.md5(F.col("text").cast("binary")), "scan": F.monotonically_increasing_id()})
    ranged = keyed.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    schema = f"conv {kind.simpleString()}, block long, open boolean, {_LISTS}, {TOLD}"
    return ranged.select("conv", "turn", "role", "text", "present").mapInArrow(sweep(to_arrow_type(kind), schema, block, with_turns), schema)


def marked(blocks: DataFrame) -> DataFrame:
    """Open blocks with later: the places of turns that repeat one of their conversation; and last: no block of it follows."""
    turn = F.arrays_zip("roles", "texts")
    keys = F.transform(turn, lambda t: F.md5(F.to_json(F.struct(F.col("conv").cast("string").alias("conv"), t.roles.alias("role"), t.texts.alias("text"))).cast("binary")))
    items = blocks.select("block", F.posexplode(keys).alias("at", "key")).select("key", F.struct("block", "at").alias("place"))
    first = items.groupBy("key").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    later = items.join(first, "key").where("place <> first").groupBy("place.block").agg(F.collect_list("place.at").alias("later"))
    ends = blocks.groupBy("conv").agg(F.max("block").alias("block")).select("block", F.lit(True).alias("last"))
    return blocks.select("conv", "block", "turns", "roles", "texts").join(later, "block", "left").join(ends, "block", "left").withColumn("last", F.coalesce("last", F.lit(False)))


def aligned(roles, texts, later, last) -> tuple[Alignment, list[int]]:
    kinds = faults(roles, texts, set(later or ()))
    return Alignment([r[:1] for r in roles], kinds, last), kinds


def cost_matrices(batches):
    for batch in batches:
        rows = [(block, aligned(roles, texts, later, last)[0].matrix().ravel().tolist()) for block, roles, texts, later, last in zip(*values(batch), strict=True)]
        if rows:
            yield batch_of(rows, [pa.int64(), pa.list_(pa.int64())], ["block", "costs"])


def costs_ahead(batches):
    """Blocks of a partition, each conversation's from its last to its first: the least cost after each block by its exit state."""
    current, ahead = None, ENDS
    for batch in batches:
        rows = []
        for conv, block, last, costs in zip(*values(batch), strict=True):
            ahead = ENDS if last or conv != current else ahead
            current = conv
            rows.append((block, ahead.tolist()))
            ahead = np.minimum((np.array(costs).reshape(4, 4) + ahead).min(axis=1), NEVER)
        if rows:
            yield batch_of(rows, [pa.int64(), pa.list_(pa.int64())], ["block", "ahead"])


def block_audits(batches):
    """The best audit of a block from every state, with its cost to the end of the conversation and its exit state."""
    for batch in batches:
        rows = []
        for block, roles, texts, later, last, ahead in zip(*values(batch), strict=True):
            table_ = aligned(roles, texts, later, last)[0]
            found = [table_.best(state, np.array(ahead)) for state in range(4)]
            rows.append((block, [f[0] for f in found], [f[1] for f in found]))
        if rows:
            yield batch_of(rows, [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())], ["block", "costs", "audits"])


def joined_up(id_kind, schema: str, with_turns: bool):
    """Blocks of a partition in order, each conversation's from its first to its last: one row per conversation, or one per block with its turns."""

    def rows(batches):
        current, told, state, cost, begun, out_at = None, None, START, 0, False, 0
        for batch in batches:
            for conv, block, turns, roles, texts, later, costs, audits in zip(*values(batch), strict=True):
                if not begun or conv != current:
                    if begun and not with_turns:
                        yield current, 0, False, None, None, None, *told.row(cost)
                    current, told, state, cost, begun, out_at = conv, Summary(), START, costs[START], True, 0
                audit = audits[state]
                kept_roles, kept_texts, state = apply(audit, state, roles, texts)
                if with_turns:
                    yield conv, block, False, [*range(out_at, out_at + len(kept_roles))], kept_roles, kept_texts, *[None] * 6, audit, None
                    out_at += len(kept_roles)
                else:
                    told.add(turns, roles, faults(roles, texts, set(later or ())), audit, kept_roles, kept_texts)
        if begun and not with_turns:
            yield current, 0, False, None, None, None, *told.row(cost)

    return lambda batches: in_batches(rows(batches), [id_kind, pa.int64(), pa.bool_(), *_LIST_KINDS, *_TOLD_KINDS], schema)


def finished(first: DataFrame, with_turns: bool) -> DataFrame:
    """The rows of swept (a stored table) with those of its open blocks joined up."""
    blocks = written(marked(first.where("open")), "blocks")
    costs = blocks.select("block", "roles", "texts", "later", "last").mapInArrow(cost_matrices, "block long, costs array<long>")
    costs = blocks.select("conv", "block", "last").join(costs, "block").repartition("conv").sortWithinPartitions("conv", F.desc("block"))
    ahead = costs.select("conv", "block", "last", "costs").mapInArrow(costs_ahead, "block long, ahead array<long>")
    audits = blocks.join(ahead, "block").select("block", "roles", "texts", "later", "last", "ahead").mapInArrow(block_audits, "block long, costs array<long>, audits array<string>")
    ordered = blocks.join(audits, "block").repartition("conv").sortWithinPartitions("conv", "block")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in first.schema)
    rest = ordered.select("conv", "block", "turns", "roles", "texts", "later", "costs", "audits").mapInArrow(joined_up(to_arrow_type(first.schema["conv"].dataType), schema, with_turns), schema)
    return first.where("NOT open").unionByName(rest)


def turn_rows(conversations: DataFrame, present: Column | None, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    space = F.lit(" ")
    return conversations.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), space).alias("role"), F.coalesce(F.col(text_col), space).alias("text"), (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"))


def audited(conversations: DataFrame, present: Column | None = None, block: int = BLOCK, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    Turns come by turn (nulls first), then role, then the first 256 characters and the MD5 of the text. Null roles and texts
    are one space; a role without a first letter fits no place. Rows with a null id are one conversation.
    Where present is given, rows that are not present count for nothing but that the conversation exists; one without rows has
    zeros, no audit and the digest of nothing. An empty table gives no rows; other columns do not matter.
    """
    return finished(written(swept(turn_rows(conversations, present, id_col, turn_col, role_col, text_col), block, False), "swept"), False).select("conv", *names_of(TOLD))


def repaired(conversations: DataFrame, block: int = BLOCK, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The turns after repair: conv, turn (from 0), role, text. Conversations that lose all turns give no rows."""
    done = finished(written(swept(turn_rows(conversations, None, id_col, turn_col, role_col, text_col), block, True), "swept"), True)
    return done.select("conv", F.inline(F.arrays_zip("turns", "roles", "texts"))).toDF("conv", "turn", "role", "text")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by a digest of conversation and turn, to test repair: dropped ones stay as rows that are not present."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    text = F.when(kind == 0, "").when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1)))
    return conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), (kind != 0).alias("present"), copies.alias("copy"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations"))
    return audited(rows, F.col("present")).withColumnRenamed("conv", "conv_id")


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _edit(cost: str, letter: str, then: str) -> str:
    return f"{{'c': {cost} + {then}.c, 'a': '{letter}' || {then}.a}}"


def _moves(state: int) -> str:
    """From a state over the next turn: delete it, keep it, change its role."""
    after = {START: ODD, HEAD: ODD, EVEN: ODD, ODD: EVEN}[state]
    keep = f"CASE WHEN ini = '{WANTED[state]}' THEN {_edit('extra', 'K', f'v{after}')}" + (f" WHEN ini = 's' THEN {_edit('extra', 'K', f'v{HEAD}')}" if state == START else "") + " END"
    change = f"CASE WHEN ini <> '{WANTED[state]}' THEN {_edit(f'{REROLE} + extra', 'R', f'v{after}')} END"
    return f"CASE WHEN fit THEN list_min(list_filter([{_edit(str(DELETE), 'D', f'v{state}')}, {keep}, {change}], lambda x: x IS NOT NULL)) ELSE {_edit(str(DELETE), 'D', f'v{state}')} END AS r{state}"


def _inserted(state: int) -> str:
    """At most three turns put in before the next one."""
    options, at, text = [f"r{state}"], state, ""
    for n in range(1, 4):
        at, text = (ODD if WANTED[at] == "u" else EVEN), text + "I"
        options.append(_edit(str(n * INSERT), text, f"r{at}"))
    return f"{_least(*options)} AS v{state}"


_END = {START: "{'c': 0, 'a': ''}", HEAD: "{'c': 10, 'a': 'II'}", EVEN: "{'c': 0, 'a': ''}", ODD: "{'c': 5, 'a': 'I'}"}
_SIGN = "[^\\x20\\x09-\\x0D]"
ORACLE = f"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_prepend(4294967295, list_transform(split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: ord(x)::BIGINT)) AS bytes FROM conversations),
f AS (SELECT conv_id, turn, role, text, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) % 20 AS kind FROM k, t),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM f WHERE kind <> 0),
o AS (SELECT *, row_number() OVER w AS i, left(role, 1) AS ini, lag(left(role, 1)) OVER w AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, left(text, 256), md5(text), copy) AS seen FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 256), md5(text), copy)),
g AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{_SIGN}') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN regexp_extract(text, '({_SIGN})[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS fault FROM o),
h AS (SELECT conv_id, i, ini, CASE WHEN fault = 'truncated' THEN {CUT_SHORT} ELSE 0 END AS extra, fault IN ('fine', 'truncated') AS fit FROM g),
v AS (SELECT conv_id, count(*) AS i, {', '.join(f'{e} AS v{s}' for s, e in _END.items())} FROM h GROUP BY conv_id
    UNION ALL SELECT conv_id, i - 1, {', '.join(_inserted(s) for s in range(4))} FROM (SELECT v.conv_id, v.i, {', '.join(_moves(s) for s in range(4))} FROM v JOIN h ON h.conv_id IS NOT DISTINCT FROM v.conv_id AND h.i = v.i)),
b AS (SELECT conv_id, v0.c AS cost, v0.a AS audit FROM v WHERE i = 0),
e AS (SELECT conv_id, j, audit[j] AS edit, len(replace(audit[:j], 'I', '')) AS i, len(replace(audit[:j], 'D', '')) AS m FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS j FROM b)),
p AS (SELECT e.conv_id, j, m, edit, role, text, max(CASE WHEN m = 1 AND edit = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS head FROM e LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id AND g.i = e.i WHERE edit <> 'D'),
r AS (SELECT conv_id, string_agg((CASE WHEN edit = 'K' THEN role WHEN (m - head) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || (CASE WHEN edit = 'I' THEN '' ELSE text END), chr(10) ORDER BY j) AS whole FROM p GROUP BY conv_id),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM a.conv_id"""
