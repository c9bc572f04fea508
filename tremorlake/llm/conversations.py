"""Conversation structure repair by weighted CYK parsing over spans of turns.

A repaired conversation reads ``(s?(ua)+)?`` by the initials of its roles. The repair grammar is in Chomsky normal form: its
symbols are pairs of places (p, q) in that pattern, its binary rules are (p, q) -> (p, r) (r, q), and its terminals are
single edits of a row, closed under insertions before and after it. A cell of a span holds, for each symbol, the
least (cost, audit). Of equal cost no audit is a prefix of another, so least parts make a least whole; and as every split of a
span passes some place r, all splits give the same cell. So spans are joined in pairs, bottom-up by
their length, and a long conversation's blocks are parsed in many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tremorlake.llm.common import written

#: Rows and characters of one block of a conversation.
BLOCK_ROWS = 4096
BLOCK_CHARS = 4_000_000
#: Spans of up to so many rows are kept by their kinds.
KEPT_SPAN = 8
SPACE = " \t\n\x0b\x0c\r"

# Places of the pattern are 0 start, 1 after the system turn, 2 after a user turn, 3 after an assistant turn.
STEPS = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}
ENDS = (0, 3)
# Costs of the edits.
KEEP, REROLE, INSERT, DELETE, LATE = 0, 2, 2, 3, 1

Cell = dict[tuple[int, int], tuple[int, str]]


def join(left: Cell, right: Cell) -> Cell:
    """The cell of two adjoining spans: for each symbol the least (cost, audit) over the places where they meet."""
    out: Cell = {}
    for (p, r), (c, a) in left.items():
        for (r2, q), (c2, a2) in right.items():
            if r == r2:
                old = out.get((p, q))
                if old is None or c + c2 < old[0] or (c + c2 == old[0] and a + a2 < old[1]):
                    out[p, q] = (c + c2, a + a2)
    return out


def _insertions() -> Cell:
    """The cell of no row: insertions only, none included."""
    cell: Cell = {(p, p): (0, "") for p in range(4)}
    one: Cell = cell | {step: (INSERT, "I") for x in "ua" for step in STEPS[x]}
    while (more := join(cell, one)) != cell:
        cell = more
    return cell


NOTHING = _insertions()


@lru_cache(4096)
def leaf(initial: str, late: bool, forced: int) -> Cell:
    """The cell of one row, or of ``forced`` equal rows in turn that must be deleted."""
    edit: Cell = {(p, p): (DELETE * max(1, forced), "D" * max(1, forced)) for p in range(4)}
    if not forced:
        for x in "ua":
            edit |= {step: (REROLE + LATE * late, "R") for step in STEPS[x]}
        edit |= {step: (KEEP + LATE * late, "K") for step in STEPS.get(initial, ())}
    return join(join(NOTHING, edit), NOTHING)


Kind = tuple[str, bool, int]


def span(kinds: tuple[Kind, ...]) -> Cell:
    """The cell of a span of rows: spans of equal length are joined in pairs until one is left."""
    if not kinds:
        return NOTHING
    cells = [_short(kinds[i : i + KEPT_SPAN]) for i in range(0, len(kinds), KEPT_SPAN)]
    while len(cells) > 1:
        cells = [join(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


@lru_cache(100_000)
def _short(kinds: tuple[Kind, ...]) -> Cell:
    return leaf(*kinds[0]) if len(kinds) == 1 else join(_short(kinds[: len(kinds) // 2]), _short(kinds[len(kinds) // 2 :]))


def best(cell: Cell) -> tuple[int, str]:
    return min(cell[0, q] for q in ENDS if (0, q) in cell)


class Spans:
    """Cells of blocks in turn, joined whenever the last two are of equally many blocks."""

    def __init__(self):
        self.stack: list[tuple[int, Cell]] = []

    def add(self, cell: Cell) -> None:
        n = 1
        while self.stack and self.stack[-1][0] == n:
            n, cell = 2 * n, join(self.stack.pop()[1], cell)
        self.stack.append((n, cell))

    def whole(self) -> Cell:
        cell = NOTHING
        for _, left in reversed(self.stack):
            cell = join(left, cell)
        return cell


def kinds_of(row: dict) -> list[Kind]:
    """What the grammar knows of a row and its copies: those beyond the first repeat it and must go."""
    if row["fault"] in ("blank", "duplicate"):
        return [("", False, row["copies"])]
    first = (row["initial"] if row["initial"] in STEPS else "", row["fault"] == "truncated", 0)
    return [first, *([("", False, row["copies"] - 1)] if row["copies"] > 1 else [])]


class Tally:
    """Counts of a conversation's faults over its rows in order."""

    def __init__(self):
        self.n = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.first = self.last = self.before = None
        self.turns = 0

    def add(self, row: dict) -> None:
        copies, fault, initial = row["copies"], row["fault"], row["initial"]
        if fault in ("blank", "duplicate"):
            self.n[fault] += copies
        else:
            self.n["duplicate"] += copies - 1
            self.n["truncated"] += fault == "truncated"
        # copies stand side by side, and no initial may follow itself
        self.n["illegal"] += copies - 1 + (self.before is not None and self.before + initial not in ("su", "ua", "au"))
        self.before = initial
        if (turn := row["turn"]) is not None:
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn

    def counts(self) -> dict:
        return {"gaps": 0 if self.first is None else self.last - self.first + 1 - self.turns} | self.n


class Repair:
    """Applies an audit to rows in order and gives the repaired turns."""

    def __init__(self, audit: str):
        self.audit, self.at, self.next = audit, 0, "u"

    def _turn(self, role: str, text: str, edit: str) -> tuple[str, str, str]:
        self.next = "a" if role[:1] == "u" else "u"
        return role, text, edit

    def _own(self) -> str:
        return "user" if self.next == "u" else "assistant"

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._turn(self._own(), "", "I")

    def row(self, row: dict) -> Iterator[tuple[str, str, str]]:
        for _ in range(row["copies"]):
            yield from self.inserted()
            edit = self.audit[self.at]
            self.at += 1
            if edit != "D":
                yield self._turn(row["role"] if edit == "K" else self._own(), row["text"], edit)


class Digest:
    """SHA-256 of the repaired turns as lines ``role:text``."""

    def __init__(self):
        self.sha, self.some = hashlib.sha256(), False

    def add(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.some else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.some = True


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
ROW = "struct<turn:bigint,role:string,text:string,initial:string,fault:string,copies:bigint>"
TURNS = "position long, role string, text string, edit string"


def _result(tally: Tally, cost: int, audit: str, digest: Digest) -> dict:
    return tally.counts() | {"cost": cost, "audit": audit, "repaired_sha256": digest.sha.hexdigest()}


def _batches(rows: Iterator[dict], schema: pa.Schema, weight) -> Iterator[pa.RecordBatch]:
    """Record batches of rows, each of bounded size."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 200 + weight(r)
        if size > BLOCK_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for at in range(0, b.num_rows, 512):
            yield from b.slice(at, 512).to_pylist()


def _groups(rows: Iterator[dict]) -> Iterator[tuple[bool, list[dict], bool]]:
    """Blocks of rows of one conversation: (it began here, rows, it ended here). A conversation that began before this
    part's first row, or may go on after its last, is open at that side."""
    held: list[dict] = []
    size, opened = 0, False
    for r in rows:
        new = bool(held) and held[0]["conv"] != r["conv"]
        if new or len(held) >= BLOCK_ROWS or size > BLOCK_CHARS:
            yield opened, held, new
            opened, held, size = new, [], 0
        held.append(r)
        size += len(r["text"])
    if held:
        yield opened, held, False


def prepared(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows (conv, turn, role, text, initial, fault, copies): equal rows are one with their number, and faults are told.

    A row is a duplicate if its role and text have an earlier turn in the conversation; that turn comes from counts by hash,
    so that texts do not meet in a window."""
    space = F.lit(" ")
    rows = df.select(df[conv_col].alias("conv"), df[turn_col].cast("long").alias("turn"), F.coalesce(df[role_col].cast("string"), space).alias("role"), F.coalesce(df[text_col].cast("string"), space).alias("text"))
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("hash", F.md5("text"))
    again = rows.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("hash").alias("h")).agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = rows.join(again, rows.conv.eqNullSafe(again.c) & (rows.role == again.r) & (rows.hash == again.h), "left")
    tail = F.rtrim("text", F.lit(SPACE))
    fault = F.when(tail == "", "blank").when(F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn")), "duplicate").when(~F.substring(tail, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    return rows.select("conv", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "copies")


def _parsed(df: DataFrame, keep_turns: bool) -> DataFrame:
    """One row for each conversation that lies in one sorted part, with its result; blocks with their cells and rows of the others."""
    kind = df.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, part int, seq int, {RESULT}, turns array<struct<role:string,text:string,edit:string>>, cell string, rows array<{ROW}>"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def found() -> Iterator[dict]:
            for seq, (began, rows, ended) in enumerate(_groups(_rows(batches))):
                cell = span(tuple(k for r in rows for k in kinds_of(r)))
                base = {"conv": rows[0]["conv"], "part": part, "seq": seq}
                if not (began and ended):
                    yield base | {"cell": _text(cell), "rows": [{k: r[k] for k in ("turn", "role", "text", "initial", "fault", "copies")} for r in rows]}
                    continue
                tally, digest, (cost, audit) = Tally(), Digest(), best(cell)
                repair, turns = Repair(audit), []
                for r in rows:
                    tally.add(r)
                    turns += repair.row(r)
                turns += repair.inserted()
                for role, text, _ in turns:
                    digest.add(role, text)
                yield base | _result(tally, cost, audit, digest) | ({"turns": [dict(zip(("role", "text", "edit"), t, strict=True)) for t in turns]} if keep_turns else {})

        yield from _batches(found(), arrow, lambda r: sum(len(x["text"]) for x in (r.get("rows") or r.get("turns") or ())) + len(r.get("cell") or r.get("audit") or ""))

    key = [F.col("conv"), F.col("turn"), F.col("role")]
    # a sort of all rows cuts a conversation of any size into parts; a prefix of the text orders as the text does
    return df.repartitionByRange(*key, F.substring("text", 1, 64)).sortWithinPartitions(*key, "text").mapInArrow(run, schema)


def _text(cell: Cell) -> str:
    return ";".join(f"{p},{q},{c},{a}" for (p, q), (c, a) in cell.items())


def _cell(text: str) -> Cell:
    return {(int(p), int(q)): (int(c), a) for p, q, c, a in (x.split(",") for x in text.split(";"))}


def _streamed(blocks: DataFrame, keep_turns: bool) -> DataFrame:
    """Results, or repaired turns, of conversations of several blocks. All cells of a conversation come before its rows, so a
    task joins the cells, then streams the rows; it holds the audit and one block."""
    kind = blocks.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, " + (TURNS if keep_turns else RESULT)
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    both = blocks.select("conv", F.explode(F.array(F.lit(0), F.lit(1))).alias("step"), "part", "seq", "cell", "rows")
    both = both.select("conv", "step", "part", "seq", F.when(F.col("step") == 0, F.col("cell")).alias("cell"), F.when(F.col("step") == 1, F.col("rows")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            some, conv = False, None
            for b in (x for batch in batches for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
                if not some or b["conv"] != conv:
                    if some:
                        yield from end()
                    some, conv, spans, tally, digest, repair, cost, n = True, b["conv"], Spans(), Tally(), Digest(), None, 0, 0
                if b["step"] == 0:
                    spans.add(_cell(b["cell"]))
                    continue
                if repair is None:
                    cost, audit = best(spans.whole())
                    repair, spans = Repair(audit), None
                for r in b["rows"]:
                    tally.add(r)
                    for role, text, edit in repair.row(r):
                        if keep_turns:
                            yield {"conv": conv, "position": n, "role": role, "text": text, "edit": edit}
                        n += 1
                        digest.add(role, text)

                def end(conv=conv, tally=tally, digest=digest, repair=repair, cost=cost, n=n):
                    for k, (role, text, edit) in enumerate(repair.inserted(), n):
                        if keep_turns:
                            yield {"conv": conv, "position": k, "role": role, "text": text, "edit": edit}
                        digest.add(role, text)
                    if not keep_turns:
                        yield {"conv": conv} | _result(tally, cost, repair.audit, digest)

            if some:
                yield from end()

        yield from _batches(found(), arrow, lambda r: len(r.get("text") or r.get("audit") or ""))

    return both.repartition("conv").sortWithinPartitions("conv", "step", "part", "seq").mapInArrow(run, schema)


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: its id, ``gaps`` of the turn numbers, rows that are ``blank``, ``duplicate`` or ``truncated``
    (each by its first fault), ``illegal`` neighbours, the least ``cost``, its ``audit`` (Keep, Rerole, Delete, Insert) and the
    SHA-256 of the repaired turns as lines ``role:text``.

    Rows go by turn, nulls first; rows of one turn by role and text. Null roles and texts count as one space, so they are blank or have no
    legal role; repeated rows are duplicates; a null id is a conversation of its own; an empty table gives no rows. Only the four
    columns are read, so others may have any name. A conversation of any length is parsed in blocks by many
    tasks; only its digest, one pass by definition, is one task's, which streams the texts.
    """
    parsed = written(_parsed(prepared(df, conv_col, turn_col, role_col, text_col), False))
    names = [c.split()[0] for c in RESULT.split(", ")]
    out = parsed.filter("cell IS NULL").select("conv", *names).unionByName(_streamed(parsed.filter("cell IS NOT NULL"), False))
    return out.withColumnRenamed("conv", conv_col)


def repaired_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations: (id, position from 0, role, text, edit), edits being K, R or I. Cases as in ``repair``; a
    conversation that is best deleted as a whole gives no rows."""
    parsed = written(_parsed(prepared(df, conv_col, turn_col, role_col, text_col), True))
    short = parsed.filter("cell IS NULL").select("conv", F.posexplode("turns").alias("position", "t")).select("conv", F.col("position").cast("long").alias("position"), "t.role", "t.text", "t.edit")
    return short.unionByName(_streamed(parsed.filter("cell IS NOT NULL"), True)).withColumnRenamed("conv", conv_col)


def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", of: int = 20) -> DataFrame:
    """Rows (id, turn, role, text) with known faults, by the CRC-32 of ``id:turn`` modulo ``of``: 0 drops the row, 1 empties its text, 2
    takes its ``.!?``, 3 repeats it, 4 makes its role user. Nulls count as one space, but for ids and turns, which stay."""
    space = F.lit(" ")
    rows = df.select(df[conv_col].alias("conv"), df[turn_col].alias("turn"), F.coalesce(df[role_col].cast("string"), space).alias("role"), F.coalesce(df[text_col].cast("string"), space).alias("text"))
    key = F.concat(F.coalesce(F.col("conv").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.withColumn("k", (F.crc32(F.encode(key, "UTF-8")) % of).cast("int")).filter("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("text").alias(text_col))


def with_all_ids(result: DataFrame, df: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``result`` of ``repair`` with a row of zeros for each id of ``df`` that has none."""
    ids = df.select(df[conv_col].alias("id")).distinct()
    got = result.withColumnRenamed(conv_col, "conv")
    j = ids.join(got, ids.id.eqNullSafe(got.conv), "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in (*COUNTS, "cost")}
    empty = {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))}
    return j.select(F.col("id").alias(conv_col), *(v.alias(k) for k, v in (zero | empty).items()))
