"""Conversation structure repair by weighted interval parsing.

A repaired conversation's role initials have the form ``(s?(ua)+)?``. Edits: Keep a row (0), Rerole it to user or
assistant (2), Delete it (3), Insert an empty user or assistant turn (2); a truncated row that stays costs 1 more, a blank or
duplicate row must go. The repair is the cheapest list of edits, and among those the one whose initials come first in ASCII.

The form is stated as a Chomsky-normal-form grammar: with the states of the form's automaton (nothing yet, after s, after u, after
a), the symbol (p, q) derives what leads from p to q, and its rules are (p, q) -> (p, r) (r, q). A cell holds, for one span
of rows and one symbol, the least (cost, audit). Cells of single rows come from the edits, closed under insertions
before and after; longer spans are combined bottom-up by length over all their split points. Equal-cost audits of one span are
never a prefix of each other (they would differ by insertions, which cost), so joining least parts gives the least whole.

Rows of a conversation reach one task in order, as short marks (initial and fault, no text). Up to ``BLOCK`` rows are one chart. A
longer conversation is parsed block by block: the cells of each block, which are spans too, are joined to the cells of
all rows before it. Memory follows the block, the audit and not the texts. What a list of marks parses to is remembered.

Defined cases: a null conversation id, turn, role or text is written as one space where text is needed; a null turn comes first and
takes no part in ``gaps``. Rows of one turn go by role and then by the MD5 of their text. A row equal in role and text to an earlier one
is a duplicate, whatever their turns. A role whose initial is not s, u or a, or that is empty, cannot be kept. A conversation without rows has cost 0
and an empty audit. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickmill.llm.common import map_rows, small, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
# Rows of one chart.
BLOCK = 16
WHITE = r"\x20\x09-\x0D"

# The automaton of (s?(ua)+)?: states and steps. Repairs start in NOTHING and end in one of ENDS.
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
STEPS = {(NOTHING, "s"): AFTER_S, (NOTHING, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
ENDS = (NOTHING, AFTER_A)
STATES = range(4)

Cell = tuple[int, str]
Cells = dict[tuple[int, int], Cell]


# -- parsing -------------------------------------------------------------------------------------------------------


def _joined(left: Cells, right: Cells, into: Cells | None = None) -> Cells:
    """Cells of two neighbouring spans to cells of both: (p, q) -> (p, r) (r, q), keeping the least."""
    found = {} if into is None else into
    for (p, r), (cost, audit) in left.items():
        for q in STATES:
            more = right.get((r, q))
            if more:
                whole = cost + more[0]
                known = found.get((p, q))
                if known is None or whole < known[0] or (whole == known[0] and audit + more[1] < known[1]):
                    found[p, q] = (whole, audit + more[1])
    return found


def _insertions() -> Cells:
    """Cells of the empty span: insertions alone, closed under joining."""
    cells: Cells = {(p, p): (0, "") for p in STATES}
    cells |= {(p, q): (INSERT, "I") for (p, role), q in STEPS.items() if role in "ua"}
    while (closed := _joined(cells, cells, dict(cells))) != cells:
        cells = closed
    return cells


INSERTED = _insertions()


def _row_cells(mark: str) -> Cells:
    """Cells of one row. Its mark is s, u, a or o for the role, in upper case if truncated, or x if it must go."""
    cells: Cells = {(p, p): (DELETE, "D") for p in STATES}
    if mark != "x":
        extra = TRUNCATED if mark.isupper() else 0
        for (p, role), q in STEPS.items():
            if role == mark.lower():
                cells[p, q] = (KEEP + extra, "K")
            elif role in "ua":
                cells[p, q] = (REROLE + extra, "R")
    return _joined(_joined(INSERTED, cells), INSERTED)


ROWS = {mark: _row_cells(mark) for mark in "suaoSUAOx"}


@lru_cache(maxsize=50_000)
def chart(marks: str) -> tuple[tuple[tuple[int, int], Cell], ...]:
    """Cells of the whole span, from the charts of all spans inside it, shorter ones first."""
    n = len(marks)
    spans = {(k, k + 1): ROWS[mark] for k, mark in enumerate(marks)}
    for length in range(2, n + 1):
        for start in range(n - length + 1):
            cells: Cells = {}
            for split in range(start + 1, start + length):
                _joined(spans[start, split], spans[split, start + length], cells)
            spans[start, start + length] = cells
    return tuple(spans[0, n].items()) if n else tuple(INSERTED.items())


class Parse:
    """Marks of one conversation, block after block; ``cells`` covers the rows of all finished blocks."""

    def __init__(self):
        self.cells: Cells = {(NOTHING, NOTHING): (0, "")}
        self.open: list[str] = []

    def add(self, mark: str) -> None:
        self.open.append(mark)
        if len(self.open) == BLOCK:
            self._close()

    def _close(self) -> None:
        self.cells = _joined(self.cells, dict(chart("".join(self.open))))
        self.open = []

    def result(self) -> Cell:
        """The least (cost, audit) of the whole conversation."""
        if self.open:
            self._close()
        return min(cell for (_, q), cell in self.cells.items() if q in ENDS)


# -- rows ----------------------------------------------------------------------------------------------------------


def _written(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the damaged rows; a dropped row stays with null role and text, so that no conversation is lost."""
    kind = F.crc32(F.concat(_written("conv_id"), F.lit(":"), _written("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(_written("text"), "[.!?]", "")).otherwise(_written("text"))
    rows = conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 0, None).when(kind == 4, "user").otherwise(_written("role")).alias("role"),
        F.when(kind != 0, text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).alias("_times"),
    )
    return rows.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times", "_time")


def _order() -> list[Column]:
    return [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def marked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest and mark of rows as :func:`damage` gives them; ``again`` tells that an earlier turn has the same row."""
    text = F.col("text")
    last = F.regexp_extract(text, rf"([^{WHITE}])[{WHITE}]*\z", 1)
    fault = (
        F.when(F.col("role").isNull(), F.lit("dropped"))
        .when(last == "", F.lit("blank"))
        .when(~last.isin(".", "!", "?"), F.lit("truncated"))
        .otherwise(F.lit(""))
    )
    slim = rows.select("conv_id", "turn", "role", F.md5("text").alias("digest"), fault.alias("fault"))
    # The first turn of every row that several turns repeat: one short row each, added up before the shuffle.
    turn = F.coalesce(F.struct(F.col("turn").isNotNull(), F.col("turn")), F.struct(F.lit(False), F.col("turn")))
    same = (
        slim.where("fault in ('', 'truncated')")
        .groupBy("conv_id", "role", "digest")
        .agg(F.min(turn).alias("first"), F.max(turn).alias("last"))
        .where("first < last")
        .select(*(F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "digest")), F.col("first").alias("_first"))
    )
    repeats = small(stored(same, "repeated-turns"))
    hit = slim["conv_id"].eqNullSafe(repeats["_conv_id"]) & (slim["role"] == repeats["_role"]) & (slim["digest"] == repeats["_digest"])
    return slim.join(repeats, hit, "left").select(
        "conv_id", "turn", "role", "digest", "fault", (F.col("_first").isNotNull() & (F.col("_first") < turn)).alias("again")
    )


JUDGED = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
)


class _Tally:
    """What is counted over the rows of one conversation, in order."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.role = None
        self.parse = Parse()

    def add(self, turn, role: str, fault: str, again: bool) -> None:
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.turns += turn != self.high
            self.high = turn
        initial = role[:1]
        if self.role is not None:
            self.illegal += self.role + initial not in ("su", "ua", "au")
        self.role = initial
        mark = initial if initial and initial in "sua" else "o"
        if fault == "blank":
            self.blank += 1
            mark = "x"
        elif again:
            self.duplicate += 1
            mark = "x"
        elif fault == "truncated":
            self.truncated += 1
            mark = mark.upper()
        self.parse.add(mark)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost, audit = self.parse.result()
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit)


def judge(rows: DataFrame) -> DataFrame:
    """``JUDGED``: gaps, faults, cost and audit of every conversation of damaged or other rows (conv_id, turn, role, text)."""
    ordered = marked(rows).repartition("conv_id").sortWithinPartitions(*_order())

    def task(found: Iterator[tuple]) -> Iterator[tuple]:
        tally = before = None
        for conv_id, turn, role, digest, fault, again in found:
            if tally is None or tally.conv_id != conv_id:
                if tally:
                    yield tally.row()
                tally, before = _Tally(conv_id), None
            if fault != "dropped":
                # Equal rows of one turn are neighbours.
                tally.add(turn, role, fault, again or before == (turn, role, digest))
                before = (turn, role, digest)
        if tally:
            yield tally.row()

    return map_rows(ordered, ["conv_id", "turn", "role", "digest", "fault", "again"], JUDGED, task)


# -- repair --------------------------------------------------------------------------------------------------------

REPAIRED = "conv_id long, place long, turn long, role string, text string, edit string"


def _grouped(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """Rows with the audit of their conversation ahead of them, each conversation in one task and in order."""
    slim = rows.where("role is not null").select("conv_id", "turn", "role", "text", F.md5("text").alias("digest"))
    heads = judged.select("conv_id", "audit")
    both = heads.withColumn("_head", F.lit(0)).unionByName(slim.withColumn("_head", F.lit(1)), allowMissingColumns=True)
    conv_id, *order = _order()
    return both.repartition("conv_id").sortWithinPartitions(conv_id, "_head", *order)


def _repaired(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Repaired rows of ``_grouped`` ones, conversation by conversation; a row of null role opens each conversation."""
    audit, at, place, conv_id = "", 0, 0, None
    want = "u"

    def inserted() -> Iterator[tuple]:
        nonlocal at, place, want
        while at < len(audit) and audit[at] == "I":
            at += 1
            yield conv_id, place, None, "user" if want == "u" else "assistant", "", "I"
            place, want = place + 1, "a" if want == "u" else "u"

    for key, steps, turn, role, text, head in rows:
        if head == 0:
            conv_id, audit, at, place, want = key, steps, 0, 0, "u"
            yield conv_id, -1, None, None, None, None
        else:
            edit = audit[at]
            at += 1
            if edit != "D":
                if edit == "R":
                    role = "user" if want == "u" else "assistant"
                yield conv_id, place, turn, role, text, edit
                place += 1
                want = "u" if role[:1] in "sa" else "a"
        yield from inserted()


_COLUMNS = ["conv_id", "audit", "turn", "role", "text", "_head"]


def repair(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """``REPAIRED``: the rows that stay or are inserted, by conversation and place, with the edit that made them (K, R or I)."""
    return map_rows(_grouped(rows, judged), _COLUMNS, REPAIRED, _repaired).where("place >= 0")


def repaired_digests(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """conv_id and the digest of ``role:text`` lines of every repaired conversation, hashed row by row."""

    def task(found: Iterator[tuple]) -> Iterator[tuple]:
        conv_id = digest = None
        for key, place, _, role, text, _ in _repaired(found):
            if place < 0:
                if digest:
                    yield conv_id, digest.hexdigest()
                conv_id, digest = key, hashlib.sha256()
                continue
            digest.update(f"{chr(10) if place else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        if digest:
            yield conv_id, digest.hexdigest()

    return map_rows(_grouped(rows, judged), _COLUMNS, "conv_id long, repaired_sha256 string", task)


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """``JUDGED`` and repaired_sha256 of every conversation after :func:`damage`."""
    rows = damage(conversations)
    judged = stored(judge(rows), "judged")
    digests = repaired_digests(rows, judged).withColumnRenamed("conv_id", "_same")
    return judged.join(digests, F.col("conv_id").eqNullSafe(F.col("_same"))).drop("_same")
