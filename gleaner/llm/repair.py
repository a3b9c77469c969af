"""Repair of conversations whose roles do not alternate or whose turns are blank, repeated or cut off.

A conversation's rows, in order, are a string of one character each: what its role begins with and whether the row is clean, truncated or to be deleted. The
cheapest edits depend on this signature alone, so each distinct signature is solved once, by a memoised recursion, and the audit (one letter for each edit) is
joined back. Edits are then replayed over the rows, which stream past in order: texts are never gathered, neither for the signature nor for the repair.

Edits: keep 0; rerole to user or assistant 1; delete 2, a must for blank and duplicate rows; insert an empty user or assistant row 5; a truncated row that is
not deleted costs 5 more. The roles that are left begin like ``(s?(ua)+)?``. Of equally cheap audits the least in ASCII order is taken.

Rows go by turn, nulls first; rows of one turn by role, then by the XXH64 of the text. A null text or role is one space, a null conversation is a conversation.
Of rows equal in role and text the first is no duplicate. A conversation without rows has an empty audit. An empty table gives no rows. Other columns are not read.
One conversation's signature and audit (a byte or two for each row) are held by one task, as the result has them in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
CLEAN, CUT, GONE = "suax", "SUAX", "1234"  # by what the role begins with: s, u, a or something else
LEGAL = {"su", "ua", "au"}
SEEN = r"[^\x20\x09-\x0D]"
SPACE = " \t\n\x0b\x0c\r"
SALT = 16  # parts that the conversations of one signature are dealt to
STRIDE = 128  # rows that a recursion goes down before it meets what is known

# What may come next, and where that leads: nothing yet (0), after a system row (1), after user (2), after assistant (3).
NEXT = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
FULL = {"u": "user", "a": "assistant"}
_NEVER = 1 << 60


def _choices(code: str, state: int) -> list[tuple[str, int, int]]:
    """Edit, cost and next state of each way to take a row, in ASCII order."""
    out = [("D", DELETE, state)]
    if code in GONE:
        return out
    extra, own = (TRUNCATED if code in CUT else 0), code.lower()
    role, to = NEXT[state]
    if own == role:
        out.append(("K", extra, to))
    if state == 0 and own == "s":
        out.append(("K", extra, 1))
    if own != role:
        out.append(("R", REROLE + extra, to))
    return out


def solve(signature: str) -> tuple[int, str]:
    """Cost and audit of the cheapest repair.

    Two inserts between two rows are never cheaper than none, so one is tried. What the rest costs is known for every state at every row from the end on,
    kept for every ``STRIDE``-th row; then the least letter that keeps to it is taken, row by row.
    """
    n = len(signature)
    edges: dict[int, tuple[int, ...]] = {n: (0, _NEVER, _NEVER, 0)}  # costs by state at every STRIDE-th row
    memo: dict[tuple[int, int], int] = {}

    def taken(at: int, state: int) -> int:
        if at in edges:
            return edges[at][state]
        if (at, state) not in memo:
            memo[at, state] = min(cost + rest(at + 1, to) for _, cost, to in _choices(signature[at], state))
        return memo[at, state]

    def rest(at: int, state: int) -> int:
        return min(taken(at, state), INSERT + taken(at, NEXT[state][1]))

    def cheapest(at: int, state: int, left: int) -> list[tuple[str, int]]:
        return [(edit, to) for edit, cost, to in _choices(signature[at], state) if cost + rest(at + 1, to) == left] if at < n else []

    for at in range(n - STRIDE, 0, -STRIDE):
        edges[at] = tuple(taken(at, state) for state in NEXT)
        memo.clear()
    total = rest(0, 0)
    audit, state, left = [], 0, total
    for at in range(n + 1):
        if at in edges:
            memo.clear()
        left = rest(at, state)
        edits = cheapest(at, state, left)
        inserted = NEXT[state][1]
        if INSERT + taken(at, inserted) == left and not any(edit < "I" for edit, _ in edits):
            audit.append("I")
            state, edits = inserted, cheapest(at, inserted, left - INSERT)
        if at < n:
            edit, state = min(edits)
            audit.append(edit)
    return total, "".join(audit)


def illegal(signature: str) -> int:
    """Neighbours whose roles may not follow each other."""
    roles = [CLEAN[(CLEAN + CUT + GONE).index(c) % 4] for c in signature]
    return sum(a + b not in LEGAL for a, b in zip(roles, roles[1:], strict=False))


def _solve_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signatures = batch.column(0).to_pylist()
        found = [solve(s) for s in signatures]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in found], pa.int64()), pa.array([illegal(s) for s in signatures], pa.int64()), pa.array([a for _, a in found], pa.string())], ["signature", "cost", "illegal", "audit"])


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, copies``: rows damaged by the checksum of their conversation and turn, as a test of the repair."""
    space = F.lit(" ")
    where = F.concat(F.coalesce(F.col(conv).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    kind = F.crc32(F.encode(where, "utf-8")) % 20
    own, said = F.coalesce(F.col(role).cast("string"), space), F.coalesce(F.col(text).cast("string"), space)
    said = F.when(kind == 1, "").when(kind == 2, F.translate(said, ".!?", "")).otherwise(said)
    return df.where(kind != 0).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(own).alias("role"), said.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies")
    )


def _coded(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` with the place among rows of the same role and text, the text's hash, and the row's characters.

    Equal rows meet once: their turns come together as a light list, and only the first is no duplicate.
    """
    met = rows.groupBy("conv_id", "role", "text").agg(F.sort_array(F.collect_list(F.struct("turn", "copies"))).alias("met"))
    each = met.select("conv_id", "role", "text", F.posexplode("met").alias("nth", "m"))
    begins = F.substring("role", 1, 1)
    kind = F.when(begins == "s", 1).when(begins == "u", 2).when(begins == "a", 3).otherwise(4)
    pick = lambda letters: F.substring(F.lit(letters), kind, F.lit(1))
    blank = ~F.rlike("text", F.lit(SEEN))
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    cut = ~last.isin(".", "!", "?")
    first = F.when(blank | (F.col("nth") > 0), pick(GONE)).when(cut, pick(CUT)).otherwise(pick(CLEAN))
    code = F.concat(first, F.repeat(pick(GONE), F.col("copies") - 1))
    copies = F.col("copies").cast("long")
    again = F.when(blank, 0).otherwise(copies - F.when(F.col("nth") == 0, 1).otherwise(0))
    each = each.select("conv_id", F.col("m.turn").alias("turn"), "role", "text", F.col("m.copies").alias("copies"), "nth", F.xxhash64("text").alias("h"))
    return each.select("*", code.alias("code"), F.when(blank, copies).otherwise(0).alias("blank"), again.alias("duplicate"), F.when(~blank & (F.col("nth") == 0) & cut, 1).otherwise(0).cast("long").alias("truncated"))


ORDER = ("turn", "role", "h", "nth")
STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audits(coded: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of every conversation that has rows."""
    light = coded.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct(*ORDER, "code"))).alias("r"), F.max("turn").alias("high"), F.min("turn").alias("low"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated"))
    )
    turns = F.size(F.array_compact(F.array_distinct(F.col("r.turn"))))
    convs = light.select("conv_id", F.coalesce(F.col("high") - F.col("low") + 1 - turns, F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", F.array_join("r.code", "").alias("signature"))
    solved = convs.select("signature").distinct().mapInArrow(_solve_batches, "signature string, cost long, illegal long, audit string")
    dealt = solved.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    own = convs.withColumn("part", F.pmod(F.xxhash64("conv_id"), F.lit(SALT)).cast("int"))
    return own.join(dealt, ["signature", "part"]).select("conv_id", *STATS, "audit")


class _Replay:
    """The rows of one conversation after its edits, given its rows one by one."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            yield self._add("I", "", None)

    def _add(self, edit: str, text: str, role: str | None) -> tuple[str, str, str]:
        self.at += 1
        if role is not None and self.state == 0 and role.startswith("s"):
            self.state = 1
            return edit, role, text
        letter, self.state = NEXT[self.state]
        return edit, FULL[letter] if role is None else role, text

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self._inserts()
        edit = self.audit[self.at]
        if edit == "D":
            self.at += 1
        else:
            yield self._add(edit, text, role if edit == "K" else None)

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserts()


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator | None]]:
    """Each conversation's header, then its repaired rows, from rows that come header first."""
    header = replay = None
    for batch in batches:
        for r in batch.to_pylist():
            if r["mark"] == 0:
                if replay:
                    yield header, replay.end()
                header, replay = r, _Replay(r["audit"])
                yield header, None
            else:
                for _ in range(r["copies"]):
                    yield header, replay.row(r["role"], r["text"])
    if replay:
        yield header, replay.end()


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: list[tuple] = []
    header, sha, n = None, None, 0

    def flush() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i >= len(STATS) + 1 else pa.int64()) for i, c in enumerate(columns)], ["conv_id", *STATS, "audit", "repaired_sha256"])

    for head, rows in _streams(batches):
        if rows is None:
            if header is not None:
                done.append((header["conv_id"], *(header[c] for c in STATS), header["audit"], sha.hexdigest()))
            header, sha, n = head, hashlib.sha256(), 0
            if len(done) >= 1000:
                yield flush()
            continue
        for _, role, text in rows:
            sha.update(f"{chr(10) if n else ''}{role}:{text}".encode())
            n += 1
    if header is not None:
        done.append((header["conv_id"], *(header[c] for c in STATS), header["audit"], sha.hexdigest()))
        yield flush()


def _row_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    size = place = 0

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], ["conv_id", "place", "edit", "role", "text"])

    for head, rows in _streams(batches):
        if rows is None:
            place = 0
            continue
        for edit, role, text in rows:
            out.append((head["conv_id"], place, edit, role, text))
            place, size = place + 1, size + len(text)
            if len(out) >= 5000 or size > 1 << 20:
                yield flush()
                size = 0
    if out:
        yield flush()


def _ordered(coded: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, in one partition."""
    none = lambda kind: F.lit(None).cast(kind)
    heads = found.select("conv_id", F.lit(0).alias("mark"), none("long").alias("turn"), none("string").alias("role"), none("long").alias("h"), none("int").alias("nth"), none("string").alias("text"), none("int").alias("copies"), *STATS, "audit")
    rows = coded.select("conv_id", F.lit(1).alias("mark"), "turn", "role", "h", "nth", "text", "copies", *(none("long").alias(c) for c in STATS), none("string").alias("audit"))
    return heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "mark", *ORDER)


def repaired(rows: DataFrame) -> DataFrame:
    """``conv_id, place, edit, role, text``: the repaired rows of ``conv_id, turn, role, text, copies``, with the edit that each comes from."""
    coded = _coded(rows)
    return _ordered(coded, audits(coded)).mapInArrow(_row_batches, "conv_id long, place long, edit string, role string, text string")


def digest(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for every conversation in ``conversations`` (``conv_id``): the audit, what was wrong, and the SHA-256 of the repaired rows as ``role:text`` lines."""
    coded = _coded(rows)
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    found = audits(coded)
    stats = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in STATS]
    every = ids.join(found, ids["id"].eqNullSafe(found["conv_id"]), "left").select(F.col("id").alias("conv_id"), *stats, F.coalesce("audit", F.lit("")).alias("audit"))
    kinds = ", ".join(f"{c} long" for c in ("conv_id", *STATS))
    return _ordered(coded, every).mapInArrow(_digest_batches, f"{kinds}, audit string, repaired_sha256 string")
