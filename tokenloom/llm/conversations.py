"""Conversation structure repair by aligning turns to the alternating grammar.

Repaired role initials read ``(s?(ua)+)?``: nothing, or an optional system turn and pairs of user and
assistant.  Edits and costs: Keep 0, Rerole to user or assistant 1, Delete 2 (required for blank and for
repeated rows), Insert an empty user or assistant turn 5; a truncated row that stays adds 5.

Wagner-Fischer against every feasible length: the grammar's strings of all lengths end alike, so one table of
(rows left, letters left) holds their alignments.  A greedy repair gives the incumbent cost; only cells
from which a cost up to the incumbent is possible are filled, which are those near the diagonal (Ukkonen's
band: a letter more than rows costs 5, a row more than letters costs 2).  The lengths of least cost are traced
back, each to its least audit, and the audits are compared.

Two passes, neither of which holds a conversation's texts.  The first shuffles a turn number, a digest and a
code a row, and holds those of one conversation (about 50 bytes a row) to align them.  The second sorts
the texts behind their conversation's audit and streams through them; a conversation of any size passes
a task row by row, as its digest demands.  The table takes rows x (incumbent / 2 + incumbent / 5) steps;
from four million cells on only every so-manieth row of it is held, the others are worked out again.

Edge cases: null roles and texts are one space, so such a role is none of the grammar's and such a text is
blank; null turns come first; rows of one turn are ordered by a digest of role and text; a null ``conv_id`` is a
conversation of its own; conversations without present rows have zeros, an empty audit and no repaired rows.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import buckets, cut_lineage, groups, released, small_batches

SPACES = " \t\n\x0b\x0c\r"
STOPS = ".!?"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NEVER = 1 << 40
#: Cells of the alignment table held at once.
CELLS = 4_000_000
_U, _A, _S, _OTHER = range(4)


class _Rows:
    """Costs of the rows of one conversation and the band in which they are aligned."""

    def __init__(self, letter: np.ndarray, must: np.ndarray, cut: np.ndarray):
        self.letter, self.must, self.cut = letter, must, cut
        self.n = len(letter)
        extra = np.where(cut, TRUNCATED, 0)
        #: By the parity of the letters left: odd wants an assistant, even a user.
        self.match = [extra + np.where(letter == _U, KEEP, REROLE), extra + np.where(letter == _A, KEEP, REROLE)]
        self.system = np.where((letter == _S) & ~must, extra, NEVER)
        self.left = np.append(np.cumsum(~must[::-1])[::-1], 0)  # live rows from each row on
        slack = self.incumbent() - DELETE * int(must.sum())
        self.down, self.width = slack // DELETE + 1, slack // DELETE + slack // INSERT + 2
        self.offset = np.arange(self.width, dtype=np.int64)

    def incumbent(self) -> int:
        """Cost of a greedy repair: a row out of turn goes if the next one fits its place, else it changes its role."""
        live = [(int(x), bool(c)) for x, c in zip(self.letter[~self.must], self.cut[~self.must])]
        cost, want, pairs, system = DELETE * int(self.must.sum()), _U, 0, False
        for k, (letter, cut) in enumerate(live):
            fits = letter == want
            if cut or (not fits and k + 1 < len(live) and live[k + 1] == (want, False)):
                cost += DELETE
                continue
            if letter == _S and not pairs and want == _U and not system:
                system = True
                continue
            cost += KEEP if fits else REROLE
            pairs += want == _A
            want = _A if want == _U else _U
        if want == _A:
            cost, pairs = cost + INSERT, pairs + 1
        if system and not pairs:
            cost += 2 * INSERT
        return min(cost, DELETE * self.n)

    def last(self) -> tuple[np.ndarray, np.ndarray]:
        r = self.offset - self.down
        return np.where(r >= 0, INSERT * r, NEVER), np.full(self.width, NEVER)

    def above(self, i: int, after: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Row i of the tables (tail; system turn and tail) from row i + 1."""
        tail, system = after
        r = self.offset - self.down + int(self.left[i])
        if self.must[i]:
            best, first = DELETE + tail, DELETE + system
        else:  # the band moved by one
            same = np.append(tail[1:], NEVER)
            best = np.minimum(DELETE + same, np.where(r >= 1, tail + np.where(r % 2, self.match[1][i], self.match[0][i]), NEVER))
            first = np.minimum(DELETE + np.append(system[1:], NEVER), self.system[i] + same)
        best = np.where(r >= 0, best, NEVER)
        best = np.minimum(np.minimum.accumulate(best - INSERT * r) + INSERT * r, NEVER)
        return best, np.minimum(first, NEVER)

    def value(self, row: np.ndarray, i: int, r: int) -> int:
        at = r - int(self.left[i]) + self.down
        return int(row[at]) if 0 <= at < self.width else NEVER


def _step(rows: _Rows, i: int, r: int, before: bool, here, after) -> tuple[str, int, int, bool]:
    """The least edit that leads from the cell on an alignment of least cost, and the cell behind it."""
    if before:  # the system turn is still to come
        if DELETE + rows.value(after[1], i + 1, r) == rows.value(here[1], i, r):
            return "D", i + 1, r, True
        return "K", i + 1, r, False
    cost = rows.value(here[0], i, r)
    if i < rows.n and DELETE + rows.value(after[0], i + 1, r) == cost:
        return "D", i + 1, r, False
    if r and INSERT + rows.value(here[0], i, r - 1) == cost:
        return "I", i, r - 1, False
    return "K" if rows.letter[i] == (_A if r % 2 else _U) else "R", i + 1, r - 1, False


def align(letter: np.ndarray, must: np.ndarray, cut: np.ndarray) -> tuple[int, str]:
    """Least cost and, of the cheapest edits, the ASCII-least initials.  ``letter``: 0 user, 1 assistant, 2 system,
    3 another; ``must``: rows that have to go; ``cut``: truncated rows."""
    rows = _Rows(letter, must, cut)
    n = rows.n
    if not n:
        return 0, ""
    block = n if n * rows.width <= CELLS else max(1, math.isqrt(n))
    held = {n: rows.last()}  # the last row of each block
    after = held[n]
    for i in range(n - 1, -1, -1):
        after = rows.above(i, after)
        if i % block == 0:
            held[i] = after
    r = rows.offset - rows.down + int(rows.left[0])
    plain = np.where((r >= 0) & (r % 2 == 0), after[0], NEVER)
    system = np.where((r >= 2) & (r % 2 == 0), after[1], NEVER)
    cost = int(min(plain.min(), system.min()))
    paths = [[0, int(x), False, []] for x in r[plain == cost]] + [[0, int(x), True, []] for x in r[system == cost]]
    for lo in range(0, n, block):
        hi = min(n, lo + block)
        table = {hi: held[hi]}
        for i in range(hi - 1, lo - 1, -1):
            table[i] = rows.above(i, table[i + 1])
        for path in paths:
            i, left, before, audit = path
            while i < hi or (hi == n and left):
                edit, i, left, before = _step(rows, i, left, before, table[i], table.get(i + 1))
                audit.append(edit)
            path[:3] = i, left, before
    return cost, min("".join(p[3]) for p in paths)


@lru_cache(maxsize=1 << 16)
def _align_short(codes: bytes) -> tuple[int, str]:
    code = np.frombuffer(codes, dtype=np.uint8).astype(np.int64)
    return align(code & 3, (code & 4) > 0, (code & 8) > 0)


def align_coded(code: np.ndarray) -> tuple[int, str]:
    """``align`` of rows coded as letter + 4 must + 8 cut; short conversations of the same shape are aligned once."""
    return _align_short(code.astype(np.uint8).tobytes()) if len(code) <= 24 else align(code & 3, (code & 4) > 0, (code & 8) > 0)


# ---- in Spark ---------------------------------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` (nulls in the last two: one space) and ``present``, damaged by a hash of
    conversation and turn: dropped (not present), emptied, without full stops, repeated, or of role user."""
    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    own = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return own.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                      (F.col("kind") != 0).alias("present"), copies.alias("copy")).drop("copy")


def _marked(rows: DataFrame, present: str | None) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    here = F.coalesce(F.col(present), F.lit(False)) if present else F.lit(True)
    own = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), here.alias("here"))
    mark = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    return own.withColumn("mark", mark)


_AUDIT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_LETTERS = {"u": _U, "a": _A, "s": _S}


def _audited(group: pa.Table) -> tuple:
    """Counts, cost and audit of the rows of one conversation in order."""
    rows = group.filter(group["here"])
    turns = [t for t in rows["turn"].to_pylist() if t is not None]
    initial = rows["initial"].to_pylist()
    blank = np.array(rows["blank"].to_pylist(), dtype=bool)
    again, seen = np.zeros(len(blank), dtype=bool), set()
    for k, mark in enumerate(rows["mark"].to_pylist()):
        again[k] = mark in seen
        seen.add(mark)
    again &= ~blank
    cut = ~np.array(rows["ended"].to_pylist(), dtype=bool) & ~blank & ~again
    letter = np.array([_LETTERS.get(x, _OTHER) for x in initial], dtype=np.int64)
    cost, audit = align_coded(letter + 4 * (blank | again) + 8 * cut)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initial, initial[1:]))
    return gaps, int(blank.sum()), int(again.sum()), int(cut.sum()), illegal, cost, audit


def _audits(kind: pa.DataType):
    types = [kind, *[pa.int64()] * len(_AUDIT), pa.string()]

    def batch(held):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=["conv_id", *_AUDIT, "audit"])

    def run(batches):
        held, size = [], 0
        for group in groups(batches, "conv_id"):
            held.append((group["conv_id"][0].as_py(), *_audited(group)))
            size += 100 + len(held[-1][-1])
            if size > 1_000_000:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)
    return run


def audit(rows: DataFrame, present: str | None = None) -> DataFrame:
    """One row for each ``conv_id`` of the rows (``conv_id``, ``turn``, ``role``, ``text``): ``gaps`` in the turn numbers, rows by first fault
    (``blank``, ``duplicate``, ``truncated``), ``illegal`` neighbours, least ``cost`` and ``audit``: the initials of
    the edits.  Rows whose column ``present`` isn't true count for their ``conv_id`` only."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    own = _marked(rows, present).select("conv_id", "turn", "mark", "here", F.substring("role", 1, 1).alias("initial"),
                                        (trimmed == "").alias("blank"), F.right(trimmed, F.lit(1)).isin(*STOPS).alias("ended"))
    kind = own.schema["conv_id"].dataType
    sorted_ = own.repartition(buckets(own), "conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "mark")
    from pyspark.sql.pandas.types import to_arrow_type
    return sorted_.mapInArrow(released(_audits(to_arrow_type(kind))), f"conv_id {kind.simpleString()}, {', '.join(f'{c} bigint' for c in _AUDIT)}, audit string")


class _Repair:
    """Follows one conversation's audit through its rows."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place, self.user = audit, 0, 0, True

    def _turn(self) -> str:
        self.user = not self.user
        return "assistant" if self.user else "user"

    def inserted(self):
        while self.audit.startswith("I", self.at):
            self.at += 1
            self.place += 1
            yield self.place, "I", self._turn(), ""

    def row(self, role: str, text: str):
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        self.place += 1
        if edit == "K" and role.startswith("s"):
            yield self.place, edit, role, text
        else:
            turn = self._turn()
            yield self.place, edit, role if edit == "K" else turn, text


def _repaired(kind: pa.DataType):
    types = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
    names = ["conv_id", "place", "edit", "role", "text"]

    def batch(held):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

    def run(batches):
        held, size, conv, repair = [], 0, None, None
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                for own, audit, role, text in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "audit", "role", "text"))):
                    if audit is not None:  # stands before its conversation's rows
                        new = [(conv, *x) for x in repair.inserted()] if repair else []
                        conv, repair = own, _Repair(audit)
                    else:
                        new = [(conv, *x) for x in repair.row(role, text)]
                    held += new
                    size += sum(len(x[-1]) + 40 for x in new)
                if size > 1_000_000:
                    yield batch(held)
                    held, size = [], 0
        if repair:
            held += [(conv, *x) for x in repair.inserted()]
        if held:
            yield batch(held)
    return run


def repaired(rows: DataFrame, audits: DataFrame, present: str | None = None) -> DataFrame:
    """The rows after the edits of their conversation's audit: ``conv_id``, ``place`` (from 1), ``edit`` (K, R or I), ``role``, ``text``.
    The rows of a conversation come one after another in one partition, by place."""
    from pyspark.sql.pandas.types import to_arrow_type
    own = _marked(rows, present).where("here").select("conv_id", "turn", "mark", F.lit(None).cast("string").alias("audit"), "role", "text")
    heads = audits.select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("binary").alias("mark"), "audit",
                          F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    kind = own.schema["conv_id"].dataType
    both = own.unionByName(heads)
    small_batches(rows.sparkSession)
    both = both.repartition(buckets(both), "conv_id").sortWithinPartitions("conv_id", F.asc_nulls_last("audit"), F.asc_nulls_first("turn"), "mark")
    return both.mapInArrow(released(_repaired(to_arrow_type(kind))), f"conv_id {kind.simpleString()}, place bigint, edit string, role string, text string")


def _hashed(kind: pa.DataType):
    def run(batches):
        conv, sha, out = None, None, []
        for b in batches:
            for own, place, role, text in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "place", "role", "text"))):
                if place == 1:
                    out += [] if sha is None else [(conv, sha.hexdigest())]
                    conv, sha = own, hashlib.sha256()
                sha.update(f"{'' if place == 1 else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            if out:
                yield _digest_batch(out, kind)
                out = []
        if sha is not None:
            yield _digest_batch([(conv, sha.hexdigest())], kind)
    return run


def _digest_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    ids, shas = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(shas, pa.string())], names=["conv_id", "repaired_sha256"])


def digests(audits: DataFrame, fixed: DataFrame) -> DataFrame:
    """The audits with ``repaired_sha256`` of the repaired ``role:text`` lines.  ``fixed`` must come straight from
    ``repaired``: its rows are hashed one by one in the order in which they stand."""
    from pyspark.sql.pandas.types import to_arrow_type
    kind = fixed.schema["conv_id"].dataType
    shas = fixed.mapInArrow(_hashed(to_arrow_type(kind)), f"conv_id {kind.simpleString()}, repaired_sha256 string")
    shas = shas.withColumnRenamed("conv_id", "own")
    out = audits.join(shas, F.col("conv_id").eqNullSafe(F.col("own")), "left").drop("own")
    return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


def repair(rows: DataFrame, present: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The audits (written to the shared checkpoint folder: they are read twice) and the repaired rows."""
    audits = cut_lineage(audit(rows, present))
    return audits, repaired(rows, audits, present)


def _add(cell: str, cost: int | str, edit: str) -> str:
    """SQL: an edit before the cheapest edits of a state, kept as nine digits of cost and the edits' initials."""
    return f"lpad((left({cell}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || '{edit}' || substr({cell}, 10)"


def _least(*cells: str) -> str:
    return f"least({', '.join(cells)})"


def _oracle() -> str:
    """The grammar as an automaton instead of an alignment: states z (nothing yet), p (after the system turn), u and a (wants
    a user, an assistant), each with its cheapest and ASCII-least way to the end, row by row from the last one."""
    def match(letter: str, cell: str) -> str:
        keep, change = _add(cell, "CASE WHEN r.cut THEN 5 ELSE 0 END", "K"), _add(cell, "CASE WHEN r.cut THEN 6 ELSE 1 END", "R")
        return f"CASE WHEN r.initial = '{letter}' THEN {keep} ELSE {change} END"
    system = f"CASE WHEN r.initial = 's' THEN {_add('p', 'CASE WHEN r.cut THEN 5 ELSE 0 END', 'K')} ELSE '999999999' END"
    gone = {c: _add(c, 2, "D") for c in "zpua"}
    states = {"z": _least(gone["z"], match("u", "a"), system), "p": _least(gone["p"], match("u", "a")),
              "u": _least(gone["u"], match("u", "a")), "a": _least(gone["a"], match("a", "u"))}
    stepped = ", ".join(f"CASE WHEN r.must THEN {gone[c]} ELSE {sql} END AS {c}0" for c, sql in states.items())
    return rf"""
WITH RECURSIVE bits(i, v, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT i, v FROM bits WHERE k = 8),
keyed AS (
  SELECT conv_id, turn, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text
  FROM conversations),
crc(s, k, c) AS (
  SELECT DISTINCT s, 1, 4294967295::BIGINT FROM keyed
  UNION ALL SELECT s, k + 1, xor(c >> 8, v) FROM crc JOIN tab ON i = xor(c, ascii(s[k])) & 255 WHERE k <= len(s)),
kinds AS (SELECT s, xor(c, 4294967295) % 20 AS kind FROM crc WHERE k = len(s) + 1),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM keyed JOIN kinds USING (s), unnest(range(CASE WHEN kind = 0 THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END)) AS c(copy)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(len(role) || ':' || role || text)) AS pos FROM hurt),
judged AS (
  SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM placed),
rows_ AS (SELECT *, blank OR again AS must, open AND NOT blank AND NOT again AS cut FROM judged),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut) AS truncated,
    count(*) FILTER (pos > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM rows_ GROUP BY conv_id),
way(conv_id, k, z, p, u, a) AS (
  SELECT conv_id, n, '000000000', '000000010II', '000000000', '000000005I' FROM counted
  UNION ALL
  SELECT conv_id, k - 1, {_least("z0", _add(_least("a0", _add("u0", 5, "I")), 5, "I"))}, {_least("p0", _add(_least("a0", _add("u0", 5, "I")), 5, "I"))},
    {_least("u0", _add("a0", 5, "I"))}, {_least("a0", _add("u0", 5, "I"))}
  FROM (SELECT w.conv_id, w.k, {stepped} FROM way w JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.pos = w.k)),
best AS (SELECT conv_id, left(z, 9)::BIGINT AS cost, substr(z, 10) AS audit FROM way WHERE k = 0),
edits AS (
  SELECT conv_id, k, audit[k] AS edit, count(*) FILTER (audit[k] <> 'I') OVER w AS pos, count(*) FILTER (audit[k] <> 'D') OVER w AS place
  FROM best, unnest(range(1, len(audit) + 1)) AS x(k) WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
shown AS (
  SELECT e.conv_id, k, edit, place, r.role, r.initial, r.text, max(CASE WHEN place = 1 AND edit = 'K' AND r.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS off
  FROM edits e LEFT JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.pos = e.pos AND edit <> 'I' WHERE edit <> 'D'),
told AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - off) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY k) AS txt
  FROM shown GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(txt, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""


ORACLE_SQL = _oracle()
