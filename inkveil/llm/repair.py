"""Conversations put into shape by the cheapest edits, found by a Viterbi search
that hands on its decisions as soon as its survivors agree.

Rows of a conversation come one after another.  A state is what the repaired
conversation ends with so far: nothing, the system's turn, the user's or the
assistant's.  For each state the cheapest way there survives (of equally cheap
ones the one whose edits are least in ASCII order).  The ways are a tree of back
pointers: every node counts the nodes and survivors that refer to it, a node
without references goes, and as long as the root has one child and is no
survivor, all survivors share that child's edit, which is handed on with its
row.  So memory follows the edits that are still open, not the conversation.

A survivor goes as soon as another one can do whatever it might still do at
less cost in all; without that, the way that deletes every row so far would
survive to the end and keep everything open.

Inserted turns are counted with the edit of the row behind them (or with the
end).  Then two ways to the same row never have edits of which one begins the
other, and the order of two ways never changes later: it is the order of the
ways they come from, then of the last edits.  That order, kept for the few
survivors, compares the whole open edits of tied ways without reading them again.

Costs: keeping a row 0, giving it the role user or assistant 1, deleting it 2,
putting in an empty turn 5; a truncated row that stays 5 more.  Blank rows and
repeated ones must go.  The roles that stay have initials (s?(ua)+)?; a row
whose role is empty has no initial and cannot be kept as it is.

Defined cases: null roles and texts count as one blank, in the damage's key null
ids and turns too; rows of one turn come by role, then text; a null conversation
id is one conversation, and null turns come first; a conversation without rows
left has zeros, no edits and the digest of an empty text; an empty table gives
no rows.  Columns besides the named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from inkveil.llm.common import table
from inkveil.llm.turns import in_order, streamed

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
_COST = {KEEP: 0, REROLE: 1, DELETE: 2}
INSERTED, TRUNCATED_STAYS = 5, 5
BLANKS = "\x20\t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
#: What the conversation ends with so far.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: The state behind the next role, by state: kept initials, and the role that an edit may put there.
_KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
_NEXT = (USER, USER, ASSISTANT, USER)
#: The most it costs a way in one state (row) to do whatever a way in another (column) still does.
_IMITATES = ((0, 0, 5, 0), (10, 0, 5, 10), (7, 5, 0, 5), (2, 0, 5, 0))


def fault(text: str, again: bool) -> str:
    """The first fault of a row: blank, duplicate, truncated, or none."""
    core = text.strip(BLANKS)
    if not core:
        return "blank"
    if again:
        return "duplicate"
    return "" if core.endswith(ENDS) else "truncated"


class _Node:
    """One step of a way: the edits of a row, with those put in before it."""

    __slots__ = ("parent", "children", "held", "edits", "row")

    def __init__(self, parent: _Node | None, edits: str, row: tuple | None) -> None:
        self.parent, self.edits, self.row = parent, edits, row
        self.children: list[_Node] = []
        self.held = 0
        if parent is not None:
            parent.children.append(self)


class Search:
    """Takes rows one by one; gives back the edits on which all survivors agree."""

    def __init__(self) -> None:
        self.root = _Node(None, "", None)
        self.root.held = 1
        #: (state, cost, node), least open edits first.
        self.survivors = [(NOTHING, 0, self.root)]

    def push(self, initial: str, why: str, row: tuple) -> Iterator[tuple[str, tuple | None]]:
        """The edits, each with its row, that are settled once this row is known."""
        best: dict[int, tuple[int, int, str]] = {}
        stays = TRUNCATED_STAYS if why == "truncated" else 0
        for order, (state, cost, _) in enumerate(self.survivors):
            for inserted in range(3):
                options = [(DELETE, state)]
                if why in ("", "truncated"):
                    options.append((REROLE, _NEXT[state]))
                    if initial in _KEPT[state]:
                        options.append((KEEP, _KEPT[state][initial]))
                for edit, after in options:
                    way = (cost + _COST[edit] + (stays if edit != DELETE else 0), order, INSERT * inserted + edit)
                    if after not in best or way < best[after]:
                        best[after] = way
                state, cost = _NEXT[state], cost + INSERTED
        yield from self._go_on(best, row)

    def finish(self) -> tuple[int, list[tuple[str, tuple | None]]]:
        """The whole cost, and the edits that were still open."""
        best: dict[int, tuple[int, int, str]] = {}
        for order, (state, cost, _) in enumerate(self.survivors):
            for inserted in range(3):
                if state in (NOTHING, ASSISTANT):
                    best[NOTHING] = min(best.get(NOTHING, (cost, order, INSERT * inserted)), (cost, order, INSERT * inserted))
                state, cost = _NEXT[state], cost + INSERTED
        last = list(self._go_on(best, None))
        return self.survivors[0][1], last

    def _go_on(self, best: dict[int, tuple[int, int, str]], row: tuple | None) -> Iterator[tuple[str, tuple | None]]:
        ways = {
            state: way
            for state, way in best.items()
            if not any(other[0] + _IMITATES[by][state] < way[0] for by, other in best.items())
        }
        before = [node for _, _, node in self.survivors]
        after = []
        for state, (cost, order, edits) in sorted(ways.items(), key=lambda w: w[1][1:]):
            node = _Node(before[order], edits, row)
            node.held = 1
            after.append((state, cost, node))
        self.survivors = after
        for node in before:
            node.held -= 1
            while node.parent is not None and not node.children and not node.held:
                node.parent.children.remove(node)
                node = node.parent
        while len(self.root.children) == 1 and not self.root.held:
            (self.root,) = self.root.children
            self.root.parent = None
            for edit in self.root.edits:
                yield edit, None if edit == INSERT else self.root.row


EDITS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("edit", T.StringType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("fault", T.StringType()),
        T.StructField("new_role", T.StringType()),
        T.StructField("cost", T.LongType()),
    ]
)


def _repaired(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (conv_id, turn, role, text, again, gone) to rows of EDITS."""
    for conv_id, found in groupby(rows, key=itemgetter(0)):
        search, state = Search(), NOTHING

        def settled(edits):
            nonlocal state
            for edit, row in edits:
                if edit == INSERT:
                    state = _NEXT[state]
                    yield (conv_id, edit, None, None, "", "", _NAMES[state], INSERTED)
                    continue
                turn, role, text, why = row
                cost = _COST[edit] + (TRUNCATED_STAYS if why == "truncated" and edit != DELETE else 0)
                name = None
                if edit == REROLE:
                    state = _NEXT[state]
                    name = _NAMES[state]
                elif edit == KEEP:
                    state = _KEPT[state][role[:1]]
                    name = role
                yield (conv_id, edit, turn, role, text, why, name, cost)

        left = 0
        for _, turn, role, text, again, gone in found:
            if not gone:
                left += 1
                why = fault(text, again)
                yield from settled(search.push(role[:1], why, (turn, role, text, why)))
        yield from settled(search.finish()[1])
        if not left:
            yield (conv_id, None, None, None, None, None, None, 0)


def repaired(rows: DataFrame) -> DataFrame:
    """One row per edit, in order: see EDITS.

    ``rows`` has conv_id, turn, role and text, and may have ``gone``: rows that
    are not there any more, of which only the conversation's id counts.  A
    conversation of none but such rows gives one row without an edit.
    ``new_role`` is null for deleted rows; those with one, in order, are the
    repaired conversation.  The rows of a conversation are one partition's, one
    after another.
    """
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    blank = F.lit(" ")
    chosen = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), gone.alias("gone"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    alike = Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.col("turn").asc_nulls_first())
    marked = chosen.withColumn("again", F.row_number().over(alike) > 1)
    streams = in_order(marked.select("conv_id", "turn", "role", "text", "again", "gone"), "conv_id", *order)
    return streamed(streams, "text", EDITS, _repaired)


DIGESTS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        *(T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        T.StructField("audit", T.StringType()),
        T.StructField("repaired_sha256", T.StringType()),
    ]
)


def _digested(edits: Iterator[tuple]) -> Iterator[tuple]:
    for conv_id, found in groupby(edits, key=itemgetter(0)):
        faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        first = last = before = None
        turns = illegal = cost = 0
        audit: list[str] = []
        digest, between = hashlib.sha256(), ""
        for _, edit, turn, role, text, why, name, price in found:
            if edit is None:
                continue
            audit.append(edit)
            cost += price
            if edit != INSERT:
                if turn is not None and turn != last:
                    first, last, turns = turn if first is None else first, turn, turns + 1
                if why:
                    faults[why] += 1
                if before is not None:
                    illegal += before + role[:1] not in ("su", "ua", "au")
                before = role[:1]
            if name is not None:
                digest.update(f"{between}{name}:{text}".encode())
                between = "\n"
        gaps = last - first + 1 - turns if turns else 0
        yield (conv_id, gaps, *faults.values(), illegal, cost, "".join(audit), digest.hexdigest())


def digested(edits: DataFrame) -> DataFrame:
    """One row per conversation from its edits, which are in order in one partition."""
    return streamed(edits, "text", DIGESTS, _digested)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with made faults, by a checksum of id and turn; dropped rows are marked ``gone``."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(key) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1)))
    gone = kind == 0
    changed = rows.select(
        "conv_id",
        "turn",
        F.when(gone, "").when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(gone, "").otherwise(text).alias("text"),
        gone.alias("gone"),
        copies.alias("copy"),
    )
    return changed.drop("copy")


def repair_of_conversations(spark: SparkSession, directory: str) -> DataFrame:
    """Faults, cost, edits and the digest of the repaired text of every conversation."""
    rows = table(spark, directory, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return digested(repaired(damaged(rows)))


#: CRC-32 of an ASCII text, bit by bit.
_CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(k, ''),
  lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"""
#: Where an insertion, and a row by its initial, lead from each state.
_STATES_SQL = "(VALUES (0, 2, 'u', 'user'), (1, 2, 'u', 'user'), (2, 3, 'a', 'assistant'), (3, 2, 'u', 'user')) s(state, next, initial, name)"


def _inserted_sql(rows: str) -> str:
    """Ways (id, n, state, cost, audit, out, names...) with none, one or two turns put in."""
    columns = "id, n"
    one = "SELECT {c}, s.next AS state, cost + 5 AS cost, audit || 'I' AS audit, out || [s.name || ':'] AS out FROM {r} w JOIN {s} USING (state)"
    none = f"SELECT {columns}, state, cost, audit, out FROM {rows}"
    first = one.format(c=columns, r=rows, s=_STATES_SQL)
    second = one.format(c=columns, r=f"({first})", s=_STATES_SQL)
    return f"({none} UNION ALL {first} UNION ALL {second})"


ORACLE = f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT *, {_CRC_SQL} % 20 AS kind FROM c),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
i AS (SELECT conv_id, row_number() OVER () AS id FROM (SELECT DISTINCT conv_id FROM conversations)),
o AS (SELECT i.id, d.*, row_number() OVER (PARTITION BY i.id ORDER BY turn NULLS FIRST, role, text) AS n,
  regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS core FROM d JOIN i ON d.conv_id IS NOT DISTINCT FROM i.conv_id),
r AS (SELECT *, CASE WHEN core = '' THEN 'blank'
  WHEN row_number() OVER (PARTITION BY id, role, text ORDER BY n) > 1 THEN 'duplicate'
  WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY id ORDER BY n) AS before FROM o),
v AS (SELECT id, 0::BIGINT AS n, 0 AS state, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS out FROM i
  UNION ALL
  SELECT id, any_value(n) + 1, state, min(cost), min(struct_pack(cost := cost, audit := audit, out := out)).audit,
    min(struct_pack(cost := cost, audit := audit, out := out)).out FROM (
    SELECT w.id, w.n, e.state, w.cost + e.price + CASE WHEN r.fault = 'truncated' AND e.edit <> 'D' THEN 5 ELSE 0 END AS cost,
      w.audit || e.edit AS audit, w.out || e.row AS out
    FROM {_inserted_sql("v")} w JOIN r ON r.id = w.id AND r.n = w.n + 1 JOIN {_STATES_SQL} USING (state),
    LATERAL (SELECT unnest([
      struct_pack(edit := 'D', state := w.state, price := 2, row := []::VARCHAR[], ok := true),
      struct_pack(edit := 'R', state := s.next, price := 1, row := [s.name || ':' || r.text], ok := r.fault IN ('', 'truncated')),
      struct_pack(edit := 'K', state := s.next, price := 0, row := [r.role || ':' || r.text], ok := r.fault IN ('', 'truncated') AND r.initial = s.initial),
      struct_pack(edit := 'K', state := 1, price := 0, row := [r.role || ':' || r.text], ok := r.fault IN ('', 'truncated') AND w.state = 0 AND r.initial = 's')
    ], recursive := true)) e WHERE e.ok) GROUP BY id, state),
b AS (SELECT id, min(struct_pack(cost := cost, audit := audit, out := out)) AS best FROM {_inserted_sql("v")} w
  WHERE state IN (0, 3) AND n = coalesce((SELECT max(r.n) FROM r WHERE r.id = w.id), 0) GROUP BY id),
t AS (SELECT id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY id)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.cost::BIGINT AS cost, best.audit AS audit,
  sha256(array_to_string(best.out, chr(10))) AS repaired_sha256
FROM i JOIN b USING (id) LEFT JOIN t USING (id)
"""
