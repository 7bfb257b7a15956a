"""Operator 12: conversations are repaired by error-correcting Earley parsing.

A conversation is well formed if its roles are, by their initials, nothing or an optional system
turn and then pairs of user and assistant turns. The role grammar has this in left-regular form::

    Whole -> Done $      Done -> (nothing)     Done -> Asked a
    Asked -> Done u      Asked -> Sys u        Sys -> s

Error productions are weighted: a terminal may stand for a turn of another role (rerole, user and
assistant only), for no turn at all (insert, likewise), and may have turns before it that go
(delete). A chart column holds items, a rule with a dot; each keeps its least (cost, audit), the
audit being the initials of the edits so far. As the grammar is left-regular, each item starts
at the first column, so that columns behind the latest are not needed and a parse takes linear time.
Audits are shared chains: two of equal cost are compared from where they part. Equal costs never
have an audit and the beginning of it, so the least audit stays the least whatever follows.

What all items of a column have in common is settled: its letters join the audit, its turns
the digest or the repaired turns. A task reads its conversations in order, so that it holds
what is not settled, whatever a conversation's length. A digest over a conversation is taken
turn by turn, which one task has to do; rows get to it sorted, by way of disk if need be.

Cases: null roles and texts, and null conv_ids and turns within the key that decides the damage, are
one space; rows without a conv_id are one conversation; rows of equal turn are taken by role and text;
texts of any length are read whole; a repeated row is a duplicate; roles other than the three
have to be reroled or deleted; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_schema, returned, table

RULES = [("Whole", ("Done", "$")), ("Done", ()), ("Done", ("Asked", "a")), ("Asked", ("Done", "u")), ("Asked", ("Sys", "u")), ("Sys", ("s",))]
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: An item that costs over this more than the least of its column is in no cheapest repair: from any
#: item, one turn inserted and the system turn deleted, or two turns inserted, give all that another leads to.
REACH = max(INSERT + DELETE, 2 * INSERT)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
WHITE = " \t\n\v\f\r"
#: Rows after which settled edits are looked for.
SETTLE = 256

_NAMES = {lhs for lhs, _ in RULES}
#: Of each item (rule, dot): the terminal after the dot, if any.
NEXT = {(r, d): rhs[d] for r, (_, rhs) in enumerate(RULES) for d in range(len(rhs)) if rhs[d] not in _NAMES}
#: Items that wait at their start for a nonterminal, after it.
AFTER = {name: [(r, 1) for r, (_, rhs) in enumerate(RULES) if rhs and rhs[0] == name] for name in _NAMES}
WHOLE = {(r, len(rhs)): lhs for r, (lhs, rhs) in enumerate(RULES)}
ACCEPT = (0, 1)


class Node:
    """An edit, after those of its parent."""

    __slots__ = ("parent", "letter", "turn", "length")

    def __init__(self, parent: Node | None, letter: str, turn: tuple[str, str] | None, length: int):
        self.parent, self.letter, self.turn, self.length = parent, letter, turn, length


def _parted(a: Node, b: Node) -> tuple[Node, list[str], list[str]]:
    """Where two chains part, and their letters after that."""
    x, y = [], []
    while a is not b:
        if a.length >= b.length:
            x.append(a.letter)
            a = a.parent
        else:
            y.append(b.letter)
            b = b.parent
    return a, x[::-1], y[::-1]


class Parser:
    """Takes the turns of a conversation one by one; ``settled`` gets each settled edit once:
    its letter and the turn it leaves, if any."""

    def __init__(self, settled: Callable[[str, tuple[str, str] | None], None]):
        self.settled, self.rows = settled, 0
        self.root = Node(None, "", None, 0)
        self.column: dict[tuple[int, int], tuple[int, Node]] = {}
        # prediction adds items with the dot at their start, to the first column only
        for r, (_, rhs) in enumerate(RULES):
            if not rhs or rhs[0] not in _NAMES:
                self.column[r, 0] = (0, self.root)
        self._close(self.column)

    @staticmethod
    def _put(column: dict, item: tuple[int, int], cost: int, parent: Node, letter: str = "", turn: tuple[str, str] | None = None) -> bool:
        """Keep the least (cost, audit) of an item; an edit without a letter is none."""
        old = column.get(item)
        if old and old[0] < cost:
            return False
        node = Node(parent, letter, turn, parent.length + 1) if letter else parent
        if old and old[0] == cost:
            if old[1] is node:
                return False
            _, mine, other = _parted(node, old[1])
            if mine >= other:
                return False
        column[item] = (cost, node)
        return True

    def _close(self, column: dict) -> None:
        """Completions and insertions, until no item gets better."""
        agenda = list(column)
        while agenda:
            item = agenda.pop()
            cost, node = column[item]
            if name := WHOLE.get(item):
                agenda += [x for x in AFTER[name] if self._put(column, x, cost, node)]
            elif (t := NEXT.get(item)) in ROLES:
                x = (item[0], item[1] + 1)
                if self._put(column, x, cost + INSERT, node, "I", (ROLES[t], "")):
                    agenda.append(x)

    def turn(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        column: dict[tuple[int, int], tuple[int, Node]] = {}
        initial, more = role[:1], TRUNCATED * truncated
        for item, (cost, node) in self.column.items():
            t = NEXT.get(item)
            if t is None:
                continue
            self._put(column, item, cost + DELETE, node, "D")
            if must_go:
                continue
            x = (item[0], item[1] + 1)
            if initial == t:
                self._put(column, x, cost + more, node, "K", (role, text))
            elif t in ROLES:
                self._put(column, x, cost + REROLE + more, node, "R", (ROLES[t], text))
        self._close(column)
        most = min(cost for cost, _ in column.values()) + REACH
        self.column = {item: x for item, x in column.items() if item in NEXT and x[0] <= most}
        self.rows += 1
        if self.rows % SETTLE == 0:
            live = [node for _, node in self.column.values()]
            common = live[0]
            for node in live[1:]:
                common, _, _ = _parted(common, node)
            self._settle(common)

    def _settle(self, last: Node) -> None:
        path, node = [], last
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            self.settled(node.letter, node.turn)
        last.parent, self.root = None, last

    def end(self) -> int:
        """The cost of the repair."""
        cost, node = self.column[ACCEPT]  # never out of reach: two turns inserted lead to it
        self._settle(node)
        return cost


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, live, copy): rows with the damage that their key decides.
    A row that is dropped stays as one that isn't live, so that its conversation is known."""
    space = F.lit(" ")
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    return conversations.select(
        "conv_id", "turn", (kind != 0).alias("live"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def ordered(rows: DataFrame) -> DataFrame:
    """Conversations whole in their partitions, in order, with ``again``: the role and text
    came earlier. One exchange; the window and the order are two sorts after it."""
    order = [F.col("turn").asc_nulls_first(), "role", "text", "copy"]
    dealt = rows.repartition("conv_id")
    first = F.row_number().over(Window.partitionBy("conv_id", "live", "role", "text").orderBy(*order))
    marked = dealt.withColumn("again", first > 1)
    return marked.select("conv_id", "turn", "role", "text", "live", "again").sortWithinPartitions("conv_id", "live", *order[:3], "again")


class Found:
    """The counts of a conversation, and its parse."""

    def __init__(self, conv_id: int | None, settled: Callable[[str, tuple[str, str] | None], None]):
        self.conv_id, self.parser = conv_id, Parser(settled)
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = self.initial = None

    def row(self, turn: int | None, role: str, text: str, again: bool) -> None:
        bare = text.rstrip(WHITE)
        blank = not bare
        duplicate = not blank and again
        truncated = not blank and not again and bare[-1] not in ".!?"
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in LEGAL
        self.initial = role[:1]
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.most
            self.most = turn
        self.parser.turn(role, text, blank or duplicate, truncated)

    def counts(self) -> tuple[int, ...]:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.parser.end()


def _conversations(batches: Iterator[pa.RecordBatch], begin: Callable) -> Iterator:
    """Feeds ordered rows to ``begin(conv_id)``, which gives (found, whole): whole() makes the
    row or rows of a conversation that is over."""
    now = None
    for batch in batches:
        for conv_id, turn, role, text, live, again in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if now is None or now[0].conv_id != conv_id:
                if now:
                    yield now[1]()
                now = begin(conv_id)
            if live:
                now[0].row(turn, role, text, again)
    if now:
        yield now[1]()


REPAIRED = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
TURNS = "conv_id long, position long, role string, text string"


def _mapped(rows: DataFrame, schema: str, begin: Callable) -> DataFrame:
    target = arrow_schema(rows.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def out():
            columns = list(zip(*held, strict=True)) or [()] * len(target)
            made = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, target, strict=True)], schema=target)
            held.clear()
            return made

        for some in _conversations(batches, begin):
            held += some
            if len(held) >= 1000:
                yield out()
        yield out()
        returned()

    return ordered(rows).mapInArrow(run, schema)


def _digesting(conv_id):
    audit, digest, lines = [], sha256(), [0]

    def settled(letter, turn):
        audit.append(letter)
        if turn:
            digest.update((("\n" if lines[0] else "") + f"{turn[0]}:{turn[1]}").encode("utf-8", "surrogatepass"))
            lines[0] += 1

    found = Found(conv_id, settled)

    def whole():
        counts = found.counts()
        return [(conv_id, *counts, "".join(audit), digest.hexdigest())]

    return found, whole


def _listing(conv_id):
    out = []
    found = Found(conv_id, lambda letter, turn: turn and out.append((conv_id, len(out), *turn)))

    def whole():
        found.parser.end()
        return out

    return found, whole


def repairs(rows: DataFrame) -> DataFrame:
    """For each conversation of ``rows`` (as from ``damaged``) the faults, the cost and
    the edits of the cheapest repair, and the digest of the repaired turns."""
    return _mapped(rows, REPAIRED, _digesting)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired turns themselves; a conversation's are held by its task."""
    return _mapped(rows, TURNS, _listing)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs(damaged(table(spark, sf_dir, "conversations")))



SQL = r"""
WITH RECURSIVE t AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
  FROM (SELECT unnest(range(256)) AS i)
), k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), d AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::BIGINT)),
    lambda c, b: xor(c >> 8, crc[xor(c, b) % 256 + 1])), 4294967295) % 20 AS kind FROM k, t
), live AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM d, (SELECT unnest([0, 1]) AS copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), counted AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM live
), o AS MATERIALIZED (
  SELECT *, row_number() OVER w AS i, lag(substr(role, 1, 1)) OVER w AS before, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last
  FROM counted WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth)
), f AS MATERIALIZED (
  SELECT *, substr(role, 1, 1) AS r, last = '' AS blank, last <> '' AND nth > 1 AS duplicate, last <> '' AND nth = 1 AND NOT regexp_matches(last, '[.!?]') AS truncated FROM o
), ins AS (SELECT * FROM (VALUES (0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'), (2, 2, ''), (2, 3, 'I'), (3, 3, ''), (3, 2, 'I')) v(p, q, i)
), use AS (SELECT * FROM (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')) v(q, s, want)
), step AS (
  SELECT p, s, want, i AS inserted FROM ins JOIN use USING (q) UNION ALL SELECT p, q, NULL, i FROM ins
), run AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, row(0::BIGINT, '') AS best FROM (SELECT DISTINCT conv_id FROM f)
  UNION ALL
  SELECT run.conv_id, f.i, step.s, min(row(best[1] + 3 * length(inserted) + CASE WHEN want IS NULL THEN 4 ELSE 3 * (f.r <> want)::INT + 3 * truncated::INT END,
    best[2] || inserted || CASE WHEN want IS NULL THEN 'D' WHEN f.r = want THEN 'K' ELSE 'R' END))
  FROM run JOIN f ON f.conv_id IS NOT DISTINCT FROM run.conv_id AND f.i = run.i + 1
  JOIN step ON step.p = run.state AND (want IS NULL OR NOT blank AND NOT duplicate AND (f.r = want OR want <> 's')) GROUP BY ALL
), final AS (
  SELECT run.conv_id, min(row(best[1] + 3 * length(inserted), best[2] || inserted)) AS best
  FROM run JOIN (SELECT conv_id, max(i) AS n FROM f GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM run.conv_id AND m.n = run.i
  JOIN (VALUES (0, ''), (1, 'II'), (2, 'I'), (3, '')) e(state, inserted) ON e.state = run.state GROUP BY run.conv_id
), letters AS (
  SELECT conv_id, p, substr(best[2], p, 1) AS letter FROM (SELECT *, unnest(range(1, length(best[2]) + 1)) AS p FROM final)
), edits AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS n FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY p)
), turns AS (
  SELECT e.conv_id, e.p, e.n, letter, f.role, f.text, max((letter = 'K' AND e.n = 1 AND f.r = 's')::INT) OVER (PARTITION BY e.conv_id) AS sys
  FROM edits e LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i AND letter <> 'I' WHERE letter <> 'D'
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (n - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS body
  FROM turns GROUP BY conv_id
), c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, sum(blank::INT)::BIGINT AS blank, sum(duplicate::INT)::BIGINT AS duplicate,
    sum(truncated::INT)::BIGINT AS truncated, count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best[1], 0) AS cost, coalesce(best[2], '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids
LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN final ON final.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN repaired ON repaired.conv_id IS NOT DISTINCT FROM ids.conv_id
"""
