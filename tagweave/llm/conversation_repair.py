"""Cheapest repair of a conversation's turn structure: bidirectional Dijkstra over an edit lattice.

A conversation is right when its roles' first letters read ``(s?(ua)+)?``. A node of the lattice is the
number of rows dealt with and the state of that pattern; edges keep a row (0), rerole it to what the
pattern needs (1), delete it (2) or insert an empty turn (5); a truncated row that stays costs 5 more,
and blank rows and repeats must go. One heap searches from the beginning, one from the two ends that the
pattern accepts, until no cheaper and no equally cheap crossing can be left. Every edge on a cheapest
path is then known from one of the searches or crosses between them; among those paths the one whose
edits' first letters (the audit: D, I, K, R) come least in ASCII is walked. An audit fixes its path.

Rows of a conversation are sorted by turn (nulls first, then role and text hash) within its task and
streamed; a row is one letter of memory and 16 bytes of text hash for finding repeats, texts pass
through in a second stream that applies the audit. A conversation is repaired and hashed in order, which
is one task's work however long it is, at about a hundred bytes of memory a row. Audits of conversations
of one shape are remembered in a bounded table.

Odd rows: nulls in role and text are read as one space, so such a row is blank or its role fits nowhere;
null ids are one conversation; an empty or unknown role can only be reroled or deleted; rows of one turn
are all kept in the order above. Extra columns are ignored. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.jobs import prepare

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing read, after s, after u, after a. What a kept row of an initial leads to.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: Where the one turn that the pattern can take next (user, or assistant after a user) leads.
NEXT = (2, 2, 3, 2)
BEFORE = ((), (), (0, 1, 3), (2,))
ENDS = (0, 3)
#: Shapes of conversations whose repair a task remembers, and the longest that is.
SHAPES, SHAPE_ROWS = 1 << 14, 64
BLANK = "[^\\x20\\x09-\\x0D]"
WHOLE = "[.!?][\\x20\\x09-\\x0D]*\\z"


def _edges(shape: str, node: int) -> Iterator[tuple[str, int, int]]:
    """Edits of a node as (letter, cost, next node), by letter; a node is 4 * rows + state."""
    i, q = divmod(node, 4)
    row = shape[i] if i < len(shape) else ""
    if row:
        yield "D", DELETE, node + 4
    yield "I", INSERT, 4 * i + NEXT[q]
    if row and row != "#":
        more = TRUNCATED if row.isupper() else 0
        kept = STEP.get((q, row.lower()))
        if kept is not None:
            yield "K", KEEP + more, 4 * i + 4 + kept
        yield "R", REROLE + more, 4 * i + 4 + NEXT[q]


def _back(shape: str, node: int) -> Iterator[tuple[int, int]]:
    """Nodes with an edit that leads here, and its cost."""
    i, q = divmod(node, 4)
    for p in BEFORE[q]:
        yield 4 * i + p, INSERT
    if i:
        row = shape[i - 1]
        yield node - 4, DELETE
        if row != "#":
            more = TRUNCATED if row.isupper() else 0
            for p in BEFORE[q]:
                yield 4 * i - 4 + p, REROLE + more
            for p in range(4):
                if STEP.get((p, row.lower())) == q:
                    yield 4 * i - 4 + p, KEEP + more


def cheapest(shape: str) -> tuple[int, str]:
    """Least cost and least audit of a shape: a letter a row, its initial (s, u, a or x), upper case if
    the row is truncated, # if it must go."""
    nodes, far = 4 * len(shape) + 4, 1 << 60
    ahead, behind = [far] * nodes, [far] * nodes
    ended = bytearray(nodes), bytearray(nodes)
    heaps = [(0, 0)], [(0, nodes - 4 + q) for q in ENDS]
    ahead[0] = 0
    for _, end in heaps[1]:
        behind[end] = 0
    best = behind[0]
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        dist, other = (ahead, behind) if side == 0 else (behind, ahead)
        d, node = heappop(heaps[side])
        if ended[side][node]:
            continue
        ended[side][node] = 1
        steps = ((v, w) for _, w, v in _edges(shape, node)) if side == 0 else _back(shape, node)
        for v, w in steps:
            if d + w < dist[v]:
                dist[v] = d + w
                heappush(heaps[side], (d + w, v))
                best = min(best, d + w + other[v])
    for q in ENDS:  # settled, though perhaps not yet taken from the heap
        ended[1][nodes - 4 + q] = 1
    # Crossings of cheapest paths, and the nodes of the first search that lead to one.
    leads = bytearray(nodes)
    todo = []
    for u in range(nodes):
        if ended[0][u] and (
            (ended[1][u] and ahead[u] + behind[u] == best)
            or any(ended[1][v] and ahead[u] + w + behind[v] == best for _, w, v in _edges(shape, u))
        ):
            leads[u] = 1
            todo.append(u)
    while todo:
        v = todo.pop()
        for u, w in _back(shape, v):
            if ended[0][u] and not leads[u] and ahead[u] + w == ahead[v]:
                leads[u] = 1
                todo.append(u)
    audit, node, spent = [], 0, 0
    while not (spent == best and node // 4 == len(shape) and node % 4 in ENDS):
        for letter, w, v in _edges(shape, node):
            crossed = ended[1][v] and spent + w + behind[v] == best
            if crossed or (leads[v] and ahead[v] == spent + w):
                audit.append(letter)
                node, spent = v, spent + w
                break
        else:
            raise AssertionError(f"no cheapest path goes on from {node} of {shape!r}")
    return best, "".join(audit)


_remembered = lru_cache(SHAPES)(cheapest)


def solve(shape: str) -> tuple[int, str]:
    return _remembered(shape) if len(shape) <= SHAPE_ROWS else cheapest(shape)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that crc32(conv_id:turn) % 20 gives them, and gone for rows that it drops.

    Nulls are one space there, in roles and in texts.
    """
    space = F.lit(" ")
    text = F.coalesce(F.col("text").cast("string"), space)
    role = F.coalesce(F.col("role").cast("string"), space)
    key = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    kind = F.pmod(F.crc32(F.concat(key[0], F.lit(":"), key[1]).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    times = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"),
        (kind == 0).alias("gone"), F.explode(times).alias("_copy"),
    ).drop("_copy")


ORDER = ("turn", "role", "h1", "h2")
FOUND = "conv_id BIGINT, gaps BIGINT, blank BIGINT, duplicate BIGINT, truncated BIGINT, illegal BIGINT, cost BIGINT, audit STRING"
_FIELDS = [x.split()[0] for x in FOUND.split(", ")]


class _Conversation:
    """What is known of a conversation whose rows are passing."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.shape: list[str] = []
        self.seen: set[tuple[str, int, int]] = set()
        self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial = ""

    def add(self, turn: int | None, role: str, h1: int, h2: int, blank: bool, whole: bool) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        initial = role[:1]
        if self.shape and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        letter = initial if initial in ("s", "u", "a") else "x"
        said = (role, h1, h2)
        if blank:
            self.blank, letter = self.blank + 1, "#"
        elif said in self.seen:
            self.duplicate, letter = self.duplicate + 1, "#"
        elif not whole:
            self.truncated, letter = self.truncated + 1, letter.upper()
        self.seen.add(said)
        self.shape.append(letter)

    def found(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        cost, audit = solve("".join(self.shape))
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, out = None, []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for conv_id, turn, role, h1, h2, gone, blank, whole in zip(*columns):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    out.append(now.found())
                now = _Conversation(conv_id)
            if not gone:
                now.add(turn, role, h1, h2, blank, whole)
        if len(out) >= 1000:
            yield _table(out)
            out = []
    if now is not None:
        yield _table([*out, now.found()])


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], _FIELDS)


def _streamed(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def _named(rows: DataFrame) -> DataFrame:
    """The rows with conv_id, turn, role and text of fixed types, and what orders them."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    return rows.select(
        *[F.col(c).cast("bigint").alias(c) for c in ("conv_id", "turn")], role.alias("role"), text.alias("text"),
        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"), gone.alias("gone"),
    )


def _matches(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def audits(rows: DataFrame) -> DataFrame:
    """Faults, least cost and audit of each conversation of ``rows``: conv_id, turn, role, text, and
    gone for rows that only name their conversation."""
    prepare(rows.sparkSession)
    narrow = _named(rows).select(
        "conv_id", *ORDER, "gone", (~_matches(F.col("text"), BLANK)).alias("blank"),
        _matches(F.col("text"), WHOLE).alias("whole"),
    )
    return _streamed(narrow, *ORDER).mapInArrow(_find, FOUND)


def _with_audits(rows: DataFrame) -> DataFrame:
    """Each conversation's findings, then its rows, in order within one partition."""
    numbers = _FIELDS[1:-1]
    found = audits(rows).select(
        "conv_id", F.lit(0).alias("kind"), *[F.lit(None).cast("bigint").alias(c) for c in ("turn", "h1", "h2")],
        F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), *numbers,
    )
    texts = _named(rows).where("NOT gone").select(
        "conv_id", F.lit(1).alias("kind"), "turn", "h1", "h2", "role", "text",
        *[F.lit(None).cast("bigint").alias(c) for c in numbers],
    )
    both = found.unionByName(texts)
    return _streamed(both, "kind", *ORDER).select("conv_id", "kind", "role", "text", "turn", *numbers)


def _turns(batches: Iterator[pa.RecordBatch], begin, turn, end) -> Iterator:
    """Calls begin(found, audit), turn(letter, role, text, turn) for what a repair leaves, and end()."""
    letters, at, state, open_ = "", 0, 0, False

    def inserted():
        nonlocal at, state
        while at < len(letters) and letters[at] == "I":
            at, state = at + 1, NEXT[state]
            turn("I", "user" if state == 2 else "assistant", "", None)

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for conv_id, kind, role, text, number, *found in zip(*columns):
            if kind == 0:
                if open_:
                    inserted()
                    end()
                letters, at, state, open_ = text, 0, 0, True
                begin((conv_id, *found), text)
                continue
            inserted()
            letter, at = letters[at], at + 1
            if letter == "K":
                state = STEP[state, role[:1]]
                turn("K", role, text, number)
            elif letter == "R":
                state = NEXT[state]
                turn("R", "user" if state == 2 else "assistant", text, number)
        yield None
    if open_:
        inserted()
        end()
        yield None


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, now = [], []

    def begin(found, audit):
        now[:] = [found, audit, hashlib.sha256(), b""]

    def turn(letter, role, text, number):
        now[2].update(now[3] + f"{role}:{text}".encode())
        now[3] = b"\n"

    def end():
        out.append((*now[0], now[1], now[2].hexdigest()))

    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    for _ in _turns(batches, begin, turn, end):
        if out:
            columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays(columns, [*_FIELDS, "repaired_sha256"])
            out.clear()


def report(rows: DataFrame) -> DataFrame:
    """``audits`` with repaired_sha256: of the repaired ``role:text``, joined by newlines."""
    return _with_audits(rows).mapInArrow(_report, FOUND + ", repaired_sha256 STRING")


REPAIRED = "conv_id BIGINT, pos BIGINT, turn BIGINT, role STRING, text STRING, edit STRING"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, now = [], []

    def begin(found, audit):
        now[:] = [found[0], 0]

    def turn(letter, role, text, number):
        out.append((now[0], now[1], number, role, text, letter))
        now[1] += 1

    kinds = [pa.int64()] * 3 + [pa.string()] * 3
    for _ in _turns(batches, begin, turn, lambda: None):
        if out:
            names = [x.split()[0] for x in REPAIRED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
            out.clear()


def repaired(rows: DataFrame) -> DataFrame:
    """The turns of every repaired conversation with the edit (K, R or I) that each comes from."""
    return _with_audits(rows).mapInArrow(_repaired, REPAIRED)


def _least(*choices: str) -> str:
    return f"list_min([{', '.join(choices)}])"


def oracle() -> str:
    """Comparison SQL: the best rest of a conversation for each state, from its last row to its first."""
    step = {(q, s[0]): to for (q, s), to in STEP.items()}
    none = "{'c': 1000000000, 'a': '~', 't': []::VARCHAR[]}"
    done = "{'c': 0, 'a': '', 't': []::VARCHAR[]}"

    def after(cost: str, letter: str, rest: str, said: str | None) -> str:
        texts = f"list_prepend({said}, {rest}.t)" if said else f"{rest}.t"
        return f"{{'c': {rest}.c + {cost}, 'a': '{letter}' || {rest}.a, 't': {texts}}}"

    def who(q: int) -> str:
        return "user" if NEXT[q] == 2 else "assistant"

    def row(q: int) -> str:
        keep = [
            f"CASE WHEN f <> 'gone' AND r[1] = '{s}' THEN {after('p', 'K', f'b{to}', 'said')} ELSE {none} END"
            for (at, s), to in step.items() if at == q
        ]
        said = f"'{who(q)}:' || x"
        change = f"CASE WHEN f <> 'gone' THEN {after('1 + p', 'R', f'b{NEXT[q]}', said)} ELSE {none} END"
        return _least(after("2", "D", f"b{q}", None), *keep, change) + f" AS b{q}"

    def insert(columns: str, select: str, source: str) -> str:
        one = ", ".join(_least(f"b{q}", after("5", "I", f"b{NEXT[q]}", f"'{who(q)}:'")) + f" AS b{q}" for q in range(4))
        return f"SELECT {columns}, {one} FROM (SELECT {columns}, {one} FROM (SELECT {select} FROM {source}))"

    ends = ", ".join(f"{done if q in ENDS else none} AS b{q}" for q in range(4))
    rows = ", ".join(row(q) for q in range(4))
    from tagweave.llm.importance import CRC_SQL

    return rf"""
WITH RECURSIVE w AS (SELECT DISTINCT coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS f FROM conversations),
{CRC_SQL},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, crc % 20 AS kind
  FROM conversations JOIN crcs ON f = coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')),
m AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS r,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS x,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM k WHERE kind <> 0),
o AS (SELECT conv_id, turn, r, x, row_number() OVER w AS i, lag(r[1]) OVER w AS before,
    row_number() OVER (PARTITION BY conv_id, r, x ORDER BY turn NULLS FIRST, copy) AS nth
  FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, copy)),
t AS (SELECT conv_id, turn, r, x, i, before, CASE WHEN NOT regexp_matches(x, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(x, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM o),
c AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || r[1] NOT IN ('su', 'ua', 'au')) AS illegal
  FROM t GROUP BY conv_id),
d AS (
  SELECT conv_id, n::BIGINT AS i, b0, b1, b2, b3 FROM ({insert('conv_id, n', f'conv_id, n, {ends}', 'c')})
  UNION ALL
  SELECT conv_id, i, b0, b1, b2, b3 FROM ({insert('conv_id, i', f'conv_id, i, {rows}', f'''(SELECT d.conv_id, d.i - 1 AS i, r, x, b0, b1, b2, b3,
      CASE WHEN fault IN ('blank', 'duplicate') THEN 'gone' ELSE fault END AS f, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS p,
      r || ':' || x AS said
    FROM d JOIN t ON t.conv_id IS NOT DISTINCT FROM d.conv_id AND t.i = d.i)''')})),
all_ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b0.c, 0)::BIGINT AS cost, coalesce(b0.a, '') AS audit,
  sha256(coalesce(array_to_string(b0.t, chr(10)), '')) AS repaired_sha256
FROM all_ids a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN d ON d.conv_id IS NOT DISTINCT FROM a.conv_id AND d.i = 0
"""
