"""Repair of conversations: the cheapest edits after which roles alternate.

A conversation's turns are kept, reroled or deleted, and turns without text inserted, so that
the initials of its roles read ``(s?(ua)+)?``. What matters of a repair is which turns are
retained (kept or reroled) and as what. Between two retained turns lie deletions, whose price
is a difference of prefix sums, and inserts, which the two roles determine. So a pass over the
turns needs, for each role that the last retained turn may have (or none), only the cheapest
way there: its cost less the deletions so far. The audit, the edits' initials in order, goes
with it and breaks ties; no two ways to a turn have audits of which one begins the other.

Such passes chain: over a run of turns, from each role before to each role after it, there is
one cheapest way. So turns are sorted over the whole table by conversation and turn, each
partition's part of a conversation is a segment of its own, ways are found for each segment,
and a conversation joins those of its segments, at most one a partition. A conversation that
holds a third of all turns is no task's alone. Equal turns of one number are stored once
with their number, so that copies don't gather either; all but the first are duplicates.

Faults: a turn is blank (nothing but white space), else duplicate (role and text seen earlier
in the conversation), else truncated (its last character that isn't white space is no
``.!?``). Blank and duplicate turns must go; a truncated one costs more unless it goes.

Defined results: null ids are a conversation; turns are in order of number, nulls first, then
role, then text; null role or text is one space; an empty role has no initial and can't be
kept; a conversation without turns has cost 0 and no audit; an empty table gives an empty
result; columns other than the four are not read. A conversation's audit is one value, and its
digest is read in order by one task, a turn at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, shuffle_partitions, stored, table

NONE, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
#: What a truncated turn costs beside its edit, unless it goes.
UNFINISHED = 5
#: How many turns to insert between two retained ones, by the role of the first (or none) and of the second (none: the end).
#: Before a user's turn it is an assistant's and the reverse; at the end the last is an assistant's.
INSERTS = {
    (NONE, SYSTEM): 0, (NONE, USER): 0, (NONE, ASSISTANT): 1, (NONE, NONE): 0,
    (SYSTEM, USER): 0, (SYSTEM, ASSISTANT): 1, (SYSTEM, NONE): 2,
    (USER, USER): 1, (USER, ASSISTANT): 0, (USER, NONE): 1,
    (ASSISTANT, USER): 0, (ASSISTANT, ASSISTANT): 1, (ASSISTANT, NONE): 0,
}
SOUND, TRUNCATED, DUPLICATE, BLANK = range(4)
#: What becomes of a turn: deleted, kept, or reroled to user or assistant; in capitals, with an insert before it.
DELETED, KEPT, TO_USER, TO_ASSISTANT = PLANS = "dkua"
SPACES = " \t\n\x0b\x0c\r"
MARKS = ".!?"


class Ways:
    """The cheapest ways through a run of turns, from one role before it to each role after it.

    A way is a cost and the place of its audit among the others'; the steps taken are one byte
    a turn and role: the role before, whether a turn is inserted, and what becomes of the turn.
    """

    def __init__(self, role: int):
        self.now = {role: (0, 0)}
        self._steps = bytearray()
        self._copies: list[int] = []

    def add(self, initial: str, fault: int, copies: int) -> None:
        """One more turn; copies of it beyond the first are deleted."""
        gone = COST[DELETE] * copies
        found = {role: (cost + gone, rank, DELETE, role, 0) for role, (cost, rank) in self.now.items()}
        if fault in (SOUND, TRUNCATED):
            base = COST[DELETE] * (copies - 1) + (UNFINISHED if fault == TRUNCATED else 0)
            own = INITIALS.get(initial)
            for role in (SYSTEM, USER, ASSISTANT):
                if role == SYSTEM != own:
                    continue
                edit, plan = (KEEP, 1) if role == own else (REROLE, role)
                for before, (cost, rank) in self.now.items():
                    puts = INSERTS.get((before, role))
                    if puts is None:
                        continue
                    way = (cost + base + COST[edit] + COST[INSERT] * puts, rank, INSERT * puts + edit, before, plan | puts << 2)
                    if role not in found or way < found[role]:
                        found[role] = way
        order = sorted(found, key=lambda r: found[r][1:3])
        self.now = {role: (found[role][0], k) for k, role in enumerate(order)}
        for role in range(4):
            self._steps.append(found[role][3] | found[role][4] << 2 if role in found else 0)
        self._copies.append(copies)

    def trace(self, role: int) -> tuple[str, str]:
        """Audit and plans (one letter a turn) of the way to a role."""
        audit, plans = [], []
        for k in range(len(self._copies) - 1, -1, -1):
            step = self._steps[4 * k + role]
            plan, puts, copies = step >> 2 & 3, step >> 4, self._copies[k]
            edit = DELETE if not plan else KEEP if plan == 1 else REROLE
            audit.append(DELETE * copies if edit == DELETE else INSERT * puts + edit + DELETE * (copies - 1))
            plans.append(PLANS[plan].upper() if puts else PLANS[plan])
            role = step & 3
        return "".join(reversed(audit)), "".join(reversed(plans))


KEYS = ["c0", "c", "t0", "t", "role", "digest"]
WAYS = "array<struct<before:int,after:int,cost:bigint,audit:string,plans:string>>"
SEGMENT = f"c0 int, c long, seg long, pos long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first_initial string, last_initial string, ways {WAYS}"
_WAY = pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("plans", pa.string())])
_SEGMENT = pa.schema(
    [("c0", pa.int32()), *((c, pa.int64()) for c in ("c", "seg", "pos", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high")), ("first_initial", pa.string()), ("last_initial", pa.string()), ("ways", pa.list_(_WAY))]
)
RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
DECIDED = "c0 int, c long, pos long, plans string, last boolean, " + ", ".join(f"{c} long" for c in RESULT) + ", audit string, tail int"
_DECIDED = pa.schema([("c0", pa.int32()), ("c", pa.int64()), ("pos", pa.int64()), ("plans", pa.string()), ("last", pa.bool_()), *((c, pa.int64()) for c in RESULT), ("audit", pa.string()), ("tail", pa.int32())])


def _legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


class _Segment:
    """A conversation's turns in one partition, as they come."""

    def __init__(self, c0: int, c: int, seg: int, pos: int, begins: bool):
        self.place = {"c0": c0, "c": c, "seg": seg, "pos": pos}
        self.faults = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.low = self.high = self.first = self.last = None
        self.ways = {role: Ways(role) for role in ((NONE,) if begins else range(4))}

    def add(self, t0: int, t: int, initial: str, fault: int, again: int, copies: int) -> None:
        self.faults[fault] += 1
        self.faults[again] += copies - 1
        if self.last is not None:
            self.illegal += not _legal(self.last, initial)
        else:
            self.first = initial
        self.illegal += copies - 1  # no role follows itself
        self.last = initial
        if t0:
            self.turns += t != self.high
            self.low, self.high = t if self.low is None else self.low, t
        for way in self.ways.values():
            way.add(initial, fault, copies)

    def row(self) -> dict:
        ways = []
        for before, way in self.ways.items():
            for after, (cost, _) in way.now.items():
                audit, plans = way.trace(after)
                ways.append({"before": before, "after": after, "cost": cost, "audit": audit, "plans": plans})
        return self.place | {
            "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[TRUNCATED], "illegal": self.illegal,
            "turns": self.turns, "low": self.low, "high": self.high, "first_initial": self.first, "last_initial": self.last, "ways": ways,
        }


def _handed(rows: Iterator[dict], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ``size`` letters."""
    some, n = [], 0
    for row, letters in rows:
        some.append(row)
        n += 200 + letters
        if n > size:
            yield pa.RecordBatch.from_pylist(some, schema)
            some, n = [], 0
    if some:
        yield pa.RecordBatch.from_pylist(some, schema)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        now = None
        for batch in batches:
            for c0, c, pos, t0, t, initial, fault, again, copies in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                seg = pos >> 33
                if now is None or (c0, c, seg) != (now.place["c0"], now.place["c"], now.place["seg"]):
                    if now:
                        yield (row := now.row()), sum(2 * len(w["audit"]) for w in row["ways"])
                    # Only a partition's first turn may go on with a conversation of the one before.
                    now = _Segment(c0, c, seg, pos, begins=pos & (1 << 33) - 1 > 0)
                now.add(t0, t, initial, fault, again, copies)
        if now:
            yield (row := now.row()), sum(2 * len(w["audit"]) for w in row["ways"])

    yield from _handed(rows(), _SEGMENT, 2_000_000)


def _decide(segments: list[dict]) -> Iterator[dict]:
    """Joins the segments of a conversation: the way through each, and the whole's figures with the last."""
    now = {NONE: (0, 0)}
    taken = []
    for s in segments:
        found: dict[int, tuple] = {}
        for k, w in enumerate(s["ways"]):
            if w["before"] in now:
                cost, rank = now[w["before"]]
                way = (cost + w["cost"], rank, w["audit"], k)
                if w["after"] not in found or way < found[w["after"]]:
                    found[w["after"]] = way
        order = sorted(found, key=lambda r: found[r][1:3])
        now = {role: (found[role][0], k) for k, role in enumerate(order)}
        taken.append({role: way[3] for role, way in found.items()})
    # No audit begins another but by the inserts at the end, which cost.
    _, _, role = min((cost + COST[INSERT] * INSERTS[role, NONE], rank, role) for role, (cost, rank) in now.items())
    cost, tail = now[role][0] + COST[INSERT] * INSERTS[role, NONE], INSERTS[role, NONE]
    chosen = []
    for s, ways in zip(reversed(segments), reversed(taken), strict=True):
        way = s["ways"][ways[role]]
        chosen.append(way)
        role = way["before"]
    chosen.reverse()
    low = [s["low"] for s in segments if s["low"] is not None]
    high = [s["high"] for s in segments if s["high"] is not None]
    # A turn's number that goes over the edge of two segments counts once.
    turns = sum(s["turns"] for s in segments) - sum(a == b for a, b in zip(high, low[1:], strict=False))
    total = {c: sum(s[c] for s in segments) for c in ("blank", "duplicate", "truncated", "illegal")}
    total["illegal"] += sum(not _legal(a["last_initial"], b["first_initial"]) for a, b in zip(segments, segments[1:], strict=False))
    total |= {"gaps": high[-1] - low[0] + 1 - turns if low else 0, "cost": cost, "audit": "".join(w["audit"] for w in chosen) + INSERT * tail, "tail": tail}
    for k, (s, w) in enumerate(zip(segments, chosen, strict=True)):
        last = k == len(segments) - 1
        yield {"c0": s["c0"], "c": s["c"], "pos": s["pos"], "plans": w["plans"], "last": last} | (total if last else {})


def _decisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        own: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if own and (own[0]["c0"], own[0]["c"]) != (row["c0"], row["c"]):
                    yield from _decide(own)
                    own = []
                own.append(row)
        if own:
            yield from _decide(own)

    yield from _handed(((r, len(r["plans"]) + len(r.get("audit") or "")) for r in rows()), _DECIDED, 4_000_000)


class Repair:
    """Conversations and their turns after the cheapest repair."""

    def __init__(self, turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"):
        spark = turns.sparkSession
        parts = max(1, shuffle_partitions(spark))
        known = lambda c: F.col(c).isNotNull().cast("int")
        number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
        self._rows = turns.select(
            known(id_col).alias("c0"), number(id_col).alias("c"), known(turn_col).alias("t0"), number(turn_col).alias("t"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text")
        ).withColumn("digest", F.unhex(F.md5("text")))
        ends = F.rtrim(F.col("text"), F.lit(SPACES))
        state = F.when(ends == "", BLANK).when(~F.right(ends, F.lit(1)).isin(*MARKS), TRUNCATED).otherwise(SOUND)
        units = self._rows.select(*KEYS, state.alias("state")).groupBy(*KEYS, "state").agg(F.count(F.lit(1)).alias("copies"))
        firsts = units.groupBy("c0", "c", "role", "digest").agg(F.min(F.struct("t0", "t")).alias("first"))
        firsts = firsts.select("c0", "c", F.col("first.t0").alias("t0"), F.col("first.t").alias("t"), "role", "digest", F.lit(True).alias("is_first"))
        units = units.join(firsts, KEYS, "left")
        fault = F.when(F.col("state") == BLANK, BLANK).when(F.col("is_first").isNull(), DUPLICATE).otherwise(F.col("state"))
        again = F.when(F.col("state") == BLANK, BLANK).otherwise(DUPLICATE)
        units = units.select(*KEYS, fault.alias("fault"), again.alias("again"), "copies")
        self._units = stored(units.repartitionByRange(parts, *KEYS).sortWithinPartitions(*KEYS).withColumn("pos", F.monotonically_increasing_id()), "repair-turns")
        tiny = self._units.select("c0", "c", "pos", "t0", "t", F.left("role", F.lit(1)).alias("initial"), "fault", "again", "copies", F.shiftright("pos", 33).alias("seg"))
        tiny = tiny.repartition(parts, "c0", "c", "seg").sortWithinPartitions("c0", "c", "pos").drop("seg")
        segments = tiny.mapInArrow(frugal(_segments), SEGMENT).repartition(parts, "c0", "c").sortWithinPartitions("c0", "c", "seg")
        self._decided = stored(segments.mapInArrow(frugal(_decisions), DECIDED), "repair-plans")

    @staticmethod
    def _conv(name: str) -> Column:
        return F.when(F.col("c0") == 1, F.col("c")).alias(name)

    def conversations(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation that has turns."""
        return self._decided.where("last").select(self._conv("conv_id"), *RESULT, "audit")

    def _repaired(self) -> DataFrame:
        """(c0, c, pos, sub, edit, role, text); pos and sub give the order in a conversation."""
        plans = self._decided.select("pos", F.posexplode(F.split("plans", "")).alias("k", "plan")).select((F.col("pos") + F.col("k")).alias("pos"), "plan").where(f"plan <> '{DELETED}'")
        retained = self._units.select(*KEYS, "pos").join(plans, "pos")
        texts = self._rows.groupBy(*KEYS).agg(F.first("text").alias("text")).join(retained, KEYS)
        kind = F.lower("plan")
        role = F.when(kind == TO_USER, "user").when(kind == TO_ASSISTANT, "assistant").otherwise(F.col("role"))
        is_user = F.when(kind == KEPT, F.left("role", F.lit(1)) == "u").otherwise(kind == TO_USER)
        put = lambda r: F.struct(F.lit(0).alias("sub"), F.lit(INSERT).alias("edit"), r.alias("role"), F.lit("").alias("text"))
        own = F.struct(F.lit(1).alias("sub"), F.when(kind == KEPT, KEEP).otherwise(REROLE).alias("edit"), role.alias("role"), F.col("text").alias("text"))
        rows = F.when(F.col("plan") != kind, F.array(put(F.when(is_user, F.lit("assistant")).otherwise(F.lit("user"))), own)).otherwise(F.array(own))
        turns = texts.select("c0", "c", "pos", F.explode(rows).alias("x")).select("c0", "c", "pos", "x.*")
        tail = self._decided.where("last and tail > 0").select("c0", "c", F.lit((1 << 63) - 1).alias("pos"), F.posexplode(F.expr("slice(array('user', 'assistant'), -tail, tail)")).alias("sub", "role"))
        return turns.unionByName(tail.select("c0", "c", "pos", "sub", F.lit(INSERT).alias("edit"), "role", F.lit("").alias("text")))

    def turns(self) -> DataFrame:
        """(conv_id, place, sub, edit, role, text): the repaired turns, in the order of place and sub."""
        return self._repaired().select(self._conv("conv_id"), F.col("pos").alias("place"), "sub", "edit", "role", "text")

    def digests(self) -> DataFrame:
        """(conv_id, repaired_sha256): of the turns as ``role:text``, joined by newlines; read in order, a turn at a time."""
        spark = self._units.sparkSession
        rows = self._repaired().repartition(max(1, shuffle_partitions(spark)), "c0", "c").sortWithinPartitions("c0", "c", "pos", "sub")
        found = rows.select("c0", "c", F.concat_ws(":", "role", "text").alias("line")).mapInArrow(frugal(_hashed), "c0 int, c long, repaired_sha256 string")
        return found.select(self._conv("conv_id"), "repaired_sha256")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("c0", pa.int32()), ("c", pa.int64()), ("repaired_sha256", pa.string())])
    now, digest = None, None
    done: list[tuple] = []

    def handed():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        for c0, c, line in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if (c0, c) != now:
                if digest:
                    done.append((*now, digest.hexdigest()))
                now, digest = (c0, c), hashlib.sha256(line.encode())
            else:
                digest.update(b"\n")
                digest.update(line.encode())
        if len(done) > 10_000:
            yield handed()
            done = []
    if digest:
        done.append((*now, digest.hexdigest()))
    if done:
        yield handed()


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults that the checksum of ``conv_id:turn`` chooses: one in twenty each is dropped, emptied, unpunctuated, repeated, or made the user's."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", MARKS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), times)).alias("time")).drop("time")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    fixed = Repair(damaged(turns))
    out = fixed.conversations().join(fixed.digests().withColumnRenamed("conv_id", "d"), F.col("conv_id").eqNullSafe(F.col("d")), "left").drop("d").withColumnRenamed("conv_id", "k")
    whole = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().join(out, F.col("conv_id").eqNullSafe(F.col("k")), "left").drop("k")
    empty = hashlib.sha256(b"").hexdigest()
    return whole.fillna(0, RESULT).fillna("", ["audit"]).fillna(empty, ["repaired_sha256"])


# A plain edit automaton over the turns, state by state, with inserts as steps of their own: n nothing yet, s, u and x the
# last turn the system's, the user's, the assistant's. Each holds the least (cost, audit) and the text that it gives.
OP13_SQL = r"""
WITH o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
k AS (
  SELECT *, xor(list_reduce(list_transform(string_split(name, ''), lambda c: ord(c)::BIGINT),
    lambda h, b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda g, i: xor(g >> 1, CASE WHEN g & 1 = 1 THEN 3988292384 ELSE 0 END), xor(h, b)), 4294967295::BIGINT), 4294967295) % 20 AS kind
  FROM o),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS time
  FROM k WHERE kind <> 0),
p AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM d),
f AS (
  SELECT *, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS was,
    CASE WHEN body = '' THEN 3 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault
  FROM p),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 3) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
    count(*) FILTER (was IS NOT NULL AND was || ini NOT IN ('su', 'ua', 'au')) AS illegal, list({'ini': ini, 'fault': fault, 'role': role, 'text': text} ORDER BY place) AS rows
  FROM f GROUP BY 1),
w AS (
  SELECT * EXCLUDE rows, list_reduce(rows, lambda q, t: list_transform([least(q.u, {'c': q.n.c + 5, 'a': q.n.a || 'I', 'r': q.n.r || chr(10) || 'user:'}, {'c': q.s.c + 5, 'a': q.s.a || 'I', 'r': q.s.r || chr(10) || 'user:'}, {'c': q.x.c + 5, 'a': q.x.a || 'I', 'r': q.x.r || chr(10) || 'user:'})],
      lambda u: list_transform([least(q.x, {'c': u.c + 5, 'a': u.a || 'I', 'r': u.r || chr(10) || 'assistant:'})],
        lambda x: list_transform([least(q.n, q.s, x)],
          lambda z: {
            'n': {'c': q.n.c + 2, 'a': q.n.a || 'D', 'r': q.n.r},
            's': least({'c': q.s.c + 2, 'a': q.s.a || 'D', 'r': q.s.r}, {'c': q.n.c + CASE WHEN t.fault > 1 OR t.ini <> 's' THEN 1000000000 ELSE 5 * t.fault END, 'a': q.n.a || 'K', 'r': q.n.r || chr(10) || t.role || ':' || t.text}),
            'u': least({'c': q.u.c + 2, 'a': q.u.a || 'D', 'r': q.u.r}, {'c': z.c + CASE WHEN t.fault > 1 THEN 1000000000 ELSE 5 * t.fault END + CASE WHEN t.ini = 'u' THEN 0 ELSE 1 END, 'a': z.a || CASE WHEN t.ini = 'u' THEN 'K' ELSE 'R' END, 'r': z.r || chr(10) || CASE WHEN t.ini = 'u' THEN t.role ELSE 'user' END || ':' || t.text}),
            'x': least({'c': q.x.c + 2, 'a': q.x.a || 'D', 'r': q.x.r}, {'c': u.c + CASE WHEN t.fault > 1 THEN 1000000000 ELSE 5 * t.fault END + CASE WHEN t.ini = 'a' THEN 0 ELSE 1 END, 'a': u.a || CASE WHEN t.ini = 'a' THEN 'K' ELSE 'R' END, 'r': u.r || chr(10) || CASE WHEN t.ini = 'a' THEN t.role ELSE 'assistant' END || ':' || t.text})
          })[1])[1])[1],
      {'n': {'c': 0::BIGINT, 'a': '', 'r': ''}, 's': {'c': 1000000000::BIGINT, 'a': '', 'r': ''}, 'u': {'c': 1000000000::BIGINT, 'a': '', 'r': ''}, 'x': {'c': 1000000000::BIGINT, 'a': '', 'r': ''}}) AS q
  FROM g),
e AS (
  SELECT * EXCLUDE q, least(q.n, q.x, {'c': q.u.c + 5, 'a': q.u.a || 'I', 'r': q.u.r || chr(10) || 'assistant:'}, {'c': q.s.c + 10, 'a': q.s.a || 'II', 'r': q.s.r || chr(10) || 'user:' || chr(10) || 'assistant:'}) AS best
  FROM w)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.r[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
