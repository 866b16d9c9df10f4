"""Repair of conversation structure by block tables of edit costs (Four Russians)."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.rowid import with_row_id
from tarn.functions.sizes import broadcast_if_small
from tarn.session import durable

DELETE, INSERT, REROLE, CUT_OFF = 2, 5, 1, 5
#: Rows up to which a conversation is repaired in one go; longer ones are cut into pieces.
LONG = 4096
PIECE = 1024
#: Ids of long conversations that are sent to all tasks at most.
BROADCAST_ROWS = 100_000

#: States of the role initials ``(s?(ua)+)?`` written so far, and the state after one more
#: user or assistant, which is also what an inserted or changed row becomes.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}

#: Symbols: nothing, a row that must go, and 2 + 2 * (initial s, u, a, other) + (cut off).
SYMBOLS, PAD, GONE = 10, 0, 1
BLOCK = 3
FAR = 1 << 40
SPACE = " \t\n\x0b\x0c\r"

COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
RESULT = f"conv_id long, {COUNTS}, audit string, repaired_sha256 string"


def _choices(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that use up a row."""
    yield "D", DELETE, state
    if symbol > GONE:
        initial, more = (symbol - 2) // 2, CUT_OFF * (symbol & 1)
        if (state, initial) in KEPT:
            yield "K", more, KEPT[state, initial]
        yield "R", REROLE + more, NEXT[state]


def _closed(costs: list[int]) -> tuple[int, ...]:
    """Costs from each state to the end when rows may be inserted first."""
    out = list(costs)
    for _ in range(3):
        out = [min(c, INSERT + out[NEXT[s]]) for s, c in enumerate(out)]
    return tuple(min(c, FAR) for c in out)


def _before(symbol: int, costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end from before a row, given those from after it."""
    if symbol == PAD:
        return costs
    return _closed([min(c + costs[s] for _, c, s in _choices(symbol, state)) for state in range(4)])


def _normal(costs: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    low = min(costs)
    return tuple(FAR if c >= FAR else c - low for c in costs), low


class BlockTables:
    """What every block of ``BLOCK`` symbols does to every normalised vector of costs.

    The differences between the costs of the four states are bounded, so the vectors that can
    come up are few. They are found once, from the accepting vector and from the four that
    end in one state (for the pieces of long conversations).
    """

    def __init__(self):
        self.accept = _closed([0, FAR, FAR, 0])
        self.units = [_closed([0 if s == end else FAR for s in range(4)]) for end in range(4)]
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        for v in [self.accept, *self.units]:
            self.id_of(_normal(v)[0])
        follow, added = [], []
        for v in self.vectors:  # grows while it is read
            steps = [_normal(_before(x, v)) for x in range(SYMBOLS)]
            follow.append([self.id_of(n) for n, _ in steps])
            added.append([a for _, a in steps])
        one, cost = np.array(follow), np.array(added)
        follow, added = one, cost
        for _ in range(BLOCK - 1):
            # The block grows by a symbol in front of it.
            added = np.concatenate([added + cost[follow, x] for x in range(SYMBOLS)], axis=1)
            follow = np.concatenate([one[follow, x] for x in range(SYMBOLS)], axis=1)
        self.width = SYMBOLS**BLOCK
        self.follow, self.added = follow.reshape(-1).tolist(), added.reshape(-1).tolist()
        self.known: dict[tuple[int, int, int], tuple[str, int]] = {}

    def id_of(self, vector: tuple[int, ...]) -> int:
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector]

    @staticmethod
    def codes(symbols: list[int]) -> list[int]:
        full = symbols + [PAD] * (-len(symbols) % BLOCK)
        out = full[::BLOCK]
        for k in range(1, BLOCK):
            out = [c * SYMBOLS + x for c, x in zip(out, full[k::BLOCK], strict=True)]
        return out

    def costs(self, codes: list[int], end: tuple[int, ...]) -> tuple[tuple[int, ...], list[int]]:
        """Costs from before the blocks, given those from after them, and the number of the
        vector after each block. One lookup a block, from the last one back."""
        vector, low = _normal(end)
        at, after = self.id_of(vector), []
        for code in reversed(codes):
            after.append(at)
            cell = at * self.width + code
            low += self.added[cell]
            at = self.follow[cell]
        return tuple(min(c + low, FAR) for c in self.vectors[at]), after[::-1]

    def trace(self, codes: list[int], after: list[int], state: int) -> tuple[str, int]:
        """The least letters of a cheapest way from ``state``, and the state behind it."""
        out = []
        for code, at in zip(codes, after, strict=True):
            key = (code, at, state)
            if key not in self.known:
                self.known[key] = self._expand(*key)
            letters, state = self.known[key]
            out.append(letters)
        return "".join(out), state

    def _expand(self, code: int, at: int, state: int) -> tuple[str, int]:
        """One block again, symbol by symbol: costs from its end back, then its letters. A
        letter is taken if some cheapest way goes on with it, so the least one is safe."""
        symbols = [code // SYMBOLS**k % SYMBOLS for k in reversed(range(BLOCK))]
        costs = [self.vectors[at]]
        for x in reversed(symbols):
            costs.insert(0, _before(x, costs[0]))
        out = []
        for x, here, behind in zip(symbols, costs[:-1], costs[1:], strict=True):
            while x != PAD:
                ways = [(a, s, True) for a, c, s in _choices(x, state) if c + behind[s] == here[state]]
                if INSERT + here[NEXT[state]] == here[state]:
                    ways.append(("I", NEXT[state], False))
                letter, state, used = min(ways)
                out.append(letter)
                if used:
                    break
        return "".join(out), state

    def close(self, state: int) -> tuple[str, int]:
        """The inserts that end a conversation properly."""
        out = ""
        while state not in (START, ASSISTANT):
            out, state = out + "I", NEXT[state]
        return out, state


_TABLES: list[BlockTables] = []


def tables() -> BlockTables:
    if not _TABLES:
        _TABLES.append(BlockTables())
    return _TABLES[0]


def symbol_of(role: str, text: str, repeated: bool) -> tuple[int, str]:
    """The symbol of a row and its first fault."""
    words = text.rstrip(SPACE)
    if not words:
        return GONE, "blank"
    if repeated:
        return GONE, "duplicate"
    cut_off = words[-1] not in ".!?"
    initial = "sua".find(role[:1]) if role else 3
    return 2 + 2 * (initial if initial >= 0 else 3) + cut_off, "truncated" if cut_off else ""


class Summary:
    """What a stretch of rows tells about faults; stretches of one conversation add up."""

    def __init__(self):
        self.faults = {"": 0, "blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.n_turns = 0
        self.low = self.high = self.first = self.last = None

    def add(self, turn: int | None, role: str, fault: str) -> None:
        self.faults[fault] += 1
        self.join(turn, turn, int(turn is not None), role[:1], role[:1], 0)

    def join(self, low: int | None, high: int | None, n_turns: int, first: str, last: str, illegal: int) -> None:
        """Go on with rows that follow; turns ascend, so only the border can be shared."""
        self.n_turns += n_turns - (low is not None and low == self.high)
        if self.low is None:
            self.low = low
        self.high = self.high if high is None else high
        if self.last is None:
            self.first = first
        else:
            self.illegal += self.last + first not in ("su", "ua", "au")
        self.illegal += illegal
        self.last = last

    def columns(self) -> tuple[int, ...]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.n_turns
        return (gaps, *(self.faults[k] for k in ("blank", "duplicate", "truncated")), self.illegal)


class Digest:
    """SHA-256 of ``role:text`` lines, fed row by row."""

    def __init__(self):
        self.sha, self.empty = hashlib.sha256(), True

    def line(self, role: str, text: str) -> None:
        self.sha.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def apply(self, letter: str, state: int, role: str, text: str) -> int:
        """The state after an edit; what it keeps is fed."""
        if letter == "D":
            return state
        if letter == "K":
            self.line(role, text)
            return KEPT[state, "sua".find(role[:1])]
        self.line(ROLE[NEXT[state]], "" if letter == "I" else text)
        return NEXT[state]


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the faults that a checksum of id and turn chooses.

    Null ids, turns, roles and texts count as one space. Rows that are dropped stay as rows
    without role and text, so that their conversation is known.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(name) % 20
    return conversations.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.when(kind == 0, F.lit(None)).when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 0, F.lit(None))
        .when(kind == 1, F.lit(""))
        .when(kind == 2, F.translate(text, ".!?", ""))
        .otherwise(text)
        .alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def _whole(rows: DataFrame) -> DataFrame:
    """The repaired conversations of ``rows``, each held by one task, one at a time."""

    def repaired(conv: int | None, turns: list[tuple[int | None, str, str]]) -> tuple:
        t, summary, seen, symbols = tables(), Summary(), set(), []
        for turn, role, text in turns:
            symbol, fault = symbol_of(role, text, (role, text) in seen)
            seen.add((role, text))
            symbols.append(symbol)
            summary.add(turn, role, fault)
        codes = t.codes(symbols)
        costs, after = t.costs(codes, t.accept)
        audit, state = t.trace(codes, after, START)
        audit += t.close(state)[0]
        digest, state, rest = Digest(), START, iter(turns)
        for letter in audit:
            _, role, text = (None, "", "") if letter == "I" else next(rest)
            state = digest.apply(letter, state, role, text)
        return (conv, *summary.columns(), costs[START], audit, digest.sha.hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turns, started, out = None, [], False, []
        for batch in batches:
            for i, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if started and i != conv:
                    out.append(repaired(conv, turns))
                    turns = []
                conv, started = i, True
                if row[1] is not None:
                    turns.append(tuple(row))
            if len(out) >= LONG:
                yield _rows(out)
                out = []
        if started:
            out.append(repaired(conv, turns))
            yield _rows(out)

    spread = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return spread.mapInArrow(run, RESULT)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in RESULT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


PIECES = (
    "conv_id long, piece long, symbols binary, blank long, duplicate long, truncated long, illegal long,"
    "low long, high long, n_turns long, first string, last string, matrix array<long>"
)


def _pieces(rows: DataFrame) -> DataFrame:
    """Faults, symbols and a matrix of costs between states for every piece of a conversation.

    A text seen in an earlier piece is found by its first row; only one row for each piece
    and text takes part in that.
    """
    live = rows.where("role is not null").withColumn("key", F.md5(F.concat("role", F.lit("\0"), "text")))
    by_piece = live.groupBy("conv_id", "piece", "key").agg(F.lit(True).alias("old"))
    first = by_piece.groupBy(F.col("conv_id").alias("c"), F.col("key").alias("k")).agg(F.min("piece").alias("p"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")) & (F.col("piece") > F.col("p"))
    old = by_piece.join(first, same).select("conv_id", "piece", "key", "old")
    live = live.unionByName(old, allowMissingColumns=True)

    def summarise(group: pd.DataFrame) -> pd.DataFrame:
        t, summary, symbols = tables(), Summary(), []
        seen = set(group["key"][group["old"].notna()])
        group = group[group["old"].isna()].sort_values("_row")
        for turn, role, text, key in zip(group["turn"], group["role"], group["text"], group["key"], strict=True):
            symbol, fault = symbol_of(role, text, key in seen)
            seen.add(key)
            symbols.append(symbol)
            summary.add(None if pd.isna(turn) else int(turn), role, fault)
        codes = t.codes(symbols)
        columns = zip(*(t.costs(codes, unit)[0] for unit in t.units), strict=True)
        gaps_etc = summary.columns()
        return pd.DataFrame(
            {
                "conv_id": pd.array([group["conv_id"].iloc[0]], "Int64"),
                "piece": [group["piece"].iloc[0]],
                "symbols": [bytes(symbols)],
                "blank": [gaps_etc[1]],
                "duplicate": [gaps_etc[2]],
                "truncated": [gaps_etc[3]],
                "illegal": [gaps_etc[4]],
                "low": pd.array([summary.low], "Int64"),
                "high": pd.array([summary.high], "Int64"),
                "n_turns": [summary.n_turns],
                "first": [summary.first],
                "last": [summary.last],
                "matrix": [list(itertools.chain(*columns))],
            }
        )

    # A group is one piece and the keys it shares with earlier ones: bounded by PIECE.
    return durable(live.groupBy("conv_id", "piece").applyInPandas(summarise, PIECES))


def _ends(pieces: DataFrame) -> DataFrame:
    """Costs to the end of the conversation from behind each piece: matrices applied from the
    last piece back. A task reads one small row for each piece."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, after, started = None, None, False
        for batch in batches:
            out = []
            for conv, piece, matrix in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not started or conv != at:
                    after = tables().accept
                at, started = conv, True
                out.append((conv, piece, list(after)))
                ways = [[min(m + c, FAR) for m, c in zip(matrix[4 * s : 4 * s + 4], after, strict=True)] for s in range(4)]
                after = _closed([min(w) for w in ways])
                out[-1] += (after[START],)
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "piece", "ending", "cost"])

    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
    rows = pieces.select("conv_id", "piece", "matrix").repartition("conv_id")
    rows = rows.sortWithinPartitions("conv_id", F.desc("piece"))
    return rows.mapInArrow(fold, "conv_id long, piece long, ending array<long>, cost long")


def _traced(pieces: DataFrame) -> DataFrame:
    """``pieces`` with the letters and the state behind them for each state before them."""

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables()
        for batch in batches:
            ways = []
            for symbols, ending in zip(batch.column("symbols").to_pylist(), batch.column("ending").to_pylist(), strict=True):
                codes = t.codes(list(symbols))
                after = t.costs(codes, tuple(ending))[1]
                ways.append([t.trace(codes, after, s) for s in range(4)])
            audits = pa.array([[a for a, _ in w] for w in ways], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, audits], names=[*batch.schema.names, "audits"])

    ends = _ends(pieces).withColumnRenamed("conv_id", "c").withColumnRenamed("piece", "p")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p"))
    joined = pieces.drop("matrix").join(ends, same).drop("c", "p")
    fields = ", ".join(f"{c} {k}" for c, k in joined.dtypes)
    return joined.mapInArrow(follow, f"{fields}, audits array<string>")


def _cut(rows: DataFrame) -> DataFrame:
    """The repaired conversations of ``rows``, piece by piece.

    Pieces are summarised and traced by themselves. Only the digest reads a conversation from
    end to end in one task, row by row, since SHA-256 cannot be put together from parts.
    """
    rows = with_row_id(rows, ["conv_id", "turn", "role", "text"], "_row")
    rows = durable(rows.withColumn("piece", F.floor(F.col("_row") / PIECE)))
    traced = _traced(_pieces(rows)).withColumn("_row", F.lit(-1).cast("long"))
    texts = rows.select("conv_id", "piece", "_row", "role", "text")
    fields = [c for c in traced.columns if c not in ("symbols", "ending")]
    both = traced.select(*fields).unionByName(texts, allowMissingColumns=True)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, started = None, False

        def end() -> pa.RecordBatch:
            letters, now = tables().close(state)
            at = state
            for letter in letters:
                at = lines.apply(letter, at, "", "")
            audit = "".join(audits) + letters
            return _rows([(conv, *summary.columns(), cost or 0, audit, lines.sha.hexdigest())])

        for batch in batches:
            for row in batch.to_pylist():
                if not started or row["conv_id"] != conv:
                    if started:
                        yield end()
                    conv, started = row["conv_id"], True
                    summary, lines, audits, state, cost = Summary(), Digest(), [], START, None
                if row["_row"] < 0:
                    summary.join(row["low"], row["high"], row["n_turns"], row["first"], row["last"], row["illegal"])
                    for k in ("blank", "duplicate", "truncated"):
                        summary.faults[k] += row[k]
                    cost = row["cost"] if cost is None else cost
                    audits.append(row["audits"][state])
                    letters = iter(audits[-1])
                elif row["role"] is not None:
                    for letter in letters:
                        state = lines.apply(letter, state, row["role"], row["text"])
                        if letter != "I":
                            break
        if started:
            yield end()

    spread = both.repartition("conv_id").sortWithinPartitions("conv_id", "piece", "_row")
    return spread.mapInArrow(digest, RESULT)


def repair(conversations: DataFrame, long: int = LONG) -> DataFrame:
    """One row for every conv_id of ``conversations`` (conv_id, turn, role, text), after
    ``damage``: its faults, the cheapest edits that give it a legal structure, and a digest of
    the repaired rows (columns of ``RESULT``).

    Rows are taken by turn, nulls first, rows of one turn by role and text. Conversations of
    at most ``long`` rows are repaired one at a time in the task that holds them; longer ones
    are cut into pieces of ``PIECE`` rows that many tasks work on.

    A null id is a conversation of its own. An empty role has no legal initial. A conversation
    that lost all rows has zeros, no edits and the digest of nothing; an empty table gives no
    rows. Other columns are left out.
    """
    rows = damage(conversations)
    # Ids by themselves: a count with a partial result in the map tasks, long ones only.
    sizes = rows.groupBy("conv_id").count().where(F.col("count") > long).select(F.col("conv_id").alias("long_id"))
    sizes = durable(sizes)
    if sizes.isEmpty():
        return _whole(rows)
    ids = broadcast_if_small(sizes, BROADCAST_ROWS)
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    return _whole(rows.join(ids, same, "left_anti")).unionByName(_cut(rows.join(ids, same, "left_semi")))


#: A checksum of a decimal text, in SQL: the table is built by its rule.
CRC32 = """bits AS (
  SELECT list(c ORDER BY n) AS crc_table FROM (
    SELECT n, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS c
    FROM (SELECT unnest(range(256)) AS n)))"""


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, where ``crc_table`` is at hand."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))"
    step = "lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce({codes}, {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


def _way(state: str, letter: str, cost: str, line: str = "") -> str:
    said = f"{state}.t || chr(10) || {line}" if line else f"{state}.t"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {said}}}"


_FAR = "{'c': 1000000000, 'a': '', 't': ''}"
_KEEP = "role || ':' || text"


def _row_ways(state: str, role: str, initial: str) -> str:
    """Keeping or changing the row from ``state``, where it need not go."""
    keep = f"CASE WHEN gone OR left(role, 1) <> '{initial}' THEN {_FAR} ELSE {_way(state, 'K', 'more', _KEEP)} END"
    rerole = f"""CASE WHEN gone THEN {_FAR} ELSE {_way(state, "R", f"{REROLE} + more", f"'{role}:' || text")} END"""
    return f"{keep}, {rerole}" if role else keep


SQL = rf"""
WITH RECURSIVE {CRC32},
damaged AS (
  SELECT conv_id, turn, kind, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("name")} % 20 AS kind
        FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
              FROM conversations), bits)),
placed AS (
  SELECT conv_id, turn, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS unended
  FROM damaged WHERE kind <> 0),
turns AS (
  SELECT *, blank OR again AS gone, CASE WHEN unended THEN {CUT_OFF} ELSE 0 END AS more,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM placed)),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
         count(*) FILTER (NOT gone AND unended) AS truncated,
         count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id),
ways AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0, 'a': '', 't': ''}} AS p0, {_FAR} AS p1,
         {{'c': {INSERT}, 'a': 'I', 't': chr(10) || 'user:'}} AS p2,
         {{'c': {2 * INSERT}, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS p3
  FROM counts
  UNION ALL
  SELECT conv_id, i, n0, n1, c2, list_min([n3, {_way("c2", "I", str(INSERT), "'assistant:'")}]) FROM (
    SELECT *, list_min([n2, {", ".join(_way(f"n{k}", "I", str(INSERT), "'user:'") for k in (0, 1, 3))}]) AS c2 FROM (
      SELECT w.conv_id, t.i, {_way("p0", "D", str(DELETE))} AS n0,
             list_min([{_way("p1", "D", str(DELETE))}, {_row_ways("p0", "", "s")}]) AS n1,
             list_min([{_way("p2", "D", str(DELETE))}, {", ".join(_row_ways(f"p{k}", "user", "u") for k in (0, 1, 3))}]) AS n2,
             list_min([{_way("p3", "D", str(DELETE))}, {_row_ways("p2", "assistant", "a")}]) AS n3
      FROM ways w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1))),
best AS (
  SELECT w.conv_id, list_min([p0, p3]) AS p FROM ways w JOIN (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id) n
  ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.n = w.i)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(p.c, 0) AS BIGINT) AS cost,
       coalesce(p.a, '') AS audit, sha256(coalesce(substr(p.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
"""
