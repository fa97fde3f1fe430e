"""Conversation structure repair: cost layers of grammar states per turn, traced to the least audit."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Roles and the initials of the grammar ``(s?(ua)+)?``; its states: nothing yet, after s, after u, after a.
ROLES = {"s": "system", "u": "user", "a": "assistant"}
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("a", USER): ASSISTANT, ("u", ASSISTANT): USER}
ACCEPT = 1 << START | 1 << ASSISTANT
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: A row as one character: its initial (``?``: none of the grammar's); truncated: upper case (``^``); ``!``: it has to go.
MUST_GO, CUT = "!", "SUA^"


def _edits(code: str, state: int) -> Iterator[tuple[str, int, int, bool]]:
    """(letter, cost, next state, row used up) of every edit before a row, in ASCII order; code "" stands for the end."""
    fill = ASSISTANT if state == USER else USER  # the only role that may be written here
    if code:
        yield "D", DELETE, state, True
    yield "I", INSERT, fill, False
    if code and code != MUST_GO:
        cut = TRUNCATED if code in CUT else 0
        kept = NEXT.get((code.lower(), state))
        if kept is not None:
            yield "K", KEEP + cut, kept, True
        yield "R", REROLE + cut, fill, True


_BACK: dict[str, list[list[tuple[int, int, bool]]]] = {
    code: [[(q, cost, used) for q in range(4) for _, cost, to, used in _edits(code, q) if to == target] for target in range(4)]
    for code in ["", MUST_GO, *"sua?", *CUT]
}


def least_audit(codes: str) -> tuple[int, str]:
    """Cost and ASCII-least audit of the cheapest edits of one conversation.

    Layer c holds, for each turn, the bitset of states from which the rest is accepted at cost c and no lower; it is
    built from the end by the layers one edit below. The first layer with the start state at turn 0 gives the cost; the trace
    goes down the layers from there by the least letter. Each (turn, state) is entered once: time and memory grow with the turns.
    """
    n = len(codes)
    layers, reached, cost = {0: {n: ACCEPT}}, [0] * (n + 1), 0
    while not reached[0] >> START & 1:
        for at, states in (todo := layers.get(cost, {})).items():
            todo[at] = states & ~reached[at]
            reached[at] |= states
        edge = [(at, q) for at, states in todo.items() for q in range(4) if states >> q & 1]
        while edge:  # edits of cost 0 stay in the layer
            at, target = edge.pop()
            for code, back in ((codes[at - 1 : at], at - 1), ("", at)):
                if back < 0:
                    continue
                for q, price, used in _BACK[code][target]:
                    if used is (back == at) or reached[back] >> q & 1:
                        continue
                    into = layers.setdefault(cost + price, {})
                    into[back] = into.get(back, 0) | 1 << q
                    if not price:
                        reached[back] |= 1 << q
                        edge.append((back, q))
        cost += 1
    cost -= 1
    at, state, left, audit = 0, START, cost, []
    while at < n or left:
        for letter, price, to, used in _edits(codes[at] if at < n else "", state):
            if layers.get(left - price, {}).get(at + used, 0) >> to & 1:
                audit.append(letter)
                at, state, left = at + used, to, left - price
                break
    return cost, "".join(audit)


_STATS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_SPACE = r"\x20\x09-\x0D"


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after damage: ``conv_id``, ``turn``, ``role``, ``text``, ``alive`` (false: a dropped row, kept for its conv_id).

    Null roles and texts become one space, and so does a null id or turn in the key of the damage.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    harm = rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), (kind != 0).alias("alive"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return harm.drop("copy").withColumn("digest", F.unhex(F.sha2("text", 256)))


def _code(role: Column) -> Column:
    initial = F.substring(role, 1, 1)
    return F.when(initial.isin(*ROLES), initial).otherwise("?")


class _Conversation:
    """One conversation's turns as they come in order: a character and at most one digest a turn are held."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.codes, self.seen = conv_id, [], set()
        self.count, self.before, self.illegal = {"blank": 0, "duplicate": 0, "truncated": 0}, None, 0
        self.first = self.last = None
        self.turns = 0

    def add(self, turn: int | None, role: str, digest: bytes, initial: str, blank: bool, cut: bool) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        fault = "blank" if blank else "duplicate" if (role, digest) in self.seen else "truncated" if cut else None
        self.seen.add((role, digest))
        if fault:
            self.count[fault] += 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        self.codes.append(MUST_GO if fault in ("blank", "duplicate") else initial if not fault else "^" if initial == "?" else initial.upper())

    def stats(self) -> tuple:
        cost, audit = least_audit("".join(self.codes))
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.count.values(), self.illegal, cost, audit)


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def _arrow(rows: list[tuple], numbers: list[str], strings: list[str]) -> pa.RecordBatch:
    schema = pa.schema([(n, pa.int64()) for n in numbers] + [(n, pa.string()) for n in strings])
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)


_NUMBERS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, done = None, []
    for batch in batches:
        for conv_id, alive, *turn in _columns(batch, "conv_id", "alive", "turn", "role", "digest", "initial", "no_word", "cut"):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    done.append(now.stats())
                now = _Conversation(conv_id)
            if alive:
                now.add(*turn)
        if done:
            yield _arrow(done, _NUMBERS, ["audit"])
            done = []
    if now is not None:
        yield _arrow([now.stats()], _NUMBERS, ["audit"])


class _Repaired:
    """Hash of the repaired lines of a conversation, turn by turn along its audit."""

    def __init__(self, stats: tuple):
        self.stats, self.at, self.state, self.sha, self.lines = stats, 0, START, hashlib.sha256(), 0

    def _line(self, role: str, text: str) -> None:
        self.sha.update(("\n" * (self.lines > 0) + role + ":" + text).encode())
        self.lines += 1

    def _inserted(self) -> None:
        audit = self.stats[-1]
        while self.at < len(audit) and audit[self.at] == "I":
            self.state = ASSISTANT if self.state == USER else USER
            self._line(ROLES["a" if self.state == ASSISTANT else "u"], "")
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self._inserted()
        letter = self.stats[-1][self.at]
        self.at += 1
        if letter == "D":
            return
        self.state = NEXT[role[0], self.state] if letter == "K" else ASSISTANT if self.state == USER else USER
        self._line(role if letter == "K" else ROLES["a" if self.state == ASSISTANT else "u"], text)

    def end(self) -> tuple:
        self._inserted()
        return (*self.stats, self.sha.hexdigest())


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, done = None, []
    for batch in batches:
        for kind, alive, role, text, *stats in _columns(batch, "kind", "alive", "role", "text", *_NUMBERS, "audit"):
            if not kind:  # a conversation begins with its audit
                if now is not None:
                    done.append(now.end())
                now = _Repaired(tuple(stats))
            elif alive:
                now.turn(role, text)
        if done:
            yield _arrow(done, _NUMBERS, ["audit", "repaired_sha256"])
            done = []
    if now is not None:
        yield _arrow([now.end()], _NUMBERS, ["audit", "repaired_sha256"])


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text after damage, ``alive``, ``digest``): faults, gaps, the
    cheapest edits and the hash of what they leave.

    Turns come by turn, nulls first; rows that agree in it come by role and digest of their text, rows that agree in all are alike.
    Rows without a conv_id are one conversation. A role that doesn't begin with s, u or a, or is empty, has no
    place in the grammar and is given a role or deleted. An empty table gives no rows; other columns are ignored.

    Texts move once, thin rows once. Both passes stream conversations in order through tasks that hold no text but
    the batch's: about 40 bytes a turn, and a digest of each distinct turn, as a conversation's audit is one value of the result, and its
    hash runs over all its lines in order.
    """
    held = rows.select(
        "conv_id", "turn", "role", "digest", "alive", _code(F.col("role")).alias("initial"), (~F.col("text").rlike(f"[^{_SPACE}]")).alias("no_word"),
        (~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z")).alias("cut"),
    )
    order = [F.col("turn").asc_nulls_first(), "role", "digest"]
    audits = held.repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(_audits, f"conv_id long, {_STATS}")
    both = audits.withColumn("kind", F.lit(0)).unionByName(rows.select("conv_id", "turn", "role", "text", "digest", "alive", F.lit(1).alias("kind")), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *order).mapInArrow(_hashes, f"conv_id long, {_STATS}, repaired_sha256 string")


def op12_repair(conversations: DataFrame) -> DataFrame:
    """All conversations, damaged and repaired."""
    return repair(damaged(conversations))


#: Forward programme over the turns: of each conversation and state the cheapest edits so far, least audit first.
SQL = r"""WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS key FROM conversations),
kinds AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(key, lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS kind FROM keyed, tab),
alive AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM alive),
told AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair FROM placed),
stat AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM told GROUP BY 1),
ins AS (SELECT * FROM (VALUES ('0', '0', 0, '', ''), ('s', 's', 0, '', ''), ('u', 'u', 0, '', ''), ('a', 'a', 0, '', ''), ('0', 'u', 5, 'I', chr(10) || 'user:'), ('0', 'a', 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  ('s', 'u', 5, 'I', chr(10) || 'user:'), ('s', 'a', 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), ('u', 'a', 5, 'I', chr(10) || 'assistant:'), ('a', 'u', 5, 'I', chr(10) || 'user:')) v(q, p, price, letters, lines)),
step AS (SELECT * FROM (VALUES ('0', 's', 's'), ('0', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')) v(p, initial, z)),
edit AS (SELECT conv_id, i, p, p AS z, 2 AS price, 'D' AS letter, '' AS line FROM told, (SELECT DISTINCT p FROM ins)
  UNION ALL SELECT conv_id, i, p, z, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, 'K', chr(10) || role || ':' || text FROM told JOIN step USING (initial) WHERE fault IS NULL OR fault = 'truncated'
  UNION ALL SELECT conv_id, i, p, z, CASE WHEN fault = 'truncated' THEN 6 ELSE 1 END, 'R', chr(10) || CASE z WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text FROM told, step WHERE z <> 's' AND (fault IS NULL OR fault = 'truncated')),
way(conv_id, i, q, b) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '0', {'cost': 0, 'audit': '', 'lines': ''} FROM told
  UNION ALL SELECT w.conv_id, w.i + 1, e.z, min({'cost': w.b.cost + n.price + e.price, 'audit': w.b.audit || n.letters || e.letter, 'lines': w.b.lines || n.lines || e.line})
  FROM way w JOIN ins n ON n.q = w.q JOIN edit e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.p = n.p GROUP BY w.conv_id, w.i, e.z),
best AS (SELECT s.conv_id, min({'cost': w.b.cost + n.price, 'audit': w.b.audit || n.letters, 'lines': w.b.lines || n.lines}) AS b FROM way w JOIN stat s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.i JOIN ins n ON n.q = w.q AND n.p IN ('0', 'a') GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(b.cost, 0) AS BIGINT) AS cost, coalesce(b.audit, '') AS audit, sha256(substr(coalesce(b.lines, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN stat s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best t ON t.conv_id IS NOT DISTINCT FROM o.conv_id"""
