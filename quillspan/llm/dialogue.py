"""Repair of conversations: the cheapest edits after which the roles are (system? (user assistant)+)? .

Edits of a row are Keep (K, 0), Rerole to user or assistant (R, 2) and Delete (D, 3, required of blank and repeated rows);
Insert (I, 2) puts a user or assistant row without text anywhere; a truncated row that stays adds 1. Of equally cheap edits those
whose letters, in order, are the least in ASCII are taken.

The edits are paths of a weighted automaton with four states (nothing yet, behind system, behind user, behind assistant). It is
determinised lazily: the vector of the cheapest costs of the four, less their least, is a state of its own, and what a row makes of
it is computed when first met and then looked up (Automaton.table). One scan through that table gives the cost; a trace
back over the arcs that are tight, again by a table, marks those that end in the best cost, and the audit follows the least letters
among them. Costs that no cheapest path can have are dropped from a vector, so there are few states.

Scan and trace see a byte for each row, not its text: rows are numbered in their conversation by windows and written once, the
edits come back by (conv_id, seq), and texts are streamed through the digests in order. A conversation costs a task 5 bytes a
row, in line with its audit, which is one value.

Defined cases: a null role or text is one space; rows of one turn are ordered by role and text, a null turn comes first; the
null conv_id is a conversation; repeated rows are repetitions; a conversation without rows gets no edits; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, crc32_sql, id_or_sentinel, materialize, partitions, read_table
from .ordering import real_id

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
INF = 1 << 40
#: States: nothing yet, behind system, behind user, behind assistant; where an inserted or renamed row leads from each.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ENDS = (NONE, ASSISTANT)
#: Symbols: twice the place of the role's initial in INITIALS (anything else: 3), one more if truncated; or MUST_GO.
INITIALS, MUST_GO = "sua", 8
WHITE = r"\x20\x09-\x0D"


class Automaton:
    """The determinised automaton: states are normalised cost vectors, found when first met."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.known: dict[tuple[int, ...], int] = {}
        self.table: list[list[tuple[int, int] | None]] = []  #: by state and symbol: next state and cost
        self.traced: dict[tuple, int] = {}  #: by state, symbol and live states behind: place in marks
        self.marks: list[tuple[int, str]] = []  #: live states (bits), and the letter that each takes
        self.start = self._state(self._inserted([0, INF, INF, INF]))[0]

    @staticmethod
    def _inserted(v: list[int]) -> list[int]:
        v[USER] = min(v[USER], v[NONE] + INSERT, v[SYSTEM] + INSERT, v[ASSISTANT] + INSERT)
        v[ASSISTANT] = min(v[ASSISTANT], v[USER] + INSERT)
        return v

    def _state(self, v: list[int]) -> tuple[int, int]:
        # From ASSISTANT all goes on as from NONE, but that a system row is deleted, and as from SYSTEM.
        if v[NONE] > v[ASSISTANT] + DELETE:
            v[NONE] = INF
        if v[SYSTEM] > v[ASSISTANT]:
            v[SYSTEM] = INF
        least = min(v)
        key = tuple(x - least if x < INF else INF for x in v)
        if key not in self.known:
            self.known[key] = len(self.vectors)
            self.vectors.append(key)
            self.table.append([None] * (MUST_GO + 1))
        return self.known[key], least

    @staticmethod
    def arcs(symbol: int):
        """(from, letter, to, cost) of the edits that a row of this symbol can get."""
        for q in range(4):
            yield q, "D", q, DELETE
            if symbol != MUST_GO:
                more = TRUNCATED * (symbol & 1)
                initial = symbol >> 1
                if initial + 1 == (NEXT[q] if initial else SYSTEM) and (initial or q == NONE):
                    yield q, "K", initial + 1, KEEP + more
                yield q, "R", NEXT[q], REROLE + more

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        v, out = self.vectors[state], [INF] * 4
        for q, _, to, cost in self.arcs(symbol):
            out[to] = min(out[to], v[q] + cost)
        hit = self.table[state][symbol] = self._state(self._inserted([min(x, INF) for x in out]))
        return hit

    def scan(self, symbols: bytes) -> tuple[array, int]:
        """The state before each row and behind the last, and the least cost."""
        state, cost, states, table = self.start, 0, array("H", [self.start]), self.table
        for c in symbols:
            state, more = table[state][c] or self.step(state, c)
            cost += more
            states.append(state)
        return states, cost + min(self.vectors[state][q] for q in ENDS)

    def _mark(self, state: int, symbol: int | None, live: int) -> int:
        """Which states before a row (or behind the last) are on a cheapest path, and the least letter of each that stays on one."""
        v, letters = self.vectors[state], [""] * 4
        if symbol is None:
            best = min(v[q] for q in ENDS)
            letters = ["." if q in ENDS and v[q] == best else "" for q in range(4)]
        else:
            to_state, least = self.table[state][symbol]
            w = self.vectors[to_state]
            for q, letter, to, cost in self.arcs(symbol):
                if live >> to & 1 and v[q] < INF and v[q] + cost == w[to] + least:
                    letters[q] = min(letters[q] or letter, letter)
        for _ in range(2):  # two inserts in a row at most
            for q in range(4):
                if letters[NEXT[q]] and v[q] < INF and v[q] + INSERT == v[NEXT[q]]:
                    letters[q] = min(letters[q] or "I", "I")
        now = sum(1 << q for q in range(4) if letters[q])
        self.marks.append((now, "".join(x or "-" for x in letters)))
        return len(self.marks) - 1

    def trace(self, symbols: bytes, states: array) -> array:
        """Backwards: the place in marks for each row and behind the last."""
        out, live = array("H", bytes(2 * len(states))), 0
        for i in range(len(symbols), -1, -1):
            key = (states[i], symbols[i] if i < len(symbols) else None, live)
            at = self.traced.get(key)
            if at is None:
                at = self.traced[key] = self._mark(*key)
            out[i], live = at, self.marks[at][0]
        return out

    def edits(self, symbols: bytes):
        """Yields for each row, and at last for the end, the letters that stand there and the roles that I and R give; then the cost."""
        states, cost = self.scan(symbols)
        marked, q = self.trace(symbols, states), NONE
        for i in range(len(symbols) + 1):
            letters, roles, choice = "", "", self.marks[marked[i]][1]
            while choice[q] == "I":
                letters, roles, q = letters + "I", roles + INITIALS[NEXT[q] - 1], NEXT[q]
            if i < len(symbols):
                letter = choice[q]
                letters += letter
                roles += "-" if letter in "KD" else INITIALS[NEXT[q] - 1]
                q = q if letter == "D" else NEXT[q] if letter == "R" else (symbols[i] >> 1) + 1
            yield letters, roles, cost


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults that depend on the row's key alone: dropped, emptied, without ends of sentences, repeated, spoken by the user."""
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), given("role").alias("role"), given("text").alias("text"))
    kind = F.crc32(F.concat(given("conv_id"), F.lit(":"), given("turn")).cast("binary")) % 20
    rows = rows.withColumn("_kind", kind).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def faults(rows: DataFrame) -> DataFrame:
    """The rows, numbered from 1 in their conversation (seq), with fault ("blank", "duplicate", "truncated", ""), illegal (the row may
    not follow the one before), fresh (the first of its turn) and symbol. conv_id is never null here."""
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select(id_or_sentinel(F.col("conv_id").cast("long")).alias("conv_id"), F.col("turn").cast("long").alias("turn"), given("role"), given("text"))
    rows = rows.withColumns({"initial": F.left("role", F.lit(1)), "said": F.sha2("text", 256)})
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumns({"seq": F.row_number().over(order).cast("long"), "_pair": F.concat(F.lag("initial").over(order), "initial"), "_turn": F.lag("turn").over(order)})
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "said").orderBy("seq")) > 1
    rows = rows.withColumn("_again", again)
    blank, whole = ~F.col("text").rlike(f"[^{WHITE}]"), F.col("text").rlike(rf"[.!?][{WHITE}]*\z")
    fault = F.when(blank, "blank").when(F.col("_again"), "duplicate").when(~whole, "truncated").otherwise("")
    rows = rows.withColumns({"fault": fault, "illegal": F.coalesce(~F.col("_pair").isin("su", "ua", "au"), F.lit(False)), "fresh": F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_turn"))})
    place = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).otherwise(2 * place + (F.col("fault") == "truncated").cast("int"))
    return rows.select("conv_id", "seq", "turn", "role", "text", "fault", "illegal", "fresh", symbol.cast("int").alias("symbol"))


def in_order(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition(partitions(df.sparkSession), "conv_id").sortWithinPartitions("conv_id", *order)


#: Rows of edits that are sent on together.
ROWS = 10_000


def decide(rows: DataFrame) -> DataFrame:
    """conv_id, seq, edits, roles and cost for each row of faults(), and for the place behind each conversation's last one."""
    names, kinds = ["conv_id", "seq", "edits", "roles", "cost"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        automaton, out = Automaton(), []

        def close(conv, symbols):
            for i, (letters, roles, cost) in enumerate(automaton.edits(bytes(symbols)), 1):
                out.append((conv, i, letters, roles, cost if i > len(symbols) else None))
                if len(out) >= ROWS:
                    yield flush()

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
            out.clear()
            return made

        current, symbols = None, bytearray()
        for b in batches:
            for conv, symbol in zip(column(b, "conv_id").to_pylist(), column(b, "symbol").to_pylist()):
                if conv != current:
                    if symbols:
                        yield from close(current, symbols)
                    current, symbols = conv, bytearray()
                symbols.append(symbol)
        if symbols:
            yield from close(current, symbols)
        if out:
            yield flush()

    return in_order(rows.select("conv_id", "seq", "symbol"), "seq").mapInArrow(run, "conv_id long, seq long, edits string, roles string, cost long")


def repaired(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """conv_id, seq, pos, edit, role, text, cost: every edit in order. Where edit is D, role and text are null; at the end of a
    conversation's edits is a row with its cost and a null edit."""
    one = decided.withColumn("n", F.length("edits") + F.col("cost").isNotNull().cast("int")).select("*", F.explode(F.sequence(F.lit(1), "n")).alias("pos"))
    one = one.select("conv_id", "seq", "pos", F.expr("nullif(substring(edits, pos, 1), '')").alias("edit"), F.expr("substring(roles, pos, 1)").alias("_role"), F.expr("CASE WHEN pos = n THEN cost END").alias("cost"))
    both = one.join(rows.select("conv_id", "seq", F.col("role").alias("_own"), F.col("text").alias("_text")), ["conv_id", "seq"], "left")
    role = F.when(F.col("edit") == "K", F.col("_own")).when(F.col("_role") == "u", "user").when(F.col("_role") == "a", "assistant")
    text = F.when(F.col("edit") == "I", "").when(F.col("edit").isin("K", "R"), F.col("_text"))
    return both.select("conv_id", "seq", "pos", "edit", role.alias("role"), text.alias("text"), "cost")


def audits(edits: DataFrame) -> DataFrame:
    """conv_id, cost, audit (the letters) and repaired_sha256 (of `role:text` lines) from the rows of repaired()."""
    names, kinds = ["conv_id", "cost", "audit", "repaired_sha256"], [pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        audit, sha, none = bytearray(), hashlib.sha256(), True
        for b in batches:
            rows = []
            for conv, edit, role, text, cost in zip(*(column(b, c).to_pylist() for c in ("conv_id", "edit", "role", "text", "cost"))):
                if edit is not None:
                    audit += edit.encode()
                    if edit != "D":
                        sha.update(f"{'' if none else chr(10)}{role}:{text}".encode())
                        none = False
                else:
                    rows.append((conv, cost, audit.decode(), sha.hexdigest()))
                    audit, sha, none = bytearray(), hashlib.sha256(), True
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return in_order(edits, "seq", "pos").mapInArrow(run, "conv_id long, cost long, audit string, repaired_sha256 string")


def counts(rows: DataFrame) -> DataFrame:
    """gaps, blank, duplicate, truncated and illegal of each conversation of faults()."""
    many = lambda c: F.sum(c.cast("long"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - many(F.col("fresh")), F.lit(0).cast("long"))
    return rows.groupBy("conv_id").agg(gaps.alias("gaps"), *[many(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")], many(F.col("illegal")).alias("illegal"))


def op12_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read_table(spark, sf_dir, "conversations")
    rows = materialize(faults(damaged(given)), "turns")
    every = given.select(id_or_sentinel(F.col("conv_id").cast("long")).alias("conv_id")).distinct()
    made = audits(repaired(rows, decide(rows)))
    both = every.join(counts(rows), "conv_id", "left").join(made, "conv_id", "left")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return both.select(real_id("conv_id").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers], *[F.coalesce(c, F.lit(v)).alias(c) for c, v in empty.items()])


def _sql() -> str:
    """From the last row to the first: the least (cost, letters) of what follows, and the lines it leaves, for each of the states."""
    went = lambda letter, cost, line, x: f"{{'c': {cost} + {x}.c, 'a': '{letter}' || {x}.a, 'p': {f'list_prepend({line}, {x}.p)' if line else f'{x}.p'}}}"
    least = lambda *x: f"list_min([{', '.join(x)}])"
    none = "{'c': 1000000, 'a': '', 'p': []::VARCHAR[]}"
    name = ("x0", "xs", "xu", "xa")
    says = {USER: "'user:'", ASSISTANT: "'assistant:'"}

    def row(q: int) -> str:
        more = f"CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END"
        out = [went("D", DELETE, "", name[q]), f"CASE WHEN stays THEN {went('R', f'{REROLE} + {more}', f'{says[NEXT[q]]} || text', name[NEXT[q]])} ELSE {none} END"]
        keeps = f"stays AND initial = '{'sua'[NEXT[q] - 1]}'"
        out.append(f"CASE WHEN {keeps} THEN {went('K', more, "role || ':' || text", name[NEXT[q]])} ELSE {none} END")
        if q == NONE:
            out.append(f"CASE WHEN stays AND initial = 's' THEN {went('K', more, "role || ':' || text", 'xs')} ELSE {none} END")
        return least(*out)

    insert = lambda q, x: went("I", INSERT, says[NEXT[q]], x)
    end = {"x0": "{'c': 0, 'a': '', 'p': []::VARCHAR[]}", "xs": "{'c': 4, 'a': 'II', 'p': ['user:', 'assistant:']}", "xu": "{'c': 2, 'a': 'I', 'p': ['assistant:']}"}
    end["xa"] = end["x0"]
    return f"""WITH RECURSIVE t AS MATERIALIZED ({crc32_sql.table}),
g AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations, t),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM g WHERE kind <> 0
      UNION ALL SELECT conv_id, turn, role, text FROM g WHERE kind = 3),
o AS (SELECT *, left(role, 1) AS initial, row_number() OVER w AS seq, lag(left(role, 1)) OVER w AS before FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS MATERIALIZED (SELECT *, fault NOT IN ('blank', 'duplicate') AS stays FROM (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{WHITE}]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY seq) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][{WHITE}]*\\z') THEN 'truncated' ELSE '' END AS fault FROM o)),
x AS (SELECT conv_id, max(seq) + 1 AS seq, {', '.join(f'{v} AS {k}' for k, v in end.items())} FROM f GROUP BY conv_id
      UNION ALL SELECT conv_id, seq, {least('b0', insert(NONE, least('bu', insert(USER, 'ba'))))}, {least('bs', insert(SYSTEM, least('bu', insert(USER, 'ba'))))}, {least('bu', insert(USER, 'ba'))}, {least('ba', insert(ASSISTANT, 'bu'))}
      FROM (SELECT x.conv_id, f.seq, {row(NONE)} AS b0, {row(SYSTEM)} AS bs, {row(USER)} AS bu, {row(ASSISTANT)} AS ba FROM x JOIN f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.seq = x.seq - 1)),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
      count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT i.conv_id, {', '.join(f'coalesce({c}, 0)::BIGINT AS {c}' for c in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal'))}, coalesce(x0.c, 0)::BIGINT AS cost, coalesce(x0.a, '') AS audit,
       sha256(coalesce(array_to_string(x0.p, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN x ON x.seq = 1 AND x.conv_id IS NOT DISTINCT FROM i.conv_id"""


QUERIES = {"op12_dialogue": op12_dialogue}
ORACLE_SQL = {"op12_dialogue": _sql()}
