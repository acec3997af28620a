"""Repair of conversation structure over a suffix-shared automaton of role and fault signatures.

A row's first fault counts: *blank* (no character but white space), *duplicate* (role and text seen earlier in its
conversation), *truncated* (the last such character is none of ``.!?``).  A conversation is made to read
``(system? (user assistant)+)?`` by the cheapest edits; of equally cheap ones those whose initials come first in ASCII.

1. A narrow shuffle (digests instead of texts) brings each conversation's rows in order to one task, which streams them to
   one symbol a row: the *signature*.  Duplicates are marked before, by (conversation, role, digest).
2. The distinct signatures of all conversations are dealt and sorted from their ends.  Sorted so, signatures that end alike
   are neighbours, and the path of nodes that they share (a node is a symbol and the node that follows) is kept while it
   is in use: cost-to-go and next edit of each grammar state are computed once for a node and serve every conversation
   with that ending (once more where a node's signatures lie on both sides of a cut between two tasks).
3. Costs and edits go back to the conversations by signature, and the texts, shuffled once, are streamed past the edits.

The hash of a repaired conversation is one pass over its rows, so a conversation is one task's work, however long; that task
holds a symbol and a few numbers for each of its rows and one batch of texts, never the conversation.

Defined results: a null role or text, and a null id or turn inside the damage key, reads as one space; rows without conversation
id are one conversation; rows are ordered by turn (nulls first), role and the SHA-256 of the text; any role that begins with s, u or
a counts as that initial and any other fits nowhere; a conversation without rows needs no edits; an empty table gives an
empty table; other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.store import settle_table

#: Fixed values of the contract: white space, sentence ends, and the costs of the edits.
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: Grammar states: nothing yet, after system, after user, after assistant; where an initial leads.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that may be written next in each state.
WRITTEN = ("user", "user", "assistant", "user")
FINAL = (0, 3)
#: Symbols from the end by which signatures are dealt to tasks.
TAIL = 32


@dataclass(frozen=True)
class Node:
    """Cheapest cost from here to the end for each state, and the edit that begins it."""

    cost: tuple[int, ...]
    edit: tuple[str, ...]


def _settled(options: list[list[tuple[int, str]]]) -> Node:
    """Adds insertions: an inserted row leads to the state after it, before the same symbol."""
    least = [min((c for c, _ in o), default=1 << 60) for o in options]
    for _ in STEP:
        least = [min(least[q], INSERT + least[STEP[q][WRITTEN[q][0]]]) for q in range(len(STEP))]
    # all edits that begin a cheapest repair have different initials, so the first of them decides the tie
    best = [min([*o, (INSERT + least[STEP[q][WRITTEN[q][0]]], "I")]) for q, o in enumerate(options)]
    return Node(tuple(c for c, _ in best), tuple(e for _, e in best))


SINK = _settled([[(0, "")] if q in FINAL else [] for q in range(len(STEP))])


def before(symbol: str, after: Node) -> Node:
    """The node of ``symbol`` followed by what ``after`` stands for."""
    options = []
    for q, step in enumerate(STEP):
        here = [(DELETE + after.cost[q], "D")]
        if symbol != "d":
            short = TRUNCATED if symbol.isupper() else 0
            if symbol.lower() in step:
                here.append((short + after.cost[step[symbol.lower()]], "K"))
            here.append((REROLE + short + after.cost[step[WRITTEN[q][0]]], "R"))
        options.append(here)
    return _settled(options)


def moved(state: int, edit: str, symbol: str) -> int:
    """The state after an edit."""
    return state if edit == "D" else STEP[state][symbol.lower() if edit == "K" else WRITTEN[state][0]]


class Endings:
    """The path of nodes of the signature seen last, from its end; the next one keeps what it shares."""

    def __init__(self) -> None:
        self.symbols: list[str] = []
        self.nodes: list[Node] = [SINK]

    def solve(self, signature: str) -> tuple[int, str]:
        """Cost and edits of a signature."""
        n, same = len(signature), 0
        most = min(n, len(self.symbols))
        while same < most and self.symbols[same] == signature[n - 1 - same]:
            same += 1
        del self.symbols[same:], self.nodes[same + 1 :]
        for k in range(same, n):
            self.symbols.append(signature[n - 1 - k])
            self.nodes.append(before(signature[n - 1 - k], self.nodes[k]))
        state, k, edits = 0, 0, []
        while edit := self.nodes[n - k].edit[state]:
            edits.append(edit)
            state = moved(state, edit, signature[k] if k < n else "")
            k += edit != "I"
        return self.nodes[n].cost[0], "".join(edits)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``gone`` of the rows after the contract's damage; dropped rows stay, marked as gone."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(said("text"), ENDS, "")).otherwise(said("text"))
    role = F.when(fate == 4, "user").otherwise(said("role"))
    times = F.explode(F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (fate == 0).alias("gone"), times.alias("time")).drop("time")


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256))


ORDER = ("conv_id", "turn", "role", "digest")


def _rows(rows: DataFrame) -> DataFrame:
    """The rows with null role or text as one space, and the digest that orders and compares texts."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    gone = F.coalesce("gone", F.lit(False)) if "gone" in rows.columns else F.lit(False)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), said("role"), said("text"), gone.alias("gone")).withColumn("digest", _digest())


def symbols(rows: DataFrame) -> DataFrame:
    """A narrow row for each row of _rows: its order, its initial, its faults and its symbol."""
    trimmed = F.rtrim("text", F.lit(SPACE))
    narrow = rows.select(
        "conv_id", "turn", "role", "digest", "gone",
        (trimmed == "").alias("blank"),
        (~F.right(trimmed, F.lit(1)).isin(*ENDS)).alias("cut"),
    )
    # gone rows are no earlier rows; null ids are one conversation, as Spark groups them
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "digest").orderBy("turn"))
    fault = F.when(F.col("blank"), "b").when(F.col("seen") > 1, "d").when(F.col("cut"), "t").otherwise("")
    narrow = narrow.withColumn("seen", seen).withColumn("fault", F.when(F.col("gone"), "g").otherwise(fault))
    initial = F.left("role", F.lit(1))
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    symbol = F.when(F.col("fault").isin("b", "d"), "d").when(F.col("fault") == "t", F.upper(letter)).otherwise(letter)
    return narrow.select("conv_id", "turn", "role", "digest", "seen", "fault", letter.alias("initial"), symbol.alias("symbol"))


@dataclass
class _Counts:
    signature: list[str] = field(default_factory=list)
    faults: dict[str, int] = field(default_factory=lambda: dict.fromkeys("bdtg", 0))
    illegal: int = 0
    last: str = ""
    turns: int = 0
    low: int | None = None
    high: int | None = None

    def add(self, turn: int | None, fault: str, initial: str, symbol: str) -> None:
        if fault:
            self.faults[fault] += 1
        if fault == "g":
            return
        if self.signature:
            self.illegal += (self.last + initial) not in ("su", "ua", "au")
        self.last = initial
        self.signature.append(symbol)
        if turn is not None and turn != self.high:
            self.turns += 1
            self.high = turn
            self.low = turn if self.low is None else self.low

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return "".join(self.signature), gaps, self.faults["b"], self.faults["d"], self.faults["t"], self.illegal


STATS = ("signature string", "gaps long", "blank long", "duplicate long", "truncated long", "illegal long")
BATCH = 4096


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def signatures(rows: DataFrame) -> DataFrame:
    """A row for each conversation: its signature and the counts of its faults."""
    narrow = symbols(rows).repartition("conv_id").sortWithinPartitions(*ORDER, "seen")
    names = ["conv_id", *(s.split()[0] for s in STATS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts, done, kind = None, None, [], None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [()] * len(names)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.string()), *(pa.array(c, pa.int64()) for c in columns[2:])], names)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, *rest in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "fault", "initial", "symbol")), strict=True):
                if counts is None or conv != now:
                    if counts is not None:
                        done.append((now, *counts.row()))
                    now, counts = conv, _Counts()
                counts.add(*rest)
            if len(done) >= BATCH:
                yield flush()
        if counts is not None:
            done.append((now, *counts.row()))
            yield flush()

    return narrow.mapInArrow(run, ", ".join([f"conv_id {_kind(rows, 'conv_id')}", *STATS]))


def solved(found: DataFrame) -> DataFrame:
    """(signature, cost, audit) of every distinct signature."""
    distinct = found.select("signature").distinct()
    tail = F.reverse(F.right("signature", F.lit(TAIL)))
    # neighbours by their ends; the hash splits the signatures of one long ending
    dealt = distinct.repartitionByRange(tail, F.xxhash64("signature")).sortWithinPartitions(F.reverse("signature"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        endings = Endings()
        for batch in batches:
            given = batch.column(0).to_pylist()
            costs, audits = zip(*map(endings.solve, given), strict=True) if given else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], ["signature", "cost", "audit"])

    return dealt.mapInArrow(run, "signature string, cost long, audit string")


def _past_edits(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Every conversation's counts, cost and audit, followed by its rows in order; one shuffle of the texts."""
    found = settle_table(signatures(rows), "conversation-signatures")
    heads = found.join(solved(found), "signature")
    stats = [s.split()[0] for s in STATS] + ["cost", "audit"]
    heads = heads.select("conv_id", F.struct(*stats).alias("head"))
    body = rows.where("NOT gone").select("conv_id", "turn", "role", "digest", "text")
    both = heads.unionByName(body, allowMissingColumns=True).withColumn("first", F.col("head").isNotNull())
    return both.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("first"), *ORDER[1:]).select("conv_id", "head", "role", "text"), stats


class _Writer:
    """Writes the repaired rows of one conversation while its rows pass by."""

    def __init__(self, head: dict) -> None:
        self.head, self.at, self.place, self.state = head, 0, 0, 0

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        audit = self.head["audit"]
        while self.at < len(audit) and audit[self.at] == "I":
            yield "I", WRITTEN[self.state], ""
            self.state = moved(self.state, "I", "")
            self.at += 1

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit, symbol = self.head["audit"][self.at], self.head["signature"][self.place]
        if edit != "D":
            yield edit, role if edit == "K" else WRITTEN[self.state], text
        self.state = moved(self.state, edit, symbol)
        self.at += 1
        self.place += 1


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, _Writer, Iterator[tuple[str, str, str]], pa.DataType]]:
    """(conversation, writer, repaired rows) for each row and, last, for each conversation's end."""
    now, writer, kind = None, None, None
    for whole in batches:
        kind = whole.schema.field("conv_id").type
        for a in range(0, whole.num_rows, BATCH):
            batch = whole.slice(a, BATCH)
            for conv, head, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "head", "role", "text")), strict=True):
                if head is not None:
                    if writer is not None:
                        yield now, writer, writer.inserted(), kind
                        yield now, writer, None, kind
                    now, writer = conv, _Writer(head)
                else:
                    yield now, writer, writer.row(role, text), kind
    if writer is not None:
        yield now, writer, writer.inserted(), kind
        yield now, writer, None, kind


def repaired(rows: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: conv_id, place (from 0), edit (K, R or I), role, text."""
    rows = _rows(rows)
    both, _ = _past_edits(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place, kind, size = [], 0, None, 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.string()) for c in columns[2:])], ["conv_id", "place", "edit", "role", "text"])

        for conv, _, written, kind in _streamed(batches):
            if written is None:
                place = 0
                continue
            for edit, role, text in written:
                out.append((conv, place, edit, role, text))
                place, size = place + 1, size + len(text)
            if len(out) >= BATCH or size > 4 << 20:
                size = 0
                yield flush()
        if out:
            yield flush()

    return both.mapInArrow(run, f"conv_id {_kind(rows, 'conv_id')}, place long, edit string, role string, text string")


def digest(rows: DataFrame) -> DataFrame:
    """A row for each conversation: counts, cost, audit and the SHA-256 of what the repair leaves."""
    rows = _rows(rows)
    both, stats = _past_edits(rows)
    shown = [s for s in stats if s != "signature"]
    kinds = {s.split()[0]: s.split()[1] for s in STATS} | {"cost": "long", "audit": "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, sha, first, kind = [], hashlib.sha256(), True, None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            made = [pa.array(c, pa.int64() if kinds[s] == "long" else pa.string()) for c, s in zip(columns[1:-1], shown, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *made, pa.array(columns[-1], pa.string())], ["conv_id", *shown, "repaired_sha256"])

        for conv, writer, written, kind in _streamed(batches):
            if written is None:
                out.append((conv, *(writer.head[s] for s in shown), sha.hexdigest()))
                sha, first = hashlib.sha256(), True
                if len(out) >= BATCH:
                    yield flush()
                continue
            for _, role, text in written:
                sha.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                first = False
        if out:
            yield flush()

    fields = ", ".join(f"{s} {kinds[s]}" for s in shown)
    return both.mapInArrow(run, f"conv_id {_kind(rows, 'conv_id')}, {fields}, repaired_sha256 string")


def oracle() -> str:
    """The same rows in DuckDB: damage, faults, and the cheapest edits folded from the end as 'cost, audit' strings."""

    def plus(key: str, cost: str, letter: str) -> str:
        return f"(printf('%09d', {key}[1:9]::INT + {cost}) || '{letter}' || {key}[10:])"

    written = ["u", "u", "a", "u"]
    base = []
    for q, step in enumerate(STEP):
        kept = " ".join(f"WHEN '{c}' THEN {plus(f'n.q{to}', 'r.late', 'K')}" for c, to in step.items())
        again = plus(f"n.q{step[written[q]]}", f"{REROLE} + r.late", "R")
        base.append(f"least({plus(f'n.q{q}', str(DELETE), 'D')}, CASE WHEN r.must THEN '~' ELSE {again} END, CASE WHEN r.must THEN '~' ELSE CASE r.c {kept} ELSE '~' END END)")
    insert = lambda q: plus(f"b.q{STEP[q][written[q]]}", str(INSERT), "I")
    twice = lambda q: plus(f"b.q{STEP[STEP[q][written[q]]][written[STEP[q][written[q]]]]}", str(2 * INSERT), "II")
    closed = ", ".join(f"q{q} := least(b.q{q}, {insert(q)}, {twice(q)})" for q in range(4))
    opened = ", ".join(f"q{q} := {b}" for q, b in enumerate(base))
    end = ", ".join(f"q{q} := '{c:09d}{a}'" for q, (c, a) in enumerate([(0, ""), (6, "II"), (3, "I"), (0, "")]))
    space = "[^\\x20\\x09-\\x0D]"
    return f"""
WITH RECURSIVE crc AS (
    SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
    FROM (SELECT unnest(range(256))::BIGINT AS b)),
said AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(4294967295, list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT),
            lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]))) % 20 AS fate
    FROM conversations, crc),
damaged AS (
    SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM (SELECT *, unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) FROM said) WHERE fate <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS place FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS again, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) || left(role, 1) AS pair FROM placed),
faults AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '{space}') THEN 'b' WHEN again THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE '' END AS fault
    FROM seen),
rows_ AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
        count(*) FILTER (place > 1 AND coalesce(pair, '') NOT IN ('su', 'ua', 'au')) AS illegal,
        list(struct_pack(c := left(role, 1), must := fault IN ('b', 'd'), late := CASE WHEN fault = 't' THEN {TRUNCATED} ELSE 0 END, role := role, text := text) ORDER BY place) AS r
    FROM faults GROUP BY conv_id),
fold(conv_id, k, n) AS (
    SELECT conv_id, len(r), struct_pack({end}) FROM rows_
    UNION ALL
    SELECT conv_id, k - 1, (SELECT struct_pack({closed}) FROM (SELECT struct_pack({opened}) AS b))
    FROM (SELECT fold.conv_id, k, n, rows_.r[k] AS r FROM fold JOIN rows_ ON fold.conv_id IS NOT DISTINCT FROM rows_.conv_id WHERE k > 0)),
solved AS (SELECT rows_.*, n.q0[1:9]::BIGINT AS cost, n.q0[10:] AS audit FROM fold JOIN rows_ ON fold.conv_id IS NOT DISTINCT FROM rows_.conv_id WHERE k = 0),
letters AS (
    SELECT conv_id, r, k, substr(audit, k, 1) AS e FROM (SELECT conv_id, r, audit, unnest(range(1, len(audit) + 1)) AS k FROM solved)),
numbered AS (
    SELECT *, (sum((e <> 'I')::INT) OVER w)::BIGINT AS i, (sum((e <> 'D')::INT) OVER w)::BIGINT AS p FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
spoken AS (
    SELECT *, bool_or(p = 1 AND e = 'K' AND r[i].c = 's') OVER (PARTITION BY conv_id) AS system FROM numbered),
texts AS (
    SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN r[i].role WHEN (p - system::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE r[i].text END, chr(10) ORDER BY k) AS body
    FROM spoken WHERE e <> 'D' GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
    coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM c.conv_id"""
