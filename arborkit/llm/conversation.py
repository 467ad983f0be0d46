"""Conversation structure repair: cheapest edits that give a regular order of roles.

A conversation's rows are taken by turn (nulls first; rows of one turn by the md5
of role and text).  Each row's first fault counts: blank (nothing but
``[\\x20\\x09-\\x0D]``), duplicate (role and text seen earlier), truncated (the
last other character is not one of ``.!?``).  Edits: Keep costs 0, Rerole to user
or assistant 2, Delete 3 (blank and duplicate rows must go), Insert an empty user
or assistant row anywhere 2; truncated rows that stay add 1.  The initials of the
roles left must read ``(s?(ua)+)?``.  Among the cheapest sequences of edits the
one whose initials (K, R, D, I) are ASCII-least is taken; it fixes all roles.

How it runs:

1. Rows become a few bytes each (role class, fault, digest); texts stay behind.
   Duplicates are found by a window over conversation and digest.
2. Rows are sorted over the cluster by conversation and turn, so that one endless
   conversation is spread over tasks, each giving a piece of its signature: one
   letter a row for role class and fault.
3. Distinct signatures, sorted over the cluster, go through a prefix trie of which
   the path to the latest signature is held: a signature shares the layers of the
   dynamic programme of its common prefix with the one before, and its answer is
   read at its terminal node.  A layer holds, for each state of the role grammar,
   the least cost, the rank of its edits among those of the other states, and the
   step before; no two edit sequences of a layer are prefixes of one another, as
   insertions count with the row they precede, so ranks order all continuations.
4. Answers are joined to conversations by signature, and rows are read once more:
   each conversation's edits arrive before its rows, which pass by in a stream
   into its repaired text's SHA-256 (sequential by its definition: the one step in
   which a conversation's rows pass through one task, held one at a time).

Nulls in any column count as one space; a null turn sorts first and is left out of
``gaps``; rows with a null ``conv_id`` form a conversation (null).  Roles count by
their first character (an empty role fits nowhere).  Repeated rows are duplicates.
A conversation without rows gets zeros, an empty audit and an empty text's hash.
Texts of any length are read whole; other columns are not read.  Empty tables give
empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

ROLES = "sua"
OK, TRUNCATED, BLANK, DUPLICATE = range(4)
#: States of the role grammar: nothing yet, after s, after u, after a pair; what each initial leads to.
STEPS = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})
ENDS = {0: 0, 3: 0, 2: 1, 1: 2}
ROLE, DELETE, INSERT, REROLE = {1: "user", 2: "assistant"}, 3, 2, 2


# ---------------------------------------------------------------------- signatures
def letter(role: int, fault: int) -> str:
    """One of sixteen letters for a role class (3: no other of s, u, a) and a fault."""
    return chr(97 + 4 * role + fault)


def read(symbol: str) -> tuple[int, int]:
    return divmod(ord(symbol) - 97, 4)


def counts(signature: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and adjacent roles not su, ua or au."""
    rows = [read(x) for x in signature]
    faults = [f for _, f in rows]
    legal = {(0, 1), (1, 2), (2, 1)}
    illegal = sum((a, b) not in legal for (a, _), (b, _) in zip(rows, rows[1:]))
    return faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal


# ------------------------------------------------------------- the shared programme
def _inserted() -> list[dict[int, int]]:
    """For each state, the states that 0, 1, 2 or 3 insertions lead to."""
    out = []
    for state in range(4):
        reach, at, n = {state: 0}, state, 0
        while n < 3:
            at = STEPS[at].get(1, STEPS[at].get(2))
            n += 1
            if at in reach:
                break
            reach[at] = n
        out.append(reach)
    return out


INSERTED = _inserted()
Layer = dict[int, tuple[int, int, int, str]]
FIRST: Layer = {0: (0, 0, -1, "")}


def next_layer(layer: Layer, symbol: str) -> Layer:
    """``{state: (cost, rank, state before, edits)}`` after one more row."""
    role, fault = read(symbol)
    best: dict[int, tuple[int, int, str, int]] = {}
    extra = int(fault == TRUNCATED)
    for before, (cost, rank, _, _) in layer.items():
        for at, n in INSERTED[before].items():
            moves = [(DELETE, "D", at)]
            if fault in (OK, TRUNCATED):
                moves += [(REROLE + extra, "R", to) for initial, to in STEPS[at].items() if initial]
                if role in STEPS[at]:
                    moves.append((extra, "K", STEPS[at][role]))
            for price, char, to in moves:
                found = (cost + INSERT * n + price, rank, "I" * n + char, before)
                if to not in best or found < best[to]:
                    best[to] = found
    order = sorted(best, key=lambda to: best[to][1:3])
    return {to: (best[to][0], order.index(to), best[to][3], best[to][2]) for to in best}


class PrefixTrie:
    """The path of a prefix trie that leads to the latest of some sorted signatures."""

    def __init__(self):
        self.path, self.layers, self.computed = "", [FIRST], 0
        self.known: dict[tuple, Layer] = {}

    def insert(self, signature: str) -> None:
        """Go down to a signature; layers of the shared prefix stay as they are."""
        shared, most = 0, min(len(signature), len(self.path))
        while shared < most and signature[shared] == self.path[shared]:
            shared += 1
        del self.layers[shared + 1 :]
        for symbol in signature[shared:]:
            self.layers.append(next_layer(self.layers[-1], symbol))
            self.computed += 1
        self.path = signature

    def answer(self) -> tuple[int, str]:
        """Cost and edits at the terminal node."""
        last = self.layers[-1]
        cost, _, state = min((cost + INSERT * ENDS[s], rank, s) for s, (cost, rank, _, _) in last.items())
        edits = ["I" * ENDS[state]]
        for layer in reversed(self.layers[1:]):
            _, _, before, step = layer[state]
            edits.append(step)
            state = before
        return cost, "".join(reversed(edits))


def solved(signatures: DataFrame) -> DataFrame:
    """Counts, cost and audit of every distinct ``sig``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PrefixTrie()
        for batch in batches:
            rows = []
            for sig in batch.column(0).to_pylist():
                trie.insert(sig)
                rows.append((sig, *counts(sig), *trie.answer()))
            columns = list(zip(*rows)) or [()] * 7
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), *[pa.int64()] * 5, pa.string()))], names=["sig", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    ordered = signatures.select("sig").distinct().repartitionByRange("sig").sortWithinPartitions("sig")
    return ordered.mapInArrow(run, "sig string, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


# -------------------------------------------------------------------- rows and pieces
def damaged(conversations: DataFrame) -> DataFrame:
    """Rows harmed by the crc32 of ``conv_id:turn`` modulo 20, to give the repair work.

    0 drops a row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes
    its role user.  Nulls count as one space.
    """
    held = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    harm = F.crc32(F.concat(held["conv_id"], F.lit(":"), held["turn"])) % 20
    text = F.when(harm == 1, "").when(harm == 2, F.translate(held["text"], ".!?", "")).otherwise(held["text"])
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(harm == 4, "user").otherwise(held["role"]).alias("role"), text.alias("text"), harm.alias("harm"))
    copies = F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("harm <> 0").withColumn("copy", F.explode(copies)).drop("harm")


def _digest() -> Column:
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))


def signatures_of(rows: DataFrame) -> DataFrame:
    """``conv_id, sig, gaps`` of every conversation that has ``rows(conv_id, turn, role, text)``."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    slim = rows.select("conv_id", "turn", _digest().alias("digest"), role.alias("r"), F.when(blank, BLANK).when(ended, OK).otherwise(TRUNCATED).alias("f"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy(F.col("turn").asc_nulls_first()))
    slim = slim.withColumn("f", F.when((F.col("f") != BLANK) & (seen > 1), DUPLICATE).otherwise(F.col("f")).cast("int"))
    # equal rows of a turn: the first of them is no duplicate and comes first (OK, TRUNCATED < DUPLICATE)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("digest").asc(), F.col("f").asc()]
    spread = slim.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "r", "f", F.spark_partition_id().alias("part"))
    kind = dict(rows.dtypes)["conv_id"]

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, piece, made = None, None, []

        def out(schema):
            return pa.RecordBatch.from_pylist([{**p, "sig": "".join(p["sig"])} for p in made], schema=schema)

        schema = None
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field(0).with_name("conv_id"), ("part", pa.int32()), ("sig", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64())])
            for conv, turn, r, f, part in zip(*(c.to_pylist() for c in batch.columns)):
                if piece is None or conv != at:
                    at, piece = conv, {"conv_id": conv, "part": part, "sig": [], "low": turn, "high": turn, "turns": int(turn is not None)}
                    made.append(piece)
                elif turn != piece["high"]:
                    piece["low"] = turn if piece["low"] is None else piece["low"]
                    piece["high"] = turn
                    piece["turns"] += 1
                piece["sig"].append(letter(r, f))
            if len(made) > 4096:
                last = made.pop()
                yield out(schema)
                made = [last]
        if made:
            yield out(schema)

    parts = spread.mapInArrow(pieces, f"conv_id {kind}, part int, sig string, low long, high long, turns long")
    # a conversation has as many pieces as partitions hold rows of it
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "sig", "low", "high", "turns"))).alias("p"))
    dated = F.filter("p", lambda x: x["low"].isNotNull())
    met_twice = F.aggregate(dated, F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("high")), lambda s, x: F.struct((s["n"] + F.coalesce((s["high"] == x["low"]).cast("long"), F.lit(0))).alias("n"), x["high"].alias("high")))["n"]
    total = F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["turns"])
    gaps = F.array_max(F.transform("p", lambda x: x["high"])) - F.array_min(F.transform("p", lambda x: x["low"])) + 1 - (total - met_twice)
    return whole.select("conv_id", F.array_join(F.transform("p", lambda x: x["sig"]), "").alias("sig"), F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"))


class Repair:
    """Follows the edits of one conversation row by row; ``say`` receives repaired rows."""

    def __init__(self, audit: str, say):
        self.audit, self.say, self.at, self.state = audit, say, 0, 0

    def _put(self, initial: int, role: str, text: str) -> None:
        self.state = STEPS[self.state][initial]
        self.say(f"{role}:{text}")

    def _insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            initial = 1 if 1 in STEPS[self.state] else 2
            self._put(initial, ROLE[initial], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._put(ROLES.index(role[0]), role, text)
        elif edit == "R":
            initial = 1 if 1 in STEPS[self.state] else 2
            self._put(initial, ROLE[initial], text)

    def end(self) -> None:
        self._insert()


class Digest:
    """SHA-256 of lines joined by line feeds."""

    def __init__(self):
        self.sha, self.started = hashlib.sha256(), False

    def add(self, line: str) -> None:
        self.sha.update((b"\n" if self.started else b"") + line.encode("utf-8", "surrogatepass"))
        self.started = True


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of every conversation in ``audits(conv_id, audit)``."""
    kind = dict(rows.dtypes)["conv_id"]
    none = F.lit(None)
    edits = audits.select("conv_id", none.cast("long").alias("turn"), none.cast("binary").alias("digest"), none.cast("string").alias("role"), F.col("audit").alias("text"))
    both = edits.unionByName(rows.select("conv_id", "turn", _digest().alias("digest"), "role", "text"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "digest")]
    # a conversation's edits have neither turn nor digest and come first
    both = both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, now, sha, done = None, None, None, []
        schema = None
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field(0).with_name("conv_id"), ("repaired_sha256", pa.string())])
            for start in range(0, batch.num_rows, 256):
                for own, role, text in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns)):
                    if role is None:  # the edits of the next conversation
                        if now is not None:
                            now.end()
                            done.append((conv, sha.sha.hexdigest()))
                        conv, sha = own, Digest()
                        now = Repair(text, sha.add)
                    else:
                        now.row(role, text)
            if len(done) > 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d)) for d in done], schema=schema)
                done = []
        if now is not None:
            now.end()
            done.append((conv, sha.sha.hexdigest()))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d)) for d in done], schema=schema)

    return both.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair_conversations(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    One row for each ``conv_id`` of ``conversations``; ``rows`` (by default its own,
    nulls as spaces) are what is judged, of the same columns.
    """
    if rows is None:
        rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    rows = rows.select("conv_id", "turn", "role", "text")
    told = materialize(signatures_of(rows), "conversation-signatures")
    answers = materialize(solved(told), "conversation-answers")
    judged = materialize(told.join(answers, "sig").drop("sig"), "conversation-edits")
    texts = repaired(rows, judged.select("conv_id", "audit"))
    every = conversations.select("conv_id").distinct()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    own, sha = judged.withColumnRenamed("conv_id", "own"), texts.withColumnRenamed("conv_id", "named")
    out = every.join(own, F.col("conv_id").eqNullSafe(F.col("own")), "left").join(sha, F.col("conv_id").eqNullSafe(F.col("named")), "left")
    empty = F.lit(hashlib.sha256().hexdigest())
    return out.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in names], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
