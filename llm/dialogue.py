"""Conversation structure repair with a suffix-shared automaton.

A conversation's turns, in order, become a signature of one sign for each turn: its role's initial (``s u a``, ``o`` for any other),
a capital if the turn is truncated, ``x`` if it must go (blank or a duplicate).  A repaired conversation reads
``(s?(ua)+)?`` in initials.  Edits and costs: Keep 0, Rerole to user or assistant 1, Delete 2, Insert an empty user or
assistant turn 5; a truncated turn that isn't deleted costs 5 more.  Of the cheapest edits those with the least audit string count.

The distinct signatures of all conversations are sorted by their reversed text and dealt out in ranges.  A node of the
automaton is a suffix; signatures with a common suffix are neighbours and share its nodes.  As no earlier
branch comes back in this order, a task keeps the nodes of one signature only.  Each node has, for every state of the grammar, the cost
to go and the best audit from here on, a cell that points to the next node's best audit; both are worked out once, from the
node behind it, however many conversations end this way.  An edit leads from a state to one state only, so the least of the
cheapest edits' initials gives the least audit.

Turns are ordered by number (nulls first), then role, then the text's MD5.  Turns alike in all of these are counted, not
repeated, before they are sorted; a first occurrence is a minimum joined by role and text.  Signatures are put together from ranges of
turns, so a long conversation is spread over tasks; its signature and its audit are one string, as the result asks,
and its repaired turns leave one task in order, one batch at a time.

Null roles and texts are one space; an empty role has no initial; a null id is a conversation of its own; repeated rows are turns
of their own; gaps ignore null turn numbers.  No rows, no conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescan.storage import Workspace

DELETE, RETAIN, REROLE, INSERT, TRUNCATED = 2, 0, 1, 5, 5
# States of the grammar: nothing yet, after the system's turn, after the user's, after the assistant's (a repaired end, as 0).
_KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_NEXT = (2, 2, 3, 2)  # after an inserted or reroled turn
_ROLES = {2: "user", 3: "assistant"}
_LEGAL = ("su", "ua", "au")
_BLANK, _TRUNCATED = 1, 2
_PART = (
    "conv_id bigint, part int, signature string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "distinct bigint, low bigint, high bigint, first string, last string"
)


class Node:
    """A suffix of signatures: by state, the cost to go and the best audit (a cell: an initial and the rest, or None)."""

    __slots__ = ("cost", "audit")

    def __init__(self, cost: list[int], audit: list):
        self.cost, self.audit = cost, audit


def end() -> Node:
    """The empty suffix."""
    user = ("I", None)
    return Node([0, 2 * INSERT, INSERT, 0], [None, ("I", user), user, None])


def before(sign: str, after: Node) -> Node:
    """The node of a suffix that is one sign longer."""
    best = []
    for state in range(4):
        ways = [(DELETE + after.cost[state], "D", state)]
        if sign != "x":
            extra = TRUNCATED if sign.isupper() else 0
            if (kept := _KEEP.get((state, sign.lower()))) is not None:
                ways.append((RETAIN + extra + after.cost[kept], "K", kept))
            ways.append((REROLE + extra + after.cost[_NEXT[state]], "R", _NEXT[state]))
        best.append(min(ways))
    cost, audit = [c for c, _, _ in best], [(initial, after.audit[state]) for _, initial, state in best]
    # Inserts lead from 2 to 3 and back, and from 0 and 1 to 2; at most one of 2 and 3 gains by them.
    for state in (2, 3, 0, 1) if cost[2] >= cost[3] else (3, 2, 0, 1):
        inserted = INSERT + cost[_NEXT[state]]
        if (inserted, "I") < (cost[state], audit[state][0]):
            cost[state], audit[state] = inserted, ("I", audit[_NEXT[state]])
    return Node(cost, audit)


def spelled(audit) -> str:
    out = []
    while audit is not None:
        initial, audit = audit
        out.append(initial)
    return "".join(out)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """signature, cost and audit of reversed signatures in order."""
    nodes, held = [end()], ""
    for batch in batches:
        costs, audits = [], []
        for backward in batch.column("backward").to_pylist():
            shared = 0
            while shared < min(len(held), len(backward)) and held[shared] == backward[shared]:
                shared += 1
            del nodes[shared + 1 :]
            for sign in backward[shared:]:
                nodes.append(before(sign, nodes[-1]))
            held = backward
            costs.append(nodes[-1].cost[0])
            audits.append(spelled(nodes[-1].audit[0]))
        yield pa.record_batch({
            "signature": batch.column("signature"), "cost": pa.array(costs, pa.int64()), "audit": pa.array(audits, pa.string()),
        })


class _Part:
    """What one task has seen of a conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.signs = conv_id, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.first = self.last = None

    def add(self, turn, initial: str, fault: int, is_first: bool, n: int) -> None:
        if self.first is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in _LEGAL
        self.last = initial
        self.illegal += n - 1  # no legal pair has equal initials
        if turn is not None and turn != self.high:
            self.distinct += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        if fault == _BLANK:
            self.blank += n
            self.signs.append("x" * n)
        elif not is_first:
            self.duplicate += n
            self.signs.append("x" * n)
        else:
            sign = initial if initial in ("s", "u", "a") else "o"
            self.truncated += fault == _TRUNCATED
            self.duplicate += n - 1
            self.signs.append((sign.upper() if fault == _TRUNCATED else sign) + "x" * (n - 1))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered turns to one row for each conversation of the task."""
    part, number = None, TaskContext.get().partitionId()

    def record(done: list[_Part]) -> pa.RecordBatch:
        def column(get, kind):
            return pa.array([get(p) for p in done], kind)

        counts = ("blank", "duplicate", "truncated", "illegal", "distinct", "low", "high")
        return pa.record_batch({
            "conv_id": column(lambda p: p.conv_id, pa.int64()), "part": column(lambda p: number, pa.int32()),
            "signature": column(lambda p: "".join(p.signs), pa.string()),
            **{c: column(lambda p, c=c: getattr(p, c), pa.int64()) for c in counts},
            "first": column(lambda p: p.first, pa.string()), "last": column(lambda p: p.last, pa.string()),
        })

    for batch in batches:
        done = []
        for conv_id, *turn in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault", "is_first", "n"))):
            if part is None or part.conv_id != conv_id:
                if part is not None:
                    done.append(part)
                part = _Part(conv_id)
            part.add(*turn)
        if done:
            yield record(done)
    if part is not None:
        yield record([part])


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns in order; of each conversation the audit comes first, then its turns."""
    nothing = object()
    current, audit, at, state, place = nothing, "", 0, 0, 0
    for batch in batches:
        rows = []

        def put(role: str, text: str) -> None:
            nonlocal place
            rows.append((current, place, role, text))
            place += 1

        def inserts() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state = _NEXT[state]
                put(_ROLES[state], "")
                at += 1

        for conv_id, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text"))):
            if kind == 0:
                current, audit, at, state, place = conv_id, text, 0, 0, 0
            else:
                edit = audit[at]
                at += 1
                if edit == "K":
                    state = _KEEP[state, role[:1]]
                    put(role, text)
                elif edit == "R":
                    state = _NEXT[state]
                    put(_ROLES[state], text)
            inserts()
        if rows:
            conv_ids, places, roles, texts = zip(*rows)
            yield pa.record_batch({
                "conv_id": pa.array(conv_ids, pa.int64()), "place": pa.array(places, pa.int64()),
                "role": pa.array(roles, pa.string()), "text": pa.array(texts, pa.string()),
            })


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's ``role:text`` lines, joined by line feeds, as SHA-256."""
    current, digest = None, None
    for batch in batches:
        done = []
        for conv_id, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text"))):
            if place == 0:
                if digest is not None:
                    done.append((current, digest.hexdigest()))
                current, digest = conv_id, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if done:
            yield _digests(done)
    if digest is not None:
        yield _digests([(current, digest.hexdigest())])


def _digests(done: list) -> pa.RecordBatch:
    return pa.record_batch({"conv_id": pa.array([c for c, _ in done], pa.int64()), "repaired_sha256": pa.array([d for _, d in done], pa.string())})


def with_order(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"numbered": F.col("turn").isNotNull(), "key": F.md5(F.col("text").cast("binary"))})


_ORDER = ["numbered", "turn", "role", "key"]


class Repair:
    """The repair of all conversations of a table."""

    def __init__(self, rows: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
                 text_column: str = "text"):
        self.work = Workspace(rows.sparkSession, "dialogue")
        self.partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.rows = rows.select(
            F.col(conv_column).cast("bigint").alias("conv_id"), F.col(turn_column).cast("bigint").alias("turn"),
            F.coalesce(F.col(role_column).cast("string"), F.lit(" ")).alias("role"),
            F.coalesce(F.col(text_column).cast("string"), F.lit(" ")).alias("text"),
        )
        self.conversations = self.work.write(self._conversations(), "conversations")
        self.solved = self.work.write(self._audits(), "solved")

    def _turns(self) -> DataFrame:
        """The distinct turns of each conversation without their texts, and how often each comes."""
        solid, whole = F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
        fault = F.when(~solid, _BLANK).when(~whole, _TRUNCATED).otherwise(0)
        turns = with_order(self.rows).withColumn("fault", fault).groupBy("conv_id", *_ORDER, "fault").agg(F.count("*").alias("n"))
        turns = self.work.write(turns, "turns")
        firsts = turns.groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("key").alias("_key")).agg(
            F.min(F.struct("numbered", "turn")).alias("least")
        )
        same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("key") == F.col("_key"))
        found = turns.join(firsts, same).withColumn("is_first", F.struct("numbered", "turn").eqNullSafe(F.col("least")))
        return self.work.write(found.select("conv_id", *_ORDER, F.substring("role", 1, 1).alias("initial"), "fault", "is_first", "n"), "flagged")

    def _conversations(self) -> DataFrame:
        keys = ["conv_id", *_ORDER]
        ranges = self._turns().repartitionByRange(self.partitions, *keys).sortWithinPartitions(*keys)
        ranges = ranges.select("conv_id", "turn", "initial", "fault", "is_first", "n").mapInArrow(_parts, _PART)
        parts = ranges.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", *[c.split()[0] for c in _PART.split(", ")[2:]]))).alias("p"))

        def total(name: str) -> Column:
            return F.aggregate("p", F.lit(0).cast("bigint"), lambda sum_, x: sum_ + x[name])

        # Neighbouring parts of a conversation: (part, next part).
        seams = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        broken = F.size(F.filter(seams, lambda s: ~F.concat(s["a"]["last"], s["b"]["first"]).isin(*_LEGAL)))
        # A turn number on both sides of a seam was counted twice.
        twice = F.size(F.filter(seams, lambda s: F.coalesce(s["a"]["high"] == s["b"]["low"], F.lit(False))))
        high, low = (of(F.transform("p", lambda x: x[end_].cast("decimal(38,0)"))) for of, end_ in ((F.array_max, "high"), (F.array_min, "low")))
        gaps = (high - low + 1 - total("distinct") + twice).try_cast("bigint")
        return parts.select(
            "conv_id", F.array_join(F.transform("p", lambda x: x["signature"]), "").alias("signature"),
            F.when(high.isNull(), 0).otherwise(gaps).cast("bigint").alias("gaps"),
            total("blank").alias("blank"), total("duplicate").alias("duplicate"), total("truncated").alias("truncated"),
            (total("illegal") + broken).alias("illegal"),
        )

    def _audits(self) -> DataFrame:
        """cost and audit of every distinct signature."""
        distinct = self.conversations.groupBy("signature").agg(F.lit(1)).select("signature", F.reverse("signature").alias("backward"))
        ranges = distinct.repartitionByRange(self.partitions, "backward").sortWithinPartitions("backward")
        return ranges.mapInArrow(_solved, "signature string, cost bigint, audit string")

    def summary(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation."""
        return self.conversations.join(self.solved, "signature").drop("signature")

    def turns(self) -> DataFrame:
        """The repaired turns: conv_id, place (from 0), role, text; a task holds whole conversations in order."""
        rows = with_order(self.rows).select("conv_id", F.lit(1).alias("kind"), *_ORDER, "text")
        none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in _ORDER]
        audits = self.summary().select("conv_id", F.lit(0).alias("kind"), *none, F.col("audit").alias("text"))
        both = audits.unionByName(rows).repartition(self.partitions, "conv_id").sortWithinPartitions("conv_id", "kind", *_ORDER)
        return both.select("conv_id", "kind", "role", "text").mapInArrow(_edited, "conv_id bigint, place bigint, role string, text string")

    def digests(self) -> DataFrame:
        """repaired_sha256 of every conversation that keeps a turn."""
        return self.turns().mapInArrow(_digested, "conv_id bigint, repaired_sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in, by the CRC-32 of ``conv_id:turn`` modulo 20."""
    def or_space(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")), F.lit(20))
    rows = rows.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")
