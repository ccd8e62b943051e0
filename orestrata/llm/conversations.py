"""Conversation structure repair: the cheapest edits that make a conversation an optional system turn and then
user and assistant in turn, by dynamic programming over the turns that are retained.

A turn that is retained is kept, or gets the role user or assistant. Between two
retained turns all others are deleted, at a price that is a difference of prefix
sums, and the pair of their roles says how many turns have to be inserted. So
the cheapest way on from a turn is a minimum over later retained turns, of which
one running minimum a role is enough: the work is linear in the turns. Of the
cheapest edits, the audit that comes first in ASCII order is taken; it is read
off the stored minima from left to right.

Turns and texts are handled apart. The first pass sorts each conversation's
turns without their texts and writes one row a conversation; its memory is a few
numbers a turn, as the audit itself has a letter a turn. The second pass streams
the texts past the audits, so no conversation's texts are held in memory,
however long it is; a conversation that holds a third of all rows is one stream,
since its digest is.

Defined cases: a null role or text is one blank; a null ``conv_id`` is a
conversation of its own; null turns come first; rows of one turn are ordered by
role, then by the md5 of their text; a role that begins with none of s, u and a
can't be kept; a conversation without rows needs no edits and has an empty audit; an
empty table gives no rows; columns other than the four are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orestrata.llm.common import cut, small_batches, table

#: Prices: an inserted turn, a changed role, a deleted turn, a truncated turn that stays.
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
SPACES = " \t\n\x0b\x0c\r"
#: Faults of a turn.
FINE, BLANK, DUPLICATE, CUT_OFF = 0, 1, 2, 3
#: The last role that stands: none yet, system, user, assistant.
START, S, U, A = range(4)
ROLE_OF = {"s": S, "u": U, "a": A}
NAMES = {U: "user", A: "assistant"}
#: The role that an inserted or reroled turn has after each of them.
NEXT = (U, U, A, U)
_NEVER = 1 << 60
#: Turns to insert between two roles that stand next to each other, and after the last.
BETWEEN = ((_NEVER, 0, 0, 1), (_NEVER, _NEVER, 0, 1), (_NEVER, _NEVER, 1, 0), (_NEVER, _NEVER, 0, 1))
AT_END = (0, 2, 1, 0)
LEGAL = {"su", "ua", "au"}


def cheapest(initials: list[str], faults: list[int]) -> tuple[int, str]:
    """The least cost of a conversation's repair, and the first audit in ASCII order among those of that cost.

    The audit has one letter an edit: K keep, R rerole, D delete, I insert.
    """
    n = len(initials)
    tail = [array("q", bytes(8 * (n + 1))) for _ in range(4)]  # tail[role][i]: cost of turns i.. after a turn of that role
    least = [_NEVER] * 4  # least[role]: of retaining some later turn as that role, with the deletions before it as a prefix sum

    def settle(i: int) -> None:
        for last in range(4):
            ways = [DELETE * n + INSERT * AT_END[last]] + [least[r] + INSERT * BETWEEN[last][r] for r in (S, U, A)]
            tail[last][i] = min(ways) - DELETE * i

    settle(n)
    for i in range(n - 1, -1, -1):
        if faults[i] in (FINE, CUT_OFF):
            own = TRUNCATED if faults[i] == CUT_OFF else 0
            for r in (S, U, A):
                if ROLE_OF.get(initials[i]) == r:
                    price = own
                elif r == S:
                    continue
                else:
                    price = own + REROLE
                least[r] = min(least[r], DELETE * i + price + tail[r][i + 1])
        settle(i)

    audit, i, last = [], 0, START
    while i < n or tail[last][i]:
        left, after = tail[last][i], NEXT[last]
        stays = i < n and faults[i] in (FINE, CUT_OFF)
        own = TRUNCATED if stays and faults[i] == CUT_OFF else 0
        role = ROLE_OF.get(initials[i]) if stays else None
        if i < n and DELETE + tail[last][i + 1] == left:
            audit.append("D")
            i += 1
        elif INSERT + tail[after][i] == left:
            audit.append("I")
            last = after
        elif role is not None and BETWEEN[last][role] == 0 and own + tail[role][i + 1] == left:
            audit.append("K")
            i, last = i + 1, role
        else:
            audit.append("R")
            i, last = i + 1, after
    return tail[START][0], "".join(audit)


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone`` after the damage that a turn's number decides. A row that is dropped stays as one that is ``gone``."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(some("text"), "[.!?]", "")).otherwise(some("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1)))
    role = F.when(kind == 4, "user").otherwise(some("role"))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), copies.alias("_n")).drop("_n")


def _ordered(turns: DataFrame) -> DataFrame:
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    gone = F.col("gone") if "gone" in turns.columns else F.lit(False)
    turns = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), some("role").alias("role"), some("text").alias("text"), gone.alias("gone"))
    return turns.withColumn("key", F.md5(F.col("text").cast("binary")))


def _fields(df: DataFrame, more: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", df.schema["conv_id"].dataType), *T._parse_datatype_string(more).fields])


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(turns: DataFrame) -> DataFrame:
    """One row a conversation of ``turns`` (``conv_id, turn, role, text`` and, if there is one, ``gone``, which says that a row isn't there any more):
    its gaps, faults, illegal neighbours, and the cost and audit of its repair."""
    rows = _ordered(turns)
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "key", "gone").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when(F.col("last") == "", BLANK).when(F.col("seen") > 1, DUPLICATE).when(~F.col("last").isin(".", "!", "?"), CUT_OFF).otherwise(FINE)
    marks = rows.select("conv_id", "turn", "role", "key", "gone", last.alias("last")).withColumn("seen", seen).withColumn("fault", fault)
    marks = marks.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "key", "fault")
    marks = marks.select("conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), "fault", "gone")
    names = [f.split()[0] for f in SUMMARY.split(", ")]

    def closed(conv, turns: list, initials: list, faults: list) -> list:
        known = [t for t in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(x + y not in LEGAL for x, y in zip(initials, initials[1:]))
        return [conv, gaps, *(faults.count(f) for f in (BLANK, DUPLICATE, CUT_OFF)), illegal, *cheapest(initials, faults)]

    def batch(out: list[list], key: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [[]] * (1 + len(names))
        kinds = [key, *[pa.int64()] * (len(names) - 1), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=["conv_id", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            out = []
            for conv, turn, initial, fault, gone in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if now is None or conv != now[0]:
                    if now is not None:
                        out.append(closed(*now))
                    now = (conv, [], [], [])
                if not gone:
                    for held, x in zip(now[1:], (turn, initial, fault)):
                        held.append(x)
            yield batch(out, b.schema.field(0).type)
        if now is not None:
            yield batch([closed(*now)], b.schema.field(0).type)

    return marks.mapInArrow(run, _fields(turns, SUMMARY))


REPAIRED = "place long, edit string, turn long, role string, text string"


def repaired(turns: DataFrame, summary: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: ``place`` from 0, the ``edit`` that each comes from (K, R or I), and for those that
    were there before, their ``turn``. ``summary`` is that of :func:`audits`. A task's rows are in order, each conversation's together."""
    small_batches(turns.sparkSession)
    rows = _ordered(turns).where(~F.col("gone")).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "key")
    plans = summary.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit("").alias("key"))
    met = plans.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "key").drop("key")
    names = ["conv_id", *[f.split()[0] for f in REPAIRED.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for b in batches:
            out: list[tuple] = []
            for conv, kind, turn, role, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if kind == 0:
                    walk = Walk(text)
                    out += [(conv, *x) for x in walk.inserted()]
                else:
                    out += [(conv, *x) for x in walk.turn(turn, role, text)]
            kinds = [b.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(list(zip(*out)) or [[]] * 6, kinds, strict=True)], names=names)

    return met.mapInArrow(run, _fields(turns, REPAIRED))


class Walk:
    """Applies an audit to a conversation's turns as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place, self.last = audit, 0, 0, START

    def _put(self, edit: str, turn, role: int, name: str, text: str) -> tuple:
        self.last, self.place = role, self.place + 1
        return self.place - 1, edit, turn, name, text

    def inserted(self) -> Iterator[tuple]:
        """The turns that come before the next one that was there."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._put("I", None, NEXT[self.last], NAMES[NEXT[self.last]], "")

    def turn(self, turn, role: str, text: str) -> Iterator[tuple]:
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            yield self._put("K", turn, ROLE_OF[role[:1]], role, text)
        elif edit == "R":
            yield self._put("R", turn, NEXT[self.last], NAMES[NEXT[self.last]], text)
        yield from self.inserted()


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of rows whose conversations stand together and in order, as those of :func:`repaired` do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            out = []
            for conv, place, role, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if place == 0:
                    if now is not None:
                        out.append((now[0], now[1].hexdigest()))
                    now = (conv, hashlib.sha256())
                now[1].update(f"{chr(10) if place else ''}{role}:{text}".encode("utf-8", "replace"))
            yield batch(out, b.schema.field(0).type)
        if now is not None:
            yield batch([(now[0], now[1].hexdigest())], b.schema.field(0).type)

    def batch(out: list[tuple], key: pa.DataType) -> pa.RecordBatch:
        ids, hashes = zip(*out) if out else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(ids, key), pa.array(hashes, pa.string())], names=["conv_id", "repaired_sha256"])

    return turns.select("conv_id", "place", "role", "text").mapInArrow(run, _fields(turns, "repaired_sha256 string"))


def op13_retained_subsequence_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = damaged(table(spark, sf_dir, "conversations"))
    summary = cut(audits(turns))
    hashes = digests(repaired(turns, summary)).withColumnRenamed("conv_id", "_conv")
    out = summary.join(hashes, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))
