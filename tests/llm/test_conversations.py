"""Conversation repair against all edits of short conversations, and the whole query against plain code."""

import hashlib
import heapq
import itertools
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from orestrata.llm import conversations as C


def searched(initials, faults):
    """The least (cost, audit) by a search over all edits, without the retained-subsequence recurrence."""
    queue, done = [(0, "", 0, "")], set()
    while queue:
        cost, audit, i, roles = heapq.heappop(queue)
        if i == len(initials) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit
        # Only the last role and whether any stands matter for what may follow.
        if (i, roles[-1:], audit) in done:
            continue
        done.add((i, roles[-1:], audit))
        after = {"": "su", "s": "u", "u": "a", "a": "u"}[roles[-1:]]
        for r in after.replace("s", ""):
            heapq.heappush(queue, (cost + 3, audit + "I", i, roles + r))
        if i < len(initials):
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, roles))
            if faults[i] in (C.FINE, C.CUT_OFF):
                own = 3 * (faults[i] == C.CUT_OFF)
                if initials[i] and initials[i] in after:
                    heapq.heappush(queue, (cost + own, audit + "K", i + 1, roles + initials[i]))
                for r in after.replace("s", ""):
                    heapq.heappush(queue, (cost + own + 3, audit + "R", i + 1, roles + r))
    raise AssertionError


def test_every_short_conversation():
    turns = list(itertools.product(["s", "u", "a", "x"], [C.FINE, C.CUT_OFF, C.BLANK]))
    for n in range(3):
        for c in itertools.product(turns, repeat=n):
            i, f = [x[0] for x in c], [x[1] for x in c]
            assert C.cheapest(i, f) == searched(i, f), c


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suuaax"), st.sampled_from([0, 0, 0, 1, 2, 3])), max_size=7))
def test_longer_conversations(c):
    i, f = [x[0] for x in c], [x[1] for x in c]
    assert C.cheapest(i, f) == searched(i, f)


def plain(rows):
    """The contract in plain code, for rows of (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        held = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            held += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, held in convs.items():
        held.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in held:
            s = text.strip(C.SPACES)
            faults.append(C.BLANK if not s else C.DUPLICATE if (role, text) in seen else C.CUT_OFF if s[-1] not in ".!?" else C.FINE)
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in held]
        cost, audit = C.cheapest(initials, faults)
        known = {t for t, _, _ in held if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        lines, i, last = [], 0, ""
        for e in audit:
            other = "assistant" if last == "u" else "user"
            if e == "I":
                lines.append(f"{other}:")
            elif e in "KR":
                lines.append(f"{held[i][1] if e == 'K' else other}:{held[i][2]}")
            if e != "D":
                last = lines[-1][0]
            i += e != "I"
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        counts = [faults.count(f) for f in (C.BLANK, C.DUPLICATE, C.CUT_OFF)]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_given_conversations(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = C.op13_retained_subsequence_repair(spark, sf_dir).collect()
    assert len(got) == len({r.conv_id for r in rows})
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got} == plain(map(tuple, rows))


def test_defined_cases(spark, tmp_path):
    long = "Many words go on. " * 20_000
    rows = [(k, t, r, x) for k in range(12) for t, (r, x) in enumerate([("system", "Be kind."), ("user", "Hi?"), ("user", "Hi?"), (None, None), ("tool", "x"), ("", "Yes."), ("assistant", long)])]
    rows += [(None, 0, "user", "a."), (None, None, "assistant", "b."), (50, None, None, None), (51, None, "user", ""), (52, 3, "assistant", "same."), (52, 3, "assistant", "same."), (52, 3, "user", "é\x85")]
    schema = T.StructType([T.StructField(c, k) for c, k in (("conv_id", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()))])
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 as gaps", "2 as kind", "text as audit", "3 as gone_by")
    df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = C.op13_retained_subsequence_repair(spark, str(tmp_path)).collect()
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got} == plain(rows) and len(got) == 16
    df.limit(0).write.parquet(f"{tmp_path}/empty/conversations.parquet")
    assert C.op13_retained_subsequence_repair(spark, f"{tmp_path}/empty").count() == 0


def test_all_turns_dropped(spark, tmp_path):
    one = next(k for k in itertools.count() if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    spark.createDataFrame([(one, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = C.op13_retained_subsequence_repair(spark, str(tmp_path)).first()
    assert [got[c] for c in COLUMNS] == [0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()]


def test_turns_of_the_repair(spark):
    turns = spark.createDataFrame([(1, 1, "user", "Hi."), (1, 2, "user", "So?"), (1, 3, "assistant", "")], "conv_id long, turn long, role string, text string")
    summary = C.audits(turns)
    # The second user turn becomes the assistant's (3), the blank one goes (4).
    assert (summary.first().cost, summary.first().audit) == (7, "KRD")
    got = [tuple(r)[1:] for r in C.repaired(turns, summary).orderBy("place").collect()]
    assert [(r[0], r[3]) for r in got] == [(0, "user"), (1, "assistant")]


@pytest.mark.parametrize("n", [2000])
def test_long_conversation_is_linear(n):
    cost, audit = C.cheapest(["u"] * n, [0] * n)
    assert cost == 3 * n // 2 and audit == "KR" * (n // 2)
