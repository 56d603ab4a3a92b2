"""Conversation repair against a plain search over all edit sequences."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from tallywatch.llm import conversations
from tallywatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
GRAMMAR = re.compile("(s?(ua)+)?")
SHOWN = re.compile(r"[^\x20\x09-\x0D]")


def order(row):
    turn, role, text = row
    return (turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest())


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = SHOWN.findall(text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last[0] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """Least (cost, audit) and the repaired lines, by trying every edit from every reachable prefix of roles."""
    def after(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))

    @lru_cache(None)
    def best(i, state, inserts):
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserts < 4:
            for role in ("user", "assistant"):
                to = after(state, role[0])
                if to:
                    cost, audit, lines = best(i, to, inserts + 1)
                    ways.append((cost + 2, "I" + audit, (f"{role}:", *lines)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, lines = best(i + 1, state, 0)
            ways.append((cost + 3, "D" + audit, lines))
            if kinds[i] not in ("blank", "duplicate"):
                for name, letter, price in ((role, "K", 0), ("user", "R", 2), ("assistant", "R", 2)):
                    to = after(state, name[:1])
                    if to:
                        cost, audit, lines = best(i + 1, to, 0)
                        ways.append((cost + price + (kinds[i] == "truncated"), letter + audit, (f"{name}:{text}", *lines)))
        return min(ways) if ways else (10**9, "~", ())

    for i in range(len(rows), 0, -1):  # from the end, so that no call goes deep
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    return best(0, "", 0)


def plain(rows):
    """conv_id -> all columns; rows are (conv_id, turn, role, text, copies)."""
    by = defaultdict(list)
    for conv, turn, role, text, copies in rows:
        by[conv].extend([(turn, " " if role is None else role, " " if text is None else text)] * copies)
    out = {}
    for conv, messages in by.items():
        messages.sort(key=order)
        kinds = faults(messages)
        turns = [t for t, _, _ in messages if t is not None]
        cost, audit, lines = cheapest(messages, kinds)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(messages, messages[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        assert GRAMMAR.fullmatch("".join(line[0] for line in lines))
        out[conv] = (gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def got(frame):
    rows = frame.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[n] for n in NAMES) for r in rows}


def frame(spark, rows):
    full = [(*r, "x", 1, "y") for r in rows]
    schema = "conv_id long, turn long, role string, text string, copies int, digest string, known int, row string"
    return (spark.createDataFrame(full, schema) if full else spark.createDataFrame([], schema)).repartition(4)


def summed(spark, rows):
    return got(conversations.summaries(frame(spark, rows), F.col("copies")))


def some(rng, conv, length, roles=("system", "user", "assistant", "tool", "", "u", None)):
    texts = ["Yes.", "No!", "cut off", "Why?\n", "", " \t", "again.", None]
    return [(conv, rng.choice([t, t, t, None, t // 2]), rng.choice(roles), rng.choice(texts), rng.choice([1, 1, 1, 0, 2, 3])) for t in range(length)]


def test_random_conversations(spark):
    rng = random.Random(4)
    rows = [r for conv in range(300) for r in some(rng, conv, rng.randrange(1, 12))]
    rows += some(rng, None, 9) + some(rng, -7, 5)
    assert summed(spark, rows) == plain(rows)


def test_defined_cases(spark):
    rows = [(1, 0, "user", "a.", 1), (1, 1, "assistant", "b.", 1),  # fine
            (2, 0, "user", "a.", 0), (2, 1, "assistant", "b.", 0),  # nothing left
            (3, None, "user", None, 1), (3, None, "user", "x.", 2),  # null turns and text
            (4, 5, "system", "s", 1), (4, 9, "user", "q?", 1), (4, 9, "user", "q?", 1), (4, 12, "user", "q?", 1),
            (5, 0, "assistant", "long. " * 50000, 1), (5, 1, "robot", "b", 1)]
    assert summed(spark, rows) == plain(rows)
    assert summed(spark, rows)[1] == (0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(b"user:a.\nassistant:b.").hexdigest())
    assert summed(spark, rows)[2] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert summed(spark, []) == {}


def test_a_conversation_over_many_tasks(spark):
    """Half of all rows in one conversation, turns that straddle tasks, one message in many copies."""
    rng = random.Random(5)
    rows = [(1, t // 5, rng.choice(["user", "assistant"]), rng.choice([f"{t}.", "same.", "same.", f"{t}"]), 1) for t in range(600)]
    rows += [(1, 7, "user", "copy.", 400)] + [r for conv in range(2, 60) for r in some(rng, conv, 9)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert summed(spark, rows) == plain(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


@pytest.mark.parametrize("length", range(5))
def test_every_short_signature(length):
    """All signatures of the nine letters, through one automaton, against the plain search."""
    letters = {"x": ("user", "blank"), "o": ("tool", ""), "O": ("tool", "truncated")}
    letters |= {r[0]: (r, "") for r in ("system", "user", "assistant")} | {r[0].upper(): (r, "truncated") for r in ("system", "user", "assistant")}
    signatures = ["".join(p) for p in itertools.product(sorted(letters), repeat=length)]
    automaton = conversations.SuffixAutomaton()
    for signature, cost, audit in automaton.solve(sorted(signatures, key=lambda s: s[::-1])):
        rows = [(0, letters[c][0], "") for c in signature]
        want = cheapest(rows, [letters[c][1] for c in signature])
        assert (cost, audit) == want[:2], signature
    assert len(automaton.known) <= 9 * 40


def test_long_signature_is_linear():
    automaton = conversations.SuffixAutomaton()
    signature = "suaUxxaoA" * 30_000
    (_, cost, audit), = automaton.solve([signature])
    assert cost > 0 and len(audit) >= len(signature)


def test_repaired_messages(spark):
    rng = random.Random(6)
    rows = [r for conv in range(80) for r in some(rng, conv, rng.randrange(1, 9))]
    by = defaultdict(list)
    for r in sorted(conversations.repaired(frame(spark, rows), F.col("copies")).collect(), key=lambda r: (r.conv_id, r.place)):
        assert r.place == len(by[r.conv_id])
        by[r.conv_id].append(f"{r.role}:{r.text}")
    for conv, want in plain(rows).items():
        assert hashlib.sha256("\n".join(by[conv]).encode()).hexdigest() == want[-1]


def test_query(spark):
    rows = []
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        fault = zlib.crc32(f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}".encode()) % 20
        text = " " if r.text is None else r.text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        rows.append((r.conv_id, r.turn, "user" if fault == 4 else r.role, text, {0: 0, 3: 2}.get(fault, 1)))
    assert got(QUERIES["op12_structure_repair"](spark, SF)) == plain(rows)
