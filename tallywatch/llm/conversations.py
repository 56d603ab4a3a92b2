"""Conversation structure: faults, cheapest repair, repaired messages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.joins import spread_join
from .graph import saved

WHITE = " \t\n\x0b\x0c\r"
#: Grammar states: nothing yet, after the system message, after a user, after an assistant.
_STATES = 4
_ENDS = (0, 3)
_KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The one role that may be put next, and the state it leads to.
_PUT = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
_RETAG, _DELETE, _INSERT, _CUT = 2, 3, 2, 1
_ORDER = ["known", "turn", "role", "digest"]
_NONE = "CAST(NULL AS {})"


class SuffixAutomaton:
    """The signatures seen so far, shared from their ends, with cost-to-go and best edits of each node.

    A node stands for a suffix of signatures. Suffixes whose costs-to-go differ
    by a constant in all grammar states ask for the same edits before them, so
    they are one node here: ``step`` computes a node and symbol once, whatever
    the number of conversations and places it occurs at. Edits of a (node,
    state) start with different letters, so the ASCII-least cheapest audit is the
    least first letter among the cheapest ones, node after node.
    """

    def __init__(self):
        costs = [0 if s in _ENDS else None for s in range(_STATES)]
        letters = [""] * _STATES
        for s in (2, 1):  # the inserts that lead to an end
            to = _PUT[s][1]
            costs[s], letters[s] = _INSERT + costs[to], "I" + letters[to]
        self.end = (tuple(costs), 0, tuple((text, s) for s, text in enumerate(letters)))
        self.known: dict[tuple[tuple[int, ...], str], tuple] = {}

    def step(self, node: tuple, symbol: str) -> tuple:
        """The node for ``symbol`` before the suffix of ``node``: relative costs, base cost, edits by state."""
        costs, base, _ = node
        made = self.known.get((costs, symbol))
        if made is None:
            made = self.known[costs, symbol] = self._make(costs, symbol)
        return made[0], base + made[1], made[2]

    @staticmethod
    def _make(costs: tuple[int, ...], symbol: str) -> tuple:
        cut, role = _CUT if symbol.isupper() else 0, symbol.lower()
        moves = []
        for s in range(_STATES):
            ways = [(_DELETE + costs[s], "D", s)]
            if role != "x":
                if (s, role) in _KEEP:
                    to = _KEEP[s, role]
                    ways.append((cut + costs[to], "K", to))
                to = _PUT[s][1]
                ways.append((_RETAG + cut + costs[to], "R", to))
            moves.append(min(ways))
        best = [m[0] for m in moves]
        for _ in range(_STATES):  # inserts before the row, as many as help
            best = [min(best[s], _INSERT + best[_PUT[s][1]]) for s in range(_STATES)]

        def edits(s: int) -> tuple[str, int]:
            letters = ""
            while True:
                to = _PUT[s][1]
                ways = [(moves[s][1], moves[s][2])] if moves[s][0] == best[s] else []
                if _INSERT + best[to] == best[s]:
                    ways.append(("I", to))
                letter, s = min(ways)
                letters += letter
                if letter != "I":
                    return letters, s

        least = min(best)
        return tuple(b - least for b in best), least, tuple(edits(s) for s in range(_STATES))

    def solve(self, signatures: Iterable[str]) -> Iterator[tuple[str, int, str]]:
        """signature, cost and audit; signatures in the order of their reversed texts share the nodes of common ends."""
        path, before = [self.end], ""
        for signature in signatures:
            back = signature[::-1]
            shared = _common(back, before)
            del path[shared + 1 :]
            for symbol in back[shared:]:
                path.append(self.step(path[-1], symbol))
            before = back
            yield signature, path[-1][0][0] + path[-1][1], self._audit(path)

    @staticmethod
    def _audit(path: list[tuple]) -> str:
        state, out = 0, []
        for node in reversed(path):
            letters, state = node[2][state]
            out.append(letters)
        return "".join(out)


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _prepared(rows: DataFrame, copies: Column) -> DataFrame:
    """Rows with the columns of the order, the faults that lie in the text alone, and how often each counts."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    counted = copies > 0
    trimmed = F.rtrim(text, F.lit(WHITE))
    shown = lambda c: F.when(counted, c).otherwise("")
    return rows.select(
        "conv_id", (counted & F.col("turn").isNotNull()).alias("known"),
        F.when(counted, F.col("turn").cast("bigint")).alias("turn"), shown(role).alias("role"), shown(F.md5(text)).alias("digest"),
        shown(text).alias("text"), copies.cast("bigint").alias("copies"), (trimmed == "").alias("blank"),
        (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"),
    )


def _segments(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task knows of each conversation whose ordered rows it holds, at most one entry for a conversation."""
    done, now = [], None
    for part in parts:
        kind = part.column("conv_id").type
        for row in part.to_pylist():
            if now is None or now["conv_id"] != row["conv_id"]:
                if now:
                    done.append(now)
                now = dict(conv_id=row["conv_id"], known=row["known"], turn=row["turn"], role=row["role"], digest=row["digest"],
                           signature=[], turns=0, low=None, high=None, blank=0, duplicate=0, truncated=0, illegal=0, head=None, tail=None)
            if row["copies"]:
                _add(now, row)
        if now and len(done) > 2000:
            yield _batch(done, kind)
            done = []
    if now:
        yield _batch([*done, now], kind)


def _batch(done: list[dict], kind: pa.DataType) -> pa.RecordBatch:
    for segment in done:
        segment["signature"] = "".join(segment["signature"])
    types = dict(conv_id=kind, known=pa.bool_(), turn=pa.int64(), role=pa.string(), digest=pa.string(), signature=pa.string(),
                 head=pa.string(), tail=pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array([d[name] for d in done], types.get(name, pa.int64())) for name in _SEGMENT], names=_SEGMENT)


_SEGMENT = ["conv_id", "known", "turn", "role", "digest", "signature", "turns", "low", "high", "blank", "duplicate",
            "truncated", "illegal", "head", "tail"]
_SEGMENT_TYPES = ("known boolean, turn bigint, role string, digest string, signature string, turns bigint, low bigint, high bigint, "
                  "blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string")
_LEGAL = ("su", "ua", "au")


def _add(now: dict, row: dict) -> None:
    """One group of equal rows of the same turn, joined to the segment."""
    n, initial = row["copies"], row["role"][:1]
    letter = initial if initial in ("s", "u", "a") else "o"
    if row["blank"]:
        now["blank"] += n
        now["signature"].append("x" * n)
    elif row["later"]:
        now["duplicate"] += n
        now["signature"].append("x" * n)
    else:
        now["duplicate"] += n - 1
        now["truncated"] += row["cut"]
        now["signature"].append((letter.upper() if row["cut"] else letter) + "x" * (n - 1))
    if now["tail"] is not None:
        now["illegal"] += now["tail"] + initial not in _LEGAL
    now["illegal"] += n - 1
    now["head"] = initial if now["head"] is None else now["head"]
    now["tail"] = initial
    if row["turn"] is not None:
        now["turns"] += now["high"] != row["turn"]
        now["low"] = row["turn"] if now["low"] is None else now["low"]
        now["high"] = row["turn"]


def signatures(prepared: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal and the signature of each conversation."""
    alike = prepared.groupBy("conv_id", *_ORDER).agg(
        F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    alike = saved(alike, "messages")
    # the first turn at which a role says a text; later ones are duplicates
    place = F.struct("known", "turn")
    firsts = alike.where("copies > 0").groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"), F.count("*").alias("times"))
    conv_key = F.struct("conv_id").alias("conv")  # a struct of a null equals another
    firsts = firsts.where("times > 1").select(conv_key, "role", "digest", "first")
    joined = spread_join(alike.select("*", conv_key), firsts, ["conv", "role", "digest"], "left")
    later = F.coalesce(F.col("turn") > F.col("first.turn"), F.col("known") & ~F.col("first.known"), F.lit(False))
    rows = saved(joined.select("conv_id", *_ORDER, "copies", "blank", "cut", later.alias("later")), "messages")

    conv = f"conv_id {prepared.schema['conv_id'].dataType.simpleString()}, "
    ordered = rows.repartitionByRange("conv_id", *_ORDER).sortWithinPartitions("conv_id", *_ORDER)
    segments = ordered.mapInArrow(_segments, conv + _SEGMENT_TYPES)
    whole = segments.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct(*_ORDER, "signature", "low", "high", "head", "tail"))).alias("parts"),
        *[F.sum(c).alias(c) for c in ("turns", "blank", "duplicate", "truncated", "illegal")],
        F.min("low").alias("low"), F.max("high").alias("high"),
    )
    seams = F.when(F.size("parts") > 1, F.sequence(F.lit(1), F.size("parts") - 1)).otherwise(F.array().cast("array<int>"))
    part = lambda i, field: F.get("parts", i)[field]
    twice = F.size(F.filter(seams, lambda i: part(i, "low") == part(i - 1, "high")))
    broken = F.size(F.filter(seams, lambda i: ~F.concat(part(i - 1, "tail"), part(i, "head")).isin(*_LEGAL)))
    return whole.select(
        "conv_id", F.coalesce(F.col("high") - F.col("low") + 1 - (F.col("turns") - twice), F.lit(0)).cast("bigint").alias("gaps"),
        "blank", "duplicate", "truncated", (F.col("illegal") + broken).cast("bigint").alias("illegal"),
        F.array_join(F.transform("parts", lambda p: p["signature"]), "").alias("signature"),
    )


def _solve(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = SuffixAutomaton()
    rows, size = [], 0
    for row in automaton.solve(s for part in parts for s in part.column("signature").to_pylist()):
        rows.append(row)
        size += len(row[2])
        if size > 1 << 22:
            yield _solved(rows)
            rows, size = [], 0
    if rows:
        yield _solved(rows)


def _solved(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())],
        names=["signature", "cost", "audit"])


def _audits(prepared: DataFrame) -> DataFrame:
    found = saved(signatures(prepared), "signatures")
    back = F.reverse("signature")
    different = found.select("signature").distinct().repartitionByRange(back).sortWithinPartitions(back)
    solved = saved(different.mapInArrow(_solve, "signature string, cost bigint, audit string"), "audits")
    return spread_join(found, solved, ["signature"], "inner").drop("signature")


def audits(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """Faults and cheapest repair of each conversation.

    Result, one row per conv_id: conv_id, gaps, blank, duplicate, truncated,
    illegal, cost (longs), audit. Rows are taken by turn (nulls first), then by
    role and digest of the text. A row's first fault counts: blank, duplicate
    (role and text seen earlier), truncated (the last character that is not white
    is not one of ``.!?``). Edits, by their initials in ``audit``: Keep costs
    nothing, Rerole to user or assistant 2, Delete 3 (the only way for blank and
    duplicate rows), Insert an empty user or assistant message 2; a truncated row
    that stays adds 1. The repaired roles are an optional system message and
    pairs of user and assistant, or nothing; among the cheapest audits the
    ASCII-least counts.

    Method: a conversation becomes a signature, one letter for each row's role
    and fault. All different signatures are dealt out by their reversed texts and
    solved from the end (``SuffixAutomaton``), so common ends are solved once.

    Rows of a conversation are ordered by a range sort, which spreads a long one
    over many tasks; equal rows of a turn are counted before the first shuffle.
    Only signature and audit, a letter a row, are ever whole in one row.

    Null role or text is one space, hence a null text is blank; a null turn comes
    first and counts in no gap; null conv_ids are one conversation. ``copies``
    says how often a row counts, 1 unless given; a conversation without counted
    rows has zeros and an empty audit. Rows that repeat are duplicates. An empty
    table gives no row. Only conv_id, turn, role and text are read, so other
    columns do not matter; texts are read whole.
    """
    return _audits(_prepared(rows, F.lit(1) if copies is None else copies))


_KINDS = {"cost": "bigint", "audit": "string", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint",
          "illegal": "bigint"}


def _with_rows(prepared: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in their order, in one task."""
    rows = prepared.where("copies > 0").drop("blank", "cut")
    for name, kind in _KINDS.items():
        rows = rows.withColumn(name, F.expr(_NONE.format(kind)))
    heads = found.select(
        "conv_id", F.expr(_NONE.format("boolean")).alias("known"), F.expr(_NONE.format("bigint")).alias("turn"),
        *[F.expr(_NONE.format("string")).alias(c) for c in ("role", "digest", "text")], F.lit(0).cast("bigint").alias("copies"), *_KINDS)
    both = heads.unionByName(rows).withColumn("row", F.col("copies") > 0)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "row", *_ORDER)


class _Repair:
    """Messages of a conversation, edit by edit."""

    def __init__(self, head: dict):
        self.head, self.state, self.at = head, 0, 0

    def inserted(self) -> Iterator[tuple[str, str]]:
        audit = self.head["audit"]
        while self.at < len(audit) and audit[self.at] == "I":
            self.at += 1
            role, self.state = _PUT[self.state]
            yield role, ""

    def taken(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        letter = self.head["audit"][self.at]
        self.at += 1
        if letter == "K":
            self.state = _KEEP[self.state, role[:1]]
            yield role, text
        elif letter == "R":
            role, self.state = _PUT[self.state]
            yield role, text


def _repairs(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple[_Repair, Iterator[tuple[str, str]]]]:
    """Conversation after conversation: its repair and its next repaired messages, the last ones with ``None`` as end."""
    now = None
    for part in parts:
        for row in part.to_pylist():
            if not row["row"]:
                if now:
                    yield now, now.inserted()
                    yield now, None
                now = _Repair(row)
            else:
                for _ in range(row["copies"]):
                    yield now, now.taken(row["role"], row["text"])
    if now:
        yield now, now.inserted()
        yield now, None


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], schema.field(n).type) for n in range(len(schema))], schema=schema)


def repaired(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """The repaired messages: conv_id, place (from 0), role, text.

    Rows, order and edits as in ``audits``. Messages of a conversation come in
    one task, in order, and are streamed: none is held whole.
    """
    prepared = _prepared(rows, F.lit(1) if copies is None else copies)
    kind = prepared.schema["conv_id"].dataType.simpleString()

    def messages(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out, size, place = None, [], 0, {}
        for part, (repair, texts) in _tagged(parts):
            schema = schema or pa.schema([("conv_id", part.column("conv_id").type), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
            for role, text in texts or ():
                repair.place = getattr(repair, "place", -1) + 1
                out.append((repair.head["conv_id"], repair.place, role, text))
                size += len(text) + 50
            if size > 1 << 22:
                yield _columns(out, schema)
                out, size = [], 0
        if out:
            yield _columns(out, schema)

    return _with_rows(prepared, _audits(prepared)).mapInArrow(messages, f"conv_id {kind}, place bigint, role string, text string")


def _tagged(parts: Iterable[pa.RecordBatch]):
    """The repairs with a batch whose column types hold for them."""
    first = []

    def seen():
        for part in parts:
            if not first:
                first.append(part)
            yield part

    for step in _repairs(seen()):
        yield first[0], step


def summaries(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """What ``audits`` gives, with repaired_sha256: of the lines ``role:text`` of the repaired messages.

    The hash of a conversation is one sequential computation; its rows are
    streamed through one task in their order, none is held.
    """
    prepared = _prepared(rows, F.lit(1) if copies is None else copies)
    kind = prepared.schema["conv_id"].dataType.simpleString()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def hashed(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out, digest, lines = None, [], hashlib.sha256(), 0
        for part, (repair, texts) in _tagged(parts):
            schema = schema or pa.schema([("conv_id", part.column("conv_id").type), *[(n, pa.int64()) for n in names], ("audit", pa.string()), ("repaired_sha256", pa.string())])
            if texts is None:
                head = repair.head
                out.append((head["conv_id"], *[head[n] for n in names], head["audit"], digest.hexdigest()))
                digest, lines = hashlib.sha256(), 0
                if len(out) > 2000:
                    yield _columns(out, schema)
                    out = []
                continue
            for role, text in texts:
                digest.update((f"\n{role}:{text}" if lines else f"{role}:{text}").encode())
                lines += 1
        if out:
            yield _columns(out, schema)

    return _with_rows(prepared, _audits(prepared)).mapInArrow(
        hashed, f"conv_id {kind}, " + ", ".join(f"{n} bigint" for n in names) + ", audit string, repaired_sha256 string")
