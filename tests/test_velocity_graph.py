import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from tallywatch.operators.graph import hops_to_blacklist, nearest_lists, transfer_edges
from tallywatch.operators.proximity import proximity_edges, with_paths, with_proximity
from tallywatch.operators.scoring import with_features
from tallywatch.operators.velocity import velocity

NS = 10**9


def brute(rows, window_s):
    return sorted(
        (k, t, sum(1 for k2, t2 in rows if k2 == k and t - window_s * NS < t2 <= t)) for k, t in rows
    )


def counted(spark, rows, window_s, slot_s=1):
    df = spark.createDataFrame(rows, "account_id string, timestamp_ns bigint")
    return sorted(tuple(r) for r in velocity(df, window_s=window_s, slot_s=slot_s).collect())


@pytest.mark.parametrize("window_s, slot_s", [(1, 1), (10, 1), (60, 20), (3600, 1), (3600, 3600)])
def test_matches_brute_force(spark, window_s, slot_s):
    rng = random.Random(window_s)
    span = 4 * window_s * NS
    base = 1_704_067_200 * NS
    rows = [(rng.choice("AAAAB"), base + rng.randrange(span)) for _ in range(150)]
    edges = [base, base + window_s * NS, base + window_s * NS - 1, base + window_s * NS + 1]
    rows += [("A", t) for t in edges] + [("A", base)] * 5 + [("C", -5), ("C", 5), ("C", -window_s * NS)]
    assert counted(spark, rows, window_s, slot_s) == brute(rows, window_s)


def test_exactly_one_window_old_is_out(spark):
    assert [r[2] for r in counted(spark, [("A", 0), ("A", 3600 * NS)], 3600)] == [1, 1]
    assert [r[2] for r in counted(spark, [("A", 1), ("A", 3600 * NS)], 3600)] == [1, 2]


def test_accounts_do_not_mix(spark):
    rows = [("A", 7)] * 5 + [("B", 7)] * 3
    assert {(r[0], r[2]) for r in counted(spark, rows, 3600)} == {("A", 5), ("B", 3)}


def test_null_account_has_no_count(spark):
    assert counted(spark, [(None, 7)], 3600) == [(None, 7, None)]


def test_slot_must_divide_window(spark):
    with pytest.raises(ValueError):
        counted(spark, [("A", 1)], 10, 3)


def test_hot_account_is_spread(spark):
    """Most rows on one account: no partition of the widest window holds more than its share."""
    hot = spark.range(200_000).select(F.lit("HOT").alias("account_id"), (F.col("id") * 36_000_000).alias("timestamp_ns"))
    cold = spark.range(100_000).select(
        F.concat(F.lit("A"), (F.col("id") % 5000).cast("string")).alias("account_id"),
        (F.col("id") * 72_000_000).alias("timestamp_ns"))
    out = velocity(hot.unionByName(cold), window_s=600)
    rows = out.where("account_id = 'HOT'").agg(
        F.count("*").alias("n"), F.max("velocity").alias("most"), F.min("velocity").alias("least")).first()
    assert (rows["n"], rows["most"], rows["least"]) == (200_000, 16667, 1)


def walk(edges, listed, most):
    back = defaultdict(set)
    for a, b in edges:
        back[b].add(a)
    hops, queue = {n: 0 for n in listed}, deque(listed)
    while queue:
        node = queue.popleft()
        for prev in back[node]:
            if prev not in hops and hops[node] < most:
                hops[prev] = hops[node] + 1
                queue.append(prev)
    return hops


@pytest.mark.parametrize("most", [1, 3, 5])
def test_hops_match_breadth_first_search(spark, most):
    rng = random.Random(most)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(90)]
    edges += [(f"n{i}", "hub") for i in range(40)] + [("hub", "x1"), ("x1", "x2"), ("n1", "n1")] * 3
    listed = ["x2", "n5", "elsewhere"]
    df = transfer_edges(spark.createDataFrame(edges, "account_id string, counterparty_id string"))
    got = hops_to_blacklist(df, spark.createDataFrame([(n,) for n in listed * 2], "node string"), most, per_part=2)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(dict(rows)) and dict(rows) == walk(edges, listed, most)


def test_edges(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "b"), ("c", "b"), ("d", "d")], "src string, dst string")
    both = transfer_edges(df, "src", "dst", both_ways=True).collect()
    assert sorted(tuple(r) for r in both) == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")]
    assert sorted(tuple(r) for r in transfer_edges(df, "src", "dst").collect()) == [("a", "b"), ("b", "a"), ("c", "b")]


def plain_nearest(edges, lists, most):
    """node -> (hops, tier, name, path), by trying every way of fewest transfers."""
    forward = defaultdict(set)
    for a, b in edges:
        if a != b and a is not None and b is not None:
            forward[a].add(b)
    best = {}
    for node, tier, name in lists:
        if node is not None:
            best[node] = min(best.get(node, (0, tier, name, (node,))), (0, tier, name, (node,)))
    for hop in range(1, most + 1):
        found = {}
        for node in set(forward) - set(best):
            ways = [(best[to][1:3], to, (node, *best[to][3])) for to in forward[node] if to in best and best[to][0] == hop - 1]
            if ways:
                (tier, name), _, path = min(ways)
                found[node] = (hop, tier, name, path)
        best |= found
    return best


@pytest.mark.parametrize("most", [1, 4, 7])
def test_nearest_lists(spark, most):
    """Several lists, nodes on two lists, ties of tier, name and next node, hubs cut into parts, nulls."""
    rng = random.Random(most)
    edges = [(f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for _ in range(130)]
    edges += [(f"n{i}", "hub") for i in range(0, 90, 3)] + [("hub", "x1"), ("x1", "x2"), ("n1", "n1"), (None, "n2"), ("n3", None)]
    lists = [("x2", 2, "B"), ("n5", 1, "C"), ("n5", 1, "A"), ("n6", 1, "A"), ("n6", 3, "Z"), ("n7", 2, "B"), ("elsewhere", 1, "A"), (None, 1, "A")]
    df = transfer_edges(spark.createDataFrame(edges, "account_id string, counterparty_id string"))
    got = nearest_lists(df, spark.createDataFrame(lists, "node string, tier int, list_name string"), most, per_part=3).collect()
    want = plain_nearest(edges, lists, most)
    assert {r.node: (r.hops, r.tier, r.list_name, tuple(r.path)) for r in got} == want and len(got) == len(want)
    none = nearest_lists(df, spark.createDataFrame([], "node string, tier int, list_name string"), most)
    assert none.count() == 0


def test_proximity(spark):
    """The nearer party counts; its path has every node, and every edge is a transfer."""
    chain = [(f"c{i}", f"c{i + 1}") for i in range(9)]
    txns = spark.createDataFrame([(f"T{n}", a, b) for n, (a, b) in enumerate([*chain, ("p", "q"), ("c9", "p"), ("c3", None)])],
                                 "txn_id string, account_hash string, counterparty_hash string")
    lists = spark.createDataFrame([("c9", 2, "LIST")], "node string, tier int, list_name string")
    near = nearest_lists(transfer_edges(txns, "account_hash", "counterparty_hash"), lists, 8)
    placed = with_proximity(txns, near)
    got = {r.txn_id: (r.hops, r.list_name, len(r.path)) for r in placed.collect()}
    assert got == {**{f"T{n}": (8 - n, "LIST", 9 - n) for n in range(9)}, "T9": (8, "NONE", 0), "T10": (0, "LIST", 1), "T11": (6, "LIST", 7)}
    rows = [tuple(r) for r in proximity_edges(placed).orderBy("txn_id", "seq").collect()]
    assert {(src, dst) for _, _, src, dst, _, _ in rows} <= set(chain)
    first = [r for r in rows if r[0] == "T0"]
    assert [r[1] for r in first] == list(range(8)) and first[0][2] == "c1"
    assert [r[4:] for r in first] == [("TRANSFERS_TO", f"c{i}") for i in range(2, 9)] + [("8 HOPS", "LIST")]
    assert [r[4] for r in rows if r[0] == "T7"] == ["1 HOP"] and not [r for r in rows if r[0] in ("T8", "T9", "T10")]


def test_hub_with_half_of_all_edges(spark):
    """Only the hub is cut into parts, and the table of edges is gone when the search ends."""
    edges = [(f"n{i}", "hub") for i in range(300)] + [(f"m{i}", f"n{i}") for i in range(300)]
    df = spark.createDataFrame(edges, "src string, dst string")
    before = {t.name for t in spark.catalog.listTables()}
    got = {r["node"]: r["hops"] for r in hops_to_blacklist(df, spark.createDataFrame([("hub",)], "node string"), 5, per_part=40).collect()}
    assert got == {"hub": 0, **{f"n{i}": 1 for i in range(300)}, **{f"m{i}": 2 for i in range(300)}}
    assert {t.name for t in spark.catalog.listTables()} == before


def test_paths_only_where_wanted(spark):
    """Features carry no path; the edges from a later look-up are those of the whole rows, ties and far rows included."""
    pairs = [("a", "b"), ("b", "x"), ("c", "d"), ("e", "f"), ("f", "y"), ("a", "e"), ("x", "y"), ("c", None)]
    txns = spark.createDataFrame(
        [(f"T{n}", a, b, a, b, 100, "NEFT", n) for n, (a, b) in enumerate(pairs)],
        "txn_id string, account_id string, counterparty_id string, account_hash string, counterparty_hash string, "
        "amount_cents bigint, txn_type string, timestamp_ns bigint")
    lists = spark.createDataFrame([("x", 1, "L"), ("y", 1, "L")], "node string, tier int, list_name string")
    near = nearest_lists(transfer_edges(txns, "account_hash", "counterparty_hash"), lists, 5)
    whole = with_proximity(txns, near)
    features = with_features(txns, near)
    assert "path" not in features.columns
    ends = {r.txn_id: (r.path or [None])[0] for r in whole.collect()}
    assert {r.txn_id: r.nearer for r in features.collect()} == ends
    assert ends["T5"] == "a" and ends["T2"] is None
    edges = lambda rows: sorted(tuple(r) for r in rows.collect())
    assert edges(proximity_edges(features, near)) == edges(proximity_edges(whole)) != []
    assert {r.txn_id: len(r.path) for r in with_paths(features, near).collect()} == {r.txn_id: len(r.path) for r in whole.collect()}


def test_features_of_some_rows_count_all(spark):
    """Rows left out of the result still count in the velocity of the others."""
    txns = spark.createDataFrame(
        [(f"T{n}", f"A{n % 2}", "B", f"A{n % 2}", "B", 100, "NEFT", n) for n in range(10)],
        "txn_id string, account_id string, counterparty_id string, account_hash string, counterparty_hash string, "
        "amount_cents bigint, txn_type string, timestamp_ns bigint")
    lists = spark.createDataFrame([("B", 1, "L")], "node string, tier int, list_name string")
    near = nearest_lists(transfer_edges(txns, "account_hash", "counterparty_hash"), lists, 5)
    some = with_features(txns, near, of=txns.where("txn_id in ('T7', 'T8')"))
    assert {(r.txn_id, r.velocity, r.hops) for r in some.collect()} == {("T7", 4, 0), ("T8", 5, 0)}
