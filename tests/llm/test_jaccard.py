"""The driver during the Jaccard join."""


def test_driver_garbage_goes_between_steps(spark, monkeypatch):
    """Plans of finished steps do not fill the driver's heap up to its limit."""
    from tallywatch.llm import jaccard
    times = []
    monkeypatch.setattr(jaccard, "tidy", times.append)
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x y z")], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert len(times) >= 4


def test_open_signatures_are_found_once(spark):
    """Later steps read the members from files, and a pair that was verified already is no open signature."""
    from tallywatch.llm import jaccard
    from tallywatch.llm.graph import saved
    ties = saved(spark.createDataFrame([(4, 1, 2), (8, 1, 2), (8, 1, 3), (12, 5, 6), (12, 5, 7), (0, 1, 9)], "sig long, a long, b long"), "ties")
    found = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (7, 5)], "node long, component long")
    members = jaccard._apart(ties.unionByName(spark.createDataFrame([(16, 1, 8)], ties.schema)), found)
    assert {tuple(r) for r in members.collect()} == {(8, 1, 1), (8, 2, 1), (8, 3, 3)}
    chosen = jaccard._sampled(jaccard._largest(members))
    assert "LeftSemi" not in chosen._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in chosen.collect()} == {(1, 3), (2, 3)}
    later = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], found.schema)
    assert jaccard._still_apart(members, later).count() == 0 and jaccard._still_apart(members, found).count() == 3
