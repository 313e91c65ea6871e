"""Operators give whole results where the generated tables are too tame to show it."""

import itertools

from gleaner import queries as Q
from gleaner.operators import dependencies as D
from gleaner.operators import similarity as S


def test_similarity_edges_finds_every_pair(spark):
    base = list(range(16))
    far = [i if i % 4 == 0 else 100 + i for i in range(16)]  # 4 of 16 slots equal, no two of them side by side
    near = [i if i < 3 else 200 + i for i in range(16)]  # 3 of 16
    sigs = {"a": base, "b": far, "c": base, "d": near, "e": [300 + i for i in range(16)]}
    got = S.similarity_edges(spark.createDataFrame(list(sigs.items()), "repo string, signature array<bigint>"), "repo", 0.25).collect()
    same = {p: sum(x == y for x, y in zip(sigs[p[0]], sigs[p[1]])) / 16 for p in itertools.combinations(sorted(sigs), 2)}
    assert {(r.a, r.b): r.similarity for r in got} == {p: s for p, s in same.items() if s >= 0.25}
    assert len(got) == 3


def test_signatures_are_the_survey_s_by_default(spark):
    sh = spark.createDataFrame([(k, f"w{i}") for k, n in (("a", 40), ("b", 40), ("c", 30)) for i in range(n)], "repo string, shingle string")
    sigs = S.minhash(sh, "repo")
    assert {len(r.signature) for r in sigs.collect()} == {128}
    assert {tuple(r) for r in S.signature_classes(sigs, "repo").collect()} == {("a", "a"), ("b", "a"), ("c", "c")}


def test_tree_holds_copies_and_lone_nodes(spark):
    sets = {"a": "xyz", "b": "xyw", "fork": "xyz", "fork2": "xyz", "lone": "q"}
    sh = spark.createDataFrame([(k, x) for k, v in sets.items() for x in v], "repo string, shingle string")
    pairs = {(r.a, r.b): r.similarity for r in S.jaccard_edges(sh, "repo", 0.5).collect()}
    assert pairs == {("a", "b"): 0.5, ("a", "fork"): 1.0, ("a", "fork2"): 1.0, ("b", "fork"): 0.5, ("b", "fork2"): 0.5, ("fork", "fork2"): 1.0}
    keys = spark.createDataFrame([(k,) for k in [*sets, "empty"]], "repo string")
    got = {r.node: (r.parent, r.level) for r in S.ingest_order(S.spanning_tree(S.tree_edges(sh, "repo", 0.5), keys)).collect()}
    assert got == {"a": (None, 0)} | {k: ("a", 1) for k in ("b", "fork", "fork2", "lone", "empty")}
    got = {r.node: (r.parent, r.level) for r in S.spanning_tree(S.tree_edges(sh, "repo", 0.5).filter("false"), keys.filter("repo in ('b', 'lone')")).collect()}
    assert got == {"b": (None, 0), "lone": ("b", 1)}


def test_cycles_of_any_length(spark):
    ring = [(f"n{i:02d}", f"n{(i + 1) % 15:02d}") for i in range(15)]
    more = [("n05", "n03"), ("x", "n00"), ("n07", "y"), ("y", "z"), ("z", "w"), ("w", "z"), ("s", "s")]
    got = {tuple(r.path) for r in D.cycles(spark, spark.createDataFrame(ring + more + ring[:2], "src string, dst string")).collect()}
    assert got == {tuple(a for a, _ in ring), ("n03", "n04", "n05"), ("w", "z"), ("s",)}
    assert D.cycles(spark, spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")).count() == 0


def test_chains_of_any_length(spark):
    line = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(55)]
    got = [r.path for r in D.import_chains(spark.createDataFrame([*line, ("n03", "n00"), ("n00", "z")], "src string, dst string"), "n00").collect()]
    assert sorted(got) == [[f"n{i:02d}" for i in range(56)], ["n00", "z"]]


def test_definitions_of_all_names(spark):
    got = {r.name for r in Q.queries()["t9_definitions"](spark, "/root/testdata/sf0.001").select("name").distinct().collect()}
    assert {"getName", "y_value", "onClick"} <= got and any(n.startswith("Widget") for n in got)
