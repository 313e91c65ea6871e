"""Every own query with SQL gives what DuckDB gives."""

import duckdb
import pytest

from gleaner import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(items):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in items)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = Q.queries()[name](spark, SF)
    sql = Q.oracle_sql()[name]
    cols = sorted(df.columns)
    assert cols == sorted(con.sql(sql).columns)
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({sql})").fetchall()
    assert rows(tuple(r) for r in df.select(*cols).collect()) == rows(want)


def test_cognitive(spark):
    def brute(content):
        import re

        total = level = 0
        for line in content.split("\n"):
            x = line.strip()
            if re.match(r"(if|for|while|try|with|def|class)\b", x):
                total += 1 + level
                level += x.endswith(":")
            if x.startswith(("return", "break", "continue", "raise")):
                level = max(0, level - 1)
        return total

    got = {r.file_path: r.cognitive for r in Q.queries()["a3_cognitive"](spark, SF).collect()}
    assert got == {r.file_path: brute(r.content) for r in Q.code(spark, SF).collect()}


def test_spanning_tree_has_greatest_weight(spark):
    import itertools

    from gleaner.operators import similarity as S

    edges = [("a", "b", 0.9), ("b", "c", 0.8), ("a", "c", 0.7), ("d", "e", 0.6), ("c", "f", 0.9)]
    got = S.spanning_tree(spark.createDataFrame(edges, "a string, b string, similarity double")).collect()
    weight = {frozenset(x[:2]): x[2] for x in edges}
    assert len(got) == 6 and sum(r.parent is None for r in got) == 2
    assert round(sum(weight[frozenset((r.node, r.parent))] for r in got if r.parent), 6) == 3.2
    assert len(set(itertools.chain(r.node for r in got))) == 6


def test_quality_and_ranker_cover_all_files(spark):
    assert Q.queries()["a8_quality"](spark, SF).count() == 200
    assert Q.queries()["r2_learn_to_rank"](spark, SF).count() == 200
    assert Q.queries()["s10_spanning_tree"](spark, SF).filter("parent is null").count() >= 1
