"""Plans that hold for tables that are much larger than Spark takes them for."""

import hashlib
import re

import pytest

from pyspark.sql import functions as F

from gleaner import queries as Q
from gleaner.functions import text as T
from gleaner.operators import intel as X
from gleaner.operators import similarity as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hashed_once(df):
    """Whether rows are grouped by key and shingle below each aggregate of hashes."""
    text = df._jdf.queryExecution().optimizedPlan().toString()
    hashes = len(re.findall(r"Aggregate \[repo#\d+\], \[[^\n]*min\(", text))
    return hashes > 0 and len(re.findall(r"Aggregate \[repo#\d+, shingle#\d+\], \[repo#\d+, shingle#\d+, count", text)) == hashes


@pytest.fixture()
def files(spark, tmp_path):
    rows = [(f"f{i}.py", "python", "class A:\n    x = 1\n    def f(self):\n        y = A") for i in range(3)] + [("g.js", "javascript", "let zz = A;\nfunction x(y) {}")]
    spark.createDataFrame(rows, "file_path string, language string, content string").write.parquet(f"{tmp_path}/files")
    return spark.read.parquet(f"{tmp_path}/files")


def test_hover_sends_no_table_through_the_driver(files):
    points = X.code_lines(files).selectExpr("file_path", "line", "9 AS at_column")
    got = X.hover(points, X.symbols(files))
    assert "Broadcast" not in plan(got)
    assert sorted((r.file_path, r.line, r.name, r.kind) for r in got.collect()) == sorted(
        [(f"f{i}.py", line, name, kind) for i in range(3) for line, name, kind in ((1, "A", "class"), (2, "x", "variable"), (3, "f", "function"), (4, "y", "variable"))]
        + [("g.js", 1, "zz", "variable"), ("g.js", 2, "x", "function")])


def least(shingles, i):
    return min(int.from_bytes(hashlib.sha256(f"{i}:{s}".encode()).digest()[:4], "little") for s in shingles)


def test_minhash_hashes_a_shingle_of_a_key_once(spark):
    rows = [("a", w) for w in ["x", "y", "x", "x", "z"]] + [("b", "y"), ("b", "y")]
    sh = spark.createDataFrame(rows, "repo string, shingle string")
    for given in (sh, sh.distinct()):
        got = S.minhash(given, "repo", 4)
        assert hashed_once(got)
        assert {r.repo: r.signature for r in got.collect()} == {k: [least({w for x, w in rows if x == k}, i) for i in range(4)] for k in "ab"}


@pytest.mark.parametrize("name", ["s6_minhash", "s7_estimate", "s9_lsh"])
def test_queries_hash_a_shingle_of_a_repository_once(spark, name):
    assert hashed_once(Q.queries()[name](spark, "/root/testdata/sf0.001"))


def test_definitions_send_no_table_through_the_driver(files):
    got = X.go_to_definition(X.references(files).select("file_path", "line", "name").distinct(), X.symbols(files))
    assert "Broadcast" not in plan(got)
    want = [(f"f{i}.py", line, name, f"f{i}.py", at, kind) for i in range(3) for line, name, at, kind in (
        (1, "A", 1, "class"), (2, "x", 2, "variable"), (3, "f", 3, "function"), (4, "A", 1, "class"), (4, "y", 4, "variable"))]
    want += [("g.js", 1, "zz", "g.js", 1, "variable"), ("g.js", 2, "x", "g.js", 2, "function")]
    want += [("g.js", line, name, f"f{i}.py", at, kind) for i in range(3) for line, name, at, kind in ((1, "A", 1, "class"), (2, "y", 4, "variable"))]
    assert sorted(tuple(r) for r in got.select("file_path", "line", "name", "def_file", "def_line", "kind").collect()) == sorted(want)


def test_a_common_name_is_dealt_over_tasks(spark):
    refs = spark.range(300).selectExpr("concat('r', id) AS file_path", "id AS line", "CASE WHEN id < 290 THEN 'x' WHEN id < 295 THEN 'rare' ELSE 'none' END AS name")
    defs = spark.range(200).selectExpr("CASE WHEN id < 195 THEN 'x' ELSE 'rare' END AS name", "concat('d', id) AS def_file", "id AS def_line")
    got = X._by_name(refs, defs, 30, 20)
    assert got.filter("name = 'x'").select("_x", "_y").distinct().count() == 10 * 10
    assert got.groupBy("_x", "_y").count().agg({"count": "max"}).first()[0] < 3 * 30 * 20
    pairs = {(r.line, r.def_line) for r in got.collect()}
    assert pairs == {(a, b) for a in range(290) for b in range(195)} | {(a, b) for a in range(290, 295) for b in range(195, 200)}
    assert got.count() == len(pairs)


def hash_plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_hash_is_compiled_once_and_not_once_a_seed(spark):
    sh = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), (None, "z"), ("c", None)], "repo string, shingle string")
    got = S.minhash(sh, "repo", 24)
    assert hash_plan(got).count("sha2(") <= 4  # one, which the four swapped bytes share; never one a seed
    want = {"a": "xy", "b": "y", None: "z"}
    rows = {r.repo: r.signature for r in got.collect()}
    assert {k: rows[k] for k in want} == {k: [least(x, i) for i in range(24)] for k, x in want.items()} and set(rows) == {*want, "c"}


def test_a_line_of_a_repository_is_parted_once(spark, monkeypatch):
    texts = [("a", "fooBar_baz\nimport os\n"), ("a", "import os\nx = 1"), ("b", "import os\n\nfoo\nBar_\n_Baz\r\n= é ok\u0085y, 日本"), ("b", None), ("b", ""), ("c", "\n")]
    files = spark.createDataFrame(texts, "repo string, content string")
    monkeypatch.setattr(Q, "code", lambda *_, **__: files)
    got = Q._repo_shingles(spark, "")
    whole = files.select("repo", F.explode(T.code_words(F.col("content"))).alias("shingle")).distinct()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    assert re.search(r"Generate explode\(regexp_extract_all[^\n]*\n[^\n]*Aggregate \[repo#\d+, line#\d+\]", hash_plan(got))


def test_pairs_of_signatures_need_few_branches(spark):
    assert hash_plan(Q.queries()["s7_estimate"](spark, "/root/testdata/sf0.001")).count("Relation [") <= 6
    rows = [("a", [1, 2, 3, 4]), ("b", [1, 2, 3, 4]), ("c", [1, 2, 9, 9]), ("d", [7, 7, 7, 7]), ("e", [1, 2, 9, 9]), ("f", [None, 2, 3, None]), ("g", [None, 2, 3, None])]
    sigs = spark.createDataFrame(rows, "repo string, signature array<bigint>")
    alike = lambda x, y: 1.0 if x == y else sum(p == q is not None for p, q in zip(x, y)) / 4
    want = {(p, q, alike(x, y)) for p, x in rows for q, y in rows if p < q and alike(x, y) >= 0.5}
    assert {tuple(r) for r in S.similarity_edges(sigs, "repo", 0.5).collect()} == want
    assert {tuple(r) for r in S.similarity_edges(sigs, "repo", 0.5, copies=False).collect()} == {x for x in want if x[2] < 1}
    assert {tuple(r) for r in S.similarity_edges(sigs, "repo", 1.5).collect()} == set()


def test_candidates_hash_rows_of_seeds_of_lines_parted_once(spark):
    text = hash_plan(Q.queries()["s9_lsh"](spark, "/root/testdata/sf0.001"))
    assert text.count("sha2(") <= 2 * 4  # two sides of the join
    assert len(re.findall(r"Generate explode\(regexp_extract_all[^\n]*\n[^\n]*Aggregate \[repo#\d+, line#\d+\]", text)) == 2


def test_candidates_part_lines_in_one_pass_and_shuffle_no_repeated_pairs(spark):
    text = hash_plan(Q.queries()["s9_lsh"](spark, "/root/testdata/sf0.001"))
    assert "regexp_replace" not in text
    assert not re.search(r"Aggregate \[repo#\d+, shingle#\d+\], \[repo#\d+, shingle#\d+\]", text)  # words are made distinct once, where they are counted
    assert not re.search(r"Aggregate \[a#\d+, b#\d+\]", text)
    rows = [("a", [1, 2, 3, 4, 5, 6]), ("b", [1, 2, 3, 4, 9, 9]), ("c", [7, 7, 3, 4, 9, 9]), ("d", [1, 2, 3, 4, 5, 6]), ("e", [2, 1, 4, 3, 6, 5]),
            ("f", [None, 2, 8, 8, 8, 8]), ("g", [None, 2, 8, 8, 0, 0]), ("h", [0, 0, 0, 0, 5, 6])]
    sigs = spark.createDataFrame(rows, "repo string, signature array<bigint>")
    got = [tuple(r) for r in S.lsh_candidates(sigs, "repo", 3).collect()]
    kept = {}
    for k, x in rows:
        kept.setdefault(tuple(x), k)
    want = {(p, q) for x, p in kept.items() for y, q in kept.items() if p < q and any(x[i: i + 2] == y[i: i + 2] for i in (0, 2, 4))}
    assert sorted(got) == sorted(want) == [("a", "b"), ("a", "c"), ("a", "h"), ("b", "c"), ("f", "g")]


def test_code_is_parted_as_by_three_patterns(spark):
    three = F.regexp_extract_all(F.regexp_replace(F.regexp_replace("t", "([a-z])([A-Z])", "$1 $2"), "_+", " "), F.lit(r"(?U)[a-zA-Z0-9]+|[^\s\w]"), F.lit(0))
    texts = ["getHTTPResponse2xx_A1bC__d9E", "aBcDeF", "A", "a1B2c3", "__", "_x_", "x\u0085y\xa0z", "é\u0301aB²Ⅷ日本😀ǅ", "\x00\x01\x1c\x7f", "a\r\n\tb", "a1" * 50000, "aB" * 5000, "Ab1" * 5000, "", None]
    texts += ["a" + chr(i) + "B" for i in range(1, 0x3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.filter(~T.code_words(F.col("t")).eqNullSafe(three)).count() == 0
    assert "regexp_replace" not in hash_plan(df.select(T.code_words(F.col("t")).alias("w")))
