"""The engine, small operators and the streaming jobs."""

import subprocess

from gleaner.functions import text as T
from gleaner.operators import analysis, dependencies, intel, monitors, ranking
from gleaner.plans.engine import Config, Engine
from gleaner.sources import corpus
from gleaner.streaming import jobs
from pyspark.sql import functions as F

FILES = [("repo1", "src/main.py", "def onClick(): pass"), ("repo1", "src/utils.py", "def helper(): return onClick()"),
         ("repo2", "app.js", "function onClick() { alert('clicked'); }")]


def test_engine_round(spark, tmp_path):
    e = Engine(spark, str(tmp_path), Config(compaction_threshold=3))
    files = spark.createDataFrame(FILES, "repo string, path string, content string")
    assert e.index(files).count() == 3
    assert e.index(files).count() == 0  # known documents are rejected
    assert {r.path for r in e.search("onClick", mode="code").collect()} == {"src/main.py", "src/utils.py", "app.js"}
    assert [r.path for r in e.search("clicked lang:javascript").collect()] == ["app.js"]
    assert e.search("nothingness").count() == 0 and e.search("").count() == 0
    assert e.search("helper", mode="hybrid", limit=2).first().path == "src/utils.py"
    assert e.search("click", verify=True).count() >= 1
    e.index(spark.createDataFrame([("repo1", "src/main.py", "def onTap(): pass")], files.schema))
    assert {r.path for r in e.search("onClick", mode="code").collect()} == {"src/utils.py", "app.js"}
    e.compact()
    assert e.documents().count() == 3 and len(e.segments) == 1
    e.delete_repo(e.documents().filter("repo = 'repo2'").first().repo_id)
    assert {r.path for r in e.search("onClick", mode="code").collect()} == {"src/utils.py"}
    assert e.cached("helper") == e.cached("helper") and e.cache.stats()["hits"] == 1
    assert e.symbols().count() == 2 and e.quality().count() == 2 and e.alerts().count() == 0


def test_engine_state(spark, tmp_path):
    """Versions that come back, deletion and a second life, compaction, and a store opened anew."""
    e = Engine(spark, str(tmp_path))
    put = lambda text: e.index(spark.createDataFrame([("r", "a.py", text)], "repo string, path string, content string"))
    contents = lambda x: sorted(r.content for r in x.documents().collect())
    for text in ("alpha = 1", "beta = 2", "alpha = 1"):
        put(text)
        assert contents(e) == [text]
    e.delete(e.documents())
    assert contents(e) == []
    put("alpha = 1")
    again = Engine(spark, str(tmp_path))
    assert contents(again) == ["alpha = 1"] and again.generations == e.generations and again.compaction_stats()["tombstones"] >= 1
    again.compact()
    third = Engine(spark, str(tmp_path))
    assert contents(third) == ["alpha = 1"] and len(third.segments) == 1 and not third.graves
    assert len([d for d in tmp_path.iterdir() if d.name.startswith(("seg_", "dead_"))]) <= 3
    assert third.search("alpha").count() == 1


def test_relative_imports(spark):
    files = spark.createDataFrame([(f, "") for f in (
        "pkg/a.py", "pkg/b.py", "pkg/sub/c.py", "top.py", "pkg/sub/index.py", "web/app.js", "web/lib/util.js", "web/x.ts")], "file_path string, content string")
    imports = spark.createDataFrame([
        ("pkg/a.py", ".b", True), ("pkg/sub/c.py", "..a", True), ("pkg/sub/c.py", "...top", True), ("pkg/a.py", ".sub", True), ("pkg/a.py", ".gone", True),
        ("web/app.js", "./lib/util", True), ("web/lib/util.js", "../x", True), ("web/lib/util.js", "../app.js", True), ("top.py", "pkg.b", False),
    ], "file_path string, module string, is_relative boolean")
    got = {(r.src, r.module): r.dst for r in dependencies.resolve(imports, files).collect()}
    assert got == {("pkg/a.py", ".b"): "pkg/b.py", ("pkg/sub/c.py", "..a"): "pkg/a.py", ("pkg/sub/c.py", "...top"): "top.py", ("pkg/a.py", ".sub"): "pkg/sub/index.py",
                   ("web/app.js", "./lib/util"): "web/lib/util.js", ("web/lib/util.js", "../x"): "web/x.ts", ("web/lib/util.js", "../app.js"): "web/app.js",
                   ("top.py", "pkg.b"): "pkg/b.py"}
    assert [r.file_path for r in dependencies.dependents(dependencies.resolve(imports, files), "pkg/b.py").orderBy("file_path").collect()] == ["pkg/a.py", "top.py"]


def test_ngrams_of_long_and_wide_texts(spark):
    text = "a\U0001f600b\né" * 40_000  # 200,000 characters, some of two UTF-16 units
    row = spark.createDataFrame([(text,)], "t string").select(T.ngrams(F.col("t")).alias("g"), T.ngrams_with_positions(F.col("t")).alias("p")).first()
    assert row.g == [text[i: i + 3] for i in range(len(text) - 2)]
    assert [tuple(x) for x in row.p[:3]] == [(text[i: i + 3], i, i + 3) for i in range(3)] and len(row.p) == len(row.g)


def test_maintainability_without_code(spark):
    d = spark.createDataFrame([(0.0, 1, 5), (100.0, 2, 10), (5000.0, 50, 500)], "v double, c int, l int")
    got = [r[0] for r in d.select(analysis.maintainability(F.col("v"), F.col("c"), F.col("l"))).collect()]
    assert got[0] == 100.0 and got[1] > 50 > got[2]


def test_sources(spark, tmp_path):
    (tmp_path / "build" / "src" / ".idea").mkdir(parents=True)
    (tmp_path / "build" / "src" / "kept.py").write_text("x")
    (tmp_path / "build" / "src" / ".idea" / "out.py").write_text("x")
    assert [r.path.rsplit("/", 1)[1] for r in corpus.read_directory(spark, str(tmp_path / "build")).collect()] == ["kept.py"]
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / "b.bin").write_text("no")
    (tmp_path / "src" / "node_modules" / "c.js").write_text("no")
    (tmp_path / "src" / "d.txt").write_bytes("é".encode("latin-1"))
    got = {r.path.rsplit("/", 1)[1]: r for r in corpus.read_directory(spark, str(tmp_path / "src"), "r").collect()}
    assert set(got) == {"a.py", "d.txt"} and got["d.txt"].content == "é" and got["a.py"].line_count == 2
    repo = tmp_path / "git"
    repo.mkdir()
    (repo / "hello.txt").write_text("hello")
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", ".")
    run("commit", "-qm", "x")
    row = corpus.read_git(spark, spark.createDataFrame([(str(repo),)], "repo string")).first()
    want = spark.createDataFrame([("hello",)], "t string").select(T.blob_hash(F.col("t"))).first()[0]
    assert row.blob_hash == want == "b6fc4c620b67d95f953a5c1c1230aaab5db5a1b0" and row.content == "hello"


def test_tokenizer_edges(spark):
    d = spark.createDataFrame([("",), ("ab",), ("abc",), ("été a_b",)], "t string")
    assert [r[0] for r in d.select(T.ngrams(F.col("t"))).collect()][:3] == [[], ["ab"], ["abc"]]
    assert d.select(T.code_words(F.col("t"))).collect()[3][0] == ["t", "a", "b"]
    assert T.query_ngrams("onClick") == ["onc", "ncl", "cli", "lic", "ick"]
    assert d.select(T.normalize(F.lit("ﬁX…"))).first()[0] == "fix..."


def test_structural(spark):
    f = spark.createDataFrame([("a.py", "def f():\n  pass\ndef g(x):\n  pass")], "file_path string, content string")
    got = intel.structural_search(f, "def :[name](:[~[a-z]*]):").orderBy("start").collect()
    assert [(r.line, r.captures["name"]) for r in got] == [(1, "f"), (3, "g")]
    assert [(r.start, r.end) for r in got] == [(0, 8), (16, 25)]


def test_vectors(spark):
    d = spark.createDataFrame([("d1", [1.0, 0.0]), ("d2", [0.0, 1.0]), ("d3", [0.7, 0.7]), ("zero", [0.0, 0.0])], "vec_id string, embedding array<double>")
    assert [r.vec_id for r in ranking.nearest(d, [1.0, 0.0], 2).collect()] == ["d1", "d3"]


def test_vector_store(spark, tmp_path):
    rows = [(i, [float(i % 7), float(i % 5) + 1, float(i % 3)]) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ranking.save_vectors(v, str(tmp_path / "v"))
    v = ranking.load_vectors(spark, str(tmp_path / "v"))
    centres, index = ranking.cell_index(v, cells=4)
    assert index.count() == 60 and index.filter("cell is null").count() == 0
    exact = ranking.nearest(v, [3.0, 2.0, 1.0], 5).collect()
    assert ranking.search_cells(centres, index, [3.0, 2.0, 1.0], 5, probes=4).collect() == exact  # all cells: exact
    docs = spark.createDataFrame([("a b",), ("a b",), ("c",)], "content string")
    none = spark.createDataFrame([], "text_key string, embedding array<double>, made_at timestamp")
    first = ranking.embed_missing(docs, none, now=F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert first.count() == 2
    later = lambda h: ranking.embed_missing(docs, first, now=F.lit(f"2024-01-0{1 + h // 24} {h % 24:02d}:00:00").cast("timestamp"))
    assert later(23).filter("made_at = '2024-01-01 00:00:00'").count() == 2 and later(30).filter("made_at = '2024-01-01 00:00:00'").count() == 0


def test_monitor_rules(spark):
    store = monitors.RuleStore()
    store.add(monitors.Rule("mine", "x", language="go", file_pattern=r".*\.go"))
    assert store.stats() == {"total_rules": 6, "active_rules": 6} and store.remove("mine") and not store.remove("mine")
    files = spark.createDataFrame([("a.py", "python", "TODO: a\né = eval(b)\nTODO: c")], "file_path string, language string, content string")
    got = monitors.scan(files, store)
    assert sorted((r.rule_id, r.line, r.text) for r in got.collect()) == [("qual-001", 1, "TODO:"), ("qual-001", 3, "TODO:"), ("sec-002", 2, "eval(")]
    assert monitors.scan(files, store, history=got).count() == 0
    assert '"color":"#ff6600"' in monitors.webhook_payloads(got).filter("rule_id = 'sec-002'").first().payload


def test_symbols_of_long_files(spark):
    text = "\n".join(f"function f{i}a(x, é) {{ return {i} }}" for i in range(3000))
    f = spark.createDataFrame([("a.js", "JS", text)], "file_path string, language string, content string")
    got = {r.name: (r.line, r.signature) for r in intel.extract_symbols(f).collect()}
    assert got == {f"f{i}a": (i + 1, f"function f{i}a(x, é)") for i in range(3000)}
    m = intel.structural_search(f, "function :[n](:[a])").filter("line = 2900").first()
    assert text[m.start: m.end] == m.match == "function f2899a(x, é)"


def test_cache():
    now = [0.0]
    c = monitors.LruCache(3, 10, lambda: now[0])
    for k in "abc":
        c.set(k, k)
    assert c.get("a") and c.get("b")
    c.set("d", "d")
    assert c.get("c") is None and c.stats()["evictions"] == 1
    now[0] = 11
    assert c.get("a") is None


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    schema = "file_path string, content string"
    spark.createDataFrame([("a.py", "x = eval(y)"), ("b.py", "ok"), ("a.py", "x = eval(y)")], schema).write.json(str(src))
    stream = jobs.new_matches(jobs.read_topic(spark, str(src), spark.createDataFrame([], schema).schema))
    q = stream.writeStream.format("memory").queryName("matches").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.file_path, r.rule_id) for r in spark.sql("select * from matches").collect()] == [("a.py", "sec-002")]
    many = jobs.new_matches(spark.createDataFrame([("c.py", "TODO: a\nFIXME: b\neval (x)")], schema)).collect()
    assert sorted((r.rule_id, r.text) for r in many) == [("qual-001", "FIXME:"), ("qual-001", "TODO:"), ("sec-002", "eval (")]
    sink = jobs.upsert_sink(str(tmp_path / "state"))
    ev = "doc_id string, content string, action string, offset long"
    sink(spark.createDataFrame([("d1", "a", "index", 1), ("d2", "b", "index", 2)], ev), 0)
    sink = jobs.upsert_sink(str(tmp_path / "state"))  # a restarted query
    sink(spark.createDataFrame([("d1", "", "delete", 3), ("d2", "c", "index", 4), ("d2", "x", "index", 3)], ev), 1)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "state" / "v00000001")).collect()] == [("d2", "c")]
