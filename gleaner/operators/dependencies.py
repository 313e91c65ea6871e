"""Imports, their resolution, and the graph they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def module_name(path: Column) -> Column:
    bare = F.regexp_replace(path, r"\.[^./]+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^(?:(?:src|lib|app)/)+", ""), "/", ".")


def python_imports(files: DataFrame) -> DataFrame:
    """Rows (file_path, line, module, names, is_relative); ``import a, b`` gives two."""
    line = files.select("file_path", F.posexplode(F.split("content", "\n")).alias("i", "text"))
    t = F.trim("text")
    plain = F.regexp_extract(t, r"^import\s+(.+)$", 1)
    source = F.regexp_extract(t, r"^from\s+(\S+)\s+import\s+.+$", 1)
    names = F.regexp_extract(t, r"^from\s+\S+\s+import\s+(.+)$", 1)
    several = F.transform(F.split(plain, r"\s*,\s*"), lambda m: F.struct(F.regexp_extract(m, r"^(\S+)", 1).alias("module"), F.lit("").alias("names")))
    found = F.when(plain != "", several).when(source != "", F.array(F.struct(source.alias("module"), names.alias("names"))))
    return line.select("file_path", (F.col("i") + 1).alias("line"), F.explode(found).alias("m")).select(
        "file_path", "line", "m.module", "m.names", F.startswith("m.module", F.lit(".")).alias("is_relative"))


def js_imports(files: DataFrame) -> DataFrame:
    line = files.select("file_path", F.posexplode(F.split("content", "\n")).alias("i", "text"))
    esm = F.regexp_extract("text", r"""import\s+(?:type\s+)?(?:[\w$]+|\{[^}]*\}|\*\s+as\s+\w+)\s+from\s+['"]([^'"]+)['"]""", 1)
    cjs = F.regexp_extract("text", r"""require\(['"]([^'"]+)['"]\)""", 1)
    return line.withColumn("module", F.when(esm != "", esm).otherwise(cjs)).filter("module <> ''").select(
        "file_path", (F.col("i") + 1).alias("line"), "module", F.lit("").alias("names"), F.rlike("module", F.lit(r"^\.\.?(/|$)")).alias("is_relative"))


#: What a resolved path may lack, in the order in which it is tried.
SUFFIXES = [".py", ".js", ".ts", "/index.py", "/index.js", "/index.ts"]


def _relative(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (src, dst, module) of relative imports: up a folder for each dot but the
    first (or each ``../``), then down the module's path; the first suffix that
    names a file wins.  Paths with slashes may also name the file itself."""
    m = F.col("module")
    slashed = m.contains("/") | m.isin(".", "..")
    climbs = F.regexp_extract(m, r"^((?:\.\.?(?:/|$))*)", 1)
    dots = F.length(F.regexp_extract(m, r"^(\.*)", 1))
    up = F.when(slashed, F.regexp_count(climbs, F.lit(r"\.\.(?:/|$)"))).otherwise(dots - 1)
    down = F.when(slashed, F.expr("substring(module, length(climbs) + 1)")).otherwise(F.translate(F.expr("substring(module, dots + 1)"), ".", "/"))
    folder = F.split("src", "/")
    base = F.array_join(F.concat(
        F.slice(folder, F.lit(1), F.greatest(F.size(folder) - 1 - F.col("up"), F.lit(0))), F.filter(F.split("down", "/"), lambda x: x != "")), "/")
    tried = F.array(*[F.concat("base", F.lit(x)) for x in SUFFIXES], F.when(slashed, F.col("base")))
    rel = imports.filter("is_relative").select(F.col("file_path").alias("src"), "module").distinct()
    rel = rel.withColumns({"climbs": climbs, "dots": dots}).withColumns({"up": up, "down": down}).withColumn("base", base)
    w = W.partitionBy("src", "module").orderBy("cut")
    return (
        rel.select("src", "module", F.posexplode(tried).alias("cut", "dst")).filter("dst is not null")
        .join(files.select(F.col("file_path").alias("dst")).distinct(), "dst", "left_semi")
        .withColumn("_r", F.row_number().over(w)).filter("_r = 1 and src <> dst").select("src", "dst", "module")
    )


def resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (src, dst, module): a relative import to the file that its path names, any
    other to the file with that module name, or else to the first whose name ends
    with it.  All files are known before any import is."""
    mods = files.select(F.col("file_path").alias("dst"), module_name(F.col("file_path")).alias("name"))
    parts = F.split("name", r"\.")
    k = F.size(parts)
    ends = F.transform(F.sequence(F.lit(1), k), lambda i: F.array_join(F.slice(parts, i, k - i + 1), "."))
    index = mods.select("dst", F.posexplode(ends).alias("cut", "module"))
    w = W.partitionBy("src", "module").orderBy("cut", "dst")
    wanted = imports.filter("not is_relative").select(F.col("file_path").alias("src"), "module").distinct()
    named = wanted.join(index, "module").filter("src <> dst").withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("src", "dst", "module")
    return named.unionByName(_relative(imports, files))


def dependents(edges: DataFrame, path: str) -> DataFrame:
    """Files that import a file."""
    return edges.filter(F.col("dst") == path).select(F.col("src").alias("file_path")).distinct()


def import_chains(edges: DataFrame, start: str) -> DataFrame:
    """All simple paths from a file to files that import nothing, in rounds of one
    step until no path can grow."""
    e = _kept(edges.select("src", "dst").distinct())
    leaves = e.select(F.col("dst").alias("node")).join(e.select(F.col("src").alias("node")), "node", "left_anti").distinct()
    paths = e.filter(F.col("src") == start).select(F.array("src", "dst").alias("path"), F.col("dst").alias("node"))
    done = None
    while True:
        paths = _kept(paths)
        ended = _kept(paths.join(leaves, "node", "left_semi").select("path"))
        done = ended if done is None else done.unionByName(ended)
        if paths.isEmpty():
            return done
        paths = paths.join(e, paths["node"] == e["src"]).filter(~F.array_contains("path", F.col("dst"))).select(
            F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("node"))


def _kept(df: DataFrame) -> DataFrame:
    """Computed once, without the constraints and size estimates of its plan, which
    else grow exponentially from round to round."""
    spark = df.sparkSession
    out = df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.cache()
    return DataFrame(spark._jsparkSession.createDataFrame(out._jdf.toJavaRDD(), out._jdf.schema()), spark)


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """The edges (src, dst) whose ends lie in one strongly connected component.

    Inside a component the least file that reaches a file, and the least that it
    reaches, are the same for all: edges whose ends differ in either go, until none does."""
    e = _kept(edges.select("src", "dst").filter("src is not null and dst is not null").distinct())
    n = e.count()
    while n:
        left, right = e.select(F.col("src").alias("v")), e.select(F.col("dst").alias("v"))
        trimmed = _kept(e.join(right.distinct(), e["src"] == F.col("v"), "left_semi").join(left.distinct(), e["dst"] == F.col("v"), "left_semi"))
        m = trimmed.count()
        e = trimmed
        if m < n:
            n = m
            continue
        lab = _reach(e)
        e = _kept(e.join(lab.toDF("src", "f1", "b1"), "src").join(lab.toDF("dst", "f2", "b2"), "dst").filter("f1 = f2 and b1 = b2").select("src", "dst"))
        m = e.count()
        if m == n:
            break
        n = m
    return e


def _reach(e: DataFrame) -> DataFrame:
    """Rows (v, f, b): the least files that reach v and that v reaches, itself among
    them, by rounds of neighbours' minima with pointer jumping."""
    lab = _kept(e.select(F.col("src").alias("v")).union(e.select("dst")).distinct().select("v", F.col("v").alias("f"), F.col("v").alias("b")))
    while True:
        none = F.lit(None).cast("string")
        ahead = e.join(lab.select(F.col("v").alias("src"), "f"), "src").select(F.col("dst").alias("v"), "f", none.alias("b"))
        back = e.join(lab.select(F.col("v").alias("dst"), "b"), "dst").select(F.col("src").alias("v"), none.alias("f"), "b")
        jump_f = lab.select("v", F.col("f").alias("k")).join(lab.select(F.col("v").alias("k"), "f"), "k").select("v", "f", none.alias("b"))
        jump_b = lab.select("v", F.col("b").alias("k")).join(lab.select(F.col("v").alias("k"), "b"), "k").select("v", none.alias("f"), "b")
        new = _kept(lab.unionByName(ahead).unionByName(back).unionByName(jump_f).unionByName(jump_b).groupBy("v").agg(F.min("f").alias("f"), F.min("b").alias("b")))
        if new.join(lab.toDF("v", "f0", "b0"), "v").filter("f <> f0 or b <> b0").isEmpty():
            return new
        lab = new


def cycles(spark, edges: DataFrame) -> DataFrame:
    """All simple cycles, of any length, each from its least file on: rounds of one
    step over paths inside strongly connected components that stay above their start."""
    e = _kept(cyclic_edges(edges))
    ahead = _kept(e.groupBy("src").agg(F.collect_list("dst").alias("next")))
    walk = e.filter("dst >= src").select(F.col("src").alias("start"), F.col("dst").alias("node"), F.array("src").alias("path"))
    done = None
    while True:
        walk = _kept(walk)
        closed = walk.filter("node = start").select("path", F.size("path").alias("length"))
        done = closed if done is None else done.unionByName(closed)
        grows = walk.filter("node <> start")
        if grows.isEmpty():
            return done
        path = F.array_append("path", F.col("node"))
        onward = F.filter("next", lambda x: (x == F.col("start")) | ((x > F.col("start")) & ~F.array_contains(path, x)))
        walk = grows.join(ahead, F.col("node") == F.col("src")).select(
            F.explode(F.transform(onward, lambda x: F.struct("start", x.alias("node"), path.alias("path")))).alias("w")).select("w.start", "w.node", "w.path")


def most_imported(edges: DataFrame, limit: int = 10) -> DataFrame:
    return edges.groupBy("dst").agg(F.countDistinct("src").alias("importers")).orderBy(F.desc("importers"), "dst").limit(limit)


def graph_stats(files: DataFrame, edges: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = files.select(F.lit(1).alias("node"), none.alias("src"), none.alias("dst")).unionByName(edges.select(F.lit(None).cast("int").alias("node"), "src", "dst"))
    return rows.agg(F.count("node").alias("nodes"), F.count("src").alias("edges"), F.countDistinct("src").alias("importing"), F.countDistinct("dst").alias("imported"))


def shared_dependencies(imports: DataFrame, repo: str = "repo_id") -> DataFrame:
    return imports.groupBy("module").agg(F.sort_array(F.collect_set(repo)).alias("repos")).filter(F.size("repos") > 1)


def import_patterns(imports: DataFrame, least: int = 3) -> DataFrame:
    return imports.filter("not is_relative").groupBy("file_path").agg(F.sort_array(F.collect_set("module")).alias("modules")).filter(F.size("modules") >= least)
