"""Static analysis of code: complexity, security, style, duplication, churn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# -- fixed values: patterns and rules -------------------------------------------------
BRANCHES = {
    "python": [r"\bif\b", r"\belif\b", r"\belse\b", r"\bfor\b", r"\bwhile\b", r"\band\b", r"\bor\b", r"\btry\b", r"\bexcept\b", r"\bwith\b"],
    "javascript": [r"\bif\b", r"\belse\b", r"\bfor\b", r"\bwhile\b", r"\bdo\b", "&&", r"\|\|", r"\?", r"\btry\b", r"\bcatch\b", r"\bswitch\b", r"\bcase\b"],
}
RULES = {  # language -> (rule, pattern, severity)
    "python": [
        ("SEC001", r"eval\s*\(", "critical"), ("SEC002", r"exec\s*\(", "critical"), ("SEC003", r"pickle\.loads?\(", "error"),
        ("SEC004", r"subprocess\.(?:call|run|Popen)\([^)]*shell\s*=\s*True", "error"), ("SEC005", r"os\.system\(", "error"),
        ("SEC006", r"""password\s*=\s*['"][^'"]+['"]""", "critical"), ("SEC007", r"""(?:api_key|apikey|secret)\s*=\s*['"][^'"]+['"]""", "critical"),
        ("SEC008", r"\.execute\([^)]*%s", "error"), ("SEC009", r"verify\s*=\s*False", "warning")],
    "javascript": [
        ("SEC001", r"eval\s*\(", "critical"), ("SEC010", r"innerHTML\s*=", "warning"), ("SEC011", r"document\.write\s*\(", "warning"),
        ("SEC006", r"""password\s*[=:]\s*['"][^'"]+['"]""", "critical")],
}
OPERATORS = ["+", "-", "*", "/", "%", "**", "//", "==", "!=", "<", ">", "<=", ">=", "=", "+=", "-=", "*=", "/=", "and", "or", "not",
             "in", "is", ".", "(", ")", "[", "]", "{", "}", ",", ":", ";"]
KEYWORDS = ["def", "class", "if", "elif", "else", "for", "while", "try", "except", "finally", "with", "as", "import", "from", "return",
            "yield", "raise", "pass", "break", "continue", "lambda", "async", "await"]
#: Fixed value: names, runs of operator characters, single marks; numbers are no tokens.
HALSTEAD_TOKEN = r"[a-zA-Z_]\w*|[+\-*/%=<>!&|^~]+|[.,;:()\[\]{}]"


def lines_of(content: Column) -> Column:
    return F.split(content, "\n")


def loc(content: Column) -> Column:
    """Lines that are neither blank nor comments."""
    return F.size(F.filter(lines_of(content), lambda x: (F.trim(x) != "") & ~F.startswith(F.trim(x), F.lit("#"))))


def comment_lines(content: Column) -> Column:
    return F.size(F.filter(lines_of(content), lambda x: F.startswith(F.trim(x), F.lit("#"))))


def cyclomatic(content: Column, language: Column) -> Column:
    def total(patterns):
        out = F.lit(1)
        for p in patterns:
            out = out + F.regexp_count(content, F.lit(p))
        return out

    return F.when(language.isin("javascript", "typescript"), total(BRANCHES["javascript"])).otherwise(total(BRANCHES["python"]))


def cognitive(content: Column) -> Column:
    """Opening lines count one more for each open level; leaving statements close one."""
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("open"))

    def step(s, raw):
        x = F.trim(raw)
        opens = F.rlike(x, F.lit(r"^(if|for|while|try|with|def|class)\b"))
        leaves = F.rlike(x, F.lit(r"^(return|break|continue|raise)"))
        level = s["open"] + F.when(opens & F.endswith(x, F.lit(":")), 1).otherwise(0)
        return F.struct(
            (s["total"] + F.when(opens, 1 + s["open"]).otherwise(0)).alias("total"),
            F.when(leaves, F.greatest(level - 1, F.lit(0))).otherwise(level).alias("open"))

    return F.aggregate(lines_of(content), start, step, lambda s: s["total"])


def max_nesting(content: Column) -> Column:
    full = F.filter(lines_of(content), lambda x: F.trim(x) != "")
    return F.coalesce(F.array_max(F.transform(full, lambda x: F.floor((F.length(x) - F.length(F.ltrim(x))) / 4).cast("int"))), F.lit(0))


def metrics(files: DataFrame) -> DataFrame:
    """(file_path, language, content) -> one row of measures a file."""
    c = F.col("content")
    functions = F.regexp_count(c, F.lit(r"\bdef\s+\w+|\bfunction\s+\w+"))
    out = files.withColumns({
        "loc": loc(c), "comment_lines": comment_lines(c), "cyclomatic": cyclomatic(c, F.col("language")), "cognitive": cognitive(c),
        "max_nesting": max_nesting(c), "functions": functions, "classes": F.regexp_count(c, F.lit(r"\bclass\s+\w+"))})
    return out.withColumn("avg_function_length", F.round(F.coalesce(F.try_divide(F.col("loc").cast("double"), F.col("functions")), F.lit(0.0)), 6)).drop("content")


def security_issues(files: DataFrame) -> DataFrame:
    """Rows (file_path, line, rule_id, severity): at most one a line and rule.
    The rules are unrolled, so each line is read once and nothing is joined."""
    line = files.select("file_path", "language", F.posexplode(lines_of(F.col("content"))).alias("i", "text"))

    def hits(rules):
        one = [F.when(F.rlike(F.col("text"), F.lit("(?i)" + p)), F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"))) for r, p, s in rules]
        return F.filter(F.array(*one), lambda x: x.isNotNull())

    found = F.when(F.col("language").isin("javascript", "typescript"), hits(RULES["javascript"])).otherwise(hits(RULES["python"]))
    return line.select("file_path", (F.col("i") + 1).alias("line"), F.explode(found).alias("h")).select("file_path", "line", "h.rule_id", "h.severity")


def style_issues(files: DataFrame, width: int = 120) -> DataFrame:
    line = files.select("file_path", F.posexplode(lines_of(F.col("content"))).alias("i", "text"))
    kinds = F.filter(F.array(
        F.when(F.length("text") > width, "long_line"), F.when(F.rlike("text", F.lit(r"[ \t\r]+$")), "trailing_whitespace")), lambda x: x.isNotNull())
    return line.select("file_path", (F.col("i") + 1).alias("line"), F.explode(kinds).alias("rule_id"))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def quality_scores(files: DataFrame) -> DataFrame:
    m = metrics(files).select("file_path", "cyclomatic", "max_nesting")
    sec = security_issues(files).groupBy("file_path").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "error", "warning")])
    sty = style_issues(files).groupBy("file_path").agg(F.count("*").alias("style"))
    j = m.join(sec, "file_path", "left").join(sty, "file_path", "left").fillna(0)
    maintain = F.greatest(F.lit(0.0), 100.0 - F.greatest(F.lit(0), F.least(F.lit(30), (F.col("cyclomatic") - 10) * 3))
                          - F.greatest(F.lit(0), F.least(F.lit(20), (F.col("max_nesting") - 4) * 5)) - 2 * F.col("style"))
    secure = F.greatest(F.lit(0.0), 100.0 - 25 * F.col("critical") - 15 * F.col("error") - 5 * F.col("warning"))
    out = j.select("file_path", "critical", "error", "warning", "style", maintain.alias("maintainability"), F.lit(100.0).alias("reliability"), secure.alias("security"))
    out = out.withColumn("overall", F.round((F.col("maintainability") + F.col("reliability") + F.col("security")) / 3, 6))
    return out.withColumn("grade", grade(F.col("overall")))


def file_reports(files: DataFrame) -> DataFrame:
    """One nested row a file: (file_path, complexity, issues in order of lines, score)."""
    m = metrics(files)
    parts = [c for c in m.columns if c not in files.columns]
    style = style_issues(files).select("file_path", "line", F.when(F.col("rule_id") == "long_line", "STYLE001").otherwise("STYLE002").alias("rule_id"), F.lit("info").alias("severity"))
    issues = security_issues(files).withColumn("type", F.lit("security")).unionByName(style.withColumn("type", F.lit("style")))
    listed = issues.groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("line", "rule_id", "severity", "type"))).alias("issues"))
    score = quality_scores(files).select("file_path", F.struct("overall", "maintainability", "reliability", "security", "grade").alias("score"))
    none = F.array().cast("array<struct<line:int,rule_id:string,severity:string,type:string>>")
    return m.select("file_path", F.struct(*parts).alias("complexity")).join(listed, "file_path", "left").join(score, "file_path").select(
        "file_path", "complexity", F.coalesce("issues", none).alias("issues"), "score")


def duplicate_pairs(files: DataFrame, threshold: float = 0.8, n: int = 3) -> DataFrame:
    """Pairs of files whose sets of ``n``-line shingles, words made alike, overlap.

    Equal sets meet once: files are grouped by their shingles first, and only
    groups are joined.  Pairs inside a group have similarity 1 and are returned
    as (first file, other file)."""
    code = F.filter(F.transform(lines_of(F.col("content")), lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("#")) & ~F.startswith(x, F.lit("//")))
    normal = F.transform(code, lambda x: F.regexp_replace(x, r"\b\w+\b", "VAR"))
    k = F.size("v")
    shingles = F.when(k >= n, F.transform(F.sequence(F.lit(1), F.greatest(k - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(F.col("v"), i, F.lit(n)), "\n"))).otherwise(F.array().cast("array<string>"))
    sets = files.select("file_path", normal.alias("v")).select("file_path", F.array_sort(F.array_distinct(shingles)).alias("s")).filter(F.size("s") > 0)
    groups = sets.groupBy("s").agg(F.min("file_path").alias("rep"), F.count("*").alias("files"))
    inside = sets.join(groups.filter("files > 1"), "s").filter("file_path <> rep").select(
        F.col("rep").alias("file_a"), F.col("file_path").alias("file_b"), F.lit(1.0).alias("similarity"))
    # rarest shingles first: sets that overlap enough share one of their first few
    seen = groups.select(F.explode("s").alias("x")).groupBy("x").agg(F.count("*").alias("times"))
    ordered = groups.select("rep", F.explode("s").alias("x")).join(seen, "x").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("times", "x"))).alias("o"))
    n_first = F.size("o") - F.ceil(F.size("o") * threshold).cast("int") + 1
    first = ordered.select("rep", F.explode(F.slice(F.col("o"), F.lit(1), n_first)).alias("y")).select("rep", "y.x")
    a, b = first.alias("a"), first.alias("b")
    pairs = a.join(b, (F.col("a.x") == F.col("b.x")) & (F.col("a.rep") < F.col("b.rep"))).select(
        F.col("a.rep").alias("file_a"), F.col("b.rep").alias("file_b")).distinct()
    full = pairs.join(groups.select(F.col("rep").alias("file_a"), F.col("s").alias("sa")), "file_a").join(groups.select(F.col("rep").alias("file_b"), F.col("s").alias("sb")), "file_b")
    both = F.size(F.array_intersect("sa", "sb"))
    sim = F.round(both / (F.size("sa") + F.size("sb") - both), 6)
    return full.withColumn("similarity", sim).filter(F.col("similarity") >= threshold).select("file_a", "file_b", "similarity").unionByName(inside)


def halstead(files: DataFrame) -> DataFrame:
    toks = F.regexp_extract_all("content", F.lit(HALSTEAD_TOKEN), F.lit(0))
    ops = F.filter(toks, lambda t: t.isin(OPERATORS + KEYWORDS))
    rest = F.filter(toks, lambda t: ~t.isin(OPERATORS + KEYWORDS))
    base = files.select("file_path", ops.alias("o"), rest.alias("r")).select(
        "file_path", F.size(F.array_distinct("o")).alias("n1"), F.size(F.array_distinct("r")).alias("n2"), F.size("o").alias("big_n1"), F.size("r").alias("big_n2"))
    none = (F.col("n1") == 0) | (F.col("n2") == 0) | (F.col("big_n1") == 0) | (F.col("big_n2") == 0)
    length, vocab = F.col("big_n1") + F.col("big_n2"), F.col("n1") + F.col("n2")
    volume = F.when(none, 0.0).otherwise(length * F.log2(vocab))
    difficulty = F.when(none, 0.0).otherwise(F.col("n1") / 2.0 * F.col("big_n2") / F.col("n2"))
    return base.select(
        "file_path", F.when(none, 0).otherwise(vocab).alias("vocabulary"), F.when(none, 0).otherwise(length).alias("length"),
        F.round(volume, 4).alias("volume"), F.round(difficulty, 4).alias("difficulty"), F.round(volume * difficulty, 3).alias("effort"))


def maintainability(volume: Column, complexity: Column, lines: Column) -> Column:
    """0 to 100; code without volume or lines has 100."""
    raw = 171 - 5.2 * F.ln(volume) - 0.23 * complexity - 16.2 * F.ln(lines)
    return F.when((volume <= 0) | (lines <= 0), 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw * 100 / 171)))


def churn(log: DataFrame, threshold: float = 50.0) -> DataFrame:
    """Mean of added and deleted lines a change; files strictly above the threshold."""
    rate = F.sum(F.col("added") + F.col("deleted")) / F.count("*")
    return log.groupBy("file_path").agg(F.count("*").alias("changes"), F.round(rate, 6).alias("churn")).filter(F.col("churn") > threshold)
