"""Structural search, symbols, references and scopes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import let, spans

_TYPED = {"identifier": r"[a-zA-Z_]\w*", "string": r"""(?:"[^"]*"|'[^']*')""", "number": r"\d+(?:\.\d+)?"}
_HOLE = re.compile(r":\[~((?:[^\[\]\\]|\\.|\[[^\]]*\])*)\]|:\[([^\]:~]*)(?::(identifier|string|number))?\]|\.\.\.")

# -- fixed values ------------------------------------------------------------------
#: Keywords that are no references; other languages have Python's.
REFERENCE_KEYWORDS = {
    "python": ["def", "class", "if", "else", "elif", "for", "while", "try", "except", "finally", "with", "as", "import", "from", "return", "yield", "raise",
               "pass", "break", "continue", "and", "or", "not", "in", "is", "lambda", "True", "False", "None", "async", "await"],
    "javascript": ["function", "class", "if", "else", "for", "while", "do", "switch", "case", "break", "continue", "return", "try", "catch", "finally", "throw",
                   "new", "delete", "typeof", "instanceof", "void", "this", "super", "const", "let", "var", "true", "false", "null", "undefined", "async",
                   "await", "import", "export"],
}
#: Keywords that are no symbols; languages that aren't named have none.
SYMBOL_KEYWORDS = {
    "python": ["if", "else", "elif", "for", "while", "try", "except", "finally", "with", "return", "yield", "import", "from", "class", "def", "async", "await",
               "pass", "break", "continue", "raise", "and", "or", "not", "in", "is", "None", "True", "False", "lambda", "global", "nonlocal"],
    "javascript": ["if", "else", "for", "while", "do", "switch", "case", "break", "continue", "return", "function", "class", "const", "let", "var", "new",
                   "this", "super", "typeof", "instanceof", "null", "undefined", "true", "false", "try", "catch", "finally", "throw", "async", "await"],
    "java": ["if", "else", "for", "while", "do", "switch", "case", "break", "continue", "return", "class", "interface", "public", "private", "protected",
             "static", "final", "abstract", "new", "this", "super", "null", "true", "false", "try", "catch", "finally", "throw", "throws", "void"],
}
#: Patterns of whole texts, by language and kind; group 1 is the name.
SYMBOL_PATTERNS = {
    "python": {
        "function": [r"^(?:async\s+)?def\s+(\w+)\s*\([^)]*\)"],
        "class": [r"^class\s+(\w+)\s*(?:\([^)]*\))?:"],
        "variable": [r"^(\w+)\s*(?::\s*\w+)?\s*="],
        "import": [r"^(?:from\s+[\w.]+\s+)?import\s+([\w,\s]+)"],
    },
    "javascript": {
        "function": [r"(?:async\s+)?function\s+(\w+)\s*\([^)]*\)", r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\([^)]*\)\s*=>",
                     r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?function"],
        "class": [r"class\s+(\w+)\s*(?:extends\s+\w+\s*)?\{"],
        "variable": [r"(?:const|let|var)\s+(\w+)\s*="],
        "import": [r"""import\s+(?:\{[^}]+\}|\w+)\s+from\s+['"]([^'"]+)['"]""", r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)"""],
    },
    "typescript": {
        "function": [r"(?:async\s+)?function\s+(\w+)\s*(?:<[^>]*>)?\s*\([^)]*\)",
                     r"(?:const|let|var)\s+(\w+)\s*(?::\s*[^=]+)?\s*=\s*(?:async\s+)?\([^)]*\)\s*=>"],
        "class": [r"class\s+(\w+)\s*(?:<[^>]*>)?\s*(?:extends\s+\w+\s*)?(?:implements\s+[\w,\s]+\s*)?\{"],
        "interface": [r"interface\s+(\w+)\s*(?:<[^>]*>)?\s*(?:extends\s+[\w,\s]+\s*)?\{"],
        "type": [r"type\s+(\w+)\s*(?:<[^>]*>)?\s*="],
        "variable": [r"(?:const|let|var)\s+(\w+)\s*(?::\s*[^=]+)?\s*="],
    },
    "java": {
        "function": [r"(?:public|private|protected)?\s*(?:static\s+)?(?:final\s+)?(?:\w+(?:<[^>]*>)?)\s+(\w+)\s*\([^)]*\)"],
        "class": [r"(?:public\s+)?(?:abstract\s+)?(?:final\s+)?class\s+(\w+)"],
        "interface": [r"(?:public\s+)?interface\s+(\w+)"],
        "variable": [r"(?:public|private|protected)?\s*(?:static\s+)?(?:final\s+)?(?:\w+(?:<[^>]*>)?)\s+(\w+)\s*[;=]"],
    },
    "go": {
        "function": [r"func\s+(?:\([^)]+\)\s+)?(\w+)\s*\([^)]*\)"],
        "type": [r"type\s+(\w+)\s+(?:struct|interface)"],
        "variable": [r"(?:var|const)\s+(\w+)\s*(?:\w+)?\s*="],
    },
    "rust": {
        "function": [r"(?:pub\s+)?(?:async\s+)?fn\s+(\w+)\s*(?:<[^>]*>)?\s*\([^)]*\)"],
        "class": [r"(?:pub\s+)?struct\s+(\w+)"],
        "interface": [r"(?:pub\s+)?trait\s+(\w+)"],
        "enum": [r"(?:pub\s+)?enum\s+(\w+)"],
        "variable": [r"(?:let|const|static)\s+(?:mut\s+)?(\w+)\s*(?::\s*[^=]+)?\s*="],
    },
    "ruby": {"function": [r"def\s+(?:self\.)?(\w+[?!]?)"], "class": [r"class\s+(\w+)"], "module": [r"module\s+(\w+)"]},
    "cpp": {
        "function": [r"(?:\w+(?:<[^>]*>)?(?:\s*[*&])?\s+)+(\w+)\s*\([^)]*\)\s*(?:const\s*)?(?:override\s*)?(?:final\s*)?[{;]"],
        "class": [r"(?:class|struct)\s+(\w+)\s*(?::\s*(?:public|private|protected)\s+\w+\s*)?[{;]"],
        "variable": [r"(?:\w+(?:<[^>]*>)?(?:\s*[*&])?\s+)(\w+)\s*[;=]"],
    },
    "csharp": {
        "function": [r"(?:public|private|protected|internal)?\s*(?:static\s+)?(?:async\s+)?(?:virtual\s+)?(?:override\s+)?(?:\w+(?:<[^>]*>)?)\s+(\w+)\s*\([^)]*\)"],
        "class": [r"(?:public|private|protected|internal)?\s*(?:abstract\s+)?(?:sealed\s+)?(?:partial\s+)?class\s+(\w+)"],
        "interface": [r"(?:public|private|protected|internal)?\s*interface\s+(\w+)"],
        "property": [r"(?:public|private|protected|internal)?\s*(?:static\s+)?(?:\w+(?:<[^>]*>)?)\s+(\w+)\s*\{\s*(?:get|set)"],
    },
}
LANGUAGE_ALIASES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "c": "cpp", "h": "cpp", "hpp": "cpp",
                    "cs": "csharp", "rs": "rust", "rb": "ruby"}
#: Patterns of single lines, by language and kind; the first group that is found is
#: the name.  Other languages have Python's.
LINE_PATTERNS = {
    "python": {"function": r"^\s*(?:async\s+)?def\s+(\w+)\s*\(", "class": r"^\s*class\s+(\w+)\s*[:\(]", "variable": r"^\s*(\w+)\s*=\s*"},
    "javascript": {"function": r"(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:function|\([^)]*\)\s*=>))",
                   "class": r"class\s+(\w+)", "variable": r"(?:const|let|var)\s+(\w+)\s*="},
    "typescript": {"function": r"(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*(?::\s*[^=]+)?\s*=\s*(?:async\s+)?(?:function|\([^)]*\)\s*=>))",
                   "class": r"class\s+(\w+)", "interface": r"interface\s+(\w+)", "type": r"type\s+(\w+)\s*=",
                   "variable": r"(?:const|let|var)\s+(\w+)\s*(?::\s*[^=]+)?\s*="},
    "java": {"class": r"(?:public|private|protected)?\s*(?:static\s+)?class\s+(\w+)", "interface": r"(?:public|private|protected)?\s*interface\s+(\w+)",
             "method": r"(?:public|private|protected)?\s*(?:static\s+)?(?:\w+(?:<[^>]+>)?)\s+(\w+)\s*\(",
             "variable": r"(?:public|private|protected)?\s*(?:static\s+)?(?:final\s+)?(?:\w+(?:<[^>]+>)?)\s+(\w+)\s*[=;]"},
    "go": {"function": r"func\s+(?:\([^)]+\)\s+)?(\w+)\s*\(", "struct": r"type\s+(\w+)\s+struct\s*\{", "interface": r"type\s+(\w+)\s+interface\s*\{",
           "variable": r"(?:var|const)\s+(\w+)\s*(?:=|[^=])"},
}
#: Structural patterns that come with each language.
BUILTIN = {
    "python": {"function_def": "def :[name](:[args]):", "class_def": "class :[name](:[base]):", "try_except": "try:\n...\nexcept :[exc]:",
               "with_statement": "with :[context] as :[var]:", "list_comprehension": "[:[expr] for :[var] in :[iterable]]"},
    "javascript": {"function_def": "function :[name](:[args]) {", "arrow_function": "const :[name] = (:[args]) =>",
                   "try_catch": "try {\n...\n} catch (:[err]) {", "async_function": "async function :[name](:[args]) {",
                   "import_statement": "import :[imports] from :[module]"},
    "go": {"function_def": "func :[name](:[args]) :[return] {", "error_check": "if err != nil {\nreturn :[_]\n}", "defer": "defer :[expr]",
           "goroutine": "go :[func](:[args])"},
}
# -- end of fixed values ---------------------------------------------------------------


def compile_pattern(pattern: str) -> tuple[str, list[str]]:
    """A Java regex and the names of its groups.  ``:[x]`` is a hole, ``:[x:kind]`` a
    typed one, ``:[~regex]`` a regex, ``...`` anything."""
    out, names, last = ["(?sm)"], [], 0
    for m in _HOLE.finditer(pattern):
        out.append(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", pattern[last: m.start()]))
        last = m.end()
        if m.group() == "...":
            out.append(".*?")
        elif m.group(1) is not None:
            out.append(f"({m.group(1)})")
            names.append("~" + m.group(1))
        else:
            out.append(f"({_TYPED.get(m.group(3), '.+?')})")
            names.append(m.group(2))
    out.append(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", pattern[last:]))
    return "".join(out), names


def explain_pattern(pattern: str) -> list[str]:
    """A line for each hole: what it takes."""
    out = []
    for m in _HOLE.finditer(pattern):
        if m.group() == "...":
            out.append("...: any code between")
        elif m.group(1) is not None:
            out.append(f"{m.group()}: what the regex {m.group(1)} matches")
        else:
            out.append(f"{m.group()}: {m.group(3) or 'any expression'} as '{m.group(2)}'")
    return out


def structural_search(files: DataFrame, pattern: str) -> DataFrame:
    """Rows (file_path, start, end, line, match, captures) of every match."""
    rx, names = compile_pattern(pattern)
    hits = files.filter(F.rlike("content", F.lit(rx))).select("file_path", F.explode(spans(F.col("content"), rx, len(names))).alias("m"))
    caps = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.col(f"m.c{i + 1}"))]) if names else F.create_map().cast("map<string,string>")
    return hits.select("file_path", "m.start", "m.end", "m.line", "m.match", caps.alias("captures"))


def code_lines(files: DataFrame) -> DataFrame:
    return files.select("file_path", "language", F.posexplode(F.split("content", "\n")).alias("i", "text")).select(
        "file_path", "language", (F.col("i") + 1).alias("line"), "text")


def by_language(language: Column, cases: dict, other: Column) -> Column:
    out = F
    for name, value in cases.items():
        out = out.when(language == name, value)
    return out.otherwise(other)


def full_language(language: Column) -> Column:
    """The language's name, from a name or an alias in any case."""
    low = F.lower(language)
    return by_language(low, {a: F.lit(b) for a, b in LANGUAGE_ALIASES.items()}, low)


# -- symbols -------------------------------------------------------------------


def extract_symbols(files: DataFrame) -> DataFrame:
    """Rows (file_path, name, kind, line, end_line, signature, documentation) of nine
    languages, found by patterns of whole texts; one row a name, kind and line.
    Names of one letter and keywords are none, nor have other languages any."""
    def of(lang, kinds):
        flat = [(kind, p) for kind, ps in kinds.items() for p in ps]
        return F.array(*[F.struct(F.lit(nth).alias("nth"), F.lit(kind).alias("kind"), F.lit("(?m)" + p).alias("regex")) for nth, (kind, p) in enumerate(flat)])

    def words(ks):
        return F.array(*[F.lit(k) for k in ks])

    named = files.select("file_path", full_language(F.col("language")).alias("language"), "content")
    lang, none = F.col("language"), F.array().cast("array<string>")
    keywords = by_language(lang, {x: words(ks) for x, ks in SYMBOL_KEYWORDS.items()}, none)
    patterns = by_language(lang, {x: of(x, kinds) for x, kinds in SYMBOL_PATTERNS.items()}, F.array().cast("array<struct<nth:int,kind:string,regex:string>>"))
    found = named.withColumn("s", F.filter(F.flatten(F.transform(patterns, _found)), lambda s: (F.length(s["name"]) >= 2) & ~F.array_contains(keywords, s["name"])))
    size = F.length("content")
    last = lambda mark: size - F.instr(F.reverse("content"), mark) * F.when(F.contains("content", F.lit(mark)), 1)
    marks = F.struct(F.split("content", "\n").alias("lines"), last("{").alias("brace"), last(":").alias("colon"))
    full = let(marks, lambda k: F.transform("s", lambda x: F.struct(
        x["name"].alias("name"), x["kind"].alias("kind"), x["line"].alias("line"), x["end_line"].alias("end_line"), x["nth"].alias("nth"), x["start"].alias("start"),
        F.when(x["kind"] == "function", _signature(x, k)).alias("signature"), _documentation(k["lines"], x["line"], F.col("language")).alias("documentation"))))
    whole = found.select("file_path", F.explode(full).alias("x"))
    first = whole.groupBy("file_path", "x.name", "x.kind", "x.line").agg(
        F.min_by(F.struct("x.end_line", "x.signature", "x.documentation"), F.struct("x.nth", "x.start")).alias("y"))
    return first.select("file_path", "name", "kind", "line", "y.end_line", "y.signature", "y.documentation")


def _found(pattern: Column) -> Column:
    """Matches of one pattern, each with the 200 characters from its start on."""
    def windows(m):
        pairs = F.transform(m, lambda x: F.substring(F.concat(x["match"], x["gap"]), 1, 200))
        return let(pairs, lambda w: F.transform(m, lambda x, i: F.struct(
            pattern["kind"].alias("kind"), x["c1"].alias("name"), x["start"].alias("start"), x["end"].alias("end"), x["line"].alias("line"),
            (x["line"] + F.regexp_count(x["match"], F.lit("\n"))).cast("int").alias("end_line"),
            F.substring(F.array_join(F.slice(w, i + 1, 100), ""), 1, 200).alias("window"), pattern["nth"].alias("nth"), F.length(x["match"]).alias("length"))))

    return let(spans(F.col("content"), pattern["regex"], 1), windows)


def _signature(x: Column, marks: Column) -> Column:
    """From the match to the next ``{``, or else ``:``, or else 100 characters behind
    it; at most 200, white space squeezed."""
    def until(mark, last):
        near = F.call_function("locate", F.lit(mark), x["window"], x["length"] + 1)
        return F.when(near > 0, near - 1).when(last >= x["end"], 200)

    cut = F.coalesce(until("{", marks["brace"]), until(":", marks["colon"]), x["length"] + 100)
    return F.trim(F.regexp_replace(F.substring(x["window"], F.lit(1), F.least(cut, F.lit(200))), r"\s+", " "))


def _documentation(lines: Column, line: Column, language: Column, most: int = 10) -> Column:
    """The comment right above a line, without its marks; null if there is none."""
    first = F.greatest(line - most, F.lit(1))
    above = F.when(line > 1, F.reverse(F.slice(lines, first, F.least(line - 1, F.lit(most))))).otherwise(F.array().cast("array<string>"))
    start = F.struct(F.array().cast("array<string>").alias("got"), F.lit(False).alias("stop"))
    blank = r"^[\s]+|[\s]+$"
    hash_, slashes = language.isin("python", "ruby"), ~language.isin("python", "ruby")

    def step(s, raw):
        x = F.regexp_replace(raw, blank, "")
        quoted = (language == "python") & F.rlike(x, F.lit(r"^(\"\"\"|\'\'\')"))
        text = (
            F.when(quoted, F.regexp_replace(x, r"^[\"\']+|[\"\']+$", ""))
            .when(hash_ & x.startswith("#"), F.substring(x, 2, 2147483647))
            .when(slashes & x.startswith("//"), F.substring(x, 3, 2147483647))
            .when(slashes & x.startswith("*"), F.substring(x, 2, 2147483647)))
        text = F.when(quoted, text).otherwise(F.regexp_replace(text, blank, ""))
        takes = ~s["stop"] & text.isNotNull()
        return F.struct(F.when(takes, F.array_append(s["got"], text)).otherwise(s["got"]).alias("got"), (s["stop"] | text.isNull() | quoted).alias("stop"))

    return F.aggregate(above, start, step, lambda s: F.when(F.size(s["got"]) > 0, F.array_join(F.reverse(s["got"]), "\n")))


def symbols(files: DataFrame) -> DataFrame:
    """Rows (file_path, line, column, end_column, name, kind, signature) of five languages
    (others are read as Python): at most one a line and kind."""
    def of(lang):
        def one(kind, p):
            groups = [F.nullif(F.regexp_extract("text", p, i), F.lit("")) for i in range(1, re.compile(p).groups + 1)]
            at = F.regexp_instr("text", F.lit(p))
            found = F.struct(F.coalesce(*groups).alias("name"), F.lit(kind).alias("kind"), at.alias("column"), (at + F.length(F.regexp_extract("text", p, 0))).alias("end_column"))
            return F.when(F.rlike("text", F.lit(p)), found)  # most lines have none and are searched once

        return F.filter(F.array(*[one(k, p) for k, p in LINE_PATTERNS[lang].items()]), lambda s: s["name"].isNotNull())

    found = by_language(F.col("language"), {x: of(x) for x in LINE_PATTERNS if x != "python"}, of("python"))
    return code_lines(files).select("file_path", "line", "text", F.explode(found).alias("s")).select(
        "file_path", "line", "s.column", "s.end_column", "s.name", "s.kind", F.trim("text").alias("signature"))


def references(files: DataFrame) -> DataFrame:
    """Rows (file_path, line, column, name) of every identifier that is no keyword of its language."""
    hits = code_lines(files).select("file_path", "language", "line", F.explode(spans(F.col("text"), r"\b[a-zA-Z_]\w*\b")).alias("m"))
    word = F.col("m.match")
    keyword = F.when(F.col("language") == "javascript", word.isin(REFERENCE_KEYWORDS["javascript"])).otherwise(word.isin(REFERENCE_KEYWORDS["python"]))
    return hits.filter(~keyword).select("file_path", "line", (F.col("m.start") + 1).alias("column"), word.alias("name"))


def go_to_definition(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """For each reference (file_path, line, column, name) its definitions: those in the
    same file, if there are any, or else all.

    Joins are merged, as in ``hover``: Spark takes tables of lines for as small as files."""
    d = defs.select(F.col("name"), F.col("file_path").alias("def_file"), F.col("line").alias("def_line"), "kind")
    out = [*refs.columns, "def_file", "def_line", "kind"]
    own = refs.join(d.withColumn("file_path", F.col("def_file")).hint("merge"), ["file_path", "name"]).select(*out)
    rest = refs.join(defs.select("file_path", "name").distinct().hint("merge"), ["file_path", "name"], "left_anti")
    return own.unionByName(_by_name(rest, d).select(*out))


def _by_name(refs: DataFrame, defs: DataFrame, wide: int = 16_384, high: int = 4_096) -> DataFrame:
    """All pairs of references and definitions of one name.  A name's pairs are a grid of
    cells of about ``wide`` references and ``high`` definitions, and each cell may go to
    another task, so a name that is used and defined everywhere is not left to one.  The
    number of tasks is fixed: cells are few bytes before they are joined, so Spark would
    put them together again."""
    n = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = refs.groupBy("name").agg(F.ceil(F.count("*") / wide).cast("int").alias("_w")).join(
        defs.groupBy("name").agg(F.ceil(F.count("*") / high).cast("int").alias("_h")).hint("merge"), "name")
    across, down = F.explode(F.sequence(F.lit(0), F.col("_w") - 1)), F.explode(F.sequence(F.lit(0), F.col("_h") - 1))
    r = refs.join(names.hint("merge"), "name").select(*refs.columns, F.pmod(F.xxhash64(*refs.columns), "_w").cast("int").alias("_x"), down.alias("_y"))
    d = defs.join(names.hint("merge"), "name").select(*defs.columns, across.alias("_x"), F.pmod(F.xxhash64(*defs.columns), "_h").cast("int").alias("_y"))
    cell = ["name", "_x", "_y"]
    return r.repartition(n, *cell).join(d.repartition(n, *cell).hint("merge"), cell)


def find_references(name: str, refs: DataFrame, defs: DataFrame) -> DataFrame:
    uses = refs.filter(F.col("name") == name).select("file_path", "line", F.lit("use").alias("role"))
    return uses.unionByName(defs.filter(F.col("name") == name).select("file_path", "line", F.lit("definition").alias("role")))


def search_symbols(defs: DataFrame, query: str, limit: int = 20) -> DataFrame:
    return defs.filter(F.contains(F.lower("name"), F.lit(query.lower()))).orderBy("file_path", "line", "name", "kind").limit(limit)


def completions(defs: DataFrame, prefix: str, limit: int = 20) -> DataFrame:
    names = defs.filter(F.contains(F.lower("name"), F.lit(prefix.lower()))).select("name", "kind").distinct()
    return names.orderBy(~F.lower("name").startswith(prefix.lower()), F.length("name"), "name", "kind").limit(limit)


def scopes(files: DataFrame) -> DataFrame:
    """Rows (file_path, name, kind, indent, line, end_line) of Python blocks: a block
    ends before the first later full line that is indented no deeper."""
    line = code_lines(files.filter("language = 'python'")).filter(F.trim("text") != "").withColumn("indent", F.length("text") - F.length(F.ltrim("text")))
    every = F.sort_array(F.collect_list(F.struct("line", "indent", "text")))
    per = line.groupBy("file_path").agg(every.alias("ls"))
    head = per.select("file_path", "ls", F.explode("ls").alias("x")).select(
        "file_path", "ls", "x.line", "x.indent", F.regexp_extract("x.text", r"^\s*(?:async\s+)?def\s+(\w+)", 1).alias("f"), F.regexp_extract("x.text", r"^\s*class\s+(\w+)", 1).alias("c")
    ).filter("f <> '' or c <> ''")
    later = F.filter("ls", lambda x: (x["line"] > F.col("line")) & (x["indent"] <= F.col("indent")))
    last = F.get(F.col("ls"), F.size("ls") - 1)["line"]
    return head.select(
        "file_path", F.when(F.col("f") != "", F.col("f")).otherwise(F.col("c")).alias("name"), F.when(F.col("f") != "", "function").otherwise("class").alias("kind"),
        "indent", "line", F.coalesce(F.get(later, F.lit(0))["line"] - 1, last).alias("end_line"))


def enclosing(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """The innermost block around each (file_path, at_line): an interval join within a file."""
    p, b = points.alias("p"), blocks.alias("b")
    met = p.join(b, (F.col("p.file_path") == F.col("b.file_path")) & F.col("p.at_line").between(F.col("b.line"), F.col("b.end_line")))
    return met.groupBy(F.col("p.file_path").alias("file_path"), F.col("p.at_line").alias("at_line")).agg(
        F.max_by(F.struct("b.name", "b.kind", "b.line"), F.struct("b.line", "b.indent")).alias("x")).select("file_path", "at_line", "x.name", "x.kind", "x.line")


def assignments(files: DataFrame) -> DataFrame:
    """Last assignment of each name in its innermost block (or the file)."""
    vars_ = symbols(files.filter("language = 'python'")).filter("kind = 'variable'")
    inner = enclosing(vars_.select("file_path", F.col("line").alias("at_line")).distinct(), scopes(files)).select(
        "file_path", F.col("at_line").alias("line"), F.col("name").alias("scope"), F.col("line").alias("scope_line"))
    j = vars_.select("file_path", "line", F.col("name").alias("variable")).join(inner, ["file_path", "line"], "left")
    return j.groupBy("file_path", F.coalesce("scope", F.lit("")).alias("scope"), F.coalesce("scope_line", F.lit(0)).alias("scope_line"), "variable").agg(F.max("line").alias("line"))


def deduplicate(defs: DataFrame) -> DataFrame:
    return defs.dropDuplicates(["file_path", "name", "kind", "line"])


def visible_symbols(points: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (file_path, at_line, variable, scope, scope_line, line): what is assigned in any
    block around each (file_path, at_line), or in the file itself."""
    blocks = scopes(files).select("file_path", F.col("line").alias("scope_line"), "end_line")
    a = assignments(files).join(blocks, ["file_path", "scope_line"], "left")
    p = points.select("file_path", "at_line").distinct()
    inside = (F.col("scope_line") == 0) | F.col("at_line").between(F.col("scope_line"), F.col("end_line"))
    return p.join(a, "file_path").filter(inside).select("file_path", "at_line", "variable", "scope", "scope_line", "line")


def find_symbol(points: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """The innermost assignment of a name that each (file_path, at_line) sees."""
    seen = visible_symbols(points, files).filter(F.col("variable") == name)
    return seen.groupBy("file_path", "at_line").agg(F.max_by(F.struct("scope", "line"), "scope_line").alias("x")).select("file_path", "at_line", "x.*")


def signatures(files: DataFrame) -> DataFrame:
    """Rows (file_path, line, name, signature) of functions."""
    return extract_symbols(files).filter("kind = 'function'").select("file_path", "line", "name", "signature")


def doc_comments(files: DataFrame) -> DataFrame:
    """Rows (file_path, line, name, kind, comment): the comments right above symbols."""
    return extract_symbols(files).filter("documentation is not null").select("file_path", "line", "name", "kind", F.col("documentation").alias("comment"))


#: Of symbols at one place the first of these kinds is shown.
KIND_ORDER = ["function", "class", "struct", "interface", "type", "method", "variable"]


def hover(points: DataFrame, defs: DataFrame) -> DataFrame:
    """The symbol at each (file_path, line, at_column), with what is shown there.

    The join is merged: what Spark takes for the size of ``defs`` is that of the files
    before they are parted into lines, and such a table would go through the driver."""
    met = points.join(defs.hint("merge"), ["file_path", "line"]).filter(F.col("at_column").between(F.col("column"), F.col("end_column")))
    order = F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("kind"))
    first = met.groupBy("file_path", "line", "at_column").agg(F.min_by(F.struct("name", "kind", "signature"), order).alias("x")).select("file_path", "line", "at_column", "x.*")
    return first.withColumn("contents", F.concat(F.lit("**"), "kind", F.lit("** `"), "name", F.lit("`\n\n"), "signature"))


def combined_search(files: DataFrame, query: str, search=None) -> DataFrame:
    """``struct:"..."``, ``lang:``, ``file:`` (a glob) and words in one query; words must all occur."""
    struct = re.search(r'struct:"([^"]*)"', query)
    rest = query.replace(struct.group(), "") if struct else query
    out = files
    for word in rest.split():
        if word.startswith("lang:"):
            out = out.filter(F.lower("language") == word[5:].lower())
        elif word.startswith("file:"):
            glob = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in word[5:])
            out = out.filter(F.rlike("file_path", F.lit(f"^{glob}$")))
        else:
            out = out.filter(F.contains(F.lower("content"), F.lit(word.lower())))
    if struct:
        return structural_search(out, struct.group(1)).select("file_path", "line", "match")
    return out.select("file_path", F.lit(1).alias("line"), F.lit("").alias("match"))
