"""Column functions: tokenizers, hashes, query understanding, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# -- fixed values --------------------------------------------------------------
LANGUAGES = {
    ".py": "python", ".pyw": "python", ".pyi": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".kt": "kotlin", ".kts": "kotlin",
    ".scala": "scala", ".go": "go", ".rs": "rust", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp",
    ".hpp": "cpp", ".hxx": "cpp", ".cs": "csharp", ".fs": "fsharp", ".fsx": "fsharp", ".rb": "ruby", ".php": "php",
    ".swift": "swift", ".m": "objective-c", ".mm": "objective-c", ".sql": "sql", ".sh": "shell", ".bash": "shell",
    ".zsh": "shell", ".ps1": "powershell", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".xml": "xml", ".html": "html",
    ".htm": "html", ".css": "css", ".scss": "scss", ".sass": "sass", ".less": "less", ".md": "markdown",
    ".markdown": "markdown", ".rst": "restructuredtext", ".txt": "text", ".r": "r", ".lua": "lua", ".pl": "perl",
    ".pm": "perl", ".ex": "elixir", ".exs": "elixir", ".erl": "erlang", ".hrl": "erlang", ".hs": "haskell",
    ".lhs": "haskell", ".clj": "clojure", ".cljs": "clojure", ".dart": "dart", ".vue": "vue", ".svelte": "svelte",
}
INDEXED_EXTENSIONS = (
    ".py .js .ts .jsx .tsx .java .kt .scala .go .rs .c .cpp .h .hpp .rb .php .cs .fs .swift .m .sql .sh .bash .yaml .yml "
    ".json .xml .md .txt .rst .html .css .scss .less").split()
SYNONYMS = {
    "function": ["func", "def", "method", "fn"], "class": ["struct", "type", "interface"],
    "variable": ["var", "let", "const", "val"], "string": ["str", "text", "char"], "integer": ["int", "number", "num"],
    "array": ["list", "slice", "vector"], "dictionary": ["dict", "map", "hash", "object"],
    "error": ["exception", "err", "panic"], "async": ["await", "promise", "future"], "test": ["spec", "unittest", "pytest"],
}
INTENTS = [
    ("example", ["how to", "example", "usage"]), ("debug", ["error", "fix", "bug", "issue"]),
    ("definition", ["define", "what is", "explain"]), ("import", ["import", "require", "from"]),
]
CODE_PATTERNS = [r"\w+\(\)", r"\w+\.\w+", r"[a-z]+[A-Z]\w*", r"\w+_\w+"]
#: A run of letters and digits up to a camel hump, or a mark; runs of one kind, most of all, are matched at once.
TOKEN = r"(?U)[a-z]++(?![0-9])|[A-Z0-9]++(?![a-z])|[a-zA-Z0-9]+?(?:(?<=[a-z])(?=[A-Z])|(?![a-zA-Z0-9]))|[^\s\w]"


# -- n-grams -------------------------------------------------------------------


def normalize(text: Column) -> Column:
    """NFKC and lower case; texts of ASCII skip the normaliser."""
    nfkc = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.lower(F.when(F.octet_length(text) == F.char_length(text), text).otherwise(nfkc))


def _windows(text: Column, n: int) -> Column:
    """Every n characters in order, in one pass over the text: each match takes one
    character and looks at those behind it."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def ngrams(text: Column, n: int = 3) -> Column:
    """All n-grams in order; a shorter text is its own only one, an empty text has none."""
    k = F.char_length(text)
    return F.when(k == 0, F.array().cast("array<string>")).when(k < n, F.array(text)).otherwise(_windows(text, n))


def ngrams_with_positions(text: Column, n: int = 3) -> Column:
    k = F.char_length(text)
    one = F.array(F.struct(text.alias("ngram"), F.lit(0).alias("start"), k.alias("end")))
    many = F.transform(_windows(text, n), lambda g, i: F.struct(g.alias("ngram"), i.alias("start"), (i + n).alias("end")))
    return F.when(k == 0, F.filter(one, lambda _: F.lit(False))).when(k < n, one).otherwise(many)


def ngrams_with_boundaries(text: Column, n: int = 3) -> Column:
    return ngrams(F.concat(F.lit("^"), text, F.lit("$")), n)


def ngram_count(text: Column, n: int = 3) -> Column:
    k = F.char_length(text)
    return F.when(k < n, (k > 0).cast("int")).otherwise(k - n + 1)


def multi_ngrams(text: Column, low: int, high: int) -> Column:
    return F.flatten(F.array(*[ngrams(text, n) for n in range(low, high + 1)]))


def ngrams_by_size(text: Column, low: int, high: int) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(n) for n in range(low, high + 1)]), F.array(*[ngrams(text, n) for n in range(low, high + 1)]))


def code_words(code: Column) -> Column:
    """Words and marks of code: camel case and underscores part words."""
    return F.regexp_extract_all(code, F.lit(TOKEN), F.lit(0))


def code_ngrams(code: Column, n: int = 3) -> Column:
    return F.flatten(F.transform(code_words(code), lambda w: ngrams(F.lower(w), n)))


def query_ngrams(query: str, n: int = 3, mode: str = "raw") -> list[str]:
    """Distinct n-grams of a query in order; ``code`` tokenizes it as content is."""
    import re

    low = query.lower()
    words = [low]
    if mode == "code":
        parted = re.sub("_+", " ", re.sub("([a-z])([A-Z])", r"\1 \2", query))
        words = [w.lower() for w in re.findall(r"[a-zA-Z0-9]+|[^\s\w]", parted)]
    out: dict[str, None] = {}
    for w in words:
        for g in ([w] if 0 < len(w) < n else [w[i: i + n] for i in range(len(w) - n + 1)]):
            out[g] = None
    return list(out)


def highlights(text: Column, query: str, n: int = 3) -> Column:
    """[start, end) ranges of a text's n-grams that the query has; touching ranges merge."""
    wanted = query_ngrams(query, n)
    spans = F.filter(ngrams_with_positions(F.lower(text), n), lambda s: s["ngram"].isin(wanted) if wanted else F.lit(False))
    kind = "array<struct<start:int,end:int>>"

    def merge(acc, s):
        last = F.get(acc, F.size(acc) - 1)
        joined = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (s["start"] <= last["end"]), joined).otherwise(
            F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))

    return F.aggregate(spans, F.array().cast(kind), merge)


# -- matches -------------------------------------------------------------------


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans(text: Column, regex: str | Column, groups: int = 0, block: int = 256) -> Column:
    """Every match of a regex that matches no empty text, in order: an array of
    (start, end, line, match, gap, c1, c2, ...) with 0-based offsets, 1-based lines, the
    text behind a match up to the next, and the groups.

    Offsets are sums over the texts between matches.  They are kept for each block
    of matches, so a row costs little more than its length, and nothing leaves it."""
    regex = F.lit(regex)
    every = [F.regexp_extract_all(text, regex, F.lit(i)) for i in range(groups + 1)]
    found = F.struct(F.split(text, regex).alias("gaps"), *[c.alias(f"c{i}") for i, c in enumerate(every)])
    breaks = lambda x: F.regexp_count(x, F.lit("\n"))
    add = lambda a, b: F.struct((a["chars"] + b["chars"]).alias("chars"), (a["lines"] + b["lines"]).alias("lines"))
    zero = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("lines"))

    def size(gap, match):
        return F.struct((F.length(gap) + F.length(match)).alias("chars"), (breaks(gap) + breaks(match)).alias("lines"))

    def total(sizes, first, n):
        return F.aggregate(F.slice(sizes, first + 1, n), zero, add)

    def starts(f, sizes):
        blocks = F.sequence(F.lit(0), F.floor(F.size(sizes) / block).cast("int"))
        grow = lambda acc, b: F.array_append(acc, add(F.element_at(acc, -1), total(sizes, b * block, F.lit(block))))
        return let(F.aggregate(blocks, F.array(zero), grow), lambda sums: F.transform(f["c0"], lambda m, i: let(
            add(F.get(sums, F.floor(i / block).cast("int")), total(sizes, F.floor(i / block).cast("int") * block, i % block)), lambda at: one(f, m, i, at))))

    def one(f, m, i, at):
        gap = F.get(f["gaps"], i)
        start = at["chars"] + F.length(gap)
        return F.struct(
            start.alias("start"), (start + F.length(m)).alias("end"), (at["lines"] + breaks(gap) + 1).alias("line"), m.alias("match"),
            F.get(f["gaps"], i + 1).alias("gap"), *[F.get(f[f"c{g}"], i).alias(f"c{g}") for g in range(1, groups + 1)])

    return let(found, lambda f: let(F.transform(f["c0"], lambda m, i: size(F.get(f["gaps"], i), m)), lambda sizes: starts(f, sizes)))


# -- documents -----------------------------------------------------------------


def extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"(\.[^./]+)$", 1)


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.element_at(table, extension(path)), F.lit("unknown"))


def line_count(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def blob_hash(text: Column) -> Column:
    """Git's hash of a blob."""
    data = text.cast("binary")
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(text).cast("string")).cast("binary"), F.unhex(F.lit("00")), data))


def document_id(repo: Column, path: Column, blob: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", repo, path, blob).cast("binary"), 256), 1, 16)


def repo_id(path: Column) -> Column:
    return F.substring(F.sha2(path.cast("binary"), 256), 1, 12)


# -- query understanding ---------------------------------------------------------


def query_terms(q: Column) -> Column:
    return F.regexp_extract_all(q, F.lit(r"(?U)\w+"), F.lit(0))


def synonyms_of(q: Column) -> Column:
    table = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    found = F.transform(query_terms(q), lambda t: F.coalesce(F.element_at(table, F.lower(t)), F.array().cast("array<string>")))
    return F.flatten(found)


def query_filter(q: Column, name: str) -> Column:
    value = {"lang": r"lang:(\w+)", "repo": r"repo:(\S+)", "file": r"file:(\S+)"}[name]
    return F.nullif(F.regexp_extract(q, value, 1), F.lit(""))


def intent_of(q: Column) -> Column:
    low, out = F.lower(q), F
    for name, words in INTENTS:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = out.when(hit, name)
    return out.otherwise("search")


def code_patterns(q: Column) -> Column:
    return F.concat(*[F.regexp_extract_all(q, F.lit(p), F.lit(0)) for p in CODE_PATTERNS])


def analyze_query(q: Column) -> Column:
    return F.struct(
        query_terms(q).alias("terms"), synonyms_of(q).alias("synonyms"), query_filter(q, "lang").alias("lang"),
        query_filter(q, "repo").alias("repo"), query_filter(q, "file").alias("file"), intent_of(q).alias("intent"),
        code_patterns(q).alias("patterns"))


# -- prompts and chats -----------------------------------------------------------

PROMPTS = {  # our own wording; the placeholders are what callers fill
    "explain": "Explain what this {language} code does:\n{code}",
    "review": "Review this {language} code and list problems by severity:\n{code}",
    "generate": "Write {language} code for this task:\n{task}",
    "search": "Turn this question into a code search query:\n{question}",
    "document": "Write documentation for this {language} code:\n{code}",
    "default": "{question}\n{code}",
}


def truncate_middle(text: Column, limit: int = 4000, mark: str = "\n...\n") -> Column:
    half = (limit - len(mark)) // 2
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, half), F.lit(mark), F.right(text, F.lit(half))))


def code_blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?s)```\w*\n(.*?)```"), F.lit(1))


def numbered_items(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?m)^\s*\d+[.)]\s+(.+)$"), F.lit(1))


def recent_turns(chats: DataFrame, limit: int = 20, keep: int = 10) -> DataFrame:
    """Chats longer than ``limit`` messages keep their last ``keep``."""
    w = W.partitionBy("conv_id")
    ranked = chats.withColumns({
        "_n": F.count("*").over(w), "_r": F.row_number().over(w.orderBy(F.desc("turn"), F.desc("role"), F.desc("text")))})
    return ranked.filter(f"_n <= {limit} or _r <= {keep}").drop("_n", "_r")
