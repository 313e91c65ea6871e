"""One query for each of the engine's own operators, over whole tables, and the SQL
that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import analysis as A
from gleaner.operators import dependencies as D
from gleaner.operators import index as I
from gleaner.operators import intel as X
from gleaner.operators import logs as L
from gleaner.operators import monitors as K
from gleaner.operators import ranking as R
from gleaner.operators import similarity as S
from gleaner.sources import corpus as C

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: A code file for every part, said in SQL that Spark and others read alike.
CODE = r"""
SELECT p_partkey AS doc_id, concat('repo', p_partkey % 7) AS repo,
  concat('src/pkg/mod', p_partkey, CASE WHEN p_size % 5 = 0 THEN '.js' ELSE '.py' END) AS file_path,
  CASE WHEN p_size % 5 = 0 THEN 'javascript' ELSE 'python' END AS language,
  CASE WHEN p_size % 5 = 0 THEN concat(
    'import { thing', p_size, ' } from ''./mod', p_partkey % 40, '''', chr(10),
    'function doThing', p_size, '(x) {', chr(10), '  if (x && y) { return eval(x); }', chr(10),
    '  document.write(x);   ', chr(10), '}', chr(10), 'const val', p_partkey % 50, ' = ', p_size, ';', chr(10), 'class Widget', p_size, ' {}')
  ELSE concat(
    'import os, sys', chr(10), 'from pkg.mod', (p_partkey * 7 + 3) % 200, ' import name', p_size, chr(10),
    CASE WHEN p_size % 4 = 0 THEN concat('# TODO: check ', p_brand, chr(10)) ELSE '' END, chr(10),
    'class Item', p_partkey % 100, ':', chr(10),
    CASE WHEN p_partkey % 25 = 0 THEN concat('    password = "secret', p_partkey, '"', chr(10)) ELSE '' END,
    '    def getName(self, other):', chr(10), '        y_value = self.name', chr(10), '        if y_value and other:', chr(10),
    '            for i in range(', p_size, '):', chr(10),
    CASE WHEN p_size % 10 = 1 THEN concat('                x = eval(other)', chr(10)) ELSE '' END,
    '                total_', p_size, ' = i + 1', chr(10), '        return y_value', chr(10), chr(10),
    'def func_', p_partkey, '(a, b):', chr(10), '    onClick = a', chr(10), '    return b')
  END AS content
FROM part"""


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def code(spark: SparkSession, d: str, spread: bool = False) -> DataFrame:
    """``spread``: in two tasks a core, or as many as shuffles have if those are fewer (each task
    sends its own copy of common lines, so more of them cost more); else as the rows of ``part``
    lie, which are a few bytes each where their files have hundreds, so one task may have a million."""
    part = table(spark, d, "part")
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(12, 2 * spark.sparkContext.defaultParallelism))
    (part.repartition(tasks, "p_partkey") if spread else part).createOrReplaceTempView("_gleaner_part")
    return spark.sql(CODE.replace("FROM part", "FROM _gleaner_part"))


def query(sql: str | None = None):
    """Registers a query under its function's name; ``@code`` in the SQL is the code corpus."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql.replace("@code", f"({CODE})")
        return f

    return register


def ngrams_sql(t: str, n: int = 3) -> str:
    return f"CASE WHEN length({t}) = 0 THEN [] WHEN length({t}) < {n} THEN [{t}] ELSE [substr({t}, i, {n}) for i in range(1, length({t}) - {n} + 2)] END"


WORDS_SQL = r"regexp_extract_all(regexp_replace(regexp_replace(content, '([a-z])([A-Z])', '\1 \2', 'g'), '_+', ' ', 'g'), '[a-zA-Z0-9]+|[^\s\p{L}\p{N}_]')"
POSTINGS_SQL = f"""words AS (SELECT doc_id, lower(unnest({WORDS_SQL})) AS w FROM code),
grams AS (SELECT doc_id, unnest({ngrams_sql('w')}) AS ngram, 1.0::DOUBLE AS score, false AS is_symbol FROM words),
names AS (SELECT doc_id, unnest([regexp_extract(x, '^\\s*class\\s+(\\w+)', 1) for x in string_split(content, chr(10)) if regexp_matches(x, '^\\s*class\\s+\\w+')]) AS name FROM code),
symgrams AS (SELECT doc_id, unnest({ngrams_sql('lower(name)')}) AS ngram, 2.0::DOUBLE AS score, true AS is_symbol FROM names),
postings AS (SELECT ngram, doc_id, max(score) AS score, bool_or(is_symbol) AS is_symbol, count(*) AS n_hits
  FROM (SELECT doc_id, ngram, score, is_symbol FROM grams UNION ALL SELECT doc_id, ngram, score, is_symbol FROM symgrams) GROUP BY 1, 2)""".replace("\\\\", "\\")


def class_names(files: DataFrame) -> DataFrame:
    lines = files.select("doc_id", F.explode(F.split("content", "\n")).alias("x"))
    return lines.select("doc_id", F.regexp_extract("x", r"^\s*class\s+(\w+)", 1).alias("name")).filter("name <> ''")


def postings(spark: SparkSession, d: str) -> DataFrame:
    files = code(spark, d)
    return I.build_postings(files, class_names(files))


# -- tokenizers -----------------------------------------------------------------------


@query(f"SELECT doc_id, {ngrams_sql('lower(content)')}::VARCHAR[] AS g FROM @code".join(["SELECT ngram, count(*) AS n FROM (SELECT unnest(g) AS ngram FROM (", ")) GROUP BY 1"]))
def g2_ngrams(spark, d):
    return code(spark, d).select(F.explode(T.ngrams(F.lower("content"))).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("n"))


@query("""SELECT item_id, count(*) AS n, sum(CASE WHEN g = 'the' THEN i - 1 ELSE 0 END)::BIGINT AS the_starts FROM (
  SELECT item_id, unnest([{'i': i, 'g': substr(lower(text), i, 3)} for i in range(1, length(text) - 1)], recursive := true) FROM benchmark) GROUP BY 1""")
def g3_ngram_positions(spark, d):
    x = table(spark, d, "benchmark").select("item_id", F.explode(T.ngrams_with_positions(F.lower("text"))).alias("x"))
    return x.groupBy("item_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("x.ngram") == "the", F.col("x.start")).otherwise(0)).alias("the_starts"))


@query(f"SELECT n_nationkey, unnest({ngrams_sql('t')}) AS ngram FROM (SELECT n_nationkey, concat('^', lower(n_name), '$') AS t FROM nation)")
def g4_boundary_ngrams(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.explode(T.ngrams_with_boundaries(F.lower("n_name"))).alias("ngram"))


@query(f"SELECT word, count(*) AS n FROM (SELECT lower(unnest({WORDS_SQL})) AS word FROM @code) GROUP BY 1")
def g5_code_tokens(spark, d):
    return code(spark, d).select(F.explode(F.transform(T.code_words(F.col("content")), F.lower)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(f"SELECT p_partkey, list_sort(list_distinct({ngrams_sql('lower(p_name)')})) AS grams FROM part")
def g7_unique_ngrams(spark, d):
    return table(spark, d, "part").select("p_partkey", F.sort_array(F.array_distinct(T.ngrams(F.lower("p_name")))).alias("grams"))


@query("SELECT doc_id, CASE WHEN length(text) < 3 THEN (length(text) > 0)::INT ELSE length(text) - 2 END AS n FROM documents")
def g8_ngram_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.ngram_count(F.col("text")).alias("n"))


@query("""WITH s AS (SELECT doc_id, i - 1 AS s, i + 2 AS e FROM (SELECT doc_id, lower(content) AS t, unnest(range(1, length(content) - 1)) AS i FROM @code)
  WHERE substr(t, i, 3) IN ('ret', 'etu', 'tur', 'urn')),
m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM s),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM m)
SELECT doc_id, min(s)::INT AS "start", max(e)::INT AS "end" FROM g GROUP BY doc_id, g""")
def g9_highlights(spark, d):
    x = code(spark, d).select("doc_id", F.explode(T.highlights(F.col("content"), "return")).alias("x"))
    return x.select("doc_id", "x.start", "x.end")


@query(f"SELECT n_nationkey, list_concat({ngrams_sql('lower(n_name)', 2)}, {ngrams_sql('lower(n_name)', 3)}) AS grams FROM nation")
def g10_multi_ngrams(spark, d):
    return table(spark, d, "nation").select("n_nationkey", T.multi_ngrams(F.lower("n_name"), 2, 3).alias("grams"))


# -- documents ---------------------------------------------------------------------------


def _docs(spark, d):
    return C.documents(code(spark, d).select("repo", F.col("file_path").alias("path"), "content"))


DOCS_SQL = r"""docs AS (SELECT repo, path, content, substr(sha256(repo), 1, 12) AS repo_id,
  sha1(concat('blob ', strlen(content), chr(0), content)) AS blob_hash, strlen(content) AS size_bytes,
  length(content) - length(replace(content, chr(10), '')) + 1 AS line_count,
  CASE regexp_extract(lower(path), '(\.[^./]+)$', 1) WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' ELSE 'unknown' END AS language
  FROM (SELECT repo, file_path AS path, content FROM @code))"""


@query(f"WITH {DOCS_SQL} SELECT substr(sha256(concat(repo_id, ':', path, ':', blob_hash)), 1, 16) AS doc_id, repo_id, path, blob_hash, language, size_bytes, line_count FROM docs")
def c11_documents(spark, d):
    return _docs(spark, d).select("doc_id", "repo_id", "path", "blob_hash", "language", "size_bytes", F.col("line_count").cast("long").alias("line_count"))


@query(r"""SELECT file_path, language FROM @code WHERE regexp_extract(lower(file_path), '(\.[^./]+)$', 1) IN ('.py', '.js')""")
def c3_extension_filter(spark, d):
    return code(spark, d).filter(C.keep_file(F.col("file_path"))).select("file_path", "language")


@query(f"WITH {DOCS_SQL} SELECT path FROM docs WHERE repo <> 'repo0' AND blob_hash NOT IN (SELECT blob_hash FROM docs WHERE repo = 'repo0')")
def c5_delta(spark, d):
    docs = _docs(spark, d)
    return C.delta(docs.filter("repo <> 'repo0'"), docs.filter("repo = 'repo0'")).select("path")


@query(f"WITH {DOCS_SQL} SELECT blob_hash, arg_min(path, repo_id || path) AS path FROM docs GROUP BY 1")
def c6_unique_blobs(spark, d):
    return C.unique_blobs(_docs(spark, d)).select("blob_hash", "path")


@query("""WITH o AS (SELECT p_partkey, p_size AS v FROM part WHERE p_size % 3 <> 0), n AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN p_size + 1 ELSE p_size END AS v FROM part WHERE p_size % 4 <> 0)
SELECT p_partkey, CASE WHEN o.v IS NULL THEN 'added' WHEN n.v IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM o FULL JOIN n USING (p_partkey) WHERE o.v IS DISTINCT FROM n.v""")
def c7_snapshot_diff(spark, d):
    p = table(spark, d, "part")
    old = p.filter("p_size % 3 <> 0").select("p_partkey", F.col("p_size").alias("v"))
    new = p.filter("p_size % 4 <> 0").select("p_partkey", F.expr("case when p_size % 7 = 0 then p_size + 1 else p_size end").alias("v"))
    return C.snapshot_diff(old, new, ["p_partkey"], "v")


@query(f"WITH {DOCS_SQL} SELECT count(*) AS files, count(DISTINCT blob_hash) AS blobs, sum(size_bytes)::BIGINT AS bytes, sum(line_count)::BIGINT AS lines, count(DISTINCT language) AS languages FROM docs")
def c9_crawl_stats(spark, d):
    return C.crawl_stats(_docs(spark, d))


# -- index and search -----------------------------------------------------------------------


@query(f"WITH code AS (SELECT * FROM @code), {POSTINGS_SQL} SELECT ngram, doc_id, score, is_symbol, n_hits FROM postings")
def i1_postings(spark, d):
    return postings(spark, d)


@query(f"WITH code AS (SELECT * FROM @code), {POSTINGS_SQL} SELECT ngram, doc_id, score, is_symbol, n_hits FROM postings")
def i5_merge(spark, d):
    files = code(spark, d)
    part = lambda r: I.build_postings(files.filter(f"doc_id % 2 = {r}"), class_names(files.filter(f"doc_id % 2 = {r}")))
    return I.merge_postings(part(0), part(1)).select("ngram", "doc_id", "score", "is_symbol", F.col("n_hits").cast("long").alias("n_hits"))


@query(f"WITH code AS (SELECT * FROM @code), {POSTINGS_SQL} SELECT ngram, count(*) AS n FROM postings WHERE doc_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY 1")
def i6_delete(spark, d):
    gone = table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("doc_id"))
    return I.delete_documents(postings(spark, d), gone).groupBy("ngram").agg(F.count("*").alias("n"))


@query(f"WITH code AS (SELECT * FROM @code), {POSTINGS_SQL} SELECT count(DISTINCT doc_id) AS documents, count(DISTINCT ngram) AS ngrams, count(*) AS postings, count(*) / count(DISTINCT ngram) AS avg_postings FROM postings")
def i9_index_stats(spark, d):
    return I.index_stats(postings(spark, d))


@query("""WITH s AS (SELECT o_custkey AS segment_id, sum(floor(o_totalprice)::BIGINT)::BIGINT AS size_bytes FROM orders GROUP BY 1),
r AS (SELECT *, sum(size_bytes) OVER (ORDER BY size_bytes, segment_id ROWS UNBOUNDED PRECEDING) AS running, row_number() OVER (ORDER BY size_bytes, segment_id) AS rank FROM s)
SELECT segment_id, size_bytes, running::BIGINT AS running, rank::INT AS rank FROM r WHERE running <= 5000000 AND rank <= 10""")
def i14_select_segments(spark, d):
    seg = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("segment_id")).agg(F.sum(F.floor("o_totalprice")).alias("size_bytes"))
    return I.select_segments(seg, 5_000_000)


@query(f"""WITH code AS (SELECT * FROM @code), {POSTINGS_SQL} SELECT ngram, doc_id, score, is_symbol, n_hits FROM postings WHERE doc_id % 5 IN (1, 3) AND doc_id % 9 <> 0""")
def i16_compact(spark, d):
    seg = postings(spark, d).withColumn("segment_id", (F.col("doc_id") % 5).cast("int"))
    chosen = spark.createDataFrame([(1,), (3,)], "segment_id int")
    dead = table(spark, d, "part").filter("p_partkey % 9 = 0").select(F.col("p_partkey").alias("doc_id"))
    return I.compact(seg, chosen, dead).select("ngram", "doc_id", "score", "is_symbol", F.col("n_hits").cast("long").alias("n_hits"))


@query("SELECT p_partkey AS doc_id FROM part WHERE p_partkey % 9 = 0 AND p_size % 2 = 0")
def i17_tombstones(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), "p_size")
    return I.clean_tombstones(p.filter("doc_id % 9 = 0").select("doc_id"), p.filter("p_size % 2 = 0"))


SEARCH_SQL = """hits AS (SELECT doc_id, sum(score) / {n}.0 AS score, bool_or(is_symbol) AS has_symbol_match FROM postings WHERE ngram IN ({grams}) GROUP BY 1 HAVING count(*) = {n})"""


def search_sql(q: str) -> str:
    grams = T.query_ngrams(q)
    return SEARCH_SQL.format(n=len(grams), grams=", ".join(f"'{g}'" for g in grams))


@query(f"WITH code AS (SELECT * FROM @code), {POSTINGS_SQL}, {search_sql('item')} SELECT doc_id, score, has_symbol_match FROM hits ORDER BY score DESC, doc_id LIMIT 20")
def q1_search(spark, d):
    return I.search(postings(spark, d), "item")


@query(f"WITH code AS (SELECT * FROM @code), {POSTINGS_SQL}, {search_sql('return')} SELECT doc_id, score, has_symbol_match FROM hits")
def q2_match_all(spark, d):
    return I.match(postings(spark, d), "return")


@query(f"WITH code AS (SELECT * FROM @code), {POSTINGS_SQL}, {search_sql('click')} SELECT doc_id, score + CASE WHEN contains(lower(content), 'click') THEN 5.0 ELSE 0.0 END AS score, contains(lower(content), 'click') AS exact FROM hits JOIN code USING (doc_id) ORDER BY score DESC, doc_id LIMIT 20")
def q5_search_bonus(spark, d):
    return I.search_with_bonus(postings(spark, d), code(spark, d), "click")


@query(f"WITH code AS (SELECT * FROM @code), {POSTINGS_SQL}, {search_sql('eval')} SELECT doc_id, score, has_symbol_match, language, file_path AS path FROM hits JOIN code USING (doc_id) WHERE language = 'javascript' ORDER BY score DESC, doc_id LIMIT 20")
def q8_service_search(spark, d):
    meta = code(spark, d).select("doc_id", "language", F.col("file_path").alias("path"))
    return I.search(postings(spark, d), "eval", meta=meta, language="JavaScript")


@query(f"WITH code AS (SELECT * FROM @code), {POSTINGS_SQL}, {search_sql('widget')}, r AS (SELECT doc_id, score, has_symbol_match, row_number() OVER (ORDER BY score DESC, doc_id) AS n FROM hits) SELECT doc_id, score, has_symbol_match FROM r WHERE n > 10 AND n <= 60")
def q6_second_page(spark, d):
    found = I.match(postings(spark, d), "widget")
    first = found.orderBy(F.desc("score"), "doc_id").limit(10).collect()
    return I.page(found, (first[-1]["score"], first[-1]["doc_id"]) if first else None)


@query("""SELECT name, count(*) AS count FROM (SELECT unnest([regexp_extract(x, '^\\s*class\\s+(\\w+)', 1) for x in string_split(content, chr(10)) if regexp_matches(x, '^\\s*class\\s+\\w+')]) AS name FROM @code) WHERE starts_with(lower(name), 'item1') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""".replace("\\\\", "\\"))
def q10_suggestions(spark, d):
    return I.suggestions(class_names(code(spark, d)), "item1")


# -- queries as text -----------------------------------------------------------------------


@query(r"""SELECT conv_id, turn, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS terms,
  CASE WHEN contains(lower(text), 'how to') OR contains(lower(text), 'example') OR contains(lower(text), 'usage') THEN 'example'
       WHEN contains(lower(text), 'error') OR contains(lower(text), 'fix') OR contains(lower(text), 'bug') OR contains(lower(text), 'issue') THEN 'debug'
       WHEN contains(lower(text), 'define') OR contains(lower(text), 'what is') OR contains(lower(text), 'explain') THEN 'definition'
       WHEN contains(lower(text), 'import') OR contains(lower(text), 'require') OR contains(lower(text), 'from') THEN 'import' ELSE 'search' END AS intent
  FROM conversations""")
def u4_intent(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", T.query_terms(t).alias("terms"), T.intent_of(t).alias("intent"))


@query(r"""SELECT p_partkey, nullif(regexp_extract(q, 'lang:(\w+)', 1), '') AS lang, nullif(regexp_extract(q, 'repo:(\S+)', 1), '') AS repo, nullif(regexp_extract(q, 'file:(\S+)', 1), '') AS file
FROM (SELECT p_partkey, concat('find ', p_name, CASE WHEN p_size % 2 = 0 THEN ' lang:python' ELSE '' END, CASE WHEN p_size % 3 = 0 THEN concat(' repo:r', p_size) ELSE '' END, ' file:*.py') AS q FROM part)""")
def u3_query_filters(spark, d):
    q = F.expr("concat('find ', p_name, case when p_size % 2 = 0 then ' lang:python' else '' end, case when p_size % 3 = 0 then concat(' repo:r', p_size) else '' end, ' file:*.py')")
    return table(spark, d, "part").withColumn("q", q).select("p_partkey", *[T.query_filter(F.col("q"), n).alias(n) for n in ("lang", "repo", "file")])


@query("""SELECT p_partkey, list_concat(CASE WHEN p_size % 2 = 0 THEN ['func', 'def', 'method', 'fn'] ELSE [] END, CASE WHEN p_size % 3 = 0 THEN ['exception', 'err', 'panic'] ELSE [] END) AS synonyms FROM part""")
def u2_synonyms(spark, d):
    q = F.expr("concat('my ', case when p_size % 2 = 0 then 'Function ' else '' end, case when p_size % 3 = 0 then 'error' else '' end)")
    return table(spark, d, "part").select("p_partkey", T.synonyms_of(q).alias("synonyms"))


@query(r"""SELECT doc_id, list_concat(list_concat(regexp_extract_all(content, '\w+\(\)'), regexp_extract_all(content, '\w+\.\w+')), list_concat(regexp_extract_all(content, '[a-z]+[A-Z]\w*'), regexp_extract_all(content, '\w+_\w+'))) AS patterns FROM @code""")
def u5_code_patterns(spark, d):
    return code(spark, d).select("doc_id", T.code_patterns(F.col("content")).alias("patterns"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 4000 THEN text ELSE concat(substr(text, 1, 1997), chr(10), '...', chr(10), right(text, 1997)) END AS prompt FROM documents""")
def k24_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncate_middle(F.col("text")).alias("prompt"))


@query("""SELECT conv_id, turn, role, text FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS r FROM conversations) WHERE n <= 4 OR r <= 2""")
def k25_recent_turns(spark, d):
    return T.recent_turns(table(spark, d, "conversations"), 4, 2).select("conv_id", "turn", "role", "text")


# -- vectors and ranking ---------------------------------------------------------------------


@query("""SELECT vec_id, round(sqrt(list_sum([x * x for x in u])), 6) AS length FROM (SELECT vec_id, [x::DOUBLE / n for x in embedding] AS u FROM (SELECT vec_id, embedding, sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in embedding])) AS n FROM embeddings))""")
def v1_unit(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(R.norm(R.unit(F.col("embedding"))), 6).alias("length"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[64] AS e FROM embeddings WHERE vec_id % 50 = 0), v AS (SELECT vec_id, embedding::DOUBLE[64] AS e FROM embeddings),
s AS (SELECT query_id, vec_id, round(array_cosine_similarity(q.e, v.e), 6) AS score FROM q JOIN v ON query_id <> vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, score, rank::INT AS rank FROM r WHERE rank <= 10""")
def v3_nearest(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return R.nearest_to_each(v, v.filter("vec_id % 50 = 0"), 10)


@query("""WITH l AS (SELECT p_partkey AS doc_id, p_retailprice AS score FROM part ORDER BY 2 DESC, 1 LIMIT 40), s AS (SELECT p_partkey AS doc_id, p_size::DOUBLE AS score FROM part ORDER BY 2 DESC, 1 LIMIT 40),
a AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM l), b AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM s)
SELECT doc_id, a.score AS lexical_score, a.r::INT AS lexical_rank, b.score AS semantic_score, b.r::INT AS semantic_rank, round(coalesce(0.6 / (60 + a.r), 0) + coalesce(0.4 / (60 + b.r), 0), 9) AS combined_score
FROM a FULL JOIN b USING (doc_id) ORDER BY combined_score DESC, doc_id LIMIT 20""")
def v9_fusion(spark, d):
    p = table(spark, d, "part")
    return R.fuse(p.select(F.col("p_partkey").alias("doc_id"), F.col("p_retailprice").alias("score")), p.select(F.col("p_partkey").alias("doc_id"), F.col("p_size").cast("double").alias("score")))


CLICKS = "SELECT coalesce(get_json_object(props, '$.k'), 'none') AS query, user_id AS doc_id, event_id % 10 AS position, event_type = 'click' AS clicked FROM {events} WHERE event_type IN ('click', 'view')"


@query("""WITH c AS (SELECT coalesce(json_extract_string(props, '$.k'), 'none') AS query, user_id AS doc_id, event_id % 10 AS position, event_type = 'click' AS clicked FROM events WHERE event_type IN ('click', 'view')),
a AS (SELECT query, doc_id, greatest(count(*) FILTER (NOT clicked), 1) AS impressions, count(*) FILTER (clicked) AS clicks, sum(CASE WHEN NOT clicked THEN position ELSE 0 END)::BIGINT AS total_position FROM c GROUP BY 1, 2)
SELECT *, round(clicks / impressions, 6) AS ctr, round(clicks / impressions * (1 + 0.1 * total_position / impressions), 6) AS adjusted_ctr FROM a""")
def r8_click_rates(spark, d):
    return R.click_stats(spark.sql(CLICKS, events=table(spark, d, "events")))


@query("""SELECT p_partkey AS doc_id, round(0.4 * p_size / 50.0 + 0.3 * p_retailprice / 2000.0 + 0.3 * (p_size % 2 = 0)::INT + 0.1 * (p_size % 3 = 0)::INT, 6) AS rank_score FROM part""")
def r4_linear_score(spark, d):
    f = table(spark, d, "part").select(
        F.col("p_partkey").alias("doc_id"), (F.col("p_size") / 50.0).alias("ngram_score"), (F.col("p_retailprice") / 2000.0).alias("semantic_score"),
        (F.col("p_size") % 2 == 0).cast("int").alias("exact_match"), (F.col("p_size") % 3 == 0).cast("int").alias("prefix_match"))
    return R.rank(f).select("doc_id", "rank_score")


@query("""WITH h AS (SELECT user_id, 'language' AS kind, event_type AS value FROM events UNION ALL SELECT user_id, 'repo', concat('r', event_id % 5) FROM events),
n AS (SELECT user_id, kind, value, count(*) AS c FROM h GROUP BY ALL) SELECT user_id, kind, value, round(0.1 * (c / sum(c) OVER (PARTITION BY user_id, kind)), 6) AS boost FROM n""")
def r10_personal(spark, d):
    h = table(spark, d, "events").select("user_id", F.col("event_type").alias("language"), F.concat(F.lit("r"), (F.col("event_id") % 5).cast("string")).alias("repo"))
    return R.preference_boost(h)


@query()
def r2_learn_to_rank(spark, d):
    f = table(spark, d, "part").select(
        F.col("p_partkey").alias("doc_id"), (F.col("p_size") / 50.0).alias("ngram_score"), (F.col("p_retailprice") / 2000.0).alias("semantic_score"),
        F.col("p_size").alias("file_length"), (F.col("p_size") > 25).cast("int").alias("relevance"))
    return R.rank(f, R.train_ranker(f, trees=10, depth=3))


# -- structure and intelligence -----------------------------------------------------------------


@query(r"""SELECT file_path, unnest(regexp_extract_all(content, '(?s)def (.+?)\((.+?)\):')) AS match FROM @code""")
def x2_structural(spark, d):
    return X.structural_search(code(spark, d), "def :[name](:[args]):").select("file_path", "match")


@query(r"""WITH l AS (SELECT file_path, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM @code)
SELECT file_path, line::INT AS line, regexp_extract(t, 'eval\((\w+)\)', 1) AS arg FROM l WHERE regexp_matches(t, 'eval\((\w+)\)')""")
def x3_match_lines(spark, d):
    m = X.structural_search(code(spark, d), "eval(:[arg:identifier])")
    return m.select("file_path", F.col("line").cast("int").alias("line"), F.element_at("captures", F.lit("arg")).alias("arg"))


LINES_SQL = "lines AS (SELECT file_path, language, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1)::INT AS line FROM @code)"
PY_KEYWORDS = ("'def', 'class', 'if', 'else', 'elif', 'for', 'while', 'try', 'except', 'finally', 'with', 'as', 'import', 'from', 'return', 'yield', 'raise', 'pass', "
               "'break', 'continue', 'and', 'or', 'not', 'in', 'is', 'lambda', 'True', 'False', 'None', 'async', 'await'")
JS_KEYWORDS = ("'function', 'class', 'if', 'else', 'for', 'while', 'do', 'switch', 'case', 'break', 'continue', 'return', 'try', 'catch', 'finally', 'throw', 'new', "
               "'delete', 'typeof', 'instanceof', 'void', 'this', 'super', 'const', 'let', 'var', 'true', 'false', 'null', 'undefined', 'async', 'await', 'import', 'export'")
JS_FUNCTION = r"(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:function|\([^)]*\)\s*=>))"
SYMBOLS_SQL = LINES_SQL + r""", raw AS (
  SELECT file_path, line, t, regexp_extract(t, '^\s*(?:async\s+)?def\s+(\w+)\s*\(', 1) AS name, 'function' AS kind, regexp_extract(t, '^\s*(?:async\s+)?def\s+(\w+)\s*\(') AS m FROM lines WHERE language = 'python'
  UNION ALL SELECT file_path, line, t, regexp_extract(t, '^\s*class\s+(\w+)\s*[:\(]', 1), 'class', regexp_extract(t, '^\s*class\s+(\w+)\s*[:\(]') FROM lines WHERE language = 'python'
  UNION ALL SELECT file_path, line, t, regexp_extract(t, '^\s*(\w+)\s*=\s*', 1), 'variable', regexp_extract(t, '^\s*(\w+)\s*=\s*') FROM lines WHERE language = 'python'
  UNION ALL SELECT file_path, line, t, concat(regexp_extract(t, '@js', 1), regexp_extract(t, '@js', 2)), 'function', regexp_extract(t, '@js') FROM lines WHERE language = 'javascript'
  UNION ALL SELECT file_path, line, t, regexp_extract(t, 'class\s+(\w+)', 1), 'class', regexp_extract(t, 'class\s+(\w+)') FROM lines WHERE language = 'javascript'
  UNION ALL SELECT file_path, line, t, regexp_extract(t, '(?:const|let|var)\s+(\w+)\s*=', 1), 'variable', regexp_extract(t, '(?:const|let|var)\s+(\w+)\s*=') FROM lines WHERE language = 'javascript'),
symbols AS (SELECT file_path, line, instr(t, m)::INT AS "column", (instr(t, m) + length(m))::INT AS end_column, name, kind, trim(t) AS signature FROM raw WHERE name <> '')""".replace("@js", JS_FUNCTION)
REFS_SQL = r"""found AS (SELECT file_path, language, line, regexp_extract_all(t, '\b[a-zA-Z_]\w*\b') AS m, string_split_regex(t, '\b[a-zA-Z_]\w*\b') AS g FROM lines),
words AS (SELECT file_path, language, line, m, g, unnest(m) AS name, generate_subscripts(m, 1) AS i FROM found),
refs AS (SELECT file_path, line, (length(array_to_string(g[1:i], '')) + length(array_to_string(m[1:i - 1], '')) + 1)::INT AS "column", name FROM words
  WHERE CASE WHEN language = 'javascript' THEN name NOT IN (@js) ELSE name NOT IN (@py) END)""".replace("@js", JS_KEYWORDS).replace("@py", PY_KEYWORDS)


@query(f"WITH {SYMBOLS_SQL} SELECT * FROM symbols")
def t6_symbols(spark, d):
    return X.symbols(code(spark, d))


@query(f"WITH {LINES_SQL}, {REFS_SQL} SELECT name, count(*) AS n, count(DISTINCT file_path) AS files, sum(\"column\")::BIGINT AS columns FROM refs GROUP BY 1")
def t7_references(spark, d):
    return X.references(code(spark, d)).groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("files"), F.sum("column").alias("columns"))


@query(f"""WITH {SYMBOLS_SQL}, {REFS_SQL}, r AS (SELECT DISTINCT file_path, line, name FROM refs), o AS (SELECT DISTINCT file_path, name FROM symbols)
SELECT r.file_path, r.line, r.name, s.file_path AS def_file, s.line AS def_line, s.kind FROM r JOIN symbols s ON s.name = r.name AND s.file_path = r.file_path
UNION ALL SELECT r.file_path, r.line, r.name, s.file_path, s.line, s.kind FROM r ANTI JOIN o USING (file_path, name) JOIN symbols s USING (name)""")
def t9_definitions(spark, d):
    files = code(spark, d, spread=True)
    refs = X.references(files).select("file_path", "line", "name").distinct()
    return X.go_to_definition(refs, X.symbols(files)).select("file_path", "line", "name", "def_file", "def_line", "kind")


@query(f"WITH {SYMBOLS_SQL}, {REFS_SQL} SELECT file_path, line, 'use' AS role FROM refs WHERE name = 'Item7' UNION ALL SELECT file_path, line, 'definition' FROM symbols WHERE name = 'Item7'")
def t10_references_of(spark, d):
    files = code(spark, d)
    return X.find_references("Item7", X.references(files), X.symbols(files))


@query(f"WITH {SYMBOLS_SQL} SELECT file_path, line, name, kind FROM symbols WHERE contains(lower(name), 'name') ORDER BY file_path, line, name, kind LIMIT 20")
def t11_symbol_search(spark, d):
    return X.search_symbols(X.symbols(code(spark, d)), "Name").select("file_path", "line", "name", "kind")


@query(f"WITH {SYMBOLS_SQL}, c AS (SELECT DISTINCT name, kind FROM symbols WHERE contains(lower(name), 'it')) SELECT name, kind FROM c ORDER BY NOT starts_with(lower(name), 'it'), length(name), name, kind LIMIT 20")
def t13_completions(spark, d):
    return X.completions(X.symbols(code(spark, d)), "it")


SCOPES_SQL = LINES_SQL + r""", full_ AS (SELECT file_path, line, t, length(t) - length(ltrim(t)) AS indent FROM lines WHERE trim(t) <> '' AND language = 'python'),
heads AS (SELECT file_path, line, indent, regexp_extract(t, '^\s*(?:async\s+)?def\s+(\w+)', 1) AS f, regexp_extract(t, '^\s*class\s+(\w+)', 1) AS c FROM full_),
scopes AS (SELECT h.file_path, CASE WHEN f <> '' THEN f ELSE c END AS name, CASE WHEN f <> '' THEN 'function' ELSE 'class' END AS kind, h.indent::INT AS indent, h.line,
  coalesce((SELECT min(x.line) - 1 FROM full_ x WHERE x.file_path = h.file_path AND x.line > h.line AND x.indent <= h.indent), (SELECT max(x.line) FROM full_ x WHERE x.file_path = h.file_path))::INT AS end_line
  FROM heads h WHERE f <> '' OR c <> '')"""


@query(f"WITH {SCOPES_SQL} SELECT file_path, name, kind, indent, line, end_line FROM scopes")
def t14_scopes(spark, d):
    return X.scopes(code(spark, d))


@query(f"""WITH {SCOPES_SQL}, p AS (SELECT file_path, line AS at_line FROM lines WHERE contains(t, 'eval(')),
m AS (SELECT p.file_path, p.at_line, s.name, s.kind, s.line, row_number() OVER (PARTITION BY p.file_path, p.at_line ORDER BY s.line DESC, s.indent DESC) AS n FROM p JOIN scopes s ON s.file_path = p.file_path AND p.at_line BETWEEN s.line AND s.end_line)
SELECT file_path, at_line, name, kind, line FROM m WHERE n = 1""")
def t16_enclosing(spark, d):
    files = code(spark, d)
    points = X.code_lines(files).filter(F.contains("text", F.lit("eval("))).select("file_path", F.col("line").alias("at_line"))
    return X.enclosing(points, X.scopes(files))


# -- analysis -------------------------------------------------------------------------------------


def _count_sql(patterns):
    return " + ".join(f"len(regexp_extract_all(content, '{p}'))" for p in patterns)


@query(r"""SELECT file_path, language, doc_id, repo, """ + f"""
 (1 + CASE WHEN language = 'javascript' THEN {_count_sql(A.BRANCHES['javascript'])} ELSE {_count_sql(A.BRANCHES['python'])} END)::INT AS cyclomatic,""" + r"""
 len([x for x in string_split(content, chr(10)) if trim(x) <> '' AND NOT starts_with(trim(x), '#')])::INT AS loc,
 len([x for x in string_split(content, chr(10)) if starts_with(trim(x), '#')])::INT AS comment_lines,
 coalesce(list_max([((length(x) - length(ltrim(x))) // 4)::INT for x in string_split(content, chr(10)) if trim(x) <> '']), 0)::INT AS max_nesting,
 len(regexp_extract_all(content, '\bdef\s+\w+|\bfunction\s+\w+'))::INT AS functions, len(regexp_extract_all(content, '\bclass\s+\w+'))::INT AS classes
 FROM @code""")
def a2_metrics(spark, d):
    return A.metrics(code(spark, d)).drop("cognitive", "avg_function_length")


@query()
def a3_cognitive(spark, d):
    return code(spark, d).select("file_path", A.cognitive(F.col("content")).alias("cognitive"))


def _rules_sql(lang):
    return " UNION ALL ".join("SELECT file_path, line, '{}' AS rule_id, '{}' AS severity FROM lines WHERE language = '{}' AND regexp_matches(t, '(?i){}')".format(r, s, lang, p.replace("'", "''")) for r, p, s in A.RULES[lang])


ISSUES_SQL = f"{LINES_SQL}, issues AS ({_rules_sql('python')} UNION ALL {_rules_sql('javascript')})"


@query(f"WITH {ISSUES_SQL} SELECT file_path, line, rule_id, severity FROM issues")
def a6_security(spark, d):
    return A.security_issues(code(spark, d))


@query(f"WITH {LINES_SQL} SELECT file_path, line, 'long_line' AS rule_id FROM lines WHERE length(t) > 120 UNION ALL SELECT file_path, line, 'trailing_whitespace' FROM lines WHERE regexp_matches(t, '[ \\t\\r]+$')".replace("\\\\", "\\"))
def a7_style(spark, d):
    return A.style_issues(code(spark, d))


@query(f"WITH {ISSUES_SQL} SELECT severity, count(*) AS n FROM issues GROUP BY 1")
def a9_severities(spark, d):
    return A.security_issues(code(spark, d)).groupBy("severity").agg(F.count("*").alias("n"))


SCORES_SQL = ISSUES_SQL + r""", sec AS (SELECT file_path, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning FROM issues GROUP BY 1),
sty AS (SELECT file_path, sum((length(t) > 120)::INT + regexp_matches(t, '[ \t\r]+$')::INT)::BIGINT AS style FROM lines GROUP BY 1),
m AS (SELECT file_path, 1 + CASE WHEN language = 'javascript' THEN len(regexp_extract_all(content, '\b(?:if|else|for|while|do|try|catch|switch|case)\b|&&|\|\||\?'))
    ELSE len(regexp_extract_all(content, '\b(?:if|elif|else|for|while|and|or|try|except|with)\b')) END AS cyclomatic,
  coalesce(list_max([(length(x) - length(ltrim(x))) // 4 for x in string_split(content, chr(10)) if trim(x) <> '']), 0) AS nesting FROM @code),
j AS (SELECT m.*, coalesce(critical, 0)::BIGINT AS critical, coalesce(error, 0)::BIGINT AS error, coalesce(warning, 0)::BIGINT AS warning, coalesce(style, 0)::BIGINT AS style FROM m LEFT JOIN sec USING (file_path) LEFT JOIN sty USING (file_path)),
k AS (SELECT *, greatest(0, 100 - greatest(0, least(30, (cyclomatic - 10) * 3)) - greatest(0, least(20, (nesting - 4) * 5)) - 2 * style)::DOUBLE AS maintainability, 100::DOUBLE AS reliability,
  greatest(0, 100 - 25 * critical - 15 * error - 5 * warning)::DOUBLE AS security FROM j),
scores AS (SELECT *, round((maintainability + reliability + security) / 3, 6) AS overall FROM k),
graded AS (SELECT file_path, critical, error, warning, style, maintainability, reliability, security, overall,
  CASE WHEN overall >= 90 THEN 'A' WHEN overall >= 80 THEN 'B' WHEN overall >= 70 THEN 'C' WHEN overall >= 60 THEN 'D' ELSE 'F' END AS grade FROM scores)"""


@query(f"WITH {SCORES_SQL} SELECT * FROM graded")
def a8_quality(spark, d):
    return A.quality_scores(code(spark, d))


@query(f"""WITH {SCORES_SQL}, every AS (SELECT file_path, line, rule_id FROM issues UNION ALL SELECT file_path, line, 'STYLE001' FROM lines WHERE length(t) > 120
  UNION ALL SELECT file_path, line, 'STYLE002' FROM lines WHERE regexp_matches(t, '[ \t\r]+$')),
listed AS (SELECT file_path, string_agg(concat(line, ':', rule_id), ',' ORDER BY line, rule_id) AS issues FROM every GROUP BY 1)
SELECT file_path, coalesce(issues, '') AS issues, cyclomatic::INT AS cyclomatic, overall, grade FROM graded JOIN m USING (file_path) LEFT JOIN listed USING (file_path)""")
def a10_file_reports(spark, d):
    issues = F.array_join(F.transform("issues", lambda x: F.concat(x["line"].cast("string"), F.lit(":"), x["rule_id"])), ",")
    return A.file_reports(code(spark, d)).select("file_path", issues.alias("issues"), "complexity.cyclomatic", "score.overall", "score.grade")


@query(r"""WITH l AS (SELECT file_path, [regexp_replace(trim(x), '\b\w+\b', 'VAR', 'g') for x in string_split(content, chr(10)) if trim(x) <> '' AND NOT starts_with(trim(x), '#') AND NOT starts_with(trim(x), '//')] AS v FROM @code),
s AS (SELECT file_path, list_sort(list_distinct([array_to_string(v[i:i+2], chr(10)) for i in range(1, len(v) - 1)])) AS s FROM l),
g AS (SELECT s, min(file_path) AS rep FROM s WHERE len(s) > 0 GROUP BY 1),
i AS (SELECT rep AS file_a, file_path AS file_b, 1.0::DOUBLE AS similarity FROM s JOIN g USING (s) WHERE file_path <> rep),
x AS (SELECT a.rep AS file_a, b.rep AS file_b, round(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 6) AS similarity FROM g a JOIN g b ON a.rep < b.rep)
SELECT * FROM i UNION ALL SELECT * FROM x WHERE similarity >= 0.8""")
def a11_duplicates(spark, d):
    return A.duplicate_pairs(code(spark, d))


_OPS = ", ".join(f"'{x}'" for x in A.OPERATORS + A.KEYWORDS)


@query(r"""WITH t AS (SELECT file_path, regexp_extract_all(content, '[a-zA-Z_]\w*|[+\-*/%=<>!&|^~]+|[.,;:()\[\]{}]') AS t FROM @code),
n AS (SELECT file_path, [x for x in t if list_contains([""" + _OPS + r"""], x)] AS o, [x for x in t if NOT list_contains([""" + _OPS + r"""], x)] AS r FROM t),
c AS (SELECT file_path, len(list_distinct(o)) AS n1, len(list_distinct(r)) AS n2, len(o) AS b1, len(r) AS b2 FROM n),
h AS (SELECT file_path, (n1 + n2)::INT AS vocabulary, (b1 + b2)::INT AS length, (b1 + b2) * log2(n1 + n2) AS v, n1 / 2.0 * b2 / n2 AS f FROM c)
SELECT file_path, vocabulary, length, round(v, 4) AS volume, round(f, 4) AS difficulty, round(v * f, 3) AS effort FROM h""")
def a12_halstead(spark, d):
    return A.halstead(code(spark, d))


@query("""SELECT p_partkey, round(greatest(0, least(100, (171 - 5.2 * ln(p_retailprice) - 0.23 * p_size - 16.2 * ln(p_size)) * 100 / 171)), 6) AS mi FROM part""")
def a13_maintainability(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(A.maintainability(F.col("p_retailprice"), F.col("p_size"), F.col("p_size")), 6).alias("mi"))


@query("""SELECT concat('f', user_id % 50) AS file_path, count(*) AS changes, round(sum(event_id % 40 + event_id % 90)::DOUBLE / count(*), 6) AS churn FROM events GROUP BY 1 HAVING round(sum(event_id % 40 + event_id % 90)::DOUBLE / count(*), 6) > 50""")
def a14_churn(spark, d):
    log = table(spark, d, "events").select(F.concat(F.lit("f"), (F.col("user_id") % 50).cast("string")).alias("file_path"), (F.col("event_id") % 40).alias("added"), (F.col("event_id") % 90).alias("deleted"))
    return A.churn(log)


IMPORTS_SQL = LINES_SQL + r""", imports AS (
  SELECT file_path, line, regexp_extract(unnest(string_split_regex(regexp_extract(trim(t), '^import\s+(.+)$', 1), '\s*,\s*')), '^(\S+)', 1) AS module, '' AS names FROM lines WHERE language = 'python' AND regexp_matches(trim(t), '^import\s+(.+)$')
  UNION ALL SELECT file_path, line, regexp_extract(trim(t), '^from\s+(\S+)\s+import\s+.+$', 1), regexp_extract(trim(t), '^from\s+\S+\s+import\s+(.+)$', 1) FROM lines WHERE language = 'python' AND regexp_matches(trim(t), '^from\s+(\S+)\s+import\s+.+$'))"""
EDGES_SQL = IMPORTS_SQL + r""", edges AS (SELECT DISTINCT i.file_path AS src, f.file_path AS dst, i.module FROM imports i JOIN @code f
  ON replace(regexp_replace(replace(f.file_path, 'src/', ''), '\.[^./]+$', ''), '/', '.') = i.module WHERE i.file_path <> f.file_path)"""


def _imports(spark, d):
    return D.python_imports(code(spark, d).filter("language = 'python'"))


def _edges(spark, d):
    return D.resolve(_imports(spark, d), code(spark, d))


@query(f"WITH {IMPORTS_SQL} SELECT file_path, line, module, names, starts_with(module, '.') AS is_relative FROM imports")
def a15_imports(spark, d):
    return _imports(spark, d)


@query(r"""SELECT file_path, line, module, starts_with(module, '.') AS is_relative FROM (SELECT file_path, line, regexp_extract(t, 'import\s+(?:\{[^}]*\})\s+from\s+[''"]([^''"]+)[''"]', 1) AS module FROM
 (SELECT file_path, language, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1)::INT AS line FROM @code) WHERE language = 'javascript') WHERE module <> ''""")
def a15_js_imports(spark, d):
    return D.js_imports(code(spark, d).filter("language = 'javascript'")).drop("names")


@query(f"WITH {EDGES_SQL} SELECT src, dst, module FROM edges")
def a17_resolve(spark, d):
    return _edges(spark, d)


@query(f"""WITH RECURSIVE {EDGES_SQL}, leaves AS (SELECT DISTINCT dst FROM edges WHERE dst NOT IN (SELECT src FROM edges)),
walk(path, node) AS (SELECT [src, dst], dst FROM edges WHERE src = 'src/pkg/mod1500.py' UNION ALL SELECT list_append(path, e.dst), e.dst FROM walk JOIN edges e ON e.src = node WHERE NOT list_contains(path, e.dst))
SELECT path FROM walk WHERE node IN (SELECT dst FROM leaves)""")
def a19_chains(spark, d):
    return D.import_chains(_edges(spark, d), "src/pkg/mod1500.py")


@query(f"""WITH RECURSIVE {EDGES_SQL}, walk(start, node, path, closed) AS (SELECT src, dst, [src], dst = src FROM edges WHERE dst >= src
 UNION ALL SELECT w.start, e.dst, list_append(w.path, w.node), e.dst = w.start FROM walk w JOIN edges e ON e.src = w.node WHERE NOT w.closed AND e.dst >= w.start AND NOT list_contains(w.path, w.node) AND len(w.path) < 12)
SELECT path, len(path)::INT AS length FROM walk WHERE closed""")
def a20_cycles(spark, d):
    return D.cycles(spark, _edges(spark, d))


@query(f"WITH {EDGES_SQL} SELECT dst, count(DISTINCT src) AS importers FROM edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def a21_most_imported(spark, d):
    return D.most_imported(_edges(spark, d))


@query(f"WITH {EDGES_SQL} SELECT (SELECT count(*) FROM part) AS nodes, count(*) AS edges, count(DISTINCT src) AS importing, count(DISTINCT dst) AS imported FROM edges")
def a22_graph_stats(spark, d):
    return D.graph_stats(code(spark, d), _edges(spark, d))


@query(f"WITH {IMPORTS_SQL} SELECT module, list_sort(list_distinct(list(repo))) AS repos FROM imports JOIN @code c USING (file_path) GROUP BY 1 HAVING count(DISTINCT repo) > 1")
def a23_shared(spark, d):
    return D.shared_dependencies(_imports(spark, d).join(code(spark, d).select("file_path", "repo"), "file_path"), "repo")


@query(f"WITH {IMPORTS_SQL} SELECT file_path, list_sort(list_distinct(list(module))) AS modules FROM imports WHERE NOT starts_with(module, '.') GROUP BY 1 HAVING count(DISTINCT module) >= 3")
def a24_patterns(spark, d):
    return D.import_patterns(_imports(spark, d))


# -- similarity --------------------------------------------------------------------------------------


@query("SELECT doc_id, (concat('0x', substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 8)::INT AS shard FROM documents")
def s1_hash_shard(spark, d):
    return table(spark, d, "documents").select("doc_id", S.hash_shard(F.col("doc_id"), 8).alias("shard"))


@query("""WITH ring AS (SELECT md5(concat('shard-', s, '-', v)) AS node, s AS shard FROM range(8) t(s), range(150) u(v)),
k AS (SELECT doc_id, md5(doc_id::VARCHAR) AS h FROM documents)
SELECT doc_id, coalesce(shard, (SELECT arg_min(shard, node) FROM ring))::INT AS shard FROM k ASOF LEFT JOIN ring ON node >= h""")
def s2_ring(spark, d):
    return S.ring_shard(table(spark, d, "documents").select("doc_id"), "doc_id", 8)


def _repo_words(spark, d):
    # no word crosses a line, and files repeat lines: each line of a repository is parted once
    lines = code(spark, d, spread=True).select("repo", F.explode(F.split("content", "\n")).alias("line")).distinct()
    return lines.select("repo", F.explode(T.code_words(F.col("line"))).alias("shingle"))


def _repo_shingles(spark, d):
    return _repo_words(spark, d).distinct()


HASH_SQL = "concat('0x', substr(h, 7, 2), substr(h, 5, 2), substr(h, 3, 2), substr(h, 1, 2))::BIGINT"
SIGN_SQL = f"""sh AS (SELECT DISTINCT repo, unnest({WORDS_SQL}) AS s FROM @code), hs AS (SELECT repo, i, min({HASH_SQL}) AS m FROM (SELECT repo, i, sha256(concat(i, ':', s)) AS h FROM sh, range(16) t(i)) GROUP BY 1, 2),
sig AS (SELECT repo, list(m ORDER BY i) AS signature FROM hs GROUP BY 1)"""


@query(f"WITH {SIGN_SQL} SELECT repo, signature FROM sig")
def s6_minhash(spark, d):
    return S.minhash(_repo_words(spark, d), "repo", 16)


@query(f"""WITH {SIGN_SQL} SELECT a.repo AS a, b.repo AS b, len([i for i in range(1, 17) if a.signature[i] = b.signature[i]]) / 16.0 AS similarity FROM sig a JOIN sig b ON a.repo < b.repo AND a.signature <> b.signature WHERE len([i for i in range(1, 17) if a.signature[i] = b.signature[i]]) >= 4""")
def s7_estimate(spark, d):
    # its SQL leaves out pairs of equal signatures
    return S.similarity_edges(S.minhash(_repo_words(spark, d), "repo", 16), "repo", 0.25, copies=False)


@query(f"""WITH sh AS (SELECT DISTINCT repo, unnest({WORDS_SQL}) AS s FROM @code), n AS (SELECT repo, count(*) AS n FROM sh GROUP BY 1),
i AS (SELECT a.repo AS a, b.repo AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.repo < b.repo GROUP BY 1, 2)
SELECT a, b, round(c / (x.n + y.n - c), 6) AS similarity FROM i JOIN n x ON x.repo = a JOIN n y ON y.repo = b WHERE round(c / (x.n + y.n - c), 6) >= 0.1""")
def s8_similarity_graph(spark, d):
    return S.jaccard_edges(_repo_shingles(spark, d), "repo", 0.1)


@query(f"""WITH {SIGN_SQL}, g AS (SELECT signature, min(repo) AS repo FROM sig GROUP BY 1), b AS (SELECT repo, i, signature[2*i+1:2*i+2] AS p FROM g, range(8) t(i))
SELECT DISTINCT x.repo AS a, y.repo AS b FROM b x JOIN b y ON x.i = y.i AND x.p = y.p AND x.repo < y.repo""")
def s9_lsh(spark, d):
    return S.lsh_candidates(S.minhash(_repo_words(spark, d), "repo", 16), "repo", 8)


@query()
def s10_spanning_tree(spark, d):
    return S.spanning_tree(S.tree_edges(_repo_shingles(spark, d), "repo", 0.05), code(spark, d).select("repo"))


# -- monitors and logs ----------------------------------------------------------------------------------


MONITOR_SQL = r"""SELECT rule_id, severity, file_path, unnest(regexp_extract_all(content, p)) AS text FROM (
  SELECT 'sec-001' AS rule_id, 'critical' AS severity, file_path, content, '(?i)(?:password|api_key|secret|token)\s*=\s*[''"][^''"]+[''"]' AS p FROM @code
  UNION ALL SELECT 'sec-002', 'error', file_path, content, '(?i)\beval\s*\(' FROM @code
  UNION ALL SELECT 'sec-003', 'error', file_path, content, '(?i)execute\([^)]*%s|execute\([^)]*\+|cursor\.execute\([^)]*f[''"]' FROM @code
  UNION ALL SELECT 'dep-001', 'warning', file_path, content, '(?i)@deprecated|# deprecated|DEPRECATED' FROM @code
  UNION ALL SELECT 'qual-001', 'info', file_path, content, '(?i)(?:TODO|FIXME|HACK|XXX):' FROM @code)"""


@query(f"SELECT rule_id, severity, file_path, substr(text, 1, 100) AS text FROM ({MONITOR_SQL})")
def k2_scan(spark, d):
    return K.scan(code(spark, d)).select("rule_id", "severity", "file_path", "text")


@query(f"SELECT rule_id, file_path, count(*) AS matches FROM ({MONITOR_SQL}) GROUP BY 1, 2 HAVING count(*) > 1")
def k3_threshold(spark, d):
    return K.threshold_alerts(K.scan(code(spark, d)), 1)


#: Rules that are off, of one language, of some paths, and with a threshold.
RULES = [K.Rule("returns", r"return \w+", "info", language="python"), K.Rule("first", r"class\s+\w+", "warning", file_pattern=r"src/pkg/mod1"),
         K.Rule("off", r"def", "error", enabled=False), K.Rule("many", r"\bself\b", "error", trigger="threshold", threshold=1)]


@query(r"""SELECT 'returns' AS rule_id, 'info' AS severity, file_path, unnest(regexp_extract_all(content, '(?i)return \w+')) AS text FROM @code WHERE language = 'python'
UNION ALL SELECT 'first', 'warning', file_path, unnest(regexp_extract_all(content, '(?i)class\s+\w+')) FROM @code WHERE starts_with(file_path, 'src/pkg/mod1')""")
def k2_filtered_rules(spark, d):
    return K.scan(code(spark, d), RULES).select("rule_id", "severity", "file_path", "text")


@query(r"""SELECT 'many' AS rule_id, 'error' AS severity, file_path, 0 AS line, concat(n, ' matches found') AS text
FROM (SELECT file_path, len(regexp_extract_all(content, '(?i)\bself\b')) AS n FROM @code) WHERE n > 1""")
def k3_threshold_rules(spark, d):
    return K.threshold_scan(code(spark, d), RULES)


@query(r"""WITH l AS (SELECT file_path, doc_id, regexp_extract_all(content, '(?i)class\s+\w+') AS a FROM @code WHERE starts_with(file_path, 'src/pkg/mod1')),
m AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN [] WHEN doc_id % 3 = 1 THEN [concat(a[1], '_v2')] ELSE a END AS b FROM l),
i AS (SELECT *, unnest(range(1, greatest(len(a), len(b)) + 1)) AS n FROM m)
SELECT 'first' AS rule_id, 'warning' AS severity, file_path, n::INT AS nth, CASE WHEN b[n] IS NULL THEN 'removed' ELSE 'modified' END AS change, a[n] AS old_text, b[n] AS new_text
FROM i WHERE a[n] IS DISTINCT FROM b[n]""")
def k4_changed_matches(spark, d):
    old = code(spark, d)
    new = old.withColumn("content", F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("content", "class", "klass")).when(
        F.col("doc_id") % 3 == 1, F.regexp_replace("content", r"(class\s+\w+)", "$1_v2")).otherwise(F.col("content")))
    return K.changed_matches(old, new, RULES[1:2])


@query(f"""WITH m AS (SELECT file_path, rule_id, severity FROM ({MONITOR_SQL}))
SELECT severity, count(*) AS alerts, count(*) FILTER (severity = 'critical') AS acknowledged, count(*) FILTER (rule_id = 'sec-002') AS resolved FROM m GROUP BY 1""")
def k6_marks(spark, d):
    alerts = K.scan(code(spark, d))
    marks = alerts.select("rule_id", "match_hash", F.explode(F.array(
        F.when(F.col("severity") == "critical", "acknowledge"), F.when(F.col("rule_id") == "sec-002", "resolve"))).alias("mark")).filter("mark is not null")
    return K.with_state(alerts, marks).groupBy("severity").agg(
        F.count("*").alias("alerts"), F.count_if("acknowledged").alias("acknowledged"), F.count_if("resolved").alias("resolved"))


@query(f"WITH m AS ({MONITOR_SQL}) SELECT s AS severity, (SELECT count(*) FROM m WHERE severity = s) AS alerts FROM (VALUES ('info'), ('warning'), ('error'), ('critical')) v(s)")
def k6_severities(spark, d):
    return K.severity_counts(K.scan(code(spark, d)))


@query("""WITH e AS (SELECT user_id AS doc_id, event_type AS content, CASE WHEN event_type = 'purchase' THEN 'delete' ELSE 'index' END AS action, event_id AS o FROM events),
l AS (SELECT doc_id, arg_max(content, o) AS content, arg_max(action, o) AS action FROM e GROUP BY 1)
SELECT doc_id, content FROM l WHERE action <> 'delete' UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT doc_id FROM l)""")
def k15_apply_events(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("content"), F.expr("case when event_type = 'purchase' then 'delete' else 'index' end").alias("action"), F.col("event_id").alias("offset"))
    state = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("content"))
    return K.apply_events(state, e)


def _log(spark, d):
    return table(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("session"), F.col("event_type").alias("key"))


@query("SELECT concat(user_id, '/', event_type) AS key, count(*) AS hits FROM events GROUP BY 1 HAVING count(*) >= 5")
def k19_popular(spark, d):
    return K.popular_keys(_log(spark, d).withColumn("key", F.concat_ws("/", F.col("session").cast("string"), "key")))


@query("""WITH n AS (SELECT event_type AS key, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_key FROM events), s AS (SELECT * FROM n WHERE next_key IS NOT NULL AND key <> next_key)
SELECT key, next_key, count(*) AS times FROM (SELECT key, next_key FROM s UNION ALL SELECT next_key, key FROM s) GROUP BY 1, 2""")
def k20_co_access(spark, d):
    return K.co_access(_log(spark, d))


@query("""SELECT coalesce(user_id % 4, -1) AS shard, count(*) AS messages, round(sum(value), 2) AS total FROM events GROUP BY GROUPING SETS ((user_id % 4), ())""")
def k22_shard_stats(spark, d):
    e = table(spark, d, "events").withColumn("shard", F.col("user_id") % 4)
    return e.rollup("shard").agg(F.count("*").alias("messages"), F.round(F.sum("value"), 2).alias("total")).select(F.coalesce("shard", F.lit(-1)).alias("shard"), "messages", "total")


# -- more of each group ------------------------------------------------------------------------------------


#: Files of nine languages (under their names and aliases); ``@`` is a number.
SNIPPETS = [
    ("python", """# adds\n# two\ndef add@(a, b):\n    return a\n\nclass Box@(Base):\n    pass\n\nlimit@: int = 3\nimport os@\nasync def go@(z): pass\ndef z(): pass\n"""),
    ("js", """import { a, b } from './m@';\n/**\n * Says hi\n */\nasync function hello@(x) { return x; }\nconst arrow@ = async (y) => y;\nclass Foo@ extends Bar { }\n"""),
    ("TS", """interface Shape@<T> extends A, B {\n}\ntype Id@ = string;\nfunction idOf@<T>(x: T) { }\nclass Kind@ implements Shape {\n}\nconst num@: number = 3;\n"""),
    ("java", """// a class\npublic class Main@ {\n  private static int count@ = 0;\n  public static void run@(String[] args) { return; }\n}\ninterface Run@ { }\n"""),
    ("go", """package m\n// Gets it\nfunc (s *S) Get@(k int) error {\n}\ntype S@ struct {\n}\nvar total@ int = 3\n"""),
    ("rs", """pub async fn run@<T>(x: T) {}\npub struct Pt@ { }\ntrait Shape@ { }\nenum Color@ { }\nlet mut n@: i32 = 3;\n"""),
    ("rb", """# greets\ndef self.greet@!\nend\nclass Dog@\nmodule Zoo@\n"""),
    ("hpp", """int add@(int a, int b) const {\n return a;}\nstruct P@ : public Q {\n};\nint total@ = 0;\n"""),
    ("cs", """public class Task@ {\n public int Size@ { get; set; }\n public static async Task Run@(int x) { }\n internal interface IRun@ { }\n}\n"""),
    ("cobol", """def none@(x):\n"""),
]


def polyglot(spark: SparkSession, d: str) -> DataFrame:
    number = (F.col("p_size") + 10).cast("string")
    text = F.element_at(F.array(*[F.lit(x) for _, x in SNIPPETS]), (F.col("p_partkey") % len(SNIPPETS) + 1).cast("int"))
    lang = F.element_at(F.array(*[F.lit(x) for x, _ in SNIPPETS]), (F.col("p_partkey") % len(SNIPPETS) + 1).cast("int"))
    return table(spark, d, "part").select(F.concat(F.lit("f"), "p_partkey").alias("file_path"), lang.alias("language"), F.replace(text, F.lit("@"), number).alias("content"))


#: What the snippets declare: place in the list, name, kind, line, last line, signature, comment.
DECLARED_SQL = """(VALUES
  (0, 'add@', 'function', 3, 3, 'def add@(a, b)', concat('adds', chr(10), 'two')),
  (0, 'go@', 'function', 11, 11, 'async def go@(z)', NULL),
  (0, 'Box@', 'class', 6, 6, NULL, NULL),
  (0, 'limit@', 'variable', 9, 9, NULL, NULL),
  (0, concat('os@', chr(10), 'async def go@'), 'import', 10, 11, NULL, NULL),
  (1, 'hello@', 'function', 5, 5, 'async function hello@(x)', concat('Says hi', chr(10), '/')),
  (1, 'arrow@', 'function', 6, 6, 'const arrow@ = async (y) => y; class Foo@ extends Bar', NULL),
  (1, 'Foo@', 'class', 7, 7, NULL, NULL),
  (1, 'arrow@', 'variable', 6, 6, NULL, NULL),
  (1, './m@', 'import', 1, 1, NULL, NULL),
  (2, 'idOf@', 'function', 4, 4, 'function idOf@<T>(x: T)', NULL),
  (2, 'Kind@', 'class', 5, 5, NULL, NULL),
  (2, 'Shape@', 'interface', 1, 1, NULL, NULL),
  (2, 'Id@', 'type', 3, 3, NULL, NULL),
  (2, 'num@', 'variable', 7, 7, NULL, NULL),
  (3, 'run@', 'function', 4, 4, 'public static void run@(String[] args)', NULL),
  (3, 'Main@', 'class', 2, 2, NULL, 'a class'),
  (3, 'Run@', 'interface', 6, 6, NULL, NULL),
  (3, 'count@', 'variable', 3, 3, NULL, NULL),
  (4, 'Get@', 'function', 3, 3, 'func (s *S) Get@(k int) error', 'Gets it'),
  (4, 'S@', 'type', 5, 5, NULL, NULL),
  (4, 'total@', 'variable', 7, 7, NULL, NULL),
  (5, 'run@', 'function', 1, 1, 'pub async fn run@<T>(x: T)', NULL),
  (5, 'Pt@', 'class', 2, 2, NULL, NULL),
  (5, 'Shape@', 'interface', 3, 3, NULL, NULL),
  (5, 'Color@', 'enum', 4, 4, NULL, NULL),
  (5, 'n@', 'variable', 5, 5, NULL, NULL),
  (6, 'greet@!', 'function', 2, 2, 'def self.greet@! end class Dog@ module Zoo@', 'greets'),
  (6, 'Dog@', 'class', 4, 4, NULL, NULL),
  (6, 'Zoo@', 'module', 5, 5, NULL, NULL),
  (7, 'add@', 'function', 1, 1, 'int add@(int a, int b) const { return a;} struct P@ : public Q', NULL),
  (7, 'P@', 'class', 3, 3, NULL, NULL),
  (7, 'total@', 'variable', 5, 5, NULL, NULL),
  (8, 'Run@', 'function', 3, 3, 'public static async Task Run@(int x)', NULL),
  (8, 'Task@', 'class', 1, 1, NULL, NULL),
  (8, 'IRun@', 'interface', 4, 4, NULL, NULL),
  (8, 'Size@', 'property', 2, 2, NULL, NULL)) v(i, name, kind, line, end_line, signature, documentation)"""
POLYGLOT_SQL = DECLARED_SQL + " JOIN part ON p_partkey % 10 = i"


@query(f"""SELECT concat('f', p_partkey) AS file_path, replace(name, '@', (p_size + 10)::VARCHAR) AS name, kind, line, end_line, replace(signature, '@', (p_size + 10)::VARCHAR) AS signature,
  documentation FROM {POLYGLOT_SQL}""")
def t1_extract_symbols(spark, d):
    return X.extract_symbols(polyglot(spark, d))


@query(r"""WITH l AS (SELECT file_path, language, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1)::INT AS line FROM @code)
SELECT file_path, line, regexp_extract(t, '^def (\w+)\(', 1) AS name, regexp_extract(t, '^def \w+\([^)]*\)') AS signature FROM l WHERE language = 'python' AND regexp_matches(t, '^def (\w+)\([^)]*\):')
UNION ALL SELECT file_path, line, regexp_extract(t, 'function (\w+)\(', 1), regexp_extract(t, 'function \w+\([^)]*\)') FROM l WHERE language = 'javascript' AND regexp_matches(t, 'function (\w+)\([^)]*\)')""")
def t2_signatures(spark, d):
    return X.signatures(code(spark, d))


@query(f"SELECT concat('f', p_partkey) AS file_path, line, replace(name, '@', (p_size + 10)::VARCHAR) AS name, kind, documentation AS comment FROM {POLYGLOT_SQL} WHERE documentation IS NOT NULL")
def t3_doc_comments(spark, d):
    return X.doc_comments(polyglot(spark, d))


@query(f"""WITH {SYMBOLS_SQL}, h AS (SELECT *, row_number() OVER (PARTITION BY file_path, line ORDER BY CASE kind WHEN 'function' THEN 1 WHEN 'class' THEN 2 ELSE 3 END) AS n FROM symbols WHERE 9 BETWEEN "column" AND end_column)
SELECT file_path, line, 9 AS at_column, name, kind, signature, concat('**', kind, '** `', name, '`', chr(10), chr(10), signature) AS contents FROM h WHERE n = 1""")
def t12_hover(spark, d):
    files = code(spark, d, spread=True)
    points = X.code_lines(files).select("file_path", "line", F.lit(9).alias("at_column"))
    return X.hover(points, X.symbols(files))


ASSIGNED_SQL = SCOPES_SQL + r""", vars AS (SELECT file_path, line, regexp_extract(t, '^\s*(\w+)\s*=\s*', 1) AS variable FROM lines WHERE language = 'python' AND regexp_matches(t, '^\s*(\w+)\s*=\s*')),
placed AS (SELECT v.file_path, v.line, v.variable, s.name, s.line AS scope_line, row_number() OVER (PARTITION BY v.file_path, v.line ORDER BY s.line DESC) AS n
  FROM vars v LEFT JOIN scopes s ON s.file_path = v.file_path AND v.line BETWEEN s.line AND s.end_line),
assigned AS (SELECT file_path, coalesce(name, '') AS scope, coalesce(scope_line, 0)::INT AS scope_line, variable, max(line)::INT AS line FROM placed WHERE n = 1 GROUP BY ALL)"""


@query(f"WITH {ASSIGNED_SQL} SELECT * FROM assigned")
def t15_assignments(spark, d):
    return X.assignments(code(spark, d))


@query(f"""WITH {ASSIGNED_SQL}, p AS (SELECT file_path, line AS at_line FROM lines WHERE contains(t, 'return'))
SELECT a.file_path, p.at_line, a.variable, a.scope, a.scope_line, a.line FROM p JOIN assigned a USING (file_path) LEFT JOIN scopes s ON s.file_path = a.file_path AND s.line = a.scope_line
WHERE a.scope_line = 0 OR p.at_line BETWEEN s.line AND s.end_line""")
def t16_visible(spark, d):
    files = code(spark, d)
    points = X.code_lines(files).filter(F.contains("text", F.lit("return"))).select("file_path", F.col("line").alias("at_line"))
    return X.visible_symbols(points, files)


@query(r"""SELECT file_path, unnest(regexp_extract_all(content, '(?s)for (.+?) in range\((\d+(?:\.\d+)?)\)')) AS match FROM @code WHERE language = 'python' AND contains(lower(content), 'todo')""")
def q11_combined_search(spark, d):
    return X.combined_search(code(spark, d), 'struct:"for :[x] in range(:[n:number])" lang:python file:src/*.py todo').select("file_path", "match")


@query("SELECT vec_id, round(CASE WHEN vec_id % 2 = 0 THEN array_cosine_similarity(embedding::DOUBLE[64], list_reverse(embedding)::DOUBLE[64]) ELSE 1 END, 6) AS score FROM embeddings")
def v2_cosine(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(F.when(F.col("vec_id") % 2 == 0, R.cosine(e, F.reverse(e))).otherwise(R.cosine(e, e)), 6).alias("score"))


@query("SELECT p_partkey, concat('0x', substr(h, 7, 2), substr(h, 5, 2), substr(h, 3, 2), substr(h, 1, 2))::BIGINT AS h FROM (SELECT p_partkey, sha256(concat('42:', p_name)) AS h FROM part)")
def s5_seeded_hash(spark, d):
    return table(spark, d, "part").select("p_partkey", S.seeded_hash(F.col("p_name"), F.lit(42)).alias("h"))


@query("SELECT (concat('0x', substr(md5(user_id::VARCHAR), 1, 8))::BIGINT % 4)::INT AS partition, count(*) AS messages, max(event_id) AS end_offset FROM events GROUP BY 1")
def k9_topic_counts(spark, d):
    return table(spark, d, "events").groupBy(S.hash_shard(F.col("user_id"), 4).alias("partition")).agg(F.count("*").alias("messages"), F.max("event_id").alias("end_offset"))


@query("SELECT (user_id % 4) AS partition, max(event_id) - coalesce(max(CASE WHEN user_id % 4 < 3 AND event_id % 7 = 0 THEN event_id END), 0) AS lag FROM events GROUP BY 1")
def k13_lag(spark, d):
    from gleaner.streaming.jobs import lag

    e = table(spark, d, "events").withColumn("partition", F.col("user_id") % 4)
    return lag(e.groupBy("partition").agg(F.max("event_id").alias("end_offset")), e.filter("partition < 3 and event_id % 7 = 0").groupBy("partition").agg(F.max("event_id").alias("offset")))


@query(r"""SELECT doc_id, regexp_extract_all(t, '(?s)```\w*\n(.*?)```', 1) AS blocks, regexp_extract_all(t, '(?m)^\s*\d+[.)]\s+(.+)$', 1) AS items
FROM (SELECT doc_id, concat('Try:', chr(10), '1. run it', chr(10), '2) read it', chr(10), '```', language, chr(10), content, chr(10), '```') AS t FROM @code)""")
def k26_blocks(spark, d):
    t = F.concat(F.lit("Try:\n1. run it\n2) read it\n```"), F.col("language"), F.lit("\n"), F.col("content"), F.lit("\n```"))
    return code(spark, d).withColumn("t", t).select("doc_id", T.code_blocks(F.col("t")).alias("blocks"), T.numbered_items(F.col("t")).alias("items"))


@query("SELECT event_type AS query, user_id AS doc_id, count(*) AS hits FROM events GROUP BY ALL HAVING count(*) >= 3")
def v11_query_counters(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("query"), F.col("user_id").alias("doc_id")).agg(F.count("*").alias("hits")).filter("hits >= 3")


@query()
def s11_ingest_order(spark, d):
    return S.ingest_order(s10_spanning_tree(spark, d))


# -- vectors, logs and neighbours ------------------------------------------------------------------


@query("""SELECT vec_id, embedding[1]::DOUBLE AS first FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id % 7 <> 1
UNION ALL SELECT vec_id, 0.5::DOUBLE FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id % 7 = 1 UNION ALL SELECT -1, 0.5::DOUBLE""")
def v5_vector_updates(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    half = F.array_repeat(F.lit(0.5), 64)
    new = v.filter("vec_id % 7 = 1 and vec_id % 3 <> 0").select("vec_id", half.alias("embedding")).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("vec_id"), half.alias("embedding")))
    return R.put_vectors(R.remove_vectors(v, v.filter("vec_id % 3 = 0")), new).select("vec_id", F.col("embedding")[0].alias("first"))


@query()
def v4_cells(spark, d):
    """Neighbours of a vector by the cell index: approximate, so without SQL."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    centres, index = R.cell_index(v, cells=16)
    return R.search_cells(centres, index, list(v.orderBy("vec_id").first()["embedding"]), 10)


@query("""WITH l AS (SELECT p_partkey AS doc_id, p_retailprice AS score FROM part ORDER BY 2 DESC, 1 LIMIT 40), s AS (SELECT p_partkey AS doc_id, p_size::DOUBLE AS score FROM part ORDER BY 2 DESC, 1 LIMIT 40),
a AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM l), b AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM s)
SELECT doc_id, a.r::INT AS ngram_rank, b.score AS semantic_score, 0.4::DOUBLE AS semantic_weight FROM a FULL JOIN b USING (doc_id) ORDER BY round(coalesce(0.6 / (60 + a.r), 0) + coalesce(0.4 / (60 + b.r), 0), 9) DESC, doc_id LIMIT 20""")
def v10_explain(spark, d):
    return R.explain(v9_fusion(spark, d)).select(
        "doc_id", F.col("explanation.ranks.ngram").alias("ngram_rank"), F.col("explanation.scores.semantic").alias("semantic_score"), F.col("explanation.weights.semantic").alias("semantic_weight"))


@query("""WITH a AS (SELECT md5(concat('shard-', s, '-', v)) AS node, s AS shard FROM range(8) t(s), range(150) u(v)), b AS (SELECT md5(concat('shard-', s, '-', v)) AS node, s AS shard FROM range(9) t(s), range(150) u(v)),
k AS (SELECT doc_id, md5(doc_id::VARCHAR) AS h FROM documents), x AS (SELECT doc_id, h, coalesce(shard, (SELECT arg_min(shard, node) FROM a))::INT AS shard FROM k ASOF LEFT JOIN a ON node >= h),
y AS (SELECT doc_id, x.shard, coalesce(b.shard, (SELECT arg_min(shard, node) FROM b))::INT AS new_shard FROM x ASOF LEFT JOIN b ON node >= h)
SELECT doc_id, shard, new_shard FROM y WHERE shard <> new_shard""")
def s1_rebalance(spark, d):
    return S.rebalanced(table(spark, d, "documents"), "doc_id", 8, 9)


@query("WITH e AS (" + _SQL["s8_similarity_graph"] + """), n AS (SELECT a AS node, b AS neighbour, similarity FROM e UNION ALL SELECT b, a, similarity FROM e)
SELECT *, (row_number() OVER (PARTITION BY node ORDER BY similarity DESC, neighbour))::INT AS rank FROM n""")
def s12_neighbours(spark, d):
    return S.neighbours(s8_similarity_graph(spark, d))


LOG_SQL = """log AS (SELECT p, user_id, event_type, (row_number() OVER (PARTITION BY p ORDER BY event_id) - 1)::BIGINT AS o
  FROM (SELECT *, (concat('0x', substr(md5(user_id::VARCHAR), 1, 8))::BIGINT % 8)::INT AS p FROM events))"""


def _topic(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("key"), "event_type")
    return L.numbered(e, ["event_id"], 8)


@query(f"WITH {LOG_SQL} SELECT user_id::VARCHAR AS key, event_type, p AS partition, o AS \"offset\" FROM log WHERE p = 3 AND o >= 50 AND o < 150")
def k8_log_range(spark, d):
    return L.read_range(_topic(spark, d), 3, 50).select("key", "event_type", "partition", "offset")


@query(f"WITH {LOG_SQL} SELECT p AS partition, count(*) AS messages, max(o) + 1 AS end_offset FROM log GROUP BY 1")
def k10_log_ends(spark, d):
    return L.log_ends(_topic(spark, d))


@query(f"WITH {LOG_SQL} SELECT user_id::VARCHAR AS key, p AS partition, o AS \"offset\" FROM log WHERE o >= CASE WHEN p < 4 THEN p * 10 ELSE 0 END AND o < CASE WHEN p < 4 THEN p * 10 ELSE 0 END + 100")
def k12_poll(spark, d):
    committed = spark.range(4).select(F.col("id").cast("int").alias("partition"), (F.col("id") * 10).alias("offset"))
    return L.poll(_topic(spark, d), committed).select("key", "partition", "offset")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Search the code corpus and enrich what it finds."""
    meta = code(spark, d).select("doc_id", "language", F.col("file_path").alias("path"), F.col("repo").alias("repo_id"))
    return I.search(postings(spark, d), "item", meta=meta, language="python")
