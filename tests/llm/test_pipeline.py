"""The pipeline, stage by stage, against what brute force keeps."""

import corpus_pipeline as P
from pyspark.sql import functions as F
from gleaner.llm.common import materialize
from test_operators import brute_base, brute_components, brute_hits, placed_ok

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [{r.doc_id: r.text for r in docs.collect()}]
    for name, stage in P.STAGES:
        before = docs.columns
        docs = materialize(stage(spark, docs, SF))
        if name != P.STAGES[-1][0]:
            assert sorted(docs.columns) == sorted(before)
            seen.append({r.doc_id: r.text for r in docs.collect()})
    start, good, single, clean, redacted = seen
    assert set(good) < set(start)
    groups = brute_components(sorted(good.items()))
    assert set(single) == {k for k in good if groups[k][1] == k}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(clean) == {d for d, _, hit, _ in brute_hits(sorted(single.items()), bench) if not hit}
    assert set(redacted) == set(clean) and not any(brute_base(t) for t in redacted.values())
    assert all(redacted[k] == t for k, t in clean.items() if not any(c.isdigit() for c in t) and "@" not in t)
    rows = docs.collect()
    assert {r.doc_id for r in rows} == set(clean)
    placed_ok([(r.sequence_id, r.offset, r.length) for r in rows], 2048)


def test_run(spark):
    assert P.run(spark, SF).count() > 0


def test_stages_on_awkward_tables(spark):
    """Nulls, empty and very long texts, repeated rows, clashing columns, no rows."""
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "", None, None, 0), (2, None, "en", "s", None), (3, "one two three four five six", "en", None, 27),
            (3, "one two three four five six", "en", None, 27), (4, "Fine words stand here. " * 6000, "en", "s", 138_000), (5, "mail a@b.org now", None, "s", 16)]
    docs = spark.createDataFrame(rows, kind).withColumns({c: F.lit(7) for c in ("_score", "_h", "score", "n_hit", "component_id", "spans")})
    want = {
        "n-gram Jaccard join": sorted(rows, key=repr), "benchmark decontamination": sorted(rows, key=repr),
        "PII": sorted([*rows[:5], (5, "mail [EMAIL] now", None, "s", 16)], key=repr),
    }
    for name, stage in P.STAGES:
        got = [tuple(r) for r in stage(spark, docs, SF).collect()]
        if name in want:
            near = lambda t: [(a, b, c, d) for a, b, c, d, _ in t]  # noqa: E731  n_chars follows the text
            assert sorted(near(got), key=repr) == sorted(near(want[name]), key=repr), name
        elif name == "quality classifier":
            assert set(got) <= set(rows) and len({r[0] for r in got}) >= 1
        else:
            assert {r[0] for r in got} == {1, 2, 3, 4, 5}
        assert stage(spark, docs.filter("false"), SF).count() == 0
