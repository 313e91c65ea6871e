"""Code monitors, caches and message bookkeeping in batch form."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions.text import spans

SEVERITIES = ["info", "warning", "error", "critical"]


class Rule(NamedTuple):
    """What a monitor looks for: a pattern, in any case of letters, in files of a language
    and with paths that begin as ``file_pattern`` says.  ``trigger``: new_match, threshold
    (more than ``threshold`` matches in a file), removed or modified."""

    id: str
    pattern: str
    severity: str = "warning"
    name: str = ""
    language: str | None = None
    file_pattern: str | None = None
    trigger: str = "new_match"
    threshold: int = 0
    enabled: bool = True


# fixed values: the default rules
DEFAULT_RULES = [
    Rule("sec-001", r"""(?:password|api_key|secret|token)\s*=\s*['"][^'"]+['"]""", "critical", "Hardcoded Secrets"),
    Rule("sec-002", r"\beval\s*\(", "error", "Eval Usage"),
    Rule("sec-003", r"""execute\([^)]*%s|execute\([^)]*\+|cursor\.execute\([^)]*f['"]""", "error", "SQL Injection Risk"),
    Rule("dep-001", r"@deprecated|# deprecated|DEPRECATED", "warning", "Deprecated APIs"),
    Rule("qual-001", r"(?:TODO|FIXME|HACK|XXX):", "info", "TODO/FIXME"),
]
COLOURS = {"info": "#36a64f", "warning": "#ffcc00", "error": "#ff6600", "critical": "#ff0000"}


class RuleStore:
    """Rules by id, the default ones first."""

    def __init__(self, rules=DEFAULT_RULES):
        self._rules = {r.id: r for r in rules}

    def add(self, rule: Rule) -> None:
        self._rules[rule.id] = rule

    def remove(self, rule_id: str) -> bool:
        return self._rules.pop(rule_id, None) is not None

    def __iter__(self):
        return iter(self._rules.values())

    def stats(self) -> dict[str, int]:
        return {"total_rules": len(self._rules), "active_rules": sum(r.enabled for r in self)}


def matches(files: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """Rows (rule_id, severity, trigger, file_path, start, line, text, match_hash) of every
    match of the enabled rules.  The rules are a bounded list in the plan; a file is
    read once for all of them."""
    rules = [r for r in rules if r.enabled]
    kind = "array<struct<rule_id:string,severity:string,trigger:string,language:string,file_pattern:string,regex:string>>"
    table = F.array(*[F.struct(
        F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.trigger).alias("trigger"), F.lit(r.language).alias("language"),
        F.lit(f"^(?:{r.file_pattern})" if r.file_pattern else None).alias("file_pattern"), F.lit("(?i)" + r.pattern).alias("regex")) for r in rules]).cast(kind)
    language = F.col("language") if "language" in files.columns else F.lit(None).cast("string")

    def applies(r):
        mine = r["language"].isNull() | F.coalesce(r["language"] == language, F.lit(False))
        return mine & (r["file_pattern"].isNull() | F.rlike("file_path", r["file_pattern"])) & F.rlike("content", r["regex"])

    def found(r):
        return F.transform(spans(F.col("content"), r["regex"]), lambda m: F.struct(
            r["rule_id"].alias("rule_id"), r["severity"].alias("severity"), r["trigger"].alias("trigger"), m["start"].alias("start"), m["line"].alias("line"), m["match"].alias("text")))

    hits = files.select("file_path", F.explode(F.flatten(F.transform(F.filter(table, applies), found))).alias("m")).select("file_path", "m.*")
    return hits.withColumn("match_hash", F.md5(F.concat_ws(":", "file_path", F.col("start").cast("string"), "text").cast("binary")))


def scan(files: DataFrame, rules=DEFAULT_RULES, history: DataFrame | None = None) -> DataFrame:
    """Rows (rule_id, severity, file_path, line, text, match_hash): matches that ``history``
    (rule_id, match_hash) doesn't have.  Texts are shown up to 100 characters."""
    out = matches(files, [r for r in rules if r.trigger == "new_match"])
    if history is not None:
        out = out.join(history.select("rule_id", "match_hash"), ["rule_id", "match_hash"], "left_anti")
    return out.select("rule_id", "severity", "file_path", "line", F.substring("text", 1, 100).alias("text"), "match_hash").dropDuplicates(["rule_id", "match_hash"])


def threshold_scan(files: DataFrame, rules) -> DataFrame:
    """Alerts (rule_id, severity, file_path, line 0, text) of files with more matches of a
    threshold rule than it allows."""
    rules = [r for r in rules if r.trigger == "threshold"]
    least = F.create_map(*[x for r in rules for x in (F.lit(r.id), F.lit(r.threshold))]) if rules else F.lit(None).cast("map<string,int>")
    n = matches(files, rules).groupBy("rule_id", "severity", "file_path").agg(F.count("*").alias("n"))
    return n.filter(F.col("n") > F.element_at(least, F.col("rule_id"))).select(
        "rule_id", "severity", "file_path", F.lit(0).alias("line"), F.concat("n", F.lit(" matches found")).alias("text"))


def changed_matches(old: DataFrame, new: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """Rows (rule_id, severity, file_path, nth, change, old_text, new_text) between two
    versions of files: a rule's nth match in a file was removed, modified or added."""
    def numbered(files, name):
        w = W.partitionBy("rule_id", "file_path").orderBy("start")
        return matches(files, rules).select("rule_id", "severity", "file_path", F.row_number().over(w).alias("nth"), F.col("text").alias(name))

    both = numbered(old, "old_text").join(numbered(new, "new_text"), ["rule_id", "severity", "file_path", "nth"], "full")
    change = F.when(F.col("new_text").isNull(), "removed").when(F.col("old_text").isNull(), "added").when(F.col("old_text") != F.col("new_text"), "modified")
    return both.withColumn("change", change).filter("change is not null").select("rule_id", "severity", "file_path", "nth", "change", "old_text", "new_text")


def threshold_alerts(matches: DataFrame, threshold: int) -> DataFrame:
    return matches.groupBy("rule_id", "file_path").agg(F.count("*").alias("matches")).filter(F.col("matches") > threshold)


def with_state(alerts: DataFrame, marks: DataFrame) -> DataFrame:
    """Alerts with ``acknowledged`` and ``resolved``, from a log of marks (rule_id,
    match_hash, mark) that only grows."""
    m = marks.groupBy("rule_id", "match_hash").agg(F.bool_or(F.col("mark") == "acknowledge").alias("acknowledged"), F.bool_or(F.col("mark") == "resolve").alias("resolved"))
    return alerts.join(m, ["rule_id", "match_hash"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("acknowledged", "resolved")})


def webhook_payloads(alerts: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """Rows (rule_id, match_hash, payload): the JSON that a chat's webhook takes."""
    names = F.create_map(*[x for r in rules for x in (F.lit(r.id), F.lit(r.name or r.id))])
    colours = F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])
    name = F.coalesce(F.element_at(names, F.col("rule_id")), F.col("rule_id"))
    attachment = F.struct(
        name.alias("title"), F.concat(F.lit("File: "), "file_path", F.lit(":"), "line").alias("text"),
        F.coalesce(F.element_at(colours, F.col("severity")), F.lit("#808080")).alias("color"))
    text = F.concat(F.lit("["), F.upper("severity"), F.lit("] "), name, F.lit(": "), "text")
    return alerts.select("rule_id", "match_hash", F.to_json(F.struct(text.alias("text"), F.array(attachment).alias("attachments"))).alias("payload"))


def severity_counts(alerts: DataFrame) -> DataFrame:
    names = alerts.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    return names.join(alerts.groupBy("severity").count(), "severity", "left").select("severity", F.coalesce("count", F.lit(0)).alias("alerts"))


def latest_alerts(alerts: DataFrame, severity: str | None = None, limit: int = 100, open_only: bool = False) -> DataFrame:
    """The last alerts; ``open_only`` leaves out those that were acknowledged."""
    out = alerts.filter(F.col("severity") == severity) if severity else alerts
    out = out.filter("not acknowledged") if open_only else out
    return out.orderBy(F.desc("line"), "rule_id", "file_path").limit(limit)


def apply_events(state: DataFrame, events: DataFrame, key: str = "doc_id") -> DataFrame:
    """Upserts and deletions: the last event of each key wins."""
    last = events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), "offset").alias("e")).select(key, "e.*")
    kept = state.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.filter("action <> 'delete'").select(*state.columns))


def popular_keys(log: DataFrame, least: int = 5, last: int | None = None) -> DataFrame:
    if last:
        log = log.orderBy(F.desc("ts"), F.desc("event_id")).limit(last)
    return log.groupBy("key").agg(F.count("*").alias("hits")).filter(F.col("hits") >= least)


def co_access(log: DataFrame, least: int = 1) -> DataFrame:
    """Rows (key, next_key, times): keys looked up one after the other by a session."""
    nxt = F.lead("key").over(W.partitionBy("session").orderBy("ts", "event_id"))
    step = log.withColumn("next_key", nxt).filter("next_key is not null and key <> next_key")
    both = step.select("key", "next_key").unionByName(step.select(F.col("next_key").alias("key"), F.col("key").alias("next_key")))
    return both.groupBy("key", "next_key").agg(F.count("*").alias("times")).filter(F.col("times") >= least)


class LruCache:
    """Driver-side memo of small results: least recently used goes, entries expire."""

    def __init__(self, size: int = 1000, ttl: float = 3600.0, clock: Callable[[], float] = time.time):
        self.size, self.ttl, self.clock = size, ttl, clock
        self._items: OrderedDict = OrderedDict()
        self.hits = self.misses = self.evictions = 0

    def get(self, key, default=None):
        item = self._items.get(key)
        if item is None or item[1] < self.clock():
            self._items.pop(key, None)
            self.misses += 1
            return default
        self._items.move_to_end(key)
        self.hits += 1
        return item[0]

    def set(self, key, value, ttl: float | None = None) -> None:
        self._items[key] = (value, self.clock() + (self.ttl if ttl is None else ttl))
        self._items.move_to_end(key)
        while len(self._items) > self.size:
            self._items.popitem(last=False)
            self.evictions += 1

    def get_or_compute(self, key, make):
        mark = object()
        value = self.get(key, mark)
        if value is mark:
            self.set(key, value := make())
        return value

    def clear(self) -> None:
        self._items.clear()

    def stats(self) -> dict:
        n = self.hits + self.misses
        return {"size": len(self._items), "hits": self.hits, "misses": self.misses, "evictions": self.evictions, "hit_rate": self.hits / n if n else 0.0}
