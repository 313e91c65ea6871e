"""Personal data by candidate gradient boosting.

Base rules (e-mail and IP addresses, card and phone numbers) are certain and
always kept.  Beyond them, generous generators propose spans, overlapping as
they may: secrets, social-security numbers, IBANs, IPv6 addresses, addresses
spelt out, and national phone numbers.  Boosted trees judge each by its format
and its context, a threshold per kind is calibrated on examples set aside, and of
overlapping survivors the likeliest stays.

No table holds labels for such spans, so the trees learn from examples that a
seeded generator writes: true items and look-alikes of every kind, in fitting
and in misleading contexts.
"""

from __future__ import annotations

import bisect
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, table

BASE = ("email", "ip", "card", "phone")
EXTRA = ("secret", "ssn", "iban", "ipv6", "spelt", "national")
KINDS = BASE + EXTRA
SPANS = "array<struct<kind:string,start:int,end:int>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    for d in map(int, digits[-2::-2]):
        total += 2 * d - 9 * (d > 4)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base rules, each in time linear in the text."""
    out = []
    last = 0
    for m in _AT.finditer(text):
        # the local part is the whole run before "@": an earlier start would be the leftmost match
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append(("email", start, m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = digits_of(m.group())
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(digits_of(m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


_GENERATORS = {
    "secret": re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"),
    "ipv6": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "spelt": re.compile(r"(?: ?\[at\] ?| ?\(at\) ?| at )[A-Za-z0-9-]{1,63}(?:(?: ?\[dot\] ?| ?\(dot\) ?| dot |\.)[A-Za-z0-9-]{2,24}){1,3}"),
    "national": re.compile(r"(?<![0-9A-Za-z+.,$-])\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}[0-9]{2,5}){1,4}(?![0-9A-Za-z-])"),
}
#: A value behind a name that asks for secrecy, whatever it is made of.
_NAMED = re.compile(
    r"(?i)(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credentials?|bearer)"
    r"[\"']?[ \t]{0,3}(?::|=>|=)[ \t]{0,3}[\"']?([^\s\"'`,;<>()\[\]{}]{4,})")
_NAMES = re.compile(r"(?i)pass|pwd|secret|token|key|auth|credential|bearer")
#: How well-known kinds of keys begin.
_KEYED = re.compile(r"AKIA|ASIA|gh[pousr]_|sk[-_]|xox[abp]-|AIza|eyJ|glpat-")
#: Within a run without digits: what tells it from a word.
_MIXED = re.compile(r"[a-z][A-Z]+[a-z]|[A-Z][a-z]+[A-Z]|[+/]")
#: Words that tell what stands behind them.
_HINTS = {
    "secret": ("token", "key", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential", "api"),
    "ssn": ("ssn", "social", "security", "tax"),
    "iban": ("iban", "account", "konto", "bank", "compte", "cuenta"),
    "ipv6": ("ip", "address", "host", "server", "ipv6"),
    "spelt": ("mail", "email", "contact", "write", "reach"),
    "national": ("tel", "phone", "call", "fax", "mobile", "cell", "telefon", "ring"),
}
_DIGITS = re.compile(r"[0-9]")


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that may be personal; they may overlap.  Runs of letters alone count
    only if their case is mixed, they begin like a well-known kind of key, or a name
    of a secret stands before them."""
    out = []
    numeric = _DIGITS.search(text) is not None
    for kind, rx in _GENERATORS.items():
        if not numeric and kind not in ("spelt", "secret"):
            continue
        for m in rx.finditer(text):
            start = m.start()
            if kind == "spelt":  # the name before it: one run of address characters
                while start and text[start - 1] in _LOCAL:
                    start -= 1
                if start == m.start():
                    continue
            elif kind == "secret" and not _DIGITS.search(m.group()) and not _MIXED.search(m.group()) and not _KEYED.match(m.group()):
                continue
            out.append((kind, start, m.end()))
    if _NAMES.search(text):
        seen = set(out)
        out += [x for m in _NAMED.finditer(text) if (x := ("secret", m.start(1), m.start(1) + len(m.group(1).rstrip(".:!?")))) not in seen and x[2] - x[1] >= 4]
    return out


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1 if s.isalnum() and s.isascii() else False


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    s = text[start:end]
    n = len(s)
    before = text[max(0, start - 24): start].lower()
    words = re.findall(r"[a-z0-9]+", before)[-3:]
    digits = digits_of(s)
    letters = sum(c.isalpha() for c in s)
    counts = Counter(s)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    check = {
        "iban": mod97, "ssn": lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000",
        "ipv6": lambda s: s.count("::") <= 1 and (s.count(":") == 7 or "::" in s) and (len(digits) > 1 or letters > 1),
        "spelt": lambda s: bool(re.search(r"[\[(](at|dot)| dot ", s)),
        "national": lambda s: 9 <= len(digits) <= 12,
    }.get(kind, lambda s: all(c in "0123456789abcdefABCDEF" for c in s))
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:]))
    return [
        float(KINDS.index(kind)), n, len(digits) / n, letters / n, sum(c.isupper() for c in s) / n, entropy,
        float(check(s)), switches / n, sum(not c.isalnum() for c in s) / n, len(digits),
        float(any(w in _HINTS[kind] for w in words)), float(before.rstrip()[-1:] in ("=", ":", '"', "'")),
        float(text[start - 1: start] in ('"', "'", "`") and text[end: end + 1] in ('"', "'", "`")),
        max(counts.values()) / n, float(s[0] == "("), float("/" in s), s.count("-"),
        float(_KEYED.match(s) is not None),
    ]


# -- boosted trees ------------------------------------------------------------


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.25, depth: int = 3) -> list:
    """Second-order gradient boosting of the logistic loss; trees as nested tuples."""

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int):
        leaf = float(g[rows].sum() / (h[rows].sum() + 1.0))
        if level == 0 or len(rows) < 12:
            return leaf
        best = (1e-6, None, None)
        whole = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        for j in range(x.shape[1]):
            order = rows[np.argsort(x[rows, j], kind="stable")]
            v = x[order, j]
            cut = np.flatnonzero(np.diff(v) > 1e-12)
            if not len(cut):
                continue
            gs, hs = np.cumsum(g[order]), np.cumsum(h[order])
            gain = gs[cut] ** 2 / (hs[cut] + 1) + (gs[-1] - gs[cut]) ** 2 / (hs[-1] - hs[cut] + 1) - whole
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, float((v[cut[k]] + v[cut[k] + 1]) / 2))
        if best[1] is None:
            return leaf
        left = x[rows, best[1]] <= best[2]
        return (best[1], best[2], grow(rows[left], g, h, level - 1), grow(rows[~left], g, h, level - 1))

    def laid(tree, level: int) -> tuple[list, list, list]:
        """A tree as a whole one of its depth: features, thresholds, leaves."""
        if level == 0:
            return [], [], [tree]
        j, cut, left, right = tree if isinstance(tree, tuple) else (0, np.inf, tree, tree)
        (fl, cl, vl), (fr, cr, vr) = laid(left, level - 1), laid(right, level - 1)
        return [j, *_levels(fl, fr)], [cut, *_levels(cl, cr)], vl + vr

    trees, f, every = [], np.zeros(len(y)), np.arange(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        tree = laid(grow(every, y - p, p * (1 - p), depth), depth)
        trees.append(tree)
        f += rate * _leaves([tree], x)[:, 0]
    return [np.array(part) for part in zip(*trees)] + [rate]


def _levels(left: list, right: list) -> list:
    """Two subtrees' nodes, level by level."""
    out, n, at = [], 1, 0
    while at < len(left):
        out += left[at: at + n] + right[at: at + n]
        at += n
        n *= 2
    return out


def _leaves(trees, x: np.ndarray) -> np.ndarray:
    """The value of each tree (columns) for each row."""
    feature, cut, value = (np.array(part) for part in zip(*trees)) if isinstance(trees, list) and len(trees) and isinstance(trees[0], tuple) else trees
    node = np.zeros((len(x), len(feature)), np.int64)
    which, rows = np.arange(len(feature))[None, :], np.arange(len(x))[:, None]
    inner = feature.shape[1]
    while inner and node[0, 0] < inner:
        node = 2 * node + 1 + (x[rows, feature[which, node]] > cut[which, node])
    return value[which, node - inner]


def probability(trees: list, x) -> np.ndarray:
    """The trees' probability for each row of features."""
    x = np.asarray(x, float)
    if not len(x):
        return np.zeros(0)
    z = trees[3] * _leaves(tuple(trees[:3]), x).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def synthetic_examples(n: int = 400, seed: int = 11) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, label): ``n`` of each kind, half of them look-alikes."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioustrnlmdhk") for _ in range(rng.randint(2, 9)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexa = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    upper = lambda k: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ" + rng.choice(["", "234567"])) for _ in range(k))
    b62 = lambda k: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))

    def iban(good: bool) -> str:
        body = num(18)
        land = rng.choice(["DE", "FR", "ES", "GB"])
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        s = f"{land}{(check if good else (check + rng.randint(1, 90)) % 97 + 1):02d}{body}"
        return " ".join(s[i: i + 4] for i in range(0, len(s), 4)) if rng.random() < 0.5 else s

    def make(kind: str, good: bool) -> str:
        if kind == "secret":
            if good:
                return rng.choice([lambda: hexa(rng.randint(12, 24)), lambda: b62(rng.randint(10, 22)), lambda: word()[:6] + num(rng.randint(2, 4)) + rng.choice("!#$%&*"), lambda: hexa(rng.choice([32, 40, 64])), lambda: b62(rng.randint(24, 64)), lambda: rng.choice(["sk_", "ghp_", "xoxb-", "AIza"]) + b62(30), lambda: "AKIA" + upper(16)])()
            return rng.choice([word, lambda: word() + word(), lambda: word().capitalize(), lambda: num(4), lambda: f"{word()}.{word()}", lambda: "-".join(word() for _ in range(5)) + "-" + num(2), lambda: num(rng.randint(20, 30)), lambda: "/".join(word() for _ in range(5)) + "/" + num(3), lambda: word() * 5 + num(1), lambda: "=" * 22 + num(1), lambda: "_".join(word() for _ in range(5)) + num(1)])()
        if kind == "ssn":
            return f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}" if good else rng.choice([f"9{num(2)}-{num(2)}-{num(4)}", f"000-{num(2)}-{num(4)}", f"{num(3)}-00-{num(4)}"])
        if kind == "iban":
            return iban(good)
        if kind == "ipv6":
            return ":".join(hexa(4) for _ in range(8)) if good and rng.random() < 0.7 else f"{hexa(4)}:{hexa(4)}::{hexa(2)}" if good else f"{rng.randint(0, 23):02d}:{num(2)}:{num(2)}"
        if kind == "spelt":
            return f"{word()}.{word()}{rng.choice([' [at] ', ' (at) ', ' at '])}{word()}{rng.choice([' [dot] ', ' (dot) ', ' dot '])}{rng.choice(['com', 'org', 'net', 'de'])}" if good else f"{word()} at {word()}.{word()}"
        return rng.choice([f"({num(3)}) {num(3)}-{num(4)}", f"0{num(2)} {num(4)} {num(4)}", f"{num(3)}-{num(3)}-{num(4)}"]) if good else rng.choice([f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(3)} {num(3)}", f"{num(4)} {num(4)} {num(4)} {num(4)} {num(4)}"])

    out = []
    for kind in EXTRA:
        for i in range(n):
            good = i % 2 == 0
            item = make(kind, good)
            hint = rng.choice(_HINTS[kind]) if rng.random() < (0.7 if good else 0.1) else word()
            link = rng.choice([" ", ": ", " = ", "=", ' = "']) if good else rng.choice([" ", " ", ", ", ": "])
            if kind == "secret" and (len(item) < 16 or (not good and rng.random() < 0.3)):  # short ones stand out by their names alone
                hint, link = rng.choice(["password", "token", "secret", "api_key", "pwd"]), rng.choice(["=", ": ", " = "])
            head = f"{word()} {word()} {hint}{link}"
            text = head + item + ('"' if link.endswith('"') else "") + f" {word()} {word()}."
            # the spans are those that the generators propose for it; only one that fits is true
            at, to = len(head), len(head) + len(item)
            for k, s, e in candidates(text):
                if k == kind and s < to and e > at:
                    fits = (min(e, to) - max(s, at)) >= 0.9 * (max(e, to) - min(s, at))
                    out.append((text, kind, s, e, int(good and fits)))
    return out


@lru_cache(maxsize=2)
def train(n: int = 400, seed: int = 11, wrong: float = 5.0) -> tuple[list, dict[str, float]]:
    """Trees, and for each kind the threshold that is worth most on the examples set
    aside, where a wrong span weighs as much as ``wrong`` missed ones."""
    made = synthetic_examples(n, seed)
    x = np.array([describe(t, k, s, e) for t, k, s, e, _ in made])
    y = np.array([r[4] for r in made], float)
    aside = np.arange(len(made)) // 2 % 2 == 1
    trees = boost(x[~aside], y[~aside])
    cuts = {}
    for kind in EXTRA:
        rows = np.flatnonzero(aside & (x[:, 0] == KINDS.index(kind)))
        p = probability(trees, x[rows])
        order = np.argsort(-p, kind="stable")
        worth = np.cumsum(np.where(y[rows][order] > 0, 1.0, -wrong))
        last = int(worth.argmax()) if len(worth) and worth.max() > 0 else -1
        upper = p[order][last] if last >= 0 else 1.1
        below = p[order][last + 1] if last + 1 < len(rows) else 0.0
        cuts[kind] = float((upper + below) / 2)  # half-way to the first that is not accepted
    return trees, cuts


def find_many(texts: Iterable[str | None], trees: list, cuts: dict[str, float]) -> list[list[tuple[str, int, int]]]:
    """For each text its base spans and accepted candidates, by kind and then by
    start.  All candidates are judged at once."""
    kept, judged, rows = [], [], []
    for i, text in enumerate(texts):
        kept.append(base_spans(text) if text else [])
        for kind, s, e in candidates(text) if text else ():
            judged.append((i, kind, s, e))
            rows.append(describe(text, kind, s, e))
    best: dict[int, list] = {}
    for (i, kind, s, e), p in zip(judged, probability(trees, rows).tolist()):
        if p >= cuts[kind]:
            best.setdefault(i, []).append((-p, s, e, kind))
    for i, found in best.items():
        taken: list[tuple[int, int]] = sorted((s, e) for _, s, e in kept[i])
        for _, s, e, kind in sorted(found):
            at = bisect.bisect_left(taken, (s, e))
            if (at < len(taken) and taken[at][0] < e) or any(b > s for _, b in taken[max(0, at - len(BASE)): at]):
                continue
            taken.insert(at, (s, e))
            kept[i].append((kind, s, e))
    return [sorted(k, key=lambda x: (KINDS.index(x[0]), x[1])) for k in kept]


def find_spans(text: str | None, trees: list, cuts: dict[str, float]) -> list[tuple[str, int, int]]:
    return find_many([text], trees, cuts)[0]


# -- operators ----------------------------------------------------------------


def _finder(df: DataFrame):
    shared = df.sparkSession.sparkContext.broadcast(train())  # some thousand numbers
    return lambda: shared.value


def pii_spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, spans): spans as (kind, start, end) in code points, end exclusive.
    Null and empty texts have an empty list; very long texts are read whole;
    repeated rows each give their row; of overlapping candidates the likeliest
    stays, of equally likely ones the first; other columns are not looked at; an
    empty table gives an empty one."""
    model = _finder(df)
    kind_type = df.schema[key].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, cuts = model()
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in find_many((t.as_py() for t in batch.column(1)), trees, cuts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, span)], names=[key, "spans"])

    return df.select(key, text).mapInArrow(lean(run), f"`{key}` {kind_type}, spans {SPANS}")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Every found span of ``text`` becomes its kind in brackets, as in ``[EMAIL]``;
    other columns and null texts stay as they are, whatever their names.  Spans that
    overlap become one; repeated rows and very long texts are treated like any; an
    empty table gives an empty one."""
    model = _finder(df)
    at = df.columns.index(text)
    schema = T.StructType([T.StructField(f.name, f.dataType, f.nullable) for f in df.schema.fields])

    def clean(t: str | None, spans: list) -> str | None:
        spans = sorted(spans, key=lambda x: (x[1], -x[2]))
        if not spans:
            return t
        out, last = [], 0
        for kind, s, e in spans:
            if s >= last:
                out += [t[last:s], f"[{kind.upper()}]"]
            last = max(last, e)
        return "".join([*out, t[last:]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, cuts = model()
        for batch in batches:
            columns = list(batch.columns)
            spans = find_many((t.as_py() for t in columns[at]), trees, cuts)
            columns[at] = pa.array((clean(t.as_py(), x) for t, x in zip(columns[at], spans)), pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(lean(run), schema)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_boosting(spark, sf_dir: str) -> DataFrame:
    found = pii_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("spans")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text(spans).alias("spans"),
        F.size(spans).cast("long").alias("n_spans"))
