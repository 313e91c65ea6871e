"""Language identification by interpolated Kneser-Ney character models.

One model a language, of characters within words (each word between two word
marks).  A model keeps, for every n-gram it has seen, the final interpolated
probability, and for every context its back-off weight; both stand in arrays
sorted by the n-gram's 64-bit hash.  A text's language is the one whose model
spends the fewest nats a character on it.  How far the second-best is away,
and how long the text is, give the probability of being right; below a
threshold calibrated on snippets of training texts a text is ``rejected``.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import decimal_id, fit_logistic, labelled_sample, lean, table, worker_state

ORDER = 5
#: Training texts a language: the bound of the sample that the models are fitted on.
TEXTS_PER_LANG = 400
CACHE_WORDS = 500_000
WORDS = re.compile(r"[^\W\d_]+")
UND = "und"
_MUL = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def _grams(codes: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that end an n-gram within one word, and the n-grams' hashes."""
    at = np.flatnonzero(place >= n - 1)
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n - 1, -1, -1):
            h = (h ^ codes[at - k]) * _MUL
            h ^= h >> np.uint64(29)
    return at, h


def _flat(words: list[str], alphabet: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words between word marks (code 1) in one array; each code's place in its word; word lengths."""
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    unknown = len(alphabet) + 2
    text = "\0" + "\0\0".join(words) + "\0"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    uniq, inv = np.unique(points, return_inverse=True)
    table_ = np.array([1 if u == 0 else alphabet.get(chr(u), unknown) for u in uniq.tolist()], np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return table_[inv], np.arange(len(points)) - np.repeat(starts, sizes), sizes


def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted hash array, and which of them hold the hash."""
    if not len(keys):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return i, keys[i] == h


def _train_one(counts: Counter, alphabet: dict[str, int], order: int):
    """Per order: (hashes, log probabilities) and (context hashes, log back-off weights)."""
    words = sorted(counts)
    weight = np.array([counts[w] for w in words], float)
    codes, place, sizes = _flat(words, alphabet)
    w = np.repeat(weight, sizes)
    raw = []
    for n in range(1, order + 1):
        at, h = _grams(codes, place, n)
        if n == 1:
            at, h = at[place[at] > 0], h[place[at] > 0]  # the mark before a word is never predicted
        keys, first, inv = np.unique(h, return_index=True, return_inverse=True)
        total = np.bincount(inv, w[at])
        raw.append((keys, total, at[first]))
    grams, contexts, below = [], [], None
    for n in range(1, order + 1):
        keys, total, at = raw[n - 1]
        adjusted = total.copy()
        if n < order:
            longer = raw[n][2]
            _, suffix = _grams(codes, place, n)
            pos = np.full(len(codes), -1, np.int64)
            pos[np.flatnonzero(place >= n - 1)] = np.arange(len(suffix))
            cont_keys, cont = np.unique(suffix[pos[longer]], return_counts=True)
            i, ok = _find(cont_keys, keys)
            starts = codes[at - (n - 1)] == 1  # begins with the word mark: nothing can stand before it
            adjusted = np.where(ok & ~(starts & (n > 1)), cont[i] if len(cont) else 0, total)
        n1, n2 = (adjusted == 1).sum(), (adjusted == 2).sum()
        d = n1 / (n1 + 2 * n2) if n1 else 0.5
        if n == 1:
            ctx = np.zeros(len(keys), np.uint64)
            lower = np.full(len(keys), 1.0 / (len(alphabet) + 3))
        else:
            at_c, h_c = _grams(codes, place, n - 1)
            pos = np.full(len(codes), -1, np.int64)
            pos[at_c] = np.arange(len(at_c))
            ctx = h_c[pos[at - 1]]
            i, ok = _find(below[0], h_c[pos[at]])
            lower = np.where(ok, below[1][i], 1.0 / (len(alphabet) + 3))
        ctx_keys, inv = np.unique(ctx, return_inverse=True)
        sums, kinds = np.bincount(inv, adjusted), np.bincount(inv)
        back = d * kinds / sums
        p = np.maximum(adjusted - d, 0) / sums[inv] + back[inv] * lower
        below = (keys, p)
        grams.append((keys, np.log(p)))
        contexts.append((ctx_keys, np.log(back)))
    return grams, contexts


@dataclass
class CharModels:
    langs: list[str]
    alphabet: dict[str, int]
    grams: list[tuple[np.ndarray, np.ndarray]]  # by order: sorted hashes, log p (rows) of each language (columns)
    contexts: list[tuple[np.ndarray, np.ndarray]]
    calibration: tuple[float, ...] = (0.0, 1.0, 0.0)
    threshold: float = 0.5

    @classmethod
    def train(cls, counts: dict[str, Counter], order: int = ORDER) -> CharModels:
        langs = sorted(counts)
        letters = sorted({c for x in counts.values() for w in x for c in w})
        alphabet = {c: i + 2 for i, c in enumerate(letters)}
        each = [_train_one(counts[lang], alphabet, order) for lang in langs]

        def join(kind: int, n: int, absent: float):
            keys = np.unique(np.concatenate([x[kind][n][0] for x in each]))
            out = np.full((len(keys), len(langs)), absent)
            for j, x in enumerate(each):
                out[np.searchsorted(keys, x[kind][n][0]), j] = x[kind][n][1]
            return keys, out

        grams = [join(0, n, np.nan) for n in range(order)]
        contexts = [join(1, n, 0.0) for n in range(order)]
        return cls(langs, alphabet, grams, contexts)

    def word_costs(self, words: list[str]) -> np.ndarray:
        """Nats that each language's model spends on each word and the mark after it."""
        codes, place, sizes = _flat(words, self.alphabet)
        n_langs = len(self.langs)
        lp = np.zeros((len(codes), n_langs))
        base = np.log(1.0 / (len(self.alphabet) + 3))
        for n, ((keys, p), (ctx_keys, back)) in enumerate(zip(self.grams, self.contexts), 1):
            at, h = _grams(codes, place, n)
            if n == 1:
                i, ok = _find(keys, h)
                lp[at] = np.where(ok[:, None], np.nan_to_num(p[i], nan=0.0), 0.0)
                miss = ~ok[:, None] | np.isnan(p[i])
                lp[at] = np.where(miss, back[0] + base, lp[at])
                continue
            i, ok = _find(keys, h)
            seen = np.where(ok[:, None], p[i], np.nan)
            at_c, h_c = _grams(codes, place, n - 1)
            pos = np.zeros(len(codes), np.int64)
            pos[at_c] = np.arange(len(at_c))
            j, has = _find(ctx_keys, h_c[pos[at - 1]])
            lp[at] = np.where(np.isnan(seen), lp[at] + np.where(has[:, None], back[j], 0.0), seen)
        lp[place == 0] = 0
        ends = np.cumsum(sizes)
        return -np.add.reduceat(lp, np.concatenate([[0], ends[:-1]]), axis=0)

    def judge(self, costs: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language and probability of being right, from summed costs and characters."""
        rate = costs / np.maximum(chars, 1)[:, None]
        best = rate.argmin(axis=1)
        part = np.sort(rate, axis=1)
        margin = part[:, 1] - part[:, 0] if rate.shape[1] > 1 else np.full(len(rate), 1.0)
        a, b, c = self.calibration
        z = a + b * margin * np.sqrt(np.maximum(chars, 1)) + c * margin
        return best, 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def calibrate(self, texts: dict[str, list[str]], precision: float = 0.99) -> None:
        """Logistic regression of "right" on the margin, over snippets of 1 to 16
        words; the threshold is the least score at which ``precision`` holds."""
        snippets, truth = [], []
        for j, lang in enumerate(self.langs):
            for t in texts[lang]:
                ws = words_of(t)
                for k, size in enumerate((1, 2, 4, 8, 16)):
                    at = (len(ws) * (k + 1)) // 7
                    if ws[at: at + size]:
                        snippets.append(ws[at: at + size])
                        truth.append(j)
        if not snippets or len(self.langs) < 2:
            return
        flat = [w for s in snippets for w in s]
        ends = np.cumsum([len(s) for s in snippets])
        starts = np.concatenate([[0], ends[:-1]])
        costs = np.add.reduceat(self.word_costs(flat), starts, axis=0)
        chars = np.add.reduceat(np.array([len(w) + 1 for w in flat]), starts)
        rate = costs / chars[:, None]
        right = (rate.argmin(axis=1) == np.array(truth)).astype(float)
        part = np.sort(rate, axis=1)
        m = part[:, 1] - part[:, 0]
        x = np.stack([np.ones_like(m), m * np.sqrt(chars), m], axis=1)
        wts = fit_logistic(x, right, 0.1)
        self.calibration = tuple(wts.tolist())
        score = 1 / (1 + np.exp(-np.clip(x @ wts, -30, 30)))
        order = np.argsort(-score)
        good = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        hold = np.flatnonzero(good >= precision)
        self.threshold = float(score[order][hold[-1]]) if len(hold) else 1.0


class _Scorer(dict):
    """Word -> row of a growing table of costs."""

    def __init__(self, model: CharModels):
        self.model, self.pending = model, []
        self.table = np.zeros((1024, len(model.langs)))

    def __missing__(self, word: str) -> int:
        self[word] = i = len(self)
        self.pending.append(word)
        return i

    def texts(self, texts: list[str | None]):
        if len(self) > CACHE_WORDS:
            self.clear()
            self.table = self.table[:1024].copy()
        ids, chars, und = [], [], []
        for t in texts:
            ws = words_of(t)
            ids.append(np.array(list(map(self.__getitem__, ws)), np.int64))
            chars.append(sum(map(len, ws)) + len(ws))
            und.append(not any(w.isalpha() for w in ws) and not any(c.isalpha() for c in t or ""))
        if len(self) > len(self.table):
            self.table = np.resize(self.table, (2 * len(self), self.table.shape[1]))
        first = len(self) - len(self.pending)
        for i in range(0, len(self.pending), 20_000):
            part = self.pending[i: i + 20_000]
            self.table[first + i: first + i + len(part)] = self.model.word_costs(part)
        self.pending = []
        costs = np.array([self.table[i].sum(axis=0) if len(i) else np.zeros(self.table.shape[1]) for i in ids])
        best, score = self.model.judge(costs, np.array(chars))
        return best, score, np.array(und)


def train_models(df: DataFrame, lang: str = "lang", key: str = "doc_id", text: str = "text",
                 texts_per_lang: int = TEXTS_PER_LANG, order: int = ORDER) -> CharModels | None:
    """Fits on at most about ``texts_per_lang`` whole texts of each language of ``df``.

    A fifth of them calibrates.  Rows with a null language or text are left out;
    None if no text with a letter is left.
    """
    rows = labelled_sample(
        df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(key, lang, text), lang, key, texts_per_lang, "langid"
    ).select(lang, key, text).collect()  # bounded by texts_per_lang
    fit: dict[str, Counter] = {}
    tune: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r[0], str(r[1]))):
        fit.setdefault(r[0], Counter())
        tune.setdefault(r[0], [])
        if for_tuning(r[1]):
            tune[r[0]].append(r[2])
        else:
            fit[r[0]].update(words_of(r[2]))
    for name, counts in fit.items():
        if not counts:  # too few texts to set any aside
            counts.update(w for t in tune[name] for w in words_of(t))
    fit = {k: v for k, v in fit.items() if v}
    if not fit:
        return None
    model = CharModels.train(fit, order)
    model.calibrate(tune)
    return model


def for_tuning(key) -> bool:
    return zlib.crc32(f"tune:{key}".encode()) % 5 == 0


def identify(df: DataFrame, model: CharModels | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, lang_pred, score, rejected).  Texts without a letter, and null
    texts, are ``und`` with score 0 and rejected, as are all without a model.
    Repeated rows each give a row, equal texts get equal ones, very long texts are
    read whole, other columns are not looked at, an empty table gives an empty one."""
    if model is None:
        return df.select(key, F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = df.sparkSession.sparkContext.broadcast(vars(model))  # bounded by the training sample
    name = uuid.uuid4().hex
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_state(name, lambda: _Scorer(CharModels(**shared.value)))
        langs = np.array(scorer.model.langs, object)
        for batch in batches:
            if not batch.num_rows:
                continue
            best, score, und = scorer.texts(batch.column(1).to_pylist())
            score = np.where(und, 0.0, score)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.where(und, UND, langs[best]), pa.string()), pa.array(score),
                 pa.array(und | (score < scorer.model.threshold))],
                names=[key, "lang_pred", "score", "rejected"])

    return df.select(key, text).mapInArrow(lean(run, name), f"`{key}` {kind}, lang_pred string, score double, rejected boolean")


def op1_kneserney(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(decimal_id(F.col("doc_id")), F.lit(3)) == 1
    model = train_models(docs.filter(F.coalesce(~held_out, F.lit(False))))
    # identifiers and fold travel beside the text; the model sees the text alone
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
