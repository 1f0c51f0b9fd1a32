"""Language ID by interpolated Kneser-Ney character models.

One model per language over the letters of words, each word between blanks, up to `ORDER` characters. All models
share sorted arrays of 64-bit n-gram hashes, one per order, each with a row of discounted probabilities by
language, and the same for contexts with their interpolation weights. A text's score under a language is its
cross-entropy per character, over every word of the whole text; the lowest wins. Rejection is calibrated on
labelled rows kept out of the counts, less those that are more like another language than their label: a text is
rejected if its cross-entropy is further above its language's mean than almost all (1 - `reject_rate`) of those were
when cut to about its number of words, with room of `slack`.

Fitting takes a bounded sample of labelled rows: about `per_lang` rows of each language (those with the lowest hash of
their id and at most `max_chars` characters; of a language without such rows, the shortest, of which as many characters
as `max_chars` are taken), a documented bound that doesn't grow with the table. Every label is learnt. Each language is
counted, and later calibrated, in a task of its own; one task puts the tables together. Scoring covers all rows.

Defined results: a letter is a character of category L; a null text or one without a letter is `und` with score 0; ties
go to the language first in order; a table without labelled rows predicts `und` everywhere; an empty table gives an empty
one; repeated rows are scored alike. Texts are taken whole; words of any length are scored in pieces of bounded size.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.common import ddl, passing, ship, slices

ORDER = 4
PER_LANG = 1500
MAX_CHARS = 20_000
REJECT_RATE = 0.001
SLACK = 1.5
#: Numbers of words to which calibrating rows are cut; the threshold between two of them is interpolated.
LENGTHS = tuple(2**x for x in range(15))
#: Words that a worker remembers; at that many it starts afresh.
REMEMBERED = 100_000
#: Texts, and characters of new words, that are scored together; longer words are scored in pieces of this size.
_DOCS, _TOGETHER = 64, 400_000
#: Characters of words that a worker remembers.
_REMEMBERED_CHARS = 20_000_000


#: Runs of what Python takes for word characters, less digits and underscores; a few other numbers are left in them.
_WORD = re.compile(r"[^\W\d_]+")
_EDGE = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: str | None) -> list[str]:
    """Runs of characters of category L, in lower case."""
    words = _WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, words)):
        return words
    return ["".join(run) for w in words for letters, run in groupby(w, str.isalpha) if letters]


def _grams(codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n characters that end at each of the places; a place before the first character counts as none."""
    h = np.full(len(at), n, np.uint64)
    for back in range(n - 1, -1, -1):
        places = at - back
        h = (h ^ (np.where(places >= 0, codes[places], 0).astype(np.uint64) + np.uint64(1))) * _MIX
        h ^= h >> np.uint64(29)
        h *= _STEP
    return h


def _contexts(codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n - 1 characters before each of the places."""
    return _grams(codes, at - 1, n - 1) if n > 1 else np.full(len(at), 7, np.uint64)


def _layout(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character codes of " word " for each word, each character's place in it, and where the words start."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    inside = np.arange(len(codes)) - np.repeat(starts, sizes)
    return codes, inside, starts


@dataclass
class Model:
    """By order n - 1: keys, sorted hashes of the n-grams that any language has, with log probabilities by language, and
    context_keys with the logs of the weights of the order below (0 where a language lacks the context)."""

    langs: list[str]
    base: float
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    context_keys: list[np.ndarray]
    weights: list[np.ndarray]
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    z: np.ndarray | None = None  # by LENGTHS
    temperature: float = 10.0

    def char_logs(self, codes: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Log probability of each character by language; 0 for the blank before a word.

        An n-gram of the table gives the whole interpolated probability at once. One that no language has leaves the
        weight of its context, and the order below, so most characters take one search."""
        out = np.zeros((len(codes), len(self.langs)))
        todo = np.flatnonzero(inside > 0)
        for n in range(len(self.keys), 0, -1):
            here = inside[todo] >= n - 1
            at, rest = todo[here], todo[~here]
            row = _find(self.keys[n - 1], _grams(codes, at, n))
            hit = row >= 0
            out[at[hit]] += self.logs[n - 1][row[hit]]
            at = at[~hit]
            row = _find(self.context_keys[n - 1], _contexts(codes, at, n))
            out[at[row >= 0]] += self.weights[n - 1][row[row >= 0]]
            todo = np.concatenate((rest, at))
        out[todo] += np.log(self.base)
        return out

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Negative log probability of each word (with the blank that ends it) by language."""
        codes, inside, starts = _layout(words)
        return -np.add.reduceat(self.char_logs(codes, inside), starts, axis=0)

    def long_word_score(self, word: str, piece: int) -> np.ndarray:
        """The same for one word, by pieces that each see the characters before them that their n-grams reach back to."""
        codes, inside, _ = _layout([word])
        total = np.zeros(len(self.langs))
        for at in range(0, len(codes), piece):
            low = max(0, at - len(self.keys) + 1)
            total -= self.char_logs(codes[low : at + piece], inside[low : at + piece])[at - low :].sum(axis=0)
        return total


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted hashes, -1 for those that aren't there."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def fit(samples: dict[str, list[str]], order: int = ORDER, reject_rate: float = REJECT_RATE, slack: float = SLACK) -> Model:
    """samples: texts by language. Every fifth text calibrates, the others are counted."""
    langs = sorted(samples)
    model = merged_tables({k: count_language(samples[k], order) for k in langs}, order)
    return calibrated(model, {k: calibration_of(model, k, samples[k]) for k in langs}, reject_rate, slack)


def count_language(texts: list[str], order: int = ORDER) -> tuple[set[int], list[tuple | None], list[tuple | None]]:
    """A language's characters and, by order, its n-grams (keys, discounted shares, contexts, n-grams below) and contexts
    (keys, weights of the order below)."""
    counts = Counter(w for i, t in enumerate(texts) if i % 5 or len(texts) < 5 for w in words_of(t))
    letters, grams, contexts = {_EDGE}, [None] * order, [None] * order
    words = list(counts)
    if not words:
        return letters, grams, contexts
    codes, inside, _ = _layout(words)
    weight = np.repeat(np.fromiter(counts.values(), np.float64, len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)
    letters.update(np.unique(codes).tolist())
    for n in range(1, order + 1):
        at = np.flatnonzero((inside > 0) & (inside >= n - 1))
        amount = weight[at]
        if n < order:
            # Lower orders count the different characters before an n-gram; one that starts at a word's edge keeps its count.
            edge = inside[at] == n - 1
            within = at[~edge]
            _, first = np.unique(_grams(codes, within, n + 1), return_index=True)
            at, amount = np.concatenate((within[first], at[edge])), np.concatenate((np.ones(len(first)), weight[at[edge]]))
        keys, first, index = np.unique(_grams(codes, at, n), return_index=True, return_inverse=True)
        count = np.bincount(index, amount)
        ones, twos = np.sum(count == 1), np.sum(count == 2)
        discount = float(np.clip(ones / (ones + 2 * twos), 0.1, 0.9)) if ones else 0.5
        own_context = _contexts(codes, at[first], n)
        below = _grams(codes, at[first], n - 1) if n > 1 else own_context
        ckeys, cindex = np.unique(own_context, return_inverse=True)
        total, kinds = np.bincount(cindex, count), np.bincount(cindex)
        grams[n - 1] = (keys, np.maximum(count - discount, 0) / total[cindex], own_context, below)
        contexts[n - 1] = (ckeys, np.minimum(1.0, discount * kinds / total))
    return letters, grams, contexts


def merged_tables(parts: dict[str, tuple], order: int = ORDER) -> Model:
    """The model of all languages, not calibrated yet; a label whose texts hold no letter is none."""
    langs = sorted(k for k, part in parts.items() if part[1][0] is not None)
    base = 1.0 / (len({_EDGE}.union(*(parts[k][0] for k in langs))) + 1)
    of = lambda i, n: [(k, *parts[k][i][n]) for k in langs if parts[k][i][n] is not None]
    return Model(langs, base, *_tables([of(1, n) for n in range(order)], [of(2, n) for n in range(order)], langs, base))


def _tables(grams: list[list[tuple]], contexts: list[list[tuple]], langs: list[str], base: float) -> tuple[list[np.ndarray], ...]:
    """The model's arrays: discounted shares of all languages in one table for each order, then, from the lowest order
    up, each n-gram's share plus its context's weight times the probability of the n-gram below."""
    keys, logs, context_keys, weights = [], [], [], []
    lower: np.ndarray | None = None
    for own, ctx in zip(grams, contexts):
        ck = np.unique(np.concatenate([k for _, k, _ in ctx])) if ctx else np.zeros(0, np.uint64)
        w = np.ones((len(ck), len(langs)))
        for lang, k, v in ctx:
            w[np.searchsorted(ck, k), langs.index(lang)] = v
        gk = np.unique(np.concatenate([x[1] for x in own])) if own else np.zeros(0, np.uint64)
        p, its_context, below = np.zeros((len(gk), len(langs))), np.zeros(len(gk), np.uint64), np.zeros(len(gk), np.uint64)
        for lang, k, v, c, u in own:
            at = np.searchsorted(gk, k)
            p[at, langs.index(lang)], its_context[at], below[at] = v, c, u
        if len(gk):
            p += w[np.searchsorted(ck, its_context)] * (base if lower is None else lower[np.searchsorted(keys[-1], below)])
        keys.append(gk)
        logs.append(np.log(p))
        context_keys.append(ck)
        weights.append(np.log(w))
        lower = p
    return keys, logs, context_keys, weights


def calibration_of(model: Model, lang: str, texts: list[str]) -> tuple | None:
    """What a language's held-out texts tell: mean and spread of its cross-entropy, distances of rows cut to LENGTHS,
    and cross-entropies of the rows; None if there are fewer than two."""
    if lang not in model.langs:
        return None
    scorer, i = Scorer(model), model.langs.index(lang)
    own = [words_of(t) for k, t in enumerate(texts) if k % 5 == 0]
    scored = []
    for at in range(0, len(own), _DOCS):
        scorer.prepare(own[at : at + _DOCS])
        scored += [(w, scorer.entropies(w), [scorer.entropies(w[:n])[0] for n in LENGTHS if len(w) >= n]) for w in own[at : at + _DOCS] if w]
    # A row that is more like another language has a wrong label, most likely, and would stretch the threshold.
    scored = [x for x in scored if np.argmin(x[1][0]) == i]
    if len(scored) < 2:
        return None
    h, n = np.array([x[1][0][i] for x in scored]), np.array([x[1][1] for x in scored], float)
    mean = float(np.average(h, weights=n))
    spread = float(np.sqrt(np.median((h - mean) ** 2 * n)) / 0.6745 + 1e-9)
    zs = [[float((x[2][k][i] - mean) / (spread / np.sqrt(size))) for x in scored if len(x[2]) > k and np.argmin(x[2][k]) == i] for k, size in enumerate(LENGTHS)]
    return mean, spread, zs, np.array([x[1][0] for x in scored])


def calibrated(model: Model, found: dict[str, tuple | None], reject_rate: float = REJECT_RATE, slack: float = SLACK) -> Model:
    k = len(model.langs)
    model.mean, model.spread = np.full(k, 5.0), np.ones(k)
    zs, tops, rows = [[] for _ in LENGTHS], [], []
    for i, lang in enumerate(model.langs):
        if found.get(lang) is None:
            continue
        model.mean[i], model.spread[i], own, entropies = found[lang]
        for all_, z in zip(zs, own):
            all_ += z
        tops += [i] * len(entropies)
        rows += list(entropies)
    # Longer texts vary by more than the root of their words tells, so the threshold doesn't fall with length.
    model.z = np.maximum.accumulate([max(4.0, float(np.quantile(x, 1 - reject_rate))) if x else 4.0 for x in zs]) * slack
    if not rows:
        model.z[:] = np.inf
    if rows:
        e, y = np.array(rows), np.array(tops)
        loss = lambda t: np.mean(np.logaddexp.reduce(-e * t, axis=1) + e[np.arange(len(y)), y] * t)
        model.temperature = min((2.0**x for x in range(0, 9)), key=loss)
    return model


class Scorer:
    """A model with a bounded table of the words that it has scored."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, int] = {}
        self.held = 0
        self.rows = np.zeros((1024, len(model.langs)))

    def _learn(self, words: list[str]) -> None:
        at = len(self.known)
        while at + len(words) > len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        long = len(words) == 1 and len(words[0]) > _TOGETHER
        self.rows[at : at + len(words)] = self.model.long_word_score(words[0], _TOGETHER) if long else self.model.word_scores(words)
        self.known.update(zip(words, range(at, at + len(words))))
        self.held += sum(map(len, words))

    def prepare(self, texts: list[list[str]]) -> None:
        """Learn the new words of some texts, as many at once as have _TOGETHER characters."""
        if len(self.known) > REMEMBERED or self.held > _REMEMBERED_CHARS:
            self.known.clear()
            self.held = 0
        together, size = [], 0
        for w in set().union(*texts).difference(self.known):
            if together and size + len(w) + 2 > _TOGETHER:
                self._learn(together)
                together, size = [], 0
            together.append(w)
            size += len(w) + 2
        if together:
            self._learn(together)

    def entropies(self, words: list[str]) -> tuple[np.ndarray, int] | None:
        """Cross-entropy per character by language, and the number of words; None without any. The words are known."""
        if not words:
            return None
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return self.rows[at].sum(axis=0) / (sum(map(len, words)) + len(words)), len(words)

    def predictions(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """Language, score, cross-entropy and whether rejected, of each text."""
        out: list[tuple[str, float, float | None, bool]] = []
        for at in range(0, len(texts), _DOCS):
            words = [words_of(t) for t in texts[at : at + _DOCS]]
            self.prepare(words)
            out += [self.predict(w) for w in words]
        return out

    def predict(self, words: list[str]) -> tuple[str, float, float | None, bool]:
        m = self.model
        found = self.entropies(words) if m.langs else None
        if found is None:
            return "und", 0.0, None, True
        e, n = found
        best = int(np.argmin(e))
        score = float(1.0 / np.exp(-(e - e[best]) * m.temperature).sum())
        far = (e[best] - m.mean[best]) / (m.spread[best] / np.sqrt(n))
        return m.langs[best], score, float(e[best]), bool(far > np.interp(np.log2(n), np.log2(LENGTHS), m.z))


def in_sample(key: Column, fold: int = 4, held: int = 2) -> Column:
    """Rows that may be learnt from: crc32 of the key as text, modulo fold, isn't held. A null key counts as held out."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % fold != held, F.lit(False))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG, max_chars: int = MAX_CHARS) -> Model:
    """Fit on a bounded sample of the labelled rows given; see the module's text for the bound."""
    spark = docs.sparkSession
    ship(spark)
    every = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text"), F.pmod(F.xxhash64(F.lit(17), key), F.lit(1 << 40)).alias("_hash"))
    short = F.length("_text") <= max_chars
    counts = every.groupBy("_lang").agg(F.count_if(short).alias("n"), F.min(F.length("_text")).alias("least")).collect()  # a row for each label
    if not counts:
        return Model([], 1.0, [], [], [], [])
    # A threshold by language on the hash lets about 1.2 times per_lang rows through before anything is shuffled.
    bars = spark.createDataFrame([(r["_lang"], int(min(1.0, 1.2 * per_lang / r["n"]) * (1 << 40)) if r["n"] else None, r["least"]) for r in counts], "_lang string, _bar long, _least int")
    wanted = F.when(F.col("_bar").isNotNull(), short & (F.col("_hash") < F.col("_bar"))).otherwise(F.length("_text") == F.col("_least"))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_hash", "_text"))
    most = F.when(F.col("_bar").isNotNull(), per_lang).otherwise(1)
    rows = every.join(F.broadcast(bars), "_lang").filter(wanted).withColumn("_text", F.substr("_text", F.lit(1), F.lit(max_chars)))
    sample = rows.withColumn("_rank", rank).filter(F.col("_rank") <= most).select("_lang", "_rank", "_text")

    def counted(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame.sort_values("_rank")
        return pd.DataFrame({"lang": [own["_lang"].iloc[0]], "part": [pickle.dumps(count_language(own["_text"].tolist()))]})

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {k: pickle.loads(p) for b in batches for k, p in zip(*(b.column(n).to_pylist() for n in ("lang", "part")))}
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(merged_tables(parts))]})

    # What one task and the driver get are tables of the bounded sample, never its texts.
    parts = sample.groupBy("_lang").applyInPandas(counted, "lang string, part binary")
    model = pickle.loads(parts.coalesce(1).mapInArrow(together, "model binary").first()["model"])
    shared = spark.sparkContext.broadcast(model)

    def measured(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame.sort_values("_rank")
        name = own["_lang"].iloc[0]
        return pd.DataFrame({"lang": [name], "found": [pickle.dumps(calibration_of(shared.value, name, own["_text"].tolist()))]})

    found = sample.groupBy("_lang").applyInPandas(measured, "lang string, found binary").collect()  # numbers of held-out rows
    return calibrated(model, {r["lang"]: pickle.loads(r["found"]) for r in found})


def identify(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add lang_pred, lang_score, lang_entropy and lang_rejected to every row, from its text alone."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the training sample
    fields = passing(docs, text, keep_text, "lang_pred", "lang_score", "lang_entropy", "lang_rejected")
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches, 1024):
            rows = scorer.predictions(batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_pydict(
                {n: batch.column(n) for n in names}
                | {
                    "lang_pred": pa.array([r[0] for r in rows], pa.string()),
                    "lang_score": pa.array([r[1] for r in rows], pa.float64()),
                    "lang_entropy": pa.array([r[2] for r in rows], pa.float64()),
                    "lang_rejected": pa.array([r[3] for r in rows], pa.bool_()),
                }
            )

    schema = ddl(fields, "lang_pred string, lang_score double, lang_entropy double, lang_rejected boolean")
    return docs.withColumn("_text", F.col(text).cast("string")).mapInArrow(run, schema)


def op7_langid(documents: DataFrame) -> DataFrame:
    """One row per document with its predicted language."""
    model = train(documents.filter(in_sample(F.col("doc_id"))))
    rows = documents.select("doc_id", (~in_sample(F.col("doc_id"))).alias("held_out"), "text")
    return identify(rows, model, keep_text=False).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), "lang_entropy", F.col("lang_rejected").alias("rejected"))
