"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of a fixed insult lexicon and of a lexicon learned from the training rows (whole words and
word beginnings), nearness of its words to second-person words, shares of capitals, punctuation and obfuscation.
A row's features come from a lexicon that is counted without the row's fold. The calibration is fitted on margins of rows
whose labels had no part in them: for fold g, lexicons and trees are made without g, lexicons of another fold's rows
without that fold as well. A score is the centred isotonic fit of the margin: linear between the middles of its steps.
Learning takes at most SAMPLE labelled rows, those of least hash: the bound is the parameter `sample`, and it bounds what
the driver gets, dense features and counted keys. Scoring is a map over whole texts without shuffle, SLICE at a time.

Edge cases: null and empty texts have all features 0 and get the score that the model gives them; without both labels
among the training rows, the score is the training rate, or 0.5 without rows; a null doc_id is not held out; repeated
ids among labels count as toxic if any of them is; other columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, materialize, ship_code

SAMPLE = 20_000
FOLDS = 4
#: Toxic documents that hold a learned key, at least.
LEAST_TOXIC = 3
#: Keys that a task counts before it hands them on, and texts that are held at once.
KEYS_HELD, SLICE = 40_000, 100
THRESHOLD = 0.3
STEM = (4, 6)

#: Insults in four languages.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb trash garbage worthless pathetic disgusting loser losers scum clown clowns fool imbecile jerk "
    "idiota imbécil estúpido estúpida basura inútil asqueroso payaso patético tonto escoria perdedor "
    "idiote imbécile stupide ordure déchet minable dégoûtant perdant crétin pathétique clownesque abruti "
    "dumm dummkopf trottel abschaum müll wertlos erbärmlich widerlich versager blöd arschloch".split()
)
#: Second-person words in four languages.
SECOND = frozenset("you your yours yourself ur u tu te ti toi ton ta tes vous votre vos du dich dir dein deine ihr euch sie usted ustedes tus vosotros".split())
#: Digits and signs used for letters.
DISGUISE = str.maketrans("013457@$!", "oieastasi")

WORD = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"\S+")


def words_of(text: str) -> list[str]:
    return WORD.findall(unicodedata.normalize("NFC", text).lower())


def keys_of(words) -> set[str]:
    """What the learned lexicon may hold: words, and beginnings of longer words (marked by a star)."""
    found = set(words)
    for w in list(found):
        found.update(w[:n] + "*" for n in STEM if len(w) >= n)
    return found


def plain_features(text: str, words: list[str]) -> tuple[list[float], list[str]]:
    """What no lexicon decides (capitals, punctuation, spelled-out and mixed words, lengths), and the undisguised mixed words."""
    n, chars = max(len(words), 1), max(len(text), 1)
    letters = sum(map(len, words))
    capitals = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    shouted = len(re.findall(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b", text))
    mixed, uncovered = 0, []
    for token in text.split():
        if not token.isalpha():
            core = token.strip(".,;:!?\"'()[]|")
            if core and not core.isalpha():
                mixed += any(ch.isalpha() for ch in core)
                uncovered.append(re.sub(r"[^\w]|_", "", core.translate(DISGUISE).lower()))
    spelled = len(re.findall(r"\b(?:\w[ .\-_*]){3,}\w\b", text))
    return [
        capitals / max(letters, 1), 100.0 * shouted / n, 100.0 * text.count("!") / chars, 100.0 * text.count("?") / chars,
        100.0 * mixed / n, 100.0 * spelled / n, math.log1p(n), math.log1p(chars),
    ], uncovered


def lexicon_features(words: list[str], uncovered: list[str], second: np.ndarray, lexicon: dict[str, float]) -> list[float]:
    """Counts and densities of insults and learned keys, and how many of their places are near a second-person word."""
    n = max(len(words), 1)
    whole, stems, best, insults, places = [], [], 0.0, 0, []
    known: dict[str, tuple[float, float, bool]] = {}
    for i, w in enumerate(words):
        got = known.get(w)
        if got is None:
            got = known[w] = (lexicon.get(w, 0.0), max([lexicon.get(w[:k] + "*", 0.0) for k in STEM if len(w) >= k], default=0.0), w in INSULTS)
        a, b, c = got
        if a:
            whole.append(a)
        if b:
            stems.append(b)
        if c:
            insults += 1
        if c or a > 1.5 or b > 1.5:
            places.append(i)
        best = max(best, a, b)
    near = 0
    if len(second) and places:
        j = np.searchsorted(second, places)
        near = int(((np.abs(second[np.minimum(j, len(second) - 1)] - places) <= 5) | (np.abs(second[np.maximum(j - 1, 0)] - places) <= 5)).sum())
    density = lambda x: 100.0 * x / n
    hidden = sum(u in INSULTS or lexicon.get(u, 0.0) > 1.5 for u in uncovered)
    span = (places[-1] - places[0]) / n if len(places) > 1 else 0.0
    return [
        insults, density(insults), len(whole), density(len(whole)), sum(whole), density(sum(whole)), len(stems), density(len(stems)), sum(stems), density(sum(stems)), best,
        len(places), density(len(places)), len({words[i] for i in places}), span, near, density(near), len(second), density(len(second)), density(hidden),
    ]


def features(text: str | None, lexicons: list[dict[str, float]]) -> list[list[float]]:
    """Dense features of a text by each lexicon."""
    text = text or ""
    words = words_of(text)
    plain, uncovered = plain_features(text, words)
    second = np.array([i for i, w in enumerate(words) if w in SECOND], int)
    return [plain + lexicon_features(words, uncovered, second, lexicon) for lexicon in lexicons]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def learned_lexicon(rows: DataFrame) -> list[tuple[str, list[int], list[int]]]:
    """Keys that tell the labels apart, with the documents of each label and fold that hold them.

    Keys are counted in slices of KEYS_HELD and summed by Spark. What weigh() would never weigh isn't collected: the rest is
    bounded by the sample, whose toxic documents hold each such key three times or more.
    """

    def keys(batches):
        schema = pa.schema([("key", pa.string()), ("side", pa.int32()), ("n", pa.int64())])
        counts: Counter = Counter()

        def counted():
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int32()), pa.array(counts.values(), pa.int64())], schema=schema)
            counts.clear()
            return out

        for batch in batches:
            for i in range(batch.num_rows):
                text, fold, toxic = (c[i].as_py() for c in batch.columns)
                side = toxic * FOLDS + fold
                counts.update((k, side) for k in keys_of(words_of(text or "")))
                if len(counts) > KEYS_HELD:
                    yield counted()
        if counts:
            yield counted()

    # Sums over (label, fold) in one pass.
    sums = [F.coalesce(F.sum(F.when(F.col("side") == t * FOLDS + f, F.col("n"))), F.lit(0)).alias(f"c{t}{f}") for t in (0, 1) for f in range(FOLDS)]
    found = mapped(rows.select("text", "fold", "toxic"), keys, "key string, side int, n long").groupBy("key").agg(*sums)
    toxic = sum((F.col(f"c1{f}") for f in range(FOLDS)), F.lit(0))
    best = found.filter(toxic >= LEAST_TOXIC).orderBy("key").collect()
    return [(r["key"], [r[f"c0{f}"] for f in range(FOLDS)], [r[f"c1{f}"] for f in range(FOLDS)]) for r in best]


def weigh(found, sizes, without: tuple[int, ...] = ()) -> dict[str, float]:
    """Log odds of each key, counted over all folds but those."""
    folds = [f for f in range(FOLDS) if f not in without]
    n0, n1 = (max(sum(sizes[t][f] for f in folds), 1) for t in (0, 1))
    out = {}
    for key, clean, toxic in found:
        a, b = sum(toxic[f] for f in folds), sum(clean[f] for f in folds)
        weight = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
        if a >= LEAST_TOXIC and weight > 0.7:
            out[key] = weight
    return out


class Trees:
    """Boosted trees of fixed depth on binned features, logistic loss, second-order leaves."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.1, bins: int = 32, least: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)], 1)
        rate = min(max(y.mean(), 1e-6), 1 - 1e-6)
        self.start, self.trees = math.log(rate / (1 - rate)), []
        f = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node, splits = np.zeros(len(y), int), []
            for level in range(self.depth):
                n = 1 << level
                feature, cut = np.zeros(n, int), np.full(n, self.bins + 1)
                gain = np.zeros(n)
                for j in range(x.shape[1]):
                    at = node * (self.bins + 1) + codes[:, j]
                    gs = np.bincount(at, g, n * (self.bins + 1)).reshape(n, -1).cumsum(1)
                    hs = np.bincount(at, h, n * (self.bins + 1)).reshape(n, -1).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    value = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    value[(hs < self.least) | (ht - hs < self.least)] = 0
                    k = value.argmax(1)
                    better = value[np.arange(n), k] > gain + 1e-9
                    gain[better], feature[better], cut[better] = value[np.arange(n), k][better], j, k[better]
                splits.append((feature, cut))
                node = 2 * node + (codes[np.arange(len(y)), feature[node]] > cut[node])
            n = 1 << self.depth
            leaf = self.rate * np.bincount(node, g, n) / (np.bincount(node, h, n) + 1)
            f += leaf[node]
            self.trees.append((splits, leaf))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        codes = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)], 1)
        f, rows = np.full(len(x), self.start), np.arange(len(x))
        for splits, leaf in self.trees:
            node = np.zeros(len(x), int)
            for feature, cut in splits:
                node = 2 * node + (codes[rows, feature[node]] > cut[node])
            f += leaf[node]
        return f


def isotonic(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centred isotonic fit: pools adjacent violators, and puts each pool's rate at its mean score. Far outside, 0 and 1."""
    order = np.argsort(scores, kind="stable")
    pools: list[list[float]] = []  # toxic rows, rows, sum of scores, highest score
    for s, t in zip(scores[order].tolist(), y[order].tolist()):
        pools.append([t, 1.0, s, s])
        while len(pools) > 1 and (pools[-2][3] == s or pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]):
            a, b = pools.pop(-2), pools[-1]
            pools[-1] = [a[0] + b[0], a[1] + b[1], a[2] + b[2], b[3]]
    xs = [total / n for _, n, total, _ in pools]
    ys = [toxic / n for toxic, n, _, _ in pools]
    return np.array([xs[0] - 10, *xs, xs[-1] + 10]), np.array([0.0, *ys, 1.0])


class Model:
    """Lexicon, trees and calibration; or a constant."""

    def __init__(self, constant: float):
        self.constant, self.lexicon, self.trees, self.curve = constant, {}, None, None

    def score(self, rows: list[list[float]]) -> np.ndarray:
        if self.trees is None or not rows:
            return np.full(len(rows), self.constant)
        return np.clip(np.interp(self.trees.margin(np.array(rows)), *self.curve), 0, 1)

    def of_texts(self, texts: pa.Array) -> np.ndarray:
        """Scores of the texts of a batch, a slice at a time."""
        parts = [self.score([features(t.as_py(), [self.lexicon])[0] for t in texts.slice(at, SLICE)]) for at in range(0, len(texts), SLICE)]
        return np.concatenate(parts) if parts else np.zeros(0)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """At most `sample` labelled rows that are not held out, those of least hash. The id list is bounded, so it may be broadcast."""
    ids = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(~held_out())
    ids = ids.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample).select("doc_id", "toxic", F.pmod(F.shiftright("h", 7), F.lit(FOLDS)).cast("int").alias("fold"))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    ship_code(docs.sparkSession)
    rows = materialize(training_rows(docs, labels, sample), "toxicity-rows")
    counted = rows.groupBy("fold", "toxic").count().collect()
    sizes = {t: [sum(r["count"] for r in counted if r["toxic"] == t and r["fold"] == f) for f in range(FOLDS)] for t in (0, 1)}
    n0, n1 = sum(sizes[0]), sum(sizes[1])
    model = Model(n1 / (n0 + n1) if n0 + n1 else 0.5)
    if n0 < 10 or n1 < 10:
        return model
    found = learned_lexicon(rows)
    lexicons = {w: weigh(found, sizes, w) for k in (1, 2) for w in combinations(range(FOLDS), k)}
    handed = docs.sparkSession.sparkContext.broadcast(lexicons)  # keys of the sample

    def dense(batches):
        lexicons = handed.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                fold = part.column(1).to_pylist()
                # For each fold g: by the lexicon without the row's fold and g.
                made = [features(t, [lexicons[tuple(sorted({f, g}))] for g in range(FOLDS)]) for t, f in zip(part.column(0).to_pylist(), fold)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.list_(pa.float64()))), part.column(1), part.column(2)], ["x", "fold", "toxic"])

    got = mapped(rows.select("text", "fold", "toxic"), dense, "x array<array<double>>, fold int, toxic int").toPandas()
    y, fold = got["toxic"].to_numpy(float), got["fold"].to_numpy()
    x = np.array([[list(v) for v in r] for r in got["x"]])
    own = x[np.arange(len(y)), fold]
    order = np.lexsort((*own.T, y, fold))
    x, own, y, fold = x[order], own[order], y[order], fold[order]
    unseen = np.zeros(len(y))
    for g in range(FOLDS):
        if (fold == g).any():
            unseen[fold == g] = Trees().fit(x[fold != g, g], y[fold != g]).margin(own[fold == g])
    model.lexicon, model.trees, model.curve = weigh(found, sizes), Trees().fit(own, y), isotonic(unseen, y)
    return model


def apply(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Every row with its score and decision."""
    handed = docs.sparkSession.sparkContext.broadcast(model)  # keys of the sample and a fixed number of trees

    def run(batches):
        model = handed.value
        for batch in batches:
            score = model.of_texts(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return mapped(docs.select("doc_id", held_out().alias("held_out"), "text"), run, "doc_id long, held_out boolean, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return apply(docs, fit(docs, labels, sample), threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, all columns, that the model does not reject."""
    model = fit(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")), labels, sample)
    handed = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        model = handed.value
        for batch in batches:
            yield batch.filter(pa.array(model.of_texts(batch.column(at)) < threshold))

    return mapped(docs, run, docs.schema)
