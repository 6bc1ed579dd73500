"""Toxicity scores by weak supervision.

1. Lexicons: words and word beginnings that mark toxic rows among the labelled
   training rows are dealt into many lexicon voters; pattern voters look at shouting,
   masked letters and the like. A voter fires or abstains on a text.
2. Label model: a generative model of the votes, fitted by expectation maximisation
   without labels, estimates each voter's firing rates in either class (its accuracy) and
   the correlations between voters within a class; a voter's evidence is divided
   by the number of voters it effectively repeats. It turns votes into posterior labels.
3. A linear classifier (logistic regression) is trained on the posterior labels and
   scores every text.

The fit uses a bounded sample of labelled rows (``sample_rows`` a class, whole texts); scoring
reads all of every text.
"""
from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import stored

#: Labelled rows of either class the model is fitted on, in expectation.
SAMPLE_ROWS = 10_000
#: Features kept for lexicons and classifier; lexicon voters.
FEATURES, LEXICONS = 4000, 16
#: A feature marks a class if its log odds ratio is so large and so many standard errors from 0.
MIN_ODDS, MIN_Z = 2.5, 2.5
STEMS = (4, 5)
THRESHOLD = 0.3
WORD = re.compile(r"\w+")
#: Pattern voters, by name. Matched on the raw text.
PATTERNS = {
    "shouting": re.compile(r"\b[^\W\d_a-z]{3,}\b[^\n]{0,20}!!"),
    "bursts": re.compile(r"[!?]{3,}"),
    "masked": re.compile(r"\b\w[*@#$]+\w*\b"),
    "stretched": re.compile(r"(\w)\1{3,}"),
}


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def features(text: str) -> set[str]:
    """Distinct words of the whole text and their beginnings (``abcd~``), lower-cased."""
    words = set(WORD.findall(text.lower()))
    out = set(words)
    for n in STEMS:
        out.update(w[:n] + "~" for w in words if len(w) > n)
    return out


def patterns(text: str) -> list[str]:
    return [name for name, p in PATTERNS.items() if p.search(text)]


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``text, toxic, weight``: up to ``sample_rows`` labelled rows of either class in expectation.

    Rows are picked by a hash of the id among those not held out and weigh the inverse
    of their rate. A document with several labels is toxic if one says so; null labels
    and null ids are left out. The picked ids are a bounded table, so they are broadcast.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic")).where(~held_out(F.col("doc_id")))
    n = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).where("toxic in (0, 1)").collect()}
    rate = F.lit(0.0)
    for cls, m in n.items():
        rate = F.when(F.col("toxic") == cls, min(1.0, sample_rows / m)).otherwise(rate)
    picked = known.withColumn("rate", rate).where(
        F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 20)) < F.col("rate") * (1 << 20))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(picked), "doc_id").select("text", "toxic", F.try_divide(F.lit(1.0), "rate").alias("weight"))


def learn_features(rows: DataFrame, most: int = FEATURES) -> dict[str, float]:
    """Features that mark toxic rows: feature -> log odds ratio, the ``most`` clearest.

    Common words that merely lean to a class are left out: in a long text their
    small weights would add up.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by = {0: Counter(), 1: Counter()}
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by[y].update(features(text))
            names = sorted(set(by[0]) | set(by[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([by[0][f] for f in names], pa.int64()),
                 pa.array([by[1][f] for f in names], pa.int64())], names=["feature", "clean", "toxic"])

    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    df = rows.select("text", "toxic").mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(
        F.sum("clean").alias("c0"), F.sum("toxic").alias("c1")).where("c0 + c1 >= 5")
    odds = F.log((F.col("c1") + 0.5) / (n1 - F.col("c1") + 0.5)) - F.log((F.col("c0") + 0.5) / (n0 - F.col("c0") + 0.5))
    spread = F.sqrt(1 / (F.col("c1") + 0.5) + 1 / (F.col("c0") + 0.5))
    top = df.select("feature", odds.alias("odds"), (odds / spread).alias("z")).where(
        (F.col("odds") >= MIN_ODDS) & (F.col("z") >= MIN_Z)).orderBy(F.col("z").desc(), "feature").limit(most).collect()
    return {r.feature: r.odds for r in top}


class Voters:
    """Lexicon and pattern voters. Each fires or abstains; a text's votes are a bit mask."""

    def __init__(self, odds: dict[str, float], lexicons: int = LEXICONS) -> None:
        marked = sorted(odds)
        self.bit = {f: zlib.crc32(f.encode()) % lexicons for f in marked}
        self.size = lexicons + len(PATTERNS)
        self.first = lexicons
        self.names = list(PATTERNS)

    def votes(self, found: set[str], shapes: list[str]) -> int:
        mask = 0
        for f in found:
            b = self.bit.get(f)
            if b is not None:
                mask |= 1 << b
        for p in shapes:
            mask |= 1 << (self.first + self.names.index(p))
        return mask


class LabelModel:
    """Firing rates per class, class-conditional correlations and prior, by EM over vote patterns."""

    def __init__(self, masks: np.ndarray, weights: np.ndarray, size: int, prior: float, lead: int = LEXICONS,
                 rounds: int = 50) -> None:
        v = ((masks[:, None] >> np.arange(size)) & 1).astype(float)
        w = weights / max(weights.sum(), 1e-12)
        self.size = size
        # start: a text on which one of the leading (lexicon) voters fires is likely toxic
        hits = v[:, :lead].sum(1)
        p = np.where(hits > 0, 0.98, 0.02)
        self.repeat = np.ones(size)
        self.prior = prior
        for _ in range(rounds):
            a, b = w * p, w * (1 - p)
            self.rate1 = (a @ v + 1e-4) / (a.sum() + 2e-4)
            self.rate0 = (b @ v + 1e-4) / (b.sum() + 2e-4)
            self.correlation = (self._correlate(v, a, self.rate1), self._correlate(v, b, self.rate0))
            # a voter that moves with others inside the classes counts as a fraction of one
            both = np.maximum(0, (self.correlation[0] + self.correlation[1]) / 2)
            np.fill_diagonal(both, 1.0)
            self.repeat = both.sum(1)
            new = self.posterior(masks)
            if np.abs(new - p).max() < 1e-6:
                break
            p = new

    @staticmethod
    def _correlate(v: np.ndarray, w: np.ndarray, rate: np.ndarray) -> np.ndarray:
        w = w / max(w.sum(), 1e-12)
        centred = v - rate
        cov = (centred * w[:, None]).T @ centred
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        return cov / sd[:, None] / sd[None, :]

    def posterior(self, masks: np.ndarray) -> np.ndarray:
        """Probability that a text with these votes is toxic."""
        v = (np.asarray(masks)[:, None] >> np.arange(self.size)) & 1
        fire = np.log(self.rate1 / self.rate0) / self.repeat
        rest = np.log((1 - self.rate1) / (1 - self.rate0)) / self.repeat
        z = math.log(self.prior / (1 - self.prior)) + v @ fire + (1 - v) @ rest
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


class Scorer:
    """A linear model over features and patterns."""

    def __init__(self, weights: dict[str, float], intercept: float) -> None:
        self.weights, self.intercept = weights, intercept

    def score(self, text: str) -> float:
        get = self.weights.get
        z = self.intercept
        for f in sorted(x for x in features(text) if x in self.weights):
            z += get(f)
        for p in patterns(text):
            z += get("pattern " + p, 0.0)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Scorer:
    """Fit voters, label model and classifier; see the module's text. Without rows of both
    classes every score is the share of toxic training rows (0 without any)."""
    rows = stored(training_rows(docs, labels, sample_rows), "toxic-rows")
    share = {r.toxic: (r.n, r.w) for r in rows.groupBy("toxic").agg(
        F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    if len(share) < 2:
        return Scorer({}, 50.0 if 1 in share else -50.0)
    prior = share[1][1] / (share[0][1] + share[1][1])
    odds = learn_features(rows)
    voters = Voters(odds)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, masks = [], []
            for text in b.column(0).to_pylist():
                found, shapes = features(text), patterns(text)
                masks.append(voters.votes(found, shapes))
                tokens.append(sorted(f for f in found if f in odds) + ["pattern " + p for p in shapes])
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens, pa.list_(pa.string())), pa.array(masks, pa.int64()), b.column(1)],
                names=["tokens", "mask", "weight"])

    voted = stored(rows.select("text", "weight").mapInArrow(vote, "tokens array<string>, mask long, weight double"),
                   "toxic-votes")
    # at most 2 ** voters patterns, however many rows
    seen = voted.groupBy("mask").agg(F.sum("weight").alias("w")).collect()
    masks = np.array([r.mask for r in seen], dtype=np.int64)
    model = LabelModel(masks, np.array([r.w for r in seen]), voters.size, prior)
    p = {int(m): float(x) for m, x in zip(masks, model.posterior(masks))}
    table = docs.sparkSession.createDataFrame(list(p.items()), "mask long, p double")
    labelled = voted.join(F.broadcast(table), "mask").select("tokens", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), (F.col("weight") * F.col("p")).alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (F.col("weight") * (1 - F.col("p"))).alias("weight")))).alias("x")
    ).select("tokens", "x.label", "x.weight").where("weight > 1e-6")
    vocabulary = sorted(odds) + ["pattern " + p for p in PATTERNS]
    vec = CountVectorizerModel.from_vocabulary(vocabulary, "tokens", "features", binary=True)
    fit = LogisticRegression(maxIter=60, regParam=1e-3, standardization=False, weightCol="weight").fit(
        vec.transform(labelled).select("features", "label", "weight"))
    coef = fit.coefficients.toArray()
    return Scorer({f: float(c) for f, c in zip(vocabulary, coef) if c}, float(fit.intercept))


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs`` (``doc_id, text``).

    Null text scores like empty text. Rows stay as they come, repeated and null
    doc_ids too (a null id hashes like empty text); other columns are not read. One
    narrow pass; the model has at most ``FEATURES`` weights.
    """
    shared = docs.sparkSession.sparkContext.broadcast((scorer.weights, scorer.intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(*shared.value)
        for b in batches:
            got = [s.score(t or "") for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(got, pa.float64()),
                 pa.array([int(x >= THRESHOLD) for x in got], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Train on the labelled rows and score every document."""
    return score(docs, train(docs, labels, sample_rows))
