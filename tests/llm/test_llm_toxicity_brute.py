"""The toxicity query's whole chain against a brute-force version in plain Python and numpy."""
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from foldspark.llm import toxicity

SHAPES = [r"\b[^\W\d_a-z]{3,}\b[^\n]{0,20}!!", r"[!?]{3,}", r"\b\w[*@#$]+\w*\b", r"(\w)\1{3,}"]
NAMES = ["shouting", "bursts", "masked", "stretched"]


def marks(text):
    """Words, their beginnings of 4 and 5 letters, and names of the patterns that occur."""
    found = set()
    for word in re.findall(r"\w+", text.lower()):
        found.add(word)
        if len(word) > 4:
            found.add(word[:4] + "~")
        if len(word) > 5:
            found.add(word[:5] + "~")
    return found, [n for n, s in zip(NAMES, SHAPES) if re.search(s, text)]


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 4 == 2


def correlation(fires, share, rate):
    """Correlation of every two voters under row shares that sum to one."""
    size = len(rate)
    cov = [[sum(s * (f[i] - rate[i]) * (f[j] - rate[j]) for s, f in zip(share, fires)) for j in range(size)] for i in range(size)]
    sd = [math.sqrt(max(cov[i][i], 1e-9)) for i in range(size)]
    return [[cov[i][j] / sd[i] / sd[j] for j in range(size)] for i in range(size)]


def posteriors(fires, prior, lexicons):
    """Label model row by row: rates, correlations and posteriors until nothing moves."""
    n, size = len(fires), len(fires[0])
    p = [0.98 if any(f[:lexicons]) else 0.02 for f in fires]
    for _ in range(50):
        rates, tables = [], []
        for own in (p, [1 - x for x in p]):
            total = sum(own) / n
            rate = [(sum(x * f[i] for x, f in zip(own, fires)) / n + 1e-4) / (total + 2e-4) for i in range(size)]
            rates.append(rate)
            tables.append(correlation(fires, [x / n / total for x in own], rate))
        repeat = [sum(1.0 if i == j else max(0.0, (tables[0][i][j] + tables[1][i][j]) / 2) for j in range(size))
                  for i in range(size)]
        new = []
        for f in fires:
            z = math.log(prior / (1 - prior))
            for i in range(size):
                a, b = (rates[0][i], rates[1][i]) if f[i] else (1 - rates[0][i], 1 - rates[1][i])
                z += math.log(a / b) / repeat[i]
            new.append(1 / (1 + math.exp(-max(-50.0, min(50.0, z)))))
        if max(abs(x - y) for x, y in zip(new, p)) < 1e-6:
            break
        p = new
    return p


def logistic(x, p, penalty=1e-3):
    """Weights and intercept of the penalised logistic regression on soft labels, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.diag([penalty] * (x.shape[1] - 1) + [0.0])
    beta = np.zeros(x.shape[1])
    loss = lambda b: np.mean(np.logaddexp(0, x @ b) - p * (x @ b)) + b @ ridge @ b / 2
    for _ in range(200):
        q = 1 / (1 + np.exp(-(x @ beta)))
        slope = x.T @ (q - p) / len(x) + ridge @ beta
        step = np.linalg.lstsq((x * (q * (1 - q))[:, None]).T @ x / len(x) + ridge, slope, rcond=None)[0]
        size = 1.0
        while loss(beta - size * step) > loss(beta) and size > 1e-9:
            size /= 2
        beta = beta - size * step
        if np.abs(slope).max() < 1e-10:
            break
    return beta


def brute(docs, labels):
    """``(held out, score)`` of every row of ``docs``."""
    truth = {}
    for i, y in labels:
        if i is not None and y is not None:
            truth[i] = max(y, truth.get(i, y))
    rows = [(marks(t or ""), truth[i]) for i, t in docs if i in truth and not held(i)]
    n1 = sum(y for _, y in rows)
    n0 = len(rows) - n1
    odds = {}
    for f in {f for (found, _), _ in rows for f in found}:
        c1 = sum(f in found for (found, _), y in rows if y)
        c0 = sum(f in found for (found, _), y in rows if not y)
        value = math.log((c1 + 0.5) / (n1 - c1 + 0.5)) - math.log((c0 + 0.5) / (n0 - c0 + 0.5))
        if c0 + c1 >= 5 and value >= 2.5 and value / math.sqrt(1 / (c1 + 0.5) + 1 / (c0 + 0.5)) >= 2.5:
            odds[f] = value
    lexicons = 16
    fires = [[int(any(zlib.crc32(f.encode()) % lexicons == k for f in found if f in odds)) for k in range(lexicons)]
             + [int(n in shapes) for n in NAMES] for (found, shapes), _ in rows]
    p = np.array(posteriors(fires, n1 / len(rows), lexicons))
    names = sorted(odds)
    def vector(found, shapes):
        return [float(f in found) for f in names] + [float(n in shapes) for n in NAMES]
    beta = logistic(np.array([vector(*m) for m, _ in rows]), p)
    return [(held(i), 1 / (1 + math.exp(-(np.array(vector(*marks(t or ""))) @ beta[:-1] + beta[-1])))) for i, t in docs], odds


def fixture():
    r = random.Random(11)
    plain = ["river", "garden", "window", "market", "letter", "summer", "engine", "number", "paper", "stone", "music", "table"]
    bad = ["grubsnout", "mudbrain", "wretchling", "vilefoot", "rotface", "scumhat"]
    docs, labels = [], []
    for i in range(260):
        toxic = r.random() < 0.35
        text = [r.choice(plain) for _ in range(r.randint(3, 14))]
        if toxic and r.random() < 0.9:
            text += [r.choice(bad) for _ in range(r.randint(1, 3))]
        if r.random() < (0.4 if toxic else 0.05):
            text.append(r.choice(["GET OUT!!", "why?!?!", "d*mn", "noooooo"]))
        r.shuffle(text)
        docs.append((i, " ".join(text)))
        if r.random() < 0.9:
            labels.append((i, int(toxic)))
    docs += [(7, "river grubsnout"), (300, None), (301, ""), (None, "mudbrain table"), (302, "paper " * 3000 + "rotface")]
    labels += [(8, 1), (8, 0), (300, 0), (301, 0), (302, None), (None, 1), (999, 1)]
    return docs, labels


def test_query_equals_brute_force(spark):
    docs, labels = fixture()
    want, odds = brute(docs, labels)
    assert len(odds) >= 6
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    y = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    assert toxicity.learn_features(toxicity.training_rows(d, y)).keys() == odds.keys()
    got = toxicity.score_toxicity(d.coalesce(1), y).collect()
    assert [r.doc_id for r in got] == [i for i, _ in docs]
    for r, (out, score) in zip(got, want):
        assert r.held_out == out and abs(r.score - score) < 0.01
        assert r.predicted == int(r.score >= 0.3)
    assert {int(s >= 0.3) for _, s in want} == {0, 1}
