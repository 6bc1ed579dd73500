"""Language identification by prediction by partial matching.

Each language has a variable-order tree of byte contexts. A byte costs the
code length of its longest known context; where the byte is new to a context, the
escape probability of that context is paid and the next shorter one is
asked, down to a uniform code of 8 bits. Escapes follow method C (distinct
followers / (total + distinct followers)), without exclusions. Statistics are frozen
after training, so the exact code length of a text is a sum of table entries. The language with
the shortest code wins.

Training reads a bounded sample of labelled documents (``sample_bytes`` a language,
whole texts, picked by a hash of the text); scoring reads every byte of every text.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 3
#: Expected bytes of text a language is learned from.
SAMPLE_BYTES = 3_000_000
#: Expected bytes of all languages together: with many languages each is learned from less.
ALL_BYTES = 12_000_000
#: Languages whose tables share one set of keys; more languages come in several sets.
GROUP = 8
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2. A null id hashes like empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def padded(text: bytes, order: int = ORDER) -> np.ndarray:
    """The bytes behind ``order`` line ends, which stand for the text's start."""
    return np.frombuffer(b"\n" * order + text, dtype=np.uint8)


def grams(a: np.ndarray, size: int, start: int) -> np.ndarray:
    """Every run of ``size`` bytes that ends at position ``start`` or later, as a number."""
    out = np.zeros(len(a) - start, dtype=np.int64)
    for k in range(size):
        lo = start - (size - 1) + k
        out = (out << 8) | a[lo:len(a) - (size - 1) + k]
    return out


class Trees:
    """Frozen context trees of all languages, as sorted arrays a order."""

    def __init__(self, langs: list[str], counts: dict[int, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> None:
        """``counts[k]``: sorted runs of k+1 bytes and their counts, one column a language."""
        self.langs, self.order = langs, order
        n = len(langs)
        self.keys: list[np.ndarray] = []
        self.cost: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []
        for k in range(order + 1):
            key, c = counts.get(k, (np.zeros(0, np.int64), np.zeros((0, n), np.int64)))
            context, where = np.unique(key >> 8, return_inverse=True)
            total = np.zeros((len(context), n))
            kinds = np.zeros((len(context), n))
            np.add.at(total, where, c)
            np.add.at(kinds, where, c > 0)
            all_ = total + kinds
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2(all_) - np.log2(kinds), 0.0)
                seen = np.log2(all_[where]) - np.log2(c)
            self.contexts.append(context)
            self.escape.append(escape)
            shorter = escape[where] + (self.lookup(k - 1, key & ((1 << 8 * k) - 1)) if k else 8.0)
            self.keys.append(key)
            self.cost.append(np.where(c > 0, seen, shorter))

    def lookup(self, k: int, runs: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each run of k+1 bytes, a column a language."""
        if k < 0:
            return np.full((len(runs), len(self.langs)), 8.0)
        keys = self.keys[k]
        at = np.minimum(np.searchsorted(keys, runs), max(0, len(keys) - 1))
        if len(keys):
            out = self.cost[k][at]
            miss = np.flatnonzero(keys[at] != runs)
        else:
            out = np.zeros((len(runs), len(self.langs)))
            miss = np.arange(len(runs))
        if len(miss):
            rest = runs[miss]
            bits = self.lookup(k - 1, rest & ((1 << 8 * k) - 1))
            context = self.contexts[k]
            if len(context):
                c = np.minimum(np.searchsorted(context, rest >> 8), len(context) - 1)
                bits = bits + np.where((context[c] == rest >> 8)[:, None], self.escape[k][c], 0.0)
            out[miss] = bits
        return out

    def bits(self, text: bytes, step: int = 1 << 18) -> np.ndarray:
        """Code length of the whole text in each language, in bits."""
        a, k = padded(text, self.order), self.order
        total = np.zeros(len(self.langs))
        for s in range(k, len(a), step):
            part = a[s - k:s + step]
            total += self.lookup(k, grams(part, k + 1, k)).sum(axis=0)
        return total


class Forest:
    """The trees of any number of languages, in groups of ``GROUP`` with tables of their own."""

    def __init__(self, groups: list[Trees]) -> None:
        self.groups = groups
        self.langs = [x for t in groups for x in t.langs]

    def bits(self, text: bytes, step: int = 1 << 18) -> np.ndarray:
        """Code length of the whole text in each language, in bits."""
        return np.concatenate([t.bits(text, step) for t in self.groups]) if self.groups else np.zeros(0)


def train(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES, order: int = ORDER) -> Forest:
    """Learn trees from ``docs`` (``doc_id, text, lang``) that aren't held out.

    Rows with null text or lang teach nothing. A language is learned from ``sample_bytes`` of text, and from less
    where all languages together would have more than ``ALL_BYTES``. The tables have at most ``order + 1`` entries a
    sampled byte and ``GROUP`` columns each, whatever the input and the number of languages.
    """
    rows = docs.select("text", "lang", held_out(F.col("doc_id")).alias("out")).where(
        "text is not null and lang is not null and not out")
    sizes = sorted((r.lang, r.n) for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect())
    if not sizes:
        return Forest([])
    langs = [x for x, _ in sizes]
    each = min(sample_bytes, ALL_BYTES / len(langs))
    rates = docs.sparkSession.createDataFrame([(x, min(1.0, each / max(1, n))) for x, n in sizes], "lang string, rate double")
    # one row a language
    picked = rows.join(F.broadcast(rates), "lang").where(
        F.shiftrightunsigned(F.xxhash64("text"), 1).cast("double") < F.col("rate") * float(1 << 63))
    number = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[int, list[bytes]] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(number[lang], []).append(text.encode())
            for i, texts in by.items():
                for k in range(order + 1):
                    runs = np.concatenate([grams(padded(t, order), k + 1, order) for t in texts])
                    key, n = np.unique(runs, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(key), i, np.int32)), pa.array(np.full(len(key), k, np.int32)),
                         pa.array(key), pa.array(n.astype(np.int64))], names=["lang", "k", "run", "n"])

    table = picked.select("text", "lang").mapInArrow(count, "lang int, k int, run long, n long").groupBy(
        "lang", "k", "run").agg(F.sum("n").alias("n")).toArrow()
    lang, kk, run, n = (table.column(i).to_numpy() for i in range(4))
    groups = []
    for g in range(0, len(langs), GROUP):
        counts, width = {}, min(GROUP, len(langs) - g)
        own = (lang >= g) & (lang < g + GROUP)
        for k in range(order + 1):
            m = own & (kk == k)
            key, at = np.unique(run[m], return_inverse=True)
            c = np.zeros((len(key), width), np.int64)
            c[at, lang[m] - g] = n[m]
            counts[k] = (key, c)
        groups.append(Trees(langs[g:g + GROUP], counts, order))
    return Forest(groups)


def predict(docs: DataFrame, trees: Forest, keep: list[str] | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, bits_per_byte`` for each row of ``docs`` (``doc_id, text``).

    ``score`` is the winner's posterior probability under equal priors, from the exact
    code lengths; equal code lengths go to the first language by name. Null text and
    text without any letter: ``und`` with score 0, as is every text when no language was learned.
    Rows stay as they come, repeated and null doc_ids too; other columns
    are not read, unless ``keep`` names columns that take the place of doc_id and held_out.
    One narrow pass; the trees are broadcast, bounded by the training sample.
    """
    shared = docs.sparkSession.sparkContext.broadcast([g.__dict__ for g in trees.groups])
    head = ["doc_id", "held_out"] if keep is None else [f"c{i}" for i in range(len(keep))]
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                       F.col("text").cast("string")) if keep is None else docs.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = []
        for state in shared.value:
            groups.append(Trees.__new__(Trees))
            groups[-1].__dict__.update(state)
        t = Forest(groups)
        for b in batches:
            pred, score, rate = [], [], []
            for text in b.column(len(head)).to_pylist():
                if not t.langs or text is None or not any(map(str.isalpha, text)):
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    rate.append(None)
                    continue
                raw = text.encode()
                bits = t.bits(raw)
                best = int(np.argmin(bits))
                pred.append(t.langs[best])
                score.append(float(1.0 / np.exp2(np.maximum(bits[best] - bits, -1000.0)).sum()))
                rate.append(float(bits[best] / len(raw)))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(head)], pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                 pa.array(rate, pa.float64())], names=[*head, "lang_pred", "score", "bits_per_byte"])

    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in head)
                          + ", lang_pred string, score double, bits_per_byte double")
    return out if keep is None else out.withColumnsRenamed({f"c{i}": c for i, c in enumerate(keep)})


def identify(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES, order: int = ORDER) -> DataFrame:
    """Train on ``docs`` and predict every row of it."""
    return predict(docs, train(docs, sample_bytes, order))
