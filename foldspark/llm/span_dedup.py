"""Removal of repeated passages by sliding sentence spans.

A text is cut into sentences. From every sentence starts a span: the shortest run of at
least ``MIN_SENTENCES`` sentences with at least ``MIN_WORDS`` words. Spans are hashed (128 bits, case
and white space aside) and joined over all documents; a span's first occurrence is the
earliest in the document with the smallest id. Every sentence that a non-first
occurrence covers is removed; longer repeats fall because each of their spans does.

Passages that hold no two whole sentences fall by two further kinds of hashes: every single sentence of
``MIN_WORDS`` words or more, and runs of ``GRAM`` words, wherever they start. Of every ``WINDOW`` successive runs the one
with the smallest hash is taken (winnowing), so two texts with ``GRAM + WINDOW - 1`` words in common
take the same run there, and successive taken runs leave no gap. A repeated run's words are
removed unless it touches a removed sentence. So no text keeps ``GRAM + WINDOW - 1`` successive words that an
earlier document has; at the ends of a passage up to ``WINDOW - 1`` words may stay.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import discard, release, stored

MIN_SENTENCES, MIN_WORDS = 2, 20
#: Words of a run, and successive runs of which at least one is taken; no gap needs WINDOW <= GRAM.
GRAM, WINDOW = 25, 25
#: Kinds of hashes: a place is ``KINDS * at + kind``, ``at`` a sentence or, of a run, a word.
SPAN, SINGLE, RUN, KINDS = 0, 1, 2, 3
#: Base of the rolling hash that chooses runs, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: A sentence ends after its closing marks or line end; the white space behind belongs to it.
SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+|\n|\Z)\s*")
#: A word and the white space behind it.
WORD = re.compile(r"\S+\s*")


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """``(start, end, words)`` of the sentences that have words; ends and starts may leave out
    pieces without words."""
    return [(m.start(), m.end(), w) for m in SENTENCE.finditer(text) if (w := m.group().lower().split())]


def span_ends(found: list[tuple[int, int, list[str]]]) -> list[int]:
    """For every sentence, the end (exclusive) of the span that starts there; 0: none does."""
    out, j, words = [], 0, 0
    n = len(found)
    for i in range(n):
        while j < n and (words < MIN_WORDS or j - i < MIN_SENTENCES):
            words += len(found[j][2])
            j += 1
        out.append(j if words >= MIN_WORDS and j - i >= MIN_SENTENCES else 0)
        words -= len(found[i][2])
    return out


def run_starts(words: list[str]) -> list[int]:
    """Where the taken runs of ``GRAM`` words start."""
    n = len(words) - GRAM + 1
    if n < 1:
        return []
    digest = xxhash.xxh3_64_intdigest
    w = np.fromiter((digest(x) for x in words), np.uint64, len(words))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(
        w * np.multiply.accumulate(np.full(len(w), BASE, np.uint64)), dtype=np.uint64)])
    h = (total[GRAM:] - total[:-GRAM]) * np.multiply.accumulate(np.full(n, INVERSE, np.uint64))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    if n <= WINDOW:
        return [int(h.argmin())]
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, WINDOW).argmin(axis=1) + np.arange(n - WINDOW + 1)).tolist()


def pieces(found: list[tuple[int, int, list[str]]]) -> Iterator[tuple[int, str, bool]]:
    """``(place, text, again)`` of all that is hashed of a text's sentences; ``again`` if the text has it before."""
    flat = [" ".join(w) for _, _, w in found]
    seen = set()
    for i, j in enumerate(span_ends(found)):
        if not j:
            break
        key = "\n".join(flat[i:j])
        yield KINDS * i + SPAN, key, key in seen
        seen.add(key)
    seen = set()
    for i, (_, _, w) in enumerate(found):
        if len(w) >= MIN_WORDS:
            yield KINDS * i + SINGLE, flat[i], flat[i] in seen
            seen.add(flat[i])
    # a line end inside a run counts, as it does inside a span
    words = [x for _, _, w in found for x in (*w[:-1], w[-1] + "\n")]
    first: dict[str, int] = {}
    for at in run_starts(words):
        key = "\t" + " ".join(words[at:at + GRAM])
        # a run that overlaps its first occurrence is a part of it
        yield KINDS * at + RUN, key, at >= first.setdefault(key, at) + GRAM


def spans(docs: DataFrame) -> DataFrame:
    """``h1, h2, doc_id, at, again``: every hashed piece of every text, ``at`` its place, ``again`` if its
    document has it before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2, ids, at, again = [], [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for place, piece, before in pieces(sentences(text)):
                    h = xxhash.xxh3_128_digest(piece.encode())
                    h1.append(int.from_bytes(h[:8], "big", signed=True))
                    h2.append(int.from_bytes(h[8:], "big", signed=True))
                    ids.append(doc)
                    at.append(place)
                    again.append(before)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(ids, pa.int64()),
                 pa.array(at, pa.int32()), pa.array(again, pa.bool_())], names=["h1", "h2", "doc_id", "at", "again"])

    return docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null").mapInArrow(
        run, "h1 long, h2 long, doc_id long, at int, again boolean")


def repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, cuts, first_doc_ids``: the places of each document's removed pieces and which
    documents have them first.

    The owner of a hash is a ``min`` with map-side combine; only hashes of two or more
    documents are joined back, in a join that adaptive execution splits when
    one passage is everywhere.
    """
    all_ = stored(spans(docs), "spans")
    owners = all_.where("not again").groupBy("h1", "h2").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select(
        "h1", "h2", "first")
    moved = all_.where("not again").join(owners, ["h1", "h2"]).where("doc_id <> first").select(
        "doc_id", "at", "first")
    inside = all_.where("again").select("doc_id", "at", F.col("doc_id").alias("first"))
    out = stored(moved.unionByName(inside).groupBy("doc_id").agg(
        F.sort_array(F.collect_set("at")).alias("cuts"), F.sort_array(F.collect_set("first")).alias("first_doc_ids")),
        "span-cuts")
    discard(all_)
    release(docs.sparkSession)
    return out


def cut(text: str, cuts: list[int]) -> tuple[str, int, int, int]:
    """The text without the pieces at the places ``cuts``, with the numbers of sentences, sentences that
    lost words and removed words."""
    found = sentences(text)
    ends = span_ends(found)
    gone, starts = set(), []
    for c in cuts:
        i, kind = divmod(c, KINDS)
        if kind == RUN:
            starts.append(i)
        elif i < len(found):
            gone.update(range(i, ends[i] if kind == SPAN else i + 1))
    away = [found[i][:2] for i in sorted(gone)]
    lost = sum(len(found[i][2]) for i in gone)
    if starts:
        owner = [i for i, (_, _, w) in enumerate(found) for _ in w]
        out = set()
        for at in starts:
            if gone.isdisjoint(owner[at:at + GRAM]):
                out.update(range(at, min(at + GRAM, len(owner))))
        places = [(m.start(), m.end()) for s, e, _ in found for m in WORD.finditer(text, s, e)] if out else []
        away = sorted(away + [places[i] for i in out])
        lost += len(out)
        gone.update(owner[i] for i in out)
    keep, at = [], 0
    for s, e in away:
        keep.append(text[at:s])
        at = e
    keep.append(text[at:])
    return "".join(keep), len(found), len(gone), lost


def rewrite(docs: DataFrame, found: DataFrame, changed_only: bool = False) -> DataFrame:
    """Join the cuts to the documents and rebuild the texts.

    All columns of ``docs`` and ``first_doc_ids, n_sentences, n_removed, words_removed``.
    """
    clash = [c for c in ("cuts", "first_doc_ids", "n_sentences", "n_removed", "words_removed") if c in docs.columns]
    docs = docs.drop(*clash).withColumn("text", F.col("text").cast("string"))
    names = docs.columns
    joined = docs.join(found.withColumnRenamed("doc_id", "__doc"), F.col("doc_id") == F.col("__doc"),
                       "inner" if changed_only else "left").drop("__doc")
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(t, None, 0, 0) if t is None or not c else cut(t, c)
                   for t, c in zip(b.column(place).to_pylist(), b.column(len(names)).to_pylist())]
            cols = [b.column(i) for i in range(len(names))]
            cols[place] = pa.array([x[0] for x in out], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*cols, b.column(len(names) + 1), pa.array([x[1] for x in out], pa.int32()),
                 pa.array([x[2] for x in out], pa.int32()), pa.array([x[3] for x in out], pa.int32())],
                names=[*names, "first_doc_ids", "n_sentences", "n_removed", "words_removed"])

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return joined.select(*[f"`{c}`" for c in names], "cuts", "first_doc_ids").mapInArrow(
        run, f"{fields}, first_doc_ids array<long>, n_sentences int, n_removed int, words_removed int")


def dedup_spans(docs: DataFrame, changed_only: bool = False) -> DataFrame:
    """Remove repeated passages from ``docs`` (``doc_id, text`` and any other columns, which are kept).

    Null texts, texts without a repeat and null doc_ids stay as they are. Rows that share a doc_id
    count as one document: they are not compared with one another and lose the same
    spans. Columns named like the added ones are replaced. With ``changed_only`` only
    documents that lost words are returned.
    """
    return rewrite(docs, repeats(docs), changed_only)
