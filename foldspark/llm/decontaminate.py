"""Benchmark decontamination with a BM25 index and block-max WAND.

The test items form an inverted index: of every term the items that hold it, in
order, with their BM25 impact, and the largest impact in each block of items. Impacts
are divided by the item's score for itself, so a score is the share of the item that a
passage explains. Every training text is cut into overlapping passages, long
enough that any item fits whole into one. Each passage queries the index; block-max
WAND skips items whose bound stays below the threshold and returns all items
at or above it. A hit is then verified: word runs of the item's question, of its
answer and of the whole item must occur in the passage. Short parts have shorter runs, so one
changed word does not hide them; the whole item's runs keep chance matches of these out.

The index is made in shards of a bounded number of items; a shard is broadcast, and
all documents are scanned once a shard.
"""
from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import stored

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach, and of its word runs that must occur.
MIN_SCORE, MIN_OVERLAP = 0.7, 0.8
RUN = 5
#: Items in one shard of the index, and in one block.
SHARD_ITEMS, BLOCK = 2000, 4
WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of an item's question and answer: the answer follows an ``Answer:`` mark or the last
    question mark, else it is the last sentence, else the last third of the words."""
    cut = None
    for pattern in (r"(?i)\banswer\s*:", r"\?(?=[^?]*\w[^?]*\Z)", r"[.!?]\s+(?=[^.!?]*\w[^.!?]*[.!?]?\s*\Z)"):
        found = list(re.finditer(pattern, text))
        if found and words(text[:found[-1].start()]) and words(text[found[-1].end():]):
            cut = found[-1].end()
            break
    if cut is not None:
        return words(text[:cut]), words(text[cut:])
    all_ = words(text)
    n = max(1, len(all_) * 2 // 3)
    return all_[:n], all_[n:]


def run_length(n: int) -> int:
    """Length of the word runs that ``n`` words are compared by: the longest of 5, 3, 2 and 1 of which one changed word
    leaves ``MIN_OVERLAP``. It stands in up to that many of the ``n - length + 1`` runs."""
    return next((k for k in (RUN, 3, 2) if n - k + 1 > 0 and (n - 2 * k + 1) / (n - k + 1) >= MIN_OVERLAP), 1)


def item_runs(text: str) -> list[set[tuple[str, ...]]]:
    """Word runs of an item's question, its answer and the whole item."""
    question, answer = question_and_answer(text)
    return [runs(w, run_length(len(w))) for w in (question, answer, question + answer)]


def runs(tokens: list[str], n: int = RUN) -> set[tuple[str, ...]]:
    """Runs of ``n`` words, or the whole sequence when it is shorter."""
    if len(tokens) < n:
        return {tuple(tokens)} if tokens else set()
    return {tuple(tokens[i:i + n]) for i in range(len(tokens) - n + 1)}


def item_statistics(items: DataFrame) -> DataFrame:
    """``item_id, text, terms`` with ``terms`` an array of (term, tf, df), ``dl`` and, in each row, ``n`` and ``avgdl``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, terms, tfs, dls = [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words(text)
                for t in sorted(set(w)):
                    ids.append(i)
                    terms.append(t)
                    tfs.append(w.count(t))
                    dls.append(len(w))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(terms, pa.string()), pa.array(tfs, pa.int32()),
                 pa.array(dls, pa.int32())], names=["item_id", "term", "tf", "dl"])

    post = stored(items.select("item_id", "text").mapInArrow(run, "item_id long, term string, tf int, dl int"),
                  "bench-postings")
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    rows = post.join(df, "term").groupBy("item_id").agg(
        F.collect_list(F.struct("term", "tf", "df")).alias("terms"), F.first("dl").alias("dl"))
    return stored(rows.join(items, "item_id").withColumn(
        "shard", F.pmod(F.xxhash64("item_id"), F.lit(1 << 30))), "bench-items")


class Index:
    """One shard: block maxima of every term, postings by block, and the items' word runs.

    Items are numbered so that those with the same frequent terms are neighbours; a block
    is ``BLOCK`` consecutive items, the same for all terms.
    """

    def __init__(self, rows: list, n: int, avgdl: float) -> None:
        rows = sorted(rows, key=lambda r: (sorted(((-t.df, t.term) for t in r.terms))[:3], r.item_id))
        self.ids = [r.item_id for r in rows]
        blocks = -(-len(rows) // BLOCK)
        self.term: dict[str, int] = {}
        #: block -> term -> (items in order, impacts)
        self.postings: list[dict[int, tuple[list[int], list[float]]]] = [{} for _ in range(blocks)]
        for k, r in enumerate(rows):
            norm = K1 * (1 - B + B * r.dl / avgdl)
            impact = {t.term: math.log(1 + (n - t.df + 0.5) / (t.df + 0.5)) * t.tf * (K1 + 1) / (t.tf + norm)
                      for t in r.terms}
            own = sum(impact.values())
            for t, x in impact.items():
                items, impacts = self.postings[k // BLOCK].setdefault(
                    self.term.setdefault(t, len(self.term)), ([], []))
                items.append(k)
                impacts.append(x / own)
        #: largest impact of every term in every block
        self.maxima = np.zeros((len(self.term), blocks))
        for b, lists in enumerate(self.postings):
            for t, (_, impacts) in lists.items():
                self.maxima[t, b] = max(impacts)
        self.parts = [item_runs(r.text) for r in rows]
        self.longest = max((r.dl for r in rows), default=1)


def search_block(lists: dict[int, tuple[list[int], list[float]]], terms: list[int], least: float) -> list[tuple[int, float]]:
    """WAND inside one block: all its items whose score for the distinct ``terms`` reaches ``least``.

    The bound of a list is its largest impact in the block.
    """
    cur = [[p[0][0], 0, p, max(p[1])] for t in terms if (p := lists.get(t)) is not None]
    out = []
    while cur:
        cur.sort(key=lambda c: c[0])
        bound, pivot = 0.0, None
        for c in cur:
            bound += c[3]
            if bound >= least:
                pivot = c[0]
                break
        if pivot is None:
            break
        if cur[0][0] == pivot:
            score = sum(c[2][1][c[1]] for c in cur if c[0] == pivot)
            if score >= least:
                out.append((pivot, score))
            target = pivot + 1
        else:
            target = pivot
        alive = []
        for c in cur:
            if c[0] < target:
                c[1] = bisect_left(c[2][0], target, c[1])
                if c[1] == len(c[2][0]):
                    continue
                c[0] = c[2][0][c[1]]
            alive.append(c)
        cur = alive
    return out


def retrieve(index: Index, passages: list[np.ndarray], least: float) -> list[tuple[int, int, float]]:
    """``(passage, item, score)`` for all items that reach ``least``. A passage is its distinct terms.

    The block maxima of a passage's terms bound every item of a block; only blocks
    whose bound reaches the threshold are searched.
    """
    out = []
    slack = least - 1e-9
    for s in range(0, len(passages), 64):
        part = [(s + k, p) for k, p in enumerate(passages[s:s + 64]) if len(p)]
        if not part:
            continue
        starts = np.cumsum([0, *[len(p) for _, p in part[:-1]]])
        bounds = np.add.reduceat(index.maxima[np.concatenate([p for _, p in part])], starts, axis=0)
        for k, block in zip(*np.nonzero(bounds >= slack)):
            number, terms = part[k]
            out += [(number, item, score) for item, score in
                    search_block(index.postings[block], terms.tolist(), slack)]
    return out


def scan(index: Index, text: str, least: float, overlap: float) -> dict[int, tuple[float, float, float]]:
    """Verified items of one text: item number -> (score, question overlap, answer overlap).

    Passages are twice the longest item and start every longest item, so every
    item that a text holds lies whole in a passage; a short text is one passage.
    """
    tokens = words(text)
    step = index.longest
    get = index.term.get
    ids = np.fromiter((get(w, -1) for w in tokens), np.int64, len(tokens))
    starts = range(0, max(1, len(tokens) - step), step)
    passages = []
    for start in starts:
        t = np.unique(ids[start:start + 2 * step])
        passages.append(t[1:] if len(t) and t[0] < 0 else t)
    best: dict[int, tuple[float, float, float]] = {}
    seen: dict[tuple[int, int], set] = {}
    for number, item, score in retrieve(index, passages, least):
        start = starts[number]
        shares = []
        for part in index.parts[item]:
            n = len(next(iter(part))) if part else RUN
            if (start, n) not in seen:
                seen[start, n] = runs(tokens[start:start + 2 * step], n)
            shares.append(len(part & seen[start, n]) / len(part) if part else 1.0)
        if min(shares) >= overlap and (item not in best or best[item][0] < score):
            best[item] = (score, *shares[:2])
    return best


def contaminated(docs: DataFrame, items: DataFrame, least: float = MIN_SCORE, overlap: float = MIN_OVERLAP,
                 shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap`` for each item found in a document.

    ``docs``: ``doc_id, text``; ``items``: ``item_id, text``; other columns are not read.
    ``score`` is the best passage's. Null or empty texts on either side match nothing;
    items with null ids are left out, of repeated item_ids the texts are taken as one
    item each (the least text); repeated documents give their rows each. No items: no rows.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, item_id long, score double, question_overlap double, answer_overlap double"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in shards_of(items, shard_items):
        out = out.unionByName(_scan_shard(docs, index, least, overlap, schema))
    return out


def shards_of(items: DataFrame, shard_items: int = SHARD_ITEMS) -> Iterator[Index]:
    """The index of ``items``, shard by shard."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(
        "item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    rows = item_statistics(items)
    total = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    shards = -(-total.n // shard_items)
    for s in range(shards):
        yield Index(rows.where(F.col("shard") % shards == s).drop("shard").collect(), total.n, total.avgdl)


def without_items(docs: DataFrame, items: DataFrame, least: float = MIN_SCORE, overlap: float = MIN_OVERLAP,
                  shard_items: int = SHARD_ITEMS) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns.

    Judged row by row where they lie, so nothing is shuffled, and rows without or with repeated ids
    are judged by their own text. Null and empty texts hold nothing."""
    names = docs.columns
    for index in shards_of(items, shard_items):
        shared = docs.sparkSession.sparkContext.broadcast(index.__dict__)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = Index.__new__(Index)
            own.__dict__.update(shared.value)
            for b in batches:
                texts = b.column(b.schema.names.index("text")).to_pylist()
                yield b.filter(pa.array([not (t and scan(own, t, least, overlap)) for t in texts], pa.bool_()))

        docs = docs.select(*[f"`{c}`" for c in names]).mapInArrow(run, docs.schema)
    return docs


def _scan_shard(docs: DataFrame, index: Index, least: float, overlap: float, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index.__dict__)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Index.__new__(Index)
        own.__dict__.update(shared.value)
        for b in batches:
            ids = b.column(0)
            rows = [(n, own.ids[item], *found) for n, text in enumerate(b.column(1).to_pylist()) if text
                    for item, found in sorted(scan(own, text, least, overlap).items())]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int64()),
                 *[pa.array([r[k] for r in rows], pa.float64()) for k in (2, 3, 4)]],
                names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)
