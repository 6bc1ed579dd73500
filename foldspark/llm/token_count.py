"""Token counts by heap-and-linked-list byte-pair merging.

The model file gives pieces and their ranks. A text is normalised as the model says
(white space escaped, one in front), cut where no piece can span the cut, and each chunk's
symbols form a doubly linked list. A heap holds the adjacent pairs that are pieces;
the best-ranked, then leftmost pair is popped and merged until none is left. The
count is the number of initial symbols minus merges, where an unknown character that
stays alone counts its UTF-8 bytes. No identifiers are made.
"""
from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

SPACE = "▁"


class PieceModel:
    """Pieces and ranks of a byte-pair model with byte fallback, read from its file."""

    def __init__(self, path: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.vocab_size())
        plain = [i for i in ids if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        # a higher score merges first; equal scores keep their order in the text
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in plain}
        self.normalise: Callable[[str], str] = sp.normalize
        inner = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.rank)
        #: A piece never crosses from a letter to an escaped space, so texts are cut there.
        self.chunks = re.compile(f"(?s).+" if inner else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall


def merge_count(chunk: str, rank: dict[str, float]) -> int:
    """Tokens of one chunk: symbols minus merges, unknown characters as bytes."""
    n = len(chunk)
    if n == 1:
        return 1 if chunk in rank else len(chunk.encode("utf-8", "surrogatepass"))
    piece = list(chunk)
    right = list(range(1, n + 1))
    left = list(range(-1, n - 1))
    heap = []
    get = rank.get
    for i in range(n - 1):
        r = get(chunk[i:i + 2])
        if r is not None:
            heap.append((r, i, 2))
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    merges = 0
    while heap:
        _, i, size = pop(heap)
        a = piece[i]
        j = right[i]
        # an entry is stale when either symbol has been merged since
        if not a or j >= n or len(a) + len(piece[j]) != size:
            continue
        b = piece[j]
        merged = a + b
        piece[i], piece[j] = merged, ""
        merges += 1
        k = right[j]
        right[i] = k
        if k < n:
            left[k] = i
            r = get(merged + piece[k])
            if r is not None:
                push(heap, (r, i, size + len(piece[k])))
        h = left[i]
        if h >= 0:
            r = get(piece[h] + merged)
            if r is not None:
                push(heap, (r, h, len(piece[h]) + size))
    extra = sum(len(p.encode("utf-8", "surrogatepass")) - 1 for p in piece if len(p) == 1 and p not in rank)
    return n - merges + extra


def counter(path: str, remember: int = 400_000) -> Callable[[str], int]:
    """A function that counts the tokens of a text; up to ``remember`` chunk counts are kept
    (all forgotten when full), so repeated words are merged once."""
    model = PieceModel(path)
    known: dict[str, int] = {}
    rank = model.rank

    def count(text: str) -> int:
        total = 0
        for chunk in model.chunks(model.normalise(text)):
            n = known.get(chunk)
            if n is None:
                n = merge_count(chunk, rank)
                if len(chunk) <= 64:
                    if len(known) >= remember:
                        known.clear()
                    known[chunk] = n
            total += n
        return total

    return count


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs`` (``doc_id, text``).

    The whole text counts: no truncation, begin, end or special tokens; special strings
    inside a text are ordinary text. Null text counts as empty: 0 bytes, 0
    tokens. Rows stay as they come, repeated and null doc_ids too; other columns
    are not read. ``model_path`` must be readable on every executor. One narrow pass, no
    shuffle; a task holds one Arrow batch and its chunk counts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            tokens = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
                 pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", docs["text"].cast("string")).mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
