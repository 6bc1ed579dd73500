"""Chat formatting by incremental black-box rendering (operator 12).

A template is any function from a list of ``(role, text)`` turns to a string. Nothing is known about
it: the prefixes of a conversation are rendered one after the other, and what a prefix adds to the
one before is the span of its last turn. If an output does not begin with the output
before, the template rewrites history, and the turn says so. Where the text lies inside
the span is found by rendering the same prefix with a probe in place of the text: what stands around the
probe is the turn's header and footer.

Rows are dealt by conversation, sorted inside the partitions by Spark (which spills) and
streamed. Whether a prefix may be cut is the template's own word and never a guess from a few turns or
from their number: a template with an attribute ``context`` states that what a turn adds depends on no more than
the first turn, the ``context`` turns before it and itself. Its prefix is, from the second turn on and at any length,
the first turn and the last few; so a conversation with a third of all rows is one stream in bounded memory (its digest,
a SHA-256 over all its turns in order, cannot be split further). A turn that renders otherwise once the prefix slides on
is an error. A template without ``context`` may look back at will: its whole prefix is rendered at
every turn, in time that grows with the square of a conversation's length.

Defined cases: null role and text are empty. Turns come in order of (turn, role, text), nulls
first; repeated rows are turns of their own. Rows with a null id are one conversation of that id. An empty table
gives an empty result. Other columns are ignored.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most turns of a prefix that may be cut, and turns at its end that it keeps if the template needs fewer.
WINDOW, OVERLAP = 64, 4
#: Stands for a text while header and footer are looked for; characters that no template adds itself.
PROBE = "probe"
LOSS_ROLE = "assistant"

# The marks of the production template.
START, END = "<|im_start|>", "<|im_end|>"

Template = Callable[[list[tuple[str, str]]], str]


def escape(s: str) -> str:
    """``s`` without ``<|``, so that no mark can appear in it; ``unescape`` gives it back."""
    return s.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], s, flags=re.S)


def marked(turns: list[tuple[str, str]]) -> str:
    """The production template: ``<|im_start|>role``, line break, text, ``<|im_end|>``, line break."""
    return "".join(f"{START}{escape(r).replace(chr(10), chr(92) + 'n')}\n{escape(t)}{END}\n" for r, t in turns)


marked.context = 0             # a turn's rendering depends on the turn alone


class Renderer:
    """Spans of successive turns of one conversation under a black-box template."""

    def __init__(self, template: Template, window: int = WINDOW, overlap: int = OVERLAP):
        self.render = template
        context = getattr(template, "context", None)
        #: turns at the end of the prefix that stay; None: all
        self.keep = None if context is None else max(context + 1, min(overlap, window - 2))
        self.proven = 0 if context is None else self.keep - context      # of these, turns with all their context
        self.turns: list[tuple[str, str]] = []
        self.pieces: list[str | None] = []
        self.out = template([])

    def add(self, role: str, text: str) -> tuple[str | None, int | None, int | None]:
        """The piece that the turn adds to the output and its text's begin and end in that.

        A template that rewrites history gives no piece; a turn whose text does not appear
        between a header and a footer of its own has no begin and end."""
        probe = PROBE
        while probe in role:
            probe += PROBE[0]
        before, shown = self.out, self.render([*self.turns, (role, text)])
        probed = self.render([*self.turns, (role, probe)])
        if not self.turns and not shown.startswith(before):
            before = ""                            # what it renders for no turns is no prefix of anything
        whole = shown.startswith(before)
        piece = shown[len(before):] if whole else None
        begin = end = None
        at = probed.find(probe, len(before)) if whole and probed.startswith(before) else -1
        if at >= 0:
            head, foot = probed[len(before):at], probed[at + len(probe):]
            if len(head) + len(foot) <= len(piece) and piece.startswith(head) and piece.endswith(foot):
                begin, end = len(head), len(piece) - len(foot)
        self.turns.append((role, text))
        self.out = shown
        if self.keep is not None:
            self.pieces.append(piece)
            self.slide()
        return piece, begin, end

    def slide(self) -> None:
        """Leave the prefix at the first turn and the last ``keep`` ones, as a template with ``context`` allows."""
        if len(self.turns) <= self.keep + 1:
            return
        self.turns = [self.turns[0], *self.turns[-self.keep:]]
        self.pieces = self.pieces[-self.proven:]
        self.out = self.render(self.turns)
        if None not in self.pieces and not self.out.endswith("".join(self.pieces)):
            raise ValueError("the template looks further back than its context")


def format_turns(conversations: DataFrame, template: Template = marked, loss_role: str = LOSS_ROLE,
                 window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """One row a turn: ``conv_id, seq, role, piece, start, end, loss_start, loss_end, rewrites``.

    ``piece`` is what the turn adds to the formatted conversation, at ``[start, end)`` of it (code points); the
    pieces of a conversation in order of ``seq`` are its formatted text. ``[loss_start, loss_end)`` is
    the text of a turn of ``loss_role``, else null. ``rewrites`` marks turns at which the template changed what
    it had rendered before; these have no piece. The rows of a conversation are in one partition, in order."""
    own = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                               F.coalesce("text", F.lit("")).alias("text"))
    dealt = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, owner, seq, at = None, None, 0, 0
        for b in batches:
            rows = []
            for conv, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(),
                                        b.column("text").to_pylist()):
                if state is None or conv != owner:
                    state, owner, seq, at = Renderer(template, window, overlap), conv, 0, 0
                piece, begin, end = state.add(role, text)
                size, loss = len(piece or ""), role == loss_role and begin is not None
                rows.append((conv, seq, role, piece, at, at + size, at + begin if loss else None,
                             at + end if loss else None, piece is None))
                seq, at = seq + 1, at + size
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), type=t) for c, t in zip(zip(*rows) if rows else [()] * 9, kinds)], names)

    names = ["conv_id", "seq", "role", "piece", "start", "end", "loss_start", "loss_end", "rewrites"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.bool_()]
    return dealt.withColumn("conv_id", F.col("conv_id").cast("long")).mapInArrow(
        spans, "conv_id bigint, seq bigint, role string, piece string, start bigint, end bigint, "
               "loss_start bigint, loss_end bigint, rewrites boolean")


class Digest:
    """What is read back from one formatted conversation, piece by piece."""

    TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.n_rewrites = 0
        self.rest = ""

    def add(self, piece: str | None, loss: tuple[int, int] | None, rewrites: bool) -> None:
        self.n_rewrites += rewrites
        if piece is None:
            return
        self.chars += len(piece)
        if loss is not None:
            text = unescape(piece[loss[0]:loss[1]])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.rest += piece
        while m := self.TURN.match(self.rest):
            self.n_turns += 1
            self.turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            self.rest = self.rest[m.end():]

    def row(self, conv) -> tuple:
        if self.rest:
            raise ValueError(f"conversation {conv}: the output holds text outside its turns")
        return (conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars,
                self.n_rewrites)


def read_back(turns: DataFrame) -> DataFrame:
    """One row a conversation, read from the output of ``format_turns`` under the template ``marked``:
    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_rewrites``."""
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: Iterable[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(zip(*rows), kinds)], names)

        now, owner, done = None, None, []
        for b in batches:
            for conv, piece, start, first, last, rewrites in zip(*[b.column(c).to_pylist() for c in (
                    "conv_id", "piece", "start", "loss_start", "loss_end", "rewrites")]):
                if now is None or conv != owner:
                    if now is not None:
                        done.append(now.row(owner))
                    now, owner = Digest(), conv
                now.add(piece, None if first is None else (first - start, last - start), rewrites)
            if done:
                yield batch(done)
                done = []
        if now is not None:
            yield batch([now.row(owner)])

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_rewrites"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return turns.mapInArrow(digests, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                     "loss_sha256 string, formatted_chars bigint, n_rewrites bigint")


def with_probe_conversation(conversations: DataFrame) -> DataFrame:
    """``conversations`` and conversation -1, whose texts are control strings."""
    text = f"{END}{START}{LOSS_ROLE} ok"
    extra = conversations.sparkSession.createDataFrame(
        [(-1, 0, "user", text), (-1, 1, LOSS_ROLE, text)], "conv_id bigint, turn bigint, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
