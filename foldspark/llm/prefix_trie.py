"""Conversation prefix trie by time-forward processing (operator 13).

A node is a distinct sequence of first turns. Its key is a chained hash (128 bits of SHA-256 over the
parent's key and the turn), made while a conversation's turns stream by in order, so no text is
shuffled after the turns have been hashed. Equal keys are added up before they meet: a first turn that
a third of all conversations share is one partial row a task.

Totals go from children to parents by time-forward processing. Spark sorts the nodes of a shard in
reverse level order (an external sort), and a task streams through them with a priority queue that
spills: a node takes the messages addressed to it off the queue, its totals are then final, and a
message to its parent goes into the queue.

Shards are bounded by weight. The weight of a node, the turns of its members below it, bounds the
nodes of its subtree and never grows on the way down. Level 0 holds the nodes of weight up to ``SHARD``, and
the topmost of them on each path are its shard roots; level 1 holds those up to ``SHARD`` squared, and so
on. A shard of any level has at most ``SHARD`` nodes of a depth, there are ``log(weight) / log(SHARD)``
levels, and each is one Spark job: the totals of its shard roots are added up by parent and join the nodes
of the levels above as messages. Every level's table is written to the shared folder.

Two streams follow one conversation or one node each in bounded memory and cannot be split further:
the chained hash of one conversation's turns and the SHA-256 over one node's ordered member ids.

Defined cases: null role and text are empty. Turns come in order of (turn, hash of the turn), null turns
first, so repeated rows are turns of their own. Rows with a null id belong to no conversation that could be
numbered and are left out. ``c - c % 100`` rounds down for negative ids too. An empty table gives no
node. Other columns are ignored.
"""
from __future__ import annotations

import hashlib
import heapq
import math
import pickle
import struct
import tempfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.llm.common import discard, stored

#: Most nodes of one depth in a shard, and base of the weight levels.
SHARD = 20_000
#: Messages that a queue holds in memory before it spills.
QUEUE = 200_000
#: Conversations that share the first turns of one of them, and the number of values of h.
BLOCK, HEADS = 100, 6

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


# ---- conversations -----------------------------------------------------------------------

def hashed_turns(conversations: DataFrame) -> DataFrame:
    """``(c, rk, turn_hash, chars)``: the turns of each conversation numbered from 1, texts hashed."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    t = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").alias("t"),
        F.unhex(F.substring(F.sha2(said, 256), 1, 32)).alias("turn_hash"), F.char_length(text).cast("long").alias("chars"))
    order = Window.partitionBy("c").orderBy(F.col("t").asc_nulls_first(), "turn_hash")
    return t.select("c", F.row_number().over(order).alias("rk"), "turn_hash", "chars")


def rebuilt(own: DataFrame) -> DataFrame:
    """``(c, part, rk, turn_hash, chars)``: a row for the root of each conversation (part 0), the first ``h`` turns
    of the conversation that heads its block (1) and its own turns after its first ``h`` (2)."""
    h = F.crc32(F.col("c").cast("string").cast("binary")) % HEADS
    ids = own.where("rk = 1").select("c", h.alias("h"), (F.col("c") - F.pmod("c", F.lit(BLOCK))).alias("head"))
    lent = own.where(F.col("rk") < HEADS).withColumnRenamed("c", "head")
    first = ids.where("h > 0").join(lent, "head").where("rk <= h").select("c", F.lit(1).alias("part"), "rk", "turn_hash", "chars")
    rest = own.where(F.col("rk") > h).select("c", F.lit(2).alias("part"), "rk", "turn_hash", "chars")
    top = ids.select("c", F.lit(0).alias("part"), F.lit(0).alias("rk"), F.lit(None).cast("binary").alias("turn_hash"),
                     F.lit(0).cast("long").alias("chars"))
    return top.unionByName(first).unionByName(rest)


def paths(parts: DataFrame) -> DataFrame:
    """``(c, depth, a, b, pa, pb, chars, below)``: the nodes on each conversation's path; (a, b) is a node's key,
    (pa, pb) its parent's, ``below`` the number of turns that follow. The root's key is (0, 0)."""
    w = Window.partitionBy("c").orderBy("part", "rk")
    t = parts.select("c", "turn_hash", "chars", (F.row_number().over(w) - 1).alias("depth"),
                     F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    t = t.select("c", "depth", "turn_hash", "chars", (F.col("n") - 1 - F.col("depth")).alias("below"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = bytes(16)
        for b in batches:
            rows = []
            for depth, turn in zip(b.column("depth").to_pylist(), b.column("turn_hash").to_pylist()):
                if depth == 0:
                    key = bytes(16)
                    rows.append((0, 0, None, None))
                    continue
                up, key = key, hashlib.sha256(key + turn).digest()[:16]
                rows.append((*struct.unpack(">qq", key), *struct.unpack(">qq", up)))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column("c"), b.column("depth"), *[pa.array(list(x), type=pa.int64()) for x in cols],
                 b.column("chars"), b.column("below")], ["c", "depth", "a", "b", "pa", "pb", "chars", "below"])

    # the window has put each conversation into one partition; the sort fixes the order that the chain needs
    return t.sortWithinPartitions("c", "depth").mapInArrow(
        chain, "c bigint, depth int, a bigint, b bigint, pa bigint, pb bigint, chars bigint, below bigint")


# ---- time-forward processing ---------------------------------------------------------------

class SpillingQueue:
    """A priority queue of tuples that keeps ``limit`` entries in memory and sorted runs in unnamed files.

    The files are private to the task, like Spark's own spills: a task that is run again starts anew."""

    def __init__(self, limit: int):
        self.limit, self.heap, self.fronts = limit, [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            run = tempfile.TemporaryFile()
            self.heap.sort()
            for i in range(0, len(self.heap), 1000):
                pickle.dump(self.heap[i:i + 1000], run)
            run.seek(0)
            self.heap = []
            self._next(self._read(run))

    @staticmethod
    def _read(run) -> Iterator[tuple]:
        with run:
            while True:
                try:
                    yield from pickle.load(run)
                except EOFError:
                    return

    def _next(self, run: Iterator[tuple]) -> None:
        if (item := next(run, None)) is not None:
            heapq.heappush(self.fronts, (item, id(run), run))

    def first(self) -> tuple | None:
        if self.heap and (not self.fronts or self.heap[0] <= self.fronts[0][0]):
            return self.heap[0]
        return self.fronts[0][0] if self.fronts else None

    def pop(self) -> tuple:
        if self.heap and (not self.fronts or self.heap[0] <= self.fronts[0][0]):
            return heapq.heappop(self.heap)
        item, _, run = heapq.heappop(self.fronts)
        self._next(run)
        return item


NODE = ["a", "b", "pa", "pb", "depth", "conv_id", "n_convs", "chars", "weight", "ra", "rb"]
TOTALS = ["n_children", "n_leaves", "saved_tokens"]


def time_forward(nodes: DataFrame, queue: int) -> DataFrame:
    """Totals of the nodes of one level. ``nodes`` have their shard's root ``(ra, rb)`` and, in ``TOTALS``, what children in
    other shards have passed; children in the same shard pass theirs through the queue."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, messages = None, None
        for b in batches:
            cols = {c: b.column(c).to_pylist() for c in [*NODE, *TOTALS]}
            out = []
            for i in range(b.num_rows):
                root = (cols["ra"][i], cols["rb"][i])
                if root != shard:
                    shard, messages = root, SpillingQueue(queue)
                a, b_, depth = cols["a"][i], cols["b"][i], cols["depth"][i]
                children, leaves, saved = (cols[c][i] for c in TOTALS)
                while (m := messages.first()) is not None and m[:3] == (-depth, a, b_):
                    messages.pop()
                    children, leaves, saved = children + 1, leaves + m[3], saved + m[4]
                leaves = leaves if children else 1
                saved += (cols["n_convs"][i] - 1) * cols["chars"][i]
                if (a, b_) != root:
                    messages.push((1 - depth, cols["pa"][i], cols["pb"][i], leaves, saved))
                out.append((children, leaves, saved))
            done = [pa.array(list(x), type=pa.int64()) for x in (zip(*out) if out else [()] * 3)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in NODE], *done], [*NODE, *TOTALS])

    schema = ", ".join(f"{c} {'int' if c == 'depth' else 'bigint'}" for c in [*NODE, *TOTALS])
    return (nodes.select(*NODE, *TOTALS).repartition("ra", "rb")
                 .sortWithinPartitions("ra", "rb", F.desc("depth"), "a", "b").mapInArrow(run, schema))


def sharded(rows: DataFrame, nodes: DataFrame, limits: list[int]) -> DataFrame:
    """``nodes`` with their weight level and the key of their shard's root, the topmost node of that level on their path."""
    level = sum((F.when(F.col("weight") > t, 1).otherwise(0) for t in limits), F.lit(0))
    nodes = nodes.withColumn("level", level)
    if not limits:                                    # one shard holds all
        return nodes.withColumns({"ra": F.lit(0).cast("long"), "rb": F.lit(0).cast("long")})
    heavy = nodes.where(F.col("weight") > limits[0]).select("a", "b", "weight")
    cuts = rows.join(heavy, ["a", "b"]).groupBy("c").agg(*[
        F.max(F.when(F.col("weight") > t, F.col("depth"))).alias(f"cut{i}") for i, t in enumerate(limits)])
    # on a conversation's path, the first node below the last that is too heavy for a level is that level's shard root
    first = [F.when(F.col("depth") == F.coalesce(F.col(f"cut{i}") if i < len(limits) else F.lit(None).cast("int"),
                                                 F.lit(-1)) + 1, F.lit(i)) for i in range(len(limits) + 1)]
    roots = rows.join(cuts, "c", "left").select(
        F.col("c").alias("conv_id"), F.col("a").alias("ra"), F.col("b").alias("rb"),
        F.explode(F.array_compact(F.array(*first))).alias("level"))
    return nodes.join(roots, ["conv_id", "level"])


def subtree_totals(rows: DataFrame, nodes: DataFrame, shard: int, queue: int) -> list[DataFrame]:
    """The nodes with their totals, a table a level."""
    most = nodes.agg(F.max("weight")).first()[0]
    limits = [shard ** (i + 1) for i in range(max(0, math.ceil(math.log(max(most, 1), shard)) + 1)) if shard ** (i + 1) < most]
    todo = stored(sharded(rows, nodes, limits), "trie-shards")
    done: list[DataFrame] = []
    for i in range(len(limits) + 1):
        here = todo.where(F.col("level") == i)
        if done:
            up = reduce(DataFrame.unionByName, done).where("a = ra and b = rb and pa is not null")
            sent = up.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
                F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
            here = here.join(sent, ["a", "b"], "left")
        else:
            here = here.select("*", *[F.lit(None).cast("long").alias(c) for c in TOTALS])
        here = here.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in TOTALS})
        done.append(stored(time_forward(here, queue), f"trie-level-{i}"))
    discard(todo)
    return done


def member_digests(ends: DataFrame) -> DataFrame:
    """``(a, b, ends_sha256)``: SHA-256 of the ids of the conversations that end at a node, ascending."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None

        def batch(rows):
            x, y, z = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()), pa.array(y, type=pa.int64()),
                                               pa.array(z, type=pa.string())], ["a", "b", "ends_sha256"])

        for b in batches:
            done = []
            for a, b_, c in zip(*[b.column(x).to_pylist() for x in ("a", "b", "c")]):
                if (a, b_) != node:
                    if node is not None:
                        done.append((*node, sha.hexdigest()))
                    node, sha = (a, b_), hashlib.sha256(str(c).encode())
                else:
                    sha.update(b",%d" % c)
            if done:
                yield batch(done)
        if node is not None:
            yield batch([(*node, sha.hexdigest())])

    return ends.repartition("a", "b").sortWithinPartitions("a", "b", "c").mapInArrow(
        run, "a bigint, b bigint, ends_sha256 string")


def prefix_trie(parts: DataFrame, shard: int = SHARD, queue: int = QUEUE) -> DataFrame:
    """The trie of conversations given as by ``rebuilt``: one row a node, with ``conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    rows = stored(paths(parts), "trie-paths")
    nodes = stored(rows.groupBy("a", "b").agg(
        F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("depth").alias("depth"), F.min("c").alias("conv_id"),
        F.count("*").alias("n_convs"), F.min("chars").alias("chars"), F.sum("below").alias("weight")), "trie-nodes")
    if nodes.isEmpty():
        return nodes.select("conv_id", F.col("depth").cast("long"), F.col("conv_id").alias("parent_conv_id"), "n_convs",
                            *[F.lit(0).cast("long").alias(c) for c in TOTALS], F.lit(EMPTY_SHA256).alias("ends_sha256"))
    totals = reduce(DataFrame.unionByName, subtree_totals(rows, nodes, shard, queue))
    ends = member_digests(rows.where("below = 0").select("a", "b", "c"))
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    return totals.join(ends, ["a", "b"], "left").join(parents, ["pa", "pb"], "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", *TOTALS,
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, shard: int = SHARD, queue: int = QUEUE) -> DataFrame:
    """The trie of the rebuilt conversations of a table ``(conv_id, turn, role, text)``."""
    own = stored(hashed_turns(conversations), "trie-turns")
    return prefix_trie(rebuilt(own), shard, queue)
