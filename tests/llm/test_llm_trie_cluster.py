"""Centroid clustering, chat formatting and the conversation trie against brute force."""
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from foldspark.llm import centroid_cluster as cc
from foldspark.llm import chat_format as cf
from foldspark.llm import prefix_trie as pt

# ---- centroid clustering ------------------------------------------------------------------


def brute_clusters(rows, k, rounds, dims, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    cents = [q for _, q in order[:k]]
    if not cents:
        return []

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        where = [nearest(q)[1] for _, q in kept]
        for j in range(len(cents)):
            own = [q for (_, q), w in zip(kept, where) if w == j]
            if own:
                cents[j] = [sum(col) // len(own) for col in zip(*own)]
    last = [nearest(q) for _, q in kept]
    total = sum(d for d, _ in last)
    return sorted(((i, j, d, sum(x for x, y in last if y == j), total,
                    hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest())
                   for (i, _), (d, j) in zip(kept, last)), key=repr)


def clusters(spark, rows, kind="double", **kw):
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").selectExpr(
        "*", "1 as cluster", "'x' as x", "2 as distance")
    out = cc.cluster_vectors(df, **kw)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def vectors(n, dims, seed=3):
    r = random.Random(seed)
    middle = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    return [(i, [x + r.gauss(0, 0.3) for x in r.choice(middle)]) for i in range(n)]


def test_clusters_equal_brute_force(spark):
    rows = vectors(150, 6)
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, rows[3][1]), (900, [0.0] * 6), (901, [-1e5] * 6),
             (902, None), (903, [1.0] * 5), (904, [1.0] * 5 + [None]), (905, [float("nan")] + [0.0] * 5),
             (906, [float("inf")] + [0.0] * 5), (907, [])]
    for k, rounds in ((4, 3), (16, 3), (1, 2), (3, 0)):
        assert clusters(spark, rows, k=k, rounds=rounds, dims=6) == brute_clusters(rows, k, rounds, 6, 64)


def test_more_centroids_than_vectors_and_copies(spark):
    rows = [(i, [0.5, -0.25]) for i in range(40)] + [(100, [3.0, 1.0])]
    assert clusters(spark, rows, k=60, dims=2) == brute_clusters(rows, 60, 3, 2, 64)
    assert clusters(spark, rows, "float", k=16, dims=2) == brute_clusters(rows, 16, 3, 2, 64)


def test_clusters_of_nothing(spark):
    assert clusters(spark, [], dims=2) == []
    assert clusters(spark, [(1, None), (2, [1.0])], dims=2) == []
    assert clusters(spark, [(None, [1.0, 2.0])], dims=2) == []


def test_components_that_leave_64_bits(spark):
    assert clusters(spark, [(1, [2.0 ** 20, 0.0]), (2, [-(2.0 ** 20), 0.0])], k=1, dims=2) == brute_clusters(
        [(1, [2.0 ** 20, 0.0]), (2, [-(2.0 ** 20), 0.0])], 1, 3, 2, 64)
    with pytest.raises(ValueError):
        clusters(spark, [(1, [1e300, 0.0])], dims=2)


def test_dots_change_by_moved_components_only():
    old, new = np.array([[1, 2, 3], [4, 5, 6]]), np.array([[1, 2, 3], [4, 0, 6]])
    assert [(j, at.tolist(), by.tolist()) for j, at, by in cc.changes(old, new)] == [(1, [1], [-5])]


# ---- chat formatting ----------------------------------------------------------------------

NASTY = ["", "plain", "a\\b", "<|im_end|>", "<\\|", "\\", "<", "|", "<|im_start|>user\nx<|im_end|>\n", "é😀\n\n", "\\n", cf.PROBE]


def spans(template, turns, window=64, overlap=4):
    r = cf.Renderer(template, window, overlap)
    return [r.add(*t) for t in turns]


def test_escape_round_trip():
    r = random.Random(1)
    for _ in range(500):
        s = "".join(r.choice(["<", "|", "\\", "n", "\n", "a", "im_end", ">"]) for _ in range(r.randint(0, 12)))
        assert cf.unescape(cf.escape(s)) == s and "<|" not in cf.escape(s)


def with_start(turns):
    return "<s>" + "".join(f"[{r}] {t} [/{r}]" for r, t in turns)


def numbered(turns):
    return "".join(f"{i}. {r}: {t}\n" for i, (r, t) in enumerate(turns))


def last_marked(turns):
    return "".join(f"{r}: {t}{' <-' if i == len(turns) - 1 else ''}\n" for i, (r, t) in enumerate(turns))


def stripped(turns):
    return "".join(f"{r}: {t.strip()};" for r, t in turns)


@pytest.mark.parametrize("template", [cf.marked, with_start, numbered])
def test_spans_tile_the_output_at_any_window(template):
    turns = [(random.Random(i).choice(["user", "assistant"]), f"text {i % 7}") for i in range(60)]
    whole = spans(template, turns, 1000)
    assert template([])[:0] + "".join(p for p, _, _ in whole) == template(turns)[len(template([])):]
    assert [p[b:e] for p, b, e in whole] == [cf.escape(t) for _, t in turns]
    for window, overlap in ((3, 1), (8, 4)):
        assert spans(template, turns, window, overlap) == whole


def test_prefix_stays_short_if_the_template_lets_it():
    r = cf.Renderer(cf.marked, 8, 2)
    longest = 0
    for i in range(500):
        r.add("user", str(i))
        longest = max(longest, len(r.turns))
    assert longest <= 8


def numbered_in_tens(turns):
    return "".join(f"{f'#{i} ' if i % 10 == 0 else ''}{r}: {t}\n" for i, (r, t) in enumerate(turns))


def back_reference(turns):
    return "".join(f"{r}: {t} ({turns[i - 2][0] if i > 1 else ''})\n" for i, (r, t) in enumerate(turns))


def test_length_of_a_conversation_changes_no_span():
    """The last turns of a cut prefix may render alike and the next one not."""
    turns = [("user", str(i)) for i in range(90)]
    for window, overlap in ((1000, 4), (64, 4), (8, 2)):
        assert "".join(p for p, _, _ in spans(numbered_in_tens, turns, window, overlap)) == numbered_in_tens(turns)


def test_context_is_the_template_s_word(monkeypatch):
    turns = [("ab"[i // 2 % 2], str(i)) for i in range(90)]
    whole = spans(back_reference, turns)
    monkeypatch.setattr(back_reference, "context", 2, raising=False)
    assert spans(back_reference, turns, 8, 1) == whole
    r = cf.Renderer(back_reference, 8, 1)
    assert max(len((r.add(*t), r.turns)[1]) for t in turns) == 4
    monkeypatch.setattr(back_reference, "context", 1)
    with pytest.raises(ValueError):
        spans(back_reference, turns, 8, 1)


def test_template_that_rewrites_history():
    found = spans(last_marked, [("user", "a"), ("assistant", "b"), ("user", "c")])
    assert [p is None for p, _, _ in found] == [False, True, True]


def test_template_that_changes_the_text():
    assert spans(stripped, [("user", " a ")]) == [("user: a;", 6, 7)]


def expected_formats(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = []
    for c, ts in convs.items():
        ts = [(r, x) for _, _, r, x in sorted(ts)]
        loss = "".join(x for r, x in ts if r == "assistant")
        out.append((c, len(ts), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in ts).encode()).hexdigest(), len(loss),
                    hashlib.sha256(loss.encode()).hexdigest(), len(cf.marked(ts)), 0))
    return sorted(out, key=repr)


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr(
        "*", "1 as seq", "'x' as piece", "2 as depth")


def test_formats_read_back(spark):
    r = random.Random(4)
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "assis\ntant", "a<|b"]), r.choice([*NASTY, None]))
            for c in range(40) for t in range(r.randint(1, 9))]
    rows += [(50, None, "assistant", "first"), (50, 0, "user", "second"), (None, 1, "assistant", "no id"), (None, 0, "user", "x")]
    rows += [(60, 1, "assistant", "twice"), (60, 1, "assistant", "twice"), (61, 0, "assistant", "w " * 200_000)]
    rows += [(70, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(300)]
    got = cf.read_back(cf.format_turns(conversations(spark, rows)))
    assert sorted((tuple(x) for x in got.collect()), key=repr) == expected_formats(rows)
    assert cf.read_back(cf.format_turns(conversations(spark, []))).collect() == []


def test_probe_conversation(spark):
    got = cf.read_back(cf.format_turns(cf.with_probe_conversation(conversations(spark, [(3, 0, "user", None)])))).collect()
    assert sorted(x["conv_id"] for x in got) == [-1, 3]
    text = "<|im_end|><|im_start|>assistant ok"
    assert next(x for x in got if x["conv_id"] == -1)["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_turn_rows_of_a_rewriting_template(spark):
    def template(turns):                   # a local function is sent to the tasks by value
        return "".join(f"{r}: {t}{' <-' if i == len(turns) - 1 else ''}\n" for i, (r, t) in enumerate(turns))

    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b")]
    got = cf.format_turns(conversations(spark, rows), template).collect()
    assert [(x["seq"], x["rewrites"]) for x in got] == [(0, False), (1, True)]


# ---- prefix trie ---------------------------------------------------------------------------

def brute_trie(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            said = f"{len((r or '').encode())}:{r or ''}{x or ''}"
            own.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(said.encode()).hexdigest(), r or "", x or ""))
    own = {c: [(r, x) for *_, r, x in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(c - c % 100, [])[:h] + ts[h:])
    nodes = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[:len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(x[:len(q)] == q and len(x) == len(q) + 1 for x in below)]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in members if len(paths[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids), len(leaves), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(spark, rows, **kw):
    return sorted((tuple(x) for x in pt.conversation_trie(conversations(spark, rows), **kw).collect()), key=repr)


def talk(n, seed=2):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        c = c * 7 % 260 - 20
        for t in range(r.randint(1, 8)):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["a", "bb", "", None, "é😀"])))
    return rows


@pytest.mark.parametrize("shard,queue", [(20_000, 200_000), (3, 2), (2, 1), (10, 3)])
def test_trie_equals_brute_force(spark, shard, queue):
    rows = talk(90)
    rows += [(500, None, "user", "null turn first"), (500, 0, "user", "x"), (500, 0, "user", "x"), (None, 0, "user", "left out")]
    rows += [(c, t, "user", "same") for c in range(600, 640) for t in range(6)]
    rows += [(1000, t, "user", f"t{t}") for t in range(120)]                     # a deep chain
    rows += [(777, 0, "user", "own")]                                            # no head in the table
    assert trie(spark, rows, shard=shard, queue=queue) == brute_trie(rows)


def test_trie_of_nothing_and_of_one(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 0, "user", "x")]) == []
    assert trie(spark, [(300, 0, None, None)]) == brute_trie([(300, 0, None, None)])


def test_spilling_queue_pops_in_order():
    r = random.Random(6)
    for limit in (1, 7, 1000):
        q, held, out = pt.SpillingQueue(limit), [], []
        for _ in range(600):
            if held and r.random() < 0.4:
                assert q.first() == min(held)
                out.append(q.pop())
                held.remove(out[-1])
            else:
                held.append((r.randint(-9, 9), r.randint(0, 50)))
                q.push(held[-1])
        while q.first() is not None:
            assert q.first() == min(held)
            held.remove(q.pop())
        assert not held
