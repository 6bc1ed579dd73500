"""Text operators against brute force: span dedup, Jaccard join, decontamination."""
import random
from collections import Counter, namedtuple

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspark.llm import decontaminate as dc
from foldspark.llm import jaccard_join as jj
from foldspark.llm import span_dedup as sd

rng = random.Random(5)


def prose(n, r=rng, size=400):
    out = []
    while len(out) < n:
        k = r.randint(3, 14)
        out += [f"w{r.randint(0, size)}" for _ in range(k)]
        out[-1] += "."
    return " ".join(out[:n])


# ---- Jaccard join -------------------------------------------------------------

def brute_components(rows):
    def sets(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", w) if x]
        if not w:
            return set()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}

    s = [(i, sets(t)) for i, t in rows]
    root = list(range(len(s)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in range(len(s)):
        for b in range(a):
            u = len(s[a][1] | s[b][1])
            if s[a][1] and s[b][1] and 100 * len(s[a][1] & s[b][1]) >= 80 * u:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(s):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(x), least.get(find(k))) for k, (i, x) in enumerate(s)), key=repr)


def corpus():
    r = random.Random(11)
    rows, n = [], 0

    def add(t):
        nonlocal n
        rows.append((n, t))
        n += 1

    common = prose(30, r)
    for _ in range(12):
        add(prose(r.randint(20, 120), r) + " " + common)
    for _ in range(6):
        base = prose(r.randint(60, 160), r).split()
        for k in range(9):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = f"e{r.randint(0, 10**6)}"
            add(" ".join(w))
    for t in ["", None, "  \t\n ", "a", "A", "a b c", "a  b\tc", "a b c d", "É b", "é b", "x\u00a0y", prose(5000, r)]:
        add(t)
    rows.append((3, rows[3][1]))          # a repeated row
    rows.append((None, rows[5][1]))       # a null id
    return rows


@pytest.mark.parametrize("limit", [400, 3])
def test_jaccard_matches_brute_force(spark, monkeypatch, limit):
    """Small regions and, with a low limit, regions that run as Spark rounds."""
    monkeypatch.setattr(jj, "REGION_POINTS", limit)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", F.lit("x")).withColumn(
        "s1", F.lit(1))
    got = sorted([tuple(r) for r in jj.jaccard_join(df).collect()], key=repr)
    assert got == brute_components(rows)


def test_jaccard_chain_and_threshold(spark):
    """Components follow chains; similarity of exactly 0.8 links, just below does not."""
    w = [f"a{i}" for i in range(13)]       # 9 shingles
    same = " ".join(w)
    eight = " ".join(w[:-1])               # 8 of 9 shingles
    seven = " ".join(w[1:-1])              # 7 of 8 with the last, 7 of 9 with the first
    rows = [(1, same), (2, eight), (3, seven)]
    rows += [(10, " ".join(f"b{i}" for i in range(8))), (11, " ".join(f"b{i}" for i in range(9)))]     # 4 of 5: 0.8
    rows += [(20, " ".join(f"c{i}" for i in range(7))), (21, " ".join(f"c{i}" for i in range(8)))]     # 3 of 4
    got = {r.doc_id: r.component_id for r in jj.jaccard_join(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 20: 20, 21: 21}


def test_jaccard_null_ids_and_two_texts_of_one_id(spark):
    """A near copy without an id links and passes chains on; each text of an id links as itself."""
    w = [f"a{i}" for i in range(24)]
    rows = [(1, " ".join(w[:-2])), (None, " ".join(w[1:])), (None, " ".join(w[1:])), (2, " ".join(w[2:] + ["z1", "z2"]))]
    other = [" ".join(f"{c}{i}" for i in range(20)) for c in "bc"]
    rows += [(5, other[0]), (5, other[1]), (6, other[0] + " x"), (7, other[1] + " x")]
    got = sorted([tuple(r) for r in jj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()], key=repr)
    want = brute_components(rows)
    assert got == want and {c for i, _, c in want if i in (1, 2)} == {1}


def edited(words, share, r):
    """``words`` with about ``share`` of them replaced by new ones, one run of them."""
    w = list(words)
    n = int(len(w) * share)
    at = r.randrange(len(w) - n + 1)
    w[at:at + n] = [f"n{r.randint(0, 10**9)}" for _ in range(n)]
    return w


@pytest.mark.parametrize("limit", [400, 3])
def test_jaccard_long_texts_at_middle_distances(spark, monkeypatch, limit):
    """Long copies of one text at distances around 0.1 to 0.4, and sizes that differ, among texts that share passages."""
    monkeypatch.setattr(jj, "REGION_POINTS", limit)
    r = random.Random(11)
    base = [f"t{r.randint(0, 10**6)}" for _ in range(400)]
    passages = [[f"p{k}x{i}" for i in range(60)] for k in range(4)]
    rows = []
    for _ in range(40):
        rows.append(" ".join(edited(base, r.choice([0.03, 0.08, 0.1, 0.12, 0.15, 0.2]), r)[:r.choice([400, 390, 350, 320])]))
    for _ in range(30):
        own = [f"o{r.randint(0, 10**9)}" for _ in range(r.randint(200, 500))] + r.choice(passages)
        rows += [" ".join(own), " ".join(edited(own, r.choice([0.05, 0.09, 0.11, 0.25]), r))]
    rows = list(enumerate(rows))
    got = sorted([tuple(x) for x in jj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()], key=repr)
    assert got == brute_components(rows)


def test_jaccard_passages_do_not_chain(spark):
    """Texts with near copies of their own that have only a passage in common fall into regions of their own."""
    r = random.Random(5)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for k in range(12):
        own = [f"w{k}x{i}" for i in range(300)]
        rows += [(2 * k, " ".join(own + passage)), (2 * k + 1, " ".join(edited(own, 0.05, r) + passage))]
    rows += rows[:3]                          # repeated rows
    got = jj.divided(spark.createDataFrame(rows, "s1 long, text string")).collect()
    of = {}
    for x in got:
        of.setdefault(x.region, set()).add(x.s1)
    assert sorted(of.values(), key=min) == [{2 * k, 2 * k + 1} for k in range(12)]


def test_jaccard_empty(spark):
    assert jj.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- span dedup ---------------------------------------------------------------

def brute_spans(rows):
    """Texts after removal, by definition: every span of every document against all others."""
    seg = {i: sd.sentences(t) for i, t in rows if i is not None and t is not None}
    occ = {}
    for i in sorted(seg):
        f = seg[i]
        for k in range(len(f)):
            j, words = k, 0
            while j < len(f) and (j - k < sd.MIN_SENTENCES or words < sd.MIN_WORDS):
                words += len(f[j][2])
                j += 1
            if j - k >= sd.MIN_SENTENCES and words >= sd.MIN_WORDS:
                occ.setdefault(tuple(tuple(x[2]) for x in f[k:j]), []).append((i, k, j))
    gone = {}
    for places in occ.values():
        for i, k, j in sorted(places)[1:]:
            gone.setdefault(i, set()).update(range(k, j))
    out = []
    for i, t in rows:
        if i in gone and t is not None:
            for k in sorted(gone[i], reverse=True):
                t = t[:seg[i][k][0]] + t[seg[i][k][1]:]
        out.append((i, t, len(gone.get(i, ())) if t is not None else 0))
    return sorted(out, key=repr)


def test_span_dedup_matches_definition(spark):
    r = random.Random(3)
    shared = [prose(60, r) + ". " for _ in range(3)]
    rows = [(i, prose(r.randint(10, 80), r) + ". " + (r.choice(shared) if i % 2 else "") + prose(40, r)) for i in range(40)]
    rows += [(100, shared[0] + shared[0].upper()), (101, shared[0].replace(" ", "\n ")), (102, ""), (103, None),
             (104, "One. Two."), (105, "..."), (106, "no end"), (None, shared[0]), (107, prose(6000, r))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cuts", F.lit(1)).withColumn("lang", F.lit("en"))
    got = sd.dedup_spans(df)
    assert got.columns == ["doc_id", "text", "lang", "first_doc_ids", "n_sentences", "n_removed", "words_removed"]
    assert sorted([(x.doc_id, x.text, x.n_removed) for x in got.collect()], key=repr) == brute_spans(rows)
    changed = sd.dedup_spans(df, changed_only=True).collect()
    assert {x.doc_id for x in changed} == {i for i, _, n in brute_spans(rows) if n}


def test_span_dedup_single_sentences_and_runs(spark):
    """One long sentence between changed ones, a passage that starts and ends inside sentences, text without marks."""
    def plain(n):
        return " ".join(f"v{r.randint(0, 10**6)}" for _ in range(n))

    r = random.Random(9)
    single, inside, bare = plain(22), plain(60), plain(300)
    rows = [(1, f"{plain(12)}. {single}. {plain(9)}."), (2, f"{plain(7)}. {single.upper()}.  {plain(15)}."),
            (3, f"{plain(10)} {inside} {plain(30)}. {plain(5)}."), (4, f"{plain(40)} {inside} {plain(8)}."),
            (5, bare), (6, bare), (7, f"{plain(30)} {bare} {plain(30)}"), (8, f"{plain(20)} {plain(19)}."),
            (9, "again " * 200), (10, f"{plain(6)} {inside[:200].upper()}")]
    got = {x.doc_id: x for x in sd.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    for i in (1, 3, 5, 8):
        assert got[i].text == text[i] and got[i].n_removed == 0
    assert got[2].text == text[2].replace(single.upper() + ".  ", "") and got[2].words_removed == 22
    assert got[6].text == "" and got[6].words_removed == 300
    for i, passage in ((4, inside), (7, bare)):
        kept, own = got[i].text.split(), [w for w in text[i].split() if w not in passage.split()]
        assert [w for w in kept if w in own] == own and len(kept) - len(own) <= 2 * (sd.WINDOW - 1)
        assert got[i].words_removed == len(text[i].split()) - len(kept) >= sd.GRAM and got[i].n_removed == 1
    assert sd.GRAM <= len(got[9].text.split()) <= sd.GRAM + sd.WINDOW
    seen = set()
    n = sd.GRAM + sd.WINDOW - 1
    for i, _ in rows:
        w = got[i].text.lower().split()
        runs = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}
        assert not runs & seen
        o = text[i].lower().split()
        seen |= {tuple(o[k:k + n]) for k in range(len(o) - n + 1)}


def test_span_dedup_query_has_every_document(spark, sf):
    from foldspark.llm.queries import QUERIES
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.n_removed for r in QUERIES["op4_span_dedup"](spark, sf).collect()}
    assert set(got) == {r.doc_id for r in docs.collect()} and 0 in got.values() and any(got.values())


def test_sentences_cover_the_text():
    for t in ["A b. C d!  E\nF? g", "", "\n\n", "no end", "a.b.c", "Hi... there\n\n.\nx"]:
        pieces = [m.group() for m in sd.SENTENCE.finditer(t)]
        assert "".join(pieces) == t


def test_span_dedup_empty(spark):
    assert sd.dedup_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- decontamination ----------------------------------------------------------

def test_wand_returns_all_above_threshold():
    r = random.Random(1)
    Term, Row = namedtuple("Term", "term tf df"), namedtuple("Row", "item_id text terms dl")
    for _ in range(60):
        texts = [prose(r.randint(3, 30), r, 40) for _ in range(r.randint(1, 40))]
        found = [dc.words(t) for t in texts]
        df = Counter(w for x in found for w in set(x))
        mean = sum(map(len, found)) / len(found)
        index = dc.Index([Row(i, t, [Term(w, x.count(w), df[w]) for w in set(x)], len(x))
                          for i, (t, x) in enumerate(zip(texts, found))], len(texts), mean)
        passages = [sorted({index.term[w] for w in dc.words(prose(r.randint(1, 60), r, 40)) if w in index.term})
                    for _ in range(20)]
        least = r.choice([0.2, 0.5, 0.8])
        want = []
        for k, p in enumerate(passages):
            score = Counter()
            for lists in index.postings:
                for t in p:
                    for item, x in zip(*lists.get(t, ((), ()))):
                        score[item] += x
            want += [(k, item) for item, x in score.items() if x >= least - 1e-9]
        got = dc.retrieve(index, [np.array(p, dtype=int) for p in passages], least)
        assert sorted((k, i) for k, i, _ in got) == sorted(want)


def test_decontamination_finds_planted_items(spark):
    r = random.Random(8)
    items = [(i, f"{prose(r.randint(12, 40), r)}? {prose(r.randint(3, 10), r)}.") for i in range(60)]
    docs = []
    for d in range(50):
        body = prose(r.randint(30, 400), r)
        if d % 5 == 0:
            w = body.split()
            at = r.randint(0, len(w))
            body = " ".join(w[:at]) + " " + items[d][1].upper() + " " + " ".join(w[at:])
        docs.append((d, body))
    question = items[7][1].split("?")[0]
    docs += [(100, question), (101, ""), (102, None), (103, items[3][1]), (None, items[4][1]), (103, items[3][1])]
    bench = items + [(None, "x y z"), (900, None), (901, ""), (5, "zzz" + items[5][1])]
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(0)),
                          spark.createDataFrame(bench, "item_id long, text string"), shard_items=25)
    assert sorted(((x.doc_id, x.item_id) for x in got.collect()), key=repr) == sorted(
        [(d, d) for d in range(0, 50, 5)] + [(103, 3), (103, 3), (None, 4)], key=repr)
    none = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                           spark.createDataFrame([], "item_id long, text string"))
    assert none.count() == 0
    assert dc.contaminated(spark.createDataFrame([], "doc_id long, text string"),
                           spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_items_with_one_changed_word(spark):
    """A changed word hides neither a short answer nor a short question; chance words of short items are no hit."""
    r = random.Random(31)
    asks = [(i, f"{prose(25, r)} Answer: {prose(8, r)}") for i in range(6)] + [(6, "what is it? so be it")]
    rows = [(100 + i, t) for i, t in asks]
    for i, t in asks[:6]:
        w = t.split()
        for at in (3, len(w) - 4):
            changed = [*w[:at], "changed", *w[at + 1:]]
            rows.append((200 + 10 * i + at % 10, prose(40, r) + " " + " ".join(changed) + " " + prose(40, r)))
    rows += [(900 + k, prose(300, r)) for k in range(5)] + [(950, "it is so and be what it may, so it"), (None, asks[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    items = spark.createDataFrame(asks, "item_id long, text string").withColumn("score", F.lit(0))
    hit = {(x.doc_id, x.item_id) for x in dc.contaminated(docs, items).collect()}
    assert {i for i, _ in hit if i is not None and 200 <= i < 900} == {i for i, _ in rows if i and 200 <= i < 900}
    assert not {i for i, _ in hit if i and 900 <= i < 950} and (None, 0) in hit
    left = dc.without_items(docs, items)
    assert left.columns == docs.columns
    want = [i for i, t in rows if i not in {x for x, _ in hit}]
    assert sorted(x.doc_id for x in left.collect()) == sorted(want)
    assert dc.without_items(docs, items.limit(0)).count() == len(rows) and dc.without_items(docs.limit(0), items).count() == 0


def test_run_lengths_survive_one_changed_word():
    for n in range(1, 60):
        k = dc.run_length(n)
        w = [str(i) for i in range(n)]
        for at in range(n):
            left = dc.runs(w, k) & dc.runs([*w[:at], "x", *w[at + 1:]], k)
            assert n < 5 or len(left) / len(dc.runs(w, k)) >= dc.MIN_OVERLAP
