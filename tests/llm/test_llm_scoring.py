"""Token counts, language ID, toxicity and mixing against libraries, brute force and held-out rows."""
import math
import random

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from foldspark.llm import mixing, ppm_langid, token_count, toxicity
from foldspark.sources.tables import table

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_token_counts_equal_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    r = random.Random(2)
    texts = ["", None, " ", "  a  b ", "a\tb\n\nc", "<s> x </s> <unk>", "▁▁ a ▁", "\u3000ﬁ ü ß", "a\x00b", "日本語のテキスト",
             "🙂🙂 e\u0301", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 50, "the " * 3000, " " * 100]
    texts += ["".join(r.choice("abcde  \n▁éß中🙂") for _ in range(r.randint(1, 300))) for _ in range(80)]
    rows = list(enumerate(texts)) + [(0, "twice"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit(1))
    got = sorted((tuple(x) for x in token_count.count_tokens(df, MODEL).collect()), key=repr)
    want = []
    for i, t in rows:
        n = len(sp.encode(t or ""))
        want.append((i, len((t or "").encode()), n, n > 4096))
    assert got == sorted(want, key=repr)
    assert token_count.count_tokens(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0


def brute_ppm(train, text, order):
    """Code length of ``text`` in bits from counts in plain dictionaries."""
    counts = {}
    for t in train:
        a = b"\n" * order + t
        for i in range(order, len(a)):
            for k in range(order + 1):
                c = counts.setdefault(a[i - k:i], {})
                c[a[i]] = c.get(a[i], 0) + 1
    a, bits = b"\n" * order + text, 0.0
    for i in range(order, len(a)):
        for k in range(order, -1, -1):
            c = counts.get(a[i - k:i])
            if not c:
                continue
            n, d = sum(c.values()), len(c)
            if a[i] in c:
                bits -= math.log2(c[a[i]] / (n + d))
                break
            bits -= math.log2(d / (n + d))
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact(spark):
    r = random.Random(4)
    docs = [(i, "".join(r.choice("abé c" if i % 2 else "xyzß d") for _ in range(r.randint(1, 60))), "p" if i % 2 else "q")
            for i in range(60)]
    df = spark.createDataFrame(docs + [(99, None, "p"), (98, "text", None)], "doc_id long, text string, lang string")
    trees = ppm_langid.train(df)
    kept = {r.doc_id for r in df.where(~ppm_langid.held_out(F.col("doc_id"))).select("doc_id").collect()}
    for text in ["", "a", "abc é\n", "xyz totally new ☃ bytes", docs[0][1]]:
        for k, lang in enumerate(trees.langs):
            want = brute_ppm([t.encode() for i, t, x in docs if i in kept and x == lang], text.encode(), ppm_langid.ORDER)
            assert math.isclose(trees.bits(text.encode(), step=7)[k], want, rel_tol=1e-9, abs_tol=1e-9)


def test_language_id_cases(spark):
    docs = [(i, "abc cab " * 3, "p") for i in range(9)] + [(i, "xyz zyx " * 3, "q") for i in range(9, 18)]
    extra = [(50, None, "p"), (51, "", None), (52, "123 ... 45", "q"), (53, "bca abc", None), (None, "zyx xyz", "q"), (53, "x", "p")]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    got = ppm_langid.identify(df).collect()
    assert len(got) == 24 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.lang_pred for r in got if r.doc_id != 53}
    assert by[50] == by[51] == by[52] == "und" and by[None] == "q" and by[0] == "p"
    none = ppm_langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert ppm_langid.identify(df.limit(0)).count() == 0


def test_language_id_held_out_accuracy(spark):
    d = table(spark, SF, "documents")
    got = ppm_langid.identify(d).where("held_out").join(d.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 20 and np.mean([r.lang_pred == r.lang for r in got]) > 0.95


def test_toxicity_held_out_and_cases(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    scorer = toxicity.train(d, labels)
    got = toxicity.score(d, scorer).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in got)
    assert hit / sum(r.toxic for r in got) > 0.75 and hit / max(1, sum(r.predicted for r in got)) > 0.8
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (1, "y"), (3, "word " * 50000)],
                                "doc_id long, text string").withColumn("predicted", F.lit(9))
    out = toxicity.score(odd, scorer).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert toxicity.score(odd.limit(0), scorer).count() == 0
    for none in (labels.limit(0), labels.withColumn("toxic", F.lit(None).cast("int"))):
        assert {r.score for r in toxicity.score_toxicity(odd, none).collect()} == {1 / (1 + math.exp(50.0))}


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(40_000) < 0.2
    hit = np.array([0.7, 0.6, 0.5, 0.65, 0.3])
    false = np.array([0.03, 0.05, 0.02, 0.04, 0.3])     # the last voter knows nothing
    v = np.where(y[:, None], rng.random((len(y), 5)) < hit, rng.random((len(y), 5)) < false)
    v = np.column_stack([v, v[:, 0]])                   # and one repeats the first
    masks, n = np.unique((v << np.arange(6)).sum(axis=1), return_counts=True)
    m = toxicity.LabelModel(masks, n.astype(float), 6, 0.2, lead=4)
    assert np.abs(m.rate1[:4] - hit[:4]).max() < 0.12 and np.abs(m.rate0[:4] - false[:4]).max() < 0.05
    assert m.repeat[0] > 1.8 and m.repeat[5] > 1.8 and m.repeat[1] < 1.5
    p = m.posterior((v << np.arange(6)).sum(axis=1))
    assert ((p > 0.5) == y).mean() > 0.93


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Iterative resharing, source by source."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, open_, done = sum(sizes.values()), set(order), {}
    while open_:
        left = total - sum(done.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            done.update(share)
            break
        for s in over:
            done[s] = most * sizes[s]
            open_.discard(s)
    return done


def test_mix_targets_and_budgets(spark):
    r = random.Random(6)
    rows = []
    for i in range(3000):
        s = r.choice(["a"] * 30 + ["b"] * 5 + ["Z", "é", None, "c", "tiny"])
        rows.append((i, " ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 40))), s))
    rows += [(9000, None, "a"), (9001, "", "void"), (None, "x y", "b"), (9002, "w " * 9000, "c"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    taken, largest = {}, {}
    for x in got:
        assert x.source_size == sizes[x.source] and math.isclose(x.target, want[x.source], rel_tol=1e-9, abs_tol=1e-9)
        assert x.taken == x.size * x.copies and x.copies <= 3
        taken[x.source] = taken.get(x.source, 0) + x.taken
        largest[x.source] = max(largest.get(x.source, 0), x.size)
    for s in sizes:
        assert 0 <= want[s] - taken[s] + 1e-6 and want[s] - taken[s] <= largest[s] + 1e-6
    again = {(x.doc_id, x.source, x.taken) for x in mixing.mix(df.repartition(7)).collect()}
    assert again == {(x.doc_id, x.source, x.taken) for x in got}
    assert mixing.mix(df.limit(0)).count() == 0


def test_thresholds_are_nested(spark):
    df = spark.createDataFrame([(i, "a", 3) for i in range(500)], "doc_id long, source string, size long").withColumn(
        "h", F.substring(F.md5(F.col("doc_id").cast("string")), 1, 15))
    kept = []
    for budget in (0, 10, 600, 601, 1500, 9999):
        b = mixing.thresholds(df, spark.createDataFrame([("a", float(budget))], "source string, budget double")).first().below
        kept.append({r.doc_id for r in df.where(F.col("h") < b).collect()})
        assert len(kept[-1]) == min(500, budget // 3)
    assert all(a <= b for a, b in zip(kept, kept[1:]))


def test_mix_splits_rows_with_one_hash(spark):
    """Rows without ids, and equal rows, are taken one by one, so the source comes near its target."""
    rows = [(None, f"{'w ' * 20}x{k}", "a") for k in range(300)] + [(None, "w " * 20, "b")] * 300 + [(k, "w " * 90, "c") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).toPandas()
    for _, part in got.groupby("source"):
        assert part.taken.sum() <= part.target.iloc[0] and part.taken.sum() > part.target.iloc[0] - 2 * part["size"].max()
    again = mixing.mix(df.repartition(5)).groupBy("source").agg({"taken": "sum"}).collect()
    assert {tuple(x) for x in again} == {(s, int(t)) for s, t in got.groupby("source").taken.sum().items()}


def test_mix_rows_keeps_columns(spark):
    rows = [(None if k % 7 == 0 else k, "w " * (k % 9), "ab"[k % 2], k, "x") for k in range(90)] + [(5, "w " * 3, None, 5, "y")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, h string")
    got = mixing.mix_rows(df)
    assert got.columns == ["doc_id", "text", "source", "h", "size", "source_size", "target", "taken", "copies"]
    assert {r.h for r in got.collect()} <= {"x", "y"} and got.where("taken <> size * copies or copies < 1").count() == 0
    assert mixing.mix_rows(df.limit(0)).count() == 0


def test_many_languages(spark, monkeypatch):
    """No number of languages is refused; groups of tables give the code lengths of one table."""
    words = {f"l{i:03}": "".join(chr(97 + (i * 7 + j * j) % 26) for j in range(12)) for i in range(40)}
    rows = [(k, f"{w} {w[::-1]} {w} {k}", lang) for k, (lang, w) in enumerate((x for x in words.items() for _ in range(8)))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one = ppm_langid.identify(df).collect()
    monkeypatch.setattr(ppm_langid, "GROUP", 64)
    whole = ppm_langid.identify(df).collect()
    assert sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in one) == sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in whole)
    truth = {i: lang for i, _, lang in rows}
    assert sum(r.lang_pred == truth[r.doc_id] for r in one) > 0.9 * len(rows)
