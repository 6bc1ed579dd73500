"""The pipeline's stages on a small corpus, against what brute force says of each."""
import random

from pyspark.sql import functions as F

import corpus_pipeline as cp

from tests.llm.test_llm_text import brute_components, brute_spans, prose


def write(df, path):
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def corpus(spark, tmp):
    r = random.Random(21)
    items = [(i, f"{prose(25, r)} {prose(8, r)}") for i in range(10)]
    rows = []

    def add(t, lang="en", source="s1"):
        rows.append((len(rows), t, lang, source, len(t or "")))

    passage = ". ".join(prose(20, r) for _ in range(4)) + ". "
    for k in range(30):
        add(prose(r.randint(60, 200), r) + ". " + (passage if k % 5 == 0 else "") + prose(30, r), source=f"s{k % 3}")
    for k in range(5):
        add(rows[k][1])
        add(rows[k][1] + f" extra{k}")
    add(items[4][1].upper() + ". " + prose(50, r))
    add("123 ... 456", None)
    add("", "en")
    add(None, "en")
    add(prose(90, r), None, None)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn(
        "score", F.lit(1))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp}/benchmark.parquet")
    docs.write.parquet(f"{tmp}/documents.parquet")
    return spark.read.parquet(f"{tmp}/documents.parquet"), rows


def test_stages(spark, tmp_path):
    sf = str(tmp_path)
    docs, rows = corpus(spark, sf)
    text = {r[0]: r[1] for r in rows}
    out = {}
    for name, stage in cp.STAGES:
        docs = write(stage(spark, docs, sf), f"{sf}/{name}")
        if name != "source_mix":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
        before, out = out or text, {r.doc_id: r.text for r in docs.collect()}
        if name == "language":
            want = {i: t for i, t in before.items() if t and any(map(str.isalpha, t))}
            assert docs.where("lang is null").count() == 0
        elif name == "near_duplicates":
            want = {i: before[i] for i, _, c in brute_components(list(before.items())) if i == c}
        elif name == "repeated_spans":
            want = {i: t for i, t, n in brute_spans(list(before.items())) if not n or t.strip()}
            assert docs.where("n_chars <> length(text)").count() == 0
        elif name == "benchmark_leaks":
            assert set(before) - set(out) == {40}
            want = {i: t for i, t in before.items() if i != 40}
        else:
            want = {r.doc_id: before[r.doc_id] for r in docs.collect() if r.taken == r.size * r.copies and r.copies > 0}
            assert docs.count() > 0
        assert out == want, name
    again = {r.doc_id: r.text for r in cp.run(spark, sf).collect()}
    assert again == out


def test_stages_without_rows(spark, tmp_path):
    sf = str(tmp_path)
    docs, _ = corpus(spark, sf)
    docs = docs.limit(0)
    for name, stage in cp.STAGES:
        docs = write(stage(spark, docs, sf), f"{sf}/{name}")
        assert docs.count() == 0


def test_rows_without_id_and_repeated_rows(spark, tmp_path):
    """Clean rows without an id stay, leaks without one go, a row repeated under one id stays once."""
    sf = str(tmp_path)
    docs, rows = corpus(spark, sf)
    r = random.Random(77)
    clean, twice = prose(80, r), prose(70, r)
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").where("item_id = 7").first().text
    more = [(None, clean), (None, clean), (None, rows[3][1]), (None, f"{prose(40, r)}. {leak}. {prose(40, r)}"),
            (500, twice), (500, twice), (500, twice + " z")]
    extra = spark.createDataFrame([(i, t, "en", None, len(t), 1) for i, t in more], docs.schema)
    names = [*docs.columns, "size", "taken", "__text", "copies"]
    docs = write(docs.unionByName(extra).withColumns({c: F.lit(c) for c in names[6:]}), f"{sf}/all")
    kept = write(cp.near_duplicates(spark, docs, sf), f"{sf}/near")
    assert kept.columns == names
    assert kept.where(F.col("doc_id").isNull() & (F.col("text") == clean)).count() == 1
    assert kept.where(F.col("doc_id").isNull() & (F.col("text") == rows[3][1])).count() == 0
    assert [x.text for x in kept.where("doc_id = 500").collect()] == [twice]
    left = write(cp.benchmark_leaks(spark, kept, sf), f"{sf}/leaks")
    assert left.columns == names and left.where("doc_id is null").count() == kept.where("doc_id is null").count() - 1
    mixed = cp.source_mix(spark, left, sf)
    assert set(mixed.columns) == {*names, "source_size", "target"} and mixed.where("taken <> size * copies").count() == 0
