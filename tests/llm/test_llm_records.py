"""Archives, URL rules, vectors, components and the pipeline against round trips and brute force."""
import gzip
import hashlib
import json
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspark.llm import itq_dedup, url_filter, warc
from foldspark.llm.common import connected_components, shared_path
from foldspark.llm.queries import ORACLES, QUERIES
from foldspark.operators import joins

SF = "/root/testdata/sf0.001"


# ---- archives -----------------------------------------------------------------

PAGES = [(1, "http://a/1", "x" * 1500), (2, "http://a/2", "x" * 1500), (3, None, "short"), (4, "http://a/4", "short"),
         (5, "http://a/5", None), (6, "http://a/6", ""), (7, "http://a/7\r\nEvil: 1", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 40),
         (8, "http://a/8", "é\r\n\r\n\n" * 300), (9, "http://a/9", "é" * 500), (10, "http://a/10", "é" * 500),
         (2, "http://a/2", "x" * 1500), (None, "http://a/null", "y" * 2000), (12, "u", "x" * 999), (13, "u", "x" * 999),
         (14, "big", "z q" * 400_000)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_archive_round_trip(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(joins, "BROADCAST_BYTES", -1)
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("owner", F.lit(1)).repartition(3)
    got = warc.archive_pages(df, shared_path(spark, "test-warc")).collect()
    assert len(got) == len(PAGES) and all(r.verified for r in got)
    owner = {}
    for i, _, h in PAGES:
        p = (h or "").encode()
        if i is not None and len(p) >= 1000:
            owner[p] = max(i, owner.get(p, i))
    want = []
    for i, _, h in PAGES:
        p = (h or "").encode()
        o = owner.get(p) if len(p) >= 1000 and i is not None else None
        again = o is not None and o != i
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", o if again else None))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)


def test_members_and_index(spark):
    """Input files are single gzip streams; every output record is a member the index points at."""
    folder = shared_path(spark, "test-warc")
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    warc.write_archives(warc.plan_revisits(df), f"{folder}/mono", records_per_file=4)
    index = warc.normalise(spark, f"{folder}/mono", f"{folder}/members").collect()
    raw = {r.path: bytes(r.content) for r in spark.read.format("binaryFile").load(f"{folder}/mono").where(
        "path like '%.gz'").collect()}
    assert len(raw) >= 4
    plain = b""
    for data in raw.values():
        d = zlib.decompressobj(31)
        plain += d.decompress(data)
        assert d.eof and not d.unused_data
    files = {int(r.path.rsplit("part-", 1)[1][:5]): bytes(r.content) for r in spark.read.format("binaryFile").load(
        f"{folder}/members/kind=record").collect()}
    assert len(index) == len(PAGES) and sum(r.length for r in index) == sum(map(len, files.values()))
    for r in index:
        piece = files[r.part][r.offset:r.offset + r.length]
        d = zlib.decompressobj(31)
        record = d.decompress(piece)
        assert d.eof and not d.unused_data and record in plain and record.startswith(b"WARC/1.1\r\n")
        assert record.endswith(b"\r\n\r\n") and int(r.headers["content-length"]) < len(record)
    assert sorted(len(gzip.decompress(f)) for f in files.values()) and sum(
        len(gzip.decompress(f)) for f in files.values()) == len(plain)


def test_member_ends_in_zero():
    big = bytes(1 << 24)
    for data in (b"", b"a" * 300, big, big + b"x"):
        m = warc.member(data)
        assert m[-1] == 0 and gzip.decompress(m) == data


def test_archive_names_keep_the_part_number(spark, tmp_path):
    for part in ("part-00009-c000.txt", "part-99999-c000.txt", "part-100000-c000.txt", "part-1000001-c000.txt"):
        (tmp_path / part).write_text("x")
    warc._name_archives(spark, str(tmp_path))
    assert {f.name for f in tmp_path.iterdir() if not f.name.startswith(".")} == {
        f"part-{n}.warc.gz" for n in ("00009", "99999", "100000", "1000001")}


def test_archive_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_pages(none, shared_path(spark, "test-warc")).count() == 0
    assert json.loads("[]") == []


# ---- url rules ----------------------------------------------------------------

URLS = [(1, "http://WWW.Example.org/es/x?q#f"), (2, "https://example.org/en/12"), (3, "http://other.net/a"),
        (4, "http://alias.net/a"), (5, None), (6, "no scheme"), (7, "x://shop.com/de/1"), (8, "x://shop.com/fr/1"),
        (9, "http://notexample.org/es/1"), (10, "http://third.net/"), (11, "http://xcom/de/1"), (12, "http://example.org?x=/es/"),
        (3, "http://other.net/a"), (13, "http://É.com/de/"), (14, "a://b://c.com/de/")]
EDGES = [("http://other.net/a", "https://example.org/en/12"), ("http://alias.net/a", "http://other.net/a"),
         ("x://shop.com/fr/1", "x://shop.com/de/1"), ("http://third.net/", "http://third.net/"), (None, "http://third.net/"),
         ("http://third.net/", "http://gone.org/ok"), ("http://other.net/a", "https://example.org/en/12")]


@pytest.mark.parametrize("most", [10_000, 0])
def test_url_rules_and_aliases(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter.match_rules, "__defaults__", (most,))
    got = url_filter.judge(spark.createDataFrame(URLS, "page_id long, url string").withColumn("rule", F.lit("x")),
                           spark.createDataFrame(EDGES, "src string, dst string"), url_filter.rules_frame(spark))
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    assert got.count() == len(URLS)
    assert by[1] == ("www.example.org", "/es/x", "example.org/es/", "block")
    assert by[2][2:] == ("example.org/en/1", "block")
    assert by[3][2:] == by[4][2:] == (None, "block")            # aliases of a blocked url
    assert by[5] == by[6] == ("", "", None, "allow")
    assert by[7][2:] == ("com/de/", "block") and by[8][2:] == ("com/fr/", "allow")   # explicit allow holds
    assert by[9][2:] == ("org/", "allow") and by[10][2:] == (None, "allow") and by[11][2] is None
    assert by[12] == ("example.org", "", None, "allow") and by[13][0] == "É.com" and by[14][:2] == ("b:", "//c.com/de/")


def test_page_edges(spark):
    pages = [(1, "http://a.net/x.html?q", '<link rel="stylesheet" href="s.css"><LINK href="http://c.net/1" rel=canonical>'),
             (2, "http://a.net/2", "<meta content='0; URL=http://d.net/2' http-equiv='refresh'>"), (3, "bad", None), (4, None, "x")]
    got = {tuple(r) for r in url_filter.page_edges(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {("http://a.net/x.html?q", "http://c.net/1"), ("http://a.net/x.html?q", "https://a.net/x.html?q"),
                   ("http://a.net/2", "http://d.net/2"), ("http://a.net/2", "https://a.net/2")}


def test_query_strings_are_no_aliases(spark):
    """A blocked page takes its other schemes and hosts with it, and no page with another query or file name."""
    pages = spark.createDataFrame([
        (1, "https://shop.net/view?id=1", '<link rel="canonical" href="https://x.example.org/es/1">'),
        (2, "https://shop.net/view?id=2", None), (3, "http://www.shop.net/view?id=1#top", None),
        (4, "https://shop.net/view", None), (5, "https://shop.net/view.html?id=1", None),
        (6, "https://long.net/" + "a" * 200_000 + "?" + "b" * 200_000, "x")], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, url_filter.page_edges(pages), url_filter.rules_frame(spark)).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "allow", 6: "allow"}


def test_variants_of_an_address_are_one_wider_class(spark):
    """The wider class reaches over query, file ending and slash, and over stated links; no verdict follows it."""
    pages = spark.createDataFrame([
        (1, "https://shop.net/view?id=1", '<link rel="canonical" href="https://x.example.org/es/1">'),
        (2, "http://m.shop.net/view.html?id=2#top", None), (3, "https://shop.net/view/", None), (4, "https://shop.net/views", None),
        (5, "no address", None), (6, None, None)], "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, r.component, r.variant_component) for r in url_filter.judge(
        pages, url_filter.page_edges(pages), url_filter.rules_frame(spark), url_filter.page_variants(pages)).collect()}
    one = "http://m.shop.net/view.html?id=2#top"
    assert got == {1: ("block", "https://shop.net/view?id=1", one), 2: ("allow", one, one),
                   3: ("allow", "https://shop.net/view/", one), 4: ("allow", "https://shop.net/views", "https://shop.net/views"),
                   5: ("allow", "no address", "no address"), 6: ("allow", None, None)}


def test_rules_without_host_or_path(spark):
    rules = spark.createDataFrame([(None, "/", "block"), ("a.net", None, "block"), ("b.net", "/", "block")],
                                  "host string, path string, verdict string")
    urls = spark.createDataFrame([(1, "http://a.net/"), (2, "http://b.net/"), (3, None)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(urls, spark.createDataFrame([], "src string, dst string"), rules).collect()}
    assert got == {1: "allow", 2: "block", 3: "allow"}


def test_url_empty(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "src string, dst string"),
                            url_filter.rules_frame(spark)).count() == 0


# ---- components ---------------------------------------------------------------

def test_components(spark):
    r = random.Random(7)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1080)]
    edges += [(5000, i) for i in range(5001, 5200)] + [(1, 1), (None, 2), (7, None)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(v):
        root.setdefault(v, v)
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {v: find(v) for v in root}


# ---- vectors ------------------------------------------------------------------

def brute_vectors(rows, threshold=0.95):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v
          and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    links = set()
    for a in range(len(ok)):
        for b in range(a):
            x, y = ok[a][1], ok[b][1]
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links.add((a, b))
    return ok, links


@pytest.mark.parametrize("block", [1000, 7])
def test_vectors_recall_and_precision(spark, monkeypatch, block):
    monkeypatch.setattr(itq_dedup, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((150, 24))
    rows = []
    for b in base:
        for s in (0, 0.1, 0.2, 0.28):
            rows.append((len(rows), (b + s * rng.standard_normal(24)).tolist()))
    rows += [(1000 + i, rows[5][1]) for i in range(30)]
    special = [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [None] * 24), (None, rows[9][1]), (2004, []),
               (2005, [1.0, 2.0]), (2006, [2.0, 4.0]), (2007, (np.array(rows[8][1]) * 1000).tolist())]
    df = spark.createDataFrame(rows + special, "vec_id long, embedding array<double>").withColumn("links", F.lit(1))
    got = {r.vec_id: r for r in itq_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows) + len(special)
    ok, links = brute_vectors(rows + special)
    n = {i: 0 for i, _ in ok}
    for a, b in links:
        n[ok[a][0]] += 1
        n[ok[b][0]] += 1
    found = sum(got[i].n_links for i in n)
    assert all(got[i].n_links <= n[i] for i in n) and found >= 0.9 * 2 * len(links)
    assert got[2005].component_id == got[2006].component_id == 2005 and got[1000].n_links >= 30
    for i in (2000, 2001, 2002, 2003, 2004):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].component_id is None and got[None].kept is False
    assert all(r.kept == (r.component_id == r.vec_id) for i, r in got.items() if i is not None)
    assert itq_dedup.near_duplicates(df.limit(0)).count() == 0


def test_vectors_with_a_common_direction(spark):
    """Mean norm 0.9: pairs at the threshold are far apart once the mean is taken off."""
    rng = np.random.default_rng(4)

    def normed(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    x = normed(normed(rng.standard_normal((4000, 64))) * 0.45 + 0.9 * np.eye(64)[0])
    assert abs(np.linalg.norm(x.mean(axis=0)) - 0.9) < 0.02
    a = x[:500]
    u = rng.standard_normal(a.shape)
    u = normed(u - (u * a).sum(axis=1, keepdims=True) * a)
    c = rng.uniform(0.9501, 0.96, (500, 1))
    rows = [(i, v) for i, v in enumerate(np.concatenate([x, c * a + np.sqrt(1 - c ** 2) * u]).tolist())]
    _, links = brute_vectors(rows)
    got = itq_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(links) >= 500 and 0.95 * 2 * len(links) <= sum(r.n_links for r in got) <= 2 * len(links)


def test_vectors_of_many_lengths(spark):
    """No number of lengths is refused; a vector without another one of its length has no links."""
    rows = [(d, [1.0] * d) for d in range(1, 91)]
    got = itq_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(d, 0, d, True) for d in range(1, 91)]


@pytest.mark.parametrize("block", [1000, 30])
def test_vectors_beyond_any_table(spark, monkeypatch, block):
    """Where no number of tables reaches the recall asked for, every pair is compared, each once."""
    monkeypatch.setattr(itq_dedup, "BLOCK", block)
    monkeypatch.setattr(itq_dedup, "RECALL", 1.01)
    rng = np.random.default_rng(8)
    base = rng.standard_normal((60, 6))
    rows = [(i, v) for i, v in enumerate(np.concatenate([base, base + 0.25 * rng.standard_normal(base.shape)]).tolist())]
    ok, links = brute_vectors(rows)
    n = {i: 0 for i, _ in rows}
    for a, b in links:
        n[ok[a][0]] += 1
        n[ok[b][0]] += 1
    got = itq_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert links and {r.vec_id: r.n_links for r in got} == n


def test_vectors_on_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    ok, links = brute_vectors([(r.vec_id, list(r.embedding)) for r in df.collect()])
    got = itq_dedup.near_duplicates(df).collect()
    assert sum(r.n_links for r in got) >= 0.9 * 2 * len(links) and sum(r.n_links for r in got) <= 2 * len(links)


# ---- SQL ----------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(f"select {', '.join(cols)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(*cols).collect())
