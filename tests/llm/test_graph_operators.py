"""Operators on pages, embeddings and graphs."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.llm import spherical, url_equivalence, warc
from tessel.llm.components import connected_components
from tessel.llm.common import new_path


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 500 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in union_find([e for e in edges if e[0] != e[1]]).items()}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([(None, 1), (2, 2)], "u long, v long")).count() == 0


PAGES = "page_id long, url string, html string, payload string, digest string"


def test_warc(spark):
    tricky = "before\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nafter WARC/1.1\r\n" * 3
    same = "<p>é" + "x" * 200 + "</p>"
    rows = [(5, "http://a/", same), (3, "http://b/", same), (9, None, same), (1, "http://c/\r\nX: y", None), (2, "http://d/", ""), (4, "u", "short"), (6, "u", "short"), (7, "u", tricky), (8, "u", "WARC/1.1\r\n"), (20, "u", "ends in WARC/1.1"), (21, "http://x/WARC/1.1", "y"), (22, " http://x/a ", "WARC/1.1"),
            (23, "http://y/WARC/1.1", "WARC\r\n5\r\n/1.1\r\nWARC/1.1\r\n0\r\n\r\nWARC/1.1"), (24, "u", "WARC\r\n5\r\n/1.1\r\n"), (25, "u", "éWARC/1.1日本WARC/1.1WARC"), (26, "u", "WARC"), (27, "u", "/1.1\r\n"),
            (-3, "u", "\r\n\r\n"), (2**40, "u", "日本" * 100)]
    pages = spark.createDataFrame([(*r, "p", "d") for r in rows], PAGES)
    path = new_path(spark, "warc")
    warc.write_warc(pages, path)
    records = warc.read_warc(spark, path)
    uris = {r.uri for r in records.collect()}
    assert {"http://x/WARC/1.1", "http://y/WARC/1.1", "%20http://x/a%20", "http://c/%0D%0AX: y"} <= uris
    assert records.count() == 3 * len(rows) and records.where("not whole").count() == 0
    captures = {warc_id: r for r in warc.assemble(records).withColumn("page", warc.page_of(warc.F.col("capture_id"))).collect() for warc_id in [r.page]}
    assert set(captures) == {r[0] for r in rows}
    for i, _, html in rows:
        c = captures[i]
        assert c.request.warc_type == "request" and len(c.metadata) == 1
        assert c.response.payload_digest == "sha256:" + hashlib.sha256((html or "").encode()).hexdigest()
        if i in (5, 9):
            assert c.response.warc_type == "revisit" and c.response.payload is None
        else:
            assert c.response.warc_type == "response" and c.response.payload == (html or "")


def test_warc_query(spark, tmp_path):
    same = "y" * 150
    rows = [(1, "u", same), (2, "u", same), (3, "u", same[:99]), (4, "u", same[:99]), (5, "u", None), (6, "WARC/1.1", "WARC\r\n5\r\n/1.1\r\nWARC/1.1")]
    spark.createDataFrame([(*r, "p", "d") for r in rows], PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.op3_warc(spark, str(tmp_path)).collect()}
    assert got == {1: (150, "response", None), 2: (150, "revisit", 1), 3: (99, "response", None), 4: (99, "response", None), 5: (0, "response", None), 6: (len(rows[5][2]), "response", None)}
    digests = {r.page_id: r.payload_digest for r in warc.op3_warc(spark, str(tmp_path)).collect()}
    assert digests == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, _, t in rows}


def test_foreign_records(spark, tmp_path):
    """Records of other writers: chunks of other sizes, one that parts a character, and a record that is not whole."""
    text = "é" * 20 + "tail"
    raw = text.encode()
    chunks = b"".join(b"%X;x=1\r\n" % len(c) + c + b"\r\n" for c in (raw[:7], raw[7:8], raw[8:])) + b"0\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\ntransfer-encoding:  chunked \r\n\r\n" + chunks
    record = lambda n: b"WARC/1.1\r\nContent-Length: %d\r\nWARC-Type: response\r\nWARC-Record-ID: <r>\r\n\r\n" % n + block + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record(len(block)) + record(len(block) + 1))
    got = [(r.whole, r.payload) for r in warc.read_warc(spark, str(tmp_path)).collect()]
    assert sorted(got) == [(False, text), (True, text)]


def test_chunked_bodies(spark):
    """Chunks of any number, cut anywhere in a character, with extensions; bodies that don't fit give null."""

    def chunked(parts):
        return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"

    rng = random.Random(4)
    text = "".join(rng.choice("ab é日😀\r\n0f") for _ in range(40_000)).encode()
    cuts = sorted(rng.sample(range(1, len(text)), 5000))
    many = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
    cases = [(chunked(many), text.decode()), (chunked([]), ""), (b"3;x=y\r\nabc\r\n0\r\n\r\n", "abc"), (chunked(many)[:-7], None), (b"7\r\nabc", None), (b"no size", None), (b"", None), (None, None)]
    cases += [(chunked([b"x"] * n), "x" * n) for n in (127, 128, 129, 256)]
    frame = spark.createDataFrame([(i, bytearray(c) if c is not None else None) for i, (c, _) in enumerate(cases)], "i int, body binary")
    # as the reader does, with the body as a string of bytes that may be cut inside a character
    got = {r.i: r.t for r in frame.select("i", warc._dechunked(F.col("body").cast("string")).alias("t")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_warc_of_nothing(spark):
    path = new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([], PAGES), path)
    assert warc.assemble(warc.read_warc(spark, path)).count() == 0


def test_assemble_parts(spark):
    kind = "warc_type string, record_id string, concurrent_to string, payload string"
    rows = [("request", "q", "r", None), ("response", "r", None, "x"), ("metadata", "m1", "r", None), ("metadata", "m2", "r", None), ("request", "lone", "gone", None), ("response", None, None, "y")]
    got = {r.capture_id: r for r in warc.assemble(spark.createDataFrame(rows, kind)).collect()}
    assert set(got) == {"r", "gone"}
    assert [m.record_id for m in got["r"].metadata] == ["m1", "m2"] and got["gone"].response is None and got["gone"].metadata == []


def test_urls(spark):
    canonical = lambda u: f'<html><head><LINK href="{u}" rel=canonical></head>'
    refresh = lambda u: f"<meta http-equiv='refresh' content='0; url={u}'>"
    rows = [
        (1, "http://Example.COM/en/1", None),
        (2, "http://m.example.com/en/2?x#y", ""),
        (3, "https://www.example.com/en/3", canonical("http://example.com/en/1")),
        (4, "http://mirror.org/a", canonical("http://example.com/en/1")),
        (5, "http://other.org/b#top", refresh("http://mirror.org/a")),
        (6, "http://safe.org/", canonical("http://www.example.com/en/9")),
        (7, "http://x.net/es/", canonical("http://safe.org/")),
        (8, "http://deep.org/1", refresh("http://deep.org/2")),
        (9, "http://deep.org/2", refresh("http://y.net/fr/?a=1&amp;b=2")),
        (10, None, "x"), (11, "no scheme", "x"), (12, "http://plain.org", "x"), (13, "http://notcom/", None), (14, "http://a.com", None), (15, "http://net/es/x", None), (8, "http://deep.org/1", None),
    ]
    pages = spark.createDataFrame([(*r, "rule", "host") for r in rows], "page_id long, url string, html string, rule string, host string")
    out = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_equivalence.judge(pages).collect()]
    got = {r[0]: r[1:] for r in out}
    assert len(out) == len(rows)
    assert got[1] == ("example.com", "/en/1", "example.com/en/", "block") and got[2] == ("m.example.com", "/en/2", "example.com/en/", "block")
    assert got[3][2:] == ("www.example.com/en/", "allow")
    # page 3 is allowed and an alias of page 1, so the whole component is allowed where it has no rule
    assert got[4][2:] == (None, "allow") and got[5][2:] == (None, "allow")
    assert got[6][2:] == (None, "allow") and got[7][2:] == ("net/es/", "block")
    assert got[8][2:] == (None, "block") and got[9][2:] == (None, "block")
    assert got[10] == got[11] == ("", "", None, "allow") and got[12] == ("plain.org", "", None, "allow") and got[13][2] is None
    assert got[14][2:] == (None, "allow") and got[15][2:] == ("net/es/", "block")
    more = spark.createDataFrame([("http://plain.org", "http://y.net/es/")], "url string, target string")
    assert {r.page_id: r.verdict for r in url_equivalence.judge(pages, more).collect()}[12] == "block"
    assert url_equivalence.judge(pages.limit(0)).count() == 0


def test_relative_targets(spark):
    base = "http://A.org/d/e/p.html?q=1/2#f"
    want = {
        "/fr/x": "http://A.org/fr/x", "x.html": "http://A.org/d/e/x.html", "?p=1": "http://A.org/d/e/p.html?p=1", "//h.net/x": "http://h.net/x",
        "./x": "http://A.org/d/e/x", "../x?u=http://z/": "http://A.org/d/x?u=http://z/", "../../../..": "http://A.org/", "..": "http://A.org/d/",
        "https://z.org/../y": "https://z.org/../y", "#top": None, "mailto:me": None,
    }
    links = spark.createDataFrame([(base, t) for t in want] + [("no scheme", "/x"), ("http://bare", "x"), ("http://bare?a", "?b")], "url string, target string")
    got = {(r.url, r.target): r.to for r in links.withColumn("to", url_equivalence.resolved(warc.F.col("url"), warc.F.col("target"))).collect()}
    assert {t: got[base, t] for t in want} == want
    assert got["no scheme", "/x"] is None and got["http://bare", "x"] == "http://bare/x" and got["http://bare?a", "?b"] == "http://bare?b"


def test_sql_of_links(spark, tmp_path):
    """The query's SQL and the query on pages with links of all kinds, a hub, null and repeated urls and ties of rules."""
    import duckdb

    rng = random.Random(3)
    hosts = ["a.net", "b.org", "www.example.com", "Example.com", "c.d.net", "com", "x.com"]
    targets = ["/fr/x", "x.html", "?p=1", "//c.net/es/y", "../e", "./../..", "..", "#top", "mailto:m", "http://a.net/es/1", "HTTPS://B.org/q?a=1&amp;b=2", "es/.", "a//b", "?", "http://hub.org/"]
    tag = lambda t: rng.choice([f'<link rel="canonical" href="{t}">', f"<meta http-equiv=refresh content='0; url={t}'>", f'<link rel=icon href="{t}">'])
    rows = [(i, f"http://{rng.choice(hosts)}/{rng.choice(['en/', 'es/', 'fr/', 'q/r', '', 'fr'])}{rng.choice(['', '1', '2?z=/', 'k#f/g'])}", "x".join(tag(rng.choice(targets)) for _ in range(rng.randint(0, 2)))) for i in range(300)]
    rows += [(300, None, tag("/fr/x")), (301, "no scheme", tag("x")), (302, "http://bare", tag("x")), (303, "http://a.net", None), (304, rows[0][1], rows[0][2])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({url_equivalence.OP4_SQL})").fetchall()
    got = [tuple(r) for r in url_equivalence.op4_url_equivalence(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len({r[4] for r in got if r[3] is None}) == 2


def test_relative_links_spread(spark):
    canonical = lambda u: f'<link rel="canonical" href="{u}">'
    rows = [
        (1, "http://a.net/x/1", canonical("/fr/x")), (2, "https://b.org/1", canonical("//c.net/es/y")), (3, "http://d.net/fr/1", ""),
        (4, "http://d.net/go/4?a", "<meta http-equiv=refresh content='0; url=../fr/1'>"), (5, "http://e.net/es", canonical("es/7")), (6, "http://e.net/", canonical("?p=1")),
        (7, "http://e.net/q", canonical("/?p=1")), (8, "http://e.net/es/8", canonical("/q")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_equivalence.judge(pages).collect()}
    assert got == dict.fromkeys(range(1, 9), "block")


def brute_links(rows, similar=0.9):
    good = {i: np.asarray(v, float) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: set() for i, _ in rows}
    for i, a in good.items():
        for j, b in good.items():
            if i != j and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= similar:
                links[i].add(j)
    return links


def test_spherical(spark):
    rng = np.random.default_rng(0)
    rows, n = [], 0
    centres = rng.normal(size=(12, 32))
    for k, c in enumerate(centres):
        c /= np.linalg.norm(c)
        for _ in range([1, 3, 8, 40][k % 4]):
            x = c + rng.normal(size=32) * [0.001, 0.02, 0.05, 0.075][k % 4 if k < 8 else 3]
            rows.append((n, [float(np.float32(v)) for v in x * rng.uniform(0.1, 9)]))
            n += 1
    rows += [(900, None), (901, []), (902, [0.0] * 32), (903, [float("nan")] * 32), (904, [None] + [1.0] * 31), (905, [float("inf")] + [0.0] * 31), (906, [1.0, 0.0]), (907, [2.0, 0.0]), (908, rows[5][1]), (5, rows[5][1])]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, n_links int")
    want = brute_links(dict(rows).items())
    got = {r.vec_id: r for r in spherical.linked_vectors(frame).collect()}
    assert set(got) == set(want)
    links = sum(map(len, want.values()))
    found = sum(r.n_links for r in got.values())
    assert all(got[i].n_links <= len(want[i]) for i in want) and found >= 0.97 * links and links > 400
    roots = union_find([(i, j) for i, v in want.items() for j in v])
    assert np.mean([got[i].component_id == roots.get(i, i) for i in want]) > 0.97
    assert spherical.linked_vectors(frame.limit(0)).count() == 0


def at_cosine(rng, x, cosine):
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    return cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)


@pytest.mark.parametrize(("dims", "balls"), [(64, 2_000), (64, 50_000), (64, 10**9), (16, 50_000), (384, 50_000)])
def test_spherical_filters_meet(dims, balls):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1000, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    caps = spherical.Caps.of(dims, balls, np.arccos(0.9), np.radians(spherical.RADIUS))
    assert caps.count <= spherical.MOST_CODES
    pairs = lambda y, ball: {tuple(r) for r in np.stack(caps.decode(y, np.full(len(y), ball)), axis=1).tolist()}
    mine = [pairs(x, ball) for ball in (False, True)]
    link, radius = np.arccos(0.9), np.radians(spherical.RADIUS)
    cases = [(c, 0, 0, 0.997) for c in (0.9, 0.91, 0.92, 0.97)] + [(np.cos(link + radius), 0, 1, 0.985), (np.cos(link + radius), 1, 0, 0.985), (np.cos(link + 2 * radius), 1, 1, 0.985)]
    for cosine, a, b, least in cases:
        met = {r[0] for r in mine[a] & pairs(at_cosine(rng, x, cosine), bool(b))}
        assert len(met) / len(x) >= least, (cosine, a, b)


def test_spherical_filters_leave_most_pairs_alone():
    """Comparisons over all pairs, with repeats, from the share of the sphere that a filter holds."""

    def work(balls):
        caps = spherical.Caps.of(64, balls, np.arccos(0.9), np.radians(spherical.RADIUS))
        return balls**2 * caps.count * caps.words**spherical.PARTS * spherical.reach(caps.cap, 64) ** 2

    sizes = [1_000, 20_000, 40_000, 640_000, 1_280_000, 20_480_000, 40_960_000]
    found = {n: work(n) for n in sizes}
    assert found[1_000] < 0.6 * 1_000**2 and found[20_000] < 0.2 * 20_000**2 and found[1_280_000] < 0.01 * 1_280_000**2
    for n in (20_000, 640_000, 20_480_000):
        assert found[2 * n] < 3.2 * found[n], n
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    caps = spherical.Caps.of(64, 4000, np.arccos(0.9), np.radians(spherical.RADIUS))
    _, held = np.unique(caps.decode(x, np.zeros(4000, bool))[1], return_counts=True)
    assert (held.astype(np.int64) ** 2).sum() < 0.35 * 4000**2


def test_product_code_decodes_all():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 21))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code = spherical.ProductCode(21, 4, 16)
    directions = np.zeros((16**2, 21))
    for i in range(16):
        for j in range(16):
            directions[i * 16 + j, code.parts[0]] = code.words[0][:, i]
            directions[i * 16 + j, code.parts[1]] = code.words[1][:, j]
    assert np.allclose(np.linalg.norm(directions, axis=1), 1)
    for cap in (0.0, 0.3, 0.5):
        assert set(zip(*map(np.ndarray.tolist, code.decode(x, np.full(len(x), cap))))) == set(zip(*map(np.ndarray.tolist, np.nonzero(x @ directions.T >= cap))))


@pytest.mark.parametrize("block", [512, 16])
def test_spherical_open_balls(spark, monkeypatch, block):
    """Groups at the edge of a link, whose balls are neither wholly linked nor wholly apart, among many other vectors."""
    monkeypatch.setattr(spherical, "BLOCK", block)
    rng = np.random.default_rng(8)
    unit = lambda y: y / np.linalg.norm(y, axis=1, keepdims=True)
    rows = list(unit(rng.normal(size=(600, 64))))
    for k in range(12):
        centre = unit(rng.normal(size=(1, 64)))
        for other in (centre, at_cosine(rng, centre, 0.905), at_cosine(rng, centre, 0.95)):  # three balls of copies, not quite equal
            rows += list(unit(other + rng.normal(size=(3 + k, 64)) * 0.006))
    for k in range(20):
        rows += list(at_cosine(rng, np.repeat(unit(rng.normal(size=(1, 64))), 6, axis=0), 0.963))
    data = [(i, v.tolist()) for i, v in enumerate(rows)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in spherical.linked_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    x = unit(np.array(rows))
    linked = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    roots = union_find([(int(i), int(j)) for i, j in zip(*np.nonzero(linked))])
    want = {i: (int(linked[i].sum()), roots.get(i, i)) for i in range(len(x))}
    assert sum(n for n, _ in want.values()) > 3000
    assert np.mean([got[i] == want[i] for i in want]) >= 0.99
    assert sum(n for n, _ in got.values()) >= 0.995 * sum(n for n, _ in want.values()) and all(got[i][0] <= want[i][0] for i in want)


def test_spherical_recall_by_band(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    band = np.repeat([0.902, 0.91, 0.92, 0.95, 0.97, 0.89, 0.88], 100)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, at_cosine(rng, x, band[:, None])]))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in spherical.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == 1400
    for cosine in np.unique(band):
        found = [got[i + 700] == (1, i) and got[i] == (1, i) for i in np.flatnonzero(band == cosine).tolist()]
        assert np.mean(found) >= 0.99 if cosine > 0.9 else not any(found), cosine
