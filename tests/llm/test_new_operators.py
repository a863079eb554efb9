"""Whitening, prefix trie and HTML extraction against brute force."""

import hashlib
import html as entities
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from riskspark.llm import htmltext, queries, trie, whiten

# ---------------------------------------------------------------- whitening


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_spectral_components(n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(200, n)) * 100
    q = np.linalg.qr(rng.normal(size=(n, n)))[0]
    for v in (x.T @ x / 200, np.eye(n), np.zeros((n, n)), np.ones((n, n)), q @ np.diag(np.repeat([5.0, 1.0, 0.0], n)[:n]) @ q.T,
              q @ np.diag(1 + 1e-13 * np.arange(n)) @ q.T, q @ np.diag(10.0 ** -np.arange(n)) @ q.T):
        values, vectors = whiten.spectral_components(v)
        scale = max(np.linalg.norm(v), 1e-300)
        assert np.all(np.diff(values) <= 0)
        assert np.abs(values - np.linalg.eigvalsh(v)[::-1]).max() < 1e-12 * scale
        assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-12
        assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * scale


def check_whitening(got, vectors, components=8):
    """Rows of the operator against numpy over {id: list}."""
    ids = sorted(vectors)
    x = np.array([[int(np.floor(1024 * float(c))) + 100000 for c in vectors[i]] for i in ids], dtype=object)
    n, sums = len(x), x.sum(0)
    z = (x - sums.astype(float) / n).astype(float)
    v = z.T @ z / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, x.shape[1])
    rows = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(rows) == n * k
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-6
    for i, row in zip(ids, x):
        dev = sum((n * a - s) ** 2 for a, s in zip(row, sums))
        assert {(rows[i, c].deviation, rows[i, c].deviation_exact) for c in range(1, k + 1)} == {(dev if dev < 1 << 63 else None, str(dev))}
    for c in range(k):
        want = z @ axes[:, c] / np.sqrt(values[c])
        have = np.array([rows[i, c + 1].whitened for i in ids])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-7
        assert abs(rows[ids[0], c + 1].explained / (values[c] / np.trace(v)) - 1) < 1e-9


def test_whitening_of_the_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = queries.op11_embedding_whitening(spark, sf).collect()
    check_whitening(got, {r.vec_id: r.embedding for r in table.collect()})


def test_whitening_of_odd_rows(spark):
    rng = random.Random(2)
    good = {i: [rng.gauss(0, 1), rng.gauss(5, 3), float(i % 7)] for i in range(500)}
    odd = [(900, None), (901, [1.0, None, 2.0]), (902, [float("nan"), 1.0, 1.0]), (903, [float("inf"), 1.0, 1.0]), (904, [1.0]), (905, [])]
    schema = "vec_id long, embedding array<float>, `v.x` string"
    rows = [(i, v, "x") for i, v in [*good.items(), *odd]]
    as_floats = {i: [float(np.float32(c)) for c in v] for i, v in good.items()}
    check_whitening(whiten.whiten(spark.createDataFrame(rows, schema)).collect(), as_floats)
    assert whiten.whiten(spark.createDataFrame(rows[500:504], schema)).count() == 0
    assert whiten.whiten(spark.createDataFrame([], schema)).count() == 0
    # no variance at all, one row, repeated rows, a null id: zeros instead of a division by zero
    same = spark.createDataFrame([(1, [2.0, 2.0], ""), (1, [2.0, 2.0], ""), (None, [2.0, 2.0], "")], schema)
    got = whiten.whiten(same).collect()
    assert len(got) == 6 and {(r.whitened, r.explained, r.identity_error, r.deviation) for r in got} == {(0.0, 0.0, 0.0, 0)}
    # far beyond the doubles that hold all integers: sums and deviations stay exact
    far = {1: [1e9, 1.0], 2: [-3e9, 2.0], 3: [5.5e9, -7.0]}
    exact = whiten.whiten(spark.createDataFrame([(i, v, "") for i, v in far.items()], "vec_id long, embedding array<double>, z string")).collect()
    x = {i: [int(np.floor(1024 * c)) + 100000 for c in v] for i, v in far.items()}
    sums = [sum(v[d] for v in x.values()) for d in range(2)]
    assert {(r.vec_id, r.deviation_exact, r.deviation) for r in exact} == {(i, str(sum((3 * a - s) ** 2 for a, s in zip(v, sums))), None) for i, v in x.items()}


# ---------------------------------------------------------------- prefix trie

def brute_trie(rows):
    original = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            original[conv].append(((turn is not None, turn or 0, name), (role, text)))
    original = {c: [t for _, t in sorted(v, key=lambda e: e[0])] for c, v in original.items()}
    built = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(original.get(c - int(np.fmod(c, 5)), [])[:h]) + tuple(own[h:])
    members, kids = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    out, leaves, saved = [], {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in kids[n]) or 1
        saved[n] = sum(saved[k] for k in kids[n]) + ((len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0)
        ends = ",".join(str(c) for c in sorted(members[n]) if len(built[c]) == len(n))
        out.append((min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(kids[n]), leaves[n], saved[n],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def nodes(df):
    return sorted((tuple(r) for r in trie.prefix_trie(df).collect()), key=repr)


CONV = "conv_id long, turn long, role string, text string, block string, `n.depth` int"


@pytest.mark.parametrize("seed", [1, 2])
def test_prefix_trie(spark, seed, monkeypatch):
    """Short and long conversations, shared and differing turns, null turns, roles, texts and ids, repeats and gaps."""
    monkeypatch.setattr(trie, "STRETCH", 3)     # so that running sums cross stretches
    monkeypatch.setattr(trie, "PACK_BITS", 3)   # and members of one end come in several packs
    rng = random.Random(seed)
    rows = [(None, 1, "user", "none's"), (7, 300, "user", "late"), (7, 900, "user", "later"), (8, None, None, None)]
    for c in [*range(-12, 45), *range(10 ** 12, 10 ** 12 + 20)]:
        for t in range(rng.choice([0, 1, 2, 5, 9, 13, 20])):
            role = rng.choice(["user", "assistant", None]) if rng.random() < .1 else "user"
            rows.append((c, t if rng.random() < .95 else None, role, rng.choice(["a", "é", "", None]) if rng.random() < .5 else "x"))
    rows += [(200 + i, t, "user", f"same {t}") for i in range(40) for t in range(6)] + [(8, 5, "user", "tie")] * 3
    rows += [(600, t, "user", str(t % 5)) for t in range(60)] + [(9, 1, "user", "word " * 6000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], CONV)
    assert nodes(df) == brute_trie(rows)


def test_prefix_trie_of_the_tables(spark, sf):
    for folder in (sf, "/root/testdata/sf0.01"):
        df = spark.read.parquet(f"{folder}/conversations.parquet")
        assert nodes(df) == brute_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert nodes(df.limit(0)) == []


# ---------------------------------------------------------------- HTML extraction

def brute_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("cells", [1, 40, 1 << 26])
def test_common_lines(cells):
    rng = random.Random(cells)
    for _ in range(200):
        a, b = ([rng.randrange(rng.choice([2, 5, 40])) for _ in range(rng.randrange(30))] for _ in range(2))
        pairs = htmltext.common_lines(a, b, cells)
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) == brute_lcs(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_page_lines():
    lines = lambda s: list(zip(*htmltext.page_lines(s)))
    M, O, C = htmltext.MAIN, htmltext.OTHER, htmltext.CHROME
    assert lines("") == [] and lines("plain &amp; 1 &lt; 2 < 3") == [("plain & 1 < 2 < 3", O)]
    assert lines("a<b>b</b>c<br>d\n e<p>f<!-- <p>no --><p class=x>g &eacute;&#233;&#xe9; &nosuch; &am") == [
        ("abc", O), ("d e", O), ("f", O), ("g ééé &nosuch; &am", O)]
    assert lines("<script>var t='</p><p>no'</script>x<style>p{}</style><title>no</title><noscript>no</noscript>y") == [("x", O), ("y", O)]
    assert lines("<nav><ul><li>menu</ul></nav><article><header><h1>T</h1></header><p>one<p>two<footer>by</footer></article>end") == [
        ("menu", C), ("T", M), ("one", M), ("two", M), ("by", C), ("end", O)]
    assert lines("<div class='x ad-box'>buy<div>more</div>now</div><p>kept<p class=notice>cookies<p>kept too") == [
        ("buy", C), ("more", C), ("now", C), ("kept", O), ("cookies", C), ("kept too", O)]
    assert lines("<main class=has-sidebar>m<article class=comment>said</article></main><header>h</header>") == [("m", M), ("said", C), ("h", C)]
    assert lines("<div class=page-header>h</div><article><div class=article-header>T</div><div class=article-footer>by</div>m</article>") == [
        ("h", C), ("T", M), ("by", C), ("m", M)]
    assert lines("<p title='a > b'>x</p><p title=\"open>y") == [("x", O), ("y", O)]
    assert lines("<p>x<!-- open") == lines("<p>x<script>open") == lines("<p>x<em open") == [("x", O)]
    assert lines("<article>" + "word " * 100000 + "</article>")[0][0].count("word") == 100000


def test_extraction_deletes_lines_that_neighbours_share(spark):
    page = lambda *body: "<html><body>" + "".join(f"<div>{b}</div>" for b in body) + "</body></html>"
    top, low = "Site of all things", "All rights kept"
    rows = [(1, "http://a.org/x/1", page(top, "first story", "Teaser", low)), (2, "http://a.org/x/2?p=1", page(top, "second story", low)),
            (3, "http://A.org/x/3#t", page(top, "third", "story &amp; more", "Teaser", low)),
            (4, "http://b.org/x/1", page("alone here", low)), (5, "not a url", page("free text")), (None, None, None), (None, None, None),
            (7, "http://a.org/x/2", page(top, "second story", low)), (7, "http://a.org/x/2", page(top, "second story", low)),
            (8, "http://c.org/1", "<nav>m</nav><article><p>same tale</p></article><div>r</div>"),
            (9, "http://c.org/2", "<nav>n</nav><article><p>same tale</p></article><div>r</div>"), (10, "http://c.org/3", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, `lines` string")
    got = htmltext.extract(df).collect()
    want = {1: "first story Teaser", 2: "second story", 3: "third story & more Teaser", 4: "alone here All rights kept", 5: "free text",
            None: "", 7: "second story", 8: "same tale", 9: "same tale", 10: ""}
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in got) == sorted(
        (i or 0, u or "", want[i], len(want[i])) for i, u, _ in rows)
    assert htmltext.extract(df.limit(0)).count() == 0


def test_extraction_of_the_table(spark, sf):
    """Every page of the table names its article: the text is the article's, whatever neighbours share."""
    import re
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op13_html_extraction(spark, sf).collect()}
    assert len(got) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        want = " ".join(entities.unescape(re.sub(r"<b>|</b>", "", re.sub(r"</?(?:p|h1|br)>", "\n", article))).split())
        assert (got[p.page_id].url, got[p.page_id].text, got[p.page_id].n_chars) == (p.url, want, len(want))
