"""Each operator against brute force, on small tables with nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulewright.llm import ann, html_extract, langid, mixing, near_texts, packing, recompress, simhash, sstable, substrings, topk, toxicity
from rulewright.llm.components import components
from rulewright.llm.queries import tokenizer_path
from rulewright.llm.tokens import WordEncoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("before", "part", "start", "rank", "copies", "each", "key", "group", "bits", "k1", "first")
VOCABULARY = [a + b for a in ("ba", "do", "ki", "lu", "me", "no") for b in ("ra", "ti", "su", "ve", "")]


def prose(r, n):
    return " ".join(r.choice(VOCABULARY) + r.choice(["", "", "", ".", ","]) for _ in range(n))


def corpus(seed=1, n=60):
    r = random.Random(seed)
    passage = prose(r, 60)
    rows = []
    for k in range(n):
        text = prose(r, r.randint(0, 150))
        if k % 7 == 0:
            text += " " + passage + " " + prose(r, 20)
        rows.append([k, text, "en", f"s{k % 4}" if k % 9 else None, len(text)])
    rows[5][1] = rows[3][1]
    rows[6][1] = rows[8][1].replace(rows[8][1].split()[0], "zz", 1) if rows[8][1].split() else ""
    rows[10][1], rows[11][1], rows[12][1], rows[13][1] = None, "", " \t\n ", "!!! 123 ???"
    rows[20][1] = prose(r, 9000)  # very long
    rows[21][1] = "Na " * 300  # one word
    rows[22][1] = "É x\x1cy İ. ΣΑΣ <|endoftext|>  z"
    rows.append(list(rows[3]))  # a repeated row
    rows.append([None, "a row without an id", "en", "s1", 1])
    return [tuple(x) for x in rows]


def table(spark, rows, clashing=True):
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for name in CLASHING if clashing else ():
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows)


@pytest.fixture(scope="module")
def nothing(spark):
    return table(spark, corpus()[:1]).limit(0)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- 1


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>t</title>{head}</head><body>{body}</body></html>"


def test_html_elements(spark):
    body = (
        '<nav><ul><li><a href="/">Home</a></ul></nav><!-- <p>no</p> --><div class="ad-banner">Buy</div><div id="cookie-notice"><p>We use cookies</div>'
        "<article><header><h1>A &amp; B</h1></header><p>One <b>bo</b>ld\n  word<br>two<script>var a='<p>x</p>'</script><p>three&nbsp;&#8364;"
        '<aside>see also</aside><form><input>send</form><p>last</p><div class="comments"><p>great!</p></div></article><footer>&copy; x</footer>'
    )
    rows = [(1, "http://h.example/a", page(body, "<style>p{}</style>")), (2, None, None), (3, "http://h.example/b", ""), (3, "http://h.example/b", ""), (None, "x", "<p>bare")]
    got = {(r["page_id"], r["url"]): r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1))).collect()}
    assert got[1, "http://h.example/a"] == "A & B One bold word two three € last"
    assert got[2, None] == "" and got[3, "http://h.example/b"] == "" and got[None, "x"] == "bare"
    assert html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).count() == 5


def test_html_differencing(spark):
    """Without elements that tell, lines shared with the nearest page go, and a copy of a page is no partner."""
    def site(own):
        return page("<div>The Daily</div><div>Read us every day</div>" + "".join(f"<p>{x}</p>" for x in own) + "<div>Imprint and contact</div>")

    rows = [(k, f"http://h.example/news/{k}", site([f"story {k} begins here and goes on for a while", f"and ends with {k} at last, after some more words"])) for k in range(6)]
    rows.append((9, "http://h.example/news/4x", rows[5][2]))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(6):
        assert got[k] == f"story {k} begins here and goes on for a while and ends with {k} at last, after some more words"
    assert got[9] == got[5]


HTML_PROBES = [
    ('<div style="overflow:hidden"><p>kept?</p></div>', "kept?"),
    ('<p title="a hidden gem">kept</p>', "kept"),
    ('<p data-id="nav">kept</p>', "kept"),
    ('<article><div class="article-header"><h1>Title</h1></div><p>x</p></article>', "Title x"),
    ('<p title="a"">kept?</p>', "kept?"),
    ('<p title="a>b" class=ad>no</p><p>a < b &lt;i&gt; &amp;amp; c', "a < b <i> &amp; c"),
    ('<div class="content no-sidebar"><p>yes</p><nav><a>no</a></nav></div>', "yes"),
    ('<article><p class="notice">n</p><div class="ad">a</div><h1>T<b>x</b></h1><p hidden>z</p></article>', "n Tx"),
    ('<form><div class="search"><article>kept <i>this</i></article></div></form>', "kept this"),
    ('<a b="c>d e', "d e"),
    ("x<!-- c", "x"),
    ("y<![CDATA[ <b> ]]>z", "y <b> z"),
    ("<script>if (a</script >b", "b"),
]


@pytest.mark.parametrize("page, want", HTML_PROBES)
def test_html_probes(page, want):
    assert html_extract.main_text(html_extract.lines(page), [], []) == want


@pytest.mark.parametrize("unit", ['<a title="x ', "<b>", "</i>", "<a x='\"", "<", "<!--", '<p class="', "<p><i>", "&amp", "</"])
def test_html_scanner_is_linear(unit):
    import time

    began = time.process_time()
    html_extract.lines(unit * 50_000)
    assert time.process_time() - began < 5


def test_html_against_all_pages(spark):
    """Differencing by plain tables of the common subsequence and a plain sort of all pages; what neighbours do shows when they are taken away."""
    r = random.Random(31)
    rows, bodies = [], {}
    for host, many in (("a.example", 14), ("b.example", 1), ("c.example", 9)):
        frame = [prose(r, 6) for _ in range(5)]
        for k in range(many):
            own = [f"{prose(r, 12)} {host} {k}" for _ in range(r.randint(1, 6))]
            body = "".join(f"<div>{x}</div>" for x in frame[:3]) + "".join(f"<p>{x}</p>" for x in own) + "".join(f"<div>{x}</div>" for x in frame[3:])
            if k % 5 == 4:
                body = "<main>" + body + "</main>"
            url = f"http://{host}/{r.choice(['x', 'y'])}/{k}"
            rows.append((len(rows), url, page(body)))
            if k % 4 == 0:
                rows.append((len(rows), url + "?copy", page(body)))
    rows.append((len(rows), rows[0][1], None))

    def table_of(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best

    def without(texts, other):
        best, i, j, keep = table_of(texts, other), len(texts), len(other), []
        while i and j:
            if texts[i - 1] == other[j - 1]:
                i, j = i - 1, j - 1
            elif best[i - 1][j] >= best[i][j - 1]:
                i -= 1
                keep.append(i)
            else:
                j -= 1
        return set(keep) | set(range(i))

    def got(rows):
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumn("content", F.lit("x"))
        return {x["page_id"]: x["text"] for x in html_extract.extract(df).collect()}

    found, alone = got(rows), {k: v for i in (4, 9) for k, v in got([rows[i]]).items()}
    hosts = {}
    for i, url, h in rows:
        host, path = re.match(r"http://([^/]*)(.*)", url).groups()
        hosts.setdefault(host, {}).setdefault(tuple(html_extract.lines(h or "")), []).append(path)
    for i, url, h in rows:
        host = re.match(r"http://([^/]*)", url)[1]
        own, others = html_extract.lines(h or ""), [p for p in hosts[host] if list(p) != html_extract.lines(h or "") and p]
        texts, main = [t for t, _ in own], any(k == html_extract.MAIN for _, k in own)
        if others and len(hosts[host]) > 4:  # all have the same frame and nothing else in common
            frame = set.intersection(*({t for t, _ in p} for p in others))
            want = " ".join(texts[k] for k in sorted(without(texts, [t for t, _ in others[0]]))) if texts else ""
            assert not frame or found[i] == want, (i, url, main)
        elif not others:
            assert found[i] == " ".join(texts)
    assert any(found[i] != alone[i] for i in alone)


def test_common_subsequence():
    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.randint(0, 5) for _ in range(r.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        kept = html_extract.shared(a, b)
        chosen, at = [x for x, k in zip(a, kept) if k], iter(b)
        assert len(chosen) == best[-1][-1] and all(x in at for x in chosen)


# --- 2


def fingerprint(text, n=4):
    from xxhash import xxh64_intdigest

    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    bits = [[(xxh64_intdigest(s.encode(), 42) >> b) & 1 for b in range(64)] for s in shingles]
    return sum(1 << b for b in range(64) if bits and 2 * sum(x[b] for x in bits) > len(bits))


def groups(prints, ids, budget):
    parent = list(range(len(prints)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                parent[top(i)] = top(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [least.get(top(i)) for i in range(len(prints))]


def test_simhash(docs, rows, nothing):
    prints = [fingerprint(r[1]) for r in rows]
    want = sorted(zip((r[0] for r in rows), (f"{p:016x}" for p in prints), groups(prints, [r[0] for r in rows], 4)), key=str)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str) == want
    assert simhash.near_duplicates(nothing).count() == 0


def test_trie_join(spark, monkeypatch):
    """Any links of chosen fingerprints, with large tops dealt in chunks; every choice of budget and blocks."""
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(12)]
    prints = {b ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 6))) for b in base for _ in range(40)} | {0, (1 << 64) - 1}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    for budget, blocks, chunk in ((4, 6, 4096), (4, 6, 8), (2, 4, 16)):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        links = components(simhash.near_links(spark.createDataFrame([(s,) for s in signed], "bits long"), budget, blocks))
        got = {x["node"]: x["component"] for x in links.collect()}
        order = sorted(signed)
        want = groups([s % (1 << 64) for s in order], order, budget)
        assert [got.get(s, s) for s in order] == want


def test_components(spark):
    r = random.Random(4)
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + r.randint(1, 300)) for _ in range(200)] + [(500, 501), (501, 500), (7, 7)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[500] == got[501] == 500 and {got[b] for a, b in links if a == 100} == {100}


def test_without_near_duplicates(spark):
    r = random.Random(5)
    a, b = prose(r, 300), prose(r, 300)
    near = " ".join(["zz"] + a.split()[1:])
    half = " ".join(a.split()[:150] + b.split()[150:])
    df = table(spark, [(1, a, "en", "s", 1), (2, near, "en", "s", 1), (3, b, "en", "s", 1), (4, half, "en", "s", 1), (5, a, "en", "s", 1), (None, a, "en", "s", 1), (6, None, "en", "s", 1)])
    kept = near_texts.without_near_duplicates(df)
    assert sorted(str(x["doc_id"]) for x in kept.collect()) == ["1", "3", "4", "6"] and kept.columns == df.columns


def test_near_duplicates_of_an_unlike_head(spark):
    """Copies and near copies of a text that is linked to a smaller doc_id, but isn't like it: one of them stays."""
    from itertools import combinations

    def jaccard(x, y):
        x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (x.split(), y.split()))
        return len(x & y) / len(x | y)

    def made(seed):
        r = random.Random(seed)
        a = [f"w{r.randint(0, 10**6)}" for _ in range(300)]
        b = [f"x{k}" if k % 30 == 7 else w for k, w in enumerate(a)]
        return " ".join(a), " ".join(b), " ".join(["y", *b[1:]])

    def near(texts):
        return all((fingerprint(x, 5) ^ fingerprint(y, 5)).bit_count() <= 8 for x, y in combinations(texts, 2))

    a, b, c = next(x for k in range(500) if near(x := made(k)))
    assert jaccard(a, b) < 0.8 < jaccard(b, c)
    df = table(spark, [(i, t, "en", "s", 1) for i, t in enumerate((a, b, b, c, c + "  ", c))])
    assert sorted(x["doc_id"] for x in near_texts.without_near_duplicates(df).collect()) == [0, 1]


def test_near_duplicates_of_repeated_ids(spark):
    """Of copies without an id, and of a table appended twice, one row stays; one with an id before one without."""
    r = random.Random(17)
    a, b = prose(r, 300), prose(r, 300)
    near = " ".join(["zz"] + b.split()[1:])
    rows = [(1, a, "en", "s", 1), (2, None, "en", "s", 1), (None, b, "en", "s", 1), (None, near, "en", "s", 1)]
    kept = near_texts.without_near_duplicates(table(spark, rows * 3)).collect()
    assert sorted(str(x["doc_id"]) for x in kept) == ["1", "2", "None"]


def test_near_duplicates_are_the_same_elsewhere(spark, tmp_path):
    """A copy of the table in another place, in other files, keeps the same rows, also where ids repeat or are missing."""
    r = random.Random(29)
    texts = families(r, 25, 3)
    rows = [(r.choice([None, k % 40]), t, "en", f"s{k % 3}", k % 5) for k, t in enumerate(texts * 2)]
    kept = []
    for place, parts in (("a", 2), ("b", 7)):
        r.shuffle(rows)
        spark.createDataFrame(rows, DOCS).repartition(parts).write.parquet(f"{tmp_path}/{place}")
        kept.append(sorted(map(tuple, near_texts.without_near_duplicates(spark.read.parquet(f"{tmp_path}/{place}")).collect()), key=str))
    assert kept[0] == kept[1] and len(kept[0]) < 75


def test_trie_walk_between_classes():
    """Pairs of two classes only, many rows of equal bits among them, against all pairs."""
    r = random.Random(16)
    base = [r.getrandbits(64) for _ in range(5)]
    bits = sorted([b ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(30)] + base * 9)
    tops = np.repeat([0, 1], [100, len(bits) - 100])
    for labels in ([r.randint(0, 3) for _ in bits], [7] * len(bits), list(range(len(bits)))):
        want = {(i, j) for j in range(len(bits)) for i in range(j) if tops[i] == tops[j] and labels[i] != labels[j] and (bits[i] ^ bits[j]).bit_count() <= 9}
        got = [p for i, j in simhash.trie_pairs(np.array(bits, np.uint64), tops, None, 9, 64, np.array(labels)) for p in zip(i.tolist(), j.tolist())]
        assert len(got) == len(set(got)) and {(min(p), max(p)) for p in got} == want


def families(r, n, size, width=120):
    """n texts, and of each size others with some words changed or a passage added."""
    texts = []
    for _ in range(n):
        base = [f"{r.choice(VOCABULARY)}{r.randint(0, 99)}" for _ in range(width)]
        texts.append(base)
        for _ in range(size):
            other = list(base)
            for _ in range(r.randint(0, 4)):
                other[r.randrange(width)] = f"x{r.randint(0, 10**6)}"
            texts.append(other + [f"y{r.randint(0, 10**6)}" for _ in range(r.choice([0, 0, 5, 20]))])
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("chunk", [4096, 6])
def test_near_texts_against_all_pairs(spark, monkeypatch, chunk):
    """Groups by all pairs' Jaccard similarity; a hot class and tops dealt in chunks give the same."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    r = random.Random(23)
    texts = families(r, 12, 6) + families(r, 1, 60) + ["", "one two", "one  TWO", "one two three four five six", "na " * 50, "na " * 70]
    sets = [frozenset(near_texts.shingle_set(t.encode(), 5).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for i, j in pairs:
        p, q = sorted((top(i), top(j)))
        parent[q] = p
    want = {top(i) for i in range(len(texts))}
    got = [x["doc_id"] for x in near_texts.without_near_duplicates(table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])).collect()]
    assert len(got) == len(set(got)) and want <= set(got)
    assert len(got) - len(want) <= 0.1 * (len(texts) - len(want))  # a recall of 0.9
    assert all(top(i) == top(j) for i, j in pairs)


def test_near_texts_lose_no_link(spark, monkeypatch):
    """Many pairs just above the least similarity, and a text that is like a farther one only: groups are those of all pairs."""
    monkeypatch.setattr(near_texts, "SHOWN", 1)  # each set, hence a line that many texts have is frequent
    r = random.Random(41)
    line, texts = [f"l{k}" for k in range(12)], []
    for k in range(70):
        base = line + [f"b{r.randint(0, 10**6)}" for _ in range(90)]
        other = list(base)
        for at in (20, 60):  # 10 of 98 shingles on each side: a similarity of 88 / 108
            other[at] = f"x{r.randint(0, 10**6)}"
        texts += [" ".join(base), " ".join(other)]
    sets = [near_texts.shingle_set(t.encode(), 5) for t in texts]
    assert all(len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) for a, b in zip(sets[::2], sets[1::2]))
    got = near_texts.without_near_duplicates(table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])).collect()
    assert sorted(x["doc_id"] for x in got) == list(range(0, 140, 2))


def test_near_texts_of_exploded_rows(spark, tmp_path):
    """Of two texts made of one row of a file, the one that is like no other stays when the other goes."""
    r = random.Random(43)
    a, b, c = (prose(r, 90) for _ in range(3))
    table(spark, [(1, a, "en", "s", 1), (2, b, "en", "s", 1)]).coalesce(1).write.parquet(f"{tmp_path}/t")
    texts = F.when(F.col("doc_id") == 2, F.array(F.lit(a), F.lit(c), F.lit(c))).otherwise(F.array("text"))
    docs = spark.read.parquet(f"{tmp_path}/t").withColumn("text", F.explode(texts))
    assert sorted((x["doc_id"], x["text"]) for x in near_texts.without_near_duplicates(docs).collect()) == [(1, a), (2, c)]


def test_near_texts_of_nothing(nothing):
    assert near_texts.without_near_duplicates(nothing).count() == 0


# --- 3 and 4


def vectors(spark, n=300, d=12, seed=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, d)) * rng.uniform(0.1, 3, (n, 1))
    x[40:90] = x[40] + rng.normal(0, 1e-3, (50, d))  # a group of near copies
    x[91] = x[90]
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x.astype(np.float32).astype(float))]
    rows += [(300, None, 1), (301, [None] + [1.0] * (d - 1), 1), (302, [float("nan")] * d, 1), (303, [float("inf")] * d, 1), (304, [0.0] * d, 1), (None, [1.0] * d, 1), rows[50], (305, [5.0, 5.0], 1), (350, [1.0, 1.0], 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rank", F.lit("x"))


def taking_part(rows, zero):
    ok = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and (zero or any(v)):
            ok[i] = v
    return ok


@pytest.mark.parametrize("bucket", [4096, 32])
def test_top_products(spark, monkeypatch, bucket):
    monkeypatch.setattr(topk, "BUCKET", bucket)
    rows, df = vectors(spark)
    ok = {i: np.floor(256 * np.array(v)).astype(int) for i, v in taking_part(rows, True).items()}
    want = []
    for q in [i for i in ok if i % 50 == 0]:
        scored = sorted(((-int(ok[q] @ v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert sorted(map(tuple, topk.top_products(df).collect())) == sorted(want)
    assert topk.top_products(df.limit(0)).count() == 0


def test_coordinates_prune_safely():
    rng = np.random.default_rng(7)
    for _ in range(200):
        p = rng.normal(0, 1, (60, 6))
        p[:20] = p[0] + rng.normal(0, 0.05, (20, 6))
        lengths = np.sqrt((p**2).sum(1))
        order = np.argsort(-lengths)
        p, lengths = p[order], lengths[order]
        unit = p / lengths[:, None]
        q = p[rng.integers(60)] + rng.normal(0, 0.02, 6)
        size = float(np.linalg.norm(q))
        wanted = rng.uniform(0.5, 1.0) * size * lengths[0]
        place = topk.candidates_of(q, size, wanted, p, lengths, unit, np.argsort(unit, axis=0).T)
        chosen = set(np.arange(60)[place].tolist())
        assert {k for k in range(60) if p[k] @ q >= wanted} <= chosen


def test_nearest(spark):
    rows, df = vectors(spark, n=300)
    ok = {i: np.array(v) for i, v in taking_part(rows, False).items()}
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for q in [i for i in ok if i % 20 == 0 and len(ok[i]) == 12]:
        scored = sorted(((-(ok[q] @ v), i) for i, v in ok.items() if i != q and len(v) == 12))[:20]
        found = sorted(got[q])
        assert [k for k, _, _ in found] == list(range(1, 21)) and all(abs(s - ok[q] @ ok[i]) < 1e-12 for _, i, s in found)
        hit += len({i for _, i in scored} & {i for _, i, _ in found})
        total += 20
    assert hit / total >= 0.9
    assert sorted(got) == [i for i in sorted(ok) if i % 20 == 0 and len(ok[i]) == 12]
    assert ann.nearest(df.limit(0)).count() == 0


# --- 5


def filled(sizes, weights=(5, 2, 1), most=3):
    """Water filling, step by step."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, total = {}, sum(sizes.values())
    while True:
        left, heft = total - sum(full.values()), sum(w for s, w in weight.items() if s not in full)
        over = [s for s in names if s not in full and left * weight[s] > most * sizes[s] * heft]
        if not over:
            return {s: float(full[s]) if s in full else weight[s] * left / heft for s in names}
        full |= {s: most * sizes[s] for s in over}


def test_mix(spark, docs, rows, nothing):
    got = mixing.mix(docs).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    want = filled(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3 and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6
        taken[r["source"]] += r["taken"]
    longest = {s: max(len(words(r[1])) for r in rows if r[3] == s) for s in sizes}
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= longest[s] for s in sizes)
    again = mixing.mix(docs.repartition(7))
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    copies = mixing.mixed_documents(docs.where("doc_id is not null and doc_id <> 3"))
    assert copies.columns == docs.columns and mixing.mix(nothing).count() == 0


def test_mixed_documents_by_row(spark):
    """Rows without an id, and repeats of one, are each taken as often as the mix takes them."""
    rows = [(None if k % 3 else 7, f"{s} " * 10 + "1" * (k % 5), "en", s, k) for s, n in (("a", 6), ("b", 60), ("c", 90)) for k in range(n)]
    df = table(spark, rows)
    want = {r["source"]: r["n"] for r in mixing.mix(df).groupBy("source").agg(F.sum("copies").alias("n")).collect()}
    got = mixing.mixed_documents(df)
    assert {r["source"]: r["count"] for r in got.groupBy("source").count().collect()} == want and got.columns == df.columns


def test_targets_stop(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 1, None: 40}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx(filled(sizes)) and got["a"] == 30 and sum(got.values()) == pytest.approx(1551)


# --- 6 and 9


def encoded(text):
    from tokenizers import Tokenizer

    encoded.t = getattr(encoded, "t", None) or Tokenizer.from_file(tokenizer_path())
    return encoded.t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder(monkeypatch):
    r = random.Random(8)
    alphabet = "aAbßÉé'.,!0́İΣς \n\t日<| "
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(500)] + [prose(r, 50) for _ in range(50)] + ["don't can't. <|endoftext|>x", None]
    monkeypatch.setattr("rulewright.llm.tokens.KEPT_WORDS", 50)
    monkeypatch.setattr("rulewright.llm.tokens.CHUNK_CHARS", 300)
    assert [x.tolist() for x in WordEncoder(tokenizer_path()).encode(texts)] == [encoded(t) for t in texts]


def test_packing(docs, rows, nothing):
    got = packing.packed_documents(docs, tokenizer_path(), capacity=256).collect()
    want = []
    for r in rows:
        ids = encoded(r[1]) + [1]
        want += [(r[0], k, at, len(ids[at : at + 256]), crc(ids[at : at + 256])) for k, at in enumerate(range(0, len(ids), 256))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 256
    assert len(places) <= -(-sum(w[3] for w in want) // 256) + 2
    assert packing.packed_documents(nothing, tokenizer_path()).count() == 0


def test_templates():
    r = random.Random(9)
    for _ in range(30):
        counts = np.zeros(101, np.int64)
        for _ in range(r.randint(0, 300)):
            counts[r.choice([r.randint(1, 100), r.randint(30, 60)])] += 1
        used = np.zeros_like(counts)
        for lengths, times in packing.templates(counts):
            assert sum(lengths) <= 100
            np.add.at(used, lengths, times)
        assert (used == counts).all()


def test_shards(spark, docs, rows, nothing, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 400)
    monkeypatch.setattr(sstable, "SHARD_BYTES", 4000)
    folder = sstable.write_shards(docs, tokenizer_path(), end_id=2)
    got = sorted((tuple(r)[:4] for r in sstable.read_shards(spark, folder).collect()), key=lambda r: (r[1], r[2]))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    start, want = 0, []
    for r in order:
        ids = encoded(r[1]) + [2]
        want.append((r[0], start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    found = {r["doc_id"]: r["ids"] for r in sstable.lookup(spark, folder, [0, 3, 20, None, 999]).collect()}
    assert found == {i: encoded(next(r[1] for r in rows if r[0] == i)) + [2] for i in (0, 3, 20, None)}
    assert sstable.read_shards(spark, sstable.write_shards(nothing, tokenizer_path(), 2)).count() == 0


# --- 7


def brute(texts, width):
    split = [words(t) for t in texts]
    seen = {}
    for w in split:
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def test_substrings(docs, rows, nothing):
    for width in (35, 12):
        want = sorted(((r[0], n, g, hashlib.sha256(k.encode()).hexdigest()) for r, (n, g, k) in zip(rows, brute([r[1] for r in rows], width))), key=str)
        got = substrings.without_repeats(docs, width, digest=True).select("doc_id", "n_words", "n_removed", "kept")
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert substrings.without_repeats(nothing).count() == 0


def test_substrings_of_few_words(spark):
    """Texts of two or three different words, with many runs and periods, and repeats that overlap themselves."""
    r = random.Random(10)
    texts = [" ".join(r.choice("ab") * r.randint(1, 4) if r.random() < 0.1 else r.choice(["a", "b", "a"]) for _ in range(r.randint(0, 60))) for _ in range(25)]
    texts += ["x " * 40, "x y " * 30, "x y z " * 20, " ".join(str(k) for k in range(80)), " ".join(str(k) for k in range(30, 110))]
    df = table(spark, [(k, t, "en", "s", 0) for k, t in enumerate(texts)], clashing=False)
    for width in (5, 9, 20):
        got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept"]) for x in substrings.without_repeats(df, width).collect()}
        assert [got[k] for k in range(len(texts))] == brute(texts, width)


def test_cleaned_documents(docs, rows):
    got = substrings.cleaned_documents(docs)
    assert got.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in got.collect()}
    for r, (n, g, text) in zip(rows, brute([r[1] for r in rows], 35)):
        assert kept[r[0]] == (text if g else r[1])


def test_substrings_of_one_doc_id(spark):
    """Rows of one key (no doc_id) whose texts' hashes agree in their lower 31 bits are told apart."""
    from xxhash import xxh64_intdigest

    r = random.Random(15)
    passage, other = prose(r, 40), " ".join(f"o{k}" for k in range(60))
    lower = {xxh64_intdigest(t := f"a{k} {passage}", 42) & 0x7FFFFFFF: t for k in range(150_000)}
    mine, theirs = next((lower[h], t) for k in range(1_000_000) if (h := xxh64_intdigest(t := f"b{k} {other}", 42) & 0x7FFFFFFF) in lower)
    texts = [mine, theirs, passage]
    df = table(spark, [(i, t, "en", "s", 0) for i, t in zip((None, None, 1), texts)], clashing=False)
    got = sorted((x["n_words"], x["n_removed"], x["kept"]) for x in substrings.without_repeats(df).collect())
    assert got == sorted(brute(texts, 35))
    assert sorted(x["text"] for x in substrings.cleaned_documents(df).collect()) == sorted([mine.split()[0], theirs, ""])


def test_symbols_are_consistent():
    """Where a context lies within equal windows, so do equal symbols at equal places."""
    r = np.random.default_rng(11)
    part = r.integers(0, 5, 60)
    one, two = (np.concatenate([r.integers(0, 5, 37), part, r.integers(0, 5, 41)]).astype(np.uint64) for _ in range(2))
    closes = np.zeros(138, bool)
    closes[-1] = True
    for a, b in zip(recompress.levels(one, closes, 4), recompress.levels(two, closes, 4)):
        inside = [{(s, n) for s, n, low, high in zip(x.start.tolist(), x.name.tolist(), x.low.tolist(), x.high.tolist()) if low >= 37 and high <= 97} for x in (a, b)]
        assert inside[0] == inside[1]


# --- 8 and 10


def test_language(spark, nothing):
    r = random.Random(12)
    langs = {"aa": ["ba", "bo", "bu", "la"], "bb": ["xi", "xe", "ki", "qi"]}
    rows = [(k, " ".join("".join(r.choices(langs[l], k=3)) for _ in range(r.randint(3, 200))), l, "s", 0) for k, l in enumerate(["aa", "bb"] * 60)]
    rows += [(200, None, "aa", "s", 0), (201, "", "aa", "s", 0), (202, "123 !!", "bb", "s", 0), (203, "xixe " * 30000, None, "s", 0), (203, "xixe " * 30000, None, "s", 0), (None, "bobaba", "aa", "s", 0)]
    df = table(spark, rows)
    network = langid.train(df.where("doc_id % 3 <> 1"))
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(df, network).collect()]
    truth = {r[0]: r[2] for r in rows}
    held = [(truth[i], p) for i, p, _ in got if i is not None and i < 120 and i % 3 == 1]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) and len(got) == len(rows) and all(0 <= s <= 1 for _, _, s in got)
    assert {p for i, p, _ in got if i in (200, 201, 202)} == {"und"} and [p for i, p, _ in got if i == 203] == ["bb", "bb"]
    x = np.random.default_rng(0).integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    network.ready()
    assert np.allclose(network.probabilities(x), langid.softmax(network.pool(x)[0] @ network.out + network.bias), atol=1e-4)
    empty = langid.train(nothing)
    assert langid.identify(nothing, empty).count() == 0 and {r["lang_pred"] for r in langid.identify(df, empty).collect()} == {"und"}
    kept = langid.recognised(df, network)
    assert kept.columns == df.columns and kept.count() >= 115 and kept.where("doc_id in (200, 201, 202)").count() == 0


def test_toxicity(spark, nothing):
    r = random.Random(13)
    bad = ["grumpfel", "schnarzo", "blorkwit"]
    rows, labels = [], []
    for k in range(400):
        w = prose(r, r.randint(5, 120)).split()
        toxic = k % 4 == 0
        if toxic:
            for _ in range(2):
                w.insert(r.randint(0, len(w)), r.choice(bad))
        rows.append((k, " ".join(w), "en", "s", 0))
        labels.append((k, 1, int(toxic)))
    rows += [(900, "well grumpffel this is ba ti", "en", "s", 0), (901, None, "en", "s", 0), (902, "", "en", "s", 0), (903, prose(r, 20000) + " schnarzo schnarzo", "en", "s", 0), (903, "ba", "en", "s", 0)]
    df, marks = table(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, marks.where("doc_id % 5 <> 0"))
    got = [(x["doc_id"], x["score"]) for x in toxicity.score(df, model).collect()]
    truth = {i: t for i, _, t in labels}
    held = [(truth[i], s >= 0.5) for i, s in got if i < 400 and i % 5 == 0]
    assert sum(a == b for a, b in held) >= 0.97 * len(held) and len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    by = {}
    for i, s in got:
        by.setdefault(i, []).append(s)
    assert by[900][0] >= 0.5 and max(by[903]) >= 0.5 and by[901] == by[902] and by[901][0] < 0.5
    assert toxicity.score(nothing, toxicity.train(nothing, marks.limit(0))).count() == 0


# --- the pipeline


def test_toxicity_of_labels_without_documents(spark, nothing):
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, toxic int")
    model = toxicity.train(nothing, labels)
    assert toxicity.score(table(spark, corpus()[:3]), model).count() == 3


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [r for r in corpus(14) if r[0] is not None]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.dtypes == spark.createDataFrame([], DOCS).dtypes, name
        docs.write.parquet(folder := str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(folder)
        if name == "substring dedup":
            assert docs.count() < before and docs.where("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.run(spark, str(tmp_path))
    sizes = {r["doc_id"]: r["sum"] for r in docs.groupBy("doc_id", "text").count().withColumn("sum", F.col("count")).collect()}
    assert {r["doc_id"] for r in packed.collect()} == set(sizes)
