"""Each operator against a brute-force version, an exact round trip or a known case, with nulls, ties, repeats and clashing names."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlake.llm import queries as q

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, pool=400):
    return " ".join(f"w{rng.integers(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with exact and near copies, a shared passage, nulls, empty and long texts."""
    rng = np.random.default_rng(1)
    passage = words(rng, 40, 5000)
    base = words(rng, 120, 5000)
    rows = [(i, words(rng, int(rng.integers(1, 90)), 3000)) for i in range(60)]
    rows += [(100 + i, base) for i in range(25)]
    rows += [(200 + i, " ".join(f"x{i}" if k == 7 * i % 110 else w for k, w in enumerate(base.split()))) for i in range(20)]
    rows += [(300 + i, words(rng, 15, 3000) + " " + passage + "\n" + words(rng, 15, 3000)) for i in range(70)]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "one"), (404, "ONE"), (405, "é É ß"), (406, words(rng, 8000, 4000)), (None, base), (407, "a b c d e"), (408, "A b C d e")]
    rows = [(i, t, "en", [None, "s1", "s2", "s0"][k % 4], len(t or "")) for k, (i, t) in enumerate(rows)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), {r[0]: r[1] for r in rows if r[0] is not None}, rows


@pytest.fixture(scope="module")
def no_docs(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_empty_tables(spark, no_docs, name):
    assert q.queries()[name](spark, no_docs).collect() == []


# --- pages


def test_pages(spark):
    from barlake.llm.html import best_run, extract, main_text, weights
    from barlake.llm.labelled_pages import labelled_pages

    unseen = labelled_pages(400, seed=9)
    assert sum(main_text(html) == main for html, main in unseen) >= 0.97 * len(unseen)
    tokens = weights().tokens
    assert tokens["word"] > 0 > tokens["link"] and all(v < 0 for k, v in tokens.items() if k[0] == "<")
    rng = np.random.default_rng(3)
    for _ in range(50):
        x = rng.normal(size=12).tolist()
        a, b = best_run(x)
        assert math.isclose(sum(x[a:b]), max(0.0, max(sum(x[i:j]) for i in range(12) for j in range(i, 13))), abs_tol=1e-12)
    page = "<html><body class='has-sidebar'><nav>menu</nav><article><h1>T&eacute;st &amp; x</h1><p>a<b>b</b> <i>c</i>&nbsp;\n d<p class='notice'>no</p><p>end</p><div class=comments>hi</div></article><p>&copy; x"
    assert main_text(page) == "Tést & x ab c d end"
    for odd in (None, "", "<", "<p", "<article><p", "<a '" * 500, "<script>never closed", "<p>" * 3000):
        assert isinstance(main_text(odd), str)
    df = spark.createDataFrame([(1, "u", page, "old"), (1, "u", page, "old"), (2, None, None, "old")], "page_id long, url string, html string, main_text string")
    got = extract(df).collect()
    assert [(r.main_text, r.main_chars) for r in got] == [("Tést & x ab c d end", 19)] * 2 + [("", 0)]


def test_names_alone_do_not_decide():
    """Names that authors give to whole articles and pages don't empty them; comments, adverts and notices go whatever they are called."""
    from barlake.llm.html import main_text

    one = " ".join(f"word{i}" for i in range(150))
    body, want = f"<h1>Head line</h1><p>{one}</p><p>{one}</p>", f"Head line {one} {one}"
    for page in (
        f'<article class="post hentry category-news tag-search">{body}</article>', f'<article class="post category-social">{body}</article>',
        f'<div class="layout-with-sidebar"><article>{body}</article></div>', f'<div id="page" class="right-sidebar"><nav><a href=x>Home</a></nav>{body}</div>',
        f'<article><div class="article-header"><h1>Head line</h1></div><p>{one}</p><p>{one}</p></article>', f"<article><header><h1>Head line</h1></header><p>{one}</p><p>{one}</p><footer>By me</footer></article>",
        f'<article>{body}</article><section id="responses"><p>Nice one, thanks a lot to all.</p><p>I disagree with all of it.</p></section>',
        f'<article>{body}<div class="feedback">Was this useful? Tell us.</div><div class="partner-content"><p>Buy this now.</p></div></article>',
        f'<div class="article-comments"><p>hi there you all</p></div><div class=article-body>{body}</div>', f'<article>{body}<p style="display:none">no</p></article>',
    ):
        assert main_text(f"<html><body><nav><a href=/>Home</a></nav>{page}<footer>&copy; x</footer></body></html>") == want, page


def test_deep_nesting_is_linear():
    import time

    from barlake.llm.html import main_text

    main_text("<p>a")
    for odd in ("<div>word " * 100_000, "<div class='a'>" * 100_000 + "x", "<section>" * 50_000 + "</div>" * 50_000 + "x", "<option>" * 100_000, "<span class=ad>" * 100_000):
        began = time.time()
        main_text(odd)
        assert time.time() - began < 5


def test_no_part_of_the_run_is_lost():
    from barlake.llm.html import main_text

    one, two = " ".join(f"one{i}" for i in range(120)), " ".join(f"two{i}" for i in range(80))
    for inside in (
        f"<article><p>{one}</p></article><article><p>{two}</p></article>",
        f"<main><article><p>{one}</p></article><section><p>{two}</p></section></main>",
        f"<article><article><p>{one}</p></article><p>{two}</p></article>",
    ):
        assert main_text(f"<html><body><nav>menu</nav>{inside}<footer>end</footer></body></html>") == f"{one} {two}"


# --- classifiers


@pytest.mark.parametrize("name", ["op2_toxicity", "op7_quality"])
def test_scores(spark, corpus, name):
    path, texts, rows = corpus
    got = q.queries()[name](spark, path).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= (0.3 if name == "op2_toxicity" else 0.7))
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    by_text = {}
    for r in got:
        if r.doc_id is not None:
            by_text.setdefault(texts[r.doc_id] or "", set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())


def test_factorization_machine_learns_an_interaction():
    from barlake.llm.toxicity import fit, terms_of

    rng = np.random.default_rng(5)
    texts, labels = [], []
    for _ in range(900):
        a, b = (int(v) for v in rng.random(2) < 0.5)
        texts.append(f"{'insult ' * a}{'folk ' * b}w{rng.integers(50)}")
        labels.append(int(a and b))
    m = fit([np.sort(terms_of(t)) for t in texts], np.array(labels))
    s = m.score([terms_of(t) for t in ("insult folk", "insult", "folk", "")])
    assert s[0] > 0.8 and max(s[1:]) < 0.3
    assert fit([terms_of("a")] * 3, np.zeros(3)).score([terms_of("a"), terms_of("")])[0] < 0.5


def test_factorization_machine_learns_terms_that_only_matter_together():
    """Exclusive or of two frequent words; and two rare words, each about as often toxic as any, always toxic together."""
    from barlake.llm.toxicity import fit

    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(3000):
        a, b = rng.integers(2, size=2)
        rows.append(np.unique([*rng.integers(1000, 1400, 20), *[1] * a, *[2] * b]))
        labels.append(int(a ^ b))
    m = fit(rows[:2500], np.array(labels[:2500]))
    assert ((m.score(rows[2500:]) > 0.5) == labels[2500:]).mean() > 0.95
    rows, labels = [], []
    for i in range(6000):
        row = [*rng.integers(1000, 3000, 30), *[9] * (i % 10 == 0), *[1] * (i < 70), *[2] * (i < 8 or 1000 <= i < 1062)]
        rows.append(np.unique(row))
        labels.append(int(i < 8 or i % 10 == 0))
    y, has = np.array(labels), np.array([[t in r for t in (1, 2)] for r in rows])
    assert y[has[:, 0]].mean() < 0.25 and y[has[:, 1]].mean() < 0.25 and y[has.all(1)].all()
    s = fit(rows, y).score([np.array(x, np.int64) for x in ([1, 2], [1], [2], [])])
    assert s[0] > 0.5 and max(s[1:]) < 0.3


def test_additive_model_learns_an_interaction():
    from barlake.llm.quality import FEATURES, describe, fit

    rng = np.random.default_rng(6)
    x = rng.random((1500, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    m = fit(x, y)
    assert ((m.score(x) >= 0.5) == y).mean() > 0.95 and (0, 1) in m.pairs
    assert len(describe("a b")) == len(FEATURES) and not describe(None).any() and not describe("  ").any()


# --- vectors


def test_vectors(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    x[100:140] = x[0] + rng.normal(size=(40, 16)) * 0.05
    x[140:160] = x[1]
    x[160] = x[2] * 3
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(1000, None, 0), (1100, [0.0] * 16, 0), (1200, [float("nan")] + [1.0] * 15, 0), (1300, [None] + [1.0] * 15, 0), (1400, [1.0, 2.0], 0), (1500, [float("inf")] * 16, 0), (1600, [], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.arange(300)
    for _ in range(300):
        label = np.minimum(label, np.where(link, label[None, :], 999).min(1))
    got = {r.vec_id: r for r in q.op3_near_vectors(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i in range(300):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), label[i], label[i] == i)
    for i in range(1000, 1601, 100):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)

    found = {}
    for r in q.op8_neighbours(spark, str(tmp_path)).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(found) == {0, 100, 200}
    hits = 0
    for i in found:
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(300), d)) if j != i][:10]
        assert sorted(found[i]) == list(range(1, 11)) and all(math.isclose(s, d[j], rel_tol=1e-12) for j, s in found[i].values())
        hits += len({j for j, _ in found[i].values()} & set(order))
    assert hits >= 27


def test_few_vectors(spark, tmp_path):
    rows = [(100, [1.0, 0.0, 0.0]), (200, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [-5.0, 0.0, 1.0]), (3, [1.0, 0.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in q.op8_neighbours(spark, str(tmp_path)).collect())
    assert got == [(100, 1, 3), (100, 2, 200), (100, 3, 1), (100, 4, 2), (200, 1, 3), (200, 2, 100), (200, 3, 1), (200, 4, 2)]


def vector_rows(spark, x):
    import pyarrow as pa

    return spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x))}))


def exact_neighbours(x, i, k=10):
    d = ((x - x[i]) ** 2).sum(1)
    d[i] = np.inf
    return set(np.argsort(d, kind="stable")[: min(k, len(x) - 1)].tolist())


@pytest.mark.parametrize(
    ("n", "size", "every", "clusters", "members"),
    [(8000, 64, 50, 0, 4096), (8000, 64, 50, 0, 16), (4000, 256, 50, 0, 4096), (2000, 768, 50, 0, 4096), (4000, 768, 50, 40, 4096), (100, 768, 1, 0, 4096), (65, 20, 1, 0, 4096), (5000, 32, 50, 3, 64)],
)
def test_neighbours_are_found_whatever_the_vectors(spark, monkeypatch, n, size, every, clusters, members):
    """Recall against brute force in every regime: many and few dimensions and rows, even and clustered, one and many groups of buckets."""
    from barlake.llm import ann

    monkeypatch.setattr(ann, "MEMBERS", members)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, size))
    if clusters:
        x = 0.3 * x + rng.normal(size=(clusters, size))[rng.integers(0, clusters, n)]
    df = vector_rows(spark, x).withColumns({c: F.lit("clash") for c in ("id", "t", "bucket", "v")})
    found = {}
    for r in ann.neighbours(df, F.col("vec_id") % every == 0).collect():
        found.setdefault(r.query_id, set()).add(r.id)
    wanted = {i: exact_neighbours(x, i) for i in range(0, n, every)}
    assert set(found) == set(wanted) and all(len(found[i]) == len(w) for i, w in wanted.items())
    assert sum(len(found[i] & w) for i, w in wanted.items()) >= 0.9 * sum(map(len, wanted.values()))


def test_hashing_compares_few(spark):
    """Where neighbours are near, few candidates are compared; where they aren't, never more than all."""
    from barlake.llm import ann

    rng = np.random.default_rng(3)
    for size, noise, most in ((64, 0.3, 0.05), (64, 9.0, 1.0), (768, 9.0, 1.0)):
        centres = rng.normal(size=(2000, size))
        x = centres[np.arange(20_000) % 2000] + noise * rng.normal(size=(20_000, size))
        asked = x[:40]
        near = [x[sorted(exact_neighbours(x, i))] for i in range(40)]
        assert ann.chosen(asked, near, x[-4096:], len(x), 200)[2] <= most * len(x)


@pytest.mark.parametrize("size", [8, 16, 64])
def test_links_are_counted_at_both_ends(spark, monkeypatch, size):
    """``n_links`` equals brute force with dozens of lists, whichever end finds the link."""
    from barlake.llm import neardup

    monkeypatch.setattr(neardup, "LISTS_PER_ROOT", 1.0)
    rng = np.random.default_rng(4)
    n = 4000
    x = rng.normal(size=(n, size))
    x[2000:] = x[rng.integers(0, 2000, 2000)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(n, size))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    angle = np.where(np.arange(n) < 2000, 0, np.arccos(0.951) * rng.uniform(0.5, 1, n))[:, None]
    x = np.cos(angle) * x + np.sin(angle) * y
    x[77] = x[78]
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.arange(n)
    while True:
        low = np.minimum(label, np.where(link, label[None, :], n).min(1))
        if (low == label).all():
            break
        label = low
    df = vector_rows(spark, x).withColumns({c: F.lit("clash") for c in ("rep", "home", "v", "id")})
    got = {r.id: r for r in neardup.near_duplicates(df).collect()}
    assert [got[i].n_links for i in range(n)] == link.sum(1).tolist()
    assert [got[i].component_id for i in range(n)] == label.tolist()


def test_quantiser_bound_holds():
    from barlake.llm.neardup import Quantiser
    from barlake.llm.vectors import unit

    x = unit(np.random.default_rng(4).normal(size=(400, 24)))
    index = Quantiser(x, 4)
    home = index.home(x)
    at = np.flatnonzero(home == 0)
    codes, left = index.codes(x[at] - index.centres[0])
    table = index.distances(x[:50] - index.centres[0], codes)
    exact = np.sqrt(((x[:50, None] - x[at][None]) ** 2).sum(2))
    assert (table <= exact + left + 1e-4).all() and (table >= exact - left - 1e-4).all()


def test_components(spark):
    from barlake.llm.components import connected_components

    rng = np.random.default_rng(8)
    edges = [(i, i + 1) for i in range(1, 40)] + [(1000 + int(a), 1000 + int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(7, 7), (None, 3)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {a: find(a) for a in parent}


# --- documents


def test_sharding(spark, corpus):
    from barlake.llm.sharding import shard_by_bytes

    path, texts, rows = corpus
    got = q.op4_histogram_sort(spark, path).collect()
    assert len(got) == len(rows)
    for r in got:
        t = texts.get(r.doc_id) if r.doc_id is not None else rows[-3][1]
        assert r.size == len((t or "").encode()) + 8 and r.text_crc32 == (None if t is None else zlib.crc32(t.encode())) and r.law == "bytes" and r.grown_shard is None
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    even = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("text"), F.lit(5).alias("shard"))
    sizes = [r["b"] for r in shard_by_bytes(even, 24).groupBy("shard").agg(F.sum("shard_size").alias("b")).collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) < 0.02 * sum(sizes) / 24 + 2 * 72


def brute_components(rows):
    sets, ids = {}, []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        s = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        ids.append((i, s))
    parent = {i: i for i, _ in ids if i is not None}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for x, (i, s) in enumerate(ids):
        for j, o in ids[:x]:
            if i is not None and j is not None and s and o:
                c = len(s & o)
                if 100 * c >= 75 * (len(s) + len(o) - c):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    return sorted(((i, len(s), find(i) if i is not None else None) for i, s in ids), key=str)


def test_jaccard(spark, corpus):
    path, _, rows = corpus
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in q.op5_jaccard(spark, path).collect()), key=str)
    assert got == brute_components(rows)


def test_tree_bound_is_sound():
    from barlake.llm.jaccard import RTree, point

    rng = np.random.default_rng(9)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 1 << 63, int(rng.integers(20, 200))).astype(np.uint64)
        sets += [np.unique(np.concatenate([base[int(rng.integers(0, 12)) :], rng.integers(0, 1 << 63, int(rng.integers(0, 12))).astype(np.uint64)])) for _ in range(5)]
    tree = RTree(np.array([len(s) for s in sets]), np.array([point(s) for s in sets]).astype(np.int32))
    for i, a in enumerate(sets):
        near = set(tree.search(i, 75, 100)[0].tolist())
        for k, b in enumerate(sets):
            c = len(np.intersect1d(a, b))
            if 100 * c >= 75 * (len(a) + len(b) - c):
                assert k in near


def test_bpe_round_trip(spark, corpus):
    from tokenizers import Tokenizer

    from barlake.llm.bpe import decode, digests, encode

    t = Tokenizer.from_file(q.vocabulary())
    odd = ["a<|endoftext|>b  <|endoftext|> c", "　x   y\u0085z", "don't 'S 's  \n\n x1２½ ́ \U0001f600 end  ", "\U0001fae8 new", " ", "tab\t\ttab", None, ""]
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(odd)], "doc_id long, text string, ids int")
    got = encode(df, q.vocabulary()).collect()
    assert all(r.ids == t.encode(r.text or "", add_special_tokens=False).ids for r in got)
    assert [r.text for r in sorted(decode(encode(df, q.vocabulary()), q.vocabulary()).collect())] == [x or "" for x in odd]
    path, texts, rows = corpus
    for r in [*digests(df, q.vocabulary()).collect(), *q.op6_bpe(spark, path).where("doc_id >= 100").collect()]:
        text = (odd[r.doc_id] if r.doc_id < 100 else texts[r.doc_id]) or ""
        ids = t.encode(text, add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_bpe_of_long_texts_is_bounded(spark):
    """Texts that Spark can't split are cut at word bounds, and neither they nor long words enter a task's table."""
    from tokenizers import Tokenizer

    from barlake.llm import bpe

    rng = np.random.default_rng(5)
    t = Tokenizer.from_file(q.vocabulary())
    long = [" ".join(f"w{x}  \n" for x in rng.integers(0, 10**6, 20_000)) + "\U0001fae8" + "x" * 300 + " end" * k for k in range(6)] + ["y" * 100_000 + " z", "a\x00b \x00"]
    assert max(map(len, bpe.cuts(long[0]))) < bpe.CUT + 100 and "".join(bpe.cuts(long[0])) == long[0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(long)], "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.ids for r in bpe.encode(df, q.vocabulary(), keep_text=False).collect()}
    assert all(got[i] == t.encode(x, add_special_tokens=False).ids for i, x in enumerate(long))
    table = bpe.WordTable(t)
    whole = 0
    for i in range(12):
        words = [f"q{i}w{k}" for k in range(30_000)] + ["l" * 1000]
        ids, ends = table.ids_of(words)
        whole += len(words)
        assert ids[ends[-2] : ends[-1]].tolist() == t.encode("l" * 1000).ids and ids[ends[7] : ends[8]].tolist() == t.encode(words[7]).ids
    assert len(table.row) < whole and table.bytes <= bpe.TABLE_BYTES + 30_000 * 300 and max(map(len, table.row)) <= bpe.LONGEST_WORD


def test_mixing(spark, corpus):
    from barlake.llm.mixing import mix, mixed_rows, source_targets
    from tests.compare import diff

    path, texts, rows = corpus
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    assert diff(q.op9_mixing(spark, path).where("doc_id IS NOT NULL"), con, f"SELECT * FROM ({q.OP9_SQL}) WHERE doc_id IS NOT NULL") == ""
    got = q.op9_mixing(spark, path).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size for r in got)
    for target, taken in {(r.source_size, r.target): sum(x.taken for x in got if (x.source_size, x.target) == (r.source_size, r.target)) for r in got}.items():
        assert 0 <= target[1] - taken < 1.01
    total = sum(r.size for r in got)
    assert abs(sum(r.taken for r in got) - total) <= 4
    sizes = spark.createDataFrame([("a", 10), ("b", 1), ("c", 1000), (None, 0)], "__source string, __total long")
    t = {r["__source"]: r["__target"] for r in source_targets(sizes, (1, 2, 3), 3).collect()}
    assert t["a"] == 30 and t["b"] == 3 and t[None] == 0 and math.isclose(t["c"], 978)
    df = spark.createDataFrame([(1, "a b c", "x", 9), (2, "d e", "y", 9), (2, "d e", "y", 9), (3, None, "y", 9)], "doc_id long, text string, source string, mix_size int")
    assert mix(df).count() == 4
    parts = mixed_rows(df)
    assert parts.columns == df.columns and sum(len(r.text.split()) for r in parts.collect()) in (6, 7)


def test_repeats(spark, corpus):
    path, texts, rows = corpus
    owner = {}
    for i, t in texts.items():
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            owner[g] = min(i, owner.get(g, i))
    got = q.op10_repeats(spark, path).collect()
    assert len(got) == len(rows)
    for r in got:
        w = (texts.get(r.doc_id, rows[-3][1]) or "").encode().split()
        gone = [False] * len(w)
        if r.doc_id is not None:
            for k in range(len(w) - 12):
                if owner[tuple(w[k : k + 13])] < r.doc_id:
                    gone[k : k + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest()), r.doc_id


def test_words_are_hashed_together(monkeypatch):
    """The hash of a word depends on its bytes alone; only words of more than 64 bytes are hashed one by one."""
    import pyarrow as pa
    import xxhash

    from barlake.llm.shingles import hashed_words, sliding_min

    alone, plain = [], xxhash.xxh3_64_intdigest
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda x: alone.append(len(x)) or plain(x))
    rng = np.random.default_rng(3)
    parts = [*" \t\n\x0b\x0c\r\x1c\x00\x85\u00a0aabAé", "x" * 8, "x" * 9, "y" * 63, "y" * 64, "z" * 65, "z" * 200]
    texts = [None if rng.random() < 0.1 else "".join(rng.choice(parts, int(rng.integers(0, 30)))) for _ in range(300)]
    for column, lower in ((pa.array(texts), False), (pa.array(texts), True), (pa.array(texts, pa.large_string()).slice(5, 90), False), (pa.array([None, ""]), False), (pa.array([], pa.string()), False)):
        alone.clear()
        hashes, bounds = hashed_words(column, lower)
        split = [((t or "").encode().lower() if lower else (t or "").encode()).split() for t in column.to_pylist()]
        flat = [w for words_here in split for w in words_here]
        assert bounds.tolist() == [0, *np.cumsum([len(x) for x in split]).tolist()] and len(hashes) == len(flat)
        assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))
        assert sorted(alone) == sorted(len(w) for w in flat if len(w) > 64)
    x = rng.permutation(40).astype(np.uint64)
    assert all(np.array_equal(sliding_min(x, n), np.lib.stride_tricks.sliding_window_view(x, n).min(1)) for n in (1, 2, 3, 9, 40))


def test_repeats_clash_and_repeat_of_id(spark):
    from barlake.llm.phrases import remove_repeats

    text = " ".join(f"v{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, "a"), (1, text, "b"), (2, "new " + text, "c"), (3, text + " " + text, "d")], "doc_id long, text string, n_words string")
    got = {(r.doc_id, r.kept_text): r.n_removed for r in remove_repeats(df).collect()}
    assert got == {(1, text): 0, (2, "new"): 30, (3, ""): 60} or got == {(1, text): 0, (2, "new"): 30, (3, " ".join([])): 60}


def test_pipeline(spark, sf_dir, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{k}")
        done = spark.read.parquet(f"{tmp_path}/{k}")
        if name in ("quality", "near_duplicates", "repeated_passages"):
            assert done.columns == docs.columns and done.count() <= n and done.select("doc_id").distinct().count() == done.count()
            if name != "repeated_passages":
                assert done.exceptAll(docs).isEmpty()
        docs = done
    assert docs.where("n_tokens != size(ids)").isEmpty() and docs.count() > 0


def test_near_duplicates_are_rows(spark):
    import corpus_pipeline

    rng = np.random.default_rng(11)
    a, b, c, d = (words(rng, 120, 5000) for _ in range(4))
    near = lambda t: t + " more"
    rows = [(1, a, "x"), (1, a, "x"), (1, a, "y"), (2, near(a), "x"), (5, a, "x"), (5, b, "x"), (None, a, "x"), (None, c, "x"), (None, c, "x"), (9, near(c), "x"), (None, d, "x"), (None, near(d), "x")]
    without_words = [(None, "", "x"), (None, "", "x"), (6, None, "x"), (7, " ", "x")]
    docs = spark.createDataFrame(rows + without_words, "doc_id long, text string, source string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sum(t in (d, near(d)) and i is None for i, t, _ in got) == 1
    rest = [r for r in got if r[1] not in (d, near(d))]
    assert sorted(rest, key=repr) == sorted([(1, a, "x"), (5, b, "x"), (9, near(c), "x"), *without_words], key=repr)


def test_bitmaps_keep_what_they_must(spark):
    from barlake.llm.bitmap import bitmap_array, bitmap_rows, in_array, maybe_in

    ids = spark.range(0, 5000, 7)
    rows = bitmap_rows(ids, "id")
    everything = spark.range(5000).withColumn("__x", F.lit(1)).union(spark.sql("SELECT CAST(NULL AS bigint), 1"))
    inside, outside = maybe_in(everything, "id", rows), maybe_in(everything, "id", rows, inside=False)
    assert ids.join(inside, "id", "left_anti").isEmpty() and inside.count() + outside.count() == 5001 and outside.where("id IS NULL").count() == 1
    assert inside.count() < 760 and inside.columns == everything.columns
    bits = bitmap_array(ids.select((F.col("id") * -3).alias("h")), "h")
    assert in_array(bits, np.arange(0, 5000, 7).astype(np.int64).__mul__(-3).view(np.uint64)).all()


def test_scores_with_clashing_columns(spark, corpus):
    from barlake.llm.quality import fit_quality, score_quality
    from barlake.llm.toxicity import fit_toxicity, score_toxicity

    path, _, rows = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({"quality_score": F.lit("old"), "toxicity": F.lit("old"), "label": F.lit(9), "text2": F.col("text")})
    labels = spark.read.parquet(f"{path}/labels.parquet")
    for out in (score_quality(docs, fit_quality(docs, labels)), score_toxicity(docs, fit_toxicity(docs, labels))):
        assert sorted(out.columns) == sorted(docs.columns) and out.count() == len(rows)
