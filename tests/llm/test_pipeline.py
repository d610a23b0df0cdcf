"""Every stage of the pipeline, and the operators without SQL, against a brute-force version on awkward tables."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barlake.llm import queries as q

#: Besides the usual columns some whose names the stages use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, id string, ids string, n_removed int, shard int, mix_size string, key int"


def said(rng, n):
    return " ".join(f"w{rng.integers(4000)}" for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """Nulls in every column, empty and long texts, ties, repeated rows, equal and near copies, ids with two texts."""
    rng = np.random.default_rng(21)
    base, shared = said(rng, 80), said(rng, 30)
    texts = [(i, said(rng, int(rng.integers(20, 70)))) for i in range(40)]
    texts += [(50 + i, base) for i in range(6)] + [(60 + i, base + f" extra{i}") for i in range(4)] + [(70 + i, f"{said(rng, 12)} {shared} {said(rng, 12)}") for i in range(8)]
    texts += [(50, base), (3, said(rng, 30)), (None, base), (None, said(rng, 40)), (None, None), (90, None), (91, ""), (92, " \n"), (93, "one"), (94, said(rng, 9000)), (95, "é\U0001fae8 <|endoftext|> x\x00y")]
    rows = [(i, t, [None, "en"][k % 2], [None, "b", "a", "c"][k % 4], [None, len(t or "")][k % 3 > 0], k % 2, "x", None, 5, 7, "z", None) for k, (i, t) in enumerate(texts)]
    rows += rows[:2] + rows[-3:]
    path = tmp_path_factory.mktemp("awkward")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 2), int(i % 3 == 0)) for i in range(40)] + [(None, 1, 1), (1, None, None), (2, 1, 0), (2, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def result(spark, stage, rows, path):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = dict(corpus_pipeline.STAGES)[stage](spark, df, path)
    return out, [tuple(r) for r in out.collect()]


def test_quality_stage(spark, awkward):
    from barlake.llm.quality import describe, fit_quality

    path, rows = awkward
    df = spark.createDataFrame(rows, SCHEMA)
    model = fit_quality(df.select("doc_id", "text"), spark.read.parquet(f"{path}/labels.parquet"))
    scores = model.score(np.array([describe(r[1]) for r in rows]))
    out, got = result(spark, "quality", rows, path)
    assert out.columns == df.columns and Counter(got) == Counter(r for r, s in zip(rows, scores, strict=True) if s >= corpus_pipeline.LEAST_QUALITY)
    assert 0 < len(got) < len(rows)


def test_near_duplicate_stage(spark, awkward):
    path, rows = awkward
    out, got = result(spark, "near_duplicates", rows, path)
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    members = defaultdict(list)
    for r, g, s in zip(rows, group, sets, strict=True):
        members[g if s else None].append(r)
    left = Counter(got)
    assert all(left[r] == n for r, n in Counter(members.pop(None)).items())
    for own in members.values():
        kept = [r for r in got if r in own]
        smallest = min((r[0] is None, r[0] or 0) for r in own)
        assert len(kept) == 1 and (kept[0][0] is None, kept[0][0] or 0) == smallest


def test_repeated_passage_stage(spark, awkward):
    path, rows = awkward
    out, got = result(spark, "repeated_passages", rows, path)
    owner = {}
    for r in rows:
        w = (r[1] or "").encode().split()
        for k in range(len(w) - 12):
            if r[0] is not None:
                g = tuple(w[k : k + 13])
                owner[g] = min(r[0], owner.get(g, r[0]))
    want = []
    for r in rows:
        w = (r[1] or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if r[0] is not None and owner[tuple(w[k : k + 13])] < r[0]:
                gone[k : k + 13] = [True] * 13
        text = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode() if any(gone) else r[1]
        want.append((r[0], text, r[2], r[3], None if text is None else len(text), *r[5:]))
    assert Counter(got) == Counter(want) and any(r not in rows for r in want)


def test_mixture_stage(spark, awkward):
    """Rows per source near their targets, whole texts or leading parts of them, no row more than three times."""
    path, rows = awkward
    out, got = result(spark, "mixture", rows, path)
    size = lambda t: len((t or "").encode().split())
    totals = Counter()
    for r in rows:
        totals[r[3]] += size(r[1])
    sources = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    target, free, rest = {}, set(sources), float(sum(totals.values()))
    while True:
        over = [s for s in free if rest * weight[s] / sum(weight[x] for x in free) > 3 * totals[s]]
        if not over:
            break
        s = min(over, key=lambda s: 3 * totals[s] / weight[s])
        target[s], rest = 3 * totals[s], rest - 3 * totals[s]
        free.discard(s)
    target |= {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
    taken = Counter()
    for r in got:
        taken[r[3]] += size(r[1])
    assert all(abs(taken[s] - target[s]) <= 2 for s in sources)
    whole = Counter((r[0], r[3], r[1]) for r in rows)
    cut = [r for r in got if (r[0], r[3], r[1]) not in whole]
    assert len(cut) <= len(sources) and all(n <= 3 * whole[k] for k, n in Counter((r[0], r[3], r[1]) for r in got if (r[0], r[3], r[1]) in whole).items())
    for r in cut:
        assert any(x[0] == r[0] and x[3] == r[3] and " ".join((x[1] or "").split()).startswith(r[1]) for x in rows)
    assert all(r[4] == len(r[1]) and size(r[1]) for r in got) and Counter(map(tuple, got)) == Counter(result(spark, "mixture", rows[::-1], path)[1])


def test_token_stage(spark, awkward):
    from tokenizers import Tokenizer

    path, rows = awkward
    t = Tokenizer.from_file(q.vocabulary())
    _, got = result(spark, "tokens", rows, path)
    want = [(r[0], r[3], t.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    assert Counter((i, s, n, tuple(x)) for i, s, n, x in got) == Counter((i, s, len(x), tuple(x)) for i, s, x in want)


def test_run_is_its_stages(spark, awkward):
    path, _ = awkward
    df = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, path)
    assert Counter(map(repr, df.collect())) == Counter(map(repr, corpus_pipeline.run(spark, path).collect()))


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_of_empty_tables(spark, awkward, stage):
    assert result(spark, stage, [], awkward[0])[1] == []


# --- operators without SQL


def test_shards_are_a_sort_cut_at_equal_bytes(spark, awkward):
    """Against a sort on the driver: rows in key order, cut where the bytes before come nearest to their share."""
    from barlake.llm.sharding import _key, shard_by_bytes

    path, rows = awkward
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.repeat(F.sha1(F.col("id").cast("string")), (F.col("id") % 7 + 1).cast("int"))).alias("text"))
    for df, tolerance in ((many, 0.002), (spark.createDataFrame(rows, SCHEMA), 0.002)):
        got = shard_by_bytes(df, 24).withColumns({"k": _key(F.col("text")), "d": _key(F.col("doc_id"))}).collect()
        ordered = sorted(got, key=lambda r: (r.k, r.d))
        assert [r["shard"] for r in ordered] == sorted(r["shard"] for r in got)
        sizes = Counter()
        for r in got:
            assert r.shard_size == len((r.text or "").encode()) + 8
            sizes[r["shard"]] += r.shard_size
        total, before = sum(sizes.values()), 0
        groups = Counter()
        for r in got:
            groups[r.k, r.d] += r.shard_size
        for i in range(24):
            assert abs(before - total * i / 24) <= max(tolerance * total / 24, max(groups.values())) + 1
            before += sizes[i]
        for i in range(24):
            assert sorted(r.shard_slot for r in got if r["shard"] == i) == list(range(sum(r["shard"] == i for r in got)))


@pytest.mark.parametrize(("name", "label", "least"), [("op7_quality", "quality", 0.7), ("op2_toxicity", "toxic", 0.3)])
def test_scores_equal_those_of_the_model_and_hold_for_unseen_rows(spark, name, label, least):
    """Scores by the query equal those of the model row by row on the driver, and are right for rows that it never saw."""
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = {r.doc_id: r for r in q.queries()[name](spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    if label == "quality":
        from barlake.llm.quality import describe, fit_quality

        model = fit_quality(docs, labels)
        score = lambda t: float(model.score(np.array([describe(t)]))[0])
    else:
        from barlake.llm.toxicity import fit_toxicity, terms_of

        model = fit_toxicity(docs, labels)
        score = lambda t: float(model.score([terms_of(t)])[0])
    assert set(got) == set(texts)
    for i in list(texts)[::11]:
        assert math.isclose(got[i].score, score(texts[i]), abs_tol=1e-9) and got[i].predicted == int(got[i].score >= least)
    known = {r.doc_id: r[label] for r in labels.collect() if r[label] is not None}
    unseen = [i for i in known if i in got and got[i].held_out]
    right = sum(got[i].predicted == known[i] for i in unseen)
    assert len(unseen) > 20 and right >= 0.95 * len(unseen)
