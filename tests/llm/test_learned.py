"""The classifiers on held-out rows, their odd inputs, the chain against enumeration, and the pipeline end to end."""

import itertools
import random
import zlib

import numpy as np
import pytest

from arborlex.llm import crf, nbsvm
from arborlex.llm.labelled import logistic, probability, sample
from arborlex.llm.workspace import Workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long, y string, score string, prob double"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    bad = ["zmoron", "zidiot", "zscum"]
    docs, labels = [], []
    for i in range(900):
        w = [rng.choice(vocab) for _ in range(rng.randrange(5, 80))]
        toxic, junk = i % 7 == 0, i % 4 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", ",", "."]))
        if junk:
            w = [x + "%%%" if rng.random() < 0.5 else x for x in w]
        docs.append((i, " ".join(w), "en", "s", 1, "a", "b", 0.5))
        labels.append((i, int(not junk), int(toxic)))
    docs += [(None, "zidiot", None, None, None, None, None, None), (2000, None, None, None, None, None, None, None), (2001, "", "en", "s", 0, "a", "b", 0.1), (2002, "x" * 200_000, "en", "s", 0, "a", "b", 0.1), (3, docs[3][1], "en", "s", 1, "a", "b", 0.5)]
    labels += [(None, 1, 1), (5, None, None), (7, 0, 1)]
    return spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("run", "mod", "rest", "column"), [(nbsvm.score_quality, 5, 0, 1), (crf.score_toxicity, 4, 2, 2)])
def test_held_out_accuracy(tables, run, mod, rest, column):
    docs, labels = tables
    truth = {r[0]: r[column] for r in labels.collect() if r[0] is not None and r[column] is not None}
    out = run(docs, labels).collect()
    assert len(out) == docs.count()
    for r in out:
        crc = zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode())
        assert r["held_out"] == (crc % mod == rest) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    own = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert len(own) > 100 and sum(r["predicted"] == truth[r["doc_id"]] for r in own) >= 0.95 * len(own)


def test_spans_point_at_toxic_words(tables):
    docs, labels = tables
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    hit = [(texts[r["doc_id"]].encode()[s["start"] : s["end"]].decode(), s["marginal"]) for r in crf.score_toxicity(docs, labels).collect() for s in r["spans"]]
    assert len(hit) > 300 and sum(w in ("zmoron", "zidiot", "zscum") for w, _ in hit) >= 0.97 * len(hit)


def test_models_do_not_see_held_out_labels(spark, tables):
    docs, labels = tables
    swapped = labels.collect()
    swapped = [(r[0], 1 - r[1] if r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[1], r[2]) for r in swapped]
    other = spark.createDataFrame(swapped, "doc_id long, quality int, toxic int")
    a, b = nbsvm.fit(docs, labels), nbsvm.fit(docs, other)
    assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])


@pytest.mark.parametrize("value", [None, 0, 1])
def test_one_class_or_none(spark, tables, value):
    docs, _ = tables
    rows = [] if value is None else [(i, value, value) for i in range(50)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    for run in (nbsvm.score_quality, crf.score_toxicity):
        scores = {r["score"] for r in run(docs, labels).collect()}
        assert len(scores) <= 2 and all(0 <= s <= 1 for s in scores)
    empty = docs.limit(0)
    assert nbsvm.score_quality(empty, labels).count() == 0 and crf.score_toxicity(empty, labels).count() == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    log_t = rng.normal(size=(2, 2))
    chain = crf.Chain(np.zeros(1), 0.0, log_t)
    lens = np.array([1, 4, 0, 6, 3])
    at = np.r_[0, np.cumsum(lens)]
    e = rng.normal(size=at[-1])
    got, pairs = chain.marginals(e, at, expect=True)
    want, want_pairs = np.zeros(len(e)), np.zeros((2, 2))
    for a, b in zip(at[:-1], at[1:]):
        total, m, p = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=b - a):
            s = sum(e[a + i] for i, y in enumerate(path) if y) + sum(log_t[x, y] for x, y in zip(path, path[1:]))
            total += np.exp(s)
            m += np.exp(s) * np.array(path)
            for x, y in zip(path, path[1:]):
                p[x, y] += np.exp(s)
        if b > a:
            want[a:b] = m / total
            want_pairs += p / total
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


def test_long_texts_have_the_same_marginals(monkeypatch):
    rng = np.random.default_rng(2)
    chain = crf.Chain(np.zeros(1), 0.0, rng.normal(size=(2, 2)))
    at = np.r_[0, np.cumsum([3000, 5, 1, 40, 2, 1025])]
    e = rng.normal(scale=4, size=at[-1])
    fast, pairs = chain.marginals(e, at, expect=True)
    monkeypatch.setattr(crf, "LONG", 1 << 30)
    slow, want = chain.marginals(e, at, expect=True)
    assert np.allclose(fast, slow) and np.allclose(pairs, want)


def test_dual_descent_meets_the_optimality_conditions():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 200)
    x = [np.unique(np.r_[rng.integers(0, 500, 20), 1000 + y[i] * (rng.random() < 0.8)]) for i in range(200)]
    r = nbsvm.log_count_ratio(x, y)
    d = nbsvm.descend(x, y, r, epochs=2000, enough=1e-9)
    scaled = [r[f] / np.sqrt(len(f)) for f in x]
    sign = np.where(y == 1, 1.0, -1.0)
    w = np.zeros_like(d.w)
    for f, v, s, a in zip(x, scaled, sign, d.alpha):  # the primal weights are those of the dual variables
        w[f] += s * a * v
    assert np.allclose(w, d.w, atol=1e-9)
    slack = np.array([s * (w[f] @ v) - 1 for f, v, s in zip(x, scaled, sign)])
    low, high = d.alpha <= 1e-9, d.alpha >= d.upper - 1e-9
    assert (slack[low] >= -1e-6).all() and (slack[high] <= 1e-6).all() and (abs(slack[~low & ~high]) <= 1e-6).all()
    assert 0 < low.sum() < 200 and (~low & ~high).any()
    primal = w @ w / 2 + (d.upper * np.maximum(0, -slack)).sum()
    assert primal == pytest.approx(d.alpha.sum() - w @ w / 2, rel=1e-6)  # no gap to the dual


def test_sample_is_bounded_in_rows_and_bytes(spark):
    rows = [(7, "copy")] * 5000 + [(7, "another copy"), (8, None), (8, "b"), (None, "c")] + [(i, "x" * i) for i in range(20, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in [7, 8, *range(20, 60)]] + [(7, 0), (8, None)], "doc_id long, toxic int")
    take = lambda n, size: sample(docs, labels, "toxic", 97, 96, n, size, Workspace(spark, "t")).collect()
    every = {r["doc_id"]: (r["text"], r["y"]) for r in take(1000, 1 << 20)}
    kept = [i for i in [7, 8, *range(20, 60)] if zlib.crc32(str(i).encode()) % 97 != 96]
    assert sorted(every) == kept and len(take(1000, 1 << 20)) == len(kept)
    assert every[7] == ("another copy", 1) and every[8] == ("", 0)
    assert len(take(10, 1 << 20)) == 10
    few = take(1000, 300)
    assert 3 <= len(few) and 240 <= sum(len(r["text"]) for r in few) <= 300 and len({r["doc_id"] for r in few}) == len(few)


@pytest.mark.parametrize("run", [nbsvm.score_quality, crf.score_toxicity])
def test_repeated_labelled_rows_change_nothing(tables, run):
    docs, labels = tables
    one = docs.where("doc_id = 14")
    more = docs
    for _ in range(6):
        more = more.unionByName(one)
    a = {r["doc_id"]: r["score"] for r in run(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in run(more, labels).collect()}
    assert a == b


def test_logistic_recovers_probabilities():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 1))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))).astype(float)
    w = logistic(x, y)
    assert abs(w[0] - 2) < 0.25 and abs(w[1] + 1) < 0.2 and probability(w, np.array([[0.5]]))[0] == pytest.approx(0.5, abs=0.06)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "simhash_dedup", "decontamination", "mixing", "sharding"] and P.ORACLE_SQL is None
    columns, kept = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        now = {r[0] for r in docs.select("doc_id").collect()}
        assert now <= kept and len(now) >= 0.5 * len(kept)
        assert k == 4 or docs.columns == columns
        kept = now
    assert docs.where("shard is null or slot is null").count() == 0
    whole = P.run(spark, sf)
    key = ["doc_id", "shard", "size"]
    assert sorted(map(tuple, whole.select(key).collect())) == sorted(map(tuple, docs.select(key).collect()))


ODD = "doc_id long, text string, lang string, source string, n_chars long, shard string, size string, kept_node string, contaminated string, again string"


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(1)
    plain = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(60)) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", 1, "x", "y", "z", "c", "a") for i, t in enumerate(plain)]
    rows += [(None, plain[0], None, None, None, None, None, None, None, None), (40, None, "en", "s1", 0, "x", "y", "z", "c", "a"), (41, "", None, "s1", 0, "x", "y", "z", "c", "a"), (42, "word " * 30_000, "en", None, 0, "x", "y", "z", "c", "a"), (3, plain[3], "en", "s0", 1, "x", "y", "z", "c", "a"), (3, plain[4], "en", "s0", 1, "x", "y", "z", "c", "a")]
    for name, every in (("odd", rows), ("empty", [])):
        sf = tmp_path / name
        spark.createDataFrame(every, ODD).repartition(3).write.parquet(str(sf / "documents.parquet"))
        spark.createDataFrame([(1, plain[7][20:150]), (2, None), (None, "")], "item_id long, text string").write.parquet(str(sf / "benchmark.parquet"))
        spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(sf / "labels.parquet"))
        out = P.run(spark, str(sf)).collect()
        if not every:
            assert out == []
            continue
        kept = {r["doc_id"] for r in out}
        assert kept <= {r[0] for r in rows} and 7 not in kept and all(0 <= r["shard"] < 40 for r in out)
        assert {r["text"] for r in out} <= {r[1] for r in rows}
