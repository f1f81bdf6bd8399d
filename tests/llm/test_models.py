import zlib

import numpy as np

from tidemark.llm import crf, toxicity


def held_out(spark, scores, sf, column):
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").collect()}
    rows = scores.collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % (5 if column == "quality" else 4) == (0 if column == "quality" else 2)) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    counts = np.zeros((2, 2), int)
    for r in rows:
        if r.held_out and r.doc_id in labels:
            counts[labels[r.doc_id], r.predicted] += 1
    return counts


def inputs(spark, sf):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        s, t = rng.normal(size=n), rng.normal(size=4)
        p = np.zeros(n)
        total = 0.0
        for code in range(1 << n):
            y = [code >> k & 1 for k in range(n)]
            w = np.exp(sum(s[k] * y[k] for k in range(n)) + sum(t[2 * y[k] + y[k + 1]] for k in range(n - 1)))
            total += w
            p += w * np.array(y)
        assert np.allclose(crf.Chains(np.array([n])).good(s, t), p / total)
    sizes = np.array([3, 1, 7, 3])
    s = rng.normal(size=14)
    together = crf.Chains(sizes).good(s, t)
    apart = [crf.Chains(np.array([n])).good(s[a : a + n], t) for a, n in zip([0, 3, 4, 11], sizes, strict=True)]
    assert np.allclose(together, np.concatenate(apart))


def test_gradient_against_differences():
    """Log likelihoods from all labellings of small documents, weights and soft labels included."""
    rng = np.random.default_rng(2)
    sizes, width = np.array([3, 1, 4]), 5
    x, y, theta = rng.normal(size=(8, width)), rng.random(8), rng.normal(size=width + 4)
    weight = np.repeat([0.5, 1.0, 2.0], sizes)

    def likelihood(theta):
        total, at = 0.0, 0
        for n in sizes:
            s, t, soft = x[at : at + n] @ theta[:-4], theta[-4:], y[at : at + n]
            score = lambda z: s @ z + sum(t[2 * int(a) + int(b)] for a, b in zip(z, z[1:], strict=False))
            every = [np.array([code >> k & 1 for k in range(n)]) for code in range(1 << n)]
            given = s @ soft + sum(pa * pb * t[2 * a + b] for u, v in zip(soft, soft[1:], strict=False) for a, pa in ((0, 1 - u), (1, u)) for b, pb in ((0, 1 - v), (1, v)))
            total += weight[at] * (given - np.log(sum(np.exp(score(z)) for z in every)))
            at += n
        return total

    steps = 1e-5 * np.eye(width + 4)
    want = [(likelihood(theta + d) - likelihood(theta - d)) / 2e-5 for d in steps]
    assert np.allclose(crf.gradient(x, crf.Chains(sizes), weight, y, theta), want, atol=1e-6)


def test_line_labels_are_estimated_again():
    p, labels = np.array([0.9, 0.2, 0.4, 0.4, 0.7, 0.1]), np.array([0, 0, 0, 1, 1, 0])
    assert crf.bad_lines(labels, p, np.array([0, 3, 5])).tolist() == [0.9, 0, 0.4, 1, 1, 0]


def test_quality_on_held_out_documents(spark):
    (bad, miss), (false, good) = held_out(spark, crf.quality_scores(*inputs(spark, "sf0.1")), "sf0.1", "quality")
    assert bad / (bad + miss) > 0.9 and good / (good + false) > 0.98


def test_toxicity_on_held_out_documents(spark):
    (clean, false), (miss, toxic) = held_out(spark, toxicity.toxicity_scores(*inputs(spark, "sf0.1")), "sf0.1", "toxic")
    assert toxic / (toxic + miss) > 0.85 and clean / (clean + false) > 0.99


def test_ftrl_against_one_coordinate_at_a_time():
    rng = np.random.default_rng(1)
    model, z, n = toxicity.Ftrl(6), np.zeros(6), np.zeros(6)
    weight = lambda i: 0.0 if abs(z[i]) <= toxicity.L1 else -(z[i] - np.sign(z[i]) * toxicity.L1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)
    for _ in range(300):
        at, y = np.flatnonzero(rng.random(5) < 0.6), int(rng.random() < 0.3)
        model.learn(at, y)
        on = [*at.tolist(), 5]
        w = {i: weight(i) for i in on}
        g = 1 / (1 + np.exp(-sum(w.values()))) - y
        for i in on:
            sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA
            z[i] += g - sigma * w[i]
            n[i] += g * g
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "nice words", 0.5), (3, "nice words", 0.5), (None, "nice words", 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 0, 1), (3, 1, 0), (3, 1, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        for rows in (crf.quality_scores(docs, labels).collect(), toxicity.toxicity_scores(docs, labels).collect()):
            assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 2, 3, 3]
            assert all(0 <= r.score <= 1 for r in rows)
            assert len({r.score for r in rows if r.doc_id == 3}) == 1
    assert crf.quality_scores(docs.limit(0), some).count() == 0 and toxicity.toxicity_scores(docs.limit(0), some).count() == 0
