import numpy as np

from winnow.llm import queries, toxicity


def test_chain_feeds_earlier_probabilities_on():
    rng = np.random.default_rng(0)
    texts, y = [], []
    for i in range(400):
        a, b = rng.random() < 0.3, rng.random() < 0.3
        words = [f"w{k}" for k in rng.integers(0, 200, 30)] + ["Vile!"] * a + ["nasty,"] * b
        texts.append(" ".join(words).encode())
        y.append((int(a), int(a or b)))
    chain = toxicity.train(texts, np.array(y))
    assert [len(m.chain) for m in chain] == [0, 1] and chain[1].chain[0] > 0
    rows, table = toxicity.weight_table(chain)
    p = toxicity.score_texts([b"VILE", b"nasty", b"w1 w2", b""], toxicity.Words(rows), table, chain)
    assert p[0, 0] > 0.5 > p[1, 0] and p[0, 1] > 0.5 and p[1, 1] > 0.5 and p[2:].max() < 0.5
    # the stored table scores as the models themselves do
    features = [toxicity.document_features(t) for t in texts]
    first = toxicity.sigmoid(chain[0].margin(features, np.zeros((400, 0))))
    second = toxicity.sigmoid(chain[1].margin(features, first[:, None]))
    got = toxicity.score_texts(texts, toxicity.Words(rows), table, chain)
    assert np.allclose(got, np.column_stack([first, second]), atol=1e-5)


def test_training_step_by_step(monkeypatch):
    """Follow the regularized leader written out weight by weight, and the chain's out-of-fold input."""
    monkeypatch.setattr(toxicity, "BUCKETS", 64)
    monkeypatch.setattr(toxicity, "L1", 0.3)
    rng = np.random.default_rng(2)
    features = [np.unique(rng.integers(0, 64, 6)) for _ in range(12)]
    earlier, y = rng.random((12, 1)), (rng.random(12) < 0.5).astype(float)
    got = toxicity.fit_linear(features, earlier, y, epochs=2, seed=8)
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= (0.3 if i < 64 else 0.0):
            return 0.0
        return ((0.3 if i < 64 else 0.0) * (1 if z[i] > 0 else -1) - z[i]) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA)

    order = np.random.default_rng(8)
    for _ in range(2):
        for r in order.permutation(12):
            x = {int(i): 1.0 for i in features[r]} | {64: earlier[r, 0], 65: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - y[r]) * x[i]
                z[i] = z.get(i, 0.0) + g - ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / toxicity.ALPHA * w[i]
                n[i] = n.get(i, 0.0) + g * g
    assert np.allclose(got.weights, [weight(i) for i in range(64)], atol=1e-5)
    assert np.allclose([got.chain[0], got.bias], [weight(64), weight(65)])


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in queries.op7_toxicity(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(rows) == 10_000
    held = [(r.toxic, rows[r.doc_id].toxic) for r in labels if rows[r.doc_id].held_out]
    assert np.mean([p for y, p in held if y]) > 0.85 and np.mean([p for y, p in held if not y]) < 0.01


def test_models_fitted_in_tasks_are_the_same(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 60, 12)).encode() for _ in range(120)]
    y = np.array([[int(b"w1 " in t), int(b"w2 " in t or b"w1 " in t)] for t in texts])
    one, other = toxicity.train(texts, y), toxicity.train(texts, y, toxicity.in_tasks(spark))
    for a, b in zip(one, other, strict=True):
        assert np.array_equal(a.weights, b.weights) and a.bias == b.bias and np.array_equal(a.chain, b.chain)


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (6, None, 1), (3, 0, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(odd, labels)
    rows = toxicity.classify(odd, chain).collect()
    assert len(rows) == odd.count() and all(0 <= r.p_toxic <= 1 and r.is_toxic == (r.p_toxic >= 0.3) for r in rows)
    by = {}
    for r, d in zip(sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted(odd.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0)), strict=True):
        by.setdefault(" ".join((d.text or "").split()), set()).add((r.p_junk, r.p_toxic))
    # equal words, equal values; null, empty and white space are alike
    assert len(by["one two three"]) == 1 and len(by[""]) == 1
    features = toxicity.document_features(odd.where("doc_id = 5").first().text.encode())
    first = toxicity.sigmoid(chain[0].margin([features], np.zeros((1, 0))))
    want = float(first[0]), float(toxicity.sigmoid(chain[1].margin([features], first[:, None]))[0])
    assert np.allclose([want], [*by[" ".join(odd.where("doc_id = 5").first().text.split())]], atol=1e-5)
    assert toxicity.classify(empty, chain).collect() == []
    assert len(toxicity.classify(odd, toxicity.fit(odd, labels.limit(0))).collect()) == odd.count()
