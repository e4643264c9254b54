import zlib

import numpy as np

from winnow.llm import labelled, quality, queries


def direct(text, model):
    """The score from the document's features one by one."""
    words = text.split()
    alone, pairs = [], []
    for i, w in enumerate(words):
        buckets, _ = quality.word_features([w])
        alone += [float(model.logits[b]) for b in buckets]
        if i:
            pairs.append(float(model.logits[quality.pair_buckets(quality.word_hashes([words[i - 1], w]))[0]]))
    mean = lambda x: sum(x) / max(len(x), 1)
    total = (mean(alone) + mean(pairs)) / 2 if pairs else mean(alone)
    return 1 / (1 + np.exp(-(total + model.bias)))


def test_document_is_the_mean_of_words_and_pairs():
    ids, share = quality.document_features(b"a b b")
    at = dict(zip(ids.tolist(), share.tolist(), strict=True))
    pairs = quality.pair_buckets(quality.word_hashes([b"a", b"b", b"b"]))
    assert abs(sum(share) - 1) < 1e-6 and at[pairs[0]] == 0.25 and at[pairs[1]] == 0.25
    assert pairs[1] == quality.pair_buckets(quality.word_hashes([b"x", b"x"]))[0]


def test_remembered_words_score_as_features_do(monkeypatch):
    monkeypatch.setattr(quality, "REMEMBERED", 5)
    model = quality.Model(np.random.default_rng(1).standard_normal(quality.BUCKETS).astype(np.float32), 0.3)
    texts = [b"", b"a", b"a a a b", "é漢 é漢 x".encode(), b" ".join(b"w%d" % (i % 9) for i in range(100)), b"b b"]
    got = quality.score_texts(texts, quality.Words(model), model)
    assert np.allclose(got, [direct(t, model) for t in texts], atol=1e-6)


def test_training_step_by_step(monkeypatch):
    """The same steps written out feature by feature, with the same starting vectors and order."""
    monkeypatch.setattr(quality, "BUCKETS", 1 << 12)
    texts = [(b"calm sea", 1), (b"calm calm calm", 0), (b"high tide at noon", 1), (b"noon noon", 0), (b"", 1), (b"sea", 1)]
    dims, epochs, rate = 3, 3, 0.4
    got = quality.train(texts, epochs=epochs, rate=rate, dims=dims, seed=5)
    rng = np.random.default_rng(5)
    vectors = rng.uniform(-1 / dims, 1 / dims, (quality.BUCKETS, dims)).astype(np.float32).astype(float)
    output, offset = np.zeros((2, dims)), [0.0, float(np.log(5 / 3))]
    data = [(dict(zip(*(x.tolist() for x in quality.document_features(t)), strict=True)), y) for t, y in texts if t]
    step = 0
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            shares, y = data[k]
            lr = rate * (1 - step / (epochs * len(data)))
            step += 1
            hidden = [sum(w * vectors[f][d] for f, w in shares.items()) for d in range(dims)]
            z = [sum(output[c][d] * hidden[d] for d in range(dims)) + offset[c] for c in (0, 1)]
            e = [np.exp(v - max(z)) for v in z]
            error = [e[c] / sum(e) - (c == y) for c in (0, 1)]
            back = [lr * sum(error[c] * output[c][d] for c in (0, 1)) for d in range(dims)]
            for c in (0, 1):
                for d in range(dims):
                    output[c][d] -= lr * error[c] * hidden[d]
            for f in shares:
                for d in range(dims):
                    vectors[f][d] -= back[d]
    assert np.allclose(got.logits, vectors @ (output[1] - output[0]), atol=1e-4)


def test_held_out_documents_are_told_apart(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op1_quality(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    held = [(r.quality, rows[r.doc_id].score) for r in labels if rows[r.doc_id].held_out]
    good, bad = [s for y, s in held if y], [s for y, s in held if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.95 and np.mean(np.array(good) >= 0.3) > 0.95


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (None, 0), (6, None), (3, 0), (99, 1)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    rows = quality.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1
    assert quality.score(empty, model).collect() == []
    none = quality.fit(odd, labels.limit(0))
    assert {r.score for r in quality.score(odd, none).collect()} == {0.5}


def test_sample_is_bounded_and_leaves_the_fold_out(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = labelled.sample(docs, labels, ["quality"], 5, rows=10)
    assert len(got) == 10 and got == labelled.sample(docs, labels, ["quality"], 5, rows=10)
    assert len(labelled.sample(docs, labels, ["quality"], 5, limit=1)) == 1
    whole = labelled.sample(docs, labels, ["quality"], 5)
    cut = labelled.sample(docs, labels, ["quality"], 5, limit=20_000)
    assert 1 < len(cut) < len(whole) and cut == whole[: len(cut)] and sum(len(t) for t, _ in cut) <= 20_000
    kept = {r.text.encode() for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    assert {t for t, _ in got} <= kept
