import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from winnow.llm import ctw, scoring


def normalized(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def brute_base(rows, folds):
    held = [i is not None and zlib.crc32(str(i).encode()) % folds == 0 for i, _ in rows]
    tokens = [[*normalized(t), "\n"] for _, t in rows]
    c = Counter(w for h, ws in zip(held, tokens, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return held, n, [(len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for ws in tokens]


def brute_tree(train, texts):
    """Context-tree weighting straight from its definition: every context and node in a dict."""
    D = ctw.DEPTH
    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)

    def walk(data):
        data = b"\n" * D + data
        for i in range(D, len(data)):
            node = 1
            for j in range(7, -1, -1):
                yield data[i - D : i], node, data[i] >> j & 1
                node = node * 2 + (data[i] >> j & 1)

    for t in train:
        for ctx, node, bit in walk(t):
            for d in range(D + 1):
                counts[ctx[D - d :], node][bit] += 1
                if d:
                    children[ctx[D - d + 1 :], node].add(ctx[D - d :])
    weighted = {}

    def pe(c):
        return math.lgamma(c[0] + 0.5) + math.lgamma(c[1] + 0.5) - math.lgamma(sum(c) + 1) - math.log(math.pi)

    for s, node in sorted(counts, key=lambda k: -len(k[0])):
        e = pe(counts[s, node])
        weighted[s, node] = e if len(s) == D else math.log(0.5) + np.logaddexp(e, sum(weighted[x, node] for x in children[s, node]))

    def predict(ctx, node, d=0):
        s = ctx[D - d :]
        if (s, node) not in counts:
            return 0.5
        c = counts[s, node]
        kt = (c[1] + 0.5) / (sum(c) + 1)
        if d == D:
            return kt
        q = math.exp(math.log(0.5) + pe(c) - weighted[s, node])
        return q * kt + (1 - q) * predict(ctx, node, d + 1)

    out = []
    for t in texts:
        total = 0.0
        for ctx, node, bit in walk(t):
            p = predict(ctx, node)
            total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


def test_log_gamma():
    z = np.array([0.5, 1, 1.5, 2, 10, 1e3, 1e7, 1e12])
    assert np.allclose(ctw.log_gamma(z), [math.lgamma(x) for x in z], rtol=1e-12, atol=1e-11)


@pytest.mark.parametrize("limit", [scoring.COMMON, 40, 0])
def test_scores_are_those_of_the_definition(docs, limit):
    rng = np.random.default_rng(5)
    syllables = ["th", "er", "ä", "On", "x", "!", "and "]
    rows = [(i, " ".join("".join(rng.choice(syllables, 3)) for _ in range(rng.integers(0, 14))), "s") for i in range(60)]
    rows += [(100, None, "s"), (101, "", "s"), (None, "The THE the", "s"), (3, "twice", "s"), (3, "twice", "s"), (102, "\x00\x7f漢字", None)]
    got = {}
    for r in scoring.score(docs(rows, extra=True), common_limit=limit).collect():
        got.setdefault((r.doc_id, r.n_tokens, round(r.base_score, 6)), []).append(r)
    held, n, base = brute_base([(i, t) for i, t, _ in rows], 10)
    data = [(" ".join(normalized(t)) + "\n").encode() for _, t, _ in rows]
    tree = brute_tree([d for d, h in zip(data, held, strict=True) if not h], data)
    assert sum(map(len, got.values())) == len(rows)
    for (i, _, _), h, (tokens, known, b), t, d in zip(rows, held, base, tree, data, strict=True):
        r = next(x for x in got[i, tokens, round(b, 6)] if abs(x.score - t) < 1e-6)
        assert (r.held_out, r.n_known, r.train_tokens) == (h, known, n)
        assert abs(r.bits_per_byte + t / math.log10(2) / len(d)) < 1e-6


def test_model_beats_the_base_on_held_out_documents(spark):
    rows = [r for r in scoring.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect()]
    assert len(rows) == 10_000
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(odd, empty):
    rows = scoring.score(odd).collect()
    assert len(rows) == odd.count() and all(r.score < 0 and r.n_tokens >= 1 for r in rows)
    assert scoring.score(empty).collect() == []
    lone = scoring.score(odd.where("doc_id = 1").limit(1), folds=1).collect()  # all held out
    assert lone[0].n_known == 0 and abs(lone[0].score - lone[0].n_tokens * 0 - 8 * 14 * math.log10(0.5)) < 1e-9
