import random

import pytest
import xxhash

from winnow.llm import simhash


def brute_print(text, words=3):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    grams = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_roots(prints):
    """The least print of each one's component."""
    left, out = set(prints), {}
    for p in sorted(left):
        if p in out:
            continue
        todo = [p]
        out[p] = p
        while todo:
            x = todo.pop()
            for y in left:
                if y not in out and (x ^ y).bit_count() <= 2:
                    out[y] = p
                    todo.append(y)
    return out


def signed(p):
    return p - (1 << 64) if p >> 63 else p


@pytest.mark.parametrize("full", [3, 32])
def test_every_link_and_no_other(spark, monkeypatch, full):
    """Crowds around centres, in either segment, and chains two bits a step."""
    monkeypatch.setattr(simhash, "FULL", full)
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for centre in list(prints)[:3]:
        for _ in range(90):
            flips = rng.sample(range(32) if rng.random() < 0.4 else range(32, 64) if rng.random() < 0.5 else range(64), rng.randint(1, 4))
            prints.add(centre ^ sum(1 << b for b in flips))
    chain = rng.getrandbits(64)
    for b in range(0, 40, 2):
        chain ^= 3 << b
        prints.add(chain)
    prints |= {0, 1, 3 << 62, (1 << 64) - 1, 1 << 63}
    df = spark.createDataFrame([(signed(p),) for p in prints], "print long")
    roots = {r.node: r.root for r in simhash.connected(simhash.links(df)).collect()}
    want, groups = brute_roots(prints), {}
    for p in prints:
        groups.setdefault(roots.get(signed(p), signed(p)), set()).add(p)
    wanted = {}
    for p, r in want.items():
        wanted.setdefault(r, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_rows_of_a_crowded_cell_grow_with_its_members(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FULL", 8)
    counts = []
    for n in (500, 2_000):
        rng = random.Random(n)
        df = spark.createDataFrame([(signed(5 << 32 | rng.getrandbits(32)),) for _ in range(n)], "print long")
        edges = simhash.links(df)
        counts.append(edges.count() / n)
    assert counts[1] < 2 * counts[0] + 5


def test_documents(spark, docs):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(vocabulary, k=300)) for _ in range(6)]
    rows = [(100 + i, t, "a") for i, t in enumerate(base)]
    rows += [(200 + i, f"{base[i % 6]} extra{i}", "b") for i in range(12)] + [(50, base[2].upper(), "a"), (51, base[2].replace(" ", " \n\t"), None)]
    rows += [(1, "Ein Wort", None), (2, "ein\vwort", "x"), (3, "ÄRGER ärger", "x")]
    got = [tuple(r) for r in simhash.components(docs(rows, extra=True)).collect()]
    prints = {i: brute_print(t) for i, t, _ in rows}
    roots = brute_roots(prints.values())
    least = {}
    for i, p in prints.items():
        least[roots[p]] = min(least.get(roots[p], i), i)
    assert sorted(got) == sorted((i, f"{p:016x}", least[roots[p]]) for i, p in prints.items())


def test_odd_rows(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(simhash, "HELD", 1_000)
    got = [tuple(r) for r in simhash.components(odd).collect()]
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(f for _, f, _ in got) == sorted(f"{brute_print(t):016x}" for _, t in rows)
    zero = [r for r in got if r[1] == "0" * 16]
    assert len(zero) == 4 and {c for _, _, c in zero} == {2}
    assert [c for i, f, c in got if f == f"{brute_print('null id'):016x}"] == [None]
    assert sum(c == 1 for _, _, c in got) == 3
    assert simhash.components(empty).collect() == []
