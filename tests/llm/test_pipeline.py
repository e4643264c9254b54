import itertools
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_jaccard import sets_of
from winnow.llm import labelled, quality, secrets


def test_stages_one_by_one(spark, sf):
    """Each stage's result on its own input, against plain Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    rows = docs.collect()

    kept = stage["quality"](spark, docs, sf).collect()
    model = quality.train(labelled.sample(docs, spark.read.parquet(f"{sf}/labels.parquet"), ["quality"], 5))
    p = quality.score_texts([r.text.encode() for r in rows], quality.Words(model), model)
    assert Counter(kept) == Counter(r for r, x in zip(rows, p, strict=True) if x >= 0.3)

    left = stage["near_copies"](spark, docs, sf).collect()
    sets = {r.doc_id: sets_of(r.text, 5) for r in rows}
    near = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    ids = [r.doc_id for r in left]
    assert not any(near(sets[a], sets[b]) for i, a in enumerate(ids) for b in ids[:i])
    group = {r.doc_id: {r.doc_id} for r in rows}
    for a in sets:
        for b in sets:
            if a < b and near(sets[a], sets[b]) and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
    assert Counter(min(group[i]) for i in ids) == Counter({min(g) for g in group.values()})

    hidden = F.concat("text", F.lit(' token = "'), F.sha1(F.col("doc_id").cast("string")), F.lit('"'))
    guarded = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, hidden).otherwise(F.col("text")))
    rows = guarded.collect()
    clean = stage["secrets"](spark, guarded, sf).collect()
    assert len(clean) == len(rows) and all(r.n_chars == len(r.text) for r in clean if r.doc_id % 10 == 0)
    found = re.compile(r'token = "([0-9a-f]{40})"')
    before, after = ({r.doc_id: r.text for r in x} for x in (rows, clean))
    assert sum(bool(found.search(t)) for t in before.values()) == 20 and not any(found.search(t) for t in after.values())
    assert all(after[i] == t for i, t in before.items() if not re.search(secrets.CANDIDATE, t))

    rows = docs.collect()
    mixed = stage["mixing"](spark, docs, sf).collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows}
    times = Counter(r.doc_id for r in mixed)
    assert max(times.values()) <= 2 and abs(sum(size[i] * n for i, n in times.items()) / sum(size.values()) - 1.5) < 0.1

    packed = stage["packing"](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == set(sets)


def test_near_copies_by_five_words_and_four_fifths(spark, docs, sf):
    base = [f"w{i}" for i in range(200)]
    edited = ["other" if i in (40, 80, 120, 160) else w for i, w in enumerate(base)]
    longer = [f"v{i}" for i in range(200)]
    apart = [f"u{i}" for i in range(200)]
    rows = [(1, base, 1), (2, edited, 1), (3, longer, 2), (4, longer + [f"x{i}" for i in range(35)], 2), (5, apart, 3), (6, apart + [f"y{i}" for i in range(60)], 4)]
    five = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    for (_, a, g), (_, b, h) in itertools.combinations(rows, 2):
        assert (100 * len(five(a) & five(b)) >= 80 * len(five(a) | five(b))) == (g == h)
    left = dict(corpus_pipeline.STAGES)["near_copies"](spark, docs([(i, " ".join(t), "s") for i, t, _ in rows]), sf).collect()
    assert sorted(g for i, _, g in rows for r in left if r.doc_id == i) == [1, 2, 3, 4]


def test_rows_that_differ_in_nulls_alone(spark, docs, sf):
    """A null and a text that change places make another row; no stage takes one for the other."""
    one = docs([(1, "a b c d e f g", "a")]).withColumn("lang", F.lit(None).cast("string"))
    other = docs([(1, "a b c d e f g", None)]).withColumn("lang", F.lit("a"))
    rows = one.unionByName(other)
    assert corpus_pipeline.with_key(rows).select("key").distinct().count() == 2
    mixed = Counter(dict(corpus_pipeline.STAGES)["mixing"](spark, rows, sf).collect())
    assert set(mixed) <= set(rows.collect()) and max(mixed.values()) <= 2 and len(mixed) == 2
    assert dict(corpus_pipeline.STAGES)["near_copies"](spark, rows, sf).count() == 1


def test_copies_leave_by_either_join(spark, docs, sf, monkeypatch):
    rows = docs([(i, f"t{i % 7} b c d e f g", "s") for i in range(20)] + [(0, "t0 b c d e f g", "s")])
    stage = dict(corpus_pipeline.STAGES)["near_copies"]
    sent = stage(spark, rows, sf).collect()
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_ROWS", 0)
    assert Counter(sent) == Counter(stage(spark, rows, sf).collect()) and len({r.text for r in sent}) == len(sent) == 7


def test_readings_stand_apart(spark, docs, sf):
    """The second epoch of a source follows the first."""
    rows = docs([(i, f"t{i} b c d", "s0") for i in range(20)])
    out = [r.doc_id for r in dict(corpus_pipeline.STAGES)["mixing"](spark, rows, sf).collect()]
    assert len(out) == 30 and set(out) == set(range(20))
    assert len(set(out[:20])) == 20 and out[20:] == out[:10]


def test_whole_run(spark, sf):
    docs = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and {r.doc_id for r in rows} <= docs
    assert Counter(r.sequence_id for r in rows) and max(r.offset + r.length for r in rows) <= 2048


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, odd, docs, sf, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd, sf)
    n = out.count()
    assert n > 0
    if name != "packing":
        assert set(out.columns) == set(odd.columns)
    assert stage(spark, docs([]), sf).count() == 0
    if name == "near_copies":
        # four rows with equal text are one; the others stand alone
        assert n == odd.count() - 2


def test_columns_of_any_name_come_through(spark, docs, sf):
    """Columns named as a stage might name its own, with their values."""
    rows = [(i, f"row {i} of text " + " ".join(f"w{i}x{j}" for j in range(40)) + f' token = "{i:040x}"', "ab"[i % 2]) for i in range(1, 30)]
    df = docs(rows)
    names = ("_row", "_position", "_winnow_pieces", "_winnow_text", "_winnow_found", "_winnow_changed", "row", "key", "pieces", "found", "changed", "position", "n", "first", "block", "file", "at")
    for n in names:
        df = df.withColumn(n, F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, sf)
        assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString()
        got = out.collect()
        assert name == "quality" or got
        assert all(r[n] == f"{n} {r.doc_id}" for r in got for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, df, sf).count()


def test_sequences_follow_the_schedule(spark, sf, tmp_path):
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = f"file://{tmp_path}/mixed"
    stage["mixing"](spark, docs, sf).write.parquet(at)
    mixed = spark.read.parquet(at)
    own = mixed.metadataColumn("_metadata")
    order = [r.doc_id for r in mixed.select("doc_id", own["file_name"].alias("f"), own["row_index"].alias("i")).orderBy("f", "i").collect()]
    assert max(Counter(order).values()) == 2
    pieces = stage["packing"](spark, mixed, sf).orderBy("sequence_id", "offset").collect()
    starts = [p.doc_id for p in pieces if p.start == 0]
    assert Counter(starts) == Counter(order)
    # each reading is packed within a block of rows of its place in the schedule
    step = len(order) // 16 + 1
    places = {i: [n for n, x in enumerate(order) if x == i] for i in set(order)}
    for i, where in places.items():
        assert all(abs(a - b) <= 2 * step for a, b in zip(where, [n for n, x in enumerate(starts) if x == i], strict=True))
    # no sequence holds two readings of a document
    held = {}
    for p in pieces:
        held.setdefault(p.sequence_id, []).append((p.doc_id, p.start))
    begun = Counter()
    for s in sorted(held):
        mine = [i for i, start in held[s] if start == 0]
        assert len(mine) == len(set(mine))
        begun.update(mine)
