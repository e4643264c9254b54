"""The tree of files as a source with filters and as a sink that is all or nothing."""

import os

import pytest
from pyspark.sql import functions as F

from winnow.sources import filetree, pushed, treewriter


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    filetree.register(spark)
    root = tmp_path_factory.mktemp("tree") / "t"
    for i in range(60):
        p = root / ("hot" if i % 3 else f"few{i % 4}/deep/er") / f"{i:02}.txt"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x" * (i * 10))
    (root / ".hidden").mkdir()
    (root / ".hidden/no.txt").write_text("n")
    (root / "hot/.gitignore").write_text("out\n*7.txt\n")
    (root / "hot/out/sub").mkdir(parents=True)
    (root / "hot/out/sub/x.txt").write_text("x")
    return root


def scan(spark, root, **options):
    return spark.read.format("winnow_files").options(path=str(root), **options).load()


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_any_partitions_give_the_same_rows(spark, tree):
    want = rows(scan(spark, tree))
    paths = [r[0] for r in want]
    assert len(set(paths)) == len(paths) and "hot/01.txt" in paths and "few0/deep/er/00.txt" in paths
    assert not [p for p in paths if p.startswith("hot/out") or p in ("hot/07.txt", ".hidden/no.txt")] and ".hidden" in paths
    for options in ({"partitionFiles": 3}, {"partitionBytes": 5_000, "plannedEntries": 7}, {"plannedEntries": 0}):
        assert rows(scan(spark, tree, **options)) == want, options


def test_a_full_folder_is_many_partitions(spark, tree):
    each = scan(spark, tree, partitionFiles=5).where("kind = 'file'").groupBy(F.spark_partition_id()).count().collect()
    assert len(each) >= 10 and max(r[1] for r in each) <= 5


FILTERS = ["kind = 'file'", "kind = 'directory'", "path LIKE 'hot/%'", "path LIKE 'few0/d%'", "path = 'few0/deep/er/00.txt'", "path IN ('hot/01.txt', 'few1/deep/er/09.txt', 'none')", "parent = 'hot'", "parent = ''", "parent LIKE 'few0%'", "depth <= 2", "depth < 2", "depth = 4", "depth > 3", "bytes > 300 AND bytes <= 400", "bytes IS NULL", "reason IS NULL", "reason IS NOT NULL", "NOT path = 'hot/01.txt'", "path LIKE '%1.txt' AND kind = 'file'", "path LIKE '%deep%'", "reason <> 'vcs'", "status = 'ok'", "kind = 'file' AND (depth = 2 OR bytes = 0)"]


@pytest.fixture(scope="module")
def whole(spark, tree):
    return spark.createDataFrame(scan(spark, tree).collect(), filetree.SCHEMA).coalesce(1).cache()


@pytest.mark.parametrize("i", range(len(FILTERS)))
def test_filters_keep_the_same_rows(spark, tree, whole, i):
    options = {"plannedEntries": 1} if i % 2 else {}
    assert rows(scan(spark, tree, **options).where(FILTERS[i])) == rows(whole.where(FILTERS[i]))


def test_what_is_ruled_out_is_not_read(spark, tree):
    reader = filetree.Reader({"path": str(tree)})
    from pyspark.sql.datasource import EqualTo, LessThan, Not, StringStartsWith

    given = [StringStartsWith(("path",), "few0/"), LessThan(("bytes",), 100), EqualTo(("status",), "ok"), Not(EqualTo(("kind",), "directory"))]
    assert list(reader.pushFilters(given)) == given[1:3]
    opened = []
    before, filetree.read_file = filetree.read_file, lambda root, path: opened.append(path) or ("ok", "", "", 0)
    listed, real = [], filetree.listing
    filetree.listing = lambda root, folder, *a: listed.append(folder) or real(root, folder, *a)
    try:
        for p in reader.partitions():
            list(reader.read(p))
    finally:
        filetree.read_file, filetree.listing = before, real
    assert opened == ["few0/deep/er/00.txt"] and not [f for f in listed if f[:3] == "hot" or f[:4] in ("few1", "few2", "few3")]
    plan = scan(spark, tree).where("kind = 'file' AND sha256 = 'x'")._jdf.queryExecution().executedPlan().toString()
    assert "sha256" in plan.split("Filter")[1].split("\n")[0] and "kind" not in plan.split("Filter")[1].split("\n")[0]


def test_nulls_in_filters():
    from pyspark.sql.datasource import EqualTo, In, IsNull, Not

    eq = EqualTo(("reason",), "vcs")
    assert pushed.holds(eq, None) is None and pushed.holds(Not(eq), None) is None and pushed.holds(Not(eq), "hidden") is True
    assert pushed.holds(In(("reason",), ("a", None)), "b") is None and pushed.holds(IsNull(("reason",)), None) is True
    assert not pushed.Pushed([Not(eq)]).keeps(reason=None) and pushed.column(EqualTo(("text",), "x")) is None


def write(df, root, mode="append"):
    df.write.format("winnow_files").mode(mode).save(str(root))


def left(folder):
    return sorted(os.listdir(folder))


def test_a_tree_is_written_and_read_again(spark, tmp_path):
    filetree.register(spark)
    texts = {"a/b/é.txt": "é\n", "a/c.txt": "", "d.txt": "x" * 100_000, "a/b/n.txt": None}
    df = spark.createDataFrame([*texts.items(), ("a/c.txt", "")], "path string, text string").repartition(4)
    write(df, tmp_path / "out")
    got = {r.path: r.text for r in scan(spark, tmp_path / "out").where("kind = 'file'").collect()}
    assert got == {p: t or "" for p, t in texts.items()} and left(tmp_path) == ["out"]
    # not a second time, but in its place
    with pytest.raises(Exception, match="FileExistsError"):
        write(df, tmp_path / "out")
    write(spark.createDataFrame([("z", bytearray(b"\xff"))], "path string, text binary"), tmp_path / "out", "overwrite")
    assert {r.path: r.status for r in scan(spark, tmp_path / "out").collect()} == {"z": "encoding"} and left(tmp_path) == ["out"]
    write(df.limit(0), f"file://{tmp_path}/none")
    assert left(tmp_path / "none") == [] and scan(spark, tmp_path / "none").count() == 0


@pytest.mark.parametrize("bad", ["/abs", "../up", "a/../b", "", None, "a//b", "./a", "clash", "a"])
def test_a_write_that_fails_leaves_nothing(spark, tmp_path, bad):
    filetree.register(spark)
    old = tmp_path / "out"
    old.mkdir()
    (old / "old.txt").write_text("old")
    df = spark.createDataFrame([("a/x", "1"), ("clash", "one"), (bad, "two"), ("y", "2")], "path string, text string").coalesce(1)
    for root, mode in ((tmp_path / "new", "append"), (old, "overwrite")):
        with pytest.raises(Exception, match="ValueError|FileExistsError|IsADirectoryError"):
            write(df, root, mode)
    assert left(tmp_path) == ["out"] and left(old) == ["old.txt"]


def test_a_tree_is_removed_in_tasks(spark, tmp_path, monkeypatch):
    """The driver is left the folders and what the scan does not list, not the files."""
    filetree.register(spark)
    (tmp_path / "t/a/b").mkdir(parents=True)
    for i in range(30):
        (tmp_path / f"t/a/b/{i}").write_text("x")
    (tmp_path / "t/.hidden").write_text("x")
    (tmp_path / "t/.ignore").write_text("*9")
    (tmp_path / "kept").write_text("kept")
    (tmp_path / "t/a/link").symlink_to(tmp_path / "kept")
    seen, delete = [], treewriter.store.delete
    monkeypatch.setattr(treewriter.store, "delete", lambda s, p: seen.extend(f for *_, fs in os.walk(tmp_path / "t") for f in fs) or delete(s, p))
    treewriter.remove(spark, f"file://{tmp_path}/t")
    assert sorted(seen) == ["19", "29", "9"] and left(tmp_path) == ["kept"]
    treewriter.remove(spark, f"file://{tmp_path}/none")


def test_a_task_runs_twice_and_another_tree_comes_first(tmp_path):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("path string, text string")
    writer = treewriter.TreeWriter({"path": str(tmp_path / "t")}, schema, False)
    part = [{"path": "a/1", "text": "one"}, {"path": "2", "text": "two"}]
    first, again = writer.write(iter(part)), writer.write(iter(part))
    assert (first.files, first.bytes, again.files) == (2, 6, 0) and not (tmp_path / "t").exists()
    other = treewriter.TreeWriter({"path": str(tmp_path / "t")}, schema, False)
    other.write(iter([{"path": "other", "text": ""}]))
    other.commit([])
    with pytest.raises(OSError):
        writer.commit([first])
    writer.abort([first])
    assert left(tmp_path) == ["t"] and left(tmp_path / "t") == ["other"]
    with pytest.raises(ValueError):
        treewriter.TreeWriter({"path": "hdfs://x/y"}, schema, False)
    with pytest.raises(ValueError):
        treewriter.TreeWriter({"path": "/x"}, StructType.fromDDL("path string, text string, more int"), False)
