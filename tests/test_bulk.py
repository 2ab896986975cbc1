"""Bundles and tables published in bulk, the walk of large trees, and merged user code."""

import hashlib
import json
import struct
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tabletrail import ArtifactError
from tabletrail.operators import summaries, usercode
from tabletrail.sinks import manifests
from tabletrail.sources import storage
from tabletrail.sources.storage import walk
from test_project import Tree


@pytest.fixture
def tree(spark, tmp_path):
    return Tree(spark, tmp_path)


def files(spark, names, text="text of "):
    return spark.createDataFrame([(n, text + n) for n in names], "filename string, content string")


def named(tree, unit="figure"):
    return {r.filename: r.size for r in tree.project.bundle_files("nb", unit).collect()}


def in_place(tree, unit="figure"):
    folder = tree.root / f"data/preserved/nb/{unit}"
    return sorted(p.name for p in folder.iterdir() if p.is_file() and p.name != "manifest.json" and not p.name.endswith(".crc"))


def test_bulk_files_accumulate_and_manifest_stays_small(tree, spark):
    unit = tree.units["figure"]
    tree.project.preserve_files(files(spark, [f"f{i}.txt" for i in range(30)]), "figure", producer=unit)
    tree.project.preserve_file("note", "figure", filename="note.txt", producer=unit)
    tree.project.preserve_files(files(spark, ["f3.txt", "new.txt"], "other "), "figure", producer=unit)
    manifest = tree.manifest("data/preserved/nb/figure/manifest.json")
    assert [o["filename"] for o in manifest["outputs"]] == ["note.txt"] and manifest["bulk"]["files"] == 31
    assert in_place(tree) == sorted([f"f{i}.txt" for i in range(30)] + ["note.txt", "new.txt"]) == sorted(named(tree))
    assert (tree.root / "data/preserved/nb/figure/f3.txt").read_text() == "other f3.txt"
    assert tree.problems() == [] and not list(tree.root.rglob("*.drafts"))
    assert [r["n_files"] for r in tree.project.list_preserved("nb").collect()] == [32]


def test_same_bulk_files_change_nothing(tree, spark):
    some = files(spark, ["a.txt", "b.txt"])
    tree.project.preserve_files(some, "figure", producer=tree.units["figure"])
    before = tree.snapshot()
    tree.project.preserve_files(some.repartition(3), "figure", producer=tree.units["figure"])
    assert tree.snapshot() == before
    # A damaged file is written again, though its record is the same.
    (tree.root / "data/preserved/nb/figure/a.txt").write_text("texT of a.txt")
    assert len(tree.problems()) == 1
    tree.project.preserve_files(some, "figure", producer=tree.units["figure"])
    assert tree.problems() == [] and (tree.root / "data/preserved/nb/figure/a.txt").read_text() == "text of a.txt"


def test_changed_code_replaces_a_bulk_bundle(tree, spark):
    unit = tree.units["figure"]
    tree.project.preserve_file("old", "figure", filename="old.txt", producer=unit)
    tree.project.preserve_table(spark.range(3), "figure", producer=unit, filename="t")
    tree.project.preserve_files(files(spark, ["a.txt", "b.txt"]), "figure", producer=unit)
    changed = replace(unit, code=unit.code + "\n    pass")
    tree.project.preserve_files(files(spark, ["b.txt", "c.txt"]), "figure", producer=changed)
    assert in_place(tree) == ["b.txt", "c.txt"] == sorted(named(tree))
    again = replace(unit, code=unit.code + "\n    pass\n    pass")
    tree.project.preserve_file("x", "figure", filename="only.txt", producer=again)
    assert in_place(tree) == ["only.txt"] and not list(tree.root.rglob("*.ledger"))


def test_a_name_belongs_to_the_last_call(tree, spark):
    unit = tree.units["figure"]
    tree.project.preserve_file("single", "figure", filename="a.txt", producer=unit)
    tree.project.preserve_files(files(spark, ["a.txt", "b.txt"]), "figure", producer=unit)
    assert named(tree) == {"a.txt": 13, "b.txt": 13} and tree.problems() == []
    tree.project.preserve_file("single", "figure", filename="b.txt", producer=unit)
    assert named(tree) == {"a.txt": 13, "b.txt": 6} and tree.problems() == []
    with pytest.raises(ArtifactError, match="two files"):
        tree.project.preserve_files(files(spark, ["x", "x"]), "figure", producer=unit)


def test_damage_to_bulk_files_is_named(tree, spark):
    tree.project.preserve_files(files(spark, ["a.txt", "b.txt", "c.txt"]), "figure", producer=tree.units["figure"])
    folder = tree.root / "data/preserved/nb/figure"
    (folder / "a.txt").unlink()
    (folder / "b.txt").write_text("text of B.txt")
    (folder / "stray.txt").write_text("")
    found = {(a, m) for a, _, m in tree.problems()}
    assert found == {
        ("nb/figure", "a.txt: missing"), ("nb/figure", "b.txt: content changed since it was written"),
        ("data/preserved/nb/figure/stray.txt", "no manifest records this file; preserve_*() did not write it"),
    }


def test_a_call_that_ended_after_its_manifest_is_finished(tree, spark, monkeypatch):
    from tabletrail.sinks import bundles

    unit = tree.units["figure"]
    tree.project.preserve_files(files(spark, ["a.txt"]), "figure", producer=unit)
    with monkeypatch.context() as patch:
        patch.setattr(bundles, "settle", lambda *_: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError, match="stopped"):
            tree.project.preserve_files(files(spark, ["a.txt", "b.txt"], "newer "), "figure", producer=unit)
    assert (tree.root / "data/preserved/nb/figure/a.txt").read_text() == "text of a.txt"
    tree.project.preserve_file("x", "figure", filename="x.txt", producer=unit)
    assert (tree.root / "data/preserved/nb/figure/a.txt").read_text() == "newer a.txt" and tree.problems() == []


# --- many tables ----------------------------------------------------------------


def many(spark, groups=7, rows=200):
    columns = ["concat('t-', id % {0}) AS name", "id", "cast(id AS string) AS text", "IF(id % 5 = 0, NULL, id / 3) AS x", "date_add(DATE'2020-01-01', cast(id % 9 AS int)) AS day"]
    return spark.range(rows).selectExpr(*[c.format(groups) for c in columns])


def test_many_tables_are_as_one_by_one(tree, spark):
    rows = many(spark)
    done = tree.project.save_shared_many(rows, "name", inputs=[], producer=tree.units["ranked"], rows_per_file=10)
    assert {(r.name, r.rows, r.files > 1, r.written) for r in done.collect()} == {(f"t-{i}", 29 if i < 4 else 28, True, True) for i in range(7)}
    assert tree.problems() == [] and tree.project.list_shared().count() == 7
    manifest = tree.manifest("data/shared/t-3.manifest.json")
    third = rows.filter("name = 't-3'").drop("name")
    loaded = tree.project.load_shared("t-3")
    assert loaded.dtypes == third.dtypes and loaded.exceptAll(third).isEmpty() and third.exceptAll(loaded).isEmpty()
    # The same table published alone has the same content identity, and counts as unchanged.
    before = tree.manifest("data/shared/t-3.manifest.json")["outputs"][0]
    tree.project.save_shared(third, "t-3", inputs=[], producer=tree.units["ranked"])
    assert tree.manifest("data/shared/t-3.manifest.json")["outputs"][0] == before == manifest["outputs"][0]


def test_many_tables_again(tree, spark):
    unit = tree.units["ranked"]
    tree.project.save_shared_many(many(spark), "name", inputs=[], producer=unit)
    before = tree.snapshot()
    again = tree.project.save_shared_many(many(spark).repartition(5), "name", inputs=[], producer=unit)
    assert not again.filter("written").count() and tree.snapshot() == before
    edited = many(spark).withColumn("text", F.when(F.col("name") == "t-2", F.lit("edited")).otherwise(F.col("text")))
    changed = tree.project.save_shared_many(edited, "name", inputs=[], producer=unit)
    assert [r.name for r in changed.filter("written").collect()] == ["t-2"] and tree.problems() == []
    assert tree.project.load_shared("t-2").filter("text = 'edited'").count() == 29
    # A lost part file makes an equal table count as changed.
    next(tree.root.glob("data/shared/t-5.parquet/*/part-*.parquet")).unlink()
    repaired = tree.project.save_shared_many(edited, "name", inputs=[], producer=unit)
    assert "t-5" in [r.name for r in repaired.filter("written").collect()] and tree.problems() == []


def test_many_tables_refusals(tree, spark):
    for bad in ("a/b", None, ".x", "t.parquet"):
        with pytest.raises(ArtifactError, match="table name"):
            tree.project.save_shared_many(spark.createDataFrame([(bad, 1)], "name string, x int"), "name", inputs=[], producer=tree.units["ranked"])
    nothing = many(spark).limit(0)
    assert tree.project.save_shared_many(nothing, "name", inputs=[], producer=tree.units["ranked"]).count() == 0


# --- walks ---------------------------------------------------------------------------


def test_deep_and_wide_trees(spark, tmp_path):
    deep = tmp_path / "x" / Path(*[f"d{i}" for i in range(60)])
    deep.mkdir(parents=True)
    want = {}
    for level, folder in enumerate([tmp_path / "x", *[p for p in deep.parents if len(str(p)) > len(str(tmp_path / "x"))], deep]):
        for i in range(level % 3):
            (folder / f"f{i}").write_text("x" * level)
            want[str((folder / f"f{i}").relative_to(tmp_path))] = level
    for i in range(40):
        (tmp_path / "x" / "wide" / str(i)).mkdir(parents=True)
        (tmp_path / "x" / "wide" / str(i) / ".hidden").write_text("")
        want[f"x/wide/{i}/.hidden"] = 0
    for bound in (1, 7, 20_000):
        assert {r.path: r.size for r in walk(spark, str(tmp_path), ["x"], bound=bound).collect()} == want
    assert walk(spark, str(tmp_path), ["absent"]).count() == 0


def test_no_task_lists_more_than_its_bound(spark, tmp_path, monkeypatch):
    rounds = []
    original = storage.staged
    monkeypatch.setattr(storage, "staged", lambda df: rounds.append(1) or original(df))
    for i in range(30):
        (tmp_path / "x" / str(i)).mkdir(parents=True)
        (tmp_path / "x" / str(i) / "f").write_text("")
    assert walk(spark, str(tmp_path), ["x"]).count() == 30 and len(rounds) == 1
    rounds.clear()
    assert walk(spark, str(tmp_path), ["x"], bound=10).count() == 30 and len(rounds) > 1


# --- user code over groups, one record per key ----------------------------------------------


def test_reduced_groups_match_whole_groups(spark):
    # One key holds most rows; a key is missing.
    rows = spark.range(20_000).selectExpr("IF(id % 3 = 0, 'hot', IF(id % 7 = 0, NULL, concat('k', id % 40))) AS g", "cast(id % 5 AS int) AS h", "id * 0.5D AS v").repartition(9)

    def partial(part):
        return struct.pack("qd", len(part), part["v"].sum())

    def merge(a, b):
        (n, x), (m, y) = struct.unpack("qd", a), struct.unpack("qd", b)
        return struct.pack("qd", n + m, x + y)

    def finish(state):
        n, total = struct.unpack("qd", state)
        return n, total / n

    got = usercode.reduce_groups(rows, ["g", "h"], partial, merge, finish, "n bigint, mean double")
    want = rows.groupBy("g", "h").agg(F.count("v").alias("n"), F.avg("v").alias("mean"))
    assert sorted(map(str, got.select("g", "h", "n", F.round("mean", 6)).collect())) == sorted(map(str, want.select("g", "h", "n", F.round("mean", 6).alias("round(mean, 6)")).collect()))
    joined = usercode.with_group_results(rows, ["g"], partial, merge, finish, "n bigint, mean double")
    assert joined.count() == 20_000 and joined.filter("n is null").count() == 0
    assert usercode.reduce_groups(rows.limit(0), ["g"], partial, merge, finish, "n bigint, mean double").count() == 0


def test_one_record_per_key_sorts_no_raw_rows(spark):
    rows = spark.range(1000).selectExpr("id % 10 AS k", "IF(id % 4 = 0, NULL, id % 7) AS a", "id AS b", "cast(id AS string) AS s")
    latest = summaries.last_wins(rows, "k", ["a", "b"])
    earliest = summaries.first_match(rows, "k", ["a", "b"])
    data = [tuple(r) for r in rows.collect()]
    order = lambda r: (r[1] is not None, r[1] or 0, r[2])
    assert sorted(map(tuple, latest.collect())) == sorted(max((r for r in data if r[0] == k), key=order) for k in range(10))
    assert sorted(map(tuple, earliest.collect())) == sorted(min((r for r in data if r[0] == k), key=order) for k in range(10))
    ties = spark.createDataFrame([(1, 5, "x"), (1, 5, "y"), (2, None, "z")], "k int, a int, s string")
    assert summaries.last_wins(ties, "k", "a").count() == 2


# --- chunks ------------------------------------------------------------------------


def test_damaged_ranges_of_large_files(spark, tmp_path):
    from tabletrail.sources import chunks

    (tmp_path / "big").write_bytes(bytes(i % 251 for i in range(70_001)))
    (tmp_path / "same").write_bytes(b"x" * 40_000)
    (tmp_path / "small").write_bytes(b"y" * 50)
    (tmp_path / "gone").write_bytes(b"z" * 300)
    (tmp_path / "grown").write_bytes(b"w" * 200)

    def state():
        listed = storage.staged(walk(spark, str(tmp_path), ["."]).select(F.regexp_replace("path", r"^\./", "").alias("path"), "size"))
        found = chunks.chunk_digests(listed, str(tmp_path), 100)
        return found, chunks.chunk_tree(found)

    recorded, tree = state()
    assert tree.agg(F.max("level")).first()[0] == 2 and chunks.roots(tree).count() == 5
    assert recorded.filter("path = 'big'").count() == 701
    assert chunks.damaged_ranges(recorded, tree, recorded, tree).count() == 0
    data = bytearray((tmp_path / "big").read_bytes())
    for at in (0, 33_333, 33_450, 70_000):
        data[at] ^= 1
    (tmp_path / "big").write_bytes(data)
    (tmp_path / "gone").unlink()
    (tmp_path / "grown").write_bytes(b"w" * 350)
    found = chunks.damaged_ranges(recorded, tree, *state()).collect()
    assert {tuple(r) for r in found} == {("big", 0, 100), ("big", 33_300, 200), ("big", 70_000, 1), ("gone", 0, 300), ("grown", 200, 150)}


def test_damaged_range_of_a_shared_table(tree, spark):
    p = tree.project
    table = spark.range(30_000).selectExpr("id", "uuid() AS u").coalesce(1)
    p.save_shared(table, "t", inputs=[], producer=tree.units["ranked"])
    p.save_chunks("t", producer=tree.units["ranked"], chunk=4096)
    assert p.damaged_ranges("t").count() == 0
    part = next((tree.root / "data/shared/t.parquet").glob("*/part-*"))
    data = bytearray(part.read_bytes())
    data[100_000] ^= 255
    part.write_bytes(data)
    found = p.damaged_ranges("t").collect()
    assert [(r.start, r.length) for r in found] == [(100_000 // 4096 * 4096, 4096)]


def test_files_are_drafts_of_their_task(spark, tmp_path, monkeypatch):
    """Files are created in a folder of the task, which goes; their own folder sees whole files only."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "7").write_text("text 7")
    documents = spark.range(40).selectExpr("concat('in/', id) AS path", "concat('text ', id) AS content")

    class Folder:
        def __init__(self, filesystem):
            self.filesystem = filesystem

        def open_output_stream(self, path):
            created.append(path)
            return self.filesystem.open_output_stream(path)

        def __getattr__(self, name):
            return getattr(self.filesystem, name)

    created, batches = [], [documents.toPandas()]
    opened = manifests._arrow
    monkeypatch.setattr(manifests, "_arrow", lambda uri: (Folder(opened(uri)[0]), opened(uri)[1]))
    monkeypatch.setattr(manifests, "TaskContext", type("Context", (), {"get": staticmethod(lambda: type("Task", (), {"taskAttemptId": lambda self: 1})())}))

    class Rows:
        def select(self, *columns):
            return self

        def mapInPandas(self, run, schema):
            return list(run(iter(batches)))

    written = manifests.write_documents(Rows(), str(tmp_path))[0]
    assert len(created) == 39 and not [p for p in created if "/in/" in p]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["in"] and len(list((tmp_path / "in").iterdir())) == 40
    assert written["written"].tolist() == [i != 7 for i in range(40)]


def test_many_inputs_share_a_batch(spark, tmp_path, monkeypatch):
    for i in range(30):
        (tmp_path / f"{i}.txt").write_text(f"text {i}")
    (tmp_path / "folder").mkdir()
    steps = []
    paths = spark.range(31).selectExpr("concat(id, '.txt') AS path").unionByName(spark.sql("SELECT 'folder' AS path"))
    monkeypatch.setattr(storage, "_spread", lambda df, *by: type("Spied", (), {"mapInPandas": lambda self, run, schema: (steps.append(run), df.mapInPandas(run, schema))[1]})())
    found = {r.path: (r.size, r.sha256) for r in storage.identify(paths, str(tmp_path)).collect()}
    assert set(found) == {"folder", *(f"{i}.txt" for i in range(30))}
    assert all(found[f"{i}.txt"] == (len(f"text {i}"), hashlib.sha256(f"text {i}".encode()).hexdigest()) for i in range(30))
    tables = list(steps[0](iter([paths.toPandas()])))
    assert [len(t) for t in tables] == [31]


def test_columns_of_many_parquet_files_are_read_by_tasks(spark, tmp_path):
    from tabletrail.sources.storage import parquet_columns, walk

    rows = spark.createDataFrame([(i % 5 or None, f"t{i}", i / 2, i) for i in range(40)], "k int, s string, x double, n long")
    for name in ("a", "b"):
        rows.filter("n % 2 = 0" if name == "a" else "n % 2 = 1").repartition(3).write.parquet(f"{tmp_path}/in/{name}.parquet")
    files = walk(spark, str(tmp_path), ["in"]).filter("path rlike '/part-[^/]*parquet$'")
    got = parquet_columns(files, str(tmp_path), rows.select("x", "k").schema)
    assert got.columns == ["path", "x", "k"]
    told = sorted((r.path.split("/")[1], r.x, r.k) for r in got.collect())
    assert told == sorted(("ab"[r.n % 2] + ".parquet", r.x, r.k) for r in rows.collect())
    assert parquet_columns(files.filter("false"), str(tmp_path), rows.schema).count() == 0
    (tmp_path / "in/a.parquet/part-x.parquet").write_bytes(b"no table")
    with pytest.raises(Exception, match="(?i)parquet"):
        parquet_columns(walk(spark, str(tmp_path), ["in"]).filter("path like '%part-x%'"), str(tmp_path), rows.schema).collect()


# --- external files of any format ---------------------------------------------------------


def test_external_files_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    from tabletrail.sources.external import read_files

    folder = tmp_path / "a folder"
    (folder / "below").mkdir(parents=True)
    (folder / "_hidden").mkdir()
    want = {f"{i}.txt": bytes([i]) * (i * 7 % 60) for i in range(50)} | {"below/b.bin": b"\xff\x00", "a%20b c.txt": b"x" * 500, "_k=1": b"k"}
    for name, data in (want | {".dot": b"1", "_SUCCESS": b"1", "_hidden/x.txt": b"1"}).items():
        (folder / name).write_bytes(data)
    monkeypatch.setattr(storage, "READ_BYTES", 100)
    files = read_files(spark, f"{folder}/")
    assert {r.path: (r.length, bytes(r.content)) for r in files.collect()} == {f"{folder}/{n}": (len(d), d) for n, d in want.items()}
    batches = spark.createDataFrame([(str(i), 40) for i in range(9)], "path string, size bigint")
    sizes = []
    for i in range(9):
        (tmp_path / str(i)).write_bytes(b"y" * (250 if i == 4 else 40))
    monkeypatch.setattr(storage, "_spread", lambda df, *by: type("Spied", (), {"select": lambda self, *c: self, "mapInArrow": lambda self, run, schema: sizes.extend(b.num_rows for b in run(iter(batches.toArrow().to_batches())))})())
    storage.contents(batches, str(tmp_path))
    assert sum(sizes) == 9 and max(sizes) == 2
    with pytest.raises(ArtifactError, match="no folder"):
        read_files(spark, str(tmp_path / "absent"))


def test_driver_holds_no_external_file(spark, tmp_path):
    from tabletrail import suite

    rows = spark.range(300).selectExpr("id AS doc_id", "repeat('é', cast(id AS int)) AS text")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    found = suite.queries()["external_binary"](spark, str(tmp_path))
    assert not [f for f in found.inputFiles() if f.endswith(".txt")]
    texts = {f"{i}.txt": ("é" * i).encode() for i in range(300)}
    assert {tuple(r) for r in found.collect()} == {(n, len(t), hashlib.sha256(t).hexdigest()) for n, t in texts.items()}


def test_a_large_folder_is_listed_name_by_name(tmp_path):
    import tracemalloc

    for i in range(10_000):
        (tmp_path / f"{i}.txt").touch()
    (tmp_path / ".7.txt.crc").touch()
    (tmp_path / ".alone.crc").touch()
    (tmp_path / "to-nothing").symlink_to(tmp_path / "nothing")
    (tmp_path / "folder" / "in").mkdir(parents=True)
    (tmp_path / "folder" / "in" / "x").write_text("four")
    tracemalloc.start()
    count = sum(1 for _ in storage._entries(str(tmp_path), False))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == 10_002 and peak < 500_000
    deep = {name: (is_file, size) for name, is_file, size in storage._entries(str(tmp_path), True)}
    assert len(deep) == 10_004 and deep["folder/in/x"] == (True, 4) and deep["folder/in"] == (False, 0) and deep[".alone.crc"] == (True, 0)
    assert list(storage._entries(str(tmp_path / "absent"), True)) == []
    with pytest.raises(OSError):
        list(storage._entries(str(tmp_path / "folder" / "in" / "x"), False))
