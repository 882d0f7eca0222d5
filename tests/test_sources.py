import bz2
import io
import json
import tarfile

import pytest

from tallyloom.sources import files, sinks
from tallyloom.streaming import events as e


def test_manifest(spark, tmp_path):
    (tmp_path / "data/other").mkdir(parents=True)
    (tmp_path / "data/a.txt").write_bytes(b"hello")
    (tmp_path / "data/other/a.txt").write_bytes(b"another file of that name")
    items = [{"id": "1", "path": "a.txt", "split": "train", "size_bytes": 5, "sha256": "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"}, {"id": "2", "path": "b.txt", "split": "test", "size_bytes": 1, "sha256": "x"}]
    (tmp_path / "m.json").write_text(json.dumps({"schema_version": 2, "items": items}))
    found = files.binary_files(spark, str(tmp_path / "data"))
    assert files.verify_manifest(files.manifest(spark, str(tmp_path / "m.json"), ["train"]), found, str(tmp_path / "data")).count() == 0
    assert [(r.id, r.problem) for r in files.verify_manifest(files.manifest(spark, str(tmp_path / "m.json")), found, f"file://{tmp_path}/data/").collect()] == [("2", "missing")]
    (tmp_path / "m3.json").write_text(json.dumps({"schema_version": 3, "items": items}))
    with pytest.raises(Exception):
        files.manifest(spark, str(tmp_path / "m3.json")).collect()


def test_tar_members(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        for name, data in (("src/a.py", b"x"), ("../evil.py", b"x"), ("src/skip/b.py", b"x"), ("src/c.bin", b"x"), ("src/d.py", b"\xff")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    found = files.safe_members(files.tar_members(files.archives(spark, str(tmp_path / "a.tar"))), ["py"], ["skip"])
    assert {(r.member, r.text) for r in found.select("member", files.utf8(found.content).alias("text")).collect()} == {("src/a.py", "x"), ("src/d.py", None)}


def test_archives_round_trip(spark):
    rows = [("a", f"d/{i}.txt", b"%d" % i * i) for i in range(20)] + [("b", "x", b""), ("b", "y", None)]
    members = spark.createDataFrame(rows, "archive string, member string, content binary")
    want = sorted((a, m, c or b"") for a, m, c in rows)
    for kind, scan in (("tar", files.tar_members), ("zip", files.zip_members), ("zip+gzip", files.zip_members)):
        assert sorted((r.archive, r.member, bytes(r.content)) for r in scan(files.packed_archives(members, kind)).collect()) == want, kind
    assert files.zip_members(files.packed_archives(members, "zip"), "1[.]txt$").count() == 2
    assert files.tar_members(files.packed_archives(members.limit(0), "tar")).count() == 0


def test_paths_that_collide_are_not_kept(spark):
    rows = [("a", m, b"") for m in ("x/A", "x/a", "x/b", "/abs", "x//y", "./z", "x\\y", "..")] + [("b", "x/A", b"")]
    got = {(r.archive, r.member) for r in files.safe_members(spark.createDataFrame(rows, "archive string, member string, content binary")).collect()}
    assert got == {("a", "x/b"), ("b", "x/A")}


def test_wiki_dump(spark, tmp_path):
    page = "<page><title>{}</title><ns>{}</ns><id>{}</id>{}<revision><id>1</id><text>old</text></revision><revision><id>2</id><text>{}</text></revision></page>"
    xml = "<mediawiki>" + page.format("A", 0, 1, "", "new") + page.format("Talk:A", 1, 2, "", "x") + page.format("R", 0, 3, '<redirect title="A"/>', "x") + page.format("E", 0, 4, "", "") + "</mediawiki>"
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(xml.encode()))
    assert [tuple(r) for r in files.wiki_pages(spark, str(tmp_path / "d.xml.bz2")).collect()] == [(1, "A", 2, "new")]


def test_immutable_writes(spark, tmp_path):
    a, b = spark.range(3), spark.range(4)
    assert sinks.write_immutable(a, str(tmp_path / "t")) and not sinks.write_immutable(a, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        sinks.write_immutable(b, str(tmp_path / "t"))
    with pytest.raises(Exception):
        sinks.write_once(a, str(tmp_path / "t"))
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken/x.parquet").write_bytes(b"no table")
    with pytest.raises(Exception, match="x.parquet"):  # a damaged table is not taken for a missing one
        sinks.write_immutable(a, str(tmp_path / "broken"))


def test_manifest_parts_are_in_order(spark, tmp_path):
    sinks.write_manifest(spark.range(5000).selectExpr("format_string('%05d', id) AS id", "id AS size_bytes"), str(tmp_path / "m"))
    parts = sorted((tmp_path / "m").glob("part-*.json"))
    ids = [json.loads(line)["id"] for p in parts for line in p.read_text().splitlines()]
    assert ids == sorted(ids) and len(ids) == 5000


def test_streams_over_several_files_equal_one_batch(spark, tmp_path):
    rows = [(i, i % 3, f'{{"k": {i % 5}}}', "a" if i % 2 else "b") for i in range(60)]
    s = "event_id long, user_id long, props string, event_type string"
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], s).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = {r.event_type: (r.n, r.n_bytes) for r in e.run_to_table(e.running_accounts(e.file_stream(spark, str(tmp_path / "in"))), "t", "complete").collect()}
    assert got == {"a": (30, 240), "b": (30, 240)}
    assert e.run_to_table(e.first_sights(e.file_stream(spark, str(tmp_path / "in"))), "t").filter("NOT reused").count() == 15
    assert e.run_to_table(e.segments(e.file_stream(spark, str(tmp_path / "in")), 40), "t").groupBy("user_id", "segment").count().filter("count = 5").count() == 12
