"""Directory and archive corpora."""

from __future__ import annotations

import io
import tarfile
import zipfile

from tallyguard.operators.ledger import negative_entries, unbalanced_groups
from tallyguard.sources import archives
from tallyguard.sources.archives import archive_members, read_archives, rejected_archives
from tallyguard.sources.files import scan_directory
from tallyguard.sources.live import catalog_columns


def test_directory(spark, tmp_path):
    kept = {"a.sql": "x", "sub/B.PRISMA": "y", "deep/er/c.yml": "mysql", "rebuild/d.tf": "Postgres", "w.json": "p\r\nq\rr"}
    left = {"node_modules/a.sql": "x", "s/build/b.js": "x", "s/.git/c.py": "x", "readme.md": "x", "dist": "x"}
    for name, text in {**kept, **left}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    (tmp_path / "broken.sql").write_bytes(b"ok \xc3\x28")
    for root in (str(tmp_path), f"file://{tmp_path}", f"{tmp_path}/"):
        rows = {r["relative_path"]: r for r in scan_directory(spark, root).collect()}
        assert set(rows) == set(kept)
    assert rows["a.sql"]["path"] == str(tmp_path / "a.sql")
    assert rows["w.json"]["raw_content"] == "p\nq\nr"
    assert {p: r["engine_type"] for p, r in rows.items()} == {
        "a.sql": "Generic SQL / Migration DDL",
        "sub/B.PRISMA": "Prisma ORM",
        "deep/er/c.yml": "MySQL",
        "rebuild/d.tf": "PostgreSQL",
        "w.json": "Generic SQL / Migration DDL",
    }


def test_single_file(spark, tmp_path):
    (tmp_path / "one.sql").write_text("select 1")
    [row] = scan_directory(spark, str(tmp_path / "one.sql")).collect()
    assert row["relative_path"] == "one.sql"


def _zip(path, members):
    with zipfile.ZipFile(path, "w") as archive:
        for name, text in members.items():
            archive.writestr(name, text)


def _tar(path, members):
    with tarfile.open(path, "w:gz") as archive:
        for name, text in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(text)
            archive.addfile(info, io.BytesIO(text.encode()))


def test_archives(spark, tmp_path):
    _zip(tmp_path / "good.zip", {"a.sql": "1", "d/": "", "d/b.yaml": "2", "node_modules/x.js": "3", "a/../c.tf": "4", "n.txt": "5"})
    _zip(tmp_path / "evil.ZIP", {"a.sql": "1", "../x.sql": "2"})
    _tar(tmp_path / "good.tgz", {"./a.sql": "6", "d/x/../b.json": "7"})
    _tar(tmp_path / "evil.tar.gz", {"/etc/x.sql": "8"})
    (tmp_path / "broken.zip").write_bytes(b"not a zip")
    (tmp_path / "other.rar").write_bytes(b"?")
    found = read_archives(spark, str(tmp_path))
    names = lambda rows: {(r["archive"].rsplit("/", 1)[1], r["relative_path"], r["content"]) for r in rows}
    assert names(archive_members(found).collect()) == {
        ("good.zip", "a.sql", "1"), ("good.zip", "d/b.yaml", "2"), ("good.zip", "a/c.tf", "4"),
        ("good.tgz", "a.sql", "6"), ("good.tgz", "d/b.json", "7"),
    }
    reasons = {r["archive"].rsplit("/", 1)[1]: r["reason"] for r in rejected_archives(found).collect()}
    assert reasons == {
        "evil.ZIP": "unsafe member: ../x.sql",
        "evil.tar.gz": "unsafe member: /etc/x.sql",
        "broken.zip": "unreadable archive: BadZipFile",
        "other.rar": archives.UNSUPPORTED,
    }
    too_large = rejected_archives(found, max_bytes=20).filter(f"reason = '{archives.TOO_LARGE}'")
    assert too_large.count() == 4


def test_archives_that_fail_while_unpacking(spark, tmp_path):
    _zip(tmp_path / "crc.zip", {"a.sql": "select one", "b.sql": "select two"})
    data = (tmp_path / "crc.zip").read_bytes()
    (tmp_path / "crc.zip").write_bytes(data.replace(b"select two", b"select 2!!"))
    (tmp_path / "cut.zip").write_bytes(data[:-30])
    _tar(tmp_path / "cut.tgz", {"a.sql": "x" * 5000, "b.sql": "".join(map(chr, range(33, 120))) * 900})
    whole = (tmp_path / "cut.tgz").read_bytes()
    (tmp_path / "cut.tgz").write_bytes(whole[: len(whole) // 2])
    # the flag of an encrypted member, in both of its headers
    locked = bytearray(data)
    for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        locked[locked.index(mark) + at] |= 1
    (tmp_path / "locked.zip").write_bytes(bytes(locked))
    with zipfile.ZipFile(tmp_path / "bomb.zip", "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("a.sql", "0" * 100_000)
    found = read_archives(spark, str(tmp_path))
    reasons = {
        r["archive"].rsplit("/", 1)[1]: r["reason"]
        for r in rejected_archives(found, max_unpacked=50_000).collect()
    }
    assert reasons == {
        "crc.zip": "unreadable archive: BadZipFile",
        "cut.zip": "unreadable archive: BadZipFile",
        "cut.tgz": "unreadable archive: EOFError",
        "locked.zip": "unreadable archive: RuntimeError",
        "bomb.zip": archives.TOO_LARGE_UNPACKED,
    }
    assert archive_members(found, max_unpacked=50_000).count() == 0


def test_repeated_paths_and_links(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "twice.zip", "w") as archive:
        archive.writestr("a.sql", "old")
        archive.writestr("a.sql", "new")
    with tarfile.open(tmp_path / "link.tgz", "w:gz") as archive:
        info = tarfile.TarInfo("a.sql")
        info.size = 3
        archive.addfile(info, io.BytesIO(b"one"))
        info = tarfile.TarInfo("b.sql")
        info.type, info.linkname = tarfile.LNKTYPE, "a.sql"
        archive.addfile(info)
    rows = archive_members(read_archives(spark, str(tmp_path))).collect()
    assert {(r["archive"].rsplit("/", 1)[1], r["relative_path"], r["content"]) for r in rows} == {
        ("twice.zip", "a.sql", "new"), ("link.tgz", "a.sql", "one"), ("link.tgz", "b.sql", "one"),
    }
    assert len(rows) == 3


def test_catalog(spark):
    spark.createDataFrame([], "bvn string").createOrReplaceTempView("people_view")
    rows = catalog_columns(spark).filter("table_name = 'people_view'").collect()
    assert [(r["name"], r["data_type"]) for r in rows] == [("bvn", "string")]
    spark.catalog.dropTempView("people_view")


def test_ledger_rows(spark):
    rows = [("a", "5.00", "2.00"), ("a", "0.00", "3.00"), ("b", "1.00", "-1.00"), ("c", "1.00", None)]
    entries = spark.createDataFrame(rows, "e string, d string, c string").selectExpr(
        "e", "cast(d as decimal(9,2)) debit", "cast(c as decimal(9,2)) credit"
    )
    assert [r["e"] for r in unbalanced_groups(entries, ["e"]).orderBy("e").collect()] == ["b", "c"]
    assert [r["e"] for r in negative_entries(entries).collect()] == ["b"]
