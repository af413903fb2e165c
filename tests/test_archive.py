"""TAR archives: what was written comes back row for row, with small splits, odd names and odd archives."""

import io
import tarfile

import pytest

from quern.sources.archive import TarReader, members, register, write_archives


@pytest.fixture(scope="module")
def tar(spark):
    register(spark)
    return lambda path, **options: spark.read.format("quern_tar").options(**options).load(str(path))


def make(path, files, mode="w"):
    with tarfile.open(path, mode, format=tarfile.PAX_FORMAT) as held:
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size, info.mtime = len(data), 1_700_000_000
            held.addfile(info, io.BytesIO(data))
        folder = tarfile.TarInfo("folder")
        folder.type = tarfile.DIRTYPE
        held.addfile(folder)
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "a.txt"
        held.addfile(link)


FILES = [("a.txt", b"first"), ("empty.json", b""), ("long/" + "x" * 180 + ".json", b"\x00\xff" * 1000), ("été 日本.json", "été".encode()), ("a.txt", b"again")]


@pytest.mark.parametrize("split", [1, 600, 1 << 20])
def test_members_come_back(tar, tmp_path, split):
    make(tmp_path / "one.tar", FILES)
    (tmp_path / "sub").mkdir()
    make(tmp_path / "sub" / "two.tar", FILES[:2])
    (tmp_path / "note.txt").write_text("no archive")
    rows = tar(tmp_path, splitBytes=split)
    found = [(r.archive.rsplit("/", 1)[1], r.name, bytes(r.content), r.size, r.modified) for r in rows.collect()]
    assert sorted(found) == sorted((a, n, d, len(d), 1_700_000_000) for a, files in (("one.tar", FILES), ("two.tar", FILES[:2])) for n, d in files)
    assert len(TarReader(str(tmp_path), split, "").partitions()) == {1: 7, 600: 4, 1 << 20: 2}[split]
    assert sorted(r.name for r in tar(tmp_path, suffix=".json").select("name").collect()) == sorted([n for n, _ in FILES if n.endswith(".json")] + ["empty.json"])
    assert tar(tmp_path / "one.tar").count() == len(FILES)


def test_offsets_are_where_the_bytes_are(tmp_path):
    make(tmp_path / "one.tar", FILES)
    raw = (tmp_path / "one.tar").read_bytes()
    assert [(n, raw[at : at + size]) for n, at, size, _ in members(str(tmp_path / "one.tar"))] == FILES


def test_odd_archives(tar, tmp_path):
    with pytest.raises(Exception, match="no whole, plain TAR"):
        make(tmp_path / "packed.tar", FILES, "w:gz")
        tar(tmp_path / "packed.tar").collect()
    make(tmp_path / "cut.tar", [("big", b"x" * 5000)])
    (tmp_path / "cut.tar").write_bytes((tmp_path / "cut.tar").read_bytes()[:2000])
    with pytest.raises(Exception, match="cut.tar is no whole"):
        tar(tmp_path / "cut.tar").collect()
    (tmp_path / "none").mkdir()
    assert tar(tmp_path / "none").count() == 0


def test_written_archives(spark, tar, tmp_path):
    rows = spark.createDataFrame([(f"{n}.txt", f"text {n}" * n) for n in range(50)] + [("null.txt", None)], "name string, content string").repartition(4)
    written = write_archives(rows, str(tmp_path / "out"), "name", "content")
    assert sum(r.members for r in written.collect()) == 51
    assert {(r.name, bytes(r.content).decode()) for r in tar(tmp_path / "out").collect()} == {(r.name, r.content or "") for r in rows.collect()}
