"""TAR archives as a table: splits planned from the members' headers, members read by offset.

``spark.read.format("quern_tar").load(folder)`` after ``register(spark)`` gives
(archive, name, offset, size, modified, content), a row a regular file. The headers of an
archive say where its members lie, so planning reads these alone, and a task opens the
archive at its own members: a large archive is read by many tasks, and a task holds
one member at a time. Paths go through Arrow's file systems, which reach the stores
that Arrow knows, and local paths where all executors share them.

Options: ``splitBytes`` (members of a split in sum, 32 MB), ``suffix`` (names that end
otherwise are not read). Links, folders and devices are left out; members of no bytes
have an empty content. A compressed archive, which has no offsets, or one that ends too
early is an error that names it.
"""

from __future__ import annotations

import tarfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, name string, offset long, size long, modified long, content binary"
SPLIT_BYTES = 32 << 20


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _archives(path: str) -> list[str]:
    """The archives of a folder, in order, or the one that is named."""
    from pyarrow import fs

    store, inner = _open(path)
    if store.get_file_info(inner).type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(inner, recursive=True))
    root = path.rstrip("/")
    return sorted(root + f.path[len(inner.rstrip("/")) :] for f in found if f.type == fs.FileType.File and f.path.endswith(".tar"))


def members(path: str) -> Iterator[tuple[str, int, int, int]]:
    """(name, offset, size, modified) of the regular files of an archive, from its headers."""
    store, inner = _open(path)
    length = store.get_file_info(inner).size
    with store.open_input_file(inner) as file:
        try:
            with tarfile.open(fileobj=file, mode="r:") as held:
                for m in held:
                    if m.isreg():
                        if m.offset_data + m.size > length:
                            raise tarfile.ReadError(f"{m.name} ends after the archive")
                        yield m.name, m.offset_data, m.size, int(m.mtime)
        except tarfile.TarError as error:
            raise ValueError(f"{path} is no whole, plain TAR archive: {error}") from None


class Split(InputPartition):
    def __init__(self, archive: str, held: list[tuple[str, int, int, int]]):
        self.archive, self.held = archive, held


class TarReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, suffix: str):
        self.path, self.split_bytes, self.suffix = path, split_bytes, suffix

    def partitions(self) -> list[Split]:
        out: list[Split] = []
        for archive in _archives(self.path):
            own, size = [], 0
            for m in members(archive):
                if m[0].endswith(self.suffix):
                    own.append(m)
                    size += m[2] + 512
                    if size >= self.split_bytes:
                        out.append(Split(archive, own))
                        own, size = [], 0
            if own:
                out.append(Split(archive, own))
        return out or [Split("", [])]

    def read(self, split: Split) -> Iterator[tuple]:
        if not split.held:
            return
        store, inner = _open(split.archive)
        with store.open_input_file(inner) as file:
            for name, offset, size, modified in split.held:
                file.seek(offset)
                yield split.archive, name, offset, size, modified, file.read(size)


class TarSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quern_tar"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TarReader:
        return TarReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)), self.options.get("suffix", ""))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TarSource)


def write_archives(rows: DataFrame, path: str, name: str, content: str) -> DataFrame:
    """Write each partition of ``rows`` as one archive below ``path``; returns (archive, members) once written.

    An archive is written aside and moved to its name when it is whole, so a task
    that is tried again leaves one. Names that repeat stay apart members.
    """

    def batches(source):
        import io
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        store, inner = _open(path)
        store.create_dir(inner, recursive=True)
        target, aside, n = f"{inner}/part-{TaskContext.get().partitionId():06d}.tar", f"{inner}/.{uuid.uuid4().hex}", 0
        with store.open_output_stream(aside) as out, tarfile.open(fileobj=out, mode="w|", format=tarfile.PAX_FORMAT) as held:
            for batch in source:
                for own, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    info = tarfile.TarInfo(own)
                    info.size = len(data or b"")
                    held.addfile(info, io.BytesIO(data or b""))
                    n += 1
        store.move(aside, target)
        yield pa.record_batch([pa.array([target]), pa.array([n], pa.int64())], names=["archive", "members"])

    return rows.selectExpr(f"cast(`{name}` as string) as name", f"cast(`{content}` as binary) as content").mapInArrow(batches, "archive string, members long")
