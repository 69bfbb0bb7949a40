"""``named_files``: a data source writer that makes one file per row, under a commit protocol.

Spark's own file sinks choose the names of their part files.  Pages, issues and reports
are files that people open, so they need a name and a place of their own:

* a task writes its rows under a hidden folder beside the target, in a folder of its
  attempt, and moves them from there when the attempt has ended well;
* ``commit`` runs once, on the driver, after all tasks: with ``overwrite`` the hidden
  folder takes the place of the target, with ``append`` its files are moved into the
  target one after the other and replace files of the same name;
* ``abort`` removes the hidden folder.

So a reader sees no file of an attempt that failed, and none before the job has ended.
Through the driver go one message a task, of a count and a size.

``read_files`` reads a folder of such files back.  Spark's file sources hold the status of
every file on the driver and plan a task for every few of them; here a task lists the
folder, and the names are dealt out to the tasks that read the files.
"""

from __future__ import annotations

import itertools
import time
import uuid
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, StringType, StructType

from pagemill.session import deal_by

SOURCE_NAME = "named_files"
#: Files and bytes that a task holds at once, unless a single file has more.
READ_FILES, READ_BYTES = 512, 4 << 20


def open_folder(path: str):
    """(file system, path on it) of a folder that pyarrow can open."""
    from pyarrow import fs

    from pagemill.sources.landed import to_arrow_uri
    return fs.FileSystem.from_uri(to_arrow_uri(path.rstrip("/")))


def checked_name(name: str | None) -> str:
    """A file name below the target; it may have folders but can't leave the target."""
    parts = (name or "").split("/")
    if not name or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"not a file name: {name!r}")
    return name


def _below(files, root: str, name: str, made: set[str]) -> str:
    """Place of ``name`` below ``root``, which has to be there; the folders between are made,
    but for those that this task has ``made``."""
    *folders, _ = name.split("/")
    at = root
    for folder in folders:
        at = f"{at}/{folder}"
        if at not in made:
            files.create_dir(at, recursive=False)
            made.add(at)
    return f"{root}/{name}"


@dataclass
class Written(WriterCommitMessage):
    """What one task has written."""

    files: int
    size: int


class NamedFilesWriter(DataSourceArrowWriter):
    """Writes the columns ``name`` and ``content`` (text or bytes; null is an empty file)."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        parent, _, base = self.path.rpartition("/")
        self.staging = f"{parent}/.{base}.staging-{uuid.uuid4().hex}"
        # Made once, before any task: a task that is still running after an abort can't bring it back.
        files, root = open_folder(self.staging)
        files.create_dir(root, recursive=True)

    def write(self, iterator) -> Written:
        task = TaskContext.get()
        own = f"attempt-{task.partitionId()}-{task.taskAttemptId()}"
        files, root = None, ""
        names: dict[str, None] = {}
        made: set[str] = set()
        size = 0
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if files is None:
                    files, root = open_folder(self.staging)
                raw = content.encode() if isinstance(content, str) else content or b""
                at = _below(files, root, f"{own}/{checked_name(name)}", made)
                with files.open_output_stream(at) as out:
                    out.write(raw)
                names[name] = None
                size += len(raw)
        for name in names:
            files.move(f"{root}/{own}/{name}", _below(files, root, f"files/{name}", made))
        return Written(len(names), size)

    def commit(self, messages) -> None:
        from pyarrow import fs
        files, target = open_folder(self.path)
        _, root = open_folder(self.staging)
        ready = f"{root}/files"
        if not sum(m.files for m in messages if m is not None):
            files.create_dir(ready, recursive=True)
        if self.overwrite:
            if files.get_file_info(target).type == fs.FileType.Directory:
                files.delete_dir(target)
            elif files.get_file_info(target).type == fs.FileType.File:
                files.delete_file(target)
            files.create_dir(target.rpartition("/")[0], recursive=True)
            files.move(ready, target)
        else:
            for info in files.get_file_info(fs.FileSelector(ready, recursive=True)):
                at = target + info.path[len(ready):]
                if info.type == fs.FileType.Directory:
                    continue
                files.create_dir(at.rpartition("/")[0], recursive=True)
                if files.get_file_info(at).type == fs.FileType.Directory:
                    files.delete_dir(at)  # what stands there gives way to the file
                files.move(info.path, at)
        files.delete_dir(root)

    def abort(self, messages) -> None:
        from pyarrow import fs
        files, root = open_folder(self.staging)
        for again in (True, True, True, False):
            try:
                if files.get_file_info(root).type == fs.FileType.Directory:
                    files.delete_dir(root)
                return
            except OSError:  # a task was still writing there
                if not again:
                    raise
                time.sleep(0.2)


class NamedFiles(DataSource):
    """``df.write.format("named_files")`` for frames of ``name`` and ``content``."""

    @classmethod
    def name(cls) -> str:
        return SOURCE_NAME

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        kinds = {f.name: type(f.dataType) for f in schema}
        if set(kinds) != {"name", "content"} or kinds["name"] is not StringType or kinds["content"] not in (StringType, BinaryType):
            raise ValueError("named_files takes the columns name (text) and content (text or bytes)")
        return NamedFilesWriter(self.options["path"], overwrite)


def write_files(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write each row of ``df`` (name, content) as a file under ``path``.

    Names have to differ (within folders too): of rows that share one the last to be moved stays.
    ``append`` keeps and replaces other files of the folder one by one and is meant for
    few files; many go to a folder of their own with ``overwrite``.
    """
    register(df.sparkSession)
    df.select("name", "content").write.format(SOURCE_NAME).mode(mode).save(qualified(df.sparkSession, path))


def read_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files right under ``path``; none if there is no such folder."""
    from pyarrow import fs
    files, root = open_folder(qualified(spark, path))
    if files.get_file_info(root).type != fs.FileType.Directory:
        return []
    return [i.base_name for i in files.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File]


def _list_names(batches):
    """mapInArrow body: names of the files right in each folder (``dir``), ``LISTING_ROWS`` at a time."""
    import pyarrow as pa

    from pagemill.sources.landed import LISTING_ROWS, _entries
    for batch in batches:
        for folder in batch.column("dir").to_pylist():
            names = (name for _, name, _, is_dir in _entries(folder) if not is_dir)
            for some in itertools.batched(names, LISTING_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["name"])


def _read_named(folder: str):
    """mapInArrow body: content of the files of ``folder`` by ``name``, READ_FILES and READ_BYTES at a time."""
    def read(batches):
        import pyarrow as pa

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["name", "content"])
        files, root = open_folder(folder)
        names, contents, size = [], [], 0
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with files.open_input_stream(f"{root}/{name}") as f:
                    raw = f.read()
                if names and (len(names) == READ_FILES or size + len(raw) > READ_BYTES):
                    yield rows()
                    names, contents, size = [], [], 0
                names.append(name)
                contents.append(raw)
                size += len(raw)
        if names:
            yield rows()
    return read


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``name`` and ``content`` (bytes) of every file right under ``path``, hidden ones included.

    One task lists the folder and holds ``LISTING_ROWS`` names at a time where the file system
    gives them one after the other; the names are dealt over all shuffle partitions and the
    files read there.  Neither a name nor a task for it passes through the driver.
    """
    folder = qualified(spark, path)
    listed = spark.range(0, 1, 1, 1).select(F.lit(folder).alias("dir")).mapInArrow(_list_names, "name string")
    return deal_by(listed, "name").mapInArrow(_read_named(folder), "name string, content binary")


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of its file system, as Spark's own sinks would take it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def register(spark: SparkSession) -> None:
    """Make the source known to the session."""
    spark.dataSource.register(NamedFiles)
