"""A sink that writes one file a row, under the row's own name.

Register :class:`NamedFiles` and write rows of ``name, content`` with ``format("named_files")`` to a path
or address that every executor reaches.  Each attempt of a task writes to a folder of its own below a hidden one of the job.  When all
tasks are done, the folders of attempts that don't count are deleted and the job's folder is renamed to ``write=…``,
so a write is there as a whole or not at all.  A job that fails deletes its hidden folder; tasks that still ran
then may leave some of it, which begins with ``_`` and no reader of Spark's sees.  The driver learns one folder name of each task.
Files are ``write=…/part-NNNNN/NNNNNN-name``, in the order of partitions and rows.  Overwriting deletes earlier writes after the
rename.  On an object store, where a folder's rename isn't one step, ``_SUCCESS`` is the last file to appear.

A null name leaves the number, a null content an empty file; characters that a file name can't hold become ``_``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


@dataclass
class _Done(WriterCommitMessage):
    folder: str | None


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        if missing := {"name", "content"} - set(names):
            raise ValueError(f"no column {' and '.join(sorted(missing))} to write")
        self.job = f"{datetime.now(timezone.utc):%Y%m%d%H%M%S%f}-{uuid4().hex[:8]}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Done:
        fs, root = _at(self.path)
        folder, n = None, 0
        for batch in iterator:
            for name, content in zip(batch["name"].to_pylist(), batch["content"].to_pylist()):
                if folder is None:
                    folder = f"part-{TaskContext.get().partitionId():05d}-{uuid4().hex}"
                    fs.create_dir(f"{root}/_{self.job}/{folder}")
                plain = re.sub(r"[/\\\x00-\x1f]", "_", name or "")
                with fs.open_output_stream(f"{root}/_{self.job}/{folder}/{n:06d}{'-' + plain if plain else ''}") as out:
                    out.write((content or "").encode())
                n += 1
        return _Done(folder)

    def commit(self, messages: list[_Done | None]) -> None:
        fs, root = _at(self.path)
        held = f"{root}/_{self.job}"
        fs.create_dir(held)
        counts = {m.folder for m in messages if m and m.folder}
        for found in fs.get_file_info(pafs.FileSelector(held)):
            if found.base_name in counts:
                fs.move(found.path, found.path[: found.path.rindex("-")])
            else:
                fs.delete_dir(found.path)
        earlier = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.startswith("write=")]
        fs.move(held, f"{root}/write={self.job}")
        with fs.open_output_stream(f"{root}/write={self.job}/_SUCCESS"):
            pass
        for path in earlier if self.overwrite else []:
            fs.delete_dir(path)

    def abort(self, messages: list[_Done | None]) -> None:
        fs, root = _at(self.path)
        if fs.get_file_info(f"{root}/_{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/_{self.job}")


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema.fieldNames(), overwrite)


def write_named(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Write a file for each row of ``name, content``."""
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select(F.col("name").cast("string").alias("name"), F.col("content").cast("string").alias("content")).write.format("named_files").mode(mode).save(path)


def reports(rows: DataFrame, name: str) -> DataFrame:
    """``name, content``: each row as indented JSON, nulls as such, under the text of its column ``name`` with ``.json``."""
    return rows.select(F.concat(F.col(name).cast("string"), F.lit(".json")).alias("name"), F.to_json(F.struct(*rows.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("content"))
