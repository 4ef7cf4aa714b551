"""Files under exact names, one per row, published in two phases (SRC4, SRC7,
SRC16).

Spark's own writers choose their file names.  This writer is a Python data
source: every task stages its files in a folder of its own beside the target,
and only when all tasks have succeeded does the commit move them to their names.
A failed job removes what it staged, a repeated task's first try is never
published.  Any file system that Arrow knows (local or shared folders, HDFS,
object stores) will do.
"""

from __future__ import annotations

import posixpath
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "quire_named_files"
STAGE = "_staged-"
_MOVES = 16
_PATIENCE = 20


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def safe_name(name: str | None) -> bool:
    """A relative path that stays inside its folder and isn't hidden from readers."""
    parts = (name or "").split("/")
    return all(p not in ("", ".", "..") and not p.startswith(("_", ".")) for p in parts) and "\\" not in (name or "")


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    names: tuple[str, ...]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.stage = f"{STAGE}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Staged:
        system, root = _file_system(self.path)
        folder = posixpath.join(self.stage, uuid.uuid4().hex)  # of this try of this task
        names = []
        for name, content in iterator:
            if not safe_name(name):
                raise ValueError(f"not a file name: {name!r}")
            if not names:
                system.create_dir(posixpath.join(root, folder), recursive=True)
            with system.open_output_stream(posixpath.join(root, folder, str(len(names)))) as out:
                out.write(bytes(content) if content is not None else b"")
            names.append(name)
        return Staged(folder, tuple(names))

    def commit(self, messages: list) -> None:
        system, root = _file_system(self.path)
        moves = [(posixpath.join(root, m.folder, str(i)), posixpath.join(root, name))
                 for m in messages if m for i, name in enumerate(m.names)]
        targets = [t for _, t in moves]
        if len(set(targets)) < len(targets):
            self.abort(messages)
            raise ValueError("two rows have one file name; nothing was published")
        for folder in sorted({posixpath.dirname(t) for t in targets}):
            system.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(_MOVES) as pool:
            list(pool.map(lambda move: system.move(*move), moves))
        self._clear()

    def abort(self, messages: list) -> None:
        """Remove what was staged, also by tasks that the failed job is still ending
        (a task whose folder is gone can't stage any more)."""
        self._clear()
        for _ in range(_PATIENCE):
            time.sleep(0.3)
            if not self._clear():
                break

    def _clear(self) -> bool:
        system, root = _file_system(self.path)
        place = posixpath.join(root, self.stage)
        there = system.get_file_info(place).type.name == "Directory"
        if there:
            try:
                system.delete_dir(place)
            except OSError:  # a task is still staging: the next round has it
                pass
        return there


class NamedFiles(DataSource):
    """Rows ``(name string, content binary)``, each a file below ``path``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"].rstrip("/"), overwrite)


def write_named(df: DataFrame, path: str, name, content) -> None:
    """One file below ``path`` for every row: ``name`` is its relative path (such
    as ``P1/form.json``), ``content`` its text in UTF-8 or its bytes (null: an
    empty file).  Files of the same names are replaced, others stay.  A null,
    unsafe or repeated name is an error, and then no file appears.
    """
    spark = df.sparkSession
    spark.dataSource.register(NamedFiles)
    df.select(name.alias("name"), content.cast("binary").alias("content")) \
        .write.format(FORMAT).mode("append").option("path", path).save()


def entity_files(df: DataFrame, path: str, id_col: str, text_col: str, file: str = "form.json") -> None:
    """SRC4 sink: ``<path>/<id>/<file>`` for every record."""
    write_named(df, path, F.concat(F.col(id_col).cast("string"), F.lit("/" + file)), F.col(text_col))


def stem_files(df: DataFrame, path: str, stem_col: str, text_col: str, suffix: str = ".json") -> None:
    """SRC7 and SRC16 sink: ``<path>/<stem><suffix>`` for every row."""
    write_named(df, path, F.concat(F.col(stem_col).cast("string"), F.lit(suffix)), F.col(text_col))
