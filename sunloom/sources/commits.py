"""A log of numbered files, each created only if it is absent: what readers see of a table, and in which order.

A version's file holds the whole state after it as JSON, so a reader needs the newest one alone. A writer reads the newest
state, makes the next, and creates its file; if another writer was faster the file is there, nothing is overwritten, and
the change is made again on top of what the other left. Data that no version names is not part of the table.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession

State = dict
#: File names of versions sort as their numbers do.
_NAME = re.compile(r"(\d{20})\.json")


class Stale(RuntimeError):
    """What a change builds on has been replaced since it was read."""


def local_path(uri: str) -> str | None:
    """The path of a ``file`` URI or of a plain path; None for other schemes."""
    parts = urlsplit(uri)
    return uri if not parts.scheme else unquote(parts.path) if parts.scheme == "file" else None


class LocalStore:
    """Files of this machine or of a folder mounted on all. A hard link appears with its content or fails."""

    def names(self, folder: str) -> list[str]:
        try:
            return os.listdir(local_path(folder))
        except FileNotFoundError:
            return []

    def read(self, path: str) -> bytes:
        with open(local_path(path), "rb") as file:
            return file.read()

    def create(self, path: str, content: bytes) -> bool:
        at = local_path(path)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        staged = f"{at}.{uuid.uuid4().hex}"
        with open(staged, "wb") as file:
            file.write(content)
            file.flush()
            os.fsync(file.fileno())
        try:
            os.link(staged, at)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(staged)

    def delete(self, path: str) -> None:
        try:
            os.unlink(local_path(path))
        except FileNotFoundError:
            pass


class ArrowStore:
    """HDFS for processes without a session. Its rename fails where the target exists; stores that overwrite are refused."""

    def __init__(self, uri: str) -> None:
        from pyarrow import fs

        if urlsplit(uri).scheme not in ("hdfs", "viewfs"):
            raise ValueError(f"{uri}: a commit needs a file system whose rename does not overwrite")
        self.fs, self.kinds = fs.FileSystem.from_uri(uri)[0], fs

    def _at(self, uri: str) -> str:
        return urlsplit(uri).path

    def names(self, folder: str) -> list[str]:
        found = self.fs.get_file_info(self.kinds.FileSelector(self._at(folder), allow_not_found=True))
        return [f.base_name for f in found]

    def read(self, path: str) -> bytes:
        with self.fs.open_input_file(self._at(path)) as file:
            return file.read()

    def create(self, path: str, content: bytes) -> bool:
        at = self._at(path)
        self.fs.create_dir(os.path.dirname(at), recursive=True)
        staged = f"{at}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(staged) as file:
            file.write(content)
        try:
            self.fs.move(staged, at)
            return True
        except OSError:
            if self.fs.get_file_info(at).type == self.kinds.FileType.NotFound:
                raise
            self.fs.delete_file(staged)
            return False

    def delete(self, path: str) -> None:
        if self.fs.get_file_info(self._at(path)).type != self.kinds.FileType.NotFound:
            self.fs.delete_file(self._at(path))


class HadoopStore:
    """Any file system of the session's. ``FileContext`` renames without overwriting."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.gateway, self.conf = spark.sparkContext._jvm, spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration()

    def _open(self, path: str):
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.conf), at

    def names(self, folder: str) -> list[str]:
        fs, at = self._open(folder)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def read(self, path: str) -> bytes:
        fs, at = self._open(path)
        stream = fs.open(at)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, path: str, content: bytes) -> bool:
        fs, at = self._open(path)
        fs.mkdirs(at.getParent())
        _, staged = self._open(f"{path}.{uuid.uuid4().hex}")
        stream = fs.create(staged, False)
        try:
            stream.write(bytearray(content))
        finally:
            stream.close()
        try:
            self.move(staged.toString(), path)
            return True
        except Exception:
            if not fs.exists(at):
                raise
            fs.delete(staged, False)
            return False

    def exists(self, path: str) -> bool:
        fs, at = self._open(path)
        return fs.exists(at)

    def move(self, path: str, to: str) -> None:
        """A file or folder under another name; FileExistsError where something has it, never into it."""
        fs, at = self._open(to)
        fs.mkdirs(at.getParent())
        kinds = self.jvm.org.apache.hadoop.fs
        options = self.gateway.new_array(kinds.Options.Rename, 1)
        options[0] = kinds.Options.Rename.NONE
        try:
            kinds.FileContext.getFileContext(fs.getUri(), self.conf).rename(self._open(path)[1], at, options)
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                raise FileExistsError(to) from None
            raise

    def delete(self, path: str) -> None:
        fs, at = self._open(path)
        fs.delete(at, True)


def store(uri: str, spark: SparkSession | None = None):
    """How to reach ``uri``: by the machine's own calls where it is local, else by the session's, else by Arrow's."""
    if local_path(uri) is not None:
        return LocalStore()
    return HadoopStore(spark) if spark is not None else ArrowStore(uri)


class Log:
    """Versions 1, 2, ... below ``folder``."""

    def __init__(self, folder: str, spark: SparkSession | None = None) -> None:
        self.folder, self.store = folder.rstrip("/"), store(folder, spark)

    def versions(self) -> list[int]:
        return sorted(int(m[1]) for m in map(_NAME.fullmatch, self.store.names(self.folder)) if m)

    def state(self, version: int) -> State:
        return json.loads(self.store.read(f"{self.folder}/{version:020d}.json"))

    def newest(self) -> tuple[int, State]:
        """The newest version and its state; 0 and nothing before the first."""
        numbers = self.versions()
        return (numbers[-1], self.state(numbers[-1])) if numbers else (0, {})

    def change(self, make: Callable[[State], State | None], attempts: int = 1000) -> tuple[int, State]:
        """Commit ``make(state)`` as the next version; where another writer commits first, ``make`` sees what it left.

        ``make`` may raise to refuse, or give None where there is nothing to do; it must not have effects of its own.
        """
        for _ in range(attempts):
            version, now = self.newest()
            later = make(json.loads(json.dumps(now)))
            if later is None:
                return version, now
            content = json.dumps(later, sort_keys=True, ensure_ascii=False, allow_nan=False).encode()
            if self.store.create(f"{self.folder}/{version + 1:020d}.json", content):
                return version + 1, later
        raise Stale(f"{self.folder}: {attempts} commits in a row went to other writers")

    def trim(self, keep: int) -> None:
        """Delete all but the newest ``keep`` versions; readers of older ones fail."""
        for version in self.versions()[: -max(keep, 1)]:
            self.store.delete(f"{self.folder}/{version:020d}.json")


class Table:
    """Rows in folders of Parquet that a log names. Readers see a version's folders, whole, whatever is written meanwhile.

    A write that fails or loses leaves folders that no version names; ``vacuum`` removes those.
    """

    def __init__(self, spark: SparkSession, location: str) -> None:
        self.spark, self.location = spark, location.rstrip("/")
        self.log = Log(f"{self.location}/log", spark)

    def folders(self, version: int | None = None) -> list[str]:
        state = self.log.newest()[1] if version is None else self.log.state(version)
        return state.get("folders", [])

    def read(self, schema: str, version: int | None = None) -> DataFrame:
        folders = self.folders(version)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.location}/{f}" for f in folders])

    def _write(self, df: DataFrame, **options: str) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        df.write.options(compression="zstd", **options).parquet(f"{self.location}/{folder}")
        return folder

    def append(self, df: DataFrame, writer: str | None = None, batch: int | None = None) -> int:
        """Add rows. With ``writer`` and ``batch`` (rising numbers) a batch that is repeated is added once."""
        if writer is not None and self.log.newest()[1].get("writers", {}).get(writer, -1) >= batch:
            return self.log.newest()[0]
        folder = self._write(df)

        def make(state: State) -> State | None:
            writers = state.setdefault("writers", {})
            if writer is not None:
                if writers.get(writer, -1) >= batch:
                    return None
                writers[writer] = batch
            state.setdefault("folders", []).append(folder)
            return state

        return self.log.change(make)[0]

    def replace(self, df: DataFrame, **options: str) -> int:
        """Make ``df``, which may read this table, all there is: readers see the rows before or after, never none.

        If another writer has committed since ``df`` began to be written, its rows would be lost: ``Stale`` is raised.
        """
        before = self.folders()
        folder = self._write(df, **options)

        def make(state: State) -> State:
            if state.get("folders", []) != before:
                raise Stale(f"{self.location}: others have written since")
            return state | {"folders": [folder]}

        return self.log.change(make)[0]

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete folders that none of the newest ``keep`` versions names, and older versions; gives their names.

        Only when no write is under way, and no reader of an older version.
        """
        named = {f for v in self.log.versions()[-max(keep, 1) :] for f in self.folders(v)}
        self.log.trim(keep)
        gone = sorted(f"data/{n}" for n in HadoopStore(self.spark).names(f"{self.location}/data") if f"data/{n}" not in named)
        for folder in gone:
            HadoopStore(self.spark).delete(f"{self.location}/{folder}")
        return gone
