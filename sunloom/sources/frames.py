"""Frame cubes as a Spark data source, and a recorder whose writes are seen whole, in order, and once.

A cube is an NPZ file with the arrays below. ``spark.read.format("frames")`` reads a folder of cubes, or what the recorder
wrote, as pixels (or as frames, with ``rows=frames``). ``scan`` says which sequences and frames are wanted: the source opens
no part that can't hold them and reads the bytes of chosen frames alone. With ``push=true`` conditions of the query reach the
source too. Spark 4.1 keeps the last query's conditions with the relation, so a DataFrame that is read that way may stand in
one query, once; that is why it has to be asked for. ``df.write.format("frames")`` and
``writeStream`` record frames: tasks write parts, and one commit to a log of numbered files names them. A commit refuses a
frame that is not the next of its sequence and passes over a batch it has seen; parts of failed or repeated writes are
named by no commit and are not read.
"""

from __future__ import annotations

import io
import json
import math
import os
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from .commits import Log, local_path

# Fixed names: arrays of a cube.
VALUES, FRAMES, TIMES, SEQUENCE = "intensity.npy", "frame_idx.npy", "time_s.npy", "sequence_id.npy"
PIXELS = "sequence_id string, frame_idx long, time_s double, row_idx long, col_idx long, intensity float"
ROWS = "sequence_id string, frame_idx long, time_s double, height int, width int, intensity array<float>"
#: Bytes of a part that is written, of a file's share that a task reads, pixels of a batch, commits between full lists.
PART_BYTES, SHARE_BYTES, BATCH_PIXELS, FULL_LIST = 32 << 20, 64 << 20, 1 << 17, 64


class OutOfOrder(ValueError):
    """A frame that is not the next one of its sequence."""


def _open(path: str):
    local = local_path(path)
    if local is not None:
        return open(local, "rb")
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)[0].open_input_file(urlsplit(path).path)


def _cubes(path: str) -> list[tuple[str, int]]:
    """Path and size of the cubes below ``path``, or of the one it names."""
    local = local_path(path)
    if local is not None:
        found = [os.path.join(d, n) for d, _, names in os.walk(local) for n in names if n.endswith(".npz")] if os.path.isdir(local) else [local]
        return sorted((f, os.path.getsize(f)) for f in found)
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    infos = system.get_file_info(fs.FileSelector(at, recursive=True)) if system.get_file_info(at).type == fs.FileType.Directory else [system.get_file_info(at)]
    prefix = path[: len(path) - len(at)] if path.endswith(at) else f"{urlsplit(path).scheme}://{urlsplit(path).netloc}"
    return sorted((prefix + i.path, i.size) for i in infos if i.path.endswith(".npz"))


class Cube:
    """One open cube: its small arrays, and frames read by their place."""

    def __init__(self, path: str) -> None:
        self.path, self.file = path, _open(path)
        try:
            self.zip = zipfile.ZipFile(self.file)
            missing = {VALUES, FRAMES, TIMES, SEQUENCE} - set(self.zip.namelist())
            if missing:
                raise ValueError(f"{path}: no cube of frames, it lacks {sorted(missing)}")
            self.frames, self.times, sequence = (np.load(io.BytesIO(self.zip.read(n)), allow_pickle=False) for n in (FRAMES, TIMES, SEQUENCE))
            self.sequence = str(sequence)
            self.values = self.zip.open(VALUES)
            version = np.lib.format.read_magic(self.values)
            read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            self.shape, fortran, self.kind = read(self.values)
            self.start = self.values.tell()
            if len(self.shape) != 3 or fortran or self.kind.kind != "f" or not self.shape[0] == len(self.frames) == len(self.times):
                raise ValueError(f"{path}: arrays do not belong together")
        except zipfile.BadZipFile as bad:
            raise ValueError(f"{path}: no cube of frames") from bad

    def frame(self, place: int) -> np.ndarray:
        """A frame's values as float32, row after row. Only its bytes are read where the file is not compressed."""
        size = self.shape[1] * self.shape[2] * self.kind.itemsize
        self.values.seek(self.start + place * size)
        return np.frombuffer(self.values.read(size), dtype=self.kind).astype(np.float32)

    def __enter__(self) -> Cube:
        return self

    def __exit__(self, *args) -> None:
        self.zip.close()
        self.file.close()


def cube(frames: np.ndarray, numbers: np.ndarray, times: np.ndarray, sequence: str) -> bytes:
    """A cube's content, not compressed, so that frames can be read apart."""
    out = io.BytesIO()
    arrays = (frames.astype(np.float32), numbers.astype(np.int64), times.astype(np.float64), np.array(sequence))
    np.savez(out, **{n.removesuffix(".npy"): a for n, a in zip((VALUES, FRAMES, TIMES, SEQUENCE), arrays, strict=True)})
    return out.getvalue()


@dataclass
class Share(InputPartition):
    """The ``index``-th of ``count`` equal ranges of a cube's frames."""

    path: str
    index: int
    count: int


@dataclass
class Wanted:
    """Conditions on sequence_id and frame_idx, all of which hold."""

    sequences: frozenset | None = None
    numbers: frozenset | None = None
    low: float = -math.inf
    high: float = math.inf

    def take(self, condition: Filter) -> bool:
        """Whether the source answers for a condition by itself."""
        name, op = tuple(condition.attribute) if hasattr(condition, "attribute") else (), type(condition)
        if op is IsNotNull and name in (("sequence_id",), ("frame_idx",)):
            return True  # neither is ever null
        if name == ("sequence_id",) and op in (EqualTo, In):
            chosen = frozenset(condition.value if op is In else [condition.value])
            self.sequences = chosen if self.sequences is None else self.sequences & chosen
            return True
        if name == ("frame_idx",) and op in (EqualTo, In):
            chosen = frozenset(condition.value if op is In else [condition.value])
            self.numbers = chosen if self.numbers is None else self.numbers & chosen
            return True
        if name == ("frame_idx",) and op in (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual):
            edge = condition.value
            if op in (GreaterThan, GreaterThanOrEqual):
                self.low = max(self.low, edge + (op is GreaterThan))
            else:
                self.high = min(self.high, edge - (op is LessThan))
            return True
        return False

    def part(self, part: dict) -> bool:
        """Whether a recorded part may hold what is wanted."""
        if self.sequences is not None and part["sequence_id"] not in self.sequences:
            return False
        first, last = part["first"], part["first"] + part["frames"] - 1
        if last < self.low or first > self.high:
            return False
        return self.numbers is None or any(n is not None and first <= n <= last for n in self.numbers)

    def places(self, cube: Cube, start: int, stop: int) -> np.ndarray:
        if self.sequences is not None and cube.sequence not in self.sequences:
            return np.zeros(0, dtype=np.int64)
        numbers = cube.frames[start:stop]
        chosen = (numbers >= self.low) & (numbers <= self.high)
        if self.numbers is not None:
            chosen &= np.isin(numbers, [n for n in self.numbers if n is not None])
        return start + np.flatnonzero(chosen)


class FramesReader(DataSourceReader):
    def __init__(self, path: str, by_pixel: bool, version: int | None, wanted: Wanted) -> None:
        self.path, self.by_pixel, self.version, self.wanted = path, by_pixel, version, wanted

    def partitions(self) -> list[InputPartition]:
        recorded = parts(self.path, self.version)
        if recorded is not None:
            chosen = [(f"{self.path}/{p['file']}", p["bytes"]) for p in recorded if self.wanted.part(p)]
        else:
            chosen = _cubes(self.path)
        shares = [Share(f, k, n) for f, size in chosen for n in [max(1, -(-size // SHARE_BYTES))] for k in range(n)]
        return shares or [Share("", 0, 1)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with Cube(partition.path) as cube:
            n, height, width = cube.shape
            bounds = [n * k // partition.count for k in (partition.index, partition.index + 1)]
            for place in self.wanted.places(cube, *bounds).tolist():
                values, number, time = cube.frame(place), int(cube.frames[place]), float(cube.times[place])
                if not self.by_pixel:
                    whole = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))
                    yield pa.RecordBatch.from_arrays([pa.array([cube.sequence]), pa.array([number]), pa.array([time]), pa.array([height], pa.int32()), pa.array([width], pa.int32()), whole], names=ROW_NAMES)
                    continue
                for a in range(0, len(values), BATCH_PIXELS):
                    at = np.arange(a, min(a + BATCH_PIXELS, len(values)))
                    same = [pa.repeat(pa.scalar(v), len(at)) for v in (cube.sequence, number, time)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(at // width), pa.array(at % width), pa.array(values[at])], names=PIXEL_NAMES)


class PushedFramesReader(FramesReader):
    """Takes conditions on sequence_id and frame_idx from the query; Spark does not evaluate them again."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for condition in filters:
            if not self.wanted.take(condition):
                yield condition


PIXEL_NAMES = [f.split()[0] for f in PIXELS.split(", ")]
ROW_NAMES = [f.split()[0] for f in ROWS.split(", ")]


@dataclass
class Written(WriterCommitMessage):
    parts: list[dict]


class _Recorder:
    """What batch and stream writers share. Tasks call ``write``, the driver's process one of the others."""

    def __init__(self, path: str, writer: str | None) -> None:
        self.path, self.name = path.rstrip("/"), writer

    def _put(self, rows: list[tuple], sequence: str) -> list[dict]:
        """Parts of frames that follow each other."""
        rows.sort(key=lambda r: r[0])
        out, start = [], 0
        for k in range(1, len(rows) + 1):
            if k < len(rows) and rows[k][0] == rows[k - 1][0] + 1 and rows[k][2].shape == rows[k - 1][2].shape:
                continue
            run, start = rows[start:k], k
            content = cube(np.stack([r[2] for r in run]), np.array([r[0] for r in run]), np.array([r[1] for r in run]), sequence)
            file = f"parts/{uuid.uuid4().hex}.npz"
            self._store(file, content)
            values = [r[2][np.isfinite(r[2])].astype(float) for r in run]
            out.append(
                {
                    "file": file,
                    "sequence_id": sequence,
                    "first": run[0][0],
                    "frames": len(run),
                    "bytes": len(content),
                    "low": min((float(v.min()) for v in values if v.size), default=None),
                    "high": max((float(v.max()) for v in values if v.size), default=None),
                    "sum": float(sum(v.sum() for v in values)),
                    "count": int(sum(v.size for v in values)),
                    "end_s": run[-1][1],
                }
            )
        return out

    def _store(self, file: str, content: bytes) -> None:
        local = local_path(f"{self.path}/{file}")
        if local is not None:
            os.makedirs(os.path.dirname(local), exist_ok=True)
            with open(local, "wb") as out:
                out.write(content)
                out.flush()
                os.fsync(out.fileno())
            return
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(f"{self.path}/{file}")
        system.create_dir(os.path.dirname(at), recursive=True)
        with system.open_output_stream(at) as out:
            out.write(content)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        held: dict[str, list[tuple]] = {}
        sizes: dict[str, int] = {}
        out: list[dict] = []
        for batch in batches:
            for k in range(batch.num_rows):
                sequence, number, time, height, width, values = (batch.column(n)[k] for n in ROW_NAMES)
                if not (sequence.is_valid and number.is_valid and values.is_valid and height.is_valid and width.is_valid):
                    raise ValueError("a frame needs sequence_id, frame_idx, height, width and intensity")
                image = values.values.to_numpy(zero_copy_only=False).astype(np.float32)
                if image.size != height.as_py() * width.as_py() or not image.size:
                    raise ValueError(f"frame {number} of {sequence} has {image.size} values, not {height} times {width}")
                name = sequence.as_py()
                held.setdefault(name, []).append((number.as_py(), time.as_py() if time.is_valid else math.nan, image.reshape(height.as_py(), width.as_py())))
                sizes[name] = sizes.get(name, 0) + image.nbytes
                if sum(sizes.values()) > PART_BYTES:
                    large = max(sizes, key=sizes.get)
                    out += self._put(held.pop(large), large)
                    del sizes[large]
        for sequence, rows in held.items():
            out += self._put(rows, sequence)
        return Written(out)

    def _commit(self, messages: list[Written | None], batch: int | None) -> None:
        added = sorted((p for m in messages if m is not None for p in m.parts), key=lambda p: (p["sequence_id"], p["first"]))
        repeated = False

        def make(state: dict) -> dict | None:
            nonlocal repeated
            writers, sequences = state.setdefault("writers", {}), state.setdefault("sequences", {})
            if self.name is not None and batch is not None:
                if writers.get(self.name, -1) >= batch:
                    repeated = True
                    return None
                writers[self.name] = batch
            if not added and self.name is None:
                return None
            for p in added:
                known = sequences.setdefault(p["sequence_id"], {"frames": 0, "sum": 0.0, "count": 0, "low": None, "high": None, "end_s": None})
                if p["first"] != known["frames"]:
                    raise OutOfOrder(f"{p['sequence_id']}: frame {p['first']} came where {known['frames']} is next")
                known["frames"] += p["frames"]
                known["sum"], known["count"], known["end_s"] = known["sum"] + p["sum"], known["count"] + p["count"], None if math.isnan(p["end_s"]) else p["end_s"]
                for side, pick in (("low", min), ("high", max)):
                    known[side] = pick((x for x in (known[side], p[side]) if x is not None), default=None)
            version = state.get("version", 0) + 1
            kept = [{k: v for k, v in p.items() if k in ("file", "sequence_id", "first", "frames", "bytes")} for p in added]
            if version % FULL_LIST == 0:
                return state | {"version": version, "since": version, "parts": (parts(self.path, version - 1) or []) + kept}
            return state | {"version": version, "since": state.get("since", 0), "parts": kept}

        try:
            Log(f"{self.path}/log").change(make)
        except OutOfOrder:
            self._drop(messages)
            raise
        if repeated:
            self._drop(messages)

    def _drop(self, messages: list[Written | None]) -> None:
        from .commits import store

        for message in messages:
            for p in message.parts if message is not None else []:
                store(self.path).delete(f"{self.path}/{p['file']}")


class FramesWriter(_Recorder, DataSourceArrowWriter):
    def __init__(self, path: str, writer: str | None, batch: int | None) -> None:
        super().__init__(path, writer)
        self.batch = batch

    def commit(self, messages: list[Written | None]) -> None:
        self._commit(messages, self.batch)

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(messages)


class FramesStreamWriter(_Recorder, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self._commit(messages, batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self._drop(messages)


class FramesSource(DataSource):
    """Options: ``path``; reading: ``rows`` (pixels or frames), ``version``, ``sequences`` (a JSON list), ``first`` and
    ``last`` (frames, both included), ``push``; writing: ``writer`` with ``batch`` (a stream's own number), by which a
    repeated batch is known."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def _by_pixel(self) -> bool:
        kind = self.options.get("rows", "pixels")
        if kind not in ("pixels", "frames"):
            raise ValueError(f"rows must be pixels or frames, not {kind}")
        return kind == "pixels"

    def schema(self) -> str:
        return PIXELS if self._by_pixel() else ROWS

    def reader(self, schema: StructType) -> FramesReader:
        get = self.options.get
        version, sequences = get("version"), get("sequences")
        wanted = Wanted(
            None if sequences is None else frozenset(json.loads(sequences)), None, float(get("first", -math.inf)), float(get("last", math.inf))
        )
        kind = PushedFramesReader if get("push", "false").lower() == "true" else FramesReader
        return kind(self.options["path"].rstrip("/"), self._by_pixel(), None if version is None else int(version), wanted)

    def _checked(self, schema: StructType, overwrite: bool) -> None:
        if overwrite:
            raise ValueError("recorded frames are appended to, never overwritten")
        if schema.names != ROW_NAMES:
            raise ValueError(f"frames are written as {ROWS}")

    def writer(self, schema: StructType, overwrite: bool) -> FramesWriter:
        self._checked(schema, overwrite)
        batch = self.options.get("batch")
        return FramesWriter(self.options["path"], self.options.get("writer"), None if batch is None else int(batch))

    def streamWriter(self, schema: StructType, overwrite: bool) -> FramesStreamWriter:  # noqa: N802
        self._checked(schema, overwrite)
        return FramesStreamWriter(self.options["path"], self.options.get("writer", "stream"))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with conditions pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FramesSource)


def scan(spark: SparkSession, path: str, sequences: list[str] | None = None, first: int | None = None, last: int | None = None, **options: str) -> DataFrame:
    """Frames ``first`` to ``last`` (both included) of ``sequences``; what is not given is not bounded."""
    asked = {"sequences": None if sequences is None else json.dumps(sequences), "first": first, "last": last}
    return spark.read.format("frames").options(**{k: str(v) for k, v in asked.items() if v is not None}, **options).load(path)


def parts(path: str, version: int | None = None) -> list[dict] | None:
    """The parts of a recording as of a version (the newest unless given), None where nothing was recorded."""
    log = Log(f"{path.rstrip('/')}/log")
    numbers = log.versions()
    if not numbers:
        return None
    state = log.state(version or numbers[-1])
    out = list(state["parts"])
    for earlier in range(state["version"] - 1, max(state["since"], 1) - 1, -1):
        if state["since"] == state["version"]:
            break
        out = log.state(earlier)["parts"] + out
    return out


def index(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per sequence of each recording: path, sequence_id, frames, low, high, mean, end_s, version; from the newest
    commit alone, so it can be made again at any time. A path with nothing recorded has no row."""
    rows = []
    for path in paths:
        version, state = Log(f"{path.rstrip('/')}/log").newest()
        for name, s in sorted(state.get("sequences", {}).items()):
            rows.append((path, name, s["frames"], s["low"], s["high"], s["sum"] / s["count"] if s["count"] else None, s["end_s"], version))
    return spark.createDataFrame(rows, "path string, sequence_id string, frames long, low double, high double, mean double, end_s double, version long")


def assemble(pixels: DataFrame, height: int, width: int, missing: float = math.nan) -> DataFrame:
    """Frames, as they are written, from pixels (sequence_id, frame_idx, time_s, row_idx, col_idx, intensity).

    Pixels outside the frame are an error, as are two of one place when the frame is written; those that are absent have the
    value ``missing``. A frame is one row, so it is what a task must hold.
    """
    inside = F.col("row_idx").between(0, height - 1) & F.col("col_idx").between(0, width - 1)
    place = F.when(inside, (F.col("row_idx") * width + F.col("col_idx")).cast("int")).otherwise(F.raise_error(F.lit(f"a pixel lies outside {height} by {width}")).cast("int"))
    grouped = pixels.groupBy("sequence_id", "frame_idx", "time_s").agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), F.col("intensity").cast("float").alias("value")))).alias("found"))
    empty = lambda n: F.array_repeat(F.lit(missing).cast("float"), n)
    after = lambda k: F.coalesce(F.get("found", k + 1)["place"], F.lit(height * width))
    filled = F.flatten(F.transform("found", lambda p, k: F.concat(F.array(p["value"]), empty(after(k) - p["place"] - 1))))
    values = F.concat(empty(F.get("found", F.lit(0))["place"]), filled)
    return grouped.select("sequence_id", "frame_idx", "time_s", F.lit(height).alias("height"), F.lit(width).alias("width"), values.alias("intensity"))
