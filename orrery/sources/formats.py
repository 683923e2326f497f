"""Fixed-record binary files of particles, light cones and halos, as a Spark data source that reads and writes them.

A file is split into ranges of records; a task reads its range with one seek, and gives Arrow batches of declared types. Rows outside the
box that a reader asks for are left out before they become Arrow rows. A writer's task makes a chunk of its partition, and the
chunks get their names when all are done.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import storage

#: Field (name, type, count) of each record in file order; sizes follow from them.
_MOVES = [(c, "f4", 1) for c in ("x", "y", "z", "vx", "vy", "vz", "eps", "phi")]
_FIELDS = {
    "tps": [("mass", "f4", 1), *_MOVES],
    "lcp": [("mass", "f8", 1), *_MOVES],
    "fof": [("x", "f4", 1), ("y", "f4", 1), ("z", "f4", 1), ("pot", "f4", 1), ("dum1", "f4", 3), ("vx", "f4", 1), ("vy", "f4", 1), ("vz", "f4", 1), ("dum2", "f4", 21), ("npart", "i4", 1), ("dum3", "f4", 2)],
}
_TYPES = {"f4": T.FloatType(), "f8": T.DoubleType(), "i4": T.IntegerType()}
#: Columns of each dataset.
DATASETS = {"xvp": ["x", "y", "z", "vx", "vy", "vz"], "xvh": ["x", "y", "z", "vx", "vy", "vz", "npart"], "xp": ["x", "y", "z"]}


@dataclass(frozen=True)
class Format:
    name: str
    header: int
    order: str
    extension: str | None
    sliced: bool
    offset: float

    @property
    def record(self) -> np.dtype:
        return np.dtype([(n, self.order + t, (k,)) if k > 1 else (n, self.order + t) for n, t, k in _FIELDS[self.name]])

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, T.ArrayType(_TYPES[t]) if k > 1 else _TYPES[t]) for n, t, k in _FIELDS[self.name]])

    def rows_in(self, size: int) -> int:
        body, width = size - self.header, self.record.itemsize
        if body < 0 or body % width:
            raise ValueError(f"a {self.name} file of {size} bytes is no header of {self.header} bytes and records of {width}")
        return body // width

    def file_name(self, namespace: str, step: int, chunk: int) -> str:
        base = f"{namespace}.{step:05d}"
        if self.extension:
            return f"{base}.{self.extension}.{chunk}"
        return base if chunk == 0 else f"{base}.{chunk}"


FORMATS = {
    "tps": Format("tps", 32, ">", None, False, -0.5),
    "lcp": Format("lcp", 0, "<", "lcp", True, 0.0),
    "fof": Format("fof", 0, "<", "fofstats", False, -0.5),
}


def format_of(name: str) -> Format:
    if name not in FORMATS:
        raise ValueError(f"Unknown file type {name!r}: one of {sorted(FORMATS)}")
    return FORMATS[name]


def chunk_files(fmt: Format, namespace: str, step: int) -> list[str]:
    """Files of a step: chunks 0, 1, 2 and so on, up to the first gap."""
    there, out = set(storage.beside(f"{namespace}.{step:05d}")), []
    while (path := fmt.file_name(namespace, step, len(out))) in there:
        out.append(path)
    return out


def particle_count(fmt: Format, paths: Sequence[str]) -> int:
    """Records of files by their sizes; nothing is read."""
    return sum(fmt.rows_in(storage.file_size(p) or fmt.header) for p in paths)


def steps_on_disk(namespace: str) -> list[int]:
    found = (re.search(r"\.(\d{5})(?:\.|$)", p[len(namespace) :]) for p in storage.beside(namespace + "."))
    return sorted({int(m[1]) for m in found if m})


@dataclass
class RecordRange(InputPartition):
    path: str
    step: int
    first: int
    count: int


class ParticleSource(DataSource):
    """Options: path (comma separated), type (tps, lcp or fof), step (of each path, comma separated), split (bytes in a range), columns,
    within (low and high of x, y and z, comma separated: rows beyond are left out, those on the edges are kept)."""

    @classmethod
    def name(cls) -> str:
        return "nbody"

    def _wanted(self) -> list[str]:
        names = [f.name for f in format_of(self.options["type"]).schema]
        wanted = [c for c in self.options.get("columns", "").split(",") if c] or names
        if missing := set(wanted) - set(names):
            raise ValueError(f"No such columns: {sorted(missing)}")
        return wanted

    def schema(self) -> T.StructType:
        full = format_of(self.options["type"]).schema
        return T.StructType([full[c] for c in self._wanted()] + [T.StructField("step", T.IntegerType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ParticleReader(dict(self.options), self._wanted())

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ParticleWriter(dict(self.options), schema.names)


class ParticleReader(DataSourceReader):
    def __init__(self, options: dict[str, str], wanted: list[str]):
        self.fmt, self.wanted = format_of(options["type"]), wanted
        self.paths = [p for p in options.get("path", "").split(",") if p]
        steps = [int(s) for s in options.get("step", "").split(",") if s]
        self.steps = steps if len(steps) == len(self.paths) else [steps[0] if steps else 0] * len(self.paths)
        self.split = int(options.get("split", 64 << 20))
        ends = [float(v) for v in options.get("within", "").split(",") if v]
        self.within = list(zip("xyz", ends[::2], ends[1::2], strict=True)) if ends else []

    def partitions(self) -> Sequence[InputPartition]:
        at_once = max(1, self.split // self.fmt.record.itemsize)
        ranges = []
        for path, step in zip(self.paths, self.steps, strict=True):
            rows = self.fmt.rows_in(storage.file_size(path))
            ranges += [RecordRange(path, step, i, min(at_once, rows - i)) for i in range(0, rows, at_once)]
        return ranges or [RecordRange("", 0, 0, 0)]

    def read(self, partition: RecordRange) -> Iterator[pa.RecordBatch]:
        kind, batch = self.fmt.record, 1 << 16
        if not partition.count:
            return
        store, inside = storage.opened(partition.path)
        with store.open_input_file(inside) as f:
            f.seek(self.fmt.header + partition.first * kind.itemsize)
            for done in range(0, partition.count, batch):
                rows = np.frombuffer(f.read(min(batch, partition.count - done) * kind.itemsize), dtype=kind)
                for c, low, high in self.within:
                    rows = rows[(rows[c] >= low) & (rows[c] <= high)]
                columns = {}
                for c in self.wanted:
                    values = rows[c].astype(rows[c].dtype.newbyteorder("="))
                    columns[c] = pa.array(values) if values.ndim == 1 else pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), pa.array(values.ravel()))
                columns["step"] = pa.array(np.full(len(rows), partition.step, dtype=np.int32))
                yield pa.RecordBatch.from_pydict(columns)


@dataclass
class Chunk(WriterCommitMessage):
    partition: int
    path: str
    count: int


class ParticleWriter(DataSourceArrowWriter):
    """Options: path (a namespace), type, step. Fields that the rows don't have are zero."""

    def __init__(self, options: dict[str, str], names: list[str]):
        self.fmt, self.names = format_of(options["type"]), names
        self.namespace, self.step = options["path"], int(options.get("step", 0))
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Chunk:
        from pyspark import TaskContext

        task = TaskContext.get()
        path, count = f"{self.namespace}.part-{self.run}-{task.partitionId()}-{task.taskAttemptId()}", 0
        store, inside = storage.opened(path)
        with store.open_output_stream(inside) as f:
            f.write(struct.pack(">d6i", 0.0, 0, 3, 0, 0, 0, 0)[: self.fmt.header])
            for batch in iterator:
                rows = np.zeros(batch.num_rows, dtype=self.fmt.record)
                for c in set(self.names) & set(self.fmt.record.names):
                    values = batch.column(self.names.index(c))
                    rows[c] = values.to_numpy(zero_copy_only=False) if rows[c].ndim == 1 else np.array(values.to_pylist())
                f.write(rows.tobytes())
                count += batch.num_rows
        return Chunk(task.partitionId(), path, count)

    def commit(self, messages: list[Chunk | None]) -> None:
        done = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        for chunk, m in enumerate(done):
            (store, old), (_, new) = storage.opened(m.path), storage.opened(self.fmt.file_name(self.namespace, self.step, chunk))
            store.move(old, new)

    def abort(self, messages: list[Chunk | None]) -> None:
        for m in messages:
            if m is not None:
                store, path = storage.opened(m.path)
                store.delete_file(path)


def write_records(df: DataFrame, kind: str, namespace: str, step: int) -> None:
    """A chunk file for each partition of df."""
    df.sparkSession.dataSource.register(ParticleSource)
    df.write.format("nbody").option("type", kind).option("step", step).mode("append").save(namespace)


def read_records(spark: SparkSession, kind: str, paths: Sequence[str], steps: Sequence[int] = (), columns: Sequence[str] = (), split: int = 64 << 20, within: Sequence[tuple[float, float]] = ()) -> DataFrame:
    """Rows of binary files; no files give an empty frame with the same schema."""
    spark.dataSource.register(ParticleSource)
    reader = spark.read.format("nbody").option("type", kind).option("split", split).option("columns", ",".join(columns)).option("step", ",".join(map(str, steps)))
    reader = reader.option("within", ",".join(repr(float(v)) for ends in within for v in ends))
    return reader.option("path", ",".join(paths)).load() if paths else reader.load()


def synthetic_particles(spark: SparkSession, n: int, box: float = 1050.0, seed: int = 42) -> DataFrame:
    """n uniform particles in [0, box), made where they are used."""
    from pyspark.sql import functions as F

    top = box * (1 - 1e-6)
    return spark.range(n).select(*[(F.rand(seed + i) * top).cast("float").alias(c) for i, c in enumerate("xyz")], F.lit(1.0).cast("float").alias("mass"))
