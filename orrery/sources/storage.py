"""Files of any store that Arrow can open: plain paths are local, others have a scheme (file, hdfs, s3, gs)."""

from __future__ import annotations

import tempfile

from pyarrow import fs
from pyspark.sql import SparkSession


def _local(path: str) -> str:
    """file:/a/b and file:///a/b as /a/b."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it)."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), _local(path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def file_size(path: str) -> int | None:
    """Bytes of a file; none if there is no such file."""
    store, inside = opened(path)
    info = store.get_file_info(inside)
    return info.size if info.type == fs.FileType.File else None


def beside(path: str) -> list[str]:
    """Paths of the files in the folder of `path` whose names start as it does."""
    store, inside = opened(path)
    folder, _, start = inside.rpartition("/")
    found = store.get_file_info(fs.FileSelector(folder or ".", allow_not_found=True))
    return sorted(path[: len(path) - len(start)] + f.base_name for f in found if f.type == fs.FileType.File and f.base_name.startswith(start))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, `spark.checkpoint.dir`; a temporary one only where the session has no executors of its own."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="orrery-"))
        root = sc._jsc.sc().getCheckpointDir().get()
    return _local(root).rstrip("/")
