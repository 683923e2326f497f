"""Gridding of a stream of particles: the grid of all particles so far is an aggregation state; grids and spectra of it are tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.grid import to_grid
from orrery.operators.spectrum import binned


def stream_grid(stream: DataFrame, ngrid: int, box: float, assignment: str = "ngp") -> DataFrame:
    """The streaming grid; sums don't depend on how the particles come in batches."""
    return to_grid(stream, ngrid, box, assignment)


def _each_batch(cells: DataFrame, folder: str, made: Callable[[DataFrame], DataFrame]) -> int | None:
    """Runs a stream to its end; `made` of the whole grid behind each batch goes to a table of its own. Gives the last batch's number."""
    done: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        made(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")  # a batch that is run again replaces its table
        done.append(number)

    query = cells.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}-log").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return done[-1] if done else None


def grid_to_table(stream: DataFrame, ngrid: int, box: float, assignment: str, folder: str) -> DataFrame:
    """All that has come so far, gridded: runs the stream to its end and gives the final grid, a table below `folder`."""
    spark: SparkSession = stream.sparkSession
    cells = stream_grid(stream, ngrid, box, assignment)
    last = _each_batch(cells, folder, lambda batch: batch)
    return spark.createDataFrame([], cells.schema) if last is None else spark.read.schema(cells.schema).parquet(f"{folder}/batch={last}")


def spectra_to_table(stream: DataFrame, ngrid: int, box: float, assignment: str, folder: str) -> DataFrame:
    """(batch, bin, k, p, n_modes): the spectrum of all particles so far, behind each batch."""
    spark: SparkSession = stream.sparkSession
    schema = "bin int, k double, p double, n_modes long"
    last = _each_batch(stream_grid(stream, ngrid, box, assignment), folder, lambda batch: binned(batch, ngrid, box))
    if last is None:
        return spark.createDataFrame([], "batch int, " + schema)
    return spark.read.schema(schema + ", batch int").parquet(folder).select("batch", *[f.split(" ")[0] for f in schema.split(", ")])


def latest(spectra: DataFrame) -> DataFrame:
    """The spectrum behind the last batch."""
    last = spectra.agg(F.max("batch").alias("batch"))
    return spectra.join(F.broadcast(last), "batch").drop("batch")  # one row
