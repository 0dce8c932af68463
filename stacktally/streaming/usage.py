"""Usage of tasks from a stream of profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from stacktally import model as m
from stacktally.operators import profiles as p
from stacktally.plans import hotspots


LANDED = m.USAGE + ", arrived TIMESTAMP"


def usage_writer(
    profiles: DataFrame, registrations: DataFrame, path: str, rejected_path: str | None = None,
    arrived: Column | None = None,
) -> DataStreamWriter:
    """Turns each micro-batch of profiles into usage rows below ``path``.

    Invalid profiles do not stop a batch; they can be kept in a second table. A
    batch that is run again after a failure overwrites its own folder. Usage ``arrived`` when it is
    written, unless told otherwise.
    """
    arrived = F.current_timestamp() if arrived is None else arrived

    def handle(batch: DataFrame, batch_id: int) -> None:
        folder = f"batch={batch_id}"
        parsed = p.parse_once(batch)
        usage = hotspots.parsed_usage(parsed, registrations)
        usage.withColumn("arrived", arrived).write.mode("overwrite").parquet(f"{path}/{folder}")
        if rejected_path is not None:
            parsed.rejected.write.mode("overwrite").parquet(f"{rejected_path}/{folder}")

    return profiles.writeStream.foreachBatch(handle)


def stream_usage(spark: SparkSession, path: str) -> DataFrame:
    """Landed usage with the time it ``arrived``."""
    return spark.readStream.schema(LANDED).option("recursiveFileLookup", "true").parquet(path)
