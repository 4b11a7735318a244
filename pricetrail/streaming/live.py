"""Batch rules as streams over appended batch files.

Stateless and windowed rules use Structured Streaming's own operators. Rules
that compare a line with its own past keep one value per line in keyed state.
The others run per micro-batch against a versioned table: batch n reads version
n-1 and writes version n, so a batch repeated after a failure writes the same
rows again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pricetrail import schemas
from pricetrail.functions.money import basis_points, direction
from pricetrail.operators.audit import unserved_slots
from pricetrail.operators.series import monthly_medians


def stream_tranches(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Observations of batch files as they are appended to a folder."""
    raw = (
        spark.readStream.schema(schemas.TRANCHE).option("multiLine", True).option("maxFilesPerTrigger", files_per_batch).json(path)
    )
    return raw.select("tranche_id", "created_at", F.explode("observations").alias("o")).select("tranche_id", "created_at", "o.*")


def stream_dedup(obs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First sight of every observation id; state lives as long as the watermark."""
    return obs.withWatermark("observed_at", delay).dropDuplicatesWithinWatermark(["observation_id"])


def stream_daily(obs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Low, high and count per product and closed UTC day."""
    days = obs.withWatermark("observed_at", delay).groupBy(F.window("observed_at", "1 day"), "mpn").agg(
        F.min("amount_minor").alias("low_minor"), F.max("amount_minor").alias("high_minor"), F.count(F.lit(1)).alias("observation_count")
    )
    return days.select(F.to_date("window.start").alias("date"), "mpn", "low_minor", "high_minor", "observation_count")


def run_to_end(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process everything present, then stop."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def write_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    return stream.writeStream.foreachBatch(handle)


class VersionedTable:
    """A table written whole per micro-batch under v=<batch>; readers take one version."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def before(self, batch: int) -> DataFrame:
        if batch == 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={batch - 1}")

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={batch}")


LINE = ["mpn", "seller"]


TRANCHE_ORDER = ("created_at", "tranche_id")

#: What a line keeps between micro-batches: its newest row.
LINE_STATE = "at LONG, observation_id STRING, amount_minor LONG"
FOLLOWED = "mpn STRING, seller STRING, observation_id STRING, at LONG, amount_minor LONG, side STRING, from_observation_id STRING, from_minor LONG"


def line_follower(tranche: Sequence[str]) -> StatefulProcessor:
    """Keyed state of one line: every row's side, and the row it follows.

    Rows are taken tranche by tranche, and inside one in time order. A row not
    later than all rows of earlier tranches is refused and moves nothing; an
    accepted row follows the newest accepted one, wherever that arrived.
    """

    order = [*tranche, "at", "observation_id"]
    follows = Row(*[c.split()[0] for c in FOLLOWED.split(", ")])

    class Follower(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.newest = handle.getValueState("newest", LINE_STATE)

        def handleInputRows(self, key: tuple, rows: Iterator[Row], timer_values: object) -> Iterator[Row]:  # noqa: N802
            # A line has few rows in a micro-batch, so plain values cost less than a table of them.
            old = self.newest.get()
            top, prior = (None, (None, None)) if old is None else (old[0], (old[1], old[2]))
            reached, mark, moved = top, None, False
            for row in sorted(rows, key=lambda r: [(r[c] is not None, r[c]) for c in order]):
                here = [row[c] or "" for c in tranche]
                if here != mark:
                    # The newest time of all tranches before the row's own.
                    reached, mark = top, here
                at = row["at"]
                accepted = at is not None and (reached is None or at > reached)
                top = at if top is None else top if at is None else max(top, at)
                told = (row["mpn"], row["seller"], row["observation_id"], at, row["amount_minor"])
                yield follows(*told, "accepted", *prior) if accepted else follows(*told, "refused", None, None)
                if accepted:
                    newest, prior, moved = at, (row["observation_id"], row["amount_minor"]), True
            if moved:
                self.newest.update((newest, *prior))

        def close(self) -> None:
            pass

    return Follower()


def follow_lines(obs: DataFrame, tranche: Sequence[str] = TRANCHE_ORDER) -> DataFrame:
    """Each row of a stream with its side and, if accepted, the row of its line that it follows.

    State is one value per line in the RocksDB store: a micro-batch reads and
    writes the lines it touches and no others, old versions go with the store's
    own snapshots, and a repeated micro-batch starts from the same version.
    With `tranche` the answer does not depend on how many files a micro-batch
    holds, as long as files come in the tranches' order; with none, a micro-batch
    is one tranche. A task holds the rows of one line and micro-batch. Rows
    without a time are refused; lines may have null keys.
    """
    spark = obs.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = obs.select(*LINE, "observation_id", F.unix_micros("observed_at").alias("at"), "amount_minor", *[F.col(c).cast("string") if i else F.col(c) for i, c in enumerate(tranche)])
    followed = rows.groupBy(*LINE).transformWithState(line_follower(tranche), FOLLOWED, "Append", "None")
    return followed.select(*LINE, "observation_id", F.timestamp_micros("at").alias("observed_at"), "amount_minor", "side", "from_observation_id", "from_minor")


def line_movements(followed: DataFrame) -> DataFrame:
    """Change of each accepted row against the row it follows."""
    change = F.col("amount_minor") - F.col("from_minor")
    return followed.where("side = 'accepted' AND from_observation_id IS NOT NULL").select(
        *LINE, "from_observation_id", F.col("observation_id").alias("to_observation_id"), "from_minor", F.col("amount_minor").alias("to_minor"),
        change.alias("change_minor"), basis_points(change, F.col("from_minor")).alias("change_basis_points"), direction(change).alias("direction"),
    )


def missed_slot_writer(spark: SparkSession, folder: str, hour: int, minute: int) -> Callable[[DataFrame, int], None]:
    """Slots without a run between the last run known before a batch and the runs in it.

    Only the last run is kept between batches: one row.
    """
    known = VersionedTable(spark, f"{folder}/last_run", "run_id STRING, started_at TIMESTAMP")

    def handle(batch: DataFrame, number: int) -> None:
        runs = known.before(number).unionByName(batch.select("run_id", "started_at"))
        missed = unserved_slots(runs, hour, minute).withColumn("state", F.lit("unobserved_no_run"))
        missed.write.mode("overwrite").parquet(f"{folder}/missed/batch={number}")
        latest = runs.agg(F.max(F.struct("started_at", "run_id")).alias("r")).select("r.run_id", "r.started_at").where("started_at IS NOT NULL")
        known.write(latest, number)

    return handle


def monthly_median_writer(spark: SparkSession, folder: str) -> Callable[[DataFrame, int], None]:
    """Medians are recomputed for the (product, month) pairs a batch touches.

    Rows are kept partitioned by month, so a batch reads back only its months;
    a reader takes the newest batch per pair through `current_medians`.
    """
    columns = ["mpn", "seller", "observed_at", "observation_id", "amount_minor", "vat_included"]

    def handle(batch: DataFrame, number: int) -> None:
        month = F.date_format("observed_at", "yyyy-MM")
        batch.select(*columns, month.alias("month_id"), F.lit(number).alias("batch")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("month_id", "batch").parquet(f"{folder}/rows")
        touched = batch.select("mpn", month.alias("month_id")).distinct()
        kept = spark.read.parquet(f"{folder}/rows").where(F.col("batch") <= number).join(touched, ["mpn", "month_id"], "left_semi")
        monthly_medians(kept).write.mode("overwrite").parquet(f"{folder}/medians/batch={number}")

    return handle


def current_medians(spark: SparkSession, folder: str) -> DataFrame:
    """Newest recomputation of every (product, month)."""
    every = spark.read.parquet(f"{folder}/medians")
    return every.groupBy("mpn", "month").agg(F.max(F.struct("batch", "median_minor")).alias("r")).select("mpn", "month", "r.median_minor")

