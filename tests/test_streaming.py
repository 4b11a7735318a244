from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from pricetrail.operators.series import monthly_medians
from pricetrail.sources import tranches
from pricetrail.streaming import live
from tests.helpers import obs, rows

SCHEMA = "observation_id STRING, mpn STRING, seller STRING, amount_minor BIGINT, vat_included BOOLEAN, observed_at TIMESTAMP"

DATA = [(m, s, f"2026-0{1 + i // 4}-{10 + i:02d} 09:00", 100 + 7 * i + len(s), True) for i in range(8) for m in "AB" for s in ("x", "yy")]


@pytest.fixture
def parts(spark, tmp_path):
    """The same observations as three appended files, in time order."""
    df = obs(spark, DATA).select(*[c.split()[0] for c in SCHEMA.split(", ")])
    for n, cond in enumerate(["observed_at < '2026-01-12'", "observed_at >= '2026-01-12' AND observed_at < '2026-02-15'", "observed_at >= '2026-02-15'"]):
        df.where(cond).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part{n}")
    return df, str(tmp_path)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/in/*")


def followed(spark, stream, folder, tranche):
    out = live.follow_lines(stream, tranche)
    live.run_to_end(out.writeStream.format("parquet").option("path", f"{folder}/out"), f"{folder}/checkpoint")
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def test_movements_agree_with_one_batch(spark, parts):
    df, folder = parts
    got = live.line_movements(followed(spark, stream(spark, folder), f"{folder}/m", ()))
    from pyspark.sql import Window

    w = Window.partitionBy("mpn", "seller").orderBy("observed_at")
    want = df.select("mpn", "seller", F.lag("amount_minor").over(w).alias("from_minor"), F.col("amount_minor").alias("to_minor")).where("from_minor IS NOT NULL")
    assert rows(got, "mpn", "seller", "from_minor", "to_minor") == rows(want)


def test_medians_agree_with_one_batch(spark, parts):
    df, folder = parts
    live.run_to_end(live.write_batches(stream(spark, folder), live.monthly_median_writer(spark, f"{folder}/med")), f"{folder}/c2")
    assert rows(live.current_medians(spark, f"{folder}/med")) == rows(monthly_medians(df))


def arrive(spark, folder, parts):
    """One parquet file per part, in order, and the stream over them."""
    for n, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/arrived/part{n}")
    return spark.readStream.schema(parts[0].schema)


def test_backdated_rows_are_refused(spark, tmp_path):
    folder = str(tmp_path)
    first = obs(spark, [("A", "s", "2026-01-05", 1, True), ("B", "s", "2026-01-05", 1, True)])
    second = obs(spark, [("A", "s", "2026-01-04", 2, True), ("A", "s", "2026-01-06", 3, True), ("C", "s", "2026-01-01", 4, True)]).withColumn("observation_id", F.concat(F.lit("n"), "observation_id"))
    s = arrive(spark, folder, [first, second]).option("maxFilesPerTrigger", 1).parquet(f"{folder}/arrived/*")
    got = followed(spark, s, folder, ())
    assert rows(got.where("side = 'refused'"), "amount_minor") == [(2,)]
    assert rows(got.where("side = 'accepted'"), "amount_minor") == [(1,), (1,), (3,), (4,)]


def test_tranche_files_dedup_and_days(spark, tmp_path):
    folder = tmp_path / "batches"
    folder.mkdir()
    for n in (1, 2, 3):
        o = {"observation_id": f"o-{min(n, 2)}", "observed_at": f"2026-01-0{n}T10:00:00Z", "identity": {"mpn_observed": "A"}, "item_price": {"amount_minor": 100 * n}}
        (folder / f"t{n}.json").write_text(json.dumps({"tranche_id": f"t{n}", "created_at": "x", "observations": [o]}))
    flat = live.stream_tranches(spark, str(folder), files_per_batch=10).select(
        "observation_id", F.to_timestamp("observed_at").alias("observed_at"), F.col("identity.mpn_observed").alias("mpn"), F.col("item_price.amount_minor").alias("amount_minor"),
    )
    unique = live.stream_dedup(flat, "3 days")
    live.run_to_end(unique.writeStream.format("parquet").option("path", f"{tmp_path}/out"), f"{tmp_path}/c3")
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "observation_id") == [("o-1",), ("o-2",)]
    days = live.stream_daily(flat, "1 hour")
    schema = days.schema
    live.run_to_end(days.writeStream.format("parquet").option("path", f"{tmp_path}/days"), f"{tmp_path}/c4")
    closed = spark.read.schema(schema).parquet(f"{tmp_path}/days").select(F.col("date").cast("string"), "low_minor", "observation_count")
    assert rows(closed) == [("2026-01-01", 100, 1), ("2026-01-02", 200, 1)]


def test_missed_slots_across_batches(spark, tmp_path):
    folder = str(tmp_path)
    handle = live.missed_slot_writer(spark, folder, 11, 30)
    for n, day in enumerate(["2026-01-01", "2026-01-04", "2026-01-06"]):
        handle(spark.sql(f"SELECT 'r{n}' AS run_id, TIMESTAMP'{day} 12:00:00' AS started_at"), n)
    assert rows(spark.read.parquet(f"{folder}/missed"), "scheduled_for") == [("2026-01-02T11:30:00",), ("2026-01-03T11:30:00",), ("2026-01-05T11:30:00",)]


@pytest.mark.parametrize("cut", [1, 2])
def test_lateness_does_not_depend_on_the_batch_cut(spark, tmp_path, cut):
    folder = str(tmp_path)
    first = obs(spark, [("A", "s", "2026-01-05", 1, True), ("A", None, "2026-01-05", 1, True)]).withColumn("tranche_id", F.lit("t1"))
    second = obs(spark, [("A", "s", "2026-01-04", 2, True), ("A", "s", "2026-01-06", 3, True), ("A", None, "2026-01-05", 4, True)]).withColumns(
        {"tranche_id": F.lit("t2"), "observation_id": F.concat(F.lit("n"), "observation_id")}
    )
    parts = [first.unionByName(second)] if cut == 1 else [first, second]
    got = followed(spark, arrive(spark, folder, parts).option("maxFilesPerTrigger", 1).parquet(f"{folder}/arrived/*"), folder, ["tranche_id"])
    assert rows(got.where("side = 'refused'"), "amount_minor") == [(2,), (4,)]
    assert rows(live.line_movements(got), "from_minor", "to_minor") == [(1, 3)]


@pytest.mark.parametrize("files", [1, 2, 10])
def test_lines_are_followed_alike_at_every_batch_size(spark, tmp_path, files):
    folder = str(tmp_path)
    rng = random.Random(4)
    data = [(t, f"o{t}-{i}", rng.choice(["A", None]), rng.choice(["s", "t"]), rng.choice([1, 2, 3, 4, 5, None]), rng.choice([10, 20, None])) for t in range(4) for i in range(12)]
    # By hand: tranche by tranche, rows of a line in order of time and id.
    newest, reached, want = {}, {}, []
    for t in range(4):
        held = sorted((r for r in data if r[0] == t), key=lambda r: (r[4] is not None, r[4], r[1]))
        for _, o, m, s, day, amount in held:
            good = day is not None and day > reached.get((m, s), 0)
            want.append((o, m, s, amount, "accepted" if good else "refused", *(newest.get((m, s), (None, None)) if good else (None, None))))
            if good:
                newest[m, s] = (o, amount)
        for _, _, m, s, day, _ in held:
            reached[m, s] = max(reached.get((m, s), 0), day or 0)
    schema = "tranche_id INT, observation_id STRING, mpn STRING, seller STRING, day INT, amount_minor LONG"
    parts = [spark.createDataFrame([r for r in data if r[0] == t], schema).withColumn("observed_at", F.timestamp_seconds(F.col("day") * 86400)) for t in range(4)]
    s = arrive(spark, folder, parts).option("maxFilesPerTrigger", files).parquet(f"{folder}/arrived/*")
    got = followed(spark, s, folder, ["tranche_id"]).select("observation_id", "mpn", "seller", "amount_minor", "side", "from_observation_id", "from_minor")
    assert rows(got) == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_tranches_come_back_as_written(spark, tmp_path):
    folder = str(tmp_path / "tranches")
    written = spark.sql("""SELECT * FROM VALUES ('t1', 1), ('t1', 2), ('t2', 3) AS t(tranche_id, n)""").select(
        F.lit(1).alias("schema_version"), "tranche_id", F.lit("candidate_only").alias("scope"), F.concat("tranche_id", F.lit("-at")).alias("created_at"),
        F.struct(F.concat(F.lit("o"), F.col("n").cast("string")).alias("observation_id"), F.when(F.col("n") < 3, F.struct(F.col("n").cast("long").alias("amount_minor"))).alias("item_price"),
                 F.when(F.col("n") == 3, F.struct(F.lit(7).alias("item_price_minor"), F.lit(None).cast("boolean").alias("vat_included"))).alias("price")).alias("o"),
    )
    tranches.write_tranches(written, folder)
    tranches.write_tranches(written.where("tranche_id = 't2'").withColumn("tranche_id", F.lit("t3")), folder)
    got = tranches.read_tranches(spark, folder)
    assert rows(got, "tranche_id", "created_at", "observation_id", "item_price.amount_minor", "price.item_price_minor") == [
        ("t1", "t1-at", "o1", 1, None), ("t1", "t1-at", "o2", 2, None), ("t2", "t2-at", "o3", None, 7), ("t3", "t2-at", "o3", None, 7)]
    assert got.select("source_file").distinct().count() == 3
    s = live.stream_tranches(spark, folder, files_per_batch=1)
    live.run_to_end(s.select("tranche_id", "observation_id").writeStream.format("parquet").option("path", f"{tmp_path}/o"), f"{tmp_path}/c")
    assert rows(spark.read.parquet(f"{tmp_path}/o")) == [("t1", "o1"), ("t1", "o2"), ("t2", "o3"), ("t3", "o3")]
