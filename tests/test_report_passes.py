"""How often the reports read their input: what is read again is written first."""

from pyspark.sql import functions as F

from lodemark.operators import reports

N = 400


def counted(spark, df):
    """df, and an accumulator of the rows that tasks have read of it."""
    read = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), read


def test_sites_are_read_for_their_means_and_their_residuals(spark):
    rows = spark.range(N).select((F.col("id") % 9).alias("site_id"), *[(F.col("id") * k % 20).cast("double").alias(c) for k, c in ((3, "e"), (7, "n"), (11, "bearing_deg"))], (2 + F.col("id") % 30).cast("double").alias("dep_deg"), F.lit(6656).alias("pano_height"))
    members, read = counted(spark, rows)
    assert reports.site_diagnosis(members).count() == 4 and read.value == 2 * N


def test_fidelity_reads_labels_for_rates_and_for_misses(spark):
    i = F.col("id")
    turned = F.when(i % 3 == 0, 5.0).otherwise(0.0)
    rows = spark.range(N).select(
        F.concat(F.lit("c"), i % 2).alias("city"), (i % 40).alias("pano_id"), (i % 360).cast("double").alias("pov_heading"), F.lit(0.0).alias("pov_pitch"), F.lit(180.0).alias("camera_heading"),
        F.lit(360).alias("pano_width"), F.lit(180).alias("pano_height"), ((i + turned) % 360).cast("double").alias("stored_x"), F.lit(90.0).alias("stored_y"), F.lit(None).cast("timestamp_ntz").alias("time_created"),
    )
    labels, read = counted(spark, rows)
    found = reports.replay_fidelity(labels, ["city"], "2021-01-01").collect()
    assert len(found) == 2 and all(r["n_panos_off"] == 20 for r in found) and read.value == 2 * N
