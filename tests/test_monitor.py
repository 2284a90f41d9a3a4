"""The windowed monitor over a stream of files: shares by window, and rows that come too late."""

import datetime

from plumbline.streaming.refinement import monitor


def test_windows_and_late_rows(spark, tmp_path):
    at = lambda minute: datetime.datetime(2024, 1, 1, 10, minute)
    schema = "ts timestamp, query_id long, refined boolean"
    batches = [[(at(1), 1, True), (at(2), 2, False), (at(6), 3, True)], [(at(30), 4, True)], [(at(32), 9, False)], [(at(3), 5, True), (at(31), 6, False), (at(59), 7, True)], [(at(59), 8, True)]]
    for k, rows in enumerate(batches):  # one file a batch, in order of their names
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in/{k}")
    query = (
        monitor(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(f"{tmp_path}/in"))
        .selectExpr("window.start AS start", "answers", "refined_share")
        .writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {r["start"].minute: (r["answers"], r["refined_share"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    # the window at minute 55 is still open; the row of minute 3 came a batch after the watermark had reached minute 20
    assert got == {0: (2, 0.5), 5: (1, 1.0), 30: (3, round(1 / 3, 16))}
