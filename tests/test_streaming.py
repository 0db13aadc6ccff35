"""The streaming CPUE state equals the batch flagship on the same shot-log files."""

import os
import uuid

from pyspark.sql import functions as F

from raremetrics.plans import flagship
from raremetrics.session import scratch_path
from raremetrics.sources import logbook, tables
from raremetrics.streaming import logbook_stream

SF = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark):
    folder = scratch_path(spark, f"stream_in_{uuid.uuid4().hex}")
    shots = tables.shots(spark, SF)
    # two files arriving separately
    logbook.write_shot_log_csv(shots.filter(F.col("shot_id") % 2 == 0), os.path.join(folder, "a"))
    logbook.write_shot_log_csv(shots.filter(F.col("shot_id") % 2 == 1), os.path.join(folder, "b"))
    name = f"cpue_{uuid.uuid4().hex[:8]}"
    q = (logbook_stream.cpue_state(logbook_stream.shot_log_stream(spark, os.path.join(folder, "*")))
         .writeStream.outputMode("complete").format("memory").queryName(name)
         .option("checkpointLocation", scratch_path(spark, f"ckpt_{name}")).start())
    q.processAllAvailable()
    q.stop()
    got = {(r.species, r.yr): (r.n, round(r.mean, 6), round(r.sd, 6) if r.sd is not None else None)
           for r in logbook_stream.cpue_from_state(spark.table(name)).collect()}
    exp = {(r.species, r.yr): (r.n, round(r["mean"], 6), round(r.sd, 6) if r.sd is not None else None)
           for r in flagship.nominal_cpue(spark, SF).collect()}
    assert got == exp
