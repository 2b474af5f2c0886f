"""Queries that write and read back, on a cluster whose shared folder is named without a scheme."""

from __future__ import annotations

import json
import os
import subprocess
import sys

ROWS = {"history_partitions": None, "sink_csv_roundtrip": "lineitem", "sink_json_roundtrip": "lineitem", "sink_parquet_roundtrip": "lineitem",
        "stream_dedupe": None, "stream_restart": "part", "ml_save_load": "part", "ml_score": None}
RUN = """
import functools, json, os, sys
from pyspark.sql import SparkSession
folder, sf, names = sys.argv[1], sys.argv[2], sys.argv[3:]
spark = (SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1")
         .config("spark.executorEnv.PYTHONPATH", os.environ["PYTHONPATH"]).config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "2")
         .config("spark.sql.warehouse.dir", folder + "/warehouse").config("spark.checkpoint.dir", folder + "/shared").getOrCreate())
from souba.operators import features
from souba.plans import all_queries
features.fit_price_model = functools.partial(features.fit_price_model, max_iter=2)      # what a model learns is tested elsewhere
found = {n: all_queries()[n](spark, sf).count() for n in names}
found["tables"] = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("lineitem", "part")}
with open(folder + "/found", "w") as out:
    json.dump(found, out)
os._exit(0)
"""


def test_queries_that_write_and_read_back_run_on_a_cluster(tmp_path):
    """F2 F4 F5 F7 F8 F9 F10 F11"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "PYTHONPATH": root, "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", RUN, str(tmp_path), "/root/testdata/sf0.001", *ROWS], env=env, capture_output=True, text=True, timeout=600)
    assert (tmp_path / "found").exists(), run.stderr[-3000:]
    found = json.loads((tmp_path / "found").read_text())
    assert all(found[n] > 0 for n in ROWS)
    assert {n: found[n] for n, t in ROWS.items() if t} == {n: found["tables"][t] for n, t in ROWS.items() if t}
