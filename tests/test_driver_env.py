"""Queries with Python UDFs must run when the package is not importable on
the Python workers (the driver loads __spark_entry__.py by path, cwd elsewhere)."""

import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = textwrap.dedent(f"""
    import importlib.util, os
    os.chdir("/tmp")
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spec = importlib.util.spec_from_file_location("__spark_entry__", "{REPO}/__spark_entry__.py")
    E = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(E)
    msgs = E.queries()["oob_summary"](spark, "/root/testdata/sf0.001").collect()
    assert all(r["actual_range"] for r in msgs)
    scores = E.queries()["imputation_bakeoff"](spark, "/root/testdata/sf0.001").collect()
    assert all(r["mse"] != float("inf") for r in scores), scores
    print("DRIVER_ENV_OK")
""")


def test_udfs_without_package_on_worker_path():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd="/tmp", env=env, capture_output=True,
                         text=True, timeout=900)
    assert "DRIVER_ENV_OK" in out.stdout, out.stderr[-3000:]
