from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def lines(spark):
    """A street table from lists of points; further columns by name."""
    from wayfold.functions.lines import LINE

    def make(geoms, **cols):
        kinds = {k: ("string" if any(isinstance(x, str) for x in v) else "array<string>" if any(isinstance(x, list) for x in v) else "long") for k, v in cols.items()}
        rows = [(i, [(float(x), float(y)) for x, y in g], *(v[i] for v in cols.values())) for i, g in enumerate(geoms)]
        return spark.createDataFrame(rows, f"street_id long, geom {LINE}" + "".join(f", {k} {t}" for k, t in kinds.items()))

    return make


def coords(rows):
    """Geometries as lists of tuples, rounded."""
    return [[(round(p["x"], 6), round(p["y"], 6)) for p in r["geom"]] for r in rows]
