"""Synthetic labelled well logs (S5), derived row-for-row from an input table.

Each input row (identified by its key columns) becomes one depth sample: a
class is drawn from the key hash (uniform or with given class weights), every
curve is ``max(0, U(lo, hi) + N(0, 0.05*(hi-lo)))`` and a share of values is
blanked.  All random draws are pure functions of (key, seed), so recomputing a
lost partition gives the same rows; no driver loop, no ``spark.range``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.prepare import order_key

# FIXED VALUES: class ranges (lo, hi) per curve.
CLASSES_5 = {
    "Sandstone": {"GR": (30, 80), "RHOB": (2.0, 2.4), "NPHI": (0.05, 0.25), "RDEP": (10, 1000),
                  "DTC": (80, 120), "PEF": (1.8, 3.0)},
    "Shale": {"GR": (80, 200), "RHOB": (2.2, 2.8), "NPHI": (0.15, 0.45), "RDEP": (1, 20),
              "DTC": (100, 200), "PEF": (2.8, 3.5)},
    "Limestone": {"GR": (10, 60), "RHOB": (2.4, 2.8), "NPHI": (0.0, 0.15), "RDEP": (50, 2000),
                  "DTC": (50, 90), "PEF": (4.5, 5.5)},
    "Dolomite": {"GR": (10, 50), "RHOB": (2.6, 2.9), "NPHI": (0.0, 0.10), "RDEP": (100, 5000),
                 "DTC": (45, 80), "PEF": (2.8, 3.2)},
    "Coal": {"GR": (20, 100), "RHOB": (1.2, 1.8), "NPHI": (0.25, 0.60), "RDEP": (100, 10000),
             "DTC": (120, 300), "PEF": (0.2, 0.8)},
}

CLASSES_12 = {
    "Sandstone": {"GR": (15, 75), "RHOB": (1.95, 2.45), "NPHI": (0.03, 0.28), "RDEP": (8, 1200), "DTC": (55, 105), "PEF": (1.6, 2.9)},
    "Shale": {"GR": (75, 220), "RHOB": (2.15, 2.85), "NPHI": (0.12, 0.48), "RDEP": (0.8, 25), "DTC": (75, 150), "PEF": (2.7, 3.6)},
    "Limestone": {"GR": (8, 65), "RHOB": (2.35, 2.85), "NPHI": (-0.02, 0.18), "RDEP": (40, 6000), "DTC": (45, 85), "PEF": (4.2, 5.8)},
    "Dolomite": {"GR": (5, 55), "RHOB": (2.55, 2.95), "NPHI": (-0.08, 0.12), "RDEP": (80, 12000), "DTC": (40, 80), "PEF": (2.6, 3.4)},
    "Anhydrite": {"GR": (2, 35), "RHOB": (2.75, 3.05), "NPHI": (-0.12, 0.08), "RDEP": (800, 60000), "DTC": (45, 75), "PEF": (4.8, 6.2)},
    "Salt": {"GR": (0, 25), "RHOB": (1.95, 2.25), "NPHI": (-0.12, 0.02), "RDEP": (8000, 120000), "DTC": (60, 90), "PEF": (4.2, 5.8)},
    "Coal": {"GR": (40, 180), "RHOB": (1.1, 1.7), "NPHI": (0.25, 0.85), "RDEP": (80, 15000), "DTC": (90, 220), "PEF": (0.1, 0.9)},
    "Marl": {"GR": (55, 130), "RHOB": (2.25, 2.65), "NPHI": (0.08, 0.32), "RDEP": (3, 120), "DTC": (65, 115), "PEF": (3.2, 4.8)},
    "Sandstone_Shaly": {"GR": (55, 130), "RHOB": (2.05, 2.55), "NPHI": (0.08, 0.32), "RDEP": (3, 250), "DTC": (65, 125), "PEF": (2.0, 3.4)},
    "Limestone_Shaly": {"GR": (35, 110), "RHOB": (2.25, 2.75), "NPHI": (0.03, 0.28), "RDEP": (8, 600), "DTC": (55, 105), "PEF": (3.6, 5.0)},
    "Siltstone": {"GR": (45, 95), "RHOB": (2.1, 2.5), "NPHI": (0.05, 0.25), "RDEP": (5, 300), "DTC": (65, 110), "PEF": (2.2, 3.0)},
    "Mudstone": {"GR": (70, 160), "RHOB": (2.2, 2.7), "NPHI": (0.15, 0.40), "RDEP": (2, 50), "DTC": (80, 130), "PEF": (2.8, 3.4)},
}

# Skewed 5-class mix (class, share).
SKEWED_MIX = [("Sandstone", 0.40), ("Shale", 0.30), ("Limestone", 0.15), ("Dolomite", 0.10), ("Anhydrite", 0.05)]
CLASSES_SKEWED = {
    "Sandstone": {"GR": (20, 80), "RHOB": (2.0, 2.6), "NPHI": (0.05, 0.3), "RDEP": (10, 200), "DTC": (55, 90), "PEF": (1.8, 3.0)},
    "Shale": {"GR": (80, 200), "RHOB": (2.2, 2.8), "NPHI": (0.2, 0.6), "RDEP": (0.5, 10), "DTC": (80, 140), "PEF": (2.8, 3.5)},
    "Limestone": {"GR": (10, 50), "RHOB": (2.6, 2.8), "NPHI": (0.0, 0.2), "RDEP": (50, 1000), "DTC": (47, 70), "PEF": (4.5, 5.5)},
    "Dolomite": {"GR": (10, 40), "RHOB": (2.8, 2.9), "NPHI": (-0.05, 0.15), "RDEP": (100, 2000), "DTC": (43, 65), "PEF": (2.8, 3.2)},
    "Anhydrite": {"GR": (5, 30), "RHOB": (2.9, 3.0), "NPHI": (-0.05, 0.05), "RDEP": (1000, 10000), "DTC": (50, 60), "PEF": (5.0, 5.5)},
}


def _uniform(key_cols, seed: int) -> Column:
    return (order_key(key_cols, seed) + F.lit(0.5)) / F.lit(float(1 << 52))


def _normal(key_cols, seed: int) -> Column:
    u1, u2 = _uniform(key_cols, seed), _uniform(key_cols, seed + 7919)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def synthetic_logs(src: DataFrame, key_cols, classes: dict = CLASSES_5, mix=None, null_rate: float = 0.02,
                   seed: int = 42, well_size: int = 500, target: str = "FORCE_2020_LITHOFACIES_LITHOLOGY") -> DataFrame:
    """One synthetic labelled sample per input row."""
    names = list(classes)
    if mix is None:
        mix = [(n, 1.0 / len(names)) for n in names]
    row = ["__row"]  # one digest of the key; every draw hashes that with its own seed
    src = src.select(*key_cols, F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols]).cast("binary")).alias("__row"))
    u = _uniform(row, seed)
    cls = None
    acc = 0.0
    for i, (name, share) in enumerate(mix):
        acc += share
        cond = u < F.lit(acc) if i < len(mix) - 1 else F.lit(True)
        cls = F.when(cond, F.lit(name)) if cls is None else cls.when(cond, F.lit(name))
    rid = order_key(row, seed).cast("long")
    df = src.withColumn(target, cls).withColumn("__rid", rid)
    curves = list(next(iter(classes.values())))
    cols = {}
    for j, c in enumerate(curves):
        lo_e = hi_e = None
        for name in names:
            lo, hi = classes[name][c]
            cond = F.col(target) == F.lit(name)
            lo_e = F.when(cond, F.lit(float(lo))) if lo_e is None else lo_e.when(cond, F.lit(float(lo)))
            hi_e = F.when(cond, F.lit(float(hi))) if hi_e is None else hi_e.when(cond, F.lit(float(hi)))
        base = lo_e + (hi_e - lo_e) * _uniform(row, seed + 100 + j)
        noise = _normal(row, seed + 200 + j) * (hi_e - lo_e) * F.lit(0.05)
        val = F.greatest(F.lit(0.0), base + noise)
        blank = _uniform(row, seed + 300 + j) < F.lit(null_rate)
        cols[c] = F.when(blank, F.lit(None).cast("double")).otherwise(val)
    out = df.withColumns(cols)
    return out.withColumns({
        "WELL": F.concat(F.lit("SYNTH_WELL_"), (F.col("__rid") % F.lit(max(1, well_size))).cast("string")),
        "DEPTH_MD": F.lit(1500.0) + (F.col("__rid") % F.lit(10_000_000)).cast("double") * F.lit(0.5),
    }).drop("__rid", "__row")
