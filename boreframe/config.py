"""Configuration: curve names, physical bounds, label vocabularies, aliases.

Everything here is overridable by passing another ``LogConfig`` to the
operators.  The values marked FIXED VALUES must stay equal to the behaviour we
reproduce (bounds, label lists, code table, alias tables, literal texts).
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reproduced behaviour; plain text, natural order)
# ---------------------------------------------------------------------------

# Feature curves, in the order used for issue text and model inputs.
FEATURES = ["GR", "RHOB", "NPHI", "RDEP", "DTC", "PEF"]

# Default target column and the ordered list of alternative target names.
TARGET = "FORCE_2020_LITHOFACIES_LITHOLOGY"
TARGET_CANDIDATES = ["FORCE_2020_LITHOFACIES_LITHOLOGY", "Lithology", "LITHOLOGY", "lithology"]

# Physical bounds, inclusive: (min, max, text used in issue rows).
# The text keeps the way the numbers are written (int vs float).
BOUNDS = {
    "GR": (0.0, 300.0, "0", "300"),
    "RHOB": (1.0, 3.5, "1.0", "3.5"),
    "NPHI": (-0.1, 1.0, "-0.1", "1.0"),
    "RDEP": (0.1, 10000.0, "0.1", "10000"),
    "DTC": (40.0, 300.0, "40", "300"),
    "PEF": (0.5, 10.0, "0.5", "10.0"),
    "DEPTH_MD": (0.0, 10000.0, "0", "10000"),
}

# Expected rock-type labels for the invalid-label check.
EXPECTED_LABELS = ["Sandstone", "Shale", "Limestone", "Dolomite",
                   "Anhydrite", "Salt", "Coal", "Marl", "Mudstone"]

# Numeric label codes and the names they stand for.
LABEL_CODES = {
    "65000": "Sandstone",
    "30000": "Shale",
    "70000": "Limestone",
    "65030": "Sandstone_Shaly",
    "80000": "Dolomite",
    "88000": "Anhydrite",
    "70032": "Limestone_Shaly",
    "74000": "Marl",
    "86000": "Salt",
    "99000": "Coal",
}

# Batch alias table: keys compared after lower() + strip().
BATCH_ALIASES = {
    "gamma": "GR", "gamma_ray": "GR", "gr": "GR",
    "density": "RHOB", "bulk_density": "RHOB", "rhob": "RHOB", "den": "RHOB",
    "neutron": "NPHI", "neutron_porosity": "NPHI", "nphi": "NPHI", "neu": "NPHI",
    "resistivity": "RDEP", "deep_resistivity": "RDEP", "rdep": "RDEP", "res": "RDEP",
    "dt": "DTC", "delta_time": "DTC", "dtc": "DTC", "sonic": "DTC",
    "pe": "PEF", "photoelectric": "PEF", "pef": "PEF",
}

# Interactive alias table: keys compared after strip() only (case-sensitive).
INTERACTIVE_ALIASES = {
    "gamma": "GR", "gamma_ray": "GR", "gr": "GR", "GAMMA": "GR", "GAMMA_RAY": "GR",
    "density": "RHOB", "bulk_density": "RHOB", "rhob": "RHOB", "den": "RHOB",
    "DENSITY": "RHOB", "BULK_DENSITY": "RHOB", "DEN": "RHOB",
    "neutron": "NPHI", "neutron_porosity": "NPHI", "nphi": "NPHI", "neu": "NPHI",
    "NEUTRON": "NPHI", "NEUTRON_POROSITY": "NPHI", "NEU": "NPHI",
    "resistivity": "RDEP", "deep_resistivity": "RDEP", "rdep": "RDEP", "res": "RDEP",
    "RESISTIVITY": "RDEP", "DEEP_RESISTIVITY": "RDEP", "RES": "RDEP",
    "dt": "DTC", "delta_time": "DTC", "dtc": "DTC", "sonic": "DTC",
    "DT": "DTC", "DELTA_TIME": "DTC", "SONIC": "DTC",
    "pe": "PEF", "photoelectric": "PEF", "pef": "PEF", "photo": "PEF",
    "PE": "PEF", "PHOTOELECTRIC": "PEF", "PHOTO": "PEF",
}

# Tokens read as missing in text inputs (the usual CSV missing markers).
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
               "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
               "n/a", "nan", "null"]

# CSV separators and encodings probed, in this order.
SEPARATORS = [",", ";", "\t", "|"]
ENCODINGS = ["utf-8", "latin-1", "cp1252"]

# Literal texts written into annotated outputs.
PIPELINE_VERSION = "Enhanced_v2.0"
DATASET_VERSION = "Processed_With_Quality_Tracking_v1.0"
PROCESSING_METHOD = "Median_Imputation_StandardScaler"
OUTLIER_TREATMENT = "Preserved_For_Geological_Validity"
SIMPLE_TECHNIQUES_TEXT = "Median Imputation; StandardScaler"
OUTLIER_NOTE = "Outliers preserved for geological validity"
LOW_CONFIDENCE_LABEL = "LOW_CONFIDENCE"

# Recommendations: mark and sentence by kind and severity, and the percentages
# above which a severity holds, worst first.
RECOMMEND = {
    "missing": {
        "high": ("🔴", "% missing values. Consider removing this feature or finding alternative data."),
        "moderate": ("🟡", "% missing values. Review data collection for this parameter."),
        "info": ("ℹ️", "% missing values. Consider imputation strategies."),
    },
    "bounds": {
        "high": ("🚨", "% values outside expected range. Check data calibration and quality."),
        "moderate": ("⚠️", "% values outside expected range. Review outliers and data collection."),
    },
    "overall": {
        "high": "🔴 High data quality issues (>30%). Extensive cleaning required.",
        "moderate": "🟡 Moderate data quality issues (>10%). Data cleaning recommended.",
        "good": "✅ Good data quality. Suitable for machine learning.",
    },
}
RECOMMEND_LEVELS = {"missing": [("high", 50), ("moderate", 20), ("info", 5)], "bounds": [("high", 10), ("moderate", 1)]}

# Outlier rule parameters.
IQR_FACTOR = 1.5
ZSCORE_THRESHOLD = 3.0
MODIFIED_Z_FACTOR = 0.6745

# Row score deductions.
SCORE_NULL_PENALTY = 30
SCORE_OUTLIER_PENALTY = 20
SCORE_PER_ISSUE = 10
SCORE_ISSUE_CAP = 50
SIMPLE_SCORE_PER_NULL = 10

# Confidence bands: (upper edge, label), right-closed, lower edge of the first is 0 (open).
CONFIDENCE_BANDS4 = [(0.5, "Low (0-0.5)"), (0.7, "Medium (0.5-0.7)"),
                     (0.9, "High (0.7-0.9)"), (1.0, "Very High (0.9-1.0)")]
CONFIDENCE_CATEGORIES3 = [(0.6, "Low_Confidence"), (0.8, "Medium_Confidence"),
                          (1.0, "High_Confidence")]
CONFIDENCE_CATEGORIES3_SHORT = [(0.6, "Low"), (0.8, "Medium"), (1.0, "High")]
# Left-closed counts: label, lower edge (inclusive), upper edge (exclusive).
CONFIDENCE_COUNTS3 = [("High (≥0.8)", 0.8, None), ("Medium (0.6-0.8)", 0.6, 0.8),
                      ("Low (<0.6)", None, 0.6)]

# Missing-value status marks for the profile.
STATUS_OK, STATUS_WARN, STATUS_BAD = "✅", "⚠️", "❌"


@dataclass(frozen=True)
class LogConfig:
    """Column roles for one well-log table."""

    features: tuple = tuple(FEATURES)
    target: str = TARGET
    well: str = "WELL"
    depth: str = "DEPTH_MD"
    bounds: dict = field(default_factory=lambda: dict(BOUNDS))
    expected_labels: tuple = tuple(EXPECTED_LABELS)
    label_codes: dict = field(default_factory=lambda: dict(LABEL_CODES))
    # Columns that identify a row; used for deterministic ordering/hashing.
    key: tuple = ("WELL", "DEPTH_MD")

    def present_features(self, columns) -> list:
        cols = set(columns)
        return [f for f in self.features if f in cols]
