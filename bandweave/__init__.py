"""Spectral, embedding and regression table jobs for PySpark DataFrames."""

TARGETS = ("P", "K", "Mg", "pH")

# Upper end of each target's range, used to scale targets to 0-1.
TARGET_MAXIMA = {"P": 325.0, "K": 625.0, "Mg": 400.0, "pH": 7.8}

# Mean of each target over the published training set (sum / 1731).
FIXED_BASELINE = {
    "P": 121764.2 / 1731.0,
    "K": 394876.1 / 1731.0,
    "Mg": 275875.1 / 1731.0,
    "pH": 11747.67 / 1731.0,
}

# Edge limits and labels of the field-size report, intervals (lo, hi].
SIZE_EDGES = (0, 11, 40, 50, 100, 110, 120, 130, 210)
SIZE_LABELS = ("0-11", "11-40", "40-50", "50-100", "100-110", "110-120", "120-130", "130+")

# Fixed value: fields up to this mean edge count as small.
SMALL_EDGE = 11

# Fixed value: divisor that brings raw reflectance near 0-1.
VALUE_SCALE = 2210.0
