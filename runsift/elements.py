"""Element dimension (fixed values): number, mass, electronegativity, radius in pm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENTS = {
    "H": (1, 1.008, 2.20, 53.0),
    "Li": (3, 6.94, 0.98, 167.0),
    "C": (6, 12.011, 2.55, 67.0),
    "N": (7, 14.007, 3.04, 56.0),
    "O": (8, 15.999, 3.44, 48.0),
    "F": (9, 18.998, 3.98, 42.0),
    "Na": (11, 22.990, 0.93, 190.0),
    "Mg": (12, 24.305, 1.31, 145.0),
    "Al": (13, 26.982, 1.61, 118.0),
    "Si": (14, 28.085, 1.90, 111.0),
    "P": (15, 30.974, 2.19, 98.0),
    "S": (16, 32.06, 2.58, 88.0),
    "K": (19, 39.098, 0.82, 243.0),
    "Ca": (20, 40.078, 1.00, 194.0),
    "Ti": (22, 47.867, 1.54, 176.0),
    "V": (23, 50.942, 1.63, 171.0),
    "Fe": (26, 55.845, 1.83, 156.0),
    "Co": (27, 58.933, 1.88, 152.0),
    "Ni": (28, 58.693, 1.91, 149.0),
    "Cu": (29, 63.546, 1.90, 145.0),
    "Zn": (30, 65.38, 1.65, 142.0),
    "As": (33, 74.922, 2.18, 114.0),
    "Sr": (38, 87.62, 0.95, 219.0),
    "Mo": (42, 95.95, 2.16, 190.0),
    "Ag": (47, 107.868, 1.93, 165.0),
    "I": (53, 126.904, 2.66, 140.0),
    "Ba": (56, 137.327, 0.89, 253.0),
    "W": (74, 183.84, 2.36, 193.0),
    "Pt": (78, 195.084, 2.28, 177.0),
    "Au": (79, 196.967, 2.54, 174.0),
    "Pb": (82, 207.2, 2.33, 154.0),
}
TRANSITION_METALS = (
    "Sc", "Ti", "V", "Cr", "Mn", "Fe", "Co", "Ni", "Cu", "Zn",
    "Y", "Zr", "Nb", "Mo", "Tc", "Ru", "Rh", "Pd", "Ag", "Cd",
    "Hf", "Ta", "W", "Re", "Os", "Ir", "Pt", "Au", "Hg",
)
METALS = (
    "Li", "Na", "Mg", "Al", "K", "Ca", "Sc", "Ti", "V", "Cr", "Mn", "Fe",
    "Co", "Ni", "Cu", "Zn", "Sr", "Mo", "Ag", "Ba", "W", "Pt", "Au", "Pb",
)
HEAVY_FROM = 56

SYMBOLS = sorted(ELEMENTS)
PROPERTIES = ("number", "mass", "electronegativity", "radius")


def lookup(position: int) -> Column:
    """Map literal from symbol to one property."""
    pairs = [F.lit(x) for s, row in ELEMENTS.items() for x in (s, float(row[position]))]
    return F.create_map(*pairs)


def element_table(spark: SparkSession) -> DataFrame:
    rows = [(s, row[0], *map(float, row[1:]), s in METALS, s in TRANSITION_METALS) for s, row in ELEMENTS.items()]
    return spark.createDataFrame(
        rows, "symbol string, atomic_number int, atomic_mass double, electronegativity double, radius_pm double, "
              "is_metal boolean, is_transition boolean")
