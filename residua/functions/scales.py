"""Published residue scales and groups, and sums over them.

All scales are kept as integers (the published value times ``SCALE``), so that
a sum over a sequence is exact in whatever order it is taken, and only the one
division at the end rounds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard residues.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"

# Residue groups of the composition descriptors, in their order.
GROUPS = {
    "PCP_PC": "KRH", "PCP_NC": "DE", "PCP_NE": "ACFGILMNPQSTVWY", "PCP_PO": "CDEHKNQRSTWY", "PCP_NP": "AFGILMPV",
    "PCP_AL": "ILVA", "PCP_CY": "P", "PCP_AR": "FHWY", "PCP_AC": "DE", "PCP_BS": "KRH", "PCP_NE_pH": "ACFGILMNPQSTVWY",
    "PCP_HB": "NQSTYCWHDEKR", "PCP_HL": "DEKRHNQ", "PCP_NT": "ACGPSTWY", "PCP_HX": "FILMV", "PCP_SC": "",
    "PCP_SS_HE": "EALMQKRH", "PCP_SS_ST": "VITYFWC", "PCP_SS_CO": "GNPDS", "PCP_SA_BU": "ACFILMVW", "PCP_SA_EX": "DEHKNQR",
    "PCP_SA_IN": "GPSTY", "PCP_TN": "ACGS", "PCP_SM": "ACDGNPSTV", "PCP_LR": "EFHIKLMQRWY",
}

# Secondary-structure groups of the physical summary.
HELIX, TURN, SHEET = "EMALK", "NPGSD", "VIYFWLT"

# Hydropathy (Kyte and Doolittle), times 10, in the order of RESIDUES.
HYDROPATHY = dict(zip(RESIDUES, (18, 25, -35, -35, 28, -4, -32, 45, -39, 38, 19, -35, -16, -35, -45, -8, -7, 42, -9, -13)))

# Aggregation propensity, times 10.
AGGREGATION = dict(zip(RESIDUES, (1, 5, -12, -12, 15, -3, -5, 13, -10, 11, 8, -4, -15, -3, -10, -2, 0, 10, 12, 9)))

# Antigenic propensity (Kolaskar and Tongaonkar), times 1000; others count 1000.
ANTIGENIC = dict(zip(RESIDUES, (1064, 1412, 866, 851, 1091, 874, 1105, 1152, 930, 1250, 826, 776, 1064, 1015, 952, 1012, 909, 1383, 893, 923)))

# Average residue masses (free amino acid), times 10000, and water.
MASS = dict(zip(RESIDUES, (890932, 1211582, 1331027, 1471293, 1651891, 750666, 1551546, 1311729, 1461876, 1311729, 1492113, 1321179, 1151305, 1461445, 1742010, 1050926, 1191192, 1171463, 2042252, 1811885)))
WATER = 180153

# Five z-scales (Sandberg and others), times 100, as used by the composition descriptors.
Z_COMPOSITION = {
    "A": (7, -173, 9, -186, -25), "C": (71, -97, 413, 202, -78), "D": (364, 113, -107, 7, 148), "E": (308, 39, -7, 88, 194),
    "F": (-492, 130, 45, 54, -18), "G": (223, -536, 30, -393, 22), "H": (241, 174, 111, -18, -11), "I": (-444, -168, -103, -98, -27),
    "K": (284, 141, -314, 21, 154), "L": (-419, -103, -98, -55, -17), "M": (-249, -27, -41, 4, -22), "N": (322, 145, 84, 81, 99),
    "P": (-122, 88, 223, -151, -101), "Q": (218, 53, -114, 79, 153), "R": (288, 252, -344, -20, 113), "S": (196, -163, 57, -160, 27),
    "T": (92, -209, -140, -116, -17), "V": (-269, -253, -129, -149, -39), "W": (-475, 365, 85, 65, -19), "Y": (-139, 232, 1, 38, -83),
}

# pK of charged groups (Bjellqvist), and of terminal groups by residue.
PK_POSITIVE = {"Nterm": 7.5, "K": 10.0, "R": 12.0, "H": 5.98}
PK_NEGATIVE = {"Cterm": 3.55, "D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}
PK_CTERM = {"D": 4.55, "E": 4.75}
PK_NTERM = {"A": 7.59, "M": 7.0, "S": 6.93, "P": 8.36, "T": 6.82, "V": 7.44, "E": 7.7}


def count_sql(letters: str, sequence: str = "sequence") -> str:
    """Number of residues of ``sequence`` that are among ``letters``, as SQL of either engine."""
    if not letters:
        return "0"
    return f"(length({sequence}) - length(translate({sequence}, '{letters}', '')))"


def sum_sql(scale: dict[str, int], sequence: str = "sequence") -> str:
    """Exact integer sum of a scale over a sequence: residues of equal value are counted together."""
    by_value: dict[int, str] = {}
    for residue, value in scale.items():
        if value:
            by_value[value] = by_value.get(value, "") + residue
    return "(" + " + ".join(f"({v}) * {count_sql(r, sequence)}" for v, r in sorted(by_value.items())) + ")"


def rounded(value: str, digits: int) -> str:
    """Half up to ``digits``, by operations that any engine does alike, where ``round`` treats ties differently."""
    return f"(floor(({value}) * {10**digits}e0 + 0.5e0) / {10**digits}e0)"


def mean_sql(scale: dict[str, int], unit: int, digits: int, sequence: str = "sequence") -> str:
    """Rounded mean of a scale, ``unit`` being the factor of the integer table."""
    return rounded(f"CAST({sum_sql(scale, sequence)} AS DOUBLE) / ({unit} * nullif(length({sequence}), 0))", digits)


def fraction_sql(letters: str, digits: int = 3, sequence: str = "sequence") -> str:
    return rounded(f"CAST({count_sql(letters, sequence)} AS DOUBLE) / nullif(length({sequence}), 0)", digits)


def counted(letters: str, sequence: str = "sequence") -> Column:
    return F.expr(count_sql(letters, sequence))
