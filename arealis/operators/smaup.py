"""S-MAUP: sensitivity of a variable to the modifiable areal unit problem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Critical values of the statistic by level, autocorrelation (rows, as in
# RHO) and number of areas (columns, as in AREAS).
AREAS = [25, 100, 225, 400, 625, 900]
RHO = [-0.9, -0.7, -0.5, -0.3, 0, 0.3, 0.5, 0.7, 0.9]
CRITICAL = {
    "01": [
        [0.83702, 0.09218, 0.23808, 0.05488, 0.07218, 0.02621],
        [0.83676, 0.16134, 0.13402, 0.06737, 0.05486, 0.02858],
        [0.83597, 0.16524, 0.13446, 0.06616, 0.06247, 0.02851],
        [0.83316, 0.19276, 0.13396, 0.0633, 0.0609, 0.03696],
        [0.8237, 0.17925, 0.15514, 0.07732, 0.07988, 0.09301],
        [0.76472, 0.23404, 0.2464, 0.11588, 0.10715, 0.0707],
        [0.67337, 0.28921, 0.25535, 0.13992, 0.12975, 0.09856],
        [0.52155, 0.47399, 0.29351, 0.23923, 0.20321, 0.1625],
        [0.28599, 0.28938, 0.4352, 0.4406, 0.34437, 0.55967],
    ],
    "05": [
        [0.83699, 0.08023, 0.10962, 0.04894, 0.04641, 0.02423],
        [0.83662, 0.12492, 0.08643, 0.059, 0.0428, 0.02459],
        [0.83578, 0.13796, 0.08679, 0.05927, 0.0426, 0.02658],
        [0.78849, 0.16932, 0.08775, 0.05464, 0.04787, 0.03042],
        [0.81952, 0.15746, 0.11126, 0.06961, 0.06066, 0.05234],
        [0.70466, 0.21088, 0.1536, 0.09766, 0.07938, 0.06461],
        [0.59461, 0.23497, 0.18244, 0.11682, 0.10129, 0.0886],
        [0.48958, 0.37226, 0.2228, 0.2054, 0.16144, 0.14123],
        [0.2158, 0.22532, 0.27122, 0.29043, 0.23648, 0.31424],
    ],
    "1": [
        [0.69331, 0.06545, 0.07858, 0.04015, 0.03374, 0.02187],
        [0.79421, 0.09566, 0.06777, 0.05058, 0.03392, 0.02272],
        [0.689, 0.10707, 0.07039, 0.05151, 0.03609, 0.02411],
        [0.73592, 0.14282, 0.07076, 0.04649, 0.04001, 0.02614],
        [0.71632, 0.13621, 0.08801, 0.06112, 0.04937, 0.03759],
        [0.63718, 0.18239, 0.12101, 0.08324, 0.06347, 0.05549],
        [0.46548, 0.17541, 0.14248, 0.10008, 0.08137, 0.07701],
        [0.3472, 0.28774, 0.1817, 0.16442, 0.13395, 0.12354],
        [0.1764, 0.18835, 0.21695, 0.23031, 0.19435, 0.22411],
    ],
}
#: Upper and lower bounds of the open intervals of rho that take a row; what lies on a
#: bound or outside takes the first row.
BOUNDS = [(0.8, 1.0, 8), (0.6, 0.8, 7), (0.4, 0.6, 6), (0.15, 0.4, 5), (-0.15, 0.15, 4), (-0.4, -0.15, 3), (-0.6, -0.4, 2), (-0.8, -0.6, 1)]


def _critical(table: list[list[float]], row: Column, n: Column) -> Column:
    values = F.get(F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in table]), row)
    out = F.get(values, F.lit(0))
    for i in range(1, len(AREAS)):
        a, b = AREAS[i - 1], AREAS[i]
        low, high = F.get(values, F.lit(i - 1)), F.get(values, F.lit(i))
        out = F.when(n > a, low + (high - low) * (n - a) / float(b - a)).otherwise(out)
    return out


def smaup(rows: DataFrame, n: str = "n", k: str = "k", rho: str = "rho") -> DataFrame:
    """Add smaup, critical_01, critical_05, critical_1, a summary and clamped (n was moved
    into 25-900, the range that the critical values cover)."""
    areas = F.greatest(F.lit(25.0), F.least(F.lit(900.0), F.col(n).cast("double")))
    theta, r = F.col(k) / areas, F.col(rho)
    level = 1 / (1 + F.exp(-2.2 + theta * 7.03))
    eta = F.exp(F.lit(-0.6618)) * F.pow(theta, F.lit(1.3))
    row = F.lit(0)
    for lo, hi, i in BOUNDS:
        row = F.when((r > lo) & (r < hi), i).otherwise(row)
    out = rows.withColumn("smaup", level / (1 + eta * F.exp(r * (-5.53 * theta + 5.32))))
    out = out.withColumns({f"critical_{a}": _critical(t, row, areas) for a, t in CRITICAL.items()})
    s = F.col("smaup")
    text = F.when(s > F.col("critical_01"), "p < 0.01").when(s > F.col("critical_05"), "p < 0.05").when(s > F.col("critical_1"), "p < 0.10").otherwise("p > 0.10")
    return out.withColumn("summary", text).withColumn("clamped", areas != F.col(n))
