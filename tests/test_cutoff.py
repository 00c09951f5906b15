import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from repspark.kernels.linkage import density_valley
from repspark.operators.clonotypes import automatic_cutoff


def _spelled(values, floor):
    """The formula over a list of all values."""
    x = np.asarray(values, dtype=float)
    sd = x.std(ddof=1)
    width = 0.9 * min(sd, (np.percentile(x, 75) - np.percentile(x, 25)) / 1.34 or sd) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 512)
    hist, edges = np.histogram(x, bins=2048)
    dens = (np.exp(-0.5 * ((grid[:, None] - (edges[1:] + edges[:-1]) / 2) / width) ** 2) * hist).sum(axis=1)
    peak = np.flatnonzero((dens[1:-1] > dens[:-2]) & (dens[1:-1] >= dens[2:])) + 1
    return floor if len(peak) < 2 else max(floor, float(grid[peak[0] + int(np.argmin(dens[peak[0] : peak[1] + 1]))]))


def test_counts_stand_for_repeated_values():
    rng = random.Random(8)
    for n in (3, 10, 500):
        x = [round(rng.choice([rng.gauss(0.1, 0.03), rng.gauss(0.6, 0.08)]), 2) for _ in range(n)] + [0.0, 0.9]
        some = sorted(set(x))
        rng.shuffle(some)
        assert density_valley(some, 0.01, [x.count(v) for v in some]) == pytest.approx(_spelled(x, 0.01))
    assert density_valley([0.1], 0.2, [5000]) == 0.2 and density_valley([], 0.2, []) == 0.2


def test_cutoff_of_a_large_run_follows_the_true_counts(spark):
    counts = {50: 40_000, 51: 300, 150: 1, 300: 200, 301: 1, 400: 1, 500: 9_000, 501: 70, 620: 1, 700: 1}
    df = spark.createDataFrame(list(counts.items()), "b int, n int").select(F.explode(F.expr("array_repeat(b / 1000D, n)")).alias("distance"))
    want = _spelled([b / 1000 for b, n in counts.items() for _ in range(n)], 0.2)
    scale = max(counts.values()) // 2000
    assert abs(_spelled([b / 1000 for b, n in counts.items() for _ in range(-(-n // scale))], 0.2) - want) > 0.001
    assert automatic_cutoff(df) == pytest.approx(want)
