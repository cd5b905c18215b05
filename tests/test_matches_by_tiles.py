"""Squares of pictures are looked for in other pictures by tiles: right over seams, gaps and bright pictures, without a row for each offset and pixel."""

import numpy as np
import pytest

from cutloom import plans
from cutloom.operators import pixels as P


def rows_of(pictures):
    return [(f, x, y, None if np.isnan(v) else float(v)) for f, p in pictures.items() for (y, x), v in np.ndenumerate(p)]


def plainly(pictures, pairs, half, radius, width, height):
    out = {}
    for f, g, point, x, y in pairs:
        if not (half <= x < width - half and half <= y < height - half):
            continue
        for dy in range(-radius, radius + 1):
            for dx in range(-radius, radius + 1):
                u, v = x + dx, y + dy
                if half <= u < width - half and half <= v < height - half:
                    a, b = (p[r - half : r + half + 1, c - half : c + half + 1].ravel() for p, r, c in ((pictures[f], y, x), (pictures[g], v, u)))
                    both = ~np.isnan(a) & ~np.isnan(b)
                    a, b = a[both] - np.median(a[both]), b[both] - np.median(b[both])
                    flat = min(a.std(), b.std()) <= 1e-6
                    out[f, g, point, dx, dy] = 0.0 if flat else np.corrcoef(a, b)[0, 1]
    return out


@pytest.mark.parametrize("bright", [0.0, 1e7])
def test_seams_gaps_and_bright_pictures(spark, bright):
    rng = np.random.default_rng(13)
    pictures = {k: rng.uniform(0, 1, (40, 70)) + bright for k in (5, 6)}
    pictures[6][10:20, 25:40] = bright + 0.5  # without contrast
    pictures[5][31, 33] = np.nan
    pictures[6][33, 30] = np.nan
    pairs = [(5, 6, 1, 32, 32), (5, 6, 2, 3, 3), (6, 5, 1, 64, 8), (5, 6, 3, 31, 14), (5, 6, 4, 2, 3), (5, 5, 1, 66, 36)]
    light = spark.createDataFrame(rows_of(pictures), "frame long, x long, y long, v double").repartition(3)
    got = P.correlate(light, spark.createDataFrame(pairs, "frame long, to_frame long, point long, x long, y long"), "v", 3, 4, 70, 40).collect()
    want = plainly(pictures, pairs, 3, 4, 70, 40)
    assert {tuple(r)[:5] for r in got} == set(want) and len(got) == len(want)
    assert max(abs(r.score - want[tuple(r)[:5]]) for r in got) < (1e-6 if bright else 1e-12)


def test_missing_pictures_and_repeated_pixels(spark):
    rng = np.random.default_rng(14)
    pictures = {k: rng.uniform(0, 1, (8, 8)) for k in (0, 1)}
    pairs = [(0, 1, 1, 3, 4), (1, 2, 1, 3, 4)]  # there is no picture 2
    kinds = "frame long, to_frame long, point long, x long, y long"
    once = spark.createDataFrame(rows_of(pictures), "frame long, x long, y long, v double")
    got = [sorted(map(tuple, P.correlate(light, spark.createDataFrame(pairs, kinds), "v", 1, 2, 8, 8).collect())) for light in (once, once.unionByName(once))]
    assert [r[:5] for r in got[0]] == sorted(plainly(pictures, pairs[:1], 1, 2, 8, 8)) and np.allclose(got[0], got[1], atol=1e-12)


def test_no_row_for_each_offset_and_pixel(spark):
    out = plans.QUERIES["px_match"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1  # pairs with tiles
