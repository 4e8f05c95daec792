"""Focal operators: the same over small tiles, nulls, empty tables, repeated columns; mending against brute force."""

import numpy as np
import pytest

from sylva.operators import rasters

SHAPE = "r int, c int, h double"


@pytest.fixture(scope="module")
def px(spark):
    rng = np.random.default_rng(8)
    h = np.round(rng.random((40, 37)) * 12)
    h[rng.random(h.shape) < 0.1] = np.nan
    rows = [(int(r), int(c), None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(h) if (r * 7 + c) % 11]
    return spark.createDataFrame(rows, SHAPE).cache()


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("operator", ["mend", "steepest", "climb", "gradient", "smoothed", "tops", "passes"])
def test_tiles_do_not_matter(px, spark, operator):
    run = {
        "mend": rasters.mend, "steepest": rasters.steepest, "gradient": rasters.gradient, "climb": lambda p, tile=1024: rasters.climb(p, lambda d: d.cache(), tile=tile),
        "smoothed": lambda p, tile=1024: rasters.gradient(p, 1.5, tile), "tops": lambda p, tile=1024: rasters.window_tops(p, 3.0, 0.2, tile=tile), "passes": lambda p, tile=1024: rasters.passes(p, rasters.climb(p, lambda d: d.cache()), tile=tile),
    }[operator]
    whole, parts = run(px), run(px, tile=13)
    if operator == "smoothed":
        a, b = ({(r.r, r.c): r.slope for r in d.collect()} for d in (whole, parts))
        assert a.keys() == b.keys() and all(x is b[k] is None or abs(x - b[k]) < 1e-9 for k, x in a.items())
    else:
        assert rows(whole) == rows(parts) and len(rows(whole)) > 20
    assert run(px.limit(0)).isEmpty()


def test_mend(px):
    have = {(r.r, r.c): r.h for r in px.collect()}
    want = {}
    for r in range(-1, 41):
        for c in range(-1, 38):
            around = [v for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (v := have.get((r + a, c + b))) is not None]
            h = have.get((r, c))
            if h is None:
                if len(around) >= 6 or (r, c) in have:
                    want[r, c] = float(np.median(around)) if len(around) >= 6 else None
            else:
                pit = sum(v > h + 1.5 for v in around) >= 6 and np.median(around) - h > 1.5
                want[r, c] = float(np.median(around)) if pit else h
    assert {(r.r, r.c): r.h for r in rasters.mend(px).collect()} == want


def test_tall_window(spark):
    """The window follows the highest pixel there is."""
    flat = spark.createDataFrame([(0, c, 140.0 if c == 0 else 141.0 if c == 3 else 1.0) for c in range(6)], SHAPE)
    assert {(r.c) for r in rasters.window_tops(flat, 1.0, 0.05).collect() if r.h > 100} == {3}


def test_wide_raster(spark):
    wide = spark.createDataFrame([(0, 100_000, 1.0), (0, 100_001, 2.0)], SHAPE)
    with pytest.raises(Exception, match="a column outside"):
        rasters.passes(wide, rasters.climb(wide)).collect()
