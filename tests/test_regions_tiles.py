"""Regions by tiles against flooding; a long winding region takes a few passes, not one for each stretch of it."""

import random

from sylva.operators import regions


def flooded(px, offsets, alike):
    out, steps = {}, [*offsets, *[(-a, -b) for a, b in offsets]]
    for p in sorted(px):
        if p in out:
            continue
        out[p], todo = p, [p]
        while todo:
            r, c = todo.pop()
            for a, b in steps:
                q = (r + a, c + b)
                if q in px and q not in out and (not alike or px[q] == px[r, c]):
                    out[q] = p
                    todo.append(q)
    return out


def test_tiles_against_flooding(spark):
    rng = random.Random(4)
    px = {(r, c): rng.choice(["a", "b", None]) for r in range(-9, 14) for c in range(-12, 15) if rng.random() < 0.62}
    df = spark.createDataFrame([(r, c, k) for (r, c), k in px.items()], "r int, c int, k string")
    for corners, same, tile in ((False, None, 5), (True, None, 4), (False, "k", 6), (True, None, 512)):
        got = {(x.r, x.c): tuple(x.root) for x in regions.components(df, lambda d: d.localCheckpoint(), corners, same, tile).collect()}
        assert got == flooded(px, regions.CORNERS if corners else regions.SIDES, same)


def test_winding_region_takes_few_passes(spark):
    px = [(r, c) for r in range(41) for c in range(40) if r % 2 == 0 or c == (39 if r % 4 == 1 else 0)]
    cuts = []
    got = regions.components(spark.createDataFrame(px, "r int, c int"), lambda d: cuts.append(1) or d.localCheckpoint()).collect()
    assert len(got) == len(px) and {tuple(x.root) for x in got} == {(0, 0)}
    assert len(cuts) <= 3


def test_no_pixels(spark):
    assert regions.components(spark.createDataFrame([], "r int, c int"), lambda d: d.localCheckpoint()).collect() == []
