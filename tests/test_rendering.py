"""Colours against image arithmetic in numpy's single precision."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.operators import rendering as D

NAMES = (*D.CHANNELS, "alpha")


def steps(stops, n=256):
    at = np.linspace(0, n - 1, len(stops))
    columns = [np.interp(np.arange(n), at, [D.rgb(s)[c] for s in stops]).astype(np.float32) for c in range(3)]
    return np.clip(np.stack(columns, 1), 0, 255).astype(np.uint8)


def laid(base, top):
    b, t = base.astype(np.float32) / 255.0, top.astype(np.float32) / 255.0
    ta, ba = t[..., 3:4], b[..., 3:4]
    alpha = ta + ba * (1 - ta)
    mixed = (t[..., :3] * ta + b[..., :3] * ba * (1 - ta)) / np.maximum(alpha, 1e-6)
    return np.clip(np.concatenate([mixed, alpha], -1) * 255, 0, 255).astype(np.uint8)


def pixels(df, column):
    rows = df.orderBy("i").select(*[F.col(f"{column}.{n}").alias(n) for n in NAMES]).collect()
    return np.array([[r[n] for n in NAMES] for r in rows], np.uint8)


@pytest.mark.parametrize("name", sorted(D.RAMPS))
def test_every_step_of_a_ramp(spark, name):
    df = spark.range(256).select(F.col("id").alias("i"), D.colourise(F.col("id").cast("double"), name, 0.0, 255.0).alias("p"))
    assert np.array_equal(pixels(df, "p")[:, :3], steps(D.RAMPS[name]))


def test_values_masks_and_opacity(spark):
    r = np.random.default_rng(1)
    rows = [(i, float(v), float(a), bool(m)) for i, (v, a, m) in enumerate(zip(r.normal(5, 6, 300), r.uniform(-0.2, 1.2, 300), r.random(300) < 0.6))]
    df = spark.createDataFrame([*rows, (300, None, 0.5, True)], "i long, v double, a double, m boolean")
    got = pixels(df.select("i", D.colourise(F.col("v"), "risk", 0.0, 10.0, F.col("a"), F.col("m")).alias("p")), "p")
    v, a, m = (np.array(x) for x in list(zip(*rows))[1:])
    want = np.zeros((300, 4), np.uint8)
    want[:, :3] = steps(D.RAMPS["risk"])[(np.clip(v / 10, 0, 1) * 255).astype(np.uint8)]
    want[:, 3] = np.where(m, (np.clip(a, 0, 1) * 255).astype(np.uint8), 0)
    assert np.array_equal(got[:300], want) and not got[300].any()
    assert D.rgb("#4E9BC9") == (78, 155, 201)


def test_layers_lie_in_their_order(spark):
    r = np.random.default_rng(2)
    colours = r.integers(0, 256, (400, 3, 4))
    colours[:40, 1, 3], colours[20:60, 0, 3], colours[60:80, 2, 3] = 0, 0, 255
    schema = "i long, " + ", ".join(f"l{k} {D.COLOUR}" for k in range(3))
    df = spark.createDataFrame([(i, *(tuple(int(x) for x in layer) for layer in c)) for i, c in enumerate(colours)], schema)
    c = colours.astype(np.uint8)
    assert np.array_equal(pixels(df.select("i", D.over(F.col("l0"), F.col("l1")).alias("p")), "p"), laid(c[:, 0], c[:, 1]))
    layers = [F.col(f"l{k}") for k in range(3)]
    assert np.array_equal(pixels(df.select("i", D.flatten(layers).alias("p")), "p"), laid(laid(c[:, 0], c[:, 1]), c[:, 2]))
    turned = pixels(df.select("i", D.flatten(layers[::-1]).alias("p")), "p")
    assert np.array_equal(turned, laid(laid(c[:, 2], c[:, 1]), c[:, 0])) and not np.array_equal(turned, pixels(df.select("i", D.flatten(layers).alias("p")), "p"))
    assert np.array_equal(pixels(df.select("i", D.flatten(layers[:1]).alias("p")), "p"), c[:, 0])


def test_channels_by_what_they_drain(spark):
    cells = spark.createDataFrame([(0, r, c, float(r * 5 + c)) for r in range(5) for c in range(5)], "district long, r long, c long, n double")
    minor, major = D.tiers("n", 2.0)
    got = {(x["r"], x["c"]): (x["minor"], x["major"]) for x in cells.select("r", "c", minor.alias("minor"), major.alias("major")).collect()}
    assert got == {(r, c): (2 <= r * 5 + c < 16, r * 5 + c >= 16) for r in range(5) for c in range(5)}
    wide = {(x["r"], x["c"]) for x in D.dilate(cells, "n = 12", "wide").where("wide").collect()}
    assert wide == {(2, 2), (1, 2), (3, 2), (2, 1), (2, 3)}
