"""Radar detection and the model store against numpy."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from strataflow.operators import learning, radar
from strataflow.plans import raster
from strataflow.plans.learning import _features

SF = "/root/testdata/sf0.001"


def smooth(z, radius):
    p = np.pad(z, radius, mode="edge")
    n, m = z.shape
    return sum(p[i : i + n, j : j + m] for i in range(2 * radius + 1) for j in range(2 * radius + 1)) / (2 * radius + 1) ** 2


def lee(z, radius=2, looks=4.4):
    mean = smooth(z, radius)
    var = np.maximum(smooth(z * z, radius) - mean * mean, 0)
    seen = var / np.maximum(mean * mean, 1e-9)
    return mean + np.clip((seen - 1 / looks) / np.maximum(seen, 1e-9), 0, 1) * (z - mean)


def otsu(values, bins=256):
    counts, edges = np.histogram(values, bins)
    at, p = (edges[:-1] + edges[1:]) / 2, counts / counts.sum()
    omega, mu = np.cumsum(p), np.cumsum(p * at)
    ok = (omega > 0) & (omega < 1 - 1e-12)
    apart = np.where(ok, (mu[-1] * omega - mu) ** 2 / np.where(ok, omega * (1 - omega), 1), 0)
    k = int(np.argmax(apart))
    spread = ((at - mu[-1]) ** 2 * p).sum()
    return at[k], min(apart[k] / spread, 1.0) if spread > 0 else 0.0


def test_thresholds(spark):
    r = np.random.default_rng(1)
    groups = [np.concatenate([r.normal(-20, 1, 400), r.normal(-9, 2, 700)]), r.uniform(0, 1, 500), np.full(7, 3.0), np.array([1.0, 2.0])]
    rows = [(d, float(v)) for d, g in enumerate(groups) for v in g] + [(0, None), (0, float("nan")), (0, float("inf")), (9, None)]
    got = {x["district"]: x for x in radar.otsu(spark.createDataFrame(rows, "district long, v double"), "v").collect()}
    assert set(got) == {0, 1, 2, 3}
    for d, g in enumerate(groups):
        cut, sep = otsu(g)
        assert got[d]["cut"] == pytest.approx(cut) and got[d]["separability"] == pytest.approx(sep, abs=1e-9)


def test_detection_against_numpy(spark):
    cells = raster.scene(spark, SF).cache()
    got = {(x["district"], x["r"], x["c"]): x for x in radar.detect(cells).collect()}
    found = 0
    for d in range(4):
        rows = cells.where(f"district = {d}").collect()
        layer = {n: np.zeros((40, 40), bool if n in ("stream", "sea") else float) for n in ("before", "after", "slope", "hand", "stream", "sea")}
        for x in rows:
            for n, z in layer.items():
                z[x["r"], x["c"]] = x[n]
        after, before = lee(layer["after"]), lee(layer["before"])
        (cut, sep), (was, _) = otsu(after.ravel()), otsu(before.ravel())
        near = np.minimum(np.abs(after - min(cut, -13)), np.abs(before - after - 2.5))
        near = np.minimum(near, np.abs(before - min(was, -13))) < 1e-7  # where rounding decides
        permanent = (before <= min(was, -13)) & (layer["stream"] | layer["sea"])
        flood = (after <= min(cut, -13)) & (before - after >= 2.5) & ~permanent & (layer["slope"] <= 12) & (layer["hand"] <= 25) & ~layer["sea"]
        trust = "low" if cut > -13 else "high" if sep >= radar.HIGH else "moderate" if sep >= radar.MODERATE else "low"
        for r, c in zip(*np.nonzero(~near)):
            x = got[d, r, c]
            assert (x["flood"], x["permanent"], x["confidence"]) == (flood[r, c], permanent[r, c], trust)
        found += flood.sum() + permanent.sum()
    assert found


def test_a_saved_model_scores_alike(spark, tmp_path):
    names = ["v", "blur", "slope"]
    rows = _features(spark, SF).withColumn("wet", F.col("blur") > 25)
    model, report = learning.water_classifier(rows, names, "wet", [3], trees=5, depth=4)
    assert learning.load(spark, str(tmp_path), "water") is None
    for _ in range(2):
        learning.save(model, names, report, str(tmp_path), "water")
    again, features, card = learning.load(spark, str(tmp_path), "water")
    assert features == names and card.first().asDict() == {k: v for k, v in report.first().asDict().items() if v is not None}
    key = lambda df: sorted((x["district"], x["r"], x["c"], x["prediction"]) for x in df.collect())
    assert key(learning.score(again, features, rows)) == key(learning.score(model, names, rows))
    weights = learning.importances(again, features, spark).collect()
    assert {x["feature"] for x in weights} == set(names) and sum(x["importance"] for x in weights) == pytest.approx(1)
    assert [x["importance"] for x in weights] == sorted((x["importance"] for x in weights), reverse=True)


def test_local_statistics(spark):
    z = np.random.default_rng(2).normal(0, 5, (11, 9))
    df = spark.createDataFrame([(0, r, c, float(z[r, c])) for r in range(11) for c in range(9)], "district long, r long, c long, v double")
    for x in learning.local_statistics(df, "v").collect():
        near = np.pad(z, 2, mode="edge")[x["r"] : x["r"] + 5, x["c"] : x["c"] + 5]
        assert x["local_mean"] == pytest.approx(near.mean()) and x["local_std"] == pytest.approx(near.std(), abs=1e-6)


def test_baseline(spark):
    rows = [(3, float(v), v < 5) for v in [*range(5), *range(20, 30), 4, 21]] + [(1, 0.0, True)]
    got = learning.cut_baseline(spark.createDataFrame(rows, "district long, v double, wet boolean"), "v", "wet", [3]).first()
    assert (got["precision"], got["recall"], got["f1"], got["n"]) == (1.0, 1.0, 1.0, 17)
