import numpy as np
import pandas as pd
import pytest

from chronoloom.functions.series import compute
from chronoloom.specs import parse_all
from chronoloom.streaming.processors import expanding_stream, sliding_stream

NAMES = ["mean", "median", "autocorr-2", "entropy", "mean_change", "spectral_centroid"]
SCHEMA = "series_id string, pos int, v double"


@pytest.fixture()
def parts(tmp_path):
    rng = np.random.default_rng(1)
    series = {k: rng.normal(size=30) for k in "ab"}
    for n, (lo, hi) in enumerate(((0, 7), (7, 9), (9, 30))):
        rows = [(k, p, x[p]) for k, x in series.items() for p in range(lo, hi)]
        rows += [("a", 0, 99.0)] * (n > 0)  # late
        d = tmp_path / f"in/{n}"
        d.parent.mkdir(exist_ok=True)
        pd.DataFrame(rows, columns=["series_id", "pos", "v"]).sample(frac=1, random_state=n).astype({"pos": "int32"}).to_parquet(f"{d}.parquet")
    return series, str(tmp_path / "in"), str(tmp_path / "state")


def run(spark, out, name, state):
    q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", state).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def source(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_expanding(spark, parts):
    series, path, state = parts
    specs = parse_all(NAMES)
    rows = run(spark, expanding_stream(source(spark, path), NAMES), "grown", state)
    assert max(r["n_points"] for r in rows) == 30 and {r["series_id"] for r in rows} == {"a", "b"}
    for r in rows:
        assert [r[s.name] for s in specs] == pytest.approx(compute(series[r["series_id"]][: r["n_points"]], specs, "expanding"))


def test_spectra_may_wait(spark, parts):
    series, path, state = parts
    rows = run(spark, expanding_stream(source(spark, path), ["mean", "spectral_centroid"], fft_update_period=10), "waited", state)
    specs = parse_all(["spectral_centroid"])
    seen = 0  # files come in order, with 7, 2 and 21 points
    for r in sorted((r for r in rows if r["series_id"] == "a"), key=lambda r: r["n_points"]):
        seen = r["n_points"] if not seen or r["n_points"] - seen >= 10 else seen
        assert r["spectral_centroid"] == pytest.approx(compute(series["a"][:seen], specs, "expanding")[0])


@pytest.mark.parametrize("window,stride", [(8, 3), (4, 6)])
def test_sliding(spark, parts, window, stride):
    series, path, state = parts
    specs = parse_all(NAMES)
    rows = run(spark, sliding_stream(source(spark, path), NAMES, window, stride), f"slid{window}", state)
    assert sorted((r["series_id"], r["window_id"]) for r in rows) == [(k, w) for k in "ab" for w in range((30 - window) // stride + 1)]
    for r in rows:
        at = r["window_id"] * stride
        assert [r[s.name] for s in specs] == pytest.approx(compute(series[r["series_id"]][at : at + window], specs, "sliding"))
