import numpy as np
import pyarrow as pa
import pytest

from chronoloom.functions.series import compute
from chronoloom.operators.extract import ExpandingExtractor, Extractor, SlidingExtractor, expanding, extract, sliding, tumbling
from chronoloom.sources.frames import from_arrays, from_csv, from_long, from_wide, pad, synthetic
from chronoloom.specs import PLAIN, parse_all

NAMES = [
    *PLAIN, "quantile-0.3", "c3-0", "c3-1", "c3-2", "paa-6-4", "paa-3-0", "autocorr-1", "autocorr-3", "partial_autocorr-1", "partial_autocorr-4", "time_reversal_asymmetry-2", "fft_coeff-2-real", "fft_coeff-2-imag", "fft_coeff-9-abs",
    "approx_entropy-2-0.5", "agg_linear_trend-slope-3-mean", "agg_linear_trend-intercept-3-max", "agg_linear_trend-stderr-2-min", "agg_linear_trend-rvalue-2-var", "agg_linear_trend-pvalue-2-var", "index_mass_quantile-0.5",
    "max_langevin_fixed_point-3-30", "mean_n_absolute_max-3", "mean_n_absolute_max-0", "wavelet-1-0", "wavelet-1-1", "spectrogram-1-2",
]
RNG = np.random.default_rng(3)
SERIES = {
    "one": [2.5], "two": [1.0, -1.0], "three": [3.0, 1.0, 2.0], "four": [1.0, 2.0, 2.0, 5.0], "five": [1.0, 2.0, 3.0, 4.0, 5.0], "constant": [4.0] * 9, "zeros": [0.0] * 6, "up": list(np.arange(12.0)), "down": list(-np.arange(12.0)),
    "alternating": [1.0, -1.0] * 7, "digits": [0.3, 0.07, 100.0, 20.5, 9.99, 1000.0, 0.001, 6.0], "noise": RNG.normal(size=41).round(3).tolist(), "ties": RNG.integers(-2, 3, 30).astype(float).tolist(), "long": RNG.normal(size=90).cumsum().tolist(),
}


@pytest.fixture(scope="module")
def frame(spark):
    return from_arrays(spark.createDataFrame([(k, [float(v) for v in x]) for k, x in SERIES.items()], "id string, x array<double>"), "id", "x")


def close(got, want, name, tolerance=1e-7):
    assert got == pytest.approx(want, rel=tolerance, abs=tolerance), name


@pytest.mark.parametrize("textbook", [False, True])
def test_static(frame, textbook):
    specs = parse_all(NAMES)
    rows = extract(frame, NAMES, textbook=textbook).collect()
    assert len(rows) == len(SERIES) and rows[0].__fields__ == ["series_id", *(s.name for s in specs)]
    for r in rows:
        for s, want in zip(specs, compute(np.array(SERIES[r["series_id"]]), specs, "static", textbook)):
            close(r[s.name], want, (r["series_id"], s.name))


def test_each_feature_alone_is_as_with_others(frame):
    together = {r["series_id"]: r for r in extract(frame, NAMES).collect()}
    for name in ("abs_sum_change", "first_loc_max", "kurtosis", "autocorr-1", "entropy", "benford_correlation"):
        for r in extract(frame, [name]).collect():
            close(r[name], together[r["series_id"]][name], name, 1e-12)


def test_expanding(frame):
    names = [n for n in NAMES if n not in ("approx_entropy-2-0.5",)]
    specs = parse_all(names)
    rows = expanding(frame, names, every=4).collect()
    assert {(r["series_id"], r["end_pos"]) for r in rows} == {(k, e) for k, x in SERIES.items() for e in {*range(3, len(x), 4), len(x) - 1}}
    for r in rows:
        x = np.array(SERIES[r["series_id"]])[: r["end_pos"] + 1]
        for s, want in zip(specs, compute(x, specs, "expanding")):
            close(r[s.name], want, (r["series_id"], r["end_pos"], s.name))


@pytest.mark.parametrize("window,stride", [(5, 2), (4, 4), (3, 7), (200, 1)])
def test_sliding(frame, window, stride):
    specs = parse_all(NAMES)
    rows = sliding(frame, NAMES, window, stride).collect()
    assert {(r["series_id"], r["window_id"]) for r in rows} == {(k, w) for k, x in SERIES.items() for w in range(max(0, (len(x) - window) // stride + 1)) if len(x) >= window}
    for r in rows:
        at = r["window_id"] * stride
        for s, want in zip(specs, compute(np.array(SERIES[r["series_id"]])[at : at + window], specs, "sliding")):
            close(r[s.name], want, (r["series_id"], at, s.name))


def test_tumbling(frame):
    assert tumbling(frame, ["mean"], 10).where("series_id = 'long'").count() == 9


def test_golden_values(spark):
    """Values pinned by hand."""

    def one(names, *columns):
        batch = pa.RecordBatch.from_arrays([pa.array(np.array(c, np.float32)) for c in columns], names=[f"c{k}" for k in range(len(columns))])
        return Extractor(names).process_arrow(spark, batch)

    t = one(["mean", "std", "energy", "min", "max", "autocorr_lag1"], [1, 2, 3, 4, 5])
    assert [c.to_pylist()[0] for c in t.columns] == pytest.approx([3, 1.58114, 55, 1, 5, 0.5], rel=1e-5)
    t = one(["mad", "iqr", "mean_abs_change", "mean_change", "cid_ce", "paa-2-0", "paa-2-1"], [1, 2, 3, 4, 5, 6])
    assert [c.to_pylist()[0] for c in t.columns] == pytest.approx([1.5, 2.5, 1, 1, 5**0.5, 2, 5], rel=1e-5)
    t = one(["fft_coeff-1-real", "autocorr-2"], [1, 2, 1, 2, 1, 2])
    assert [c.to_pylist()[0] for c in t.columns] == pytest.approx([0, 2 / 3], abs=1e-5)
    t = one(["mean", "max_value"], [1, 2, 3, 4, 5], [5, 4, 3, 2, 1])
    assert t.to_pylist() == [{"mean": 3, "max_value": 5}] * 2


def batch(**columns):
    return pa.RecordBatch.from_arrays([pa.array(np.array(c, np.float32)) for c in columns.values()], names=list(columns))


def test_expanding_updates(spark):
    e = ExpandingExtractor(["mean", "max_value", "total_sum"])
    assert e.update(spark, batch(a=[], b=[])).num_rows == 0
    assert e.update(spark, batch(a=[1, 2], b=[10, 20])).to_pylist() == [{"mean": 1.5, "max_value": 2, "total_sum": 3}, {"mean": 15, "max_value": 20, "total_sum": 30}]
    assert e.update(spark, batch(a=[3], b=[30])).to_pylist() == [{"mean": 2, "max_value": 3, "total_sum": 6}, {"mean": 20, "max_value": 30, "total_sum": 60}]


def test_sliding_updates_equal_the_batch(spark):
    x = RNG.normal(size=23).astype(np.float32)
    for window, stride in ((5, 2), (3, 5)):
        s, got = SlidingExtractor(["mean", "median"], window, stride), []
        for k in range(0, len(x), 4):
            got += s.update(spark, batch(a=x[k : k + 4])).to_pylist()
        want = [x[a : a + window] for a in range(0, len(x) - window + 1, stride)]
        assert [r["mean"] for r in got] == pytest.approx([w.mean() for w in want], rel=1e-5)
        assert [r["median"] for r in got] == pytest.approx([np.median(w) for w in want], rel=1e-5)


def test_padded_spectrum(spark):
    x = RNG.normal(size=22)
    df = from_arrays(spark.createDataFrame([("a", x.tolist())], "id string, x array<double>"), "id", "x")
    r = extract(df, ["fft_coeff-3-abs", "spectral_centroid"], max_size=20).first()
    s = np.abs(np.fft.rfft(x, 32))
    close(r["fft_coeff-3-abs"], s[3], "padded")
    close(r["spectral_centroid"], (np.arange(17) * s).sum() / s.sum(), "padded")


def test_sources(spark, tmp_path):
    long = spark.createDataFrame([("a", 2, 5.0), ("a", 1, 4.0), ("b", 1, None)], "s string, t int, x double")
    assert [tuple(r) for r in from_long(long, "s", ["t"], "x", "drop").orderBy("pos").collect()] == [("a", 0, 4.0), ("a", 1, 5.0)]
    assert from_long(long, "s", ["t"], "x", "zero").where("series_id = 'b'").first()["v"] == 0
    with pytest.raises(Exception, match="null value"):
        from_long(long, "s", ["t"], "x").collect()
    wide = spark.createDataFrame([(0, 1.0, 3.0), (1, 2.0, 4.0)], "t int, a double, b double")
    assert {tuple(r) for r in from_wide(wide, "t").collect()} == {("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 3.0), ("b", 1, 4.0)}
    (tmp_path / "f.csv").write_text("t,x,y\n0,1,2\n1,3,4\n")
    got = from_csv(spark, str(tmp_path), "t int, x float, y float", "t", ["x"])
    assert {tuple(r) for r in got.collect()} == {("f.csv/x", 0, 1.0), ("f.csv/x", 1, 3.0)}
    assert sorted(r["count"] for r in pad(got, 5).groupBy("series_id").count().collect()) == [5]
    assert synthetic(spark, 8, 25).groupBy("series_id").count().where("count = 25").count() == 8


def test_empty_frame(frame):
    assert extract(frame.limit(0), ["mean", "spectral_centroid", "entropy"]).count() == 0


def test_benford_leaves_out_nan(spark):
    from chronoloom.operators.extract import extract

    values = [1.0, 12.0, 2.5, 0.3, 19.0]
    rows = [("a", i, v) for i, v in enumerate(values)] + [("b", i, v) for i, v in enumerate([*values, float("nan"), float("inf")])]
    got = {r["series_id"]: r["benford_correlation"] for r in extract(spark.createDataFrame(rows, "series_id string, pos int, v double"), ["benford_correlation"]).collect()}
    assert got["a"] == got["b"]
