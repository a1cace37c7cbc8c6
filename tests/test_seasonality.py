import numpy as np
import pytest

from helpers import column, series
from retailcast.operators import seasonality


def wave(n, period=7):
    return 100 + 20 * np.sin(2 * np.pi * np.arange(n) / period)


def test_spectrum_equals_numpy(spark):
    x = np.random.default_rng(0).normal(size=50)
    rows = seasonality.spectrum(series(spark, x)).orderBy("k").collect()
    full = np.abs(np.fft.fft(x - x.mean()))[1:25]
    assert [r["magnitude"] for r in rows] == pytest.approx(full)
    assert [r["frequency"] for r in rows] == pytest.approx(np.fft.fftfreq(50)[1:25])


def test_short_series_and_nulls_have_no_spectrum(spark):
    assert seasonality.spectrum(series(spark, [1, 2, 3])).count() == 0
    assert seasonality.spectrum(series(spark, [1, None, 3, 4, 5])).count() == 0


def brute_peaks(m):
    """Local maxima with the middle of plateaus, from the definition."""
    out, i = [], 1
    while i < len(m) - 1:
        j = i
        while j < len(m) - 1 and m[j + 1] == m[i]:
            j += 1
        if m[i - 1] < m[i] and j < len(m) - 1 and m[j + 1] < m[i] and m[i] >= np.mean(m):
            out.append((i + j) // 2)
        i = j + 1
    return out


def test_weekly_period_is_found(spark):
    peaks = seasonality.spectral_peaks(seasonality.spectrum(series(spark, wave(365)))).collect()
    best = max(peaks, key=lambda r: r["strength"])
    assert best["period"] in (6, 7) and best["strength"] == pytest.approx(1.0)


def test_peaks_equal_the_definition(spark):
    magnitudes = [1, 5, 5, 5, 2, 2, 6, 1, 7, 7, 1, 0, 3, 8, 8, 9, 1, 6, 2, 9, 1, 9, 9]
    rows = [(1, "A", k + 1, 47, (k + 1) / 47, float(m)) for k, m in enumerate(magnitudes)]
    spec = spark.createDataFrame(rows, "store_nbr int, family string, k int, n int, frequency double, magnitude double")
    got = sorted(r["k"] - 1 for r in seasonality.spectral_peaks(spec, max_peaks=99).collect())
    assert got == brute_peaks(magnitudes)
    five = sorted(r["k"] - 1 for r in seasonality.spectral_peaks(spec).collect())
    assert five == brute_peaks(magnitudes)[:5]


def direct_acf(x, lags):
    c = x - x.mean()
    return [1.0] + [float(c[:-k] @ c[k:] / (c @ c)) for k in range(1, lags + 1)]


def direct_pacf(x, lags):
    c, n = x - x.mean(), len(x)
    r = np.array([c @ c / n] + [c[:-k] @ c[k:] / (n - k) for k in range(1, lags + 1)])
    out = [1.0]
    for k in range(1, lags + 1):
        toeplitz = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        out.append(float(np.linalg.solve(toeplitz, r[1 : k + 1])[-1]))
    return out


def test_acf_and_pacf_by_their_equations(spark):
    x = np.random.default_rng(5).normal(size=80).cumsum()
    rows = seasonality.correlogram(series(spark, x)).orderBy("lag").collect()
    assert [r["acf"] for r in rows] == pytest.approx(direct_acf(x, 39))
    assert [r["pacf"] for r in rows if r["pacf"] is not None] == pytest.approx(direct_pacf(x, 20))


def test_too_short_for_lags(spark):
    rows = seasonality.correlogram(series(spark, [1, 2, 3])).collect()
    assert [(r["lag"], r["acf"], r["pacf"]) for r in rows] == [(0, 1.0, 1.0)]


def test_analyze_gives_one_row_per_series(spark):
    both = series(spark, wave(200)).union(series(spark, [1, 2, 3], store=2))
    rows = {r["store_nbr"]: r for r in seasonality.analyze(both).collect()}
    assert rows[1]["weekly_strength"] > 0.9 and rows[1]["yearly_strength"] == 0.0
    assert rows[1]["dominant_periods"][0] in (6, 7)
    assert len(rows[1]["acf_values"]) == 100 and len(rows[1]["pacf_values"]) == 51
    assert rows[2]["dominant_periods"] == [] and rows[2]["acf_values"] == [1.0]


def test_decomposition_adds_up(spark):
    x = wave(70) + np.arange(70)
    rows = seasonality.decompose(series(spark, x)).orderBy("date").collect()
    inner = rows[3:-3]
    assert rows[0]["trend"] is None and rows[-1]["trend"] is None
    assert [r["trend"] + r["seasonal"] + r["resid"] for r in inner] == pytest.approx([r["sales"] for r in inner])
    assert sum(r["seasonal"] for r in rows[:7]) == pytest.approx(0, abs=1e-9)
    assert max(abs(r["resid"]) for r in inner) < 1e-6


def test_decomposition_of_an_even_period(spark):
    x = np.tile([1.0, 2, 3, 4], 6)
    rows = seasonality.decompose(series(spark, x), period=4).orderBy("date").collect()
    assert [r["trend"] for r in rows[2:-2]] == pytest.approx([2.5] * 20)
    assert rows[1]["trend"] is None


def test_decomposition_needs_two_weeks(spark):
    assert seasonality.decompose(series(spark, range(13))).count() == 0
    assert seasonality.decompose(series(spark, range(14))).count() == 14


def test_report_correlogram_band(spark):
    rows = seasonality.report_correlogram(series(spark, wave(100))).collect()
    assert max(r["lag"] for r in rows) == 49
    assert rows[0]["band"] == pytest.approx(1.96 / 10)
    assert column(seasonality.report_correlogram(series(spark, [1, 2, 3])), "lag") == []
