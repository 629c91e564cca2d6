"""Features of one series that need all of it at once, in numpy."""

from __future__ import annotations

import numpy as np

FIRST_BELOW = 0.36787944  # 1/e as the threshold is given


def next_good_fft_size(n: int) -> int:
    """The smallest size in [n, 1.05 n] without a prime factor above 7, else the next power of two."""
    if n <= 1:
        return 1
    for size in range(n, int(n * 1.05) + 1):
        rest = size
        for p in (2, 3, 5, 7):
            while rest % p == 0:
                rest //= p
        if rest == 1:
            return size
    return 1 << (n - 1).bit_length()


def spectrum(x: np.ndarray, size: int | None = None) -> np.ndarray:
    return np.abs(np.fft.rfft(x, size))


def spectral_centroid(s: np.ndarray) -> float:
    total = s.sum()
    return float((np.arange(len(s)) * s).sum() / total) if total > 0 else 0.0


def spectral_distance(s: np.ndarray) -> float:
    return float(np.sqrt(((s - s.mean()) ** 2).sum())) if len(s) else 0.0


def spectral_decrease(s: np.ndarray) -> float:
    rest = s[1:].sum()
    return float(((s[1:] - s[0]) / np.arange(1, len(s))).sum() / rest) if len(s) > 1 and rest > 0 else 0.0


def spectral_slope(s: np.ndarray) -> float:
    if len(s) < 2:
        return 0.0
    k = np.arange(len(s)) - (len(s) - 1) / 2
    return float((k * (s - s.mean())).sum() / (k * k).sum())


def human_range_energy(s: np.ndarray, rate: float = 100.0) -> float:
    """Share of the energy from 0.6 to 2.5 Hz."""
    power = s * s
    if len(s) < 2 or not power.sum() > 0:
        return 0.0
    step = rate / ((len(s) - 1) * 2)
    return float(power[int(np.ceil(0.6 / step)) : int(np.floor(2.5 / step)) + 1].sum() / power.sum())


def _lagged(x: np.ndarray, most: int) -> np.ndarray:
    """Sums of products of the centred series at lags 0 to most."""
    c = x - x.mean()
    n = len(c)
    if most <= 32:
        return np.array([c[: n - k] @ c[k:] if k < n else 0.0 for k in range(most + 1)])
    f = np.fft.rfft(c, 2 * n)
    return np.fft.irfft(f * f.conj(), 2 * n)[: most + 1]


def autocorr_first_1e(x: np.ndarray) -> float:
    """The first lag at which the autocorrelation is below 1/e; 0 if there is none."""
    n = len(x)
    if n < 2 or x.var(ddof=1) <= 1e-9:
        return 0.0
    block = min(n - 1, 32)
    r = _lagged(x, block)
    below = np.flatnonzero(r[1:] / r[0] < FIRST_BELOW)
    if not len(below) and block < n - 1:
        r = _lagged(x, n - 1)
        below = np.flatnonzero(r[1:] / r[0] < FIRST_BELOW)
    return float(below[0] + 1) if len(below) else 0.0


def partial_autocorr(x: np.ndarray, lag: int, by_count: bool = False) -> float:
    """Durbin-Levinson. by_count: sums are divided by their number of terms and the sample
    variance instead of by the sum of squares."""
    n = len(x)
    if n <= lag or n < 2 or (var := x.var(ddof=1)) <= 1e-9:
        return 0.0
    s = _lagged(x, lag)
    r = np.concatenate([[1.0], s[1:] / ((n - np.arange(1, lag + 1)) * var)]) if by_count else s / s[0]
    phi, error, last = np.zeros(0), 1.0, 0.0
    for k in range(1, lag + 1):
        if error < 1e-9:
            return 0.0
        last = (r[k] - phi @ r[k - 1 : 0 : -1]) / error
        phi = np.concatenate([phi - last * phi[::-1], [last]])
        error *= 1 - last * last
    return float(last)


def _phi(x: np.ndarray, m: int, r: float) -> float:
    """Mean log share of the m-grams within r of each one. Candidates come from a window of the
    m-grams sorted by their first value."""
    count = len(x) - m + 1
    if m == 0:
        return 0.0
    grams = np.lib.stride_tricks.sliding_window_view(x, m)
    grams = grams[np.argsort(grams[:, 0], kind="stable")]
    first = grams[:, 0]
    # a margin, so that rounding in first - r can't hide a match
    margin = 1e-9 * (1 + np.abs(first) + abs(r))
    lo, hi = np.searchsorted(first, first - r - margin), np.searchsorted(first, first + r + margin, "right")
    total = 0.0
    for i in range(count):
        total += np.log((np.abs(grams[lo[i] : hi[i]] - grams[i]).max(axis=1) <= r).sum() / count)
    return total / count


def approx_entropy(x: np.ndarray, m: int, r: float) -> float:
    return float(_phi(x, m, r) - _phi(x, m + 1, r)) if len(x) > m + 1 else 0.0
