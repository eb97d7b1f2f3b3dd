"""Second feature extractor: 8 kHz samples -> line-fit quality of each Bark band (r) and dominant harmonic (dom).

Kernels are numpy over all frames of a song at once; `fit_quality` and `harmonic_level` are their SQL twins.
"""

from __future__ import annotations

import numpy as np

from .features import bark

# Fixed values of the extraction.
RATE, FRAME, FRAMES, LEAST_SECONDS, BANDS = 8000, 8192, 87, 10, 17
SILENCE, EPSILON = 1 / 32768, 1e-10
#: Levels of the fit quality, a row for each cut, a column for each band.
FIT_CUTS = (
    (0.8116, 0.4273, 0.4233, 0.3827, 0.3783, 0.3848, 0.3726, 0.3669, 0.3500, 0.3440, 0.3281, 0.3256, 0.3148, 0.3091, 0.3031, 0.3340, 0.5660),
    (0.8528, 0.5300, 0.5267, 0.4800, 0.4765, 0.4853, 0.4711, 0.4635, 0.4430, 0.4356, 0.4147, 0.4117, 0.3993, 0.3892, 0.3825, 0.4151, 0.6249),
    (0.8824, 0.6216, 0.6220, 0.5754, 0.5736, 0.5838, 0.5699, 0.5595, 0.5374, 0.5281, 0.5032, 0.4983, 0.4850, 0.4674, 0.4612, 0.4929, 0.6746),
)
#: Frequencies (Hz) between the 64 levels of the dominant harmonic.
HARMONIC_CUTS = (
    15.63, 40.04, 44.92, 48.83, 50.78, 52.73, 54.69, 57.62, 59.57, 62.50, 64.45, 66.41, 69.34, 71.29, 73.24, 74.22,
    77.15, 79.10, 82.03, 83.01, 83.98, 86.91, 87.89, 91.80, 93.75, 97.66, 98.63, 99.61, 103.52, 105.47, 109.38, 110.35,
    111.33, 116.21, 119.14, 123.05, 125.00, 130.86, 134.77, 140.63, 146.48, 151.37, 159.18, 165.04, 171.88, 182.62, 195.31, 201.17,
    218.75, 228.52, 247.07, 262.70, 291.02, 310.61, 333.98, 372.07, 414.06, 461.91, 523.44, 592.77, 699.22, 868.16, 1176.76,
)


def lines() -> np.ndarray:
    """Bark band of each spectrum line; the last band reaches to the end."""
    f = (np.arange(FRAME // 2) * float(RATE) + FRAME // 2) / FRAME
    return np.minimum(bark(f).astype(int), BANDS - 1)


def trimmed(samples: np.ndarray) -> np.ndarray:
    """(n, channels) floats from the first audible sample on."""
    loud = np.flatnonzero((np.abs(samples) >= SILENCE - EPSILON).any(axis=1))
    return samples[loud[0] :] if len(loud) else samples[:0]


def spectra(samples: np.ndarray) -> np.ndarray:
    """(FRAMES, FRAME / 2) energies of 8 kHz samples, zero-filled at the end."""
    whole = np.zeros(FRAMES * FRAME)
    whole[: min(len(samples), len(whole))] = samples[: len(whole)]
    half = np.sin(np.pi * np.arange(FRAME // 2) / FRAME)
    shape = np.concatenate((half, half[::-1]))
    return np.abs(np.fft.fft(whole.reshape(FRAMES, FRAME) * shape, axis=1)[:, : FRAME // 2]) ** 2


def decibels(energy: np.ndarray) -> np.ndarray:
    return np.where(energy > EPSILON, 10 * np.log10(np.maximum(energy, EPSILON)), 0.0)


def fits(values: np.ndarray) -> np.ndarray:
    """Fourth root of R squared of a straight line through each row; NaN for a flat row."""
    x = np.arange(values.shape[1]) - (values.shape[1] - 1) / 2
    y = values - values.mean(axis=1, keepdims=True)
    vary = (y * y).sum(axis=1)
    told = (y @ x) ** 2 / (x @ x) / np.where(vary > 0, vary, 1)
    return np.where(vary > 0, told, np.nan) ** 0.25


def fit_levels(energy: np.ndarray) -> np.ndarray:
    """(frames, 16) of 0..3 for bands 1 to 16; flat bands are 3."""
    of, power = lines(), decibels(energy)
    cuts = np.array(FIT_CUTS)
    out = np.empty((len(energy), BANDS - 1), np.int64)
    for b in range(1, BANDS):
        got = fits(power[:, of == b])
        out[:, b - 1] = np.where(np.isnan(got), 3, (got[:, None] >= cuts[None, :, b]).sum(axis=1))
    return out


def harmonic_levels(energy: np.ndarray) -> np.ndarray:
    """0..63 of each frame's strongest line."""
    return np.searchsorted(HARMONIC_CUTS, RATE / 2 * energy.argmax(axis=1) / energy.shape[1], side="right")


def packed(levels: np.ndarray, width: int) -> bytes:
    """Values of `width` bits one after the other, high bits first, in whole bytes."""
    bits = (levels.reshape(-1, 1) >> np.arange(width - 1, -1, -1)) & 1
    return np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def extract(samples: np.ndarray) -> tuple[bytes, bytes, int, int] | None:
    """(r of 348 bytes, dom of 66 bytes, average fit x 1000, average harmonic x 100) of mono 8 kHz floats, or None where
    there are less than LEAST_SECONDS."""
    if len(samples) < LEAST_SECONDS * RATE:
        return None
    energy = spectra(samples)
    levels, dom = fit_levels(energy), harmonic_levels(energy)
    r = packed(levels, 2)
    return r, packed(np.append(dom, 0), 6), int(np.floor(levels.mean() * 1000 + 0.5)), int(np.floor(dom.mean() * 100 + 0.5))


def fit_level_sql(fit: str, band: str) -> str:
    """SQL: level of a fit in a band (1..16); NaN or NULL: 3."""
    cut = lambda k: f"element_at(array({', '.join(f'{v}D' for v in FIT_CUTS[k])}), {band} + 1)"
    return f"CASE WHEN {fit} IS NULL OR isnan({fit}) THEN 3 WHEN {fit} < {cut(0)} THEN 0 WHEN {fit} < {cut(1)} THEN 1 WHEN {fit} < {cut(2)} THEN 2 ELSE 3 END"


def harmonic_level_sql(hz: str) -> str:
    return f"size(filter(array({', '.join(f'{v}D' for v in HARMONIC_CUTS)}), c -> c <= {hz}))"
