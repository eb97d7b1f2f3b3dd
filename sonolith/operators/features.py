"""First feature extractor: PCM -> chroma image -> integral image -> packed sub-prints, vectorised over one song.

An image is a (frames, 12) array. Kernels are plain numpy; `extract` and `images` bring them to DataFrames.
"""

from __future__ import annotations

from math import gcd

import numpy as np

# Fixed values of the extraction.
RATE, FRAME, HOP, LOW, HIGH, NOTES = 11025, 4096, 1365, 28, 3520, 12
SMOOTHING = (0.25, 0.75, 1.0, 0.75, 0.25)
LEAST_RATE, TAPS, CUTOFF, KAISER_BETA = 1000, 16, 0.8, 9
#: (kind, first pitch, pitches, frames, three thresholds) of the sixteen classifiers.
CLASSIFIERS = (
    (0, 0, 3, 15, 2.10543, 2.45354, 2.69414),
    (1, 0, 4, 14, -0.345922, 0.0463746, 0.446251),
    (1, 4, 4, 11, -0.392132, 0.0291077, 0.443391),
    (3, 0, 4, 14, -0.192851, 0.00583535, 0.204053),
    (2, 8, 2, 4, -0.0771619, -0.00991999, 0.0575406),
    (5, 6, 2, 15, -0.710437, -0.518954, -0.330402),
    (1, 9, 2, 16, -0.353724, -0.0189719, 0.289768),
    (3, 4, 2, 10, -0.128418, -0.0285697, 0.0591791),
    (3, 9, 2, 16, -0.139052, -0.0228468, 0.0879723),
    (2, 1, 3, 6, -0.133562, 0.00669205, 0.155012),
    (3, 3, 6, 2, -0.0267, 0.00804829, 0.0459773),
    (2, 8, 1, 10, -0.0972417, 0.0152227, 0.129003),
    (3, 4, 4, 14, -0.141434, 0.00374515, 0.149935),
    (5, 4, 2, 15, -0.64035, -0.466999, -0.285493),
    (5, 9, 2, 3, -0.322792, -0.254258, -0.174278),
    (2, 1, 8, 4, -0.0741375, -0.00590933, 0.0600357),
)
GRAY = (0, 1, 3, 2)

Box = tuple[int, int, int, int]  # first frame, end frame, first pitch, end pitch


def downmix(samples: np.ndarray) -> np.ndarray:
    """Mono int16 of (n, channels) samples: the mean, truncated toward zero."""
    samples = np.asarray(samples)
    if samples.ndim == 1 or samples.shape[1] == 1:
        return samples.reshape(-1).astype(np.int16)
    return np.trunc(samples.sum(axis=1, dtype=np.int64) / samples.shape[1]).astype(np.int16)


def resample(x: np.ndarray, rate: int, target: int = RATE) -> np.ndarray:
    """x at `target` Hz by a Kaiser-windowed sinc of TAPS taps a lobe, cut at CUTOFF of the narrower band."""
    if rate <= LEAST_RATE:
        raise ValueError(f"a sample rate of {rate} is too low")
    x = np.asarray(x, float)
    if rate == target or not len(x):
        return x.copy()
    width = min(1.0, CUTOFF * target / rate)
    half = int(np.ceil(TAPS / width / 2))
    up, down = target // gcd(rate, target), rate // gcd(rate, target)
    n = len(x) * up // down
    padded = np.concatenate((np.zeros(half), x, np.zeros(half + down)))
    reach = np.arange(-half + 1, half + 1)
    out = np.empty(n)
    for phase in range(min(up, n)):  # outputs of one phase share their taps
        at = (np.arange(phase, n, up) * down) // up
        off = phase * down / up % 1
        t = reach - off
        taps = np.sinc(t * width) * np.i0(KAISER_BETA * np.sqrt(np.maximum(0, 1 - (t / half) ** 2)))
        taps /= taps.sum()
        view = np.lib.stride_tricks.sliding_window_view(padded, len(taps))
        out[phase::up] = view[at + 1] @ taps
    return out


def window(n: int = FRAME, scale: float = 1 / 32767) -> np.ndarray:
    return scale * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1)))


def power(samples: np.ndarray, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """(frames, frame / 2 + 1) energies of the overlapped frames."""
    if len(samples) < frame:
        return np.zeros((0, frame // 2 + 1))
    cut = np.lib.stride_tricks.sliding_window_view(np.asarray(samples, float), frame)[::hop]
    return np.abs(np.fft.rfft(cut * window(frame), axis=1)) ** 2


def notes(frame: int = FRAME, rate: int = RATE, low: float = LOW, high: float = HIGH) -> tuple[np.ndarray, np.ndarray]:
    """(bins, real-valued note 0 .. 12 of each) between two frequencies."""
    bins = np.arange(max(1, round(frame * low / rate)), min(frame // 2, round(frame * high / rate)))
    return bins, NOTES * (np.log2(bins * rate / frame / 27.5) % 1)


def fold(energy: np.ndarray, frame: int = FRAME, rate: int = RATE, low: float = LOW, high: float = HIGH, interpolate: bool = False) -> np.ndarray:
    """(frames, 12): energies added up by note; interpolated ones are shared with the nearer neighbour note."""
    bins, note = notes(frame, rate, low, high)
    own = note.astype(int)
    share = np.zeros((len(bins), NOTES))
    at = np.arange(len(bins))
    part = note - own
    kept = 1 - np.abs(part - 0.5) if interpolate else np.ones(len(bins))
    np.add.at(share, (at, own), kept)
    np.add.at(share, (at, (own + np.where(part < 0.5, -1, 1)) % NOTES), 1 - kept)
    return energy[:, bins] @ share


def smooth(image: np.ndarray, taps=SMOOTHING) -> np.ndarray:
    """Each row and its predecessors, weighted; the first len - 1 rows give none."""
    n = len(image) - len(taps) + 1
    return sum((c * image[k : k + n] for k, c in enumerate(taps)), np.zeros((max(n, 0), image.shape[1]))) if n > 0 else image[:0]


def normalised(image: np.ndarray, least: float = 0.01) -> np.ndarray:
    norm = np.sqrt((image * image).sum(axis=1, keepdims=True))
    return np.where(norm < least, 0.0, image / np.where(norm == 0, 1, norm))


def chroma(samples: np.ndarray) -> np.ndarray:
    """Image of mono samples at RATE."""
    return normalised(smooth(fold(power(samples))))


def integral(image: np.ndarray) -> np.ndarray:
    """2-D prefix sums with a border of zeros before the first row and column."""
    out = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    out[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    return out


def area(sums: np.ndarray, first: np.ndarray | int, box: Box) -> np.ndarray:
    """Sum of each rectangle `box`, moved to frames `first`; empty rectangles are 0."""
    x0, x1, y0, y1 = box
    return sums[first + x1, y1] - sums[first + x0, y1] - sums[first + x1, y0] + sums[first + x0, y0]


def regions(kind: int, frames: int, pitches: int) -> tuple[list[Box], list[Box]]:
    """Rectangles whose sums a filter sets against each other: (for, against)."""
    w, h = frames // 2, pitches // 2
    w3, h3 = frames // 3, pitches // 3
    whole = (0, frames, 0, pitches)
    return {
        0: ([whole], []),
        1: ([(0, frames, h, pitches)], [(0, frames, 0, h)]),
        2: ([(w, frames, 0, pitches)], [(0, w, 0, pitches)]),
        3: ([(0, w, h, pitches), (w, frames, 0, h)], [(0, w, 0, h), (w, frames, h, pitches)]),
        4: ([(0, frames, h3, 2 * h3)], [(0, frames, 0, h3), (0, frames, 2 * h3, pitches)]),
        5: ([(w3, 2 * w3, 0, pitches)], [(0, w3, 0, pitches), (2 * w3, frames, 0, pitches)]),
    }[kind]


def difference(a, b):
    return a - b


def log_difference(a, b):
    return np.log1p(a) - np.log1p(b)


def contrast(sums: np.ndarray, first, kind: int, pitch: int, pitches: int, frames: int, compare=log_difference):
    """Filter value at frames `first`."""
    told = [sum((area(sums, first, (x0, x1, y0 + pitch, y1 + pitch)) for x0, x1, y0, y1 in side), np.zeros(np.shape(first))) for side in regions(kind, frames, pitches)]
    return compare(*told)


def sub_prints(image: np.ndarray, classifiers=CLASSIFIERS) -> np.ndarray:
    """Unsigned words (int64), one for each frame that starts a window of the widest filter."""
    n = len(image) - max(c[3] for c in classifiers) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    sums, first, words = integral(image), np.arange(n), np.zeros(n, np.int64)
    for kind, pitch, pitches, frames, *cuts in classifiers:
        level = np.searchsorted(cuts, contrast(sums, first, kind, pitch, pitches, frames), side="right")
        words = words << 2 | np.take(GRAY, level)
    return words


def cprint(samples: np.ndarray, rate: int) -> np.ndarray:
    """Words of mono samples at any rate."""
    return sub_prints(chroma(np.round(resample(samples, rate))))


# -- an alternative feature: the centre of mass of each Bark band ---------------------------------------------------------


def bark(f):
    """Critical-band rate of a frequency, with the low and high ends corrected."""
    z = 26.81 * f / (1960.0 + f) - 0.53
    return np.where(z < 2, z + 0.15 * (2 - z), np.where(z > 20.1, z + 0.22 * (z - 20.1), z))


def band_edges(bands: int, low: float, high: float, frame: int, rate: int) -> list[int]:
    """Bins at which bands of equal Bark width start, and the end of the last one."""
    step = (bark(high) - bark(low)) / bands
    edges, before = [round(frame * low / rate)], float(bark(low))
    for i in range(edges[0], frame // 2):
        z = float(bark(i * rate / frame))
        if z - before > step:
            edges.append(i)
            before = z
            if len(edges) > bands:
                break
    return edges + [frame // 2] * (bands + 1 - len(edges))


def centroids(energy: np.ndarray, edges: list[int]) -> np.ndarray:
    """(frames, bands): place of the centre of mass within each band, 0 to 1; the middle where there is no energy."""
    out = np.empty((len(energy), len(edges) - 1))
    for b, (first, last) in enumerate(zip(edges, edges[1:])):
        part, at = energy[:, first:last], np.arange(first, last)
        mass = part.sum(axis=1)
        centre = np.where(mass > 0, part @ at / np.where(mass > 0, mass, 1), (first + last) / 2)
        out[:, b] = (centre - first) / max(1, last - first)
    return out
