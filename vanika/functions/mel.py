"""Log-mel spectrograms of waveforms: short-time Fourier transforms and mel filters in numpy, block by block of frames."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of frames that are transformed at once.
BLOCK = 1 << 20


@dataclass(frozen=True)
class Mel:
    """How a spectrogram is made. The defaults are those of a voice's training."""

    rate: int = 24000
    n_fft: int = 1024
    hop: int = 256
    window: int = 1024
    n_mels: int = 80
    low: float = 0.0
    high: float = 12000.0
    least: float = 1e-5


def _to_mel(hz: np.ndarray) -> np.ndarray:
    """Slaney's scale: linear to 1000 Hz (15 mel), then logarithmic, 27 mel for each factor of 6.4."""
    return np.where(hz < 1000, hz * 3 / 200, 15 + 27 * np.log(np.maximum(hz, 1000) / 1000) / np.log(6.4))


def _to_hz(mel: np.ndarray) -> np.ndarray:
    return np.where(mel < 15, mel * 200 / 3, 1000 * 6.4 ** ((np.maximum(mel, 15) - 15) / 27))


@lru_cache(maxsize=8)
def filters(m: Mel) -> np.ndarray:
    """n_mels triangles over the n_fft / 2 + 1 frequencies, evenly apart in mel, each of the same area."""
    edges = _to_hz(np.linspace(*_to_mel(np.array([m.low, m.high])), m.n_mels + 2))
    hz = np.linspace(0, m.rate // 2, m.n_fft // 2 + 1)
    left, middle, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    rise, fall = (hz - left) / (middle - left), (right - hz) / (right - middle)
    return np.maximum(0, np.minimum(rise, fall)) * 2 / (right - left)


@lru_cache(maxsize=8)
def hann(m: Mel) -> np.ndarray:
    """A periodic Hann window in the middle of n_fft values."""
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(m.window) / m.window)
    left = (m.n_fft - m.window) // 2
    return np.pad(w, (left, m.n_fft - m.window - left))


def log_mel_blocks(samples: np.ndarray, m: Mel) -> Iterator[np.ndarray]:
    """Frames by mels, as many frames at once as BLOCK allows; the last samples of a block are the first of the next.

    Frame t is centred at t * hop; the waveform is mirrored at its ends. No samples: no frames.
    """
    if not len(samples):
        return
    padded = np.pad(np.asarray(samples, np.float64), m.n_fft // 2, mode="reflect")
    frames = 1 + (len(padded) - m.n_fft) // m.hop
    step = max(1, BLOCK // m.n_fft)
    for at in range(0, frames, step):
        n = min(step, frames - at)
        part = padded[at * m.hop : (at + n - 1) * m.hop + m.n_fft]
        cut = np.lib.stride_tricks.sliding_window_view(part, m.n_fft)[:: m.hop]
        yield np.log(np.maximum(np.abs(np.fft.rfft(cut * hann(m), axis=1)) @ filters(m).T, m.least))


def log_mel(sounds: DataFrame, key: str, m: Mel = Mel()) -> DataFrame:
    """key, frame, mel (n_mels doubles) of sounds (key, samples): a row for each frame, so that no row grows with the sound. Null samples have no frames; samples have the rate that m says."""
    kind = sounds.schema[key].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, samples in zip(batch.column("key"), batch.column("samples"), strict=True):
                at = 0
                for block in log_mel_blocks(samples.values.to_numpy(zero_copy_only=False) if samples.is_valid else np.empty(0), m):
                    n = len(block)
                    mel = pa.ListArray.from_arrays(pa.array(np.arange(0, n * m.n_mels + 1, m.n_mels, dtype=np.int32)), pa.array(block.ravel()))
                    yield pa.record_batch({key: pa.repeat(k, n), "frame": pa.array(np.arange(at, at + n)), "mel": mel})
                    at += n

    return sounds.select(F.col(key).alias("key"), F.col("samples").cast("array<float>").alias("samples")).mapInArrow(each, f"`{key}` {kind}, frame long, mel array<double>")
