"""Frame statistics of waveforms, as functions of arrays of samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12


def frame_rms(samples: Column, frame: int | Column) -> Column:
    """Root mean square of each whole frame; what is left at the end is dropped."""
    frame = F.lit(frame) if isinstance(frame, int) else frame
    n = F.floor(F.size(samples) / frame).cast("int")
    frames = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def rms(i: Column) -> Column:
        total = F.aggregate(F.slice(samples, i * frame + 1, frame), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        return F.sqrt(total / frame + EPSILON)

    return F.transform(frames, rms)


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def snr_db(samples: Column, frame: int = 2048) -> Column:
    """20 log10 of the loudest tenth of frames over the quietest; 0 for fewer than two frames."""
    rms = F.array_sort(frame_rms(samples, frame))
    k = F.greatest(F.lit(1), F.floor(F.size(rms) / 10).cast("int"))
    ratio = _mean(F.slice(rms, -k, k)) / _mean(F.slice(rms, F.lit(1), k))
    return F.when(F.size(samples) < 2 * frame, 0.0).otherwise(20.0 * F.log10(ratio))


def _db(rms: Column) -> Column:
    return 20.0 * F.log10(rms + EPSILON)


def silence_ratio(samples: Column, threshold_db: float = -40.0, frame: int = 2048) -> Column:
    """Share of frames below the threshold; 1 for less than a frame."""
    rms = frame_rms(samples, frame)
    return F.when(F.size(samples) < frame, 1.0).otherwise(F.size(F.filter(rms, lambda r: _db(r) < threshold_db)) / F.size(rms))


def trim_silence(samples: Column, rate: int, pad_ms: int = 50, threshold_db: float = -40.0) -> Column:
    """Samples from the first to the last voiced 10 ms frame, with padding; all of them if no frame is voiced."""
    return trim_silence_at(samples, F.lit(rate), pad_ms, threshold_db)


def trim_silence_at(samples: Column, rate: Column, pad_ms: int = 50, threshold_db: float = -40.0) -> Column:
    """trim_silence() of samples that each have their own rate."""
    frame = F.greatest(F.lit(1), F.floor(rate / 100).cast("int"))
    pad = F.floor(F.lit(pad_ms) * rate / 1000).cast("int")
    voiced = F.transform(frame_rms(samples, frame), lambda r: _db(r) > threshold_db)
    first = F.array_position(voiced, True).cast("int") - 1
    last = F.size(voiced) - F.array_position(F.reverse(voiced), True).cast("int")
    start = F.greatest(F.lit(0), first * frame - pad)
    end = F.least(F.size(samples), (last + 1) * frame + pad)
    return F.when(F.array_contains(voiced, True), F.slice(samples, start + 1, end - start)).otherwise(samples)


def interval(samples: Column, rate: int, start_sec: Column, duration_sec: Column) -> Column:
    """The samples of an interval of seconds."""
    start = F.greatest(F.lit(0), F.floor(start_sec * rate).cast("int"))
    return F.slice(samples, start + 1, F.greatest(F.lit(0), F.floor(duration_sec * rate).cast("int")))


def stretch(samples: Column, ratio: Column) -> Column:
    """Resampled to 1/ratio of the length (ratio within 0.5 and 2): the sample at or before each even step."""
    r = F.least(F.lit(2.0), F.greatest(F.lit(0.5), ratio))
    n = F.size(samples)
    new = F.floor(n / r).cast("int")
    at = F.when(new > 1, F.sequence(F.lit(0), new - 1)).when(new == 1, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.get(samples, F.when(new > 1, F.floor(i * (n - 1) / (new - 1))).otherwise(0).cast("int")))


def pad_to(values: Column, length: Column, pad: Column) -> Column:
    return F.concat(values, F.array_repeat(pad, F.greatest(F.lit(0), length - F.size(values))))


def wav_seconds(content: Column) -> Column:
    """Duration by a canonical 44-byte RIFF header; 0 where there is none."""
    def little(at: int, n: int) -> Column:
        return F.conv(F.concat(*(F.hex(F.substring(content, at + n - 1 - k, 1)) for k in range(n))), 16, 10).cast("double")

    ok = (F.length(content) >= 44) & (F.hex(F.substring(content, 1, 4)) == "52494646")
    return F.when(ok & (little(29, 4) > 0), little(41, 4) / little(29, 4)).otherwise(0.0)
