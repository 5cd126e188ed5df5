"""Column expressions: decibels, angles, duration bands, names, simple formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds in seconds of the duration bands, and the band beyond.
BANDS = [(0.5, "micro"), (5.0, "meso"), (600.0, "macro"), (21600.0, "cyclic"), (259200.0, "circadian"), (31536000.0, "seasonal")]
BEYOND = "archival"
#: Names of the twelve semitones.
NOTES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
#: Fixed value: standard weight of a diagonal scale on the two axes.
COS45 = 0.7071067811865476


def db(power: Column, floor: float = 1e-12) -> Column:
    """Power in decibels, floored."""
    return 10 * F.log10(F.greatest(power, F.lit(floor)))


def power(level_db: Column) -> Column:
    return F.pow(F.lit(10.0), level_db / 10)


def nan_to_null(x: Column) -> Column:
    return F.when(F.isnan(x), None).otherwise(x)


def quantile(x: Column, p: float, accuracy: int | None = None) -> Column:
    """Interpolated quantile; with ``accuracy`` an approximate one of bounded memory, for unbounded groups."""
    return F.percentile(x, p) if accuracy is None else F.percentile_approx(x, p, accuracy)


def wrap_degrees(angle: Column) -> Column:
    """Into (-180, 180]."""
    return -(F.pmod(180.0 - angle, F.lit(360.0)) - 180.0)


def to_pascal(sample: Column, offset_db: float) -> Column:
    return sample * 20e-6 * 10 ** (offset_db / 20)


def critical_bandwidth(f: Column) -> Column:
    return 25 + 75 * F.pow(1 + 1.4 * F.pow(f / 1000, F.lit(2.0)), F.lit(0.69))


def fluctuation_weight(f: Column) -> Column:
    """Weight of a modulation frequency, 1 at 4 Hz, 0 at 0."""
    return F.when(f == 0, F.lit(0.0)).otherwise(2 / (f / 4 + 4 / f))


def band_of(seconds: Column) -> Column:
    """Name of the duration band; null for null."""
    out = F.when(seconds < BANDS[0][0], BANDS[0][1])
    for bound, name in BANDS[1:]:
        out = out.when(seconds < bound, name)
    return out.when(seconds.isNotNull(), BEYOND)


def channel_mode(channels: Column) -> Column:
    return F.when(channels == 1, "mono").when(channels >= 4, "ambix").otherwise("stereo")


def note_number(f: Column) -> Column:
    return 69 + 12 * F.log2(f / 440.0)


def note_name(f: Column) -> Column:
    """Name and octave of the nearest semitone; null where there is none (not above 0, not finite)."""
    nearest = F.rint(note_number(f)).try_cast("int")
    names = F.array(*[F.lit(n) for n in NOTES])
    octave = (F.floor(nearest / 12) - 1).cast("int")
    return F.concat(F.get(names, F.pmod(nearest, F.lit(12))), octave.cast("string"))


def note_cents(f: Column) -> Column:
    return 100 * (note_number(f) - F.rint(note_number(f)))


def clock_offset(observed: Column, true_clock: Column) -> Column:
    return true_clock - F.pmod(observed, F.lit(86400.0))


def quadrant(pleasantness: Column, eventfulness: Column) -> Column:
    pleasant, eventful = pleasantness >= 0, eventfulness >= 0
    return (
        F.when(pleasant & eventful, "vibrant").when(~pleasant & eventful, "chaotic").when(pleasant, "calm").otherwise("monotonous")
    )


def circular_sd(r: Column, floor: float = 1e-20) -> Column:
    return F.sqrt(-2 * F.ln(F.greatest(r, F.lit(floor))))


def rayleigh_p(r: Column, n: Column) -> Column:
    """Probability of so large a resultant by chance, by Wilkie's approximation, 1 at most."""
    n = n.cast("double")
    exponent = F.sqrt(1 + 4 * n + 4 * (n * n - F.pow(n * r, F.lit(2.0)))) - (1 + 2 * n)
    return F.least(F.exp(exponent), F.lit(1.0))


def clock_text(seconds: Column) -> Column:
    """HH:MM:SS, with the number of days before it from the second day on."""
    whole = F.floor(seconds).cast("bigint")
    days = F.floor(whole / 86400).cast("bigint")
    part = lambda d, m: F.lpad(F.pmod(F.floor(whole / d), F.lit(m)).cast("bigint").cast("string"), 2, "0")
    clock = F.concat_ws(":", part(3600, 24), part(60, 60), part(1, 60))
    return F.when(days > 0, F.concat_ws(" ", days.cast("string"), clock)).otherwise(clock)


def parse_clock(text: Column) -> Column:
    """Seconds of a number, ``HH:MM:SS`` or ``D HH:MM:SS``; null for other text."""
    groups = [F.regexp_extract(text, r"^(?:(\d+) )?(\d+):(\d+):(\d+(?:\.\d+)?)$", i) for i in (1, 2, 3, 4)]
    number = lambda g: F.expr("0D") + F.coalesce(F.when(g == "", None).otherwise(g).try_cast("double"), F.lit(0.0))
    clock = number(groups[0]) * 86400 + number(groups[1]) * 3600 + number(groups[2]) * 60 + number(groups[3])
    return F.when(groups[1] != "", clock).otherwise(text.try_cast("double"))


def date_in(name: Column) -> Column:
    """The first valid date in a name: YYYY-MM-DD, else YYYYMMDD."""
    dashed = F.try_to_date(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    compact = F.try_to_date(F.regexp_extract(name, r"(\d{8})", 1), "yyyyMMdd")
    return F.coalesce(dashed, compact)
