"""Column expressions on time: gaps, sample counts, the duration guard, time stamps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

RATE = 24_000
EMPTY_CHAPTER_S = 0.1


@dataclass(frozen=True)
class Gaps:
    """Seconds of silence after an utterance."""

    sentence: float = 0.25
    clause: float = 0.10
    paragraph: float = 0.40
    heading: float = 0.80


@dataclass(frozen=True)
class Guard:
    """How long a spoken text may be: outside, it is spoken again."""

    base_s: float = 2.0
    long_s: float = 0.10
    short_s: float = 0.045
    least_chars: int = 20
    slack: float = 1.25
    retries: int = 2


def terminal(text: Column) -> Column:
    """Last character before closing marks; empty where nothing is left."""
    return F.right(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+\z", ""), "[\"')\\]”’]+$", ""), F.lit(1))


def gap(text: Column, kind: Column, ends_paragraph: Column, ends_chapter: Column, gaps: Gaps = Gaps()) -> Column:
    last = terminal(text)
    return (
        F.when((kind == "heading") | ends_chapter, gaps.heading)
        .when(ends_paragraph, gaps.paragraph)
        .when(last.isin(",", ";", ":", ""), gaps.clause)
        .otherwise(gaps.sentence)
    )


def silence_samples(text: Column, rate: int = RATE, chars_s: float = 15.0, least_s: float = 0.2) -> Column:
    """Samples the silent engine makes of ``text``."""
    return (F.greatest(F.lit(least_s), F.length(text) / F.lit(chars_s)) * rate).cast("long")


def gap_samples(seconds: Column, rate: int = RATE) -> Column:
    return (seconds * rate).cast("long")


def long_limit(chars: Column, guard: Guard = Guard()) -> Column:
    return guard.base_s + guard.long_s * chars


def short_limit(chars: Column, guard: Guard = Guard()) -> Column:
    return F.when(chars < guard.least_chars, 0.0).otherwise(guard.short_s * chars)


def window_miss(chars: Column, seconds: Column, guard: Guard = Guard()) -> Column:
    """Seconds by which a take misses its window; 0 inside."""
    return F.greatest(short_limit(chars, guard) - seconds, seconds - long_limit(chars, guard), F.lit(0.0))


def clip_miss(chars: Column, seconds: Column, capped: Column, guard: Guard = Guard()) -> Column:
    """The same, infinite for a capped take that ran to its limit."""
    return F.when(capped & (seconds > long_limit(chars, guard)), F.lit(float("inf"))).otherwise(window_miss(chars, seconds, guard))


def max_new_tokens(most_chars: Column, frame_rate: float, guard: Guard = Guard()) -> Column:
    return F.ceil(long_limit(most_chars, guard) * guard.slack * frame_rate)


def max_chars_within(seconds: Column, guard: Guard = Guard()) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor((seconds - guard.base_s) / guard.long_s))


def stamp(seconds: Column) -> Column:
    """HH:MM:SS.mmm, half-even to the millisecond, hours unbounded."""
    ms = F.rint(seconds * 1000).cast("long")
    two = lambda c: F.format_string("%02d", c.cast("long"))
    return F.concat(two(F.floor(ms / 3_600_000)), F.lit(":"), two(F.floor(ms / 60_000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit("."), F.format_string("%03d", ms % 1000))


def hms(seconds: Column) -> Column:
    """H:MM:SS, floored."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("long"), (F.floor(s / 60) % 60).cast("long"), s % 60)
