"""Written forms spoken out, for English: years, decades, ranges, money, clock, ordinals, decimals, units, titles.

A rule set of our own; what no rule knows passes through as it is."""

from __future__ import annotations

import re
from functools import cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as ST

# English number words, titles, units and currencies.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = ((10**12, "trillion"), (10**9, "billion"), (10**6, "million"), (10**3, "thousand"))
ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
TITLES = {"Mr.": "mister", "Mrs.": "misses", "Dr.": "doctor", "St.": "Saint", "Mt.": "Mount"}
UNITS = {"kg": ("kilogram", "kilograms"), "g": ("gram", "grams"), "km": ("kilometer", "kilometers"), "cm": ("centimeter", "centimeters"), "mm": ("millimeter", "millimeters"), "ft": ("foot", "feet"), "lb": ("pound", "pounds"), "m": ("M", "M")}
MONEY = {"$": ("dollar", "dollars", "cent", "cents"), "£": ("pound", "pounds", "penny", "pence"), "€": ("euro", "euros", "cent", "cents")}
MONTHS = "January February March April May June July August September October November December".split()
LANGUAGES = frozenset(("en",))


def cardinal(n: int, hundred_and: bool = True) -> str:
    if n < 20:
        return ONES[n]
    if n < 100:
        return TENS[n // 10] + (f" {ONES[n % 10]}" if n % 10 else "")
    if n < 1000:
        rest = n % 100
        return f"{ONES[n // 100]} hundred" + ((" and " if hundred_and else " ") + cardinal(rest) if rest else "")
    for size, name in SCALES:
        if n >= size:
            head, rest = divmod(n, size)
            joint = " and " if 0 < rest < 100 and size == 1000 else " "
            return f"{cardinal(head, hundred_and)} {name}" + (joint + cardinal(rest, hundred_and) if rest else "")
    raise ValueError(n)


def ordinal(n: int) -> str:
    head, _, last = cardinal(n).rpartition(" ")
    last = ORDINALS.get(last) or (last[:-1] + "ieth" if last.endswith("y") else last + "th")
    return f"{head} {last}".strip()


def year(n: int) -> str:
    high, low = divmod(n, 100)
    if n % 1000 < 10:
        return cardinal(n)
    if low == 0:
        return f"{cardinal(high)} hundred"
    return f"{cardinal(high)} " + (f"oh {ONES[low]}" if low < 10 else cardinal(low))


def decade(n: int) -> str:
    high, low = divmod(n, 100)
    tail = "hundreds" if low == 0 else TENS[low // 10][:-1] + "ies" if low >= 20 else "tens"
    if low == 0 and high % 10 == 0:
        return f"{cardinal(high // 10)} thousands"
    return f"{cardinal(high)} {tail}"


def decimal(text: str) -> str:
    whole, _, part = text.replace(",", "").partition(".")
    return cardinal(int(whole or 0)) + (" point " + " ".join(ONES[int(d)] for d in part) if part else "")


def _money(m: re.Match) -> str:
    one, many, cent, cents = MONEY[m[1]]
    if m[4]:
        return f"{decimal(m[2] + (m[3] or ''))} {m[4]} {many}"
    whole = int(m[2].replace(",", ""))
    part = int((m[3] or ".0")[1:].ljust(2, "0")[:2])
    said = f"{cardinal(whole)} {one if whole == 1 else many}" if whole or not part else ""
    return f"{said} {cardinal(part)} {cent if part == 1 else cents}".strip() if part else said


def _clock(m: re.Match) -> str:
    hour, minute, half = int(m[1]), m[2], m[3]
    said = cardinal(hour)
    if minute and int(minute):
        said += f" {'oh ' + ONES[int(minute)] if int(minute) < 10 else cardinal(int(minute))}"
    elif not half:
        said += " o'clock"
    return said + (f" {half[0].upper()}M" if half else "")


def _span(m: re.Match) -> str:
    hours, minutes, seconds = (int(x) for x in m.groups())
    unit = lambda n, name: f"{cardinal(n)} {name}{'' if n == 1 else 's'}"
    return f"{unit(hours, 'hour')} {unit(minutes, 'minute')} and {unit(seconds, 'second')}"


@cache
def _rules() -> tuple:
    number = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    years = r"(?:1[0-9]|20)\d{2}"
    return tuple(
        (re.compile(p), f)
        for p, f in (
            (r"\b(?:[A-Z]\.){2,}(?=\s[\w(])", lambda m: m[0].replace(".", "")),
            (r"\bSt\.(?=\s+[A-Z][a-z]+(?:'s|’s|\b))(?!\s+No\b)", lambda m: "Saint"),
            (r"\b(?:Mr|Mrs|Dr|Mt)\.(?=\s+[A-Z])", lambda m: TITLES[m[0]]),
            (rf"\b({years})[-–]({years})\b", lambda m: f"{year(int(m[1]))} to {year(int(m[2]))}"),
            (r"(?:\bthe\s+)?(?<!\w)['’]?(\d)0s\b", lambda m: ("the " if m[0].lower().startswith("the") else "") + TENS[int(m[1])][:-1] + "ies"),
            (r"\b((?:1[0-9]|20)\d0)s\b", lambda m: decade(int(m[1]))),
            (r"([$£€])(\d{1,3}(?:,\d{3})+|\d+)(\.\d+)?(?:\s+(thousand|million|billion|trillion)\b)?", _money),
            (r"\b(\d{1,2}):([0-5]\d):([0-5]\d)\b", _span),
            (r"\b(\d{1,2}):([0-5]\d)(?:\s*([ap])\.?m\.?)?(?!\d)", _clock),
            (r"\b(\d{1,2})()\s*([ap])\.?m\.(?!\w)", _clock),
            (r"\b(January|February|March|April|May|June|July|August|September|October|November|December)\s+(\d{1,2})(?:st|nd|rd|th)\b", lambda m: f"{m[1].lower()} {ordinal(int(m[2]))}"),
            (r"\b(\d+)(?:st|nd|rd|th)\b", lambda m: ordinal(int(m[1]))),
            (r"(?<!\w)[-−](\d+(?:\.\d+)?)\s*°\s*([CF])\b", lambda m: f"minus {decimal(m[1])} degrees {'Celsius' if m[2] == 'C' else 'Fahrenheit'}"),
            (r"\b(\d+(?:\.\d+)?)\s*°\s*([CF])\b", lambda m: f"{decimal(m[1])} degrees {'Celsius' if m[2] == 'C' else 'Fahrenheit'}"),
            (rf"(?<![\w.])({number})\s?%", lambda m: f"{decimal(m[1])} percent"),
            (rf"(?<![\w.])({number})\s({units})\b(?!\.\w)", lambda m: f"{decimal(m[1])} {UNITS[m[2]][m[1] != '1']}"),
            (rf"\b((?i:in|since|until|by|from|to|of|year|c\.|ca\.|page|ended in|for)\s+)({years})\b(?![,.]\d)", lambda m: m[1] + year(int(m[2]))),
            (r"\bWorld War II\b", lambda m: "World War two"),
            (r"\bWorld War I\b", lambda m: "World War one"),
            (r"\bQ([1-4])\b", lambda m: f"Q {ONES[int(m[1])]}"),
            (rf"(?<![\w.,$£€:])({number})(?![\w:]|[.,]\d)", lambda m: decimal(m[1])),
        )
    )


def spoken(text: str, lang: str = "en") -> str:
    """``text`` as it is spoken. Raises ValueError for a language without rules."""
    if lang not in LANGUAGES:
        raise ValueError(f"no rules for {lang!r}")
    if not any(c.isdigit() for c in text) and "." not in text and "War" not in text:
        return text
    for pattern, say in _rules():
        text = pattern.sub(say, text)
    return text


@F.pandas_udf(ST.StringType())
def spoken_udf(texts: pd.Series) -> pd.Series:
    return texts.map(spoken, na_action="ignore")
