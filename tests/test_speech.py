import pytest

from folioflow.functions.speech import spoken

PAIRS = [
    ("By 1886 she had left", "By eighteen eighty six she had left"), ("since the 1930s", "since the nineteen thirties"), ("all of the 3000 and the 1800s", "all of the three thousand and the eighteen hundreds"),
    ("The reign of 1702-1714 was short.", "The reign of seventeen oh two to seventeen fourteen was short."), ("He owed £2.75 and €1.", "He owed two pounds seventy five pence and one euro."),
    ("About 45% of $3.4 million", "About forty five percent of three point four million dollars"), ("They met at 7:05 and 16:00.", "They met at seven oh five and sixteen o'clock."), ("at 4 p.m. sharp", "at four PM sharp"),
    ("the 3rd, 12th and 40th day", "the third, twelfth and fortieth day"), ("some 0.75 of it", "some zero point seven five of it"), ("250,000 rivets", "two hundred and fifty thousand rivets"),
    ("Mrs. Ort and Dr. Vale of Mt. Pash", "misses Ort and doctor Vale of Mount Pash"), ("8 km and 1 kg", "eight kilometers and one kilogram"), ("2,304 names", "two thousand three hundred and four names"),
    ("after 1:01:30 of it", "after one hour one minute and thirty seconds of it"), ("a mild 12 °C", "a mild twelve degrees Celsius"), ("on May 5th", "on may fifth"),
    ("Book XI", "Book XI"), ("half- way", "half- way"), ("so . . . on", "so . . . on"), ("‘Well,’ — she said…", "‘Well,’ — she said…"), ("", ""),
]


@pytest.mark.parametrize("written, want", PAIRS)
def test_written_forms(written, want):
    assert spoken(written) == want


def test_unknown_language():
    with pytest.raises(ValueError):
        spoken("x", "xx")
