"""Very long texts of one kind take time in proportion: none of the patterns goes back over a text again and again."""

import time
from collections import Counter

import pytest

from folioflow.llm import encoding, leakage, lookalikes, markup, pieces, sentences, stuffing

TEXTS = {
    "letters": "a" * 200_000, "stops": "a.b" * 60_000, "quotes": "''a " * 40_000, "stars": "**a " * 40_000, "tags": "<a " * 50_000, "braces": "{{a " * 40_000, "money": "$a " * 50_000,
    "brackets": "[a " * 50_000, "lines": "a\n" * 80_000, "accents": "é" * 100_000, "garbled": "Ã©" * 50_000, "han": "林安云打量着马车" * 12_000, "marks": "e" + "́" * 50_000, "ats": "a@" * 60_000, "blanks": " " * 200_000,
}
MODEL = encoding.Model(Counter({"aé": 10}), 1000, {})
STEPS = {
    "sentences": sentences.scan, "encoding": MODEL.restore, "signs": markup.signs, "stream": lambda t: markup.folded(markup.stream(t)), "blocks": markup.blocks, "one form": lookalikes.one_form,
    "pieces": lambda t: pieces.cut(t, "chars", 300, 30), "words": leakage.words, "lines": lambda t: stuffing.diverging(t, {"the": 0.05}),
}


@pytest.mark.parametrize("name", TEXTS)
@pytest.mark.parametrize("step", STEPS)
def test_time_follows_length(step, name):
    began = time.perf_counter()
    STEPS[step](TEXTS[name])
    assert time.perf_counter() - began < 20
