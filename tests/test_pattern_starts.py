"""Texts that no pattern stands in are passed over before the automaton."""

import random

import numpy as np
import pyarrow as pa
import pytest

from graniteleaf.functions.arrays import text_slices
from graniteleaf.operators import matching


@pytest.mark.parametrize("least", [8, 20, 60])
def test_only_texts_with_the_start_of_a_pattern_are_read(least):
    rng = random.Random(least)
    word = lambda: rng.choice(["der", "die", "größe", "a", "nä", "日本", "the "]) + str(rng.randint(0, 9))
    texts = [" ".join(word() for _ in range(rng.randint(0, 200))) for _ in range(400)]
    patterns = [p for p in (t[k : k + least + 30] for t in rng.sample(texts, 60) for k in [rng.randint(0, 50)]) if len(p.encode()) >= least][:20]
    texts += ["x" + p for p in patterns] + [p[:-1] for p in patterns] + ["", *patterns]
    automaton = matching._Automaton(patterns)
    held = {i for i, t in enumerate(texts) if any(p in t for p in patterns)}
    for most in (1, 5000, 1 << 22):
        got = {a + int(i) for a, ends, data in text_slices(pa.array(texts), most) for i in automaton.likely(ends, data)}
        assert held <= got and all(automaton.within(texts[i]) for i in held)
        if least > 8:
            assert len(got) < len(texts) / 2


def test_short_and_empty_patterns_are_looked_for_everywhere():
    ends, data = np.array([3, 3, 9]), np.frombuffer(b"abcdefghi", np.uint8)
    for patterns in (["ab"], ["ab", "y" * 40], ["", "y" * 40], [""]):
        assert list(matching._Automaton(patterns).likely(ends, data)) == [0, 1, 2]
    assert list(matching._Automaton(["y" * 40]).likely(ends, data)) == []
    assert list(matching._Automaton(["defghi" + "j" * 2]).likely(ends, data)) == []
