from __future__ import annotations

import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """prose(n, seed): n words of invented prose, sentences and lines."""

    def make(n, seed):
        rng = random.Random(seed)
        syllables = ["er", "th", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or"]
        out = []
        for k in range(n):
            w = "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
            out.append(w.capitalize() if k % 9 == 0 else w + "." if k % 9 == 8 else w)
        lines = [" ".join(out[i : i + 27]) for i in range(0, n, 27)]
        return "\n".join(lines)

    return make
