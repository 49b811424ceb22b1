"""Texts for the tests of this folder."""

from __future__ import annotations

import random


def words(seed: int, n: int) -> str:
    """Prose of ``n`` words with sentences and lines, the same for one seed."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        word = "".join(rng.choice(("ta", "ner", "so", "li", "mo", "ré", "the", "und")) for _ in range(rng.randint(1, 4)))
        out.append(word + (".\n" if i % 17 == 16 else "." if i % 9 == 8 else ""))
    return " ".join(out)
