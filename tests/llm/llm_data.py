"""Invented texts for the tests of this folder."""

import random

WORDS = "alpha beta gamma delta river stone cloud tiger apple quiet seven lemon paper north under maple ocean brick".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", str(rng.randint(0, 99))]) for _ in range(n))
