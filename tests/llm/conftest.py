import random

import pytest

WORDS = [a + b for a in "ba ce di fo gu ka le mi no pu".split() for b in "ra se ti lo nu".split()]


@pytest.fixture
def prose():
    """A maker of invented texts: prose(seed, n) has n words."""
    def make(seed, n):
        rng = random.Random(str(seed))
        return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))

    return make
