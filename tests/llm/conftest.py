import random

import pytest

WORDS = "report filter clause valve budget annex sensor queue policy ledger router gasket payroll signature notice archive vendor premium deposit matrix tenant worker schema token".split()


@pytest.fixture()
def prose():
    """A maker of word sequences that rarely repeat."""
    rng = random.Random(5)

    def make(n: int) -> str:
        return " ".join(f"{rng.choice(WORDS)}{rng.randrange(1000)}" if rng.random() < 0.3 else rng.choice(WORDS) for _ in range(n))

    return make
