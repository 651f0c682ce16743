from __future__ import annotations

import random

import pytest
from odd_rows import ODD


@pytest.fixture(scope="session")
def prose():
    """Random words from a small alphabet: ``prose(seed, n)``."""

    def words(seed: int, n: int) -> str:
        rng = random.Random(seed)
        return " ".join("".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 7))) for _ in range(n))

    return words


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
