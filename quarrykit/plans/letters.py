"""An embedder that SQL can repeat: how often each letter occurs, and 1 for every text."""

from __future__ import annotations

import string

import numpy as np

LETTERS = string.ascii_lowercase


def letter_embedder(texts: list[str]) -> np.ndarray:
    return np.array([[t.count(x) for x in LETTERS] + [1] for t in texts], np.float32)


def counts_sql(text: str) -> str:
    counts = ", ".join(f"length({text}) - length(replace({text}, '{x}', ''))" for x in LETTERS)
    return f"list_transform([{counts}, 1], lambda c: CAST(c AS BIGINT))"


def unit_sql(counts: str) -> str:
    """The unit vector, in 32-bit floats as the embedding job makes it, widened for sums."""
    return f"list_transform({counts}, lambda z: CAST(CAST(z AS FLOAT) / CAST(sqrt(list_sum(list_transform({counts}, lambda y: y * y))) AS FLOAT) AS DOUBLE))"
