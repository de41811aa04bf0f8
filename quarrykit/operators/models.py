"""Models in tasks: loaded once per Python worker, and called with batches of texts of like length."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np


class Model(NamedTuple):
    """A name, and a function that loads the model: a callable on lists of texts (or, to score pairs, on two of them)."""

    name: str
    load: Callable[[], Callable]


_LOADED: dict[str, Callable] = {}


def loaded(model: Model | Callable) -> Callable:
    """The callable of a model, kept by name for all later tasks of this worker; a plain callable is its own model."""
    if not isinstance(model, Model):
        return model
    if model.name not in _LOADED:
        _LOADED[model.name] = model.load()
    return _LOADED[model.name]


def by_length(lengths: np.ndarray, batch: int, cells: int | None = None) -> Iterator[np.ndarray]:
    """Rows from short to long in batches of up to `batch`, padded to no more than `cells` characters in all (or one row).

    Neighbours are about equally long, so little of a padded batch is padding.
    """
    order, at = np.argsort(lengths, kind="stable"), 0
    while at < len(order):
        end = min(at + batch, len(order))
        if cells is not None:
            size = lengths[order[at:end]] * np.arange(1, end - at + 1)
            end = at + max(1, int(np.searchsorted(size, cells, "right")))
        yield order[at:end]
        at = end


def run_by_length(model: Callable, columns: list[list[str]], batch: int, cells: int | None = None) -> list[Any]:
    """The model's results for all rows, in their order."""
    out: list[Any] = [None] * len(columns[0])
    lengths = np.array([sum(map(len, row)) for row in zip(*columns, strict=True)], np.int64)
    for rows in by_length(lengths, batch, cells):
        made = model(*([column[i] for i in rows] for column in columns))
        for i, value in zip(rows, made, strict=True):
            out[i] = value
    return out
