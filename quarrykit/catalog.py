"""The registered queries and their SQL twins."""

from __future__ import annotations

from quarrykit.plans import answers, corpus, retrieval, storage

QUERIES: dict = {**corpus.QUERIES, **retrieval.QUERIES, **answers.QUERIES, **storage.QUERIES}
ORACLES: dict = {**corpus.ORACLES, **retrieval.ORACLES, **answers.ORACLES, **storage.ORACLES}
