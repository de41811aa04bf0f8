"""Text kernels against plain Python, in pieces of any length, and bounded memory on one very long text."""

import random
import re
import resource
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from quarrykit.llm import crf, divergence, kernels, langid, lines


def laid(texts):
    return kernels.text_buffers(pa.array(texts, pa.string()))


def some_texts(seed=3):
    rng = random.Random(seed)
    letters = "ab c\n\t.#É|wörd"
    return [None, "", " ", *("".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(60)), "x" * 90, ""]


@pytest.mark.parametrize("chunk", [1, 2, 7, 64])
def test_pieces_do_not_matter(chunk, monkeypatch):
    raw, offsets = laid(some_texts())
    model = langid.Model(["a", "b"], np.random.default_rng(1).normal(size=(2, 1 << langid.CELL_BITS)).astype(np.float32), np.ones((len(langid.SCRIPTS), 2), bool))

    def everything():
        words = kernels.word_table(raw, offsets, lower=True)
        counts = divergence.base_counts(raw, offsets, words)
        return [*words, *lines.line_table(raw, offsets), *counts.values(), divergence._classes(raw, offsets), crf.line_features(raw, offsets)[1], langid._word_scores(raw, offsets, words, model)]

    whole = everything()
    monkeypatch.setattr(kernels, "_CHUNK", chunk)
    for a, b in zip(whole, everything(), strict=True):
        np.testing.assert_allclose(a, b, atol=1e-4) if a.dtype.kind == "f" else np.testing.assert_array_equal(a, b)


def test_words_and_hashes():
    texts = some_texts()
    raw, offsets = laid(texts)
    words = kernels.word_table(raw, offsets)
    plain = [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert [(d, raw[a:b].tobytes().decode()) for d, a, b in zip(words.doc, words.start, words.end, strict=True)] == plain
    assert len(set(words.hash.tolist())) == len({w for _, w in plain})
    table = lines.line_table(raw, offsets)
    split = [(i, x) for i, t in enumerate(texts) if t for x in t.split("\n")]
    assert [(d, raw[a:b].tobytes().decode()) for d, a, b in zip(table.doc, table.start, table.end, strict=True)] == split
    assert table.filled.tolist() == [bool(re.search(r"[^\x20\x09-\x0D]", x)) for _, x in split]


LONG = """
import resource, sys
import numpy as np
from quarrykit.llm import crf, divergence, kernels, langid
n = 50_000_000
raw = np.frombuffer({text}, np.uint8)
offsets = np.array([0, len(raw)])
model = langid.Model(["a", "b"], np.zeros((2, 1 << langid.CELL_BITS), np.float32), np.ones((len(langid.SCRIPTS), 2), bool))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
words = kernels.word_table(raw, offsets)
langid._word_scores(raw, offsets, words, model)
divergence.base_counts(raw, offsets, words)
divergence._classes(raw, offsets)
kernels.windows(words, 13)
crf.line_features(raw, offsets)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""


@pytest.mark.parametrize(("text", "most_mb"), [("b'x' * n", 60), ("(b'some words here ' * 60 + b'end of it\\n') * (n // 970)", 1900)])
def test_memory_of_one_long_text(text, most_mb):
    """50 MB without a delimiter, and as words and lines: memory follows the number of words, not of bytes."""
    made = subprocess.run([sys.executable, "-c", LONG.format(text=text)], capture_output=True, text=True, check=True)
    assert int(made.stdout) / 1024 < most_mb
    assert resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss > 0
