import random

import pytest


@pytest.fixture(scope="session")
def texts():
    """doc_id -> text: nulls, empties, repeats, near copies, shared passages, odd white space, one long text."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["Été", "The", "the", "ÿ", "word,", "end."]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = make(60), make(120).split(" ")
    out = {0: None, 1: "", 2: "   \n\t ", 3: "one", 4: "one", 5: "ONE two three", 6: "one TWO three", 7: "a b c d", 8: passage}
    for i in range(9, 30):
        out[i] = f"{make(rng.randrange(5, 40))}\n{passage}\n{make(rng.randrange(5, 40))}"
    for i in range(30, 60):
        near = list(base)
        for _ in range(rng.randrange(4)):
            near[rng.randrange(len(near))] = rng.choice(words)
        out[i] = rng.choice([" ", "  ", "\n"]).join(near)
    for i in range(60, 80):
        out[i] = make(rng.randrange(200))
    out[80], out[81] = make(20_000), out[70]
    out[82] = "x" * 5000
    out[83] = " ".join(["same words again and"] * 40)
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with the columns of documents and extra ones whose names clash with results."""
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 4}", len(t) if t else 0, -1.0, "x") for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, n_words string").repartition(5)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
