import os
import random

import pytest

S = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


def document(rng, words):
    return " ".join("".join(rng.choices("abdeionrst", k=rng.randint(2, 7))) for _ in range(words))


def corpus(seed=0, n=60):
    """Documents with exact and near copies, repeated lines and passages, a hot group, very long, empty and null texts."""
    rng = random.Random(seed)
    passage, line = document(rng, 60), document(rng, 12)
    texts = []
    for i in range(n):
        kind = i % 8
        if kind == 0 or not texts:
            t = "\n".join(document(rng, rng.randint(5, 40)) for _ in range(rng.randint(1, 5)))
        elif kind == 1:
            t = rng.choice(texts)
        elif kind == 2:
            w = rng.choice(texts).split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind == 3:
            t = document(rng, 20) + "\n" + passage + "\n" + document(rng, 20)
        elif kind == 4:
            t = line + "\n" + document(rng, 30)
        elif kind == 5:
            t = rng.choice(texts).upper()
        elif kind == 6:
            t = document(rng, rng.randint(1, 7))
        else:
            t = rng.choice(texts).replace(" ", "  ", 2) + " é ß"
        texts.append(t)
    hot = document(rng, 50)
    texts += [hot] * (n // 3)  # one group holds a third of all rows
    texts += [document(rng, 3000), "x" * 5000, "ab " * 1500, "", " \t\n ", None, "\n\n"]
    rows = [(i * 3, t, rng.choice(["en", None]), rng.choice(["s1", "s1", "s1", "s2", "é", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[4], rows[7]]  # repeated rows
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names clash with those the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, S)
    names = ["id", "n", "node", "size", "word", "at", "row", "value", "digest", "entry", "score", "copy", "doc id.x"]
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(names))).cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def unique_rows(rows):
    return sorted({r[0]: r for r in rows}.values())


@pytest.fixture(scope="session")
def sf():
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables")
    return d
