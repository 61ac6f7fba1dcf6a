import random

import pytest

#: Texts that any operator must stand: null, empty, white space, repeats, ties, odd characters.
ODD = [None, "", " \n\t ", "one", "One one", "a b c d", "a b c d e", "x\u00a0y Σίσυφος İstanbul 日本語", "<|endoftext|> it's o'clock", "tail\n\n\ntail\ntail", "k" * 5000]


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    stems = ["the", "of", "lan", "ter", "mi", "so", "Gra", "ène", "öl", "ción", "re", "und"]
    return ["".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(400)]


@pytest.fixture(scope="session")
def texts(words):
    """About 150 texts: the odd ones, prose with lines, copies, near copies, one long text."""
    rng = random.Random(6)
    out = list(ODD)
    for _ in range(60):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 30))) + "." for _ in range(rng.randint(1, 8))]
        out.append("\n".join(lines))
    for _ in range(40):
        base = rng.choice(out[len(ODD) :]).split(" ")
        for _ in range(rng.randint(1, 3)):
            base[rng.randrange(len(base))] = rng.choice(words)
        out.append(" ".join(base))
    out += [rng.choice(out) for _ in range(30)]
    out.append(" ".join(rng.choice(words) for _ in range(9000)))
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents with extra columns whose names clash with the operators' own."""
    rows = [(i, t, ["en", "de", None][i % 3], f"src{0 if i % 3 == 0 else i % 5}", len(t or ""), i, "x", True, -1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest long, hash string, kept boolean, score double").repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def nulls(spark):
    """Rows with nulls in every column, one of them twice."""
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, None, None, None, None), (1, "a b", None, None, 3), (2, "a b", None, None, 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def as_dir(frame, folder, table="documents"):
    """Write a table as a query's input folder."""
    frame.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    return str(folder)
