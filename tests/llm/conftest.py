import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and blank texts, one word, odd characters, repeats, a very long text.
ODD = [None, "", " \n\t\x0b", "word", "a b", "Σίσυφος ΑΣ İstanbul naïve ﬁne", "x y z\u0085w \x1c v", "漢字 🙂 é <|endoftext|> 's", "same " * 80, "n\nn\nn\n\nn", "#*$%&|<> !!", "long " + "w" * 3000 + " tail", "\x00\x01 ctrl"]


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeéñü") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = sentence(60)
    plain = [sentence(rng.randint(5, 200)) for _ in range(40)]
    shared = [f"{sentence(20)} {passage} {sentence(20)}" for _ in range(6)]
    near = [plain[3] + " tail" + str(i) for i in range(4)]
    return [*ODD, *plain, *shared, *near, plain[0], plain[0], passage * 2, sentence(12_000)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", "s0", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, texts[25], None, None, None), (None, None, None, None, None)]  # repeated rows, no id
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """A table with columns named like outputs and inner columns."""
    from pyspark.sql import functions as F

    names = ["score", "evidence", "leaks", "ids", "decoded", "n_tokens", "n_words", "kept", "anomaly", "factors", "kept_text", "simhash", "id", "rk", "n", "first", "key", "licenses", "label", "terms", "count", "text_low", "ids_by_line", "__a", "__b", "__id", "__rk", "__found", "__spans", "__first", "__order", "__n", "row_hash", "rest", "further_0", "folder"]
    return docs.withColumns({n: F.lit("x") for n in names})


@pytest.fixture(scope="session")
def labels(spark, texts):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(len(texts))], "doc_id long, quality int, toxic int")
