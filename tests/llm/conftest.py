import pytest

#: Rows that every operator must take: nulls in any column, empty and long texts, ties, repeated rows, clashing names.
LONG = "lorem ipsum dolor sit amet " * 4000


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [
        (1, "", "en", "a", 0, "x"), (2, None, None, None, None, None), (None, "a null id has text too", "en", "a", 22, "x"),
        (4, LONG, "en", "a", len(LONG), "x"), (5, "Same text in two rows, word for word and letter for letter.", "en", "a", 5, "x"),
        (5, "Same text in two rows, word for word and letter for letter.", "en", "a", 5, "x"), (6, "é" * 70 + " \U0001f600 ß", "de", "a", 73, "x"), (7, " \t\n ", "en", "a", 4, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def some_docs(spark):
    """A few hundred documents with exact and near copies."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    texts = [" ".join(word() for _ in range(rng.randint(3, 120))) for _ in range(60)]
    shared = " ".join(word() for _ in range(60))
    for k in range(40):
        words = texts[k % 20].split(" ")
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts += [t + "\n" + shared + "\n" + word() for t in texts[30:40]] + ["ab " * 90, "ab " * 90, "aaaa" * 60, ""]
    return spark.createDataFrame([(i * 3 + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")
