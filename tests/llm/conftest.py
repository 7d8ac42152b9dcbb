import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# columns with names that the operators use themselves
CLASHES = "h long, row long, term string, start long, score double, component_id long, weight double, shared boolean"

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus():
    rng = random.Random(3)
    passage, line = words(rng, 60), words(rng, 12)
    plain = [words(rng, rng.randint(20, 120)) for _ in range(40)]
    near = plain[0].split()
    near[5] = "changed"
    texts = [
        *plain,
        plain[0],
        plain[0],
        " ".join(near),
        f"{words(rng, 20)} {passage} {words(rng, 20)}",
        f"{passage} {words(rng, 5)}",
        f"{words(rng, 3)} {passage.upper()}",
        *(f"{words(rng, 15)} {line} {words(rng, 15)}" for _ in range(12)),
        f"{words(rng, 4)} {ITEM.upper()}, {words(rng, 4)}",
        "Alpha-beta.gamma delta;epsilon zeta eta theta iota KAPPA",
        "mail a.b+c@x-y.example.org or d@e.f.g_h@i.jk, 10.0.0.255 and 1.2.3.4.5.6.7.8 or 300.1.1.1 not",
        "card 4111 1111 1111 1111 and 4111-1111-1111-1112, phone +1 (555) 123-4567 +12 +49 30 1234567890 é +1",
        None,
        "",
        " \t\n",
        "###",
        "one",
        "ÀÉ 日本語 текст <|endoftext|> 😀",
        words(rng, 30_000),
        "a" * 60_000,
        "7" * 60_000,
        "7 " * 30_000,
        "a@" * 20_000,
    ]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s0", "s0", "s1", None][i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[1], rows[1], (2, "same id, other text", "en", "s1", 19), (None, plain[3], "en", "s0", 1), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def corpus_rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, corpus_rows):
    extra = (7, 8, "x", 9, 0.5, 10, 1.5, True)
    return spark.createDataFrame([r + extra for r in corpus_rows], f"{SCHEMA}, {CLASHES}").repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="session")
def benchmark(spark):
    rows = [(1, ITEM), (2, "Delta! epsilon"), (3, None), (4, "..."), (None, "kappa lambda"), (10, ITEM)]
    return spark.createDataFrame(rows, "item_id long, text string")
