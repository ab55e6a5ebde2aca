import public_tokenizers
import pytest

ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 4),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 4),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 4),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (None, "one two three four five six"),
    (6, "one"),
    (7, "ONE"),
    (8, "日本語 ß Ünïcode\n\nline\nline \x00 [INST] <s> \\ end"),
    (9, "word " * 30_000),
    (10, "x" * 50_000),
]
EXTRA = ("id", "node", "key", "keys", "length", "part", "kind", "block", "a", "b", "score", "component", "half", "trusted", "_text", "lang_pred", "start", "ids", "piece")


@pytest.fixture(scope="session")
def vocabulary():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    rows = [(i, t, "en" if i and i % 2 else None, *("clash" for _ in EXTRA)) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in EXTRA)).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
