import pytest

SAID = [
    None,
    "",
    " ",
    "Plain words, twice. Plain words, twice.",
    "  two  spaces\n\n\nlines \n end ",
    "tab\tand nbsp ▁mark▁ é 中文 \U0001f600 <|endoftext|> <s> it's we'll",
    "it" * 3000,
    "a b\n" * 800,
    "Plain words, twice. Plain words, twice.",
    "<|im_end|> <\\|x <\\\\|y",
]


@pytest.fixture
def documents(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names clash with those of results."""
    rows = [(i % 8, t, "en" if i % 2 else None, None if i % 3 else "s", i, "x") for i, t in enumerate(SAID)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int, ids string")


@pytest.fixture
def none(documents):
    return documents.limit(0)
