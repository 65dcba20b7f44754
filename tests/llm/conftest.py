import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _doc string, fp string, h double, _text string"
LONG = " ".join(f"word{i % 977} tail{i}" for i in range(60_000))
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"


@pytest.fixture(scope="session")
def texts():
    """Texts with what documents can hold: null, empty, repeats, near copies, long ones, odd characters."""
    base = "The quick brown fox jumps over the lazy dog near the river bank today and every other day of the week."
    return [
        (3, "one shared line of text\nown line three\none shared line of text\nshort"), (1, "ONE shared line of text  \nfirst line only here"), (2, None), (4, ""), (None, "one shared line of text\nnull id line"),
        (5, base), (6, base), (6, base), (7, base.replace("lazy", "idle")), (8, "   "), (9, LONG), (10, "x" + LONG[:-3]), (11, "naïve ÇA 你好 \u0000 <b>&amp; a@b.example.com x +1 (499) 555-6503 y 4111 1111 1111 1111 z 1.2.3.4"),
        (12, f"Start {ITEM}! End"), (13, "alpha beta gamma delta epsilon zeta eta theta iota other kappa"), (14, "tiny words"), (15, "\n\n"), (16, "Tiny Words, again. tiny words"),
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, "s", None, "clash", "clash", 1.5, "clash") for i, t in texts], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
