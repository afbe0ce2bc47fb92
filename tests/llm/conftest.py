import pytest

from feedloom.llm import common

common.PAUSE = common.HEARD = 0  # disk is no concern here

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as further columns.
CLASH = "row string, n string, h string, kind string, batch string, key string, queue string, _span_doc string, component string"


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls in every column, empty and blank texts, a long one, copies, a repeated row and columns of clashing names."""
    prose = "The cat sat on the mat and looked at the moon. It was a bright night over the quiet town. Nobody saw the cat leave again. "
    rows = [
        (1, prose * 3, "en", "a", 1),
        (2, prose * 3, "en", "a", 1),
        (2, prose * 3, "en", "a", 1),
        (3, None, "en", None, None),
        (4, "", None, "b", 0),
        (5, " \n\t ", "de", "b", 3),
        (None, "text without an id", "en", "b", 3),
        (6, "word " * 60_000, "en", "a", 1),
        (7, "Ünïcödé wörds — and “quotes” 漢字", "de", "c", 1),
        (8, "x" * 5000, "en", "a", 1),
        (9, "short", "fr", "a", 1),
    ]
    clash = [c.split()[0] for c in CLASH.split(", ")]
    return spark.createDataFrame([r + ("z",) * len(clash) for r in rows], f"{DOCS}, {CLASH}")


@pytest.fixture(scope="session")
def none(hard):
    return hard.limit(0)
