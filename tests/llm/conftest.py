import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _id string, _text string, fp string, key int, row int, score string, at int, n int, _i int, _k int, spans int, _text_hash string, _language string, _language_share string, kept string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from ``(doc_id, text[, lang[, source]])``, with extra columns named like inner ones."""

    def make(rows):
        full = []
        for r in rows:
            doc_id, text, lang, source = (*r, None, None)[:4]
            full.append((doc_id, text, lang, source, None if text is None else len(text), "x", "y", "z", 1, 2, "s", 3, 4, 5, 6, 7, "h", "MINE", "half", "no"))
        return spark.createDataFrame(full, COLUMNS)

    return make


PROSE = (
    "the river runs past the old mill and the children of the village play near its banks every summer while "
    "their parents talk about the harvest and the price of bread in the market town beyond the hills"
).split()


def prose(n, start=0, step=7):
    """``n`` words of which no two runs of some length are alike for different starts."""
    return " ".join(f"{PROSE[(start + i * step) % len(PROSE)]}{chr(97 + (start * 3 + i * i) % 26)}" for i in range(n))


@pytest.fixture(scope="session")
def messy(docs_of):
    """NULLs in all columns, empty, blank and very long texts, ties, repeated rows."""
    long_text = " ".join(prose(400, s) for s in range(60))
    return docs_of(
        [
            (1, prose(120), "en", "a"),
            (2, prose(120), "en", "a"),
            (None, prose(120), "en", None),
            (4, None, "en", "a"),
            (5, "", None, "b"),
            (6, " \n\t \n", "de", None),
            (7, long_text, "en", "b"),
            (8, "x" * 60000, None, "b"),
            (9, "same row", "en", "a"),
            (9, "same row", "en", "a"),
            (None, None, None, None),
            (11, "1 2 3 !!!", "en", "c"),
        ]
    )
