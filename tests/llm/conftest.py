import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls, empties, blanks, repeats, a very long text and clashing columns in a table that all operators have to take.
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one", "en", None, 3), (5, "one", "en", "b", 3), (5, "one", "en", "b", 3),
    (None, "no id here", "en", "b", 10), (6, "w " * 30000, "en", "a", 60000), (7, "été ☃ 𝄞 \x00 x", "fr", "a", 10), (8, "a b c d e f g h i j k l m n o p " * 8, "en", "a", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    extra = "n_words string, score string, component_id string, sig string, node string, spans string, slot string, stats string, tid string, packed string"
    names = [c.split()[0] for c in extra.split(", ")]
    return spark.createDataFrame([(*r, *["clash"] * len(names)) for r in ODD], f"{DOCS}, {extra}")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("doc_id < -1")
