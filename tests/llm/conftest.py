import pytest

#: Names that operators use inside, as extra columns of the input.
CLASHING = ("row", "same", "id", "tie", "start", "n", "node", "bands", "spans", "known", "ws", "measured", "m", "quality", "pieces", "kept")


@pytest.fixture(scope="session")
def table(spark):
    """Documents as (doc_id, text) rows with extra columns of clashing names."""

    def make(rows, id_kind="bigint"):
        extra = ", ".join(f"`{c}` string" for c in CLASHING)
        return spark.createDataFrame([(*r, *("x",) * len(CLASHING)) for r in rows], f"doc_id {id_kind}, text string, {extra}").coalesce(2)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, one very long text, repeated rows, one id twice."""
    long = " ".join(f"word{i % 977} of{i % 31}" for i in range(40_000))
    return [(1, "a b c d e f g h"), (None, "no id here at all"), (2, None), (None, None), (3, ""), (4, " \n\t "), (5, long),
            (6, "same row twice over and over"), (6, "same row twice over and over"), (7, "one id"), (7, "two texts of one id"), (8, "é🎉 ß naïve")]


@pytest.fixture(scope="session")
def thue_morse():
    """A Thue-Morse word of 1,024 letters and its complement: they collide under every
    polynomial with an odd base modulo a power of two."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    return word, word.translate(str.maketrans("ab", "ba"))
