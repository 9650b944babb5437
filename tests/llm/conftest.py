import pytest

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, copies int, fp string, ids string, _row int"


def prose(words, n, seed):
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(words) for _ in range(n)) + "."


EN = "the and water house river stone light morning bread table window garden people never always walking under bright".split()
DE = "der die das und wasser haus fluss stein licht morgen brot tisch fenster garten menschen niemals immer unter straße".split()


def hard_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing columns."""
    extra = (7, 0.5, 2, "x", "y", 1)
    rows = [(i, prose(EN, 60, i), "en", f"s{i % 3}", 10, *extra) for i in range(20)]
    rows += [(i, prose(DE, 60, i), "de", f"s{i % 3}", 10, *extra) for i in range(20, 40)]
    rows += [rows[0], rows[0], (40, rows[1][1], "en", "s0", 1, *extra), (41, rows[1][1].replace("water", "Water", 1), "en", None, 1, *extra)]
    rows += [(42, None, "en", "s0", None, *extra), (43, "", "en", "s1", 0, *extra), (44, "  \n\t ", None, "s2", 4, *extra),
        (45, "12 34 !! 56", None, None, 9, *extra), (None, "the house", None, None, None, *extra), (None, None, None, None, None, *extra)]
    rows += [(46, prose(EN, 60_000, 99), "en", "s0", None, *extra), (47, "x" * 300_000, "en", "s1", None, *extra),
        (48, "Σίσυφος <|endoftext|> é́ \x1c 日本語 😀", None, "ü", 5, *extra)]
    return rows


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(hard_rows(), FIELDS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], FIELDS)


@pytest.fixture(scope="session")
def marks(spark):
    rows = [(i, i % 2, (i // 2) % 2, "z") for i in range(0, 40)] + [(None, 1, 1, "z"), (1, None, None, "z"), (3, 2, 5, "z"), (5, 0, 0, "z")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, y string")
