import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, digest string, score double, size long, keep_id long, dedup_key string, block int, readings int"


def extra(doc_id, text, source="src1"):
    return (doc_id, text, "en", source, len(text or ""), "x", 0.5, 1, 2, "k", 3, 4)


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, columns with clashing names."""
    words = [f"w{i % 997}x{i % 89}" for i in range(60_000)]
    near = "the quick brown fox jumps over the lazy dog and runs far away from the big bad wolf that lives in the dark green wood near our old town by the sea".split()
    rows = [
        extra(1, " ".join(near)),
        extra(2, " ".join(near[:-1] + ["lake"])),
        extra(3, " ".join(near)),
        extra(3, " ".join(near)),
        extra(4, None),
        extra(5, ""),
        extra(6, " \n\t "),
        extra(7, " ".join(words), None),
        extra(8, " ".join(words[:-5]), None),
        extra(9, "two words", "src2"),
        extra(10, "TWO Words", "src2"),
        extra(None, "a row without an id and some words", "src2"),
        extra(11, "naïve café ünïcode 😀 text with emoji 😀 and more words here", "src3"),
        (12, None, None, None, None, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
