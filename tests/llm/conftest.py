import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, score int, n int, `key` int, digest string, component string, uid string, seeds string, kept int, slice int, file int, part int, _text_key long, _n_tokens int, _epoch int, _position int, _0 string, _score int, label string, held int"
EXTRA = ("x", 1, 2, 3, "d", "c", "u", "s", 4, 5, 6, 7, 8, 9, 10, 11, "z", 12, "l", 13)


def prose(rng, n, words=None):
    words = words or ["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "green", "walks", "under", "the", "of", "and"]
    out = []
    for i in range(n):
        w = rng.choice(words) + str(rng.randrange(30) if rng.random() < 0.3 else "")
        out.append(w.capitalize() if i % 9 == 0 else w + "." if i % 9 == 8 else w)
    return " ".join(out)


def odd_rows():
    """Null and empty texts, white space, one very long word, a very long text, repeats, null ids and columns."""
    rng = random.Random(1)
    long_text = prose(rng, 30_000)
    same = prose(rng, 80)
    texts = [None, "", " \n\t ", "x" * 300_000, long_text, same, same, same.replace("river", "brook"), "One short line.", "Zwei kurze Wörter über ñandú 日本語 \U0001f600."]
    rows = [(i, t, "en" if i % 2 else None, ["a", "a", None][i % 3], len(t or ""), *EXTRA) for i, t in enumerate(texts)]
    rows.append((5, same, "en", "a", len(same), *EXTRA))  # an id twice, with the same text
    rows.append((5, "Another text with this id.", "en", "b", 10, *EXTRA))
    rows.append((None, same, None, None, None, *EXTRA))
    rows.append((None, None, None, None, None, *([None] * len(EXTRA))))
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
