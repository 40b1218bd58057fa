import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, class string, t string, w string, row string, score string, bucket string, words string, pos string"


def sentence(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "Alpha", "beta", "gamma", "délta", "Épsilon", "zeta.", "eta,", "theta"]) + str(rng.randrange(400)) for _ in range(n))


def awkward_rows():
    """Nulls, empty and very long texts, ties, equal rows, rows sharing an id, a hot source and a hot line."""
    rng = random.Random(4)
    hot = "This very common line stands in most of the documents."
    texts = [None, "", " \t\n", "one", "\n\n\n", "MIT License", "a|b # c $ d", "ÀÉ ñandú 中文 \x85   x"]
    texts += [f"{sentence(rng, 40)}\n{hot}\n{sentence(rng, 30)}" for _ in range(30)]
    long = sentence(rng, 30_000)
    texts += [long, long + " end", "x" * 200_000, "word " * 3_000]
    base = sentence(rng, 200).split()
    for k in range(25):  # near copies of one text, all different
        texts.append(" ".join([*base[:3 * k], f"changed{k}", *base[3 * k + 1:]]))
    texts += [" ".join(base)] * 6
    texts += ["Released under the MIT License.\n  THE GNU general public license, Apache License\nMIT LICENSE", "Licensed under the  gnu very General Public License, version 3."]
    rows = [(i, t, "en", None if i % 7 == 0 else "hot" if i % 3 else f"s{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (10, "another text for an id in use", None, "hot", 1), (None, "no id " + hot, None, None, None), (None, None, None, None, None)]
    return [(*r, "c", "t", "w", "r", "s", "b", "x", "p") for r in rows]


@pytest.fixture(scope="module")
def rows():
    return awkward_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
