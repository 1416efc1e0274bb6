import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, t string, k int, own string, gone int"


def prose(rng: random.Random, n: int, lines: int = 8) -> str:
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 5))) for _ in range(n)]
    return "".join(w + ("\n" if rng.random() < lines / max(n, 1) else " ") for w in words).strip()


@pytest.fixture(scope="session")
def rows():
    """Texts of every awkward kind: null, empty, blank, no letters, long, equal, nearly equal, repeated rows, null ids."""
    rng = random.Random(3)
    base = [prose(rng, rng.randint(1, 220)) for _ in range(40)]
    passage = prose(rng, 70, 0)
    texts = [None, "", "  \n\t ", "12 34 !!", "x", "a b  c", "😀 <|endoftext|> </s> ▁ \x00", "la " * 5000, "z" * 3000, *base]
    texts += [base[0], base[0].upper(), base[1] + " end", base[2] + "\n" + passage, passage + " " + base[3], base[4] + " " + passage + " " + base[5]]
    words = base[6].split(" ")
    texts += [" ".join([*words[:k], "zz", *words[k + 1 :]]) for k in (3, len(words) // 2)] if len(words) > 8 else []
    texts += [("A short line.\n" * 3) + "one two three four five six seven eight nine ten eleven\n" + base[k] for k in (7, 8, 9)]
    out = [(i * 3, t, "xy"[i % 2], "s", 0, 1, "t", 2, "own", 3) for i, t in enumerate(texts)]
    return [*out, out[12], out[12], (None, base[3], None, None, None, None, None, None, None, None), (9_000, None, "x", "s", 0, 1, "t", 2, "own", 3)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
