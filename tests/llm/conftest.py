import random

import pytest

WORDS = "the of and tion ing ère que ción über haus lamp river stone glass paper cloud tree ocean light".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Ids and texts with copies, near copies, repeated lines, nulls, empty and long texts."""
    rng = random.Random(5)
    out = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    base = prose(rng, 150).split()
    for _ in range(25):
        one = list(base)
        for _ in range(rng.randint(0, 4)):
            one[rng.randrange(len(one))] = rng.choice(WORDS) + "x"
        out.append(" ".join(one))
    line = "This line is in many documents."
    out += [f"{prose(rng, 20)}\n{line}\n{prose(rng, 5)}" for _ in range(20)]
    out += [out[3], out[3].upper(), out[7] + " ", line, f" {line.upper()}\t", f"{line}\n{line}", "short\nshort\n", "\n\n"]
    out += ["", None, " ", "\t\n", "one", "one two", "one two three", "one two three four", "émigré 😀 漢字 \x1c\x85x  y"]
    out += [prose(rng, 6000), "x" * 30_000, "7" * 5000, ("a b " * 3000).strip()]
    return list(enumerate(out))


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents; columns of other names and of names that operators use must not matter."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, token string, start long, score double, rep long"
    rows = [(i, t, "en", None, len(t or ""), -i, "z", 1, 0.5, 3) for i, t in texts]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
