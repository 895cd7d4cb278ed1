import hashlib
import random

import pytest


def words(rng, n, alphabet="abcdefghij"):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 8))) for _ in range(n)]


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared lines and passages, odd characters, none, empty and a long one."""
    rng = random.Random(4)
    line = " ".join(words(rng, 9))
    passage = " ".join(words(rng, 60))
    base = words(rng, 120)
    out = [None, "", "   ", "\n\n", "a", "one two three four", "One  two\tthree FOUR", "é ü 日本語 🙂 ▁x <s>", "\x00 b \x1f c", "x" * 500, " " * 300 + "end"]
    for i in range(50):
        t = " ".join(words(rng, rng.randrange(1, 150)))
        if i % 3 == 0:
            t += "\n  " + (line.upper() if i % 2 else line) + " \n" + " ".join(words(rng, 8))
        if i % 5 == 0:
            t += " " + passage
        out.append(t)
    for i in range(14):  # near copies
        w = list(base)
        w[rng.randrange(len(w))] = f"edit{i}"
        out.append(" ".join(w))
    out += [out[20]] * 4 + [" ".join(base)]
    out.append("\n".join(" ".join(words(rng, 12)) for _ in range(1500)))
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """A documents table; with a repeated row, null ids, languages and sources, and columns with the operators' own names."""
    rows = [(i, t, (None, "en", "fr")[i % 3], (None, "s1", "s2", "s1", "s1")[i % 5], len(t or ""), "x", i) for i, t in enumerate(texts)]
    rows.append(rows[15])
    rows.append((None, "a row without an id", "en", "s1", 19, "x", 1))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, token bigint").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()
