import random

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, h long, size long, key string, regs binary"


def brute_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def make_rows():
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randrange(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    base = say(200)
    words = base.split()
    passage = say(60)
    texts = [None, "", "  \n\t", "one", "two words", base, base, base, base.upper(), base.replace(" ", "\n")]
    texts += [" ".join(words[:k] + ["edit"] + words[k:]) for k in (10, 50, 150)]
    texts += [" ".join(w if rnd.random() > 0.1 else "x%d" % rnd.randrange(10**6) for w in words) for _ in range(8)]
    texts += [say(rnd.randrange(30, 90)) + " " + passage + "\n" + say(rnd.randrange(5, 50)) for _ in range(8)]
    texts += ["x" * 30000, say(20000), "la " * 500, "👩‍🚀 漢字 <|endoftext|> a  b\r\n", "Licensed under the Apache License, Version 2.0.\nfoo"]
    texts += [say(rnd.randrange(1, 120)) for _ in range(40)]
    rows = [(i, t, rnd.choice(["en", "fr", None, ""]), rnd.choice(["b", "a", None, "c", "a"]), len(t or "")) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Nulls in most columns, empty and very long texts, copies, and extra columns whose names operators use themselves."""
    return spark.createDataFrame([(*r, 1, None, 3, 4, "k", None) for r in rows], KIND).repartition(5)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
