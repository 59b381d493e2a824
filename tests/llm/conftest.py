import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slice string, band int, `__keep` string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("ka lo mi tur ven sol pra den ist ok".split()) + r.choice("an er il os ut".split()) for _ in range(n))


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join(w + "x" if r.random() < share else w for w in text.split())


def edge_rows():
    """Null and empty texts, white space, ties, copies, near copies, shared passages, secrets, a long text, a long word."""
    base, passage = prose(1, 150), prose(2, 60)
    texts = [None, "", " \t\n", "one", "One", "two words", base, base, base.replace(" ", "  ", 3), base.upper(), edited(base, 3, 0.02), edited(base, 4, 0.03), edited(base, 5, 0.2)]
    texts += [prose(10 + i, 40) + " " + passage + " " + prose(30 + i, 20) for i in range(6)] + [passage, passage[:200], " ".join([prose(7, 40)] * 3), "a " * 200, "x" * 3000]
    texts += ["password: hunter22 and token='abc' then AKIA" + "Z9" * 9 + " end", "é deadbeefdeadbeefdeadbeefdead secret = k" + "a1B2" * 6, "plain ▁ mark  two", "tab\there\n\nline 😀 　end ", "it's <|endoftext|> 3.14!", prose(99, 5000)]
    return [(i * 3 + 1, t, ("en", "de", None)[i % 3], f"src{i % 4}", None if t is None else len(t), "s", i, "k") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def pairs():
    return [(r[0], r[1]) for r in edge_rows()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def lone(spark):
    """Rows without a doc_id or without anything."""
    return spark.createDataFrame([(None, "a text", None, None, None, None, None, None), (5, None, None, None, None, None, None, None)], SCHEMA)
