import random

import pytest

WORDS = [a + b for a in ("ba", "de", "ki", "lo", "mu", "na", "po", "re", "si", "tu") for b in ("", "ran", "tel", "vis", "mon", "dor")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=1):
    """Texts with copies, near copies, shared passages, odd and empty ones; ids repeat and miss."""
    rng = random.Random(seed)
    base = [prose(rng, n) for n in (3, 4, 5, 6, 40, 60, 90, 150, 400)]
    texts = [*base, *base[4:7], *base[5:6] * 5]
    for t in base[4:]:
        words = t.split()
        for k in (1, 2, 4):
            near = list(words)
            for _ in range(k):
                near[rng.randrange(len(near))] = "x" + rng.choice(WORDS)
            texts.append(" ".join(near))
    passage = prose(rng, 70)
    texts += [prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 20) for _ in range(4)]
    texts += [passage[:210] + passage[:210], "", None, " \t\n", "One", "éàü ÉÀ été", "a" * 500, "ab " * 300, prose(rng, 9000), "\x0b\x0c tab\tsep  two"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(7, base[7], "en", "s1", 1), (None, base[6], None, None, None), (None, prose(rng, 20), "de", "s0", 0), (rows[5][0], rows[5][1], "en", "s2", 9)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with columns named like what operators add or use."""
    from pyspark.sql import functions as F

    names = "copy rate shuffle_key size shard slot law kept fp bucket bands text_key place anchor k1 k2 spans media streams pattern index value score votes n_entities _row _found _u _who piece start length sequence_id offset event".split()
    return docs.withColumns({n: F.lit("clash") for n in names})
