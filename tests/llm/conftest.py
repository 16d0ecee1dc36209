import random

import pytest

WORDS = ["the", "of", "and", "to", "in", "river", "stone", "market", "winter", "garden", "letter", "window", "silver", "mountain", "paper", "bridge", "history", "music", "harbour", "candle"]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 40)) for _ in range(n))


def corpus():
    """(doc_id, text, lang, source): nulls, empty and blank texts, a very long one, exact and near copies, repeated ids, ties."""
    rnd = random.Random(4)
    rows = [(i, prose(rnd, rnd.randint(1, 120)), ["en", "fr", None][i % 3], ["a", "b", "é", None][i % 4]) for i in range(60)]
    base = prose(rnd, 150)
    rows += [(100, base, "en", "a"), (101, base, "en", "b"), (102, base.upper(), "en", "a")]
    for i in range(8):
        w = base.split(" ")
        w[rnd.randrange(150)] = f"edit{i}"
        rows.append((110 + i, " ".join(w), "en", "a"))
    rows += [(200, None, "en", "a"), (201, "", "en", None), (202, " \n\t ", None, "b"), (203, "a", "en", "b"), (204, "1234 !! ??", "fr", "b"), (205, "x" * 120, "en", "a"), (206, "word " * 30, "en", "a")]
    rows += [(207, prose(rnd, 30_000), "en", "a"), (208, "ab cd é ß\x1c z", "fr", "a")]
    rows += [(300, prose(random.Random(9), 40), "en", "a")] * 2 + [(301, "one text", "en", "a"), (301, "another text of the same id", "en", "b")]
    rows += [(None, "no id here at all", "en", "a"), (None, None, None, None)]
    rnd.shuffle(rows)
    return rows


#: Columns that clash with names that the operators use inside.
CLASH = ("shard", "key", "size", "score", "kept", "part", "word", "row", "whole", "seed", "frame", "host", "entry", "blocked", "quality_score", "mix_source", "mix_size", "mix_row", "rep", "node", "base", "words", "anon", "text_id", "place", "h", "rank")


def frame(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select("*", *[F.lit(c).alias(c) for c in CLASH])


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    frame(spark, rows).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
