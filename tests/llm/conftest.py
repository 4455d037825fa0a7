import random

import pytest
from pyspark.sql import types as T

WORDS = "alpha beta gamma delta river stone cloud night winter letter house garden window silver paper".split()
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    # names that the operators use themselves
    + [T.StructField(c, T.LongType()) for c in ("score", "lang_pred", "component_id", "size", "spans", "fp", "block", "offset", "rank", "shard", "h", "got", "epoch", "n")]
    + [T.StructField("notes", T.MapType(T.StringType(), T.StringType()))]
)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) * (rng.random() < 0.3) for _ in range(n))


def doc_rows() -> list[tuple]:
    texts = [prose(k, 5 + 7 * k % 90) for k in range(40)]
    texts += [None, "", " \t\n ", "x", "\x0b", "1" * 30_000, " " * 20_000, "word " * 30_000, prose(3, 26) + " tail", "漢字 é ß ﬁ 😀", "<|endoftext|> in text"]
    texts += [texts[3]] * 5  # ties
    rows = [(k, t, ("aa", "bb", None)[k % 3], ("hot", "hot", "web", "é", None)[k % 5], None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[3]] * 3 + [(None, texts[4], "aa", "hot", 1), (None, None, None, None, None), (7_000, texts[5], None, "one", None)]
    return [(*r, *range(14), {"k": "v"}) for r in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(doc_rows(), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
