import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and anend lion river stone cloud winter maple copper signal harbor violet engine lantern meadow orbit pepper quartz".split()


def sentence(draw: random.Random, n: int) -> str:
    return " ".join(draw.choice(WORDS) + (str(draw.randrange(400)) if draw.random() < 0.5 else "") for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Texts with copies, near copies, nulls, empties, ties, long texts and odd characters."""
    draw = random.Random(4)
    texts = ["\n".join(sentence(draw, draw.randrange(1, 40)) for _ in range(draw.randrange(1, 6))) for _ in range(120)]
    texts += texts[:10]
    for i in range(10, 30):
        words = texts[i].split(" ")
        words[draw.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [None, "", "   \n\t ", "one", "One ONE one", "日本語 テキスト 𠀀 naïve", "x" * 5000, sentence(draw, 6000), "###" * 30, "a b c d e f g h i j " * 4]
    langs, sources = ["en", "de", None, "fr"], ["s1", "s2", None, "S3", "é"]
    out = [(i, t, langs[i % 4], sources[i % 5], None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [(7, "same id other text for row seven", "en", "s1", 1), (None, "no id here at all", "en", "s2", 1), out[3], out[3]]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def model():
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


CLASHES = ("id", "kind", "key", "size", "shard", "order", "words", "fp", "n_tokens", "n_words", "kept", "lines", "taken", "target", "label", "part", "_words", "tie", "row", "draw", "doc", "times", "set", "bucket", "first", "held", "_q_key", "_m_key", "_s_key", "_m_times", "_l_kept", "_s_i",
           "page", "data", "ids", "late", "copies", "behind", "_text", "_lang", "_source", "n_lines", "symbol_rate", "n_id", "doc_")


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with more columns, whose names the operators use themselves."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(1).alias(c) for c in CLASHES])
