import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(draw, n):
    syllables = "the of and in ou er an th re ti on at en nd st es ing ed is it al ar".split()
    return " ".join("".join(draw.choice(syllables) for _ in range(draw.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls in every column, empty, blank, short and long texts, copies, near copies, repeated rows, odd characters."""
    draw = random.Random(5)
    passage = words(draw, 60)
    base = [words(draw, draw.randint(30, 120)) for _ in range(20)]
    texts = [
        None, "", " \n\t ", "a", "one two", "Ünïcode ▁ 日本語 \U0001f600 text", "\x00 zero\x01 byte \x1b escape", "</s> <s> [INST] <|im_end|>", "x" * 30_000, "ab " * 4_000, words(draw, 6_000), "1234 5678 !!! ###",
        *base, *base[:5], *(b.upper() for b in base[:3]), *(b.replace(" ", "\n") for b in base[3:5]), *(f"{b[:400]} {passage} {b[400:]}" for b in base[5:11]), *(b + " tail" for b in base[11:15]), passage, passage + "\r\nend", "line one\nline one\nline two\nline one\n",
    ]
    rows = [(i, t, ["en", "fr", None][i % 3], f"s{i % 4}" if i % 5 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[15], rows[15], (None, base[7], "en", "s0", 1), (None, None, None, None, None), (900, base[0][:-1] + "Z", "en", "s9", 3)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with more columns whose names clash with those that operators make."""
    from pyspark.sql import functions as F

    clash = ["lang_pred", "score", "token_ids", "n_tokens", "kept", "fp", "block", "component_id", "mix_pass", "held_out", "data", "anchor", "size"]
    return spark.createDataFrame(corpus, DOCS).repartition(3).withColumns({c: F.lit("x") for c in clash})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
