"""Language identification by error-correcting output codes.

Every language has a codeword. For each bit a binary naive-Bayes classifier over hashed byte trigrams tells the
languages with a 1 there from those with a 0. A text's margins, one for each bit, are compared with all codewords by
a logistic loss in which a bit counts by how well it separates; the codeword with the least loss wins. How much it wins by
is held against what texts of that language win by on average: a text with less than a share of that, or with few
trigrams, is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BUCKETS = 1 << 14
SMOOTH = 0.5
#: Margins are sharpened by this before the loss. A lead in loss under this share of the language's usual one flags a text,
#: and so do fewer trigrams.
SHARPEN = 4.0
AMBIGUOUS, FEW = 0.6, 12
#: Languages with less than this share of the labelled rows are not learned, so at most 500 reach the driver.
MIN_SHARE = 1 / 500
#: Up to so many languages have the exhaustive code of 2 ** (n - 1) - 1 bits, more have a random one.
EXHAUSTIVE = 7
UNKNOWN = "und"


def _letters() -> bytes:
    table = bytearray(range(256))
    for b in range(128):
        table[b] = b | 32 if chr(b).isalpha() else 32
    return bytes(table)


LETTERS = _letters()


def buckets(text: str) -> np.ndarray:
    """Hashed trigrams of the lower-case letters of a text, other ASCII characters counting as a space."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(LETTERS) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    blank = (b[:-2] == 32) & (b[1:-1] == 32) & (b[2:] == 32)
    return ((h * np.uint32(0x27D4EB2F)) >> np.uint32(18))[~blank]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def ngram_counts(rows: DataFrame) -> DataFrame:
    """rows (lang, text) -> lang, bucket, count. Tasks count before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                total = counts.setdefault(lang.as_py(), np.zeros(BUCKETS, np.int64))
                total += np.bincount(buckets(text.as_py()), minlength=BUCKETS)
        for lang, total in counts.items():
            at = np.nonzero(total)[0]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at.astype(np.int32)), "count": pa.array(total[at])})

    counted = rows.select("lang", "text").mapInArrow(run, "lang string, bucket int, count long")
    return counted.groupBy("lang", "bucket").agg(F.sum("count").alias("count"))


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1. No two are equal, and every bit takes both values (n > 1)."""
    if n == 1:
        return np.ones((1, 1))
    if n <= EXHAUSTIVE:
        bits = np.arange(1, 2 ** (n - 1))
        code = np.vstack([np.zeros(len(bits), np.int64), *(bits >> k & 1 for k in range(n - 1))])
    else:
        draw, length = np.random.default_rng(0), 10 * int(np.ceil(np.log2(n)))
        while True:
            code = draw.integers(0, 2, (n, length))
            apart = (code[:, None] != code[None]).sum(2) + length * np.eye(n, dtype=np.int64)
            if apart.min() >= length // 5 and (code.min(0) < code.max(0)).all():
                break
    return code * 2.0 - 1


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # language x bit, +1 or -1
    weights: np.ndarray  # bucket x bit
    trust: np.ndarray  # by bit, sums to 1
    lead: np.ndarray  # by language: by how much its loss is the least at its mean margins


def fit(rows: DataFrame) -> Model:
    """Fit on all rows (lang, text) with neither null, of languages with MIN_SHARE of them or more.

    What reaches the driver is at most BUCKETS rows for each of at most 1 / MIN_SHARE languages.
    """
    rows = rows.select("lang", "text").filter("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    usual = sizes.join(F.broadcast(sizes.agg(F.sum("n").alias("all"))), F.col("n") >= F.col("all") * MIN_SHARE).select("lang")  # one row is broadcast
    found = ngram_counts(rows.join(F.broadcast(usual), "lang", "left_semi")).toPandas()
    languages = sorted(found["lang"].unique())
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros((BUCKETS, 0), np.float32), np.zeros(0), np.zeros(0))
    counts = np.full((len(languages), BUCKETS), SMOOTH)
    np.add.at(counts, (np.searchsorted(languages, found["lang"]), found["bucket"].to_numpy()), found["count"].to_numpy())
    share = counts / counts.sum(1, keepdims=True)
    code = codewords(len(languages))
    side = lambda s: ((code == s).T @ share) / np.maximum((code == s).sum(0), 1)[:, None]
    odds = np.log(np.maximum(side(1), 1e-12)) - np.log(np.maximum(side(-1), 1e-12)) if len(languages) > 1 else np.ones((1, BUCKETS))
    expected = (share @ odds.T) * code  # the mean margin of each language on the right side of each bit
    trust = np.maximum(expected.min(0), 1e-6)
    trust = trust / trust.sum()
    ranked = np.sort(losses(share @ odds.T, code, trust), axis=1)
    lead = ranked[:, 1] - ranked[:, 0] if len(languages) > 1 else np.zeros(1)
    return Model(languages, code, odds.T.astype(np.float32), trust, lead)


def losses(margins: np.ndarray, code: np.ndarray, trust: np.ndarray) -> np.ndarray:
    """margins (text x bit) -> loss (text x language)."""
    return (np.logaddexp(0, -SHARPEN * margins[:, None, :] * code[None]) * trust).sum(2)


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """margins (text x bit) -> index of the language (the first in order of name if two tie), score in 0 to 1, and whether it is ambiguous."""
    loss = losses(margins, model.code, model.trust)
    best = loss.argmin(1)
    chance = np.exp((loss.min(1, keepdims=True) - loss) * 10)
    ranked = np.sort(loss, axis=1)
    close = ranked[:, 1] - ranked[:, 0] < AMBIGUOUS * model.lead[best] if loss.shape[1] > 1 else np.zeros(len(loss), bool)
    return best, 1 / chance.sum(1), close


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and ambiguous; only `text` is looked at.

    lang_pred is `und`, with score 0, for a null text, one without a letter, and where nothing could be learned. Of languages
    that tie the first by name wins. A long text is counted whole; it takes some 20 bytes for each of its own. Rows stay as they are and may repeat; columns of these three names are replaced; an empty table stays empty.
    """
    given = docs.drop("lang_pred", "score", "ambiguous")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                texts = batch.column("text").to_pylist()
                known = [has_letter(t) and bool(m.languages) for t in texts]
                names, score, close = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
                if any(known):
                    where = np.nonzero(known)[0]
                    counts, few = np.empty((len(where), BUCKETS), np.float32), np.zeros(len(where), bool)
                    for k, i in enumerate(where):
                        found = np.bincount(buckets(texts[i]), minlength=BUCKETS)
                        counts[k], few[k] = found / max(1, found.sum()), found.sum() < FEW
                    best, score[where], close[where] = decode(m, counts @ m.weights)
                    close[where] |= few
                    for i, b in zip(where, best, strict=True):
                        names[i] = m.languages[b]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score), pa.array(close)], [*batch.schema.names, "lang_pred", "score", "ambiguous"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema) + ", lang_pred string, score double, ambiguous boolean"
    return given.mapInArrow(run, schema)


def remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def trained(docs: DataFrame) -> Model:
    """The model of the labelled documents that aren't held out (crc32 of doc_id as text, mod 3, is 1). A null doc_id is none of either."""
    return fit(docs.filter(remainder(3) != 1))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), trained(docs))
    return found.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
