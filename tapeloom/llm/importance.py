"""Importance resampling towards a target distribution.

A text's features are hashed into buckets. The log ratio of a bucket's share in the target to its share in the corpus is its
gain, a text's weight the sum of its features' gains, and Gumbel noise on top makes the highest scores a draw without
replacement. Gains are one array that every task looks features up in. The k-th best key (score, doc_id, row) is found by
counting its digits, a scan of the stored keys for each digit; only rows up to that key are sorted and ranked.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

#: Fixed values of the contract: buckets, words of a feature at most, words that a drawn text has at least, percent drawn, seed of the noise.
BUCKETS = 10_000
N_WORDS = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: Bits of a digit of the radix selection: at most 2 ** 12 counts come to the driver at once.
DIGIT_BITS = 12
#: Bytes of text whose words are held at once.
PIECE = 1 << 20


def _fold() -> bytes:
    """A-Z to lower case; the ASCII characters that end words to spaces."""
    fold = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        fold[b] = b | 32 if "A" <= c <= "Z" else b if "a" <= c <= "z" or "0" <= c <= "9" else 32
    return bytes(fold)


FOLD = _fold()


def feature_buckets(text: str, buckets: int = BUCKETS, n_words: int = N_WORDS) -> Iterator[np.ndarray]:
    """The buckets of all runs of 1 to n_words words, some for each PIECE of text; the words before a piece's first ones go along."""
    data = text.encode("utf-8", "surrogatepass").translate(FOLD)
    at, last = 0, []
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        words = data[at:end].split()
        found = list(map(zlib.crc32, words))
        held = last + words
        for n in range(2, n_words + 1):
            found += [zlib.crc32(b" ".join(held[i - n + 1 : i + 1])) for i in range(max(n - 1, len(last)), len(held))]
        last = held[len(held) - n_words + 1 :] if n_words > 1 else []
        yield np.array(found, np.int64) % buckets
        at = end


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS, n_words: int = N_WORDS) -> DataFrame:
    """rows (side, text; a null text has no features) -> side, bucket, n. Each task adds up before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for side, text in zip(batch.column("side"), batch.column("text"), strict=True):
                total = counts.setdefault(side.as_py(), np.zeros(buckets, np.int64))
                for found in feature_buckets(text.as_py() or "", buckets, n_words):
                    total += np.bincount(found, minlength=buckets)
        for side, total in counts.items():
            at = np.nonzero(total)[0]
            yield pa.RecordBatch.from_pydict({"side": pa.array([side] * len(at), pa.string()), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})

    return rows.select("side", "text").mapInArrow(run, "side string, bucket int, n long").groupBy("side", "bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS, n_words: int = N_WORDS) -> np.ndarray:
    """A whole number for each bucket, in thousandths of a natural logarithm. Two counts a bucket reach the driver."""
    texts = corpus.select(F.lit("s").alias("side"), "text").unionAll(target.select(F.lit("t").alias("side"), "text"))
    counts = {side: [0] * buckets for side in "st"}
    for r in bucket_counts(texts, buckets, n_words).toLocalIterator():
        counts[r.side][r.bucket] = r.n
    all_s, all_t = sum(counts["s"]), sum(counts["t"])
    ratio = lambda s, t: float(t + 1) * float(all_s + buckets) / (float(s + 1) * float(all_t + buckets))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(counts["s"], counts["t"], strict=True)], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, n_words: int = N_WORDS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_features, weight. A text of any length is read in pieces."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # buckets x 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            sums = np.zeros((batch.num_rows, 2), np.int64)
            for i, text in enumerate(batch.column("text")):
                for found in feature_buckets(text.as_py() or "", len(gain), n_words):
                    sums[i] += len(found), gain[found].sum()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["doc_id", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_features long, weight long")


def noise(seed: int = SEED) -> Column:
    """Gumbel noise of a doc_id in thousandths, from a digest, so that every run draws alike."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


#: A long's sign bit turned over orders as an unsigned number.
SIGN = -(1 << 63)


def digits_of(width: int) -> list[tuple[int, int]]:
    """(shift, bits) of the digits of numbers of `width` bits, highest first."""
    return [(at, min(DIGIT_BITS, width - at)) for at in reversed(range(0, width, DIGIT_BITS))]


def kth_key(rows: DataFrame, keys: list[str], k: int) -> list[int] | None:
    """The k-th smallest of the tuples `keys` (longs without nulls) of rows; None if k is 0 or there are fewer rows.

    A digit at a time, highest first: rows that agree with the digits found so far are counted by their next one, and the
    count that k falls into names it. Partial aggregation leaves at most 2 ** DIGIT_BITS counts a task.
    """
    ends = rows.agg(F.count("*"), *(f(c) for c in keys for f in (F.min, F.max))).first()
    if not 0 < k <= ends[0]:
        return None
    found: list[int] = []
    same = F.lit(True)
    for i, key in enumerate(keys):
        low, high = (v + (1 << 63) for v in ends[2 * i + 1 : 2 * i + 3])
        width = (low ^ high).bit_length()  # bits above are the same in all rows
        at, unsigned = low >> width, F.col(key).bitwiseXOR(F.lit(SIGN))
        for shift, bits in digits_of(width):
            prefix = F.shiftrightunsigned(unsigned, shift + bits) == F.lit(at) if shift + bits < 64 else F.lit(True)
            digit = F.shiftrightunsigned(unsigned, shift).bitwiseAND(F.lit((1 << bits) - 1))
            counts = rows.filter(same & prefix).groupBy(digit.cast("int").alias("digit")).count().collect()
            for d, n in sorted(map(tuple, counts)):
                if k <= n:
                    at = at << bits | d
                    break
                k -= n
        found.append(at - (1 << 63))
        same = same & (F.col(key) == F.lit(found[-1]))
    return found


def up_to(keys: list[str], limit: list[int]) -> Column:
    """Whether a row's tuple `keys` is at most limit."""
    holds = F.lit(True)
    for key, v in reversed(list(zip(keys, limit, strict=True))):
        holds = (F.col(key) < F.lit(v)) | ((F.col(key) == F.lit(v)) & holds)
    return holds


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with `rank`, 1 for the least tuple `keys`. Ranges are sorted apart; a range's offset is the sum of the counts before it."""
    held = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())
    held = staged(held, "ranked")
    part = F.shiftright("place", 33)
    before, offsets = 0, []
    for p, n in sorted(map(tuple, held.groupBy(part).count().collect())):  # one row for each range
        offsets.append((p, before))
        before += n
    known = rows.sparkSession.createDataFrame(offsets, "part long, before long")
    return held.withColumn("part", part).join(F.broadcast(known), "part").withColumn("rank", F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("part", "before", "place")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, n_words: int = N_WORDS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """One row for each of docs (doc_id, text): doc_id, n_features, weight, score, rank (null if it isn't drawn).

    Of the N texts with at least min_words words floor(percent * N / 100) are drawn, those with the highest score; of equal
    scores the smaller doc_id, then null, then any one of the rows. A null or empty text has no features and weight 0.
    Repeated rows are rows of their own, which may be drawn each. Other columns of docs and target are not looked at. An
    empty target gives gains from docs alone; an empty docs an empty result. A text may be of any length.
    """
    if n_words > 1:  # how many words a text has no longer follows from its features
        raise ValueError("min_words is counted by features of one word")
    plain = weighed(docs, bucket_gains(docs, target, buckets, n_words), n_words)
    top = (1 << 63) - 1
    keyed = plain.withColumn("score", F.col("weight") + noise(seed)).withColumns({"low": -F.col("score"), "id_key": F.coalesce("doc_id", F.lit(top)), "row": F.monotonically_increasing_id()})
    keyed = staged(keyed, "scores")
    able = keyed.filter(F.col("n_features") >= min_words)
    keys = ["low", "id_key", "row"]
    limit = kth_key(able, keys, percent * able.count() // 100)
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    if limit is None:
        return keyed.withColumn("rank", F.lit(None).cast("long")).select(names)
    drawn = (F.col("n_features") >= min_words) & up_to(keys, limit)
    return ranked(keyed.filter(drawn), keys).select(names).unionAll(keyed.filter(~drawn).withColumn("rank", F.lit(None).cast("long")).select(names))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 in SQL: the table by its rule, and one step for each byte of all distinct words.
ORACLE = r"""
WITH RECURSIVE steps AS (
  SELECT b AS byte, b AS c, 0 AS i FROM range(256) r(b)
  UNION ALL
  SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i + 1 FROM steps WHERE i < 8),
crc AS (SELECT byte, c FROM steps WHERE i = 8),
words AS (
  SELECT 's' AS side, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 't', item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
walk AS (
  SELECT word, hex(encode(word)) AS h, 0 AS i, 4294967295 AS c FROM (SELECT DISTINCT word FROM words)
  UNION ALL
  SELECT word, h, i + 1, xor(walk.c // 256, crc.c)
  FROM walk JOIN crc ON crc.byte = xor(walk.c % 256, ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) WHERE 2 * i < length(h)),
hashed AS (SELECT word, xor(c, 4294967295) % 10000 AS bucket FROM walk WHERE 2 * i = length(h)),
features AS (SELECT side, id, bucket FROM words JOIN hashed USING (word)),
counts AS (
  SELECT b AS bucket, count(id) FILTER (side = 's') AS s, count(id) FILTER (side = 't') AS t
  FROM range(10000) r(b) LEFT JOIN features ON bucket = b GROUP BY b),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counts),
per_doc AS (SELECT id AS doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM features JOIN gains USING (bucket) WHERE side = 's' GROUP BY id),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN per_doc USING (doc_id)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed
"""
