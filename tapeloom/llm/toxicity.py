"""Toxicity by compression distance.

Zstandard dictionaries are trained on toxic and on ordinary text, a pair for each of two folds of the labelled texts. A window
of text is compressed with both of a pair, before the end of the dictionary, so that only what the window adds counts. A window
that its ordinary length makes a surprise and that the toxic dictionary holds is evidence: lengths (ordinary, toxic) at which
windows are LIFT times likelier in toxic texts are calibrated on the fold that the pair has not seen. A text's score is the
chance of label 1 by all its windows, the mean of both pairs.

A window is a lower-cased word between spaces; equal windows of a text count once, so that repeated lines add nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

#: Labelled rows of each class that are learned from, those with the smallest digests of doc_id: the bounded sample.
SAMPLE_ROWS = 6_000
#: Bytes of a dictionary, windows that one is trained on at most, and how often a frequent one is repeated among them.
DICT_BYTES, DICT_WINDOWS, REPEAT = 16_384, 60_000, 8
#: Runs of bytes whose document counts tell toxic windows from ordinary ones: lengths, buckets, least lift, least G statistic.
GRAMS, GRAM_BUCKETS, GRAM_LIFT, GRAM_G = (5, 6, 7), 1 << 22, 4.0, 12.0
#: Bytes of a window, of the dictionary's end before it, and of text whose words are held at once.
WINDOW, ANCHOR, PIECE = 48, 32, 1 << 20
#: Lengths above this count as this. A cell is toxic if windows in it are LIFT times likelier in toxic texts, with 3 more ordinary ones added.
LENGTHS, LIFT = 32, 3.0
#: From this score a text is predicted as toxic (fixed value of the contract).
CUT = 0.3
#: Windows that a task remembers.
REMEMBERED = 1 << 19


def _letters() -> bytes:
    fold = bytearray(range(256))
    for b in range(128):
        fold[b] = b if chr(b).isalpha() else 32
    return bytes(fold)


LETTERS = _letters()


def windows(text: str | None) -> set[bytes]:
    """The distinct windows of a text: its words, longer ones in overlapping stretches."""
    data = (text or "").lower().encode("utf-8", "replace").translate(LETTERS)
    found: set[bytes] = set()
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        for w in data[at:end].split():
            if len(w) <= WINDOW:
                found.add(b" " + w + b" ")
            else:
                found.update(b" " + w[i : i + WINDOW] + b" " for i in range(0, len(w) - WINDOW // 2, WINDOW // 2))
        at = end
    return found


def grams(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed runs of bytes of some windows, and the window of each; no run goes over a window's end."""
    b = np.frombuffer(b"".join(found), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    owner = np.repeat(np.arange(len(found)), sizes)
    left = np.cumsum(sizes)[owner] - np.arange(len(b)) if len(b) else owner
    buckets, owners = [], []
    for n in GRAMS:
        if len(b) < n:
            continue
        h = np.zeros(len(b) - n + 1, np.uint64)
        for i in range(n):
            h = h * np.uint64(1_099_511_628_211) + b[i : len(b) - n + 1 + i] + np.uint64(n)
        inside = left[: len(h)] >= n
        buckets.append(((h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42))[inside].astype(np.int64))
        owners.append(owner[: len(h)][inside])
    return (np.concatenate(buckets), np.concatenate(owners)) if buckets else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def remainder(n: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[DataFrame, tuple[int, int]]:
    """toxic, fold (0 or 1) and text of the labelled rows to learn from, at most `rows` of each class; and how many of each class there are.

    Equal texts of a class are learned once. A doc_id with several labels is toxic if one of them is.
    """
    marked = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    own = marked.filter(remainder(4) != 2)
    sizes = dict(map(tuple, own.groupBy("toxic").count().collect()))
    least = [own.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    chosen = F.broadcast(least[0].unionAll(least[1]))  # at most 2 * rows ids
    text = docs.select("doc_id", "text").filter("text is not null").join(chosen, "doc_id").select("toxic", "text").withColumn("fold", (F.abs(F.xxhash64("text")) % 2).cast("int"))
    return staged(text.dropDuplicates(["toxic", "text"]), "toxicity-sample"), (sizes.get(0, 0), sizes.get(1, 0))


def telling_grams(rows: DataFrame) -> np.ndarray:
    """By bucket, a bit for each fold in which a gram is found in more toxic texts than chance allows. Only such buckets reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((4, GRAM_BUCKETS), np.int32)
        for batch in batches:
            for y, fold, text in zip(*(batch.column(c).to_pylist() for c in ("toxic", "fold", "text")), strict=True):
                counts[2 * y + fold, np.unique(grams(list(windows(text)))[0])] += 1
        for side in range(4):
            at = np.nonzero(counts[side])[0]
            for a in range(0, len(at), 1 << 16):
                part = at[a : a + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"side": pa.array(np.full(len(part), side, np.int32)), "bucket": pa.array(part.astype(np.int32)), "n": pa.array(counts[side, part].astype(np.int64))})

    side = lambda k: F.coalesce(F.sum(F.when(F.col("side") == k, F.col("n"))), F.lit(0)).alias(f"n{k}")
    totals = {(r.toxic, r.fold): r["count"] for r in rows.groupBy("toxic", "fold").count().collect()}
    counts = rows.mapInArrow(run, "side int, bucket int, n long").groupBy("bucket").agg(*map(side, range(4)))
    marks = F.lit(0)
    for fold in (0, 1):
        t, o = F.col(f"n{2 + fold}").cast("double"), F.col(f"n{fold}").cast("double")
        all_t, all_o = (float(max(1, totals.get((y, fold), 0))) for y in (1, 0))
        share = (t + o) / (all_t + all_o)
        log = lambda k, n: F.when(k > 0, k * F.log(k / (n * share))).otherwise(0.0) + F.when(n - k > 0, (n - k) * F.log((n - k) / (n * (1 - share)))).otherwise(0.0)  # noqa: B023, E731
        telling = (t >= 3) & (t / all_t >= GRAM_LIFT * (o + 0.5) / all_o) & (2 * (log(t, F.lit(all_t)) + log(o, F.lit(all_o))) > GRAM_G)
        marks = marks.bitwiseOR(F.when(telling, 1 << fold).otherwise(0))
    marks_of = np.zeros(GRAM_BUCKETS, np.uint8)
    for r in counts.select("bucket", marks.alias("marks")).filter("marks > 0").toLocalIterator():
        marks_of[r.bucket] = r.marks
    return marks_of


def dictionary_windows(rows: DataFrame, marks_of: np.ndarray) -> DataFrame:
    """fold, toxic, window, n: windows with a telling gram of toxic texts, those without one of ordinary texts, by number of texts."""
    shared = rows.sparkSession.sparkContext.broadcast(marks_of)  # GRAM_BUCKETS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, bytes]] = []
            for y, fold, text in zip(*(batch.column(c).to_pylist() for c in ("toxic", "fold", "text")), strict=True):
                found = list(windows(text))
                bucket, owner = grams(found)
                telling = np.zeros(len(found), bool)
                telling[owner[shared.value[bucket] >> fold & 1 > 0]] = True
                out += [(fold, y, found[i]) for i in np.nonzero(telling == bool(y))[0]]
                if len(out) > 1 << 17:
                    yield batched(out)
                    out = []
            yield batched(out)

    def batched(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        fold, toxic, window = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(fold, pa.int32()), pa.array(toxic, pa.int32()), pa.array(window, pa.binary())], ["fold", "toxic", "window"])

    return rows.mapInArrow(run, "fold int, toxic int, window binary").groupBy("fold", "toxic", "window").agg(F.count("*").alias("n"))


def trained_dictionary(found: list[tuple[bytes, int]]) -> bytes:
    """A zstandard dictionary of windows, the frequent ones up to REPEAT times. Fewer than a trainer takes are the dictionary as they are."""
    text = [w for w, n in found for _ in range(min(n, REPEAT))]
    order = np.random.default_rng(0).permutation(len(text))
    text = [text[i] for i in order]
    parts = [b"".join(text[i : i + 8]) for i in range(0, len(text), 8)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, parts, k=32, d=6).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(w for w, _ in reversed(found)) or b" ")[-DICT_BYTES:].rjust(8)


class Pair:
    """What windows cost by an ordinary and a toxic dictionary, in bytes beyond the dictionaries' own ends.

    Dictionaries are read as plain content and literals stay plain, so that lengths mean the same for every dictionary. The end
    comes after the window, as the compressor looks for no match in the last 8 bytes.
    """

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.sides = []
        for data in (ordinary, toxic):
            known = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(19, strategy=zstandard.STRATEGY_BTLAZY2, min_match=3, source_size=128, dict_size=len(data), write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            known.precompute_compress(compression_params=how)
            compressor, end = zstandard.ZstdCompressor(dict_data=known, compression_params=how), data[-ANCHOR:]
            self.sides.append((compressor.compress, end, len(compressor.compress(end))))

    def cost(self, side: int, window: bytes) -> int:
        compress, end, own = self.sides[side]
        return min(max(len(compress(window + end)) - own, 0), LENGTHS - 1)

    def cell(self, window: bytes) -> int:
        """LENGTHS * ordinary + toxic length."""
        return self.cost(0, window) * LENGTHS + self.cost(1, window)


@dataclass(frozen=True)
class Model:
    dictionaries: dict[tuple[int, int], bytes]  # by fold and label
    evidence: np.ndarray  # fold x cell, natural logarithms
    prior: float


def calibrated(rows: DataFrame, dictionaries: dict[tuple[int, int], bytes]) -> np.ndarray:
    """Evidence by fold and cell: the dictionaries of a fold judge the texts of the other one."""
    shared = rows.sparkSession.sparkContext.broadcast(dictionaries)
    cells = LENGTHS * LENGTHS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [Pair(shared.value[m, 0], shared.value[m, 1]) for m in (0, 1)]
        counts, known = np.zeros((4, cells), np.int64), {}
        for batch in batches:
            for y, fold, text in zip(*(batch.column(c).to_pylist() for c in ("toxic", "fold", "text")), strict=True):
                for w in windows(text):
                    if (fold, w) not in known:
                        known[fold, w] = pairs[1 - fold].cell(w)
                    counts[2 * (1 - fold) + y, known[fold, w]] += 1
                if len(known) > REMEMBERED:
                    known.clear()
        side, at = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"side": pa.array(side.astype(np.int32)), "cell": pa.array(at.astype(np.int32)), "n": pa.array(counts[side, at])})

    h = np.zeros((2, 2, cells))
    for r in rows.mapInArrow(run, "side int, cell int, n long").groupBy("side", "cell").agg(F.sum("n").alias("n")).collect():  # four rows a cell
        h[r.side >> 1, r.side & 1, r.cell] = r.n
    return np.stack([evidence(ordinary, toxic) for ordinary, toxic in h])


def evidence(ordinary: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """By cell, the logarithm of how much likelier it is in toxic texts; one value for all cells that aren't surely toxic."""
    ratio = max(toxic.sum(), 1) / max(ordinary.sum(), 1)
    sure = (toxic > 0) & ((toxic + 0.1) / (ordinary + 3) >= LIFT * ratio)
    rest = math.log(max(toxic[~sure].sum(), 1) / max(toxic.sum(), 1)) - math.log(max(ordinary[~sure].sum(), 1) / max(ordinary.sum(), 1))
    return np.where(sure, np.log((toxic + 0.5 * ratio) / (ordinary + 0.5) / ratio), min(rest, 0.0))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """Learn from the labelled documents whose crc32(doc_id) mod 4 is not 2; None if there are none of one class."""
    found, (ordinary, toxic) = sample(docs, labels, rows)
    if not ordinary or not toxic:
        return None
    chosen = staged(dictionary_windows(found, telling_grams(found)), "toxicity-windows")
    dictionaries = {}
    for fold in (0, 1):
        for y in (0, 1):
            best = chosen.filter((F.col("fold") == fold) & (F.col("toxic") == y)).orderBy(F.desc("n"), "window").limit(DICT_WINDOWS)
            dictionaries[fold, y] = trained_dictionary([(bytes(r.window), r.n) for r in best.collect()])
    return Model(dictionaries, calibrated(found, dictionaries), math.log(toxic / ordinary))


class Judge:
    """A text's evidence: the sum over its windows of the mean of both pairs. Remembers windows.

    The ordinary length is asked for only where the toxic one leaves it open whether the window counts.
    """

    def __init__(self, model: Model):
        self.pairs = [Pair(model.dictionaries[f, 0], model.dictionaries[f, 1]) for f in (0, 1)]
        self.evidence = model.evidence.reshape(2, LENGTHS, LENGTHS)
        self.fixed = [[e[0, b] if (e[:, b] == e[0, b]).all() else None for b in range(LENGTHS)] for e in self.evidence]
        self.known: dict[bytes, float] = {}

    def window(self, w: bytes) -> float:
        total = 0.0
        for pair, table, fixed in zip(self.pairs, self.evidence, self.fixed, strict=True):
            b = pair.cost(1, w)
            total += table[pair.cost(0, w), b] if fixed[b] is None else fixed[b]
        return float(total) / len(self.pairs)

    def text(self, text: str | None) -> float:
        found, known = windows(text), self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in found.difference(known):
            known[w] = self.window(w)
        return math.fsum(map(known.__getitem__, found))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= CUT); only `text` is looked at.

    A null or empty text, or one without a letter, has the share of toxic labels as its score; without a model all have 0. Rows stay
    and may repeat; columns of these two names are replaced; an empty table stays empty. A text of any length is read in pieces.
    """
    given = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        judge = Judge(m) if m else None
        for batch in batches:
            chance = np.zeros(batch.num_rows)
            if m:
                odds = np.array([m.prior + judge.text(t.as_py()) for t in batch.column("text")])
                chance = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chance), pa.array((chance >= CUT).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return given.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema) + ", score double, predicted int")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", "predicted")
