"""Language-model scoring with a log-frequency Bloom filter.

Training documents are counted in blocks: a task sums the words and word pairs of a block, splits the sums by hash
into segments, and a segment adds up what all blocks sent it. A segment makes its page of the filter: that holds every
counted n-gram once for each level of its quantised count, and has so many bits for each level that it holds; a
count is read by probing level after level until one is absent. Blocks send all their words and pairs, so the probes
are at their page already, and what the page answers goes back to the block. With it go the exact counts of the
block's own words, from which the base score is made. The filter grows with the input; neither it nor a table of all
words is ever gathered.

A word's probability after the word before it is (pair + MU * p) / (before + MU), p its share of all tokens: the weight of
the shares falls as the word before is better known, and is 1 where it is unknown. Quantised counts of pairs and words
are rounded down and those of the word before up, so the probabilities of all words after any word add up to at most 1
(but for the levels that the filter wrongly sees as present).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, staged, table, texts_of

#: Probes for each level of the filter, and bits for each level in a page, at least: an absent level is seen as present
#: with chance (1 - exp(-4 / 24)) ** 4, 0.056 %.
PROBES, LEVEL_BITS = 4, 24
#: Counts that a level stands for: those of three binary digits at most. Level 0 is 0, level 8 is 8, and each doubling has four.
VALUES = np.concatenate([np.arange(4), *(np.arange(4, 8) << e for e in range(48))])
#: Counts that the shares of single words weigh in a probability, and what is added to a word's count.
MU, ADD = 32.0, 0.1
#: Bytes of text in a block, of a piece of it that is cut into words at once, and for each segment.
BLOCK_BYTES, PIECE_BYTES, SEGMENT_BYTES = 8 << 20, 512 << 10, 16 << 20
#: N-grams whose bits are looked at at once.
SLICE = 1 << 17

_U = np.uint64
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits depend on all bits."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


END = mix(np.array([0x0E0D], _U))[0]  # the token after the last word


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of data, which ends with a blank, and where each starts."""
    b = np.frombuffer(data.translate(_LOWER), np.uint8)
    blank = _SPACE[b]
    first = ~blank
    first[1:] &= blank[:-1]
    starts = np.nonzero(first)[0]
    if not len(starts):
        return np.zeros(0, _U), starts
    lengths = np.nonzero(blank & ~np.concatenate([[True], blank[:-1]]))[0] - starts
    letters = np.nonzero(~blank)[0]
    place = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    powers = np.full(int(lengths.max()), _U(0x9E3779B97F4A7C15))
    powers[0] = 1
    powers = np.cumprod(powers, dtype=_U)
    values = (b[letters].astype(_U) + _U(1)) * powers[place]
    return mix(np.add.reduceat(values, np.cumsum(lengths) - lengths) ^ (lengths.astype(_U) << _U(40))), starts


def pieces(texts: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(index of the text, bytes): a long text is cut at blanks."""
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > PIECE_BYTES and (m := _BLANK.search(text, at + PIECE_BYTES)):
            yield i, text[at : m.start()]
            at = m.start()
        yield i, text[at:] if at else text


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the tokens of all texts, each text's words and then END, and the offsets of the texts."""
    hashes, counts = [np.zeros(0, _U)], np.zeros(len(texts), np.int64)
    held: list[tuple[int, bytes]] = []

    def flush() -> None:
        h, starts = word_hashes(b" ".join([x for _, x in held] + [b""]))
        bounds = np.concatenate([[0], np.cumsum([len(x) + 1 for _, x in held])])
        np.add.at(counts, [i for i, _ in held], np.diff(np.searchsorted(starts, bounds)))
        hashes.append(h)
        held.clear()

    size = 0
    for i, x in pieces(texts):
        held.append((i, x))
        size += len(x)
        if size >= PIECE_BYTES:
            flush()
            size = 0
    if held:
        flush()
    offsets = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(offsets[-1], END, _U)
    inside = np.ones(offsets[-1], bool)
    inside[offsets[1:] - 1] = False
    out[inside] = np.concatenate(hashes)
    return out, offsets


def pairs(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of every token with the one before it; before the first stands END."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[offsets[:-1]] = END
    return mix(before * _U(0xD1B54A32D192ED03) + h)


#: Bits of a pair's hash that tell pairs of one segment apart; the others choose the segment. A segment has some millions
#: of pairs at any size of the corpus, so that one in 300,000 pairs is taken for another.
KEY_BITS = 40


def in_segments(h: np.ndarray, n_segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of distinct hashes by segment and the bits that don't choose it, the segments that occur, and where each starts and ends."""
    seg = (h >> _U(KEY_BITS)).astype(np.int64) % n_segments
    order = np.lexsort((h, h & _U((1 << KEY_BITS) - 1), seg))
    found, starts = np.unique(seg[order], return_index=True)
    return order, found, np.append(starts, len(h))


def short_keys(h: np.ndarray) -> bytes:
    """KEY_BITS of each of ascending pairs, some 3.3 bytes each: steps of the highest 16 bits, compressed, and 3 bytes as they are."""
    high = ((h & _U((1 << KEY_BITS) - 1)) >> _U(24)).astype(np.uint16)
    steps = zstandard.ZstdCompressor().compress(np.diff(high, prepend=np.uint16(0)).tobytes())
    return len(steps).to_bytes(4, "little") + steps + h.view(np.uint8).reshape(-1, 8)[:, :3].tobytes()


def long_keys(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    steps = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4 : 4 + n]), np.uint16)
    low = np.frombuffer(data, np.uint8, offset=4 + n).reshape(-1, 3)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :3] = low
    return out.view(_U)[:, 0] | (np.cumsum(steps, dtype=np.uint16).astype(_U) << _U(24))


# ---- the filter -----------------------------------------------------------------------------------------------


def level(counts: np.ndarray) -> np.ndarray:
    """The last level whose value is not above the count."""
    return np.searchsorted(VALUES, counts, "right") - 1


def least(levels: np.ndarray) -> np.ndarray:
    """The smallest count of a level."""
    return VALUES[levels].astype(float)


def most(levels: np.ndarray) -> np.ndarray:
    """The largest count of a level."""
    return np.where(levels > 0, VALUES[np.minimum(levels.astype(np.int64) + 1, len(VALUES) - 1)] - 1.0, 0.0)


def page_bits(counts: np.ndarray) -> int:
    """The least power of two, as an exponent and 10 at least, that has LEVEL_BITS for each level of n-grams with these counts."""
    return max(10, int(LEVEL_BITS * level(counts).sum() - 1).bit_length())


def bit_places(h: np.ndarray, j: int, bits: int) -> Iterator[np.ndarray]:
    """Bits within a page of 2 ** bits of h at level j, one array for each probe."""
    g = mix(h + _U(j * 0x9E3779B97F4A7C15 % 2**64))
    step = (g >> _U(32)) | _U(1)
    for k in range(PROBES):
        yield ((g + _U(k) * step) >> _U(3)) & _U((1 << bits) - 1)


def slices(h: np.ndarray) -> Iterator[np.ndarray]:
    """h in pieces of SLICE, so that what is derived from it bit by bit is never held for all of it."""
    return (h[i : i + SLICE] for i in range(0, len(h), SLICE))


def page_of(h: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """The bits of a page, of 2 ** bits, that n-grams with these counts set, as bytes."""
    page = np.zeros(1 << bits - 3, np.uint8)
    levels = level(counts).astype(np.int16)
    by = np.argsort(-levels, kind="stable")
    h, ends = h[by], np.searchsorted(-levels[by], -np.arange(int(levels.max(initial=0)) + 1), "right")
    for j in range(1, len(ends)):
        for x in slices(h[: ends[j]]):
            for at in bit_places(x, j, bits):
                np.bitwise_or.at(page, (at >> _U(3)).astype(np.int64), np.left_shift(1, (at & _U(7)).astype(np.uint8), dtype=np.uint8))
    return page


def read_levels(h: np.ndarray, page: np.ndarray) -> np.ndarray:
    """The last level that is present by repeated probes, 0 if none is."""
    bits = (len(page) * 8).bit_length() - 1
    found = np.zeros(len(h), np.uint8)
    for h_part, found_part in zip(slices(h), slices(found), strict=True):
        live = np.arange(len(h_part))
        for j in range(1, len(VALUES)):
            x, ok = h_part[live], np.ones(len(live), bool)
            for at in bit_places(x, j, bits):
                ok &= (page[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8) & 1).astype(bool)
            live = live[ok]
            found_part[live] = j
            if not len(live):
                break
    return found


def probabilities(pair: np.ndarray, before: np.ndarray, word: np.ndarray, n_all: int, n_distinct: int) -> np.ndarray:
    """Of words, from the levels of the pair, of the word before and of the word itself."""
    alone = np.minimum((least(word) + ADD) / (n_all + ADD * (n_distinct + 1)), 1)
    known = most(before)
    return np.minimum((np.minimum(least(pair), known) + MU * alone) / (known + MU), 1)


# ---- passes ---------------------------------------------------------------------------------------------------

PARTS = {"seg": pa.int64(), "words": pa.binary(), "word_counts": pa.binary(), "pairs": pa.binary(), "pair_counts": pa.binary()}


def count_block(texts: list[bytes], learn: list[bool], n_segments: int) -> list[dict]:
    """Of one block: its words and its pairs with their counts in training, by segment."""
    h, offsets = tokens(texts)
    learned = np.repeat(np.array(learn, bool), np.diff(offsets))
    out: dict[int, dict] = {}
    for kind in ("word", "pair"):
        keys, _, n = summed(h if kind == "word" else pairs(h, offsets), learned)
        order, segs, at = in_segments(keys, n_segments)
        keys, n = keys[order], n[order].astype(np.uint32)
        for s, a, b in zip(segs.tolist(), at[:-1], at[1:], strict=True):
            row = out.setdefault(s, {"seg": s, "words": b"", "word_counts": b"", "pairs": short_keys(keys[:0]), "pair_counts": b""})
            row |= {f"{kind}s": short_keys(keys[a:b]) if kind == "pair" else keys[a:b].tobytes(), f"{kind}_counts": n[a:b].tobytes()}
    return list(out.values())


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, ascending, which of them each key is, and what the n of each add up to."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=first[1:])
    which = np.empty(len(keys), np.uint32)
    which[order] = np.cumsum(first, dtype=np.uint32) - np.uint32(1)
    return keys[first], which, np.add.reduceat(n[order], np.flatnonzero(first), dtype=np.int64)


def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one segment: totals, and of each block's words and pairs, in the order that they came in, what the page of the
    filter says of them; of words the exact counts too."""
    sums = {}
    for kind in ("word", "pair"):
        n = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf[f"{kind}_counts"]])
        sums[kind] = summed(np.concatenate([long_keys(x) if kind == "pair" else np.frombuffer(x, _U) for x in pdf[f"{kind}s"]]), n)
    total = sums["word"][2]
    probes = {"word": sums["word"][0], "pair": mix(sums["pair"][0] + END)}
    counts = np.concatenate([x[2] for x in sums.values()])
    page = page_of(np.concatenate(list(probes.values())), counts, bits := page_bits(counts))
    out = {"block": pdf["block"], "seg": pdf["seg"]}
    for kind, (_, which, _) in sums.items():
        at = np.cumsum([len(x) // 4 for x in pdf[f"{kind}_counts"]])[:-1]
        out[f"{kind}_levels"] = [x.tobytes() for x in np.split(read_levels(probes[kind], page)[which], at)]
        if kind == "word":
            out["exact"] = [total[x].tobytes() for x in np.split(which, at)]
    first = np.arange(len(pdf)) == 0  # totals of the segment stand in one of its rows
    levels = int(level(counts).sum())
    return pd.DataFrame(out | {"n": np.where(first, total.sum(), 0), "v": np.where(first, (total > 0).sum(), 0), "levels": np.where(first, levels, 0), "bits": np.where(first, 1 << bits, 0)})


ADDED = "block long, seg long, word_levels binary, pair_levels binary, exact binary, n long, v long, levels long, bits long"


def score_block(n_segments: int, n_all: int, n_distinct: int):
    def run(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """Base and model scores of one block's documents, from the exact counts of its words and from what the filter said."""
        texts = texts_of(pdf)
        h, offsets = tokens(texts)
        words, which = np.unique(h, return_inverse=True)
        two, at = np.unique(pairs(h, offsets), return_inverse=True)
        known = known.sort_values("seg")

        def back(keys: np.ndarray, column: str, dtype) -> np.ndarray:
            """What the segments sent of these n-grams, put in the order of keys."""
            out = np.zeros(len(keys), dtype)
            out[in_segments(keys, n_segments)[0]] = np.frombuffer(b"".join(known[column]), dtype)
            return out

        exact = back(words, "exact", np.int64)
        total = lambda x: np.add.reduceat(x, offsets[:-1])
        base = total(np.log10((exact + ADD) / (n_all + ADD * (n_distinct + 1)))[which])
        one = back(words, "word_levels", np.uint8)
        before = np.empty(len(h), np.uint8)
        before[1:] = one[which[:-1]]
        before[offsets[:-1]] = one[np.searchsorted(words, END)]
        model = total(np.log10(probabilities(back(two, "pair_levels", np.uint8)[at], before, one[which], n_all, n_distinct)))
        return pd.DataFrame({
            "doc_id": pdf["doc_id"].iloc[0], "held_out": np.array(pdf["held_out"].iloc[0], bool), "n_tokens": np.diff(offsets), "n_known": total((exact > 0)[which].astype(np.int64)),
            "train_tokens": n_all, "base_score": base, "score": model,
        })

    return run


def false_levels(added: DataFrame) -> DataFrame:
    """One row: levels in the filter, its bits, and the chance that an absent level is seen as present, on average over pages."""
    chance = F.pow(1 - F.exp(-PROBES * F.col("levels") / F.col("bits")), PROBES)
    return added.filter("bits > 0").agg(F.sum("levels").alias("levels"), F.sum("bits").alias("bits"), F.avg(chance).alias("false_chance"))


def counted(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """docs in blocks, what the segments say of each block, and how many segments there are."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_segments = max(1, -(-size // SEGMENT_BYTES))
    part = F.crc32(F.col("doc_id").cast("string")) % 10
    fields = {"doc_id": F.col("doc_id").cast("string"), "learn": F.coalesce(part != 0, F.lit(False)), "held_out": F.coalesce(part == 0, F.lit(False))}
    packed = blocks(docs, fields, "lm-texts", BLOCK_BYTES, lambda _, held: count_block(held["data"], held["learn"], n_segments), PARTS)
    return packed, staged(packed.select("block", F.inline("parts")).groupBy("seg").applyInPandas(add_up, ADDED), "lm", row_group=BLOCK_BYTES), n_segments


def lm_score(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents whose crc32(doc_id as text) mod 10 isn't 0; those with 0 are held out; a null doc_id is
    neither. A null text counts as empty and has one token, the end. base_score is exact. score is the model's log10
    probability of the text's words and its end. Repeated rows are learned from and scored each; an empty table gives an
    empty result; other columns are ignored; a long text is cut into words in pieces, and its tokens are held at once.

    The filter has LEVEL_BITS bits or more for each n-gram level in it, for any corpus: a level that is absent is seen as
    present with chance 0.056 % at most.
    """
    packed, parts, n_segments = counted(docs)
    n_all, n_distinct = parts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    known = parts.select("block", "seg", "word_levels", "pair_levels", "exact")
    out = packed.select("block", "doc_id", "held_out", "sizes", "blob").groupBy("block").cogroup(known.groupBy("block")).applyInPandas(
        score_block(n_segments, n_all, n_distinct), "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))
