"""SimHash near-duplicates by anchor points.

Anchors are the words of a covering code over 46 of the 64 bits: the product of two perfect binary Golay codes of
length 23. Each half of a fingerprint lies within distance 3 of exactly one Golay word, so every fingerprint has one
home among 2 ** 24 anchors. A fingerprint visits every anchor that could be the home of another one within THRESHOLD
bits. Two fingerprints within THRESHOLD of each other therefore meet at the home of either, and only there are
compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, table, text_or_empty
from .components import components

THRESHOLD = 2
WORDS = 3
SEED = 42
#: Fixed value: the generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101
LENGTH, RADIUS, CHECKS = 23, 3, 11
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None) -> int:
    """SimHash over the 3-word shingles of a text; 0 for a text without a word."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()  # bytes.split() splits at exactly [\x20\x09-\x0D]
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False)) if len(words) >= WORDS else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for part in np.array_split(h, len(h) // 65536 + 1):  # a bounded number of bits at a time
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns named in keep of docs and `fp`, the fingerprint of `text` as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found)], [*keep, "fp"])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, "text").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", fp long")


def syndrome(x: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words divided by the generator polynomial; 0 for code words."""
    x = x.copy()
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        x ^= np.where(x >> bit & 1, GOLAY << (bit - CHECKS), 0)
    return x


@lru_cache(1)
def differences() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a word may differ in from code words within RADIUS + THRESHOLD, by syndrome: starts, patterns, weights."""
    sets = [c for w in range(RADIUS + THRESHOLD + 1) for c in combinations(range(LENGTH), w)]
    patterns = np.array([sum(1 << i for i in c) for c in sets], np.int64)
    weights = np.array([len(c) for c in sets], np.int64)
    s = syndrome(patterns)
    order = np.lexsort((patterns, weights, s))
    return np.searchsorted(s[order], np.arange(2**CHECKS + 1)), patterns[order], weights[order]


def near_words(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each 23-bit word, its code words within RADIUS + THRESHOLD: index of the word, code word, distance."""
    starts, patterns, weights = differences()
    s = syndrome(x)
    counts = starts[s + 1] - starts[s]
    index = np.repeat(np.arange(len(x)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts[s], counts)
    return index, x[index] ^ patterns[at], weights[at]


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors that each fingerprint visits: index of the fingerprint, anchor, whether it is the home."""
    bits = (1 << LENGTH) - 1
    u = fp.view(np.uint64)
    halves = [near_words((u >> np.uint64(k * LENGTH)).astype(np.int64) & bits) for k in (0, 1)]
    # what a half needs of THRESHOLD is at least its distance less RADIUS; both together may need THRESHOLD
    parts = []
    for spent in range(THRESHOLD + 1):
        (i0, a0, d0), (i1, a1, d1) = halves
        left = np.maximum(d0 - RADIUS, 0) == spent
        right = np.maximum(d1 - RADIUS, 0) <= THRESHOLD - spent
        i0, a0, d0, i1, a1, d1 = i0[left], a0[left], d0[left], i1[right], a1[right], d1[right]
        starts = np.searchsorted(i1, np.arange(len(fp) + 1))
        counts = (starts[1:] - starts[:-1])[i0]
        rep = np.repeat(np.arange(len(i0)), counts)
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts[i0], counts)
        parts.append((i0[rep], a0[rep] | a1[at] << LENGTH, (d0[rep] <= RADIUS) & (d1[at] <= RADIUS)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        all_fp = batch["fp"].to_numpy("int64")
        for fp in np.array_split(all_fp, len(all_fp) // 4096 + 1):
            index, anchor, home = anchors(fp)
            yield pd.DataFrame({"anchor": anchor, "fp": fp[index], "home": home})


def links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> pairs (a, b), a < b as longs, that differ in at most THRESHOLD bits, each once.

    Every fingerprint has at most 2,080 others within two bits, so there are never pairs by the square of a group.
    """
    seen = fps.mapInPandas(visits, "anchor long, fp long, home boolean")
    homes = seen.filter("home").select("anchor", F.col("fp").alias("a"))
    visitors = seen.select("anchor", F.col("fp").alias("b"))
    return homes.join(visitors.hint("merge"), "anchor").filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= THRESHOLD)).select("a", "b")


def simhash_groups(docs: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, fingerprint, component_id, and columns named in extra.

    A null text counts as empty; texts without a word have the fingerprint zero, which links like any other. Equal
    fingerprints are one node however many documents have them. component_root is one fingerprint of the component, the
    same for all its documents. component_id is the smallest doc_id of the component;
    a null doc_id is never the smallest unless a component has no other. An empty table gives an empty result.
    """
    keep = ["doc_id", *(extra or [])]
    rows = staged(fingerprints(docs, keep), "fingerprints")
    classes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    found = components(links(classes.select("fp"))).hint("merge")
    roots = classes.join(found, F.col("fp") == F.col("node")).select("fp", "root", "first_id")
    least = roots.groupBy("root").agg(F.min("first_id").alias("least_id"))
    linked = roots.join(least.hint("merge"), "root").select("fp", "root", "least_id")
    named = staged(classes.join(linked.hint("merge"), "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"), F.coalesce("root", "fp").alias("root")), "named")
    shown = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return rows.join(named.hint("merge"), "fp").select("doc_id", shown("fp").alias("fingerprint"), "component_id", shown("root").alias("component_root"), *keep[1:])


def op6_simhash_dedup(spark, sf_dir):
    return simhash_groups(table(spark, sf_dir, "documents"))
