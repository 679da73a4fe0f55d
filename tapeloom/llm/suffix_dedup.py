"""Removal of byte strings of SPAN bytes that occur more than once, by intervals of a Burrows-Wheeler transform.

What could match is brought together first. Every window of SPAN bytes has an anchor, the GRAM bytes in it with the
least hash, so equal windows have equal anchors at equal places. Windows that follow one another with the same anchor
make a segment. An anchor that occurs once has windows that occur once. Of all others the segments are compared:

* equal segments (by 128 bits of hash, 64 of them BLAKE2) are a class. One copy stands for all and weighs two if there are
  more; every place of the class is a member and gets what is found for it;
* the segments around one anchor go into one transform, byte by byte. Breadth-first backward extension of its intervals
  sets common prefixes in increasing order up to SPAN; what stays unset parts the intervals that share SPAN bytes, and an
  interval that weighs two or more is repeated. Nothing is removed that the transform did not find;
* an anchor with more than GROUP_BYTES of segments around it (the ends of a passage that very many documents embed) gets
  several transforms. Its segments are cut by where the anchor lies in a window, into ranges of so many windows as WIDTHS
  says. All windows of a range have a stretch in common, so those that could be equal agree in that stretch and go into
  one transform. What is still too large is cut again, at last into single windows, where all that agree are one class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, staged, table, texts_of

SPAN, GRAM = 200, 64
#: Bytes of text in a block, of a chunk of it that is hashed at once, and of segments in one transform where anchors have few.
BLOCK_BYTES, CHUNK_BYTES, TRANSFORM_BYTES = 4 << 20, 1 << 19, 1 << 20
#: Bytes of text for each part that sums up hashes; a part has 17 bytes for each of its segments, which are some 60 windows long.
PART_BYTES = 32 << 20
#: Bytes of segments around one anchor in one transform, and how many windows a range has where an anchor has more.
GROUP_BYTES, WIDTHS = 2 << 20, (24, 4, 1)

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U))


class Rolling:
    """Hashes of any substrings of one byte array, from sums of all prefixes."""

    def __init__(self, b: np.ndarray) -> None:
        powers = np.full(len(b) + 1, _U(_ODD))
        powers[0] = 1
        self.sums = np.zeros(len(b) + 1, _U)
        np.cumsum(_BYTE[b] * np.cumprod(powers[:-1], dtype=_U), out=self.sums[1:])
        powers[1:] = _U(_INVERSE)
        self.back = np.cumprod(powers, dtype=_U)

    def hash(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        ends = starts + lengths
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + np.asarray(lengths).astype(_U) * _U(0xC2B2AE3D27D4EB4F))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def stretches(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (index of the text, where it starts in it, bytes) of about CHUNK_BYTES. Every window is in one stretch: texts
    that are longer are cut, and each stretch goes on for SPAN - 1 bytes."""
    out, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - SPAN + 1, 0), CHUNK_BYTES):
            part = text if len(text) < CHUNK_BYTES else text[at : at + CHUNK_BYTES + SPAN - 1]
            if size and size + len(part) > CHUNK_BYTES:
                yield out
                out, size = [], 0
            out.append((i, at, part))
            size += len(part)
    if out:
        yield out


def short_digest(data) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


def segments(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Of all segments: doc (index of the text), start, n (windows), gram_at (of the anchor in it), anchor and whole (hashes)."""
    out: dict[str, list[np.ndarray]] = {k: [np.zeros(0, t)] for k, t in (("doc", np.int64), ("start", np.int64), ("n", np.int64), ("gram_at", np.int64), ("anchor", _U), ("whole", _U))}
    for parts in stretches(texts):
        data = b"".join(x for _, _, x in parts)
        b = np.frombuffer(data, np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(x) for _, _, x in parts])])
        grams = Rolling(b).hash(np.arange(len(b) - GRAM + 1), GRAM)
        low = _U((1 << 28) - 1)  # places in a chunk
        least = sliding_min((grams & ~low) | np.arange(len(grams), dtype=_U), SPAN - GRAM + 1)
        place = (least & low).astype(np.int64)
        part = np.repeat(np.arange(len(parts)), np.diff(bounds))[: len(place)]
        windows = np.nonzero(np.arange(len(place)) + SPAN <= bounds[part + 1])[0]
        p = place[windows]
        first = np.nonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (np.diff(windows) > 1)]))[0]
        start, n = windows[first], np.diff(np.append(first, len(windows)))
        own = part[start]
        view = memoryview(data)
        whole = np.fromiter((short_digest(view[a:z]) for a, z in zip(start.tolist(), (start + n + SPAN - 1).tolist(), strict=True)), _U, len(start))
        docs, offsets = np.array([i for i, _, _ in parts]), np.array([at for _, at, _ in parts])
        for k, x in (("doc", docs[own]), ("start", start - bounds[own] + offsets[own]), ("n", n), ("gram_at", p[first] - start), ("anchor", grams[p[first]]), ("whole", whole)):
            out[k].append(x)
    return {k: np.concatenate(x) for k, x in out.items()}


# ---- classes of equal segments, over all blocks ---------------------------------------------------------------------

#: Bits of what comes back for a class: its anchor occurs twice or more; this block sends the copy; the class has two members or more.
OPEN, LEAD, TWICE = 1, 2, 4


def classes(s: dict[str, np.ndarray], n_parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of a block's segments by part of the anchor, anchor, whole and place; where classes start in that order; the
    part of each class; and whether it has two members or more here."""
    part = (s["anchor"] >> _U(20)).astype(np.int64) % n_parts
    order = np.lexsort((s["whole"], s["anchor"], part))
    a, w = s["anchor"][order], s["whole"][order]
    first = np.nonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (w[1:] != w[:-1])]))[0] if len(a) else np.zeros(0, np.int64)
    return order, first, part[order][first], np.diff(np.append(first, len(a))) > 1


PARTS = {"part": pa.int64(), "anchors": pa.binary(), "wholes": pa.binary(), "twice": pa.binary()}


def hash_block(texts: list[bytes], n_parts: int) -> list[dict]:
    """A block's classes by part: hashes, and whether the block has two or more."""
    s = segments(texts)
    order, first, part, twice = classes(s, n_parts)
    found, at = np.unique(part, return_index=True)
    a, w = s["anchor"][order][first], s["whole"][order][first]
    return [{"part": int(p), "anchors": a[x:y].tobytes(), "wholes": w[x:y].tobytes(), "twice": twice[x:y].tobytes()} for p, x, y in zip(found, at, np.append(at, len(part))[1:], strict=True)]


def summed(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one part: the flags of each block's classes, in the order that they came in."""
    pdf = pdf.sort_values("block")
    a, w = (np.concatenate([np.frombuffer(x, _U) for x in pdf[c]]) for c in ("anchors", "wholes"))
    twice = np.concatenate([np.frombuffer(x, bool) for x in pdf["twice"]])
    order = np.lexsort((w, a))  # stable: blocks of a class stay in order
    new_anchor = np.concatenate([[True], a[order][1:] != a[order][:-1]])
    new = new_anchor | np.concatenate([[True], w[order][1:] != w[order][:-1]])
    times = 1 + twice[order].astype(np.int64)
    flags = np.where(np.add.reduceat(times, np.nonzero(new_anchor)[0])[np.cumsum(new_anchor) - 1] > 1, OPEN, 0).astype(np.uint8)
    flags[np.add.reduceat(times, np.nonzero(new)[0])[np.cumsum(new) - 1] > 1] |= TWICE
    flags[new] |= LEAD
    back = np.empty_like(flags)
    back[order] = flags
    ends = np.cumsum([len(x) // 8 for x in pdf["anchors"]])[:-1]
    return pd.DataFrame({"block": pdf["block"], "part": pdf["part"], "flags": [x.tobytes() for x in np.split(back, ends)]})


#: What a block sends: members (a place and its class) and copies for the transforms (with data). `group` is what may match.
SENT = {"block": "long", "row": "long", "start": "long", "anchor": "long", "whole": "long", "group": "long", "gram_at": "long", "size": "long", "twice": "boolean", "data": "binary"}


def sort_block(n_parts: int):
    def run(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """Of one block: the members whose anchor occurs elsewhere too, and the copies that it has to send."""
        texts, block = texts_of(pdf), int(pdf["block"].iloc[0])
        s = segments(texts)
        order, first, _, _ = classes(s, n_parts)
        flags = np.frombuffer(b"".join(known.sort_values("part")["flags"]), np.uint8)
        head = order[first]  # the first of each class here
        sent = head[(flags & (OPEN | LEAD)) == OPEN | LEAD]
        twice = (flags[(flags & (OPEN | LEAD)) == OPEN | LEAD] & TWICE) > 0
        member = order[np.repeat((flags & OPEN) > 0, np.diff(np.append(first, len(order))))]
        signed = lambda x: x.view(np.int64)
        rows, starts, sizes = s["doc"][sent], s["start"][sent], s["n"][sent] + SPAN - 1
        data = [texts[i][a : a + n] for i, a, n in zip(rows.tolist(), starts.tolist(), sizes.tolist(), strict=True)]
        anchor = signed(s["anchor"][sent])
        copies = pd.DataFrame({"block": block, "row": rows, "start": starts, "anchor": anchor, "whole": signed(s["whole"][sent]), "group": anchor, "gram_at": s["gram_at"][sent], "size": sizes, "twice": twice, "data": data})
        members = pd.DataFrame({"block": block, "row": s["doc"][member], "start": s["start"][member], "anchor": signed(s["anchor"][member]), "whole": signed(s["whole"][member]), "group": 0, "gram_at": 0, "size": 0, "twice": False, "data": None})
        return pd.concat([members, copies]) if len(copies) else members

    return run


# ---- the transform ----------------------------------------------------------------------------------------------


def suffix_order(b: np.ndarray, depth: int) -> np.ndarray:
    """Places in b ordered by their suffixes' first `depth` bytes at least, by prefix doubling from 8 bytes."""
    n = len(b)
    wide = np.concatenate([b, np.zeros(8, np.uint8)]).astype(_U)
    key = np.zeros(n, _U)
    for k in range(8):
        key = (key << _U(8)) | wide[k : k + n]
    order = np.argsort(key)
    sorted_key = key[order]
    slots, members, h = np.arange(n), order, 8
    rank = np.zeros(n + depth * 2, np.int64)  # past the end: 0, before all others
    while True:
        new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        starts = np.nonzero(new)[0]
        group = np.cumsum(new) - 1
        rank[members] = slots[starts][group] + 1
        if h >= depth:
            return order
        sizes = np.diff(np.append(starts, len(members)))
        open_ = sizes[group] > 1
        slots, members = slots[open_], members[open_]
        if not len(members):
            return order
        sorted_key = (rank[members].astype(_U) << _U(32)) | rank[members + h].astype(_U)
        by = np.argsort(sorted_key)
        sorted_key, members = sorted_key[by], members[by]
        order[slots] = members
        h *= 2


def repeats(b: np.ndarray, span: int, weight: np.ndarray) -> np.ndarray:
    """Whether the `span` bytes from each place of b occur at places that weigh two or more together. Byte 0 separates; it never matches.

    Breadth-first over intervals of the transform that share a prefix of length l, for l from 0 to span - 1: each is
    extended backwards by every character before it. The border after a new interval, where no shorter prefix has
    set it, gets the common prefix l, and only then the interval goes on. Borders that are left have span or more; they
    join the suffixes of one interval of prefixes of length span, whose weights are added up.
    """
    n = len(b)
    order = suffix_order(b, span)
    before = b[order - 1]  # of place 0: the last byte, a separator
    back = np.empty(n, np.int64)
    back[np.argsort(before, kind="stable")] = np.arange(n)
    new_run = np.concatenate([[True], before[1:] != before[:-1]])
    run = np.cumsum(new_run) - 1
    run_start = np.nonzero(new_run)[0]
    run_end = np.append(run_start[1:], n) - 1
    set_ = np.zeros(n + 1, bool)
    set_[[0, n]] = True
    low, high = np.array([0]), np.array([n - 1])
    for length in range(span):
        k = run[high] - run[low] + 1
        parent = np.repeat(np.arange(len(low)), k)
        at = np.arange(len(parent)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(run[low], k)
        c = before[run_start[at]]
        new_low, new_high = back[np.maximum(run_start[at], low[parent])], back[np.minimum(run_end[at], high[parent])]
        if length:
            keep = c != 0
            parent, c, new_low, new_high = parent[keep], c[keep], new_low[keep], new_high[keep]
        if len(parent) > 1:  # runs of one character within one interval are one new interval
            key = parent * 256 + c
            by = np.argsort(key, kind="stable")
            first = np.nonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))[0]
            new_low = np.minimum.reduceat(new_low[by], first)
            new_high = np.maximum.reduceat(new_high[by], first)
        fresh = ~set_[new_high + 1]
        low, high = new_low[fresh], new_high[fresh]
        set_[high + 1] = True
        if not len(low):
            break
    interval = np.cumsum(set_[:n]) - 1
    heavy = np.bincount(interval, weight[order]) >= 2
    out = np.empty(n, bool)
    out[order] = heavy[interval]
    return out


# ---- transforms of groups -------------------------------------------------------------------------------------------

FOUND = "anchor long, whole long, starts array<long>, ends array<long>"


def runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals of bytes that windows of SPAN at ascending places cover."""
    new = np.concatenate([[True], places[1:] > places[:-1] + SPAN])
    last = np.append(np.nonzero(new)[0][1:] - 1, len(places) - 1)
    return places[new], places[last] + SPAN


def compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies of some groups -> what is repeated in each class. Copies of one group go into one transform."""
    pdf = pdf.sort_values("group", kind="stable").reset_index(drop=True)
    sizes = pdf["data"].map(len).to_numpy() + 1
    groups = np.append(np.nonzero(np.concatenate([[True], np.diff(pdf["group"].to_numpy()) != 0]))[0], len(pdf))
    parts, at, total = [], 0, np.concatenate([[0], np.cumsum(sizes)])
    for end, following in zip(groups[1:], np.append(groups[2:], len(pdf) + 1), strict=True):
        if following > len(pdf) or total[following] - total[at] > TRANSFORM_BYTES:
            parts.append((at, end))
            at = end
    anchor, whole, data = (pdf[c].tolist() for c in ("anchor", "whole", "data"))
    weight = 1 + pdf["twice"].to_numpy(np.int64)
    rows = []
    for lo, hi in parts:
        b = np.frombuffer(b"\0".join([b"", *data[lo:hi], b""]), np.uint8)
        # a byte 0 in a text is a character of its own: bytes shift up by one, and 255, which UTF-8 never has, is free
        inner = np.ones(len(b), bool)
        bounds = 1 + total[lo : hi + 1] - total[lo]
        inner[0] = inner[-1] = False
        inner[bounds[1:] - 1] = False
        found = repeats(np.where(inner, b + 1, 0).astype(np.uint8), SPAN, np.append(1, np.repeat(weight[lo:hi], sizes[lo:hi])))
        for j, a, n in zip(range(lo, hi), bounds[:-1].tolist(), sizes[lo:hi].tolist(), strict=True):
            if len(places := np.nonzero(found[a : a + n - SPAN])[0]):
                rows.append((anchor[j], whole[j], *runs(places)))
    return pd.DataFrame(rows, columns=["anchor", "whole", "starts", "ends"])


PIECES = "anchor long, whole long, twice boolean, lo long, group long, piece long, gram_at long, data binary"


def pieces(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Copies cut into ranges of `width` windows by where the anchor lies in them; a group is a range and what all its windows share."""
        for batch in batches:
            rows = []
            for anchor, whole, twice, gram_at, data in zip(batch["anchor"], batch["whole"], batch["twice"], batch["gram_at"], batch["data"], strict=True):
                at = 0
                while at + SPAN <= len(data):
                    r = (gram_at - at) // width
                    low, high = r * width, min(r * width + width - 1, SPAN - GRAM)
                    end = min(gram_at - low + SPAN, len(data))  # after the last window of the range
                    piece = data[at:end]
                    group = hashlib.blake2b(data[gram_at - low : gram_at + SPAN - high], digest_size=8, salt=r.to_bytes(8, "little"), person=(anchor % 2**64).to_bytes(8, "little")).digest()
                    rows.append((anchor, whole, twice, at, int.from_bytes(group, "little", signed=True), int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little", signed=True), gram_at - at, piece))
                    at = end - SPAN + 1
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PIECES.split(", ")])

    return run


def decided(copies: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """copies (anchor, whole, group, gram_at, size, twice, data; one of each class) -> FOUND, for classes with a repeat."""
    sizes = staged(copies.groupBy("group").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > GROUP_BYTES), "groups") if widths else None
    crowded = sizes is not None and not sizes.isEmpty()
    usual = copies.join(sizes.select("group"), "group", "left_anti") if crowded else copies
    n_tasks = max(1, -(-(copies.agg(F.sum("size")).first()[0] or 0) // (TRANSFORM_BYTES * 2)))
    found = usual.select("anchor", "whole", "group", "twice", "data").groupBy(F.pmod(F.xxhash64("group"), F.lit(n_tasks))).applyInPandas(compare, FOUND)
    if not crowded:
        return found
    cut = staged(copies.join(sizes.select("group"), "group", "left_semi").select("anchor", "whole", "twice", "gram_at", "data").mapInPandas(pieces(widths[0]), PIECES), "pieces")
    of_class = cut.groupBy("group", "piece").agg(F.min(F.struct("anchor", "whole", "lo", "gram_at", "data")).alias("c"), (F.max("twice") | (F.count("*") > 1)).alias("twice"))
    sent = of_class.select(F.col("group").alias("anchor"), F.col("piece").alias("whole"), "group", "c.gram_at", F.length("c.data").cast("long").alias("size"), "twice", "c.data")
    alone = cut.groupBy("group").agg(F.count("*").alias("n"), F.max("twice").alias("twice")).filter("n = 1 and not twice").select("group")
    inner = decided(staged(sent.join(alone, "group", "left_anti"), "copies"), widths[1:]).withColumnsRenamed({"anchor": "group", "whole": "piece"})
    moved = lambda c: F.transform(c, lambda x: x + F.col("lo")).alias(c)
    return found.unionAll(cut.select("anchor", "whole", "lo", "group", "piece").join(inner, ["group", "piece"]).select("anchor", "whole", moved("starts"), moved("ends")))


# ---- spans ------------------------------------------------------------------------------------------------------


def finish(pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """The documents of one block without the spans that were found."""
    texts = texts_of(pdf)
    cut: list[list[tuple[int, int]]] = [[] for _ in texts]
    for row, start, starts, ends in zip(found["row"].tolist(), found["start"].tolist(), found["starts"], found["ends"], strict=True):
        cut[row] += [(start + a, start + z) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
    rows = []
    for doc_id, data, spans in zip(pdf["doc_id"].iloc[0], texts, cut, strict=True):
        kept, at, removed, n = hashlib.sha256(), 0, 0, 0
        view, reach = memoryview(data), -1
        for a, z in sorted(spans):
            if a > reach:  # a new run of bytes; one that touches the last goes on with it
                n += 1
            if a > at:
                kept.update(view[at:a])
            if z > at:
                removed += z - max(a, at)
                at = z
            reach = max(reach, z)
        kept.update(view[at:])
        rows.append((doc_id, len(data), removed, n, kept.hexdigest()))
    return pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Each byte is removed that a string of SPAN bytes covers which starts at another place too, in the same or another
    document; all its copies go. A null text counts as empty; a text of less than SPAN bytes keeps all; repeated rows
    are copies of one another; an empty table gives an empty result; other columns are ignored. A text of any length is
    hashed in stretches; a task holds it whole once, beside a block of others.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(1, -(-size // PART_BYTES))
    packed = blocks(docs, {"doc_id": F.col("doc_id").cast("string")}, "texts", BLOCK_BYTES, lambda _, held: hash_block(held["data"], n_parts), PARTS)
    known = packed.select("block", F.inline("parts")).groupBy("part").applyInPandas(summed, "block long, part long, flags binary")
    sent = packed.select("block", "sizes", "blob").groupBy("block").cogroup(known.groupBy("block")).applyInPandas(sort_block(n_parts), ", ".join(f"`{k}` {t}" for k, t in SENT.items()))
    sent = staged(sent, "sent")
    found = decided(sent.filter("data is not null").select("anchor", "whole", "group", "gram_at", "size", "twice", "data"))
    places = sent.filter("data is null").select("block", "row", "start", "anchor", "whole").join(found, ["anchor", "whole"]).select("block", "row", "start", "starts", "ends")
    out = packed.select("block", "doc_id", "sizes", "blob").groupBy("block").cogroup(places.groupBy("block")).applyInPandas(finish, "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))
