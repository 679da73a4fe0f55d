"""SentencePiece encoding and decoding: batched Viterbi in numpy.

Words of equal length advance together. Hashes of all their substrings of one length are probed in the sorted hashes
of the pieces at once; the best score of every prefix is a maximum over the piece that ends there, and backpointers
are kept for the way back. A word is a run of spaces and what follows it, since no piece goes on after a space.

A long word, such as a line of Japanese, is cut into stretches of equal length that advance together, too. Where a stretch
starts, the best scores of the last few prefixes are all that matters of what lies before; each of those places is tried as
the only start, which gives a matrix of scores from the places before a stretch to those at its end. The matrices one
after another give the true scores at every border, and with them all stretches advance once more, now for the backpointers.

The model file lends its pieces and their scores; the segmentation with the greatest sum of log probabilities is
taken (what SentencePiece calls unigram encoding), the longest last piece winning ties. A BPE model's scores are
negative merge ranks, whose sum says nothing about likelihood; they become Zipf's log probabilities of those ranks.
Its ids are those of the model, but where merges of BPE would cut otherwise, the segmentation is Viterbi's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed values of the format: the mark that stands for a space, and what an unknown character costs beyond the worst piece.
SPACE_MARK, UNKNOWN_PENALTY = "▁", 10.0
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = pow(int(BASE), -1, 1 << 64)
#: Code points of a matrix of words, and words that a task remembers.
CELLS, REMEMBERED = 1 << 16, 1 << 17
#: Words of more code points go in stretches of so many; a part of such a word that is looked at together, a multiple of that.
STRETCH, PART = 1 << 9, 1 << 17
_WORD = re.compile(f" *[^ \n{SPACE_MARK}]+| +|\n|{SPACE_MARK}")


@dataclass(frozen=True)
class Pieces:
    """Normal pieces sorted by hash, byte pieces, and the bytes that every id stands for."""

    keys: np.ndarray
    first: np.ndarray  # whether a key has these highest 20 bits
    ids: np.ndarray
    lengths: np.ndarray
    scores: np.ndarray
    longest: int
    unknown_score: float
    byte_ids: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def substring_hashes(codes: np.ndarray, n: int, sums: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Polynomial hashes modulo 2 ** 64 of all substrings of n code points of each row, from prefix_sums()."""
    return (sums[:, n:] - sums[:, :-n]) * up[n - 1 : codes.shape[1]]


def prefix_sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of (code point + 1) / BASE ** place, and powers of BASE; BASE is odd, so it can be divided by."""
    length = codes.shape[1]
    out = np.zeros((len(codes), length + 1), np.uint64)
    np.cumsum((codes + np.uint64(1)) * powers(INVERSE, length), axis=1, out=out[:, 1:])
    return out, powers(int(BASE), length)


def code_points(words: list[str]) -> np.ndarray:
    """Words of equal length as a matrix; a space becomes SPACE_MARK."""
    return np.frombuffer("".join(words).replace(" ", SPACE_MARK).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def log_probabilities(scores: np.ndarray) -> np.ndarray:
    """Scores of a unigram model as they are; whole numbers are merge ranks r, as 1 / (r + 1) over their sum, to 10 binary places so that sums are exact."""
    ranks = -scores
    if (ranks < 0).any() or (ranks != np.round(ranks)).any():
        return scores
    return np.round((-np.log(ranks + 1) - np.log((1 / (ranks + 1)).sum())) * 1024) / 1024


def load(path: str = MODEL) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    byte_ids = np.full(256, -1, np.int32)
    normal, data = [], []
    for i in range(n):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            b = int(piece[3:5], 16)
            byte_ids[b] = i
            data.append(bytes([b]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            data.append(b"")
        else:
            normal.append((piece, i))
            data.append(piece.replace(SPACE_MARK, " ").encode())
    if any(p.lstrip(SPACE_MARK).find(SPACE_MARK) >= 0 for p, _ in normal):
        raise ValueError("the model has pieces that go on after a space, so words can't be cut at spaces")
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces, so not every text can be decoded")
    hashes = np.array([substring_hashes(c := code_points([p]), len(p), *prefix_sums(c))[0, 0] for p, _ in normal], np.uint64)
    order = np.argsort(hashes)
    if (np.diff(hashes[order]) == 0).any():
        raise ValueError("two pieces have the same hash")
    ids = np.array([i for _, i in normal], np.int32)[order]
    scores = log_probabilities(np.array([sp.get_score(int(i)) for i in ids]))
    first = np.zeros(1 << 20, bool)
    first[hashes >> np.uint64(44)] = True
    return Pieces(
        hashes[order], first, ids, np.array([len(p) for p, _ in normal])[order], scores, max(len(p) for p, _ in normal), float(scores.min()) - UNKNOWN_PENALTY,
        byte_ids, np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]),
    )


def probe(codes: np.ndarray, pieces: Pieces) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, ... the scores and ids of the pieces that the n code points from each place are; -inf and -1 if none.

    A single code point that isn't a piece has the score of an unknown one.
    """
    sums, up = prefix_sums(codes)
    found = []
    for n in range(1, min(pieces.longest, codes.shape[1]) + 1):
        h = substring_hashes(codes, n, sums, up)
        scores, ids = np.full(h.shape, pieces.unknown_score if n == 1 else -np.inf), np.full(h.shape, -1, np.int32)
        maybe = np.nonzero(pieces.first[h >> np.uint64(44)])
        at = np.minimum(np.searchsorted(pieces.keys, h[maybe]), len(pieces.keys) - 1)
        hit = (pieces.keys[at] == h[maybe]) & (pieces.lengths[at] == n)
        where = tuple(x[hit] for x in maybe)
        scores[where], ids[where] = pieces.scores[at[hit]], pieces.ids[at[hit]]
        found.append((scores, ids))
    return found


def viterbi(codes: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Best last piece of every prefix: its length, and its id or -1 for an unknown character."""
    m, length = codes.shape
    found = [(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)) for x, y in probe(codes, pieces)]
    best = np.full((length + 1, m), -np.inf)
    best[0] = 0
    back, ids = np.zeros((length + 1, m), np.int32), np.zeros((length + 1, m), np.int32)
    for end in range(1, length + 1):
        for n in range(min(len(found), end), 0, -1):
            total = best[end - n] + found[n - 1][0][end - n]
            better = total > best[end]
            best[end][better] = total[better]
            back[end][better] = n
            ids[end][better] = found[n - 1][1][end - n][better]
    return back.T, ids.T


def advance(scores: np.ndarray, start: np.ndarray, back: np.ndarray | None = None) -> np.ndarray:
    """scores: length of the piece x place of its end x stretch; start: last places x stretch (x more). -> the same of the end.

    back gets the length of the best last piece of every place.
    """
    longest, length = scores.shape[:2]
    best = np.concatenate([start, np.full((length, *start.shape[1:]), -np.inf)])
    for end in range(length):
        for n in range(longest, 0, -1):
            step = scores[n - 1, end]
            total = best[longest + end - n] + (step if start.ndim == 2 else step[:, None])
            if back is None:
                np.maximum(best[longest + end], total, out=best[longest + end])
            else:
                better = total > best[longest + end]
                best[longest + end][better] = total[better]
                back[end][better] = n
    return best[length:]


def encode_long(word: str, pieces: Pieces) -> np.ndarray:
    """The ids of a word of any length, in parts of PART code points; a code point takes 5 bytes of backpointers."""
    longest, length = pieces.longest, len(word)
    back, ids = np.zeros(length + 1, np.uint8), np.full(length + 1, -1, np.int32)
    state = np.full(longest, -np.inf)  # best scores of the last places, the border of the part at the end
    state[-1] = 0
    for lo in range(0, length, PART):
        hi = min(lo + PART, length)
        before = min(longest, lo)  # code points before the part that pieces into it start with
        found = probe(code_points([word[lo - before : hi]]), pieces)
        n_stretches = -(-(hi - lo) // STRETCH)
        by_end = np.full((longest, n_stretches * STRETCH), -np.inf)  # what ends at each place of the part
        of_id = np.full((longest, hi - lo), -1, np.int32)
        for n, (score, piece) in enumerate(found, 1):
            ends = np.arange(score.shape[1]) + n - before - 1
            inside = ends >= 0
            by_end[n - 1, ends[inside]], of_id[n - 1, ends[inside]] = score[0, inside], piece[0, inside]
        scores = np.ascontiguousarray(by_end.reshape(longest, n_stretches, STRETCH).transpose(0, 2, 1))
        starts = np.empty((longest, n_stretches))
        if n_stretches > 1:
            alone = np.full((longest, n_stretches, longest), -np.inf)
            for k in range(longest):
                alone[k, :, k] = 0
            matrix = advance(scores, alone)  # place at the end x stretch x place before
        for k in range(n_stretches):
            starts[:, k] = state
            if k + 1 < n_stretches:
                state = (matrix[:, k] + state).max(1)
        steps = np.zeros((STRETCH, n_stretches), np.uint8)
        state = advance(scores, starts, steps)[:, -1]  # only the last part may end within a stretch
        flat = steps.T.reshape(-1)[: hi - lo]
        back[lo + 1 : hi + 1] = flat
        ids[lo + 1 : hi + 1] = of_id[flat.astype(np.int64) - 1, np.arange(hi - lo)]
    out, end, lengths = [], length, back.tolist()
    while end > 0:
        if ids[end] < 0:
            out.append(pieces.byte_ids[list(word[end - 1].encode("utf-8", "replace"))])
        else:
            out.append(ids[end : end + 1])
        end -= lengths[end]
    return np.concatenate(out[::-1]).astype(np.int32)


def encode_words(words: list[str], pieces: Pieces) -> list[np.ndarray]:
    """The ids of each word; words of equal length go through viterbi() together."""
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if w == SPACE_MARK:  # literally in the text: not a space
            out[i] = pieces.byte_ids[list(w.encode())]
        elif len(w) > STRETCH:
            out[i] = encode_long(w, pieces)
        else:
            by_length.setdefault(len(w), []).append(i)
    for length, members in by_length.items():
        step = max(1, CELLS // length)
        for at in range(0, len(members), step):
            part = members[at : at + step]
            back, ids = viterbi(code_points([words[i] for i in part]), pieces)
            ends = np.full(len(part), length)
            way = []  # from the last piece of each word to its first
            while (ends > 0).any():
                rows = np.nonzero(ends > 0)[0]
                way.append((rows, ids[rows, ends[rows]], ends[rows]))
                ends[rows] -= back[rows, ends[rows]]
            which, piece, end = (np.concatenate([w[k] for w in reversed(way)]) for k in range(3))
            order = np.argsort(which, kind="stable")
            which, piece, end = which[order], piece[order], end[order]
            starts = np.searchsorted(which, np.arange(len(part) + 1))
            unknown = set(which[piece < 0].tolist())
            for k, i in enumerate(part):
                found = piece[starts[k] : starts[k + 1]]
                if k in unknown:
                    word, ends_k = words[i], end[starts[k] : starts[k + 1]]
                    found = np.concatenate([pieces.byte_ids[list(word[e - 1].encode("utf-8", "replace"))] if p < 0 else [p] for p, e in zip(found, ends_k, strict=True)]).astype(np.int32)
                out[i] = found
    return out


class Encoder:
    """Encodes lists of texts and remembers words it has met, up to REMEMBERED of them."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.index]
        if new:
            found = encode_words(new, self.pieces)
            self.index.update(zip(new, range(len(self.lengths), len(self.lengths) + len(new)), strict=True))
            self.flat = np.concatenate([self.flat, *found])
            self.lengths = np.concatenate([self.lengths, [len(x) for x in found]])
            self.starts = np.cumsum(self.lengths) - self.lengths

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the offsets of each."""
        words = [_WORD.findall(" " + t) if t else [] for t in texts]
        if len(self.index) > REMEMBERED or len(self.flat) > 8 * REMEMBERED:
            self.forget()
        self.learn(set().union(*words))
        at = np.fromiter((self.index[w] for ws in words for w in ws), np.int64)
        lengths = self.lengths[at] if len(at) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.arange(total[-1]) - np.repeat(total[:-1] - self.starts[at], lengths)] if len(at) else np.zeros(0, np.int32)
        return ids, total[np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)]


def decode(ids: np.ndarray, offsets: np.ndarray, pieces: Pieces) -> list[str]:
    """Texts of encoded ids: the bytes of the pieces, without the space that encoding put first."""
    lengths = (pieces.offsets[1:] - pieces.offsets[:-1])[ids]
    total = np.concatenate([[0], np.cumsum(lengths)])
    data = pieces.data[np.arange(total[-1]) - np.repeat(total[:-1] - pieces.offsets[ids], lengths)].tobytes()
    ends = total[offsets]
    return [data[a + 1 : b].decode("utf-8", "replace") if b > a else "" for a, b in zip(ends[:-1], ends[1:], strict=True)]


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """docs with token_ids (array<int>) and n_tokens.

    A null text counts as empty and has no tokens. Rows stay as they are and may repeat; columns of these names are
    replaced; an empty table stays empty. The pieces are read by the driver and broadcast: their number is fixed.
    """
    given = docs.drop("token_ids", "n_tokens")
    shared = docs.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for whole in batches:
            for batch in pieces_of(whole):
                ids, offsets = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(np.diff(offsets))], [*batch.schema.names, "token_ids", "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)
    return given.mapInArrow(run, f"{schema}, token_ids array<int>, n_tokens long")


def decoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """docs with token_ids -> the same with decoded_text."""
    given = docs.drop("decoded_text")
    shared = docs.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                lists = batch.column("token_ids")
                offsets = np.concatenate([[0], np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))])
                texts = decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), offsets, shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded_text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)
    return given.mapInArrow(run, f"{schema}, decoded_text string")


def pieces_of(batch: pa.RecordBatch, chars: int = 1 << 21, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text, one row at least."""
    sizes = np.cumsum(np.nan_to_num(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + chars, "right"))
        end = min(max(end, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    docs = decoded(encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return docs.select("doc_id", "token_ids", "n_tokens", F.length("decoded_text").cast("long").alias("decoded_chars"), (F.col("decoded_text") == F.coalesce("text", F.lit(""))).alias("round_trip"))
