"""A copy of a SentencePiece model file that the library itself encodes by unigram Viterbi."""

import struct


def _varint(b, i):
    v = s = 0
    while True:
        v, s, i = v | (b[i] & 127) << s, s + 7, i + 1
        if b[i - 1] < 128:
            return v, i


def _pack(v):
    out = b""
    while v > 127:
        out, v = out + bytes([v & 127 | 128]), v >> 7
    return out + bytes([v])


def _fields(b):
    i = 0
    while i < len(b):
        start = i
        tag, i = _varint(b, i)
        if tag & 7 == 0:
            _, i = _varint(b, i)
            yield tag >> 3, b[start:i], None
        elif tag & 7 == 2:
            n, i = _varint(b, i)
            yield tag >> 3, b[start : i + n], b[i : i + n]
            i += n
        else:
            i += 4 if tag & 7 == 5 else 8
            yield tag >> 3, b[start:i], None


def as_unigram(model: bytes, scores: dict[int, float]) -> bytes:
    """The model with type unigram and other scores: piece is field 1 (score: its field 2), trainer field 2 (type: its field 3)."""
    out, n = b"", 0
    for number, raw, body in _fields(model):
        if number == 1:
            new = b"".join(_pack(2 << 3 | 5) + struct.pack("<f", scores[n]) if k == 2 and n in scores else r for k, r, _ in _fields(body))
            out, n = out + _pack(1 << 3 | 2) + _pack(len(new)) + new, n + 1
        elif number == 2:
            new = b"".join(_pack(3 << 3) + _pack(1) if k == 3 else r for k, r, _ in _fields(body))
            out += _pack(2 << 3 | 2) + _pack(len(new)) + new
        else:
            out += raw
    return out
