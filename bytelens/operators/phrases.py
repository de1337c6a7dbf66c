"""Phrase-dictionary coding of a block, and what a code over all parses would save.

The stretches not yet covered by a phrase are kept as a list: a phrase occurs in them as often as it
would be used, and admitting it splits them.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np

from .codec import Decoder, Encoder

# Longest phrase, least count, candidates, phrases, bytes of an archive's header.
LONGEST, LEAST, CANDIDATES, MOST, HEADER = 7, 4, 3000, 1024, 22


def admit(data: bytes) -> list[bytes]:
    """Phrases by falling count * (length - 1), each taken if it shortens the description."""
    seen = Counter(data[i : i + n] for n in range(2, LONGEST + 1) for i in range(len(data) - n + 1))
    likely = sorted((p for p, c in seen.items() if c >= LEAST), key=lambda p: (-seen[p] * (len(p) - 1), p))[:CANDIDATES]
    free, symbols, taken = [data], float(len(data)), []
    for p in likely:
        if len(taken) == MOST:
            break
        uses = sum(s.count(p) for s in free)
        if uses < 2:
            continue
        after = symbols - uses * (len(p) - 1)
        if 8 * (len(p) + 1) + uses * (math.log2(after / uses) - 8 * len(p)) < 0:
            taken.append(p)
            free = [x for s in free for x in s.split(p) if len(x) > 1]
            symbols = after
    return taken


def symbols_of(data: bytes, phrases: list[bytes]) -> list[int]:
    """The longest phrase at each place, the later admitted of equals, else the byte; phrase k is 256 + k."""
    number = {p: 256 + k for k, p in enumerate(phrases)}
    out, at = [], 0
    while at < len(data):
        n = next((n for n in range(LONGEST, 1, -1) if data[at : at + n] in number and at + n <= len(data)), 1)
        out.append(number[data[at : at + n]] if n > 1 else data[at])
        at += n
    return out


def encode(data: bytes) -> tuple[list[bytes], int, bytes]:
    """(phrases, number of symbols, payload): symbols under counts that start at one each."""
    phrases = admit(data)
    stream, counts, out = symbols_of(data, phrases), np.ones(256 + len(phrases), np.int64), Encoder()
    for s in stream:
        begin = int(counts[:s].sum())
        out.put(begin, begin + int(counts[s]), int(counts.sum()))
        counts[s] += 1
    return phrases, len(stream), out.finish() if stream else b""


def decode(phrases: list[bytes], n: int, payload: bytes) -> bytes:
    counts, source, out = [1] * (256 + len(phrases)), Decoder(payload), []
    for _ in range(n):
        s = source.get(counts)
        counts[s] += 1
        out.append(bytes([s]) if s < 256 else phrases[s - 256])
    return b"".join(out)


def archive_bits(phrases: list[bytes], payload: bytes) -> int:
    return 8 * (HEADER + sum(len(p) + 1 for p in phrases) + len(payload))


def parse_saving(data: bytes, phrases: list[bytes]) -> tuple[float, float]:
    """Bits of the one parse and of all parses together, under the final shares of the symbols."""
    stream = Counter(symbols_of(data, phrases))
    total = sum(stream.values())
    share = {(bytes([s]) if s < 256 else phrases[s - 256]): c / total for s, c in stream.items()}
    single = -sum(c * math.log2(c / total) for c in stream.values())
    mass = [-math.inf] * len(data) + [0.0]
    for i in range(len(data) - 1, -1, -1):
        ways = [math.log2(share[x]) + mass[i + n] for n in range(1, LONGEST + 1) if (x := data[i : i + n]) in share and i + n <= len(data)]
        if ways:
            top = max(ways)
            mass[i] = top + math.log2(sum(2 ** (w - top) for w in ways)) if top > -math.inf else top
    return single, -mass[0]
