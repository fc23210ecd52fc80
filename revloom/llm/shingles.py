"""Vectorised hashes of words and of runs of words.

A word is hashed by tabulation: a random number for each byte at each of PLACES places,
summed.  Two different words agree with a chance of 2 to the power of -64, whatever their
bytes; longer words chain the sums of their blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

#: Bytes hashed at a time, and bytes of a block.
SLICE, PLACES = 1 << 17, 32
SPACES = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")
ODD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every other."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8; bytes split at the six ASCII white-space characters only."""
    return (text or "").encode("utf-8", "surrogatepass").split()


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A number for each place and byte (0 for white space), and which bytes are white space."""
    space = np.zeros(256, dtype=bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    numbers = np.random.default_rng(20).integers(0, 1 << 64, (PLACES, 256), dtype=np.uint64)
    numbers[:, space] = 0
    return numbers.ravel(), space


def piece_hashes(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One hash per piece of ``raw`` (bytes): from each start to the next one, without the
    white space at its end."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    numbers, space = _tables()
    raw, starts = raw[starts[0] :], starts - starts[0]
    sizes = np.diff(starts, append=len(raw))
    place = np.arange(len(raw), dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)
    terms = numbers[((place % PLACES) << 8) | raw]
    if sizes.max() <= PLACES:
        return mix(np.add.reduceat(terms, starts))
    filled = np.add.reduceat(~space[raw], starts, dtype=np.int64)
    sums = np.add.reduceat(terms, at := np.flatnonzero(place % PLACES == 0))
    first = np.searchsorted(at, starts)
    out = mix(sums[first])
    for k in range(1, -(-int(filled.max()) // PLACES)):
        more = np.flatnonzero(filled > k * PLACES)
        out[more] = mix(out[more] * np.uint64(ODD) + sums[first[more] + k])
    return out


def word_starts(raw: np.ndarray) -> np.ndarray:
    _, space = _tables()
    gap = space[raw]
    first = ~gap
    first[1:] &= gap[:-1]
    return np.flatnonzero(first)


def slices(raw: bytes, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Bounds of slices of about ``most`` bytes, which end where words do."""
    at = 0
    while at < len(raw):
        end = min(at + most, len(raw))
        if end < len(raw):  # cut at white space, the last one here or else the next one
            cut = max(raw.rfind(c, at, end) for c in SPACES)
            if cut < 0:
                cut = min((x for x in (raw.find(c, end) for c in SPACES) if x >= 0), default=len(raw) - 1)
            end = cut + 1
        yield at, end
        at = end


def texts_hashes(texts: Iterable[str | None]) -> list[np.ndarray]:
    """For each text one hash per word, in order."""
    parts = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    ends = np.cumsum([len(x) + 1 for x in parts])
    raw = b"\n".join(parts)
    hashes, places = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for at, end in slices(raw):
        some = np.frombuffer(raw, dtype=np.uint8, count=end - at, offset=at)
        starts = word_starts(some)
        hashes.append(piece_hashes(some, starts))
        places.append(starts + at)
    cuts = np.searchsorted(np.concatenate(places), ends[:-1])
    return np.split(np.concatenate(hashes), cuts) if parts else []


def text_hashes(text: str | None) -> np.ndarray:
    """One hash per word of a text, in order."""
    return texts_hashes([text])[0]


def batches_of(texts: list, most: int = SLICE) -> Iterator[tuple[int, list]]:
    """Consecutive texts, together at most ``most`` characters or one text, with the first's place."""
    at = size = 0
    for i, x in enumerate(texts):
        n = len(x or "")
        if size and size + n > most:
            yield at, texts[at:i]
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, texts[at:]


def combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of the pair, in order."""
    return mix(left * np.uint64(ODD) + (right ^ np.uint64(0xC2B2AE3D27D4EB4F)))


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words, built from runs of powers of two."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    power, runs, out, done = 1, hashes, None, 0
    while True:
        if length & power:
            part = runs[done : done + n]
            out = mix(part + np.uint64(power)) if out is None else combine(out, part)
            done += power
        if done == length:
            return out
        runs, power = combine(runs[:-power], runs[power:]), 2 * power
