"""CRC-32 of very many spans at once, from a table of (distance from the end, byte).

CRC-32 is linear over XOR but for its start value: the checksum of a span is the XOR of one contribution for each byte, which depends
on the byte and its distance from the end only, and of a constant for the length.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: The reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Distances that the table holds; longer spans are folded in blocks of as many bytes.
DISTANCES = 64
#: Blocks whose bytes are gathered at once.
STEP = 1 << 17


@lru_cache(maxsize=1)
def contributions() -> np.ndarray:
    """Row d, column b: what byte b does to the checksum from d bytes before the end."""
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = np.where(row & np.uint32(1), (row >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), row >> np.uint32(1))
    table = [row]
    for _ in range(DISTANCES - 1):
        table.append((table[-1] >> np.uint32(8)) ^ row[table[-1] & np.uint32(255)])
    return np.array(table)


def _apply(shift: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Move checksums (linear part) by the bytes of a shift table: one row for each byte of the value, lowest first."""
    out = shift[0][values & np.uint32(255)]
    for k in range(1, 4):
        out = out ^ shift[k][(values >> np.uint32(8 * k)) & np.uint32(255)]
    return out


@lru_cache(maxsize=64)
def shift_by(power: int) -> np.ndarray:
    """Table that moves a checksum by 2 ** ``power`` zero bytes."""
    if power < 2:
        # below four bytes a part of the value stays: move it byte by byte
        values = np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None])
        for _ in range(1 << power):
            values = (values >> np.uint32(8)) ^ contributions()[0][values & np.uint32(255)]
        return values
    if 1 << power <= DISTANCES:
        return contributions()[(1 << power) - 1 - np.arange(4)]
    half = shift_by(power - 1)
    return _apply(half, half)


def constants(lengths: np.ndarray) -> np.ndarray:
    """What the start and end values add to a span of each length: the checksum of as many zero bytes."""
    values, place = np.unique(lengths, return_inverse=True)
    moved = np.full(len(values), 0xFFFFFFFF, np.uint32)
    for power in range(int(values.max()).bit_length() if len(values) else 0):
        some = (values >> power) & 1 == 1
        moved[some] = _apply(shift_by(power), moved[some])
    return (moved ^ np.uint32(0xFFFFFFFF))[place]


def _blocks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Linear part for spans of 1 to ``DISTANCES`` bytes."""
    flat, out = contributions().reshape(-1), np.empty(len(starts), np.uint32)
    for at in range(0, len(starts), STEP):
        end = ends[at : at + STEP]
        sizes = end - starts[at : at + STEP]
        edges = np.cumsum(sizes)
        distance = np.repeat(edges, sizes) - 1 - np.arange(edges[-1])
        byte = data[np.repeat(end, sizes) - 1 - distance]
        out[at : at + STEP] = np.bitwise_xor.reduceat(flat[distance * 256 + byte], edges - sizes)
    return out


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of ``data[start:end]`` for each span; spans may overlap and may be empty (0)."""
    sizes = ends - starts
    out = constants(sizes)
    short = np.flatnonzero((sizes > 0) & (sizes <= DISTANCES))
    out[short] ^= _blocks(data, starts[short], ends[short])
    long = np.flatnonzero(sizes > DISTANCES)
    if not len(long):
        return out
    # blocks are counted from the end of a span, so that only the first one may be short; neighbours are folded in pairs
    pieces = -(-sizes[long] // DISTANCES)
    owner = np.repeat(np.arange(len(long)), pieces)
    place = np.repeat(np.cumsum(pieces), pieces) - 1 - np.arange(len(owner))
    stop = ends[long][owner] - place * DISTANCES
    value = _blocks(data, np.maximum(stop - DISTANCES, starts[long][owner]), stop)
    power = DISTANCES.bit_length() - 1
    while len(value) > len(long):
        odd = place & 1 == 1
        value[odd] = _apply(shift_by(power), value[odd])
        place, power = place >> 1, power + 1
        first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])
        value, place, owner = np.bitwise_xor.reduceat(value, first), place[first], owner[first]
    out[long] ^= value
    return out
