"""Checksums of the binary formats, over many records or pieces of one at a time; used for import and export only."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

# The reflected Castagnoli polynomial, and offset and prime of 64-bit FNV-1a.
CASTAGNOLI = 0x82F63B78
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def _table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (CASTAGNOLI if n & 1 else 0)
        out.append(n)
    return out


TABLE = np.array(_table(), np.uint32)
#: Records from this length on are cut into pieces that are summed side by side.
LONG = 1 << 12

_shifts: dict[int, np.ndarray] = {}


def _registers(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, begin: int) -> np.ndarray:
    """The register after each stretch of ``data``, from ``begin`` on, all side by side."""
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order], lengths[order]
    crc = np.full(len(at), begin, np.uint32)
    active = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")
    for j, n in enumerate(active.tolist()):
        c = crc[:n]
        crc[:n] = TABLE[(c ^ data[at[:n] + j]) & 0xFF] ^ (c >> 8)
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _shifted(length: int) -> np.ndarray:
    """What ``length`` zero bytes make of a register, as a table by byte."""
    if length not in _shifts:
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        for _ in range(length):
            bits = TABLE[bits & 0xFF] ^ (bits >> 8)
        table = np.zeros((4, 256), np.uint32)
        for k in range(32):
            table[k // 8] ^= np.where(np.arange(256) >> (k % 8) & 1, bits[k], np.uint32(0)).astype(np.uint32)
        _shifts[length] = table
    return _shifts[length]


def _long_register(data: np.ndarray, register: int) -> int:
    """The register after a long stretch: pieces of one length side by side, joined by shifting, then the rest."""
    size = 1 << max(6, (len(data).bit_length() - 1) // 2)
    n = len(data) // size
    pieces = _registers(data, np.arange(n) * size, np.full(n, size), 0)
    table = _shifted(size)
    for r in pieces.tolist():
        register = int(table[0, register & 0xFF] ^ table[1, register >> 8 & 0xFF] ^ table[2, register >> 16 & 0xFF] ^ table[3, register >> 24]) ^ r
    for b in data[n * size :].tolist():
        register = int(TABLE[(register ^ b) & 0xFF]) ^ (register >> 8)
    return register


def crc32c(data: bytes, crc: int = 0) -> int:
    """CRC-32C; pass an earlier result to go on from it."""
    return _long_register(np.frombuffer(data, np.uint8), crc ^ 0xFFFFFFFF) ^ 0xFFFFFFFF


def crc32c_many(data: bytes, starts: Sequence[int], ends: Sequence[int]) -> list[int]:
    """CRC-32C of many stretches of ``data``."""
    raw, at = np.frombuffer(data, np.uint8), np.asarray(starts, np.int64)
    lengths = np.asarray(ends, np.int64) - at
    long = lengths >= LONG
    out = np.zeros(len(at), np.uint32)
    out[~long] = _registers(raw, at[~long], lengths[~long], 0xFFFFFFFF) ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(long).tolist():
        out[i] = _long_register(raw[at[i] : at[i] + lengths[i]], 0xFFFFFFFF) ^ 0xFFFFFFFF
    return out.tolist()


def fnv1a64(data: bytes) -> int:
    """64-bit FNV-1a; each step needs the one before, so this goes byte by byte."""
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h
