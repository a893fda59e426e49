"""Seeded draws that depend on the row key only, never on the partitioning.

Every draw is the md5 of ``seed|key|stream|number`` read as a fraction, so a lost task, another
cluster size or another engine gives the same value.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hex digits are 52 bits: with the half step below the fraction is exact in a double.
HEX_DIGITS = 13
STEPS = float(2**52)


def _text(value: Column | str | int) -> Column:
    return value.cast("string") if isinstance(value, Column) else F.lit(str(value))


def digest(key: Column, seed: int, stream: str = "", number: Column | int = 0) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), _text(key), F.lit(stream), _text(number)))


def fraction(text: Column, start: int = 1) -> Column:
    """Thirteen hex digits of a digest as a number in the open interval (0, 1)."""
    whole = F.conv(F.substring(text, start, HEX_DIGITS), 16, 10)
    return (whole.cast("long").cast("double") + F.lit(0.5)) / F.lit(STEPS)


def uniform(key: Column, seed: int, stream: str, number: Column | int = 0) -> Column:
    """Uniform on the open interval (0, 1)."""
    return fraction(digest(key, seed, stream, number))


def uniform_between(
    low: float, high: float, key: Column, seed: int, stream: str, number: Column | int = 0
) -> Column:
    return F.lit(float(low)) + uniform(key, seed, stream, number) * F.lit(float(high) - float(low))


def normal_pair(text: Column) -> Column:
    """Two independent standard normals from one digest (Box-Muller), as an array."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(fraction(text)))
    angle = F.lit(2.0) * F.pi() * fraction(text, HEX_DIGITS + 1)
    return F.array(radius * F.cos(angle), radius * F.sin(angle))


def normal(key: Column, seed: int, stream: str, number: Column | int = 0) -> Column:
    return F.get(normal_pair(digest(key, seed, stream, number)), F.lit(0))


def _hash_fraction(h: Column) -> Column:
    """Upper 52 bits of a 64-bit hash as a number in (0, 1)."""
    return (F.shiftrightunsigned(h, 12).cast("double") + F.lit(0.5)) / F.lit(STEPS)


def normals(key: Column, seed: int, stream: str, number: Column, count: int) -> Column:
    """``count`` (even) independent normals for draw ``number``.

    For many draws per row: two 64-bit hashes per pair instead of a digest in hex digits.
    """
    pairs = count // 2

    def hashed(i: Column) -> Column:
        text = F.concat_ws(
            "|", F.lit(str(seed)), _text(key), F.lit(stream), _text(number * pairs + i)
        )
        return F.xxhash64(text)

    def pair(h: Column) -> Column:
        radius = F.sqrt(F.lit(-2.0) * F.ln(_hash_fraction(h)))
        angle = F.lit(2.0) * F.pi() * _hash_fraction(F.xxhash64(h))
        return F.array(radius * F.cos(angle), radius * F.sin(angle))

    # Binding the hashes to the lambda variable computes each of them once.
    hashes = F.transform(F.sequence(F.lit(0), F.lit(pairs - 1)), hashed)
    return F.flatten(F.transform(hashes, pair))


# -- the same draws for the rows of an Arrow batch ------------------------------------------------

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_SPARK_SEED = 42


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _finished(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _step(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _turned(h ^ (_turned(word * _P2, 31) * _P1), 27) * _P1 + _P4


def hashed_texts(texts: np.ndarray) -> np.ndarray:
    """``xxhash64`` of texts of one length, given as bytes (row, byte)."""
    n, size = texts.shape
    seed = np.uint64(_SPARK_SEED)
    texts, at = np.ascontiguousarray(texts), 0

    def words(kind: str, width: int) -> np.ndarray:
        return np.ascontiguousarray(texts[:, at:at + width]).view(kind)[:, 0].astype(np.uint64)

    with np.errstate(over="ignore"):
        if size >= 32:
            lanes = [np.full(n, s) for s in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
            while at + 32 <= size:
                for i in range(4):
                    lanes[i] = _turned(lanes[i] + words("<u8", 8) * _P2, 31) * _P1
                    at += 8
            h = sum((_turned(lane, by) for lane, by in zip(lanes[1:], (7, 12, 18))), _turned(lanes[0], 1))
            for lane in lanes:
                h = (h ^ (_turned(lane * _P2, 31) * _P1)) * _P1 + _P4
        else:
            h = np.full(n, seed + _P5)
        h = h + np.uint64(size)
        while at + 8 <= size:
            h = _step(h, words("<u8", 8))
            at += 8
        if at + 4 <= size:
            h = _turned(h ^ (words("<u4", 4) * _P1), 23) * _P2 + _P3
            at += 4
        while at < size:
            h = _turned(h ^ (words("u1", 1) * _P5), 11) * _P1
            at += 1
        return _finished(h)


def normal_columns(heads: np.ndarray, tail: bytes) -> np.ndarray:
    """The pair of ``normals`` of the texts ``heads`` (row, byte) followed by ``tail``: (row, 2)."""
    end = np.broadcast_to(np.frombuffer(tail, np.uint8), (len(heads), len(tail)))
    first = hashed_texts(np.concatenate([heads, end], axis=1))
    with np.errstate(over="ignore"):
        second = _finished(_step(np.full(len(first), np.uint64(_SPARK_SEED) + _P5 + np.uint64(8)), first))
    u, v = (((h >> np.uint64(12)).astype(float) + 0.5) / STEPS for h in (first, second))
    radius, angle = np.sqrt(-2.0 * np.log(u)), 2.0 * np.pi * v
    return np.column_stack([radius * np.cos(angle), radius * np.sin(angle)])
