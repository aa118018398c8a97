"""Keccak-256, which Spark lacks, and the words of contract data that are too wide for its integers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LANES, MASK = 5, (1 << 64) - 1


def _turn(x: int, n: int) -> int:
    n %= 64
    return (x << n | x >> (64 - n)) & MASK if n else x


def _tables() -> tuple[list[int], dict[tuple[int, int], int], dict[tuple[int, int], tuple[int, int]]]:
    """Round constants from the shift register of the standard, and where each lane turns and moves."""
    constants, state = [], 1
    for _ in range(24):
        value = 0
        for j in range(7):
            if state & 1:
                value |= 1 << ((1 << j) - 1)
            state = state << 1 ^ (0x171 if state & 0x80 else 0)
        constants.append(value)
    turns, moves, x, y = {(0, 0): 0}, {}, 1, 0
    for t in range(24):
        turns[x, y] = (t + 1) * (t + 2) // 2
        x, y = y, (2 * x + 3 * y) % LANES
    for x in range(LANES):
        for y in range(LANES):
            moves[y, (2 * x + 3 * y) % LANES] = (x, y)
    return constants, turns, moves


CONSTANTS, TURNS, MOVES = _tables()
CELLS = [(x, y) for y in range(LANES) for x in range(LANES)]


def permuted(a: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    for constant in CONSTANTS:
        columns = [a[x, 0] ^ a[x, 1] ^ a[x, 2] ^ a[x, 3] ^ a[x, 4] for x in range(LANES)]
        mixed = {(x, y): a[x, y] ^ columns[x - 1] ^ _turn(columns[(x + 1) % LANES], 1) for x, y in CELLS}
        moved = {to: _turn(mixed[at], TURNS[at]) for to, at in MOVES.items()}
        a = {(x, y): moved[x, y] ^ (~moved[(x + 1) % LANES, y] & MASK & moved[(x + 2) % LANES, y]) for x, y in CELLS}
        a[0, 0] ^= constant
    return a


def keccak256(data: bytes) -> bytes:
    """The original padding (a single 1 byte), as chains use it, not that of SHA-3."""
    rate = 136
    held = bytearray(data + b"\x01" + b"\0" * (-(len(data) + 1) % rate))
    held[-1] |= 0x80
    a = dict.fromkeys(CELLS, 0)
    for start in range(0, len(held), rate):
        for i in range(rate // 8):
            a[CELLS[i]] ^= int.from_bytes(held[start + 8 * i : start + 8 * i + 8], "little")
        a = permuted(a)
    return b"".join(a[c].to_bytes(8, "little") for c in CELLS[:4])


@F.pandas_udf(T.StringType())
def keccak_hex(data: pd.Series) -> pd.Series:
    """Hex digits of the hash of a binary column; nulls stay."""
    return data.map(lambda d: None if d is None else keccak256(bytes(d)).hex())


def create2_address(factory: Column, salt: Column, code_hash: Column) -> Column:
    """The address that a factory gives a contract, from hex text without prefix."""
    return F.concat(F.lit("0x"), F.right(keccak_hex(F.unhex(F.concat(F.lit("ff"), factory, salt, code_hash))), F.lit(40)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def words(data: pd.Series) -> pd.Series:
    """The 256-bit words of hex data as decimal text, so that none is too wide; an odd end is left out."""

    def cut(text: str | None) -> list[str] | None:
        if text is None:
            return None
        text = text.removeprefix("0x")
        return [str(int(text[i : i + 64], 16)) for i in range(0, len(text) - 63, 64)]

    return data.map(cut)
