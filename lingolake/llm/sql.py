"""Pieces of DuckDB SQL that the corpus queries' oracles share."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _nibble(n: int) -> int:
    """What four zero bits make of a CRC-32 that ends in n."""
    for _ in range(4):
        n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
    return n


_TABLE = "[" + ", ".join(f"{_nibble(n)}::BIGINT" for n in range(16)) + "]"


def crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, unsigned: half a byte at a time, the low one first."""
    half = f"CAST(instr('123456789ABCDEF', substr(hex({text}), CAST(CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END AS BIGINT), 1)) AS BIGINT)"
    steps = f"list_prepend(4294967295::BIGINT, list_transform(range(2 * strlen({text})), lambda i: {half}))"
    return f"xor(list_reduce({steps}, lambda c, n: xor(c >> 4, {_TABLE}[1 + (xor(c, n) & 15)])), 4294967295)"


def ascii_lower(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"
