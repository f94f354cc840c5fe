"""Grams as Spark columns: complete windows only, offsets from 0 to length - n."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def symbol_width(alphabet_size: int) -> int:
    """Bytes of a symbol for an alphabet of that many."""
    if alphabet_size < 1 or alphabet_size > 1 << 32:
        raise ValueError("an alphabet has 1 to 2 ** 32 symbols")
    return 1 if alphabet_size <= 256 else 2 if alphabet_size <= 65536 else 4


def auto_stride(n: int) -> int:
    """The stride that long grams get by default."""
    return max(n // 4, 1)


def symbol_grams(content: Column, n: int, width: int = 1) -> Column:
    """Every window of n big-endian symbols, as bytes; a partial last symbol is dropped. Null and short contents have none."""
    size = n * width
    starts = F.sequence(F.lit(1), F.length(content) - (size - 1), F.lit(width))
    return F.when(F.length(content) >= size, F.transform(starts, lambda i: F.substring(content, i, F.lit(size)))).otherwise(F.array().cast("array<binary>"))


def byte_grams(content: Column, n: int) -> Column:
    return symbol_grams(content, n, 1)


def decode_symbols(content: Column, width: int) -> Column:
    """The content as an array of unsigned numbers."""
    return F.transform(symbol_grams(content, 1, width), lambda s: F.conv(F.hex(s), 16, 10).cast("long"))


def content_slice(content: Column, offset: int, length: int) -> Column:
    """length bytes from offset (counted from 0)."""
    return F.substring(content, offset + 1, length)


def bucketize(hashed: Column, filter_size: int) -> Column:
    """An unsigned 32-bit hash, given as int or long, modulo filter_size."""
    return hashed.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)) % F.lit(filter_size)


def gram_to_hex(gram: Column) -> Column:
    return F.hex(gram)
