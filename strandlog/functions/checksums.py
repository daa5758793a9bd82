"""Checksums, byte layouts, Bloom positions and run names as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF
#: Fixed value: the reflected polynomial of CRC-64/ISO.
CRC64_ISO = 0xD800000000000000


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def crc64_table() -> list[int]:
    out = []
    for byte in range(256):
        v = byte
        for _ in range(8):
            v = (v >> 1) ^ CRC64_ISO if v & 1 else v >> 1
        out.append(v)
    return out


def _bytes(col: Column) -> Column:
    """Array of the unsigned bytes of a binary column; empty for zero bytes."""
    hexed = F.hex(col)
    n = F.octet_length(col)
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    return F.when(n > 0, each).otherwise(F.array().cast("array<bigint>"))


def crc64_iso(col: Column) -> Column:
    """CRC-64/ISO of a string's UTF-8 bytes or of binary, as a signed BIGINT with the same bits."""
    table = F.array(*[F.lit(_signed(v)) for v in crc64_table()])
    step = lambda c, b: F.element_at(table, (c.bitwiseXOR(b).bitwiseAND(F.lit(255)) + 1).cast("int")).bitwiseXOR(
        F.shiftrightunsigned(c, 8))
    folded = F.aggregate(_bytes(col.cast("binary")), F.lit(-1).cast("long"), step)
    return folded.bitwiseXOR(F.lit(-1).cast("long"))


def bloom_positions(col: Column, bits: Column, hashes: int = 7) -> Column:
    """Bit positions of a key in a filter of ``bits`` bits: double hashing on the halves of its CRC-64."""
    def positions(c: Column) -> Column:
        h0, h1 = c.bitwiseAND(F.lit(MASK32)), F.shiftrightunsigned(c, 32).bitwiseAND(F.lit(MASK32))
        return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)),
                           lambda i: F.pmod((h0 + i.cast("long") * h1).bitwiseAND(F.lit(MASK32)), bits))

    return F.transform(F.array(crc64_iso(col)), positions)[0]  # an array of one, so that the checksum is computed once


def le_bytes(col: Column, width: int) -> Column:
    """Little-endian bytes of a non-negative integer column."""
    h = F.lpad(F.hex(col.cast("long")), 2 * width, "0")
    return F.unhex(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(width))]))


def wal_body(seq: Column, op: Column, key: Column, value: Column) -> Column:
    """Log record bytes after the checksum: op 1, seq 8, key length 2, value length 4, key, value."""
    k, v = key.cast("binary"), F.coalesce(value.cast("binary"), F.lit(b""))
    return F.concat(le_bytes(op, 1), le_bytes(seq, 8), le_bytes(F.octet_length(k), 2), le_bytes(F.octet_length(v), 4), k, v)


def wal_crc(seq: Column, op: Column, key: Column, value: Column) -> Column:
    return F.crc32(wal_body(seq, op, key, value))


def run_name(n: Column, ext: str = "sst") -> Column:
    return F.format_string(f"%06d.{ext}", n)


def run_number(path: Column) -> Column:
    return F.regexp_extract(path, r"(\d+)\.(sst|wal)$", 1).cast("long")


def log_to_run_name(path: Column) -> Column:
    return F.regexp_replace(path, r"\.wal$", ".sst")
