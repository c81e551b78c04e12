"""Byte layouts: entries, blocks, block meta, checksums."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def u16(n: Column) -> Column:
    """A number as two bytes, the low one first."""
    return F.unhex(F.format_string("%02X%02X", n % 256, F.floor(n / 256)))


def encode_entry(key: Column, value: Column) -> Column:
    """Length and bytes of the key, then of the value, within the JVM."""
    key, value = key.cast("binary"), value.cast("binary")
    return F.concat(u16(F.octet_length(key)), key, u16(F.octet_length(value)), value)


def checksum_ok(payload: Column, stored: Column) -> Column:
    return F.crc32(payload) == stored


def encode_block(entries: list[tuple[bytes, bytes]]) -> bytes:
    """Entries, their offsets, and their number."""
    if not entries:
        raise ValueError("a block has at least one entry")
    body, offsets = b"", []
    for key, value in entries:
        offsets.append(len(body))
        body += struct.pack("<H", len(key)) + key + struct.pack("<H", len(value)) + value
    return body + struct.pack(f"<{len(offsets)}HH", *offsets, len(offsets))


def decode_block(data: bytes) -> list[tuple[bytes, bytes]]:
    (n,) = struct.unpack_from("<H", data, len(data) - 2)
    out = []
    for at in struct.unpack_from(f"<{n}H", data, len(data) - 2 - 2 * n):
        (size,) = struct.unpack_from("<H", data, at)
        key = data[at + 2 : at + 2 + size]
        (length,) = struct.unpack_from("<H", data, at + 2 + size)
        out.append((key, data[at + 4 + size : at + 4 + size + length]))
    return out


def seal_block(data: bytes) -> bytes:
    return data + struct.pack("<I", zlib.crc32(data))


def open_block(sealed: bytes) -> list[tuple[bytes, bytes]]:
    data, (crc,) = sealed[:-4], struct.unpack("<I", sealed[-4:])
    if zlib.crc32(data) != crc:
        raise ValueError("a block's checksum doesn't match")
    return decode_block(data)


def encode_meta(zones: list[tuple[int, bytes, bytes]]) -> bytes:
    """(offset, first key, last key) of each block after their number."""
    out = struct.pack("<I", len(zones))
    for offset, first, last in zones:
        out += struct.pack("<IH", offset, len(first)) + first + struct.pack("<H", len(last)) + last
    return out


def decode_meta(data: bytes) -> list[tuple[int, bytes, bytes]]:
    (n,) = struct.unpack_from("<I", data)
    at, out = 4, []
    for _ in range(n):
        offset, size = struct.unpack_from("<IH", data, at)
        first = data[at + 6 : at + 6 + size]
        at += 6 + size
        (size,) = struct.unpack_from("<H", data, at)
        out.append((offset, first, data[at + 2 : at + 2 + size]))
        at += 2 + size
    return out
