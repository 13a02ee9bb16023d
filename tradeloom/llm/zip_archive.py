"""ZIP containers of stored members, written whole and read by byte ranges.

The reader asks a `read(offset, length)` function for the end record, the ZIP64 records if there
are any, the central directory and single local headers; member data are then read at any offset.
Nothing is extracted. Layout and signatures are those of the published ZIP format.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

Read = Callable[[int, int], bytes]

# Fixed values of the format: signatures, field layouts and markers of values kept elsewhere.
LOCAL = struct.Struct("<4s5H3I2H")
CENTRAL = struct.Struct("<4s6H3I5H2I")
END = struct.Struct("<4s4H2IH")
END64 = struct.Struct("<4sQ2H2I4Q")
LOCATOR64 = struct.Struct("<4sIQI")
LOCAL_SIGN, CENTRAL_SIGN, END_SIGN = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
END64_SIGN, LOCATOR64_SIGN = b"PK\x06\x06", b"PK\x06\x07"
EXTRA64 = 0x0001
UTF8_NAME = 0x0800
ENCRYPTED = 0x0001
STORED = 0
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
LONGEST_COMMENT = 0xFFFF
DAY = 0x0021  # 1980-01-01


class BadArchive(ValueError):
    """The bytes are not a ZIP archive that can be read by ranges."""


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    flags: int
    crc: int
    packed: int
    size: int
    header_at: int


def pack(members: list[tuple[str, bytes]], comment: bytes = b"", zip64: bool = False) -> bytes:
    """One archive of stored members; with `zip64` all sizes and places are 64 bits wide.

    Archives that outgrow the narrow fields are written with `zip64` in any case.
    """
    zip64 = zip64 or len(members) >= FULL16 or sum(len(d) + 400 for _, d in members) >= FULL32
    parts, central, at = [], [], 0
    for name, data in members:
        label, crc, n = name.encode(), zlib.crc32(data), len(data)
        version, narrow = (45, FULL32) if zip64 else (20, n)
        local_extra = struct.pack("<2H2Q", EXTRA64, 16, n, n) if zip64 else b""
        place_extra = struct.pack("<2H3Q", EXTRA64, 24, n, n, at) if zip64 else b""
        head = LOCAL.pack(LOCAL_SIGN, version, UTF8_NAME, STORED, 0, DAY, crc, narrow, narrow, len(label), len(local_extra))
        central.append(
            CENTRAL.pack(
                CENTRAL_SIGN, version, version, UTF8_NAME, STORED, 0, DAY, crc, narrow, narrow, len(label),
                len(place_extra), 0, 0, 0, 0, FULL32 if zip64 else at,
            ) + label + place_extra
        )
        parts += [head, label, local_extra, data]
        at += len(head) + len(label) + len(local_extra) + n
    listing, count = b"".join(central), len(members)
    parts.append(listing)
    if zip64:
        end_at = at + len(listing)
        parts.append(END64.pack(END64_SIGN, END64.size - 12, 45, 45, 0, 0, count, count, len(listing), at))
        parts.append(LOCATOR64.pack(LOCATOR64_SIGN, 0, end_at, 1))
        parts.append(END.pack(END_SIGN, 0, 0, FULL16, FULL16, FULL32, FULL32, len(comment)))
    else:
        parts.append(END.pack(END_SIGN, 0, 0, count, count, len(listing), at, len(comment)))
    return b"".join([*parts, comment])


def _end(read: Read, size: int) -> tuple[int, tuple]:
    """Place and fields of the end record: the last whose comment reaches the end of the file."""
    start = max(0, size - END.size - LONGEST_COMMENT)
    tail = read(start, size - start)
    at = tail.rfind(END_SIGN)
    while at >= 0:
        if at + END.size <= len(tail):
            fields = END.unpack_from(tail, at)
            if at + END.size + fields[-1] == len(tail):
                return start + at, fields
        at = tail.rfind(END_SIGN, 0, at)
    raise BadArchive("no end of a central directory")


def directory(read: Read, size: int) -> list[Member]:
    """All members by the central directory, with the sizes of ZIP64 where these are used."""
    end_at, (_, disk, first_disk, _, count, length, at, _) = _end(read, size)
    if end_at >= LOCATOR64.size:
        found = read(end_at - LOCATOR64.size, LOCATOR64.size)
        if found[:4] == LOCATOR64_SIGN:
            place = LOCATOR64.unpack(found)[2]
            wide = read(place, END64.size)
            if len(wide) < END64.size or wide[:4] != END64_SIGN:
                raise BadArchive("the ZIP64 locator points elsewhere")
            _, _, _, _, disk, first_disk, _, count, length, at = END64.unpack(wide)
    if disk or first_disk:
        raise BadArchive("the archive has several parts")
    if at + length > end_at:
        raise BadArchive("the central directory lies outside of the file")
    listing, members, here = read(at, length), [], 0
    for _ in range(count):
        if listing[here : here + 4] != CENTRAL_SIGN or here + CENTRAL.size > len(listing):
            raise BadArchive("the central directory is cut")
        (_, _, _, flags, method, _, _, crc, packed, full, n_name, n_extra, n_comment, _, _, _, header_at) = (
            CENTRAL.unpack_from(listing, here)
        )
        here += CENTRAL.size
        name = listing[here : here + n_name].decode("utf-8" if flags & UTF8_NAME else "cp437")
        extra = listing[here + n_name : here + n_name + n_extra]
        full, packed, header_at = _widened(extra, full, packed, header_at)
        members.append(Member(name, method, flags, crc, packed, full, header_at))
        here += n_name + n_extra + n_comment
    return members


def _widened(extra: bytes, *narrow: int) -> list[int]:
    """Values that fill their field are taken, in order, from the ZIP64 extra field."""
    at, wide = 0, b""
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<2H", extra, at)
        if kind == EXTRA64:
            wide = extra[at + 4 : at + 4 + n]
        at += 4 + n
    values, used = [], 0
    for value in narrow:
        if value == FULL32 and used + 8 <= len(wide):
            (value,) = struct.unpack_from("<Q", wide, used)
            used += 8
        values.append(value)
    return values


def data_at(read: Read, member: Member) -> int:
    """Where the bytes of a stored member begin; its local header has fields of its own length."""
    if member.method != STORED or member.flags & ENCRYPTED:
        raise BadArchive(f"{member.name} is not stored plainly")
    head = read(member.header_at, LOCAL.size)
    if len(head) < LOCAL.size or head[:4] != LOCAL_SIGN:
        raise BadArchive(f"{member.name} has no local header")
    fields = LOCAL.unpack(head)
    return member.header_at + LOCAL.size + fields[-2] + fields[-1]
