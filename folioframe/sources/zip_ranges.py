"""Members of zip archives by ranges: the directory at an archive's end says where each lies, and only that is read.

Directories are read piece by piece and members one by one, so memory does not grow with the archive, and one archive feeds many tasks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

# Signatures and layouts of the format.
END, END64, LOCATOR64, DIRECTORY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_FIELDS, END64_FIELDS, LOCATOR_FIELDS = struct.Struct("<4s4H2LH"), struct.Struct("<4sQ2H2L4Q"), struct.Struct("<4sLQL")
ENTRY_FIELDS, LOCAL_FIELDS = struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s5H3L2H")
STORED, DEFLATED = 0, 8
ENCRYPTED, UTF8 = 1, 0x800
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
LARGE_SIZES = 1  # the extra field that holds what does not fit 32 bits
#: Bytes of a directory that are held at once.
PIECE = 1 << 20


class Entry(NamedTuple):
    """A member: its name, where its local header begins in the file, packed and plain size, method, checksum and flags."""

    name: str
    offset: int
    packed: int
    size: int
    method: int
    crc: int
    flags: int


def _at(source, offset: int, size: int) -> bytes:
    source.seek(offset)
    data = source.read(size)
    if len(data) != size:
        raise ValueError("archive ends too early")
    return data


def _directory(source, length: int) -> tuple[int, int, int]:
    """(begin, bytes, shift) of the directory: where it lies in the file, and by how much data in front of the archive shifts all offsets."""
    tail_at = max(0, length - END_FIELDS.size - FULL16)
    tail = _at(source, tail_at, length - tail_at)
    at = tail.find(END)
    # the first one whose comment reaches the file's end: later ones stand in that comment
    while at >= 0 and not (len(tail) - at >= END_FIELDS.size and at + END_FIELDS.size + END_FIELDS.unpack_from(tail, at)[-1] == len(tail)):
        at = tail.find(END, at + 1)
    if at < 0:
        raise ValueError("not a zip archive")
    *_, entries, size, offset, _ = END_FIELDS.unpack_from(tail, at)
    stop = tail_at + at
    if entries == FULL16 or FULL32 in (size, offset):
        if stop >= LOCATOR_FIELDS.size and (raw := _at(source, stop - LOCATOR_FIELDS.size, LOCATOR_FIELDS.size))[:4] == LOCATOR64:
            where = LOCATOR_FIELDS.unpack(raw)[2]
            # with data in front of the archive the place does not fit: then it stands before the locator
            if where + END64_FIELDS.size > length or _at(source, where, 4) != END64:
                where = stop - LOCATOR_FIELDS.size - END64_FIELDS.size
            large = END64_FIELDS.unpack(_at(source, where, END64_FIELDS.size))
            if large[0] != END64:
                raise ValueError("directory of a large archive not found")
            size, offset, stop = large[8], large[9], where
    return stop - size, size, stop - size - offset


def _large(extra: bytes, packed: int, size: int, offset: int) -> tuple[int, int, int]:
    """Sizes and offset with those that stand in the extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<2H", extra, at)
        if kind == LARGE_SIZES:
            values = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            size = next(values) if size == FULL32 else size
            packed = next(values) if packed == FULL32 else packed
            offset = next(values) if offset == FULL32 else offset
        at += 4 + n
    return packed, size, offset


def entries(source, length: int, piece: int = PIECE) -> Iterator[Entry]:
    """The members of an archive, an open seekable file of so many bytes, in the directory's order; folders are left out."""
    begin, left, shift = _directory(source, length)
    held, at = b"", 0
    while left or at < len(held):
        if len(held) - at < ENTRY_FIELDS.size + 3 * FULL16 and left:
            more = _at(source, begin, min(piece, left))
            held, at, begin, left = held[at:] + more, 0, begin + len(more), left - len(more)
            continue
        fields = ENTRY_FIELDS.unpack_from(held, at)
        if fields[0] != DIRECTORY:
            raise ValueError("broken directory")
        flags, method, crc, packed, size, n_name, n_extra, n_comment, offset = (*fields[3:5], *fields[7:13], fields[16])
        at += ENTRY_FIELDS.size
        name = held[at : at + n_name].decode("utf-8" if flags & UTF8 else "cp437", "replace")
        packed, size, offset = _large(held[at + n_name : at + n_name + n_extra], packed, size, offset)
        at += n_name + n_extra + n_comment
        if not name.endswith("/"):
            yield Entry(name, offset + shift, packed, size, method, crc, flags)


def read_member(source, entry: Entry) -> bytes:
    """A member's content; only its range is read. An error where it is encrypted, packed by another method, or not what its checksum says."""
    if entry.flags & ENCRYPTED:
        raise ValueError(f"{entry.name} is encrypted")
    header = LOCAL_FIELDS.unpack(_at(source, entry.offset, LOCAL_FIELDS.size))
    if header[0] != LOCAL:
        raise ValueError(f"{entry.name} is not where the directory says")
    raw = _at(source, entry.offset + LOCAL_FIELDS.size + header[-2] + header[-1], entry.packed)
    if entry.method not in (STORED, DEFLATED):
        raise ValueError(f"{entry.name} is packed by method {entry.method}")
    data = zlib.decompress(raw, -zlib.MAX_WBITS, max(entry.size, 1)) if entry.method == DEFLATED else raw
    if len(data) != entry.size or zlib.crc32(data) != entry.crc:
        raise ValueError(f"{entry.name} is damaged")
    return data
