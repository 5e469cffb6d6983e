"""Block-compressed (BGZF) files: their blocks, virtual offsets, and tabix and CSI indexes. No Spark here.

A BGZF file is a run of gzip members of at most 64 KiB of text, each of which states its own size, so reading can start at any
of them. A virtual offset is the place of a block in the file, shifted left by 16 bits, plus a place in the block's text.
"""

from __future__ import annotations

import bisect
import glob
import io
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

from pyarrow import fs

# What each block begins with, the last block of a file, and the index's first bytes.
MAGIC = b"\x1f\x8b\x08\x04"
EMPTY_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
TABIX, CSI = b"TBI\x01", b"CSI\x01"
#: Text of a block, a little below 64 KiB so that text that does not compress fits too; and the most that a block can take.
BLOCK_TEXT, LARGEST = 65_280, 1 << 16
#: The smallest bins, and the windows of the linear index, are of 2**14 positions; each level of bins above covers eight times
#: as many, 2**29 by the five levels of a tabix index. Bin numbers have 32 bits, which is enough for ten levels.
WINDOW, DEPTH, DEEPEST = 14, 5, 10


# --- file systems --------------------------------------------------------------------------------------------------


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that a path or URI names, and the path in it."""
    if "://" in path or path.startswith("file:/"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1))
    return fs.LocalFileSystem(), path


def listed(paths: list[str], suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, size) of all files, of folders those with one of the suffixes; local paths may hold wildcards. Sorted by folder."""
    found = []
    for path in paths:
        expanded = sorted(glob.glob(path)) if "://" not in path and glob.has_magic(path) else [path]
        for one in expanded:
            system, name = located(one)
            lead = one[: len(one) - len(name)] if one.endswith(name) else ""
            info = system.get_file_info(name)
            if info.type == fs.FileType.Directory:
                inside = system.get_file_info(fs.FileSelector(name))
                files = [i for i in inside if i.type == fs.FileType.File and not i.base_name.startswith(("_", ".")) and i.base_name.endswith(suffixes)]
                found += sorted((lead + i.path, i.size) for i in files)
            elif info.type == fs.FileType.File:
                found.append((one, info.size))
            else:
                raise FileNotFoundError(one)
    return found


def exists(path: str) -> bool:
    system, name = located(path)
    return system.get_file_info(name).type != fs.FileType.NotFound


def is_bgzf(path: str) -> bool:
    """Whether a file begins with a block. False too where the path's file system cannot be reached from here."""
    try:
        system, name = located(path)
        with system.open_input_file(name) as file:
            return block_size(file.read(LARGEST), 0) is not None
    except (OSError, ValueError):
        return False


# --- blocks --------------------------------------------------------------------------------------------------------


def block_size(data: bytes, at: int) -> int | None:
    """Bytes of the block whose header is at ``at``; None if there is none."""
    if data[at : at + 4] != MAGIC or at + 18 > len(data):
        return None
    (extra,) = struct.unpack_from("<H", data, at + 10)
    place, end = at + 12, at + 12 + extra
    while place + 4 <= min(end, len(data)):
        one, two, length = struct.unpack_from("<BBH", data, place)
        if (one, two, length) == (66, 67, 2) and place + 6 <= len(data):
            return struct.unpack_from("<H", data, place + 4)[0] + 1
        place += 4 + length
    return None


def block_text(block: bytes) -> bytes:
    (extra,) = struct.unpack_from("<H", block, 10)
    text = zlib.decompress(block[12 + extra : -8], wbits=-15)
    if (zlib.crc32(text), len(text)) != struct.unpack("<II", block[-8:]):
        raise ValueError("a block does not agree with its checksum")
    return text


def first_block(file, start: int, size: int) -> int:
    """The place of the first block at or after ``start``; ``size`` (that of the file) if there is none.

    A header that is there by chance has no other header, or end of file, behind it at the distance that it states.
    """
    if start == 0:
        return 0
    at, data = start, b""
    file.seek(start)
    data = file.read(3 * LARGEST)
    place = data.find(MAGIC)
    while place >= 0:
        length = block_size(data, place)
        if length is not None:
            after = place + length
            if at + after == size or block_size(data, after) is not None:
                return at + place
        place = data.find(MAGIC, place + 1)
    return size


def blocks_from(file, place: int, ahead: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(place, text) of each block from ``place`` on, read ``ahead`` bytes at a time."""
    file.seek(place)
    data, base = b"", place
    while True:
        length = block_size(data, place - base)
        if length is None or place - base + length > len(data):
            data, base = data[place - base :], place
            more = file.read(ahead)
            if not more:
                if data:
                    raise ValueError(f"the file ends within a block, at {place}")
                return
            data += more
            if len(data) >= 18 and block_size(data, 0) is None:
                raise ValueError(f"no block at {place}")
            continue
        yield place, block_text(data[place - base : place - base + length])
        place += length


def lines_of_bytes(file, start: int, stop: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(virtual offset, line) of the lines that a range of compressed bytes owns.

    Those are the lines that start behind the first block of the range, or at 0, up to the first block after the range: a line
    at that very place is still this range's, so each line of a file has one owner however the file is cut.
    """
    place = first_block(file, start, size)
    skipping, tail, begun = place > 0, b"", 0
    if place >= stop and place > 0:
        return
    for place, text in blocks_from(file, place):
        at = 0
        if place >= stop:
            if skipping:
                return
            end = text.find(b"\n")
            if not tail:
                begun = place << 16
            if end >= 0:
                yield begun, tail + text[:end]
                return
            tail += text
            continue
        if skipping:
            at = text.find(b"\n") + 1
            if not at:
                continue
            skipping = False
        while (end := text.find(b"\n", at)) >= 0:
            yield (begun if tail else place << 16 | at), tail + text[at:end]
            tail, at = b"", end + 1
        if at < len(text):
            if not tail:
                begun = place << 16 | at
            tail += text[at:]
    if tail:
        yield begun, tail


def lines_of_offsets(file, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(virtual offset, line) of lines that start from one virtual offset to before another, both starts of lines."""
    tail, begun, at = b"", start, start & 0xFFFF
    for place, text in blocks_from(file, start >> 16):
        while True:
            if not tail:
                begun = place << 16 | at
                if begun >= stop:
                    return
            end = text.find(b"\n", at)
            if end < 0:
                break
            yield begun, tail + text[at:end]
            tail, at = b"", end + 1
        tail, at = tail + text[at:], 0
    if tail and begun < stop:
        yield begun, tail


class BlockWriter:
    """Writes text in blocks; ``offset`` is the virtual offset of what comes next."""

    def __init__(self, sink, level: int = 6) -> None:
        self._sink, self._level, self._text, self._place = sink, level, bytearray(), 0

    @property
    def offset(self) -> int:
        return self._place << 16 | len(self._text)

    def write(self, text: bytes) -> None:
        at = 0
        while at < len(text):
            room = BLOCK_TEXT - len(self._text)
            self._text += text[at : at + room]
            at += room
            if len(self._text) >= BLOCK_TEXT:
                self._flush()

    def _flush(self) -> None:
        text = bytes(self._text)
        for level in (self._level, 0):
            packer = zlib.compressobj(level, zlib.DEFLATED, -15)
            body = packer.compress(text) + packer.flush()
            if len(body) + 26 <= LARGEST:
                break
        head = EMPTY_BLOCK[:16] + struct.pack("<H", len(body) + 25)
        block = head + body + struct.pack("<II", zlib.crc32(text), len(text))
        self._sink.write(block)
        self._place += len(block)
        self._text = bytearray()

    def close(self) -> None:
        if self._text:
            self._flush()
        self._sink.write(EMPTY_BLOCK)


# --- indexes -------------------------------------------------------------------------------------------------------


def bin_of(start: int, end: int) -> tuple[int, int]:
    """The smallest bin that holds [start, end): the power of two that it covers, and its place among those of its size."""
    shift = WINDOW
    while start >> shift != (end - 1) >> shift:
        shift += 3
    return shift, start >> shift


def _first(level: int) -> int:
    """The number of the first bin of a level; the topmost level 0 has one bin, each other one eight times as many."""
    return ((1 << 3 * level) - 1) // 7


@dataclass
class Contig:
    """Chunks by bin; the least offset of records over windows, which holds up to the next window that has one."""

    bins: dict[tuple[int, int], list[tuple[int, int]]] = field(default_factory=dict)
    windows: dict[int, int] = field(default_factory=dict)
    #: Windows up to the last record's end.
    covered: int = field(default=0, compare=False)


@dataclass
class Tabix:
    """A binning and a linear index: which virtual offsets hold the records of a region.

    Stored as a tabix index where positions end at 2**29, else as a CSI index, which has more levels of bins and keeps the
    linear index as an offset in each bin.
    """

    contigs: dict[str, Contig] = field(default_factory=dict)
    unmapped: int | None = None
    #: The power of two of the smallest bins and the windows; others than WINDOW come from files only.
    window: int = WINDOW

    def add(self, contig: str, start: int, end: int, first: int, after: int) -> None:
        """A record over [start, end) that is written from ``first`` to ``after``; records come sorted by start."""
        if end > 1 << (WINDOW + 3 * DEEPEST):
            raise ValueError(f"positions beyond 2**{WINDOW + 3 * DEEPEST} do not fit this index")
        one = self.contigs.setdefault(contig, Contig())
        chunks = one.bins.setdefault(bin_of(start, end), [])
        if chunks and chunks[-1][1] >> 16 == first >> 16:
            chunks[-1] = chunks[-1][0], after
        else:
            chunks.append((first, after))
        # Windows that an earlier record lies over have its offset, which is less.
        window, last = max(start >> WINDOW, one.covered), (end - 1) >> WINDOW
        if last >= window:
            one.windows[window] = first
            one.covered = last + 1

    def ranges(self, contig: str, start: int = 0, end: int = 1 << 62) -> list[tuple[int, int]]:
        """Ascending, disjoint ranges of virtual offsets, bounds of lines, that hold all records over [start, end)."""
        one = self.contigs.get(contig)
        start = max(0, start)
        if one is None or end <= start:
            return []
        # Windows without an offset take that of the one before.
        before = max((window for window in one.windows if window <= start >> self.window), default=None)
        least = 0 if before is None else one.windows[before]
        wanted = sorted(
            (first, after)
            for (shift, place), chunks in one.bins.items()
            if place << shift < end and (place + 1) << shift > start
            for first, after in chunks
            if after > least
        )
        merged: list[tuple[int, int]] = []
        for first, after in wanted:
            if merged and first <= merged[-1][1]:
                merged[-1] = merged[-1][0], max(merged[-1][1], after)
            else:
                merged.append((first, after))
        return merged

    def cut(self, contig: str, first: int, after: int, size: int) -> list[tuple[int, int]]:
        """A range in parts of about ``size`` compressed bytes, cut where a window of positions begins."""
        places = sorted({offset for offset in self.contigs[contig].windows.values() if first < offset < after})
        out, begun = [], first
        for place in places:
            if (place >> 16) - (begun >> 16) >= size:
                out.append((begun, place))
                begun = place
        return [*out, (begun, after)]

    @property
    def depth(self) -> int:
        """Levels of bins below the topmost that positions need, those of a tabix index at least."""
        reach = max(((place + 1) << shift for one in self.contigs.values() for shift, place in one.bins), default=0)
        return max(DEPTH, -(-((reach - 1).bit_length() - self.window) // 3))

    @property
    def suffix(self) -> str:
        return ".tbi" if (self.depth, self.window) == (DEPTH, WINDOW) else ".csi"

    def to_bytes(self) -> bytes:
        names = b"".join(name.encode() + b"\0" for name in self.contigs)
        columns = struct.pack("<7i", 2, 1, 2, 0, ord("#"), 0, len(names)) + names
        depth, tabix = self.depth, self.suffix == ".tbi"
        count = struct.pack("<i", len(self.contigs))
        out = [TABIX, count, columns] if tabix else [CSI, struct.pack("<3i", self.window, depth, len(columns)), columns, count]
        for one in self.contigs.values():
            out.append(struct.pack("<i", len(one.bins)))
            known = sorted(one.windows)
            numbered = []
            for (shift, place), chunks in one.bins.items():
                # The offset that holds for the bin's first window; where none does yet, records begin with the first that has one.
                at = bisect.bisect_right(known, place << shift >> self.window) - 1
                least = one.windows[known[max(at, 0)]] if known else 0
                numbered.append((_first(depth - (shift - self.window) // 3) + place, least, chunks))
            for number, least, chunks in sorted(numbered):
                out.append(struct.pack("<Ii", number, len(chunks)) if tabix else struct.pack("<IQi", number, least, len(chunks)))
                out.append(b"".join(struct.pack("<QQ", *chunk) for chunk in chunks))
            if tabix:
                offsets = accumulate((one.windows.get(window, 0) for window in range(one.covered)), max)
                out.append(struct.pack(f"<i{one.covered}Q", one.covered, *offsets))
        sink = io.BytesIO()
        writer = BlockWriter(sink)
        writer.write(b"".join(out))
        writer.close()
        return sink.getvalue()

    @classmethod
    def of(cls, path: str) -> Tabix | None:
        """The index that stands beside a file, if any does."""
        return next((cls.read(path + suffix) for suffix in (".tbi", ".csi") if exists(path + suffix)), None)

    @classmethod
    def read(cls, path: str) -> Tabix:
        system, name = located(path)
        with system.open_input_file(name) as file:
            data = b"".join(text for _, text in blocks_from(file, 0))
        tabix = data[:4] == TABIX
        if not tabix and data[:4] != CSI:
            raise ValueError(f"{path} is no index of this kind")
        window, depth, n_columns = (WINDOW, DEPTH, 0) if tabix else struct.unpack_from("<3i", data, 4)
        if not tabix and n_columns < 28:
            raise ValueError(f"{path} does not name its contigs")
        at = 8 if tabix else 16
        (n_names,) = struct.unpack_from("<i", data, at + 24)
        names, after = data[at + 28 : at + 28 + n_names].split(b"\0"), at + (28 + n_names if tabix else n_columns)
        (n_contigs,) = struct.unpack_from("<i", data, 4 if tabix else after)
        at = after if tabix else after + 4
        out = cls(window=window)
        for contig in names[:n_contigs]:
            one = out.contigs[contig.decode()] = Contig()
            (n_bins,) = struct.unpack_from("<i", data, at)
            at += 4
            for _ in range(n_bins):
                if tabix:
                    (number, n_chunks), least = struct.unpack_from("<Ii", data, at), 0
                else:
                    number, least, n_chunks = struct.unpack_from("<IQi", data, at)
                at += 8 if tabix else 16
                flat = struct.unpack_from(f"<{2 * n_chunks}Q", data, at)
                at += 16 * n_chunks
                # Bins behind the last level's hold statistics, not places.
                if number >= _first(depth + 1):
                    continue
                level = next(level for level in range(depth, -1, -1) if number >= _first(level))
                shift, place = window + 3 * (depth - level), number - _first(level)
                one.bins[shift, place] = list(zip(flat[::2], flat[1::2]))
                begins = place << shift >> window
                if least:
                    one.windows[begins] = max(one.windows.get(begins, 0), least)
            if tabix:
                (one.covered,) = struct.unpack_from("<i", data, at)
                offsets = struct.unpack_from(f"<{one.covered}Q", data, at + 4)
                at += 4 + 8 * one.covered
                seen = 0
                for number, offset in enumerate(offsets):
                    if offset not in (0, seen):
                        one.windows[number] = seen = offset
        return out


def gzi_places(path: str) -> list[tuple[int, int]]:
    """(place in the file, place in the text) of each block, from the index of a block-compressed file."""
    system, name = located(path)
    with system.open_input_file(name) as file:
        data = file.read()
    (n,) = struct.unpack_from("<Q", data)
    flat = struct.unpack_from(f"<{2 * n}Q", data, 8)
    return [(0, 0), *zip(flat[::2], flat[1::2])]


def text_range(file, places: list[tuple[int, int]] | None, start: int, stop: int) -> bytes:
    """Text bytes ``start`` to ``stop``, of a plain file (``places`` None) or by a block index."""
    if places is None:
        file.seek(start)
        return file.read(stop - start)
    at = bisect.bisect_right(places, start, key=lambda place: place[1]) - 1
    block, text_at = places[at]
    out = bytearray()
    for _, text in blocks_from(file, block, ahead=2 * LARGEST):
        if text_at + len(text) > start:
            out += text[max(0, start - text_at) : stop - text_at]
        text_at += len(text)
        if text_at >= stop:
            break
    return bytes(out)
