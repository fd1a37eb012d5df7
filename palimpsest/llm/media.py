"""Media columns: texts stored losslessly as baseline JPEGs, read back through their DC-only thumbnails.

Each byte of the payload is one 8x8 block of that grey value: with a DC quantiser of 8 its only coefficient is the byte
less 128, so the thumbnail of one pixel a block is the payload again. The decoder reads baseline JPEGs in general (several
components, subsampling, AC coefficients, restart intervals) and keeps the DC coefficients of the first component.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Payloads are padded to rows of so many bytes; a row of blocks is a restart interval.
ROW = 192
#: Rows of blocks in one image (the format ends at 65,535 lines); longer payloads are stored as several images.
MOST_ROWS = 8191

#: Payload bytes that are coded together: an image at least.
TOGETHER = MOST_ROWS * ROW

# Code lengths and symbols of the standard luminance DC table (JPEG, table K.3), then a small AC table
# that holds the end of block alone.
DC_COUNTS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_SYMBOLS = list(range(12))
AC_COUNTS = [1] + [0] * 15
AC_SYMBOLS = [0]


def codes(counts: list[int]) -> list[tuple[int, int]]:
    """(code, length) of the symbols of a Huffman table, in order."""
    out, code = [], 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((code, length))
            code += 1
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number of each DC difference -255 to 255 with the end of block behind."""
    dc, (end, end_bits) = codes(DC_COUNTS), codes(AC_COUNTS)[0]
    value, length = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, bits = dc[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        value[d + 255] = ((code << size | extra) << end_bits) | end
        length[d + 255] = bits + size + end_bits
    return value, length


_VALUE, _LENGTH = _tables()


def _scans(pixels: np.ndarray, rows: list[int]) -> list[bytes]:
    """Entropy-coded scans of images that lie one above the other in ``pixels``; each row is a restart interval."""
    signed = pixels.astype(np.int64) - 128
    difference = np.diff(signed, axis=1, prepend=0) + 255
    value, length = _VALUE[difference], _LENGTH[difference]
    ends = length.cumsum(axis=1)
    size = -(-ends[:, -1] // 8)  # bytes of each row; the last is filled up with ones
    row_at = np.concatenate([[0], size.cumsum()])
    start = (ends - length + row_at[:-1, None] * 8).ravel()
    value, length = value.ravel(), length.ravel()
    words = np.zeros(int(row_at[-1]) + 8, np.uint8)
    shifted = value << (np.uint64(40) - (start % 8 + length).astype(np.uint64))  # a code and its place in a byte fill 40 bits at most
    at = start >> 3
    for k in range(5):
        # codes never share bits, so bytes of codes add up without a carry
        words += np.bincount(at + k, (shifted >> np.uint64(32 - 8 * k)) & np.uint64(255), minlength=len(words))[: len(words)].astype(np.uint8)
    spare = (size * 8 - ends[:, -1]).astype(np.int64)
    words[row_at[1:] - 1] |= ((1 << spare) - 1).astype(np.uint8)
    words = words[: row_at[-1]]
    stuffed = np.flatnonzero(words == 255) + 1
    last = np.cumsum(rows)
    inner = np.ones(len(pixels), bool)
    inner[last - 1] = False
    cut = row_at[1:][inner]
    number = (np.arange(len(pixels)) - np.repeat(last - rows, rows))[inner]
    marks = np.stack([np.full(len(cut), 255), 0xD0 + number % 8], axis=1).ravel().astype(np.uint8)
    where = np.concatenate([stuffed, np.repeat(cut, 2)])
    what = np.concatenate([np.zeros(len(stuffed), np.uint8), marks])
    order = np.argsort(where, kind="stable")  # a stuffed zero goes before the marker at the same place
    data = np.insert(words, where[order], what[order]).tobytes()
    ends = row_at[last] + np.searchsorted(where[order], row_at[last], "right")
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """For each payload, a positive multiple of ROW bytes, the JPEGs that hold it, one behind the other."""
    parts = [[min(MOST_ROWS, len(p) // ROW - at) for at in range(0, len(p) // ROW, MOST_ROWS)] for p in payloads]
    rows = [n for part in parts for n in part]
    scans = iter(zip(_scans(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW), rows), rows)) if rows else iter(())
    head = b"\xff\xd8" + _segment(0xDB, bytes([0]) + bytes([8]) * 64)
    tables = _segment(0xC4, bytes([0x00, *DC_COUNTS, *DC_SYMBOLS])) + _segment(0xC4, bytes([0x10, *AC_COUNTS, *AC_SYMBOLS]))
    tables += _segment(0xDD, ROW.to_bytes(2, "big")) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    out = []
    for part in parts:
        image = b""
        for scan, n in itertools.islice(scans, len(part)):
            frame = _segment(0xC0, bytes([8]) + (n * 8).to_bytes(2, "big") + (ROW * 8).to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
            image += head + frame + tables + scan + b"\xff\xd9"
        out.append(image)
    return out


@cache
def _lookup(counts: tuple[int, ...], symbols: bytes) -> np.ndarray:
    """Length << 8 | symbol for every 16 bits ahead; 0 where no code fits."""
    table = np.zeros(1 << 16, np.uint16)
    for (code, length), symbol in zip(codes(counts), symbols):
        table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return table


def images(data: bytes) -> Iterator[dict]:
    """The baseline JPEGs in ``data``: size, components, tables, restart interval and the cleaned bytes of their scan."""
    at = 0
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        image, at = {"quant": {}, "tables": {}, "restart": 0}, at + 2
        while True:
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                while body:
                    wide = 1 + (body[0] >> 4)
                    image["quant"][body[0] & 15] = int.from_bytes(body[1 : 1 + wide], "big")  # of DC alone
                    body = body[1 + 64 * wide :]
            elif marker == 0xC0:
                image |= {"height": int.from_bytes(body[1:3], "big"), "width": int.from_bytes(body[3:5], "big")}
                image["components"] = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
            elif 0xC1 <= marker <= 0xCF and marker != 0xC4:
                raise ValueError("not a baseline image")
            elif marker == 0xC4:
                while body:
                    counts = tuple(body[1:17])
                    image["tables"][body[0]] = counts, body[17 : 17 + sum(counts)]
                    body = body[17 + sum(counts) :]
            elif marker == 0xDD:
                image["restart"] = int.from_bytes(body, "big")
            elif marker == 0xDA:
                image["scan"] = {body[k]: (body[k + 1] >> 4, body[k + 1] & 15) for k in range(1, 1 + 2 * body[0], 2)}
                break
        rest = np.frombuffer(data, np.uint8, offset=at)
        marks = np.flatnonzero(rest[:-1] == 255)
        kinds = rest[marks + 1]
        end = int(marks[kinds == 0xD9][0])
        marks, kinds = marks[marks < end], kinds[marks < end]
        cuts = marks[kinds >= 0xD0]
        keep = np.ones(end, bool)
        keep[marks[kinds == 0] + 1] = False
        keep[cuts] = keep[cuts + 1] = False
        kept_before = np.concatenate([[0], keep.cumsum()])
        image["bits"] = rest[:end][keep]
        image["starts"] = np.concatenate([[0], kept_before[cuts]])
        at += end + 2
        yield image


def thumbnails(found: list[dict]) -> list[np.ndarray]:
    """DC-only luminance of each image: one pixel for each 8x8 block of the first component, rows by columns.

    The restart intervals of all images of one make are decoded side by side, one Huffman symbol each in a step.
    """
    out: list[np.ndarray | None] = [None] * len(found)
    makes: dict = {}
    for i, image in enumerate(found):
        make = tuple(image["components"]), *(tuple(sorted(image[x].items())) for x in ("scan", "tables", "quant")), image["restart"]
        makes.setdefault(make, []).append(i)
    for own in makes.values():
        for i, pixels in zip(own, _together([found[i] for i in own])):
            out[i] = pixels
    return out


def _together(same: list[dict]) -> list[np.ndarray]:
    first = same[0]
    parts = first["components"]
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    most_h, most_v = max(c[1] for c in parts), max(c[2] for c in parts)
    units = [(k, *first["scan"][c[0]]) for k, c in enumerate(parts) for _ in range(c[1] * c[2])]  # blocks of one MCU
    tables = {k: _lookup(*x) for k, x in first["tables"].items()}
    h, v = parts[0][1], parts[0][2]
    sizes = [(-(-x["width"] // (8 * most_h)), -(-x["height"] // (8 * most_v))) for x in same]
    mcus = [across * down for across, down in sizes]
    interval = first["restart"] or max(mcus)
    todo = np.concatenate([np.clip(n - np.arange(len(x["starts"])) * interval, 0, interval) for n, x in zip(mcus, same)]) * len(units)
    byte_at = np.cumsum([0, *(len(x["bits"]) for x in same)])
    bit = np.concatenate([x["starts"] + at for x, at in zip(same, byte_at)]).astype(np.int64) * 8
    data = np.concatenate([*(x["bits"] for x in same), np.full(8, 255, np.uint8)]).astype(np.uint32)
    ahead = data[:-3] << np.uint32(24) | data[1:-2] << np.uint32(16) | data[2:-1] << np.uint32(8) | data[3:]  # 32 bits from each byte
    dc = np.zeros((interval * h * v, len(bit)), np.int16)
    before = np.zeros((len(parts), len(bit)), np.int64)
    for block in range(int(todo.max(initial=0))):
        live = np.flatnonzero(todo > block)
        k, dc_table, ac_table = units[block % len(units)]
        symbol, now = _symbol(ahead, bit[live], tables[dc_table])
        size = symbol & 15
        raw = _bits(ahead, now, size)
        bit[live] = now + size
        before[k, live] += np.where((size > 0) & (raw < (1 << size >> 1)), raw - (1 << size) + 1, raw)
        if k == 0:
            dc[block // len(units) * h * v + block % len(units), live] = before[0, live]
        place = np.ones(len(live), np.int64)
        while len(live):  # AC coefficients are passed over
            symbol, now = _symbol(ahead, bit[live], tables[16 + ac_table])
            bit[live] = now + (symbol & 15)
            place = np.where(symbol == 0, 64, place + (symbol >> 4) + 1)
            more = place < 64
            live, place = live[more], place[more]
    pixels = np.clip((dc.T.astype(np.int32) * first["quant"][parts[0][3]] + 4) // 8 + 128, 0, 255).astype(np.uint8)
    out, row = [], 0
    for (across, down), image in zip(sizes, same):
        own = pixels[row : row + len(image["starts"])].reshape(-1)[: across * down * h * v]
        row += len(image["starts"])
        out.append(own.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h))
    return out


def _symbol(ahead: np.ndarray, bit: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = table[(ahead[bit >> 3] << (bit & 7).astype(np.uint32)) >> np.uint32(16)].astype(np.int64)
    return found & 255, bit + (found >> 8)


def _bits(ahead: np.ndarray, bit: np.ndarray, size: np.ndarray) -> np.ndarray:
    window = (ahead[bit >> 3] << (bit & 7).astype(np.uint32)) >> np.uint32(16)
    return (window.astype(np.int64) >> (16 - size)) & ((1 << size) - 1)


def feature(pixels: np.ndarray) -> str:
    """Dimensions and a 64-bit hash of the thumbnail: whether each of 8x8 mean cells is lighter than the cells' mean."""
    cells = pixels.astype(np.int64)
    for axis in (0, 1):
        n = pixels.shape[axis]
        at = np.arange(8) * n // 8
        wide = np.maximum(np.diff([*at, n]), 1).reshape((-1, 1) if axis == 0 else (1, -1))
        cells = np.add.reduceat(cells, at, axis) / wide
    bits = np.packbits((cells > cells.mean()).ravel())
    return f"{pixels.shape[1] * 8}x{pixels.shape[0] * 8}:{bits.tobytes().hex()}"


class Stored:
    """A payload as it is stored image by image: digests of the media and of the payload read back, and features."""

    def __init__(self, payload: bytes, keep: bool):
        self.parts = [payload[at : at + MOST_ROWS * ROW] for at in range(0, len(payload), MOST_ROWS * ROW)]
        self.media_hash, self.back_hash, self.media_bytes, self.back_bytes = hashlib.sha256(), hashlib.sha256(), 0, 0
        self.tail, self.features, self.media = b"", [], [] if keep else None

    def add(self, media: bytes, pixels: np.ndarray) -> None:
        back = pixels.tobytes()
        self.media_hash.update(media)
        self.back_hash.update(back)
        self.media_bytes += len(media)
        self.back_bytes += len(back)
        self.tail = (self.tail + back[-16:])[-16:]
        self.features.append(feature(pixels))
        if self.media is not None:
            self.media.append(media)


def store(payloads: list[bytes], keep: bool = False) -> list[Stored]:
    """All payloads, in groups of images of bounded size: what is held at once doesn't grow with a payload."""
    out = [Stored(x, keep) for x in payloads]
    todo = [(x, part) for x in out for part in x.parts]
    at = 0
    while at < len(todo):
        end, held = at, 0
        while end < len(todo) and (end == at or held + len(todo[end][1]) <= TOGETHER):
            held += len(todo[end][1])
            end += 1
        media = encode([part for _, part in todo[at:end]])
        for (own, _), data, pixels in zip(todo[at:end], media, thumbnails([x for data in media for x in images(data)])):
            own.add(data, pixels)
        at = end
    return out


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_columns(docs: DataFrame, keep: bool = False) -> DataFrame:
    """Sizes, digests and feature of every text of (doc_id, text) as an image; with ``keep`` the image itself too (media).

    A null text is an empty one. The payload is the UTF-8 text filled up with blanks to a positive multiple of ROW bytes. The
    features of several images of one text are joined by blanks.
    """
    names = [x.split(" ")[0] for x in _DIGEST.split(", ")] + ["media"] * keep
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()][: len(names)]

    def digest(docs: list, texts: list[bytes]) -> pa.RecordBatch:
        rows = []
        payloads = [x.ljust(max(-(-len(x) // ROW), 1) * ROW) for x in texts]
        for doc, text, own in zip(docs, texts, store(payloads, keep)):
            row = (doc, len(text), own.back_bytes, own.back_hash.hexdigest(), zlib.crc32(own.tail), own.media_bytes, own.media_hash.hexdigest(), " ".join(own.features))
            rows.append((*row, b"".join(own.media)) if keep else row)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc)
                texts.append((text.as_py() or "").encode("utf-8", "surrogatepass"))
                held += len(texts[-1]) + ROW
                if held >= TOGETHER:
                    yield digest(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield digest(ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _DIGEST + ", media binary" * keep)
