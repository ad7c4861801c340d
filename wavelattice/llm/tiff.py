"""TIFF columns: image directories, strips and tiles, predictors, page rows.

:func:`write_tiff` stores 8-bit samples (none, PackBits, LZW or deflate; strips
or tiles; with or without the horizontal predictor). :func:`read_pages` walks
the chain of image directories, decodes every strip or tile, undoes the
predictor and yields one page after another. :func:`decode_pages` is the
DataFrame form, one row per page.

Defined results: null bytes have no pages; a broken file gives one row with
page -1 and the reason in ``error`` after the pages before the fault (no size,
a size that its data can't fill, missing or short blocks and bad codes are
faults); a directory chain that loops ends where it meets itself; in
:func:`store_texts` a null text counts as empty, a null doc_id passes through,
repeated rows give repeated results, an empty table gives no rows, and further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, id_text, text_slices

NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
#: Bytes of a value of each field type (fixed values of the format).
_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODE = {1: "B", 3: "H", 4: "I"}
_RUNS = re.compile(rb"(.)\1{2,127}", re.DOTALL).finditer


#: No code of the format stands for more bytes than this for each byte of itself.
_MOST = 4096


def packbits_encode(data: bytes) -> bytes:
    """One row of a block: the format packs each row apart."""
    out, at = bytearray(), 0

    def literal(part: bytes) -> None:
        for i in range(0, len(part), 128):
            out.append(min(128, len(part) - i) - 1)
            out.extend(part[i : i + 128])

    for run in _RUNS(data):
        literal(data[at : run.start()])
        out.append(257 - (run.end() - run.start()))
        out.extend(run[1])
        at = run.end()
    literal(data[at:])
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at = [], 0
    n = 0
    while at < len(data) and n < size:
        head = data[at]
        if head < 128:
            out.append(data[at + 1 : at + 2 + head])
            n += head + 1
            at += head + 2
        elif head > 128:
            out.append(data[at + 1 : at + 2] * (257 - head))
            n += 257 - head
            at += 2
        else:
            at += 1
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes from the high bit on, one code wider a code early, table reset when full."""
    out, bits, held = bytearray(), 256, 9  # begins with a clear code
    width, table, nxt = 9, {bytes([i]): i for i in range(256)}, 258
    prefix = b""
    for i in range(len(data)):
        longer = prefix + data[i : i + 1]
        if longer in table:
            prefix = longer
            continue
        bits, held = bits << width | table[prefix], held + width
        if held > 512:
            held, rest = held % 8, held // 8
            out += (bits >> held).to_bytes(rest, "big")
            bits &= (1 << held) - 1
        table[longer] = nxt
        nxt += 1
        prefix = data[i : i + 1]
        if nxt == 4094:
            bits, held = (bits << width | table[prefix]) << width | 256, held + 2 * width
            width, table, nxt, prefix = 9, {bytes([i]): i for i in range(256)}, 258, b""
        elif nxt == 1 << width:
            width += 1
    if prefix:
        bits, held = bits << width | table[prefix], held + width
        nxt += 1
        if nxt == 1 << width and width < 12:
            width += 1
    bits, held = bits << width | 257, held + width
    pad = -held % 8
    return bytes(out) + (bits << pad).to_bytes((held + pad) // 8, "big")


def lzw_decode(data: bytes, size: int) -> bytes:
    data = data + b"\0\0\0"
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, limit, at, last = first[:], 9, 511, 0, None
    out, end = [], 8 * (len(data) - 3)
    while at + width <= end:
        byte = at >> 3
        code = (int.from_bytes(data[byte : byte + 3], "big") >> (24 - width - (at & 7))) & ((1 << width) - 1)
        at += width
        if code == 257:
            break
        if code == 256:
            table, width, limit, last = first[:], 9, 511, None
            continue
        if last is None:
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("a code comes before its entry")
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
            if len(table) == limit and width < 12:
                width += 1
                limit = (1 << width) - 1
        out.append(entry)
        last = entry
    return b"".join(out)[:size]


def _encoded(compression: int, block: np.ndarray) -> bytes:
    if compression == PACKBITS:
        return b"".join(packbits_encode(row.tobytes()) for row in block)
    data = block.tobytes()
    return data if compression == NONE else lzw_encode(data) if compression == LZW else zlib.compress(data, 1)


def _decoded(compression: int, data: bytes, size: int) -> bytes:
    if compression == NONE:
        return data
    if compression in (DEFLATE, 32946):
        return zlib.decompressobj().decompress(data, size)
    if compression == LZW:
        return lzw_decode(data, size)
    if compression == PACKBITS:
        return packbits_decode(data, size)
    raise ValueError(f"compression {compression} is not supported")


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 32, tile: int = 0) -> bytes:
    """``pages``: arrays (height, width, samples) of uint8; ``tile``: side of the tiles, 0 for strips."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        height, width, samples = page.shape
        blocks = []
        if tile:
            padded = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile, samples), np.uint8)
            padded[:height, :width] = page
            blocks = [padded[y : y + tile, x : x + tile] for y in range(0, padded.shape[0], tile) for x in range(0, padded.shape[1], tile)]
        else:
            blocks = [page[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        offsets, sizes = [], []
        for block in blocks:
            if predictor == 2:
                block = block.copy()
                block[:, 1:] -= block[:, :-1].copy()
            data = _encoded(compression, block)
            offsets.append(len(out))
            sizes.append(len(data))
            out += data
        fields = {256: (4, [width]), 257: (4, [height]), 258: (3, [8] * samples), 259: (3, [compression]), 262: (3, [2 if samples == 3 else 1]), 277: (3, [samples]), 284: (3, [1]), 317: (3, [predictor])}
        if tile:
            fields |= {322: (4, [tile]), 323: (4, [tile]), 324: (4, offsets), 325: (4, sizes)}
        else:
            fields |= {273: (4, offsets), 278: (4, [rows_per_strip]), 279: (4, sizes)}
        entries = []
        for tag, (kind, values) in sorted(fields.items()):
            data = struct.pack(f"<{len(values)}{_CODE[kind]}", *values)
            if len(data) > 4:
                out += b"\0" * (len(out) % 2)
                place, data = struct.pack("<I", len(out)), out.extend(data)
            else:
                place = data.ljust(4, b"\0")
            entries.append(struct.pack("<HHI", tag, kind, len(values)) + place)
        out += b"\0" * (len(out) % 2)
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def read_pages(data: bytes) -> Iterator[np.ndarray]:
    """Pages as arrays (height, width, samples); raises ValueError on what it can't decode."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        tags: dict[int, list[int]] = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind in _CODE:
                place = at + 10 + 12 * k
                if _SIZE[kind] * count > 4:
                    place = struct.unpack_from(order + "I", data, place)[0]
                tags[tag] = list(struct.unpack_from(f"{order}{count}{_CODE[kind]}", data, place))
        one = lambda tag, default: tags.get(tag, [default])[0]
        width, height, samples = one(256, 0), one(257, 0), one(277, 1)
        if set(tags.get(258, [1])) != {8} or one(284, 1) != 1:
            raise ValueError("only interleaved 8-bit samples are supported")
        tiled = 324 in tags
        bw, bh = (one(322, 0), one(323, 0)) if tiled else (width, min(one(278, height), height))
        if min(width, height, samples, bw, bh) < 1:
            raise ValueError("a page has no size")
        offsets, sizes = tags[324 if tiled else 273], tags[325 if tiled else 279]
        across, down = -(-width // bw), -(-height // bh)
        if len(offsets) != len(sizes) or len(offsets) != across * down:
            raise ValueError("blocks are missing or too many")
        if across * bw * down * bh * samples > _MOST * sum(min(n, max(0, len(data) - at)) for at, n in zip(offsets, sizes)):
            raise ValueError("a page is larger than its data can fill")
        page = np.zeros((height, width, samples), np.uint8)
        for k, (offset, size) in enumerate(zip(offsets, sizes)):
            y, x = k // across * bh, k % across * bw
            rows = bh if tiled else min(bh, height - y)
            raw = _decoded(one(259, 1), data[offset : offset + size], rows * bw * samples)
            if len(raw) < rows * bw * samples:
                raise ValueError("a block is cut short")
            block = np.frombuffer(raw, np.uint8, rows * bw * samples).reshape(rows, bw, samples)
            if one(317, 1) == 2:
                block = np.cumsum(block, axis=1, dtype=np.uint8)
            page[y : y + rows, x : x + bw] = block[: height - y, : width - x]
        yield page
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


_PAGE = "page int, width int, height int, samples int, pixels binary, error string"


def decode_pages(files: DataFrame, id_cols: str | list[str] = "doc_id", data_col: str = "data") -> DataFrame:
    """``id_cols``, page, width, height, samples, pixels, error: one row per page, in the order of the files."""
    keep = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    schema = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep) + ", " + _PAGE
    names = [*keep, *(x.split()[0] for x in _PAGE.split(", "))]
    kinds = [pa.int32()] * 4 + [pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, held = [], [], 0

            def made() -> pa.RecordBatch:
                ids = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(keep))]
                return pa.RecordBatch.from_arrays([*ids, *(pa.array(list(c), k) for c, k in zip(zip(*rows), kinds))], names)

            for i in range(batch.num_rows):
                data = batch.column(len(keep))[i].as_py()
                try:
                    for k, page in enumerate(read_pages(data) if data is not None else ()):
                        at.append(i)
                        rows.append((k, page.shape[1], page.shape[0], page.shape[2], page.tobytes(), None))
                        held += page.size
                        if held > 4 << 20:
                            yield made()
                            at, rows, held = [], [], 0
                except (ValueError, KeyError, IndexError, struct.error, zlib.error, MemoryError) as e:
                    at.append(i)
                    rows.append((-1, None, None, None, None, str(e) or type(e).__name__))
            if rows:
                yield made()

    return arrow_map(files.select(*keep, F.col(data_col).alias("__data" if "data" in keep else "data")), run, schema)


WIDTH, SAMPLES, PAGE_ROWS = 192, 3, 256
ROW = WIDTH * SAMPLES


def layout_of(payload: bytes) -> dict:
    """How a payload is stored: by its own checksum, so all codecs and both block kinds are in use."""
    k = zlib.crc32(payload) & 15
    if k < 1:
        return {"compression": LZW, "predictor": 1}
    if k < 5:
        return {"compression": PACKBITS, "predictor": 1, "tile": 64 if k == 4 else 0}
    return {"compression": DEFLATE, "predictor": 2 if k < 8 else 1, "tile": 64 if k == 8 else 0}


def to_pages(payload: bytes) -> list[np.ndarray]:
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, SAMPLES)
    return [samples[i : i + PAGE_ROWS] for i in range(0, len(samples), PAGE_ROWS)]


def features(payload: bytes, n_pages: int) -> str:
    """Pages, mean, deviation and a 64-bit average hash over equal blocks of the samples."""
    x = np.frombuffer(payload, np.uint8)
    blocks = np.add.reduceat(x, np.arange(64) * (len(x) // 64), dtype=np.int64)
    sizes = np.full(64, len(x) // 64)
    sizes[-1] += len(x) % 64
    bits = blocks * len(x) > int(blocks.sum()) * sizes
    counts = np.bincount(x, minlength=256).astype(np.float64)
    mean = float(counts @ np.arange(256) / len(x))
    spread = float(counts @ (np.arange(256) - mean) ** 2 / len(x)) ** 0.5
    return f"pages={n_pages};mean={mean:.3f};sd={spread:.3f};ahash={np.packbits(bits).tobytes().hex()}"


_FILE = "doc_id long, file long, n_bytes long, media_bytes long, media_sha256 string"


def write_texts(docs: DataFrame) -> DataFrame:
    """``docs``: doc_id, text. A TIFF file (``data``) of each text, numbered within its task."""
    names = [*(x.split()[0] for x in _FILE.split(", ")), "data"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = 0
        for whole in batches:
            for batch in text_slices(whole):
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                    payload = text + b"\xff" * (-len(text) % ROW if text else ROW)
                    media = write_tiff(to_pages(payload), **layout_of(payload))
                    rows.append((doc_id, file, len(text), len(media), hashlib.sha256(media).hexdigest(), media))
                    file += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    return arrow_map(docs, run, _FILE + ", data binary")


def payloads_of(pages: DataFrame) -> DataFrame:
    """Page rows to one row a file. The pages of a file follow each other in one task, so none moves."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def one(head: tuple, parts: list[bytes]) -> tuple:
        back = b"".join(parts)
        return (head[0], head[2], len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), head[3], head[4], features(back, len(parts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, parts = None, []
        for batch in batches:
            rows = []
            columns = [batch.column(k).to_pylist() for k in range(5)]
            pixels, errors = batch.column("pixels"), batch.column("error").to_pylist()
            for i, now in enumerate(zip(*columns)):
                if errors[i] is not None:
                    raise ValueError(f"doc_id {now[0]}: {errors[i]}")
                if head is not None and now != head:
                    rows.append(one(head, parts))
                    parts = []
                head = now
                parts.append(pixels[i].as_py())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)
        if head is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(one(head, parts), kinds)], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return arrow_map(pages, run, schema)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a TIFF file, its pages as rows (:func:`decode_pages`), and what they give put together."""
    files = write_texts(id_text(docs, id_col, text_col))
    keep = [x.split()[0] for x in _FILE.split(", ")]
    return payloads_of(decode_pages(files, keep))
