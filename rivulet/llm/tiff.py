"""Media columns: TIFF files in a binary column, written from bytes and read to one row for each page.

The reader walks the chain of image directories in either byte order, takes strips or tiles, undoes PackBits, LZW or deflate
and then the horizontal predictor, and yields 8-bit samples page by page. The writer stores a payload losslessly as grey
8-bit samples, one page for each PAGE_ROWS rows; the column writer deals payloads by their checksum over all FORMS of storage.

Defined results: a null or empty file has no pages; a file that can't be read gives the pages before the fault and one row with page
-1 and the reason, and so does a page that declares more than MOST_SAMPLES samples or more values than the file has bytes; a strip
is never inflated beyond the samples it stands for; equal payloads give equal files; repeated rows give repeated pages; an empty
table gives an empty result; a column that has the name of the result is replaced, other columns pass through whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, with_made

#: Samples in a row, rows in a strip and rows on a page, as the writer sets them.
WIDTH, STRIP_ROWS, PAGE_ROWS = 64, 1024, 16384
#: Fixed numbers of the format: tags, and sizes of the field types.
TAG_WIDTH, TAG_LENGTH, TAG_BITS, TAG_COMPRESSION, TAG_PHOTOMETRIC = 256, 257, 258, 259, 262
TAG_STRIP_OFFSETS, TAG_SAMPLES, TAG_ROWS_PER_STRIP, TAG_STRIP_COUNTS, TAG_PLANAR, TAG_PREDICTOR = 273, 277, 278, 279, 284, 317
TAG_TILE_WIDTH, TAG_TILE_LENGTH, TAG_TILE_OFFSETS, TAG_TILE_COUNTS = 322, 323, 324, 325
FIELD_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Samples that a page may have at most.
MOST_SAMPLES = 1 << 28


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples_per_pixel: int
    compression: int
    samples: np.ndarray  # height x width x samples_per_pixel, uint8


# --- codecs -----------------------------------------------------------------------------------------------------


def packbits_decode(data: bytes, most: int = MOST_SAMPLES) -> bytes:
    out, i, size = [], 0, 0
    while i < len(data) and size < most:
        n = data[i]
        size += n + 1 if n < 128 else 257 - n if n > 128 else 0
        if n < 128:
            out.append(data[i + 1 : i + 2 + n])
            i += n + 2
        elif n > 128:
            out.append(data[i + 1 : i + 2] * (257 - n))
            i += 2
        else:
            i += 1
    return b"".join(out)


def packbits_encode(data: bytes) -> bytes:
    out, i, literal = bytearray(), 0, bytearray()

    def flush():
        for k in range(0, len(literal), 128):
            part = literal[k : k + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    while i < len(data):
        run = 1
        while run < 128 and i + run < len(data) and data[i + run] == data[i]:
            run += 1
        if run >= 3:
            flush()
            out.extend((257 - run, data[i]))
        else:
            literal.extend(data[i : i + run])
        i += run
    flush()
    return bytes(out)


#: Codes of 9 to 12 bits; a code gets longer one entry before the table needs it, as the format has it.
LZW_CLEAR, LZW_END, LZW_FIRST, LZW_LAST = 256, 257, 258, 4093


def _lzw_bits(entries: int) -> int:
    """Bits of the next code when the decoder's table has so many entries."""
    return min(12, max(9, (entries + 1).bit_length()))


def lzw_decode(data: bytes, most: int = MOST_SAMPLES) -> bytes:
    """Codes come with the most significant bit first."""
    stream = left = at = total = 0
    out: list[bytes] = []
    words: list[bytes] = []
    last = b""
    while True:
        size = _lzw_bits(len(words)) if words else 9
        while left < size:
            if at >= len(data):
                return b"".join(out)
            stream, left, at = (stream << 8 | data[at]) & 0xFFFFFF, left + 8, at + 1
        code = stream >> (left - size) & ((1 << size) - 1)
        left -= size
        if code == LZW_END:
            return b"".join(out)
        if code == LZW_CLEAR:
            words, last = [*(bytes((i,)) for i in range(256)), b"", b""], b""
            continue
        if code < len(words):
            word = words[code]
        elif code == len(words) and last:
            word = last + last[:1]
        else:
            raise ValueError("bad LZW code")
        out.append(word)
        total += len(word)
        if total >= most:
            return b"".join(out)
        if last:
            words.append(last + word[:1])
        last = word


def lzw_encode(data: bytes) -> bytes:
    out, stream, left = bytearray(), 0, 0
    table: dict[bytes, int] = {}
    entries = 0  # of the decoder's table when it reads the next code: one behind the encoder's

    def put(code, size):
        nonlocal stream, left
        stream, left = stream << size | code, left + size
        while left >= 8:
            out.append(stream >> (left - 8) & 255)
            left -= 8
        stream &= (1 << left) - 1

    put(LZW_CLEAR, 9)
    table, entries, word, first = {bytes((i,)): i for i in range(256)}, LZW_FIRST, b"", True
    for b in data:
        longer = word + bytes((b,))
        if longer in table:
            word = longer
            continue
        put(table[word], _lzw_bits(entries))
        entries += not first
        first = False
        table[longer] = len(table) + 2
        word = bytes((b,))
        if entries >= LZW_LAST - 1:
            put(table[word], _lzw_bits(entries))
            put(LZW_CLEAR, _lzw_bits(entries + 1))
            table, entries, word, first = {bytes((i,)): i for i in range(256)}, LZW_FIRST, b"", True
    if word:
        put(table[word], _lzw_bits(entries))
        entries += not first
    put(LZW_END, _lzw_bits(entries))
    if left:
        out.append(stream << (8 - left) & 255)
    return bytes(out)


def inflate(data: bytes, most: int = MOST_SAMPLES) -> bytes:
    return zlib.decompressobj().decompress(data, most)


#: Each takes the stored bytes and the most bytes that are wanted of them.
DECODERS = {NONE: lambda data, most: data[:most], LZW: lzw_decode, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: packbits_decode}
ENCODERS = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: packbits_encode}


# --- files ------------------------------------------------------------------------------------------------------


def _directory(order: str, fields: list[tuple[int, int, list[int]]], at: int, nxt: bool) -> bytes:
    """A directory that starts at `at`, with the values that don't fit into their fields behind it."""
    head, tail = [struct.pack(order + "H", len(fields))], b""
    after = at + 2 + 12 * len(fields) + 4
    for tag, kind, values in sorted(fields):
        code = {3: "H", 4: "I"}[kind]
        raw = struct.pack(order + code * len(values), *values)
        if len(raw) <= 4:
            raw = raw.ljust(4, b"\0")
        else:
            raw, tail = struct.pack(order + "I", after + len(tail)), tail + raw
        head.append(struct.pack(order + "HHI", tag, kind, len(values)) + raw)
    body = after + len(tail)
    return b"".join(head) + struct.pack(order + "I", body if nxt else 0) + tail


def write(pages: list[np.ndarray], *, compression: int = DEFLATE, predictor: bool = True, order: str = "<", strip_rows: int = STRIP_ROWS, tile: tuple[int, int] | None = None) -> bytes:
    """A file with a page for each array (height x width, or height x width x samples, of uint8)."""
    out = [struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 8)]
    size = 8
    for k, page in enumerate(pages):
        page = page[:, :, None] if page.ndim == 2 else page
        h, w, s = page.shape
        if tile:
            tw, th = tile
            padded = np.zeros((-(-h // th) * th, -(-w // tw) * tw, s), np.uint8)
            padded[:h, :w] = page
            parts = [padded[y : y + th, x : x + tw] for y in range(0, len(padded), th) for x in range(0, padded.shape[1], tw)]
        else:
            parts = [page[y : y + strip_rows] for y in range(0, h, strip_rows)]
        if predictor:
            parts = [np.concatenate([p[:, :1], p[:, 1:] - p[:, :-1]], axis=1) for p in parts]
        coded = [ENCODERS[compression](p.tobytes()) for p in parts]
        fields = [(TAG_WIDTH, 4, [w]), (TAG_LENGTH, 4, [h]), (TAG_BITS, 3, [8] * s), (TAG_COMPRESSION, 3, [compression]), (TAG_PHOTOMETRIC, 3, [1 if s == 1 else 2]), (TAG_SAMPLES, 3, [s]), (TAG_PLANAR, 3, [1]), (TAG_PREDICTOR, 3, [2 if predictor else 1])]
        zeros = [0] * len(coded)
        counts = [len(c) for c in coded]

        def laid(offsets, fields=fields, counts=counts):
            if tile:
                return [*fields, (TAG_TILE_WIDTH, 4, [tile[0]]), (TAG_TILE_LENGTH, 4, [tile[1]]), (TAG_TILE_OFFSETS, 4, offsets), (TAG_TILE_COUNTS, 4, counts)]
            return [*fields, (TAG_ROWS_PER_STRIP, 4, [strip_rows]), (TAG_STRIP_OFFSETS, 4, offsets), (TAG_STRIP_COUNTS, 4, counts)]

        ahead = len(_directory(order, laid(zeros), 0, False))
        offsets = [size + ahead + sum(counts[:i]) for i in range(len(counts))] if len(counts) < 64 else (size + ahead + np.concatenate([[0], np.cumsum(counts[:-1])])).tolist()
        body = sum(counts)
        directory = bytearray(_directory(order, laid(offsets), size, False))
        if k + 1 < len(pages):
            struct.pack_into(order + "I", directory, 2 + 12 * len(laid(zeros)), size + ahead + body + (ahead + body) % 2)
        out += [bytes(directory), *coded, b"\0" * ((ahead + body) % 2)]
        size += ahead + body + (ahead + body) % 2
    return b"".join(out)


def _fields(data: bytes, order: str, at: int) -> tuple[dict[int, list[int]], int]:
    n = struct.unpack_from(order + "H", data, at)[0]
    found = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        code = {1: "B", 3: "H", 4: "I"}.get(kind)
        if code is None:
            continue
        where = at + 2 + 12 * i + 8
        if FIELD_SIZES[kind] * count > 4:
            where = struct.unpack_from(order + "I", data, where)[0]
        if where + FIELD_SIZES[kind] * count > len(data):
            raise ValueError(f"field {tag} ends outside the file")
        found[tag] = list(struct.unpack_from(order + code * count, data, where))
    return found, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def pages(data: bytes) -> Iterator[Page]:
    """The pages of a file, one at a time."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen, number = struct.unpack_from(order + "I", data, 4)[0], set(), 0
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        f, at = _fields(data, order, at)
        w, h, s = f[TAG_WIDTH][0], f[TAG_LENGTH][0], f.get(TAG_SAMPLES, [1])[0]
        compression = f.get(TAG_COMPRESSION, [NONE])[0]
        if set(f.get(TAG_BITS, [1])) != {8} or f.get(TAG_PLANAR, [1])[0] != 1:
            raise ValueError("only 8-bit samples, pixel by pixel, are read")
        if compression not in DECODERS:
            raise ValueError(f"unknown compression {compression}")
        predictor = f.get(TAG_PREDICTOR, [1])[0] == 2
        if h * w * s > MOST_SAMPLES or any(v[0] * u[0] * s > MOST_SAMPLES for u, v in [(f.get(TAG_TILE_WIDTH, [1]), f.get(TAG_TILE_LENGTH, [1]))]):
            raise ValueError("too many samples on a page")
        if TAG_TILE_OFFSETS in f:
            tw, th = f[TAG_TILE_WIDTH][0], f[TAG_TILE_LENGTH][0]
            spots = [(y, x, th, tw) for y in range(0, h, th) for x in range(0, w, tw)]
            stored = zip(f[TAG_TILE_OFFSETS], f[TAG_TILE_COUNTS], spots, strict=True)
        else:
            rows = min(f.get(TAG_ROWS_PER_STRIP, [h])[0], h) or 1
            spots = [(y, 0, min(rows, h - y), w) for y in range(0, h, rows)]
            stored = zip(f[TAG_STRIP_OFFSETS], f[TAG_STRIP_COUNTS], spots, strict=True)
        samples = np.empty((h, w, s), np.uint8)
        for start, count, (y, x, ph, pw) in stored:
            raw = DECODERS[compression](data[start : start + count], ph * pw * s)
            part = np.frombuffer(raw, np.uint8, ph * pw * s).reshape(ph, pw, s)
            if predictor:
                part = np.cumsum(part, axis=1, dtype=np.uint8)
            samples[y : y + ph, x : x + pw] = part[: h - y, : w - x]
        yield Page(number, w, h, s, compression, samples)
        number += 1


def payload_pages(payload: bytes) -> list[np.ndarray]:
    """A payload, a multiple of WIDTH bytes long, as grey pages."""
    grid = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return [grid[y : y + PAGE_ROWS] for y in range(0, len(grid), PAGE_ROWS)]


#: Ways to store a payload: compression, and the size of the tiles or none.
FORMS = [(c, t) for c in (DEFLATE, LZW, PACKBITS, NONE) for t in (None, (32, 64))]


def stored(payload: bytes) -> bytes:
    """The file of a payload; its form follows from the payload's checksum."""
    compression, tile = FORMS[zlib.crc32(payload) % len(FORMS)]
    return write(payload_pages(payload), compression=compression, tile=tile)


def pad(raw: bytes) -> bytes:
    return raw + b"\0" * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


# --- columns ----------------------------------------------------------------------------------------------------

PAGE_SCHEMA = "page int, width int, height int, samples_per_pixel int, compression int, samples binary, error string"


def encode(df: DataFrame, text_col: str = "text", media_col: str = "media", *, keep_text: bool = True) -> DataFrame:
    """df with a column of TIFF files that hold the texts as UTF-8, padded with zeros (null: the empty text)."""

    def make(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([stored(pad((t or "").encode())) for t in texts.to_pylist()], pa.binary())]

    return with_made(df, text_col, make, [(media_col, "binary")], keep_used=keep_text)


def read_pages(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, page, width, height, samples_per_pixel, compression, samples, error): a row for each page of each file."""

    def run(batches):
        for b in batches:
            for part in slices(b, "media", most_rows=1):
                for row in _rows(part.column("media")[0].as_py()):
                    yield pa.RecordBatch.from_pylist([{"id": part.column("id")[0].as_py()} | row], schema=schema)

    kind = dict(df.dtypes)[id_col]
    schema = pa.schema([("id", b_type(df, id_col)), ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples_per_pixel", pa.int32()), ("compression", pa.int32()), ("samples", pa.binary()), ("error", pa.string())])
    return df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, f"id {kind}, {PAGE_SCHEMA}")


def b_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


FAULTS = (ValueError, KeyError, IndexError, OverflowError, ZeroDivisionError, struct.error, zlib.error)


def _rows(data: bytes | None) -> Iterator[dict]:
    if not data:
        return
    try:
        for p in pages(data):
            yield {"page": p.number, "width": p.width, "height": p.height, "samples_per_pixel": p.samples_per_pixel, "compression": p.compression, "samples": p.samples.tobytes(), "error": None}
    except FAULTS as e:
        yield {"page": -1, "width": None, "height": None, "samples_per_pixel": None, "compression": None, "samples": None, "error": f"{type(e).__name__}: {e}"}


DIGESTS = [("payload_bytes", "bigint"), ("payload_sha256", "string"), ("tail_crc32", "bigint"), ("media_bytes", "bigint"), ("media_sha256", "string"), ("feature", "string")]


def _digest(data: bytes | None) -> tuple:
    if data is None:
        return (None,) * len(DIGESTS)
    whole, total, tail, n = hashlib.sha256(), 0, b"", 0
    counts = np.zeros(256, np.int64)
    own = len(data), hashlib.sha256(data).hexdigest()
    try:
        for p in pages(data):
            raw = p.samples.tobytes()
            whole.update(raw)
            total, tail, n = total + len(raw), (tail + raw)[-WIDTH:], n + 1
            counts += np.bincount(p.samples.reshape(-1), minlength=256)
    except FAULTS as e:
        return None, None, None, *own, f"error: {type(e).__name__}: {e}"
    level = np.arange(256)
    mean = int((counts * level).sum() * 1000 // max(total, 1))
    square = int((counts * level * level).sum() * 1000 // max(total, 1))
    bins = ".".join(map(str, counts.reshape(16, 16).sum(axis=1)))
    return total, whole.hexdigest(), zlib.crc32(tail), *own, f"{n};{mean};{square};{bins}"


def digests(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", size_col: str = "n_bytes") -> DataFrame:
    """A row for each file: what its pages hold when they are read back, page by page, and a feature of the samples.

    feature: pages, mean and mean square of the samples, and a 16-bin histogram, all in whole numbers. A null file has nulls; of a
    file that can't be read only its own size and digest are there, and the feature says why.
    """

    def make(files: pa.Array) -> list[pa.Array]:
        out = [_digest(files[i].as_py()) for i in range(len(files))]
        kinds = {"bigint": pa.int64(), "string": pa.string()}
        return [pa.array([row[k] for row in out], kinds[kind]) for k, (_, kind) in enumerate(DIGESTS)]

    slim = df.select(F.col(id_col).alias("id"), F.col(size_col).cast("bigint").alias("n_bytes"), F.col(media_col).alias("media"))
    return with_made(slim, "media", make, DIGESTS, keep_used=False)
