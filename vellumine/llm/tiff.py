"""TIFF media columns: walk image directories, decode strips and tiles, one row per page.

Reads little- and big-endian files with no compression, PackBits, LZW or deflate, with the
horizontal or floating-point predictor, chunky or planar samples of 8, 16, 32 or 64 bits. Writes
multi-page 8-bit RGB files with which payloads are stored without loss.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.llm.arrow import bounded_batches, utf8

# Fixed values of the TIFF 6.0 specification and its supplements: tags and compression codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}

#: Bytes of samples that one page may claim unless a reader is given another bound (None: any): a broken file can't fill a worker.
MAX_PAGE = 1 << 30


class TiffError(ValueError):
    """The bytes are no TIFF file that this module reads."""


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    data: bytes  # rows from the top, samples interleaved, multi-byte samples little-endian


# --- codecs -------------------------------------------------------------------------------


def unpackbits(data: bytes, size: int) -> bytes:
    out, at, made = [], 0, 0
    while made < size and at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += n + 2
            made += n + 1
        elif n > 128:
            out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2
            made += 257 - n
        else:
            at += 1
    return b"".join(out)[:size]


_RUNS = re.compile(rb"(.)\1{2,127}", re.DOTALL)


@functools.lru_cache(maxsize=512)  # padding repeats the same rows
def packbits(row: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(begin: int, end: int) -> None:
        for i in range(begin, end, 128):
            part = row[i : min(i + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for run in _RUNS.finditer(row):
        literal(at, run.start())
        out.append(257 - (run.end() - run.start()))
        out.append(row[run.start()])
        at = run.end()
    literal(at, len(row))
    return bytes(out)


def _widths(n: int) -> np.ndarray:
    """Bits of the first ``n`` codes behind a clear code: 9 to 12, growing one code before the table needs it."""
    i = np.arange(n) + 258
    return 9 + (i >= 512) + (i >= 1024) + (i >= 2048)


#: Codes behind a clear code after which a writer clears the table again, and codes that a reader takes up at a time.
_FULL, _SOME = 3836, 4096
_WIDTHS = _widths(_SOME)
_STARTS = np.cumsum(_WIDTHS) - _WIDTHS


def _codes(padded: np.ndarray, bits: int, at: int) -> tuple[np.ndarray, int]:
    """The codes from bit ``at`` up to the next clear or end code, or the data's end, and the bit behind them."""
    n = (bits - at) // 9
    for most in (min(n, _SOME), n):
        widths, starts = (_WIDTHS[:most], _STARTS[:most]) if most <= _SOME else ((w := _widths(most)), np.cumsum(w) - w)
        place = at + starts
        inside = int(np.searchsorted(place + widths, bits, "right"))
        place, widths = place[:inside], widths[:inside]
        byte = place >> 3
        word = (padded[byte] << 16) | (padded[byte + 1] << 8) | padded[byte + 2]
        codes = (word >> (24 - (place & 7) - widths)) & ((1 << widths) - 1)
        stop = np.flatnonzero((codes == 256) | (codes == 257))
        if len(stop):
            end = int(stop[0])
            return codes[: end + 1], int(place[end] + widths[end])
        if inside < most or most == n:
            break
    return codes, bits


def unlzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, high bits first."""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    padded = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    out: list[bytes] = []
    made = at = 0
    while made < size and at + 9 <= 8 * len(data):
        found, at = _codes(padded, 8 * len(data), at)
        codes = found.tolist()
        last = codes.pop() if codes and codes[-1] in (256, 257) else None
        if codes:
            if codes[0] > 255:
                raise TiffError("LZW: a code before its entry")
            table = list(base)
            held = base[codes[0]]
            run, add = [held], table.append
            for code in codes[1:]:
                try:
                    entry = table[code]
                    add(held + entry[:1])
                except IndexError:
                    if code != len(table):
                        raise TiffError("LZW: a code before its entry") from None
                    entry = held + held[:1]
                    add(entry)
                run.append(entry)
                held = entry
            text = b"".join(run)
            out.append(text)
            made += len(text)
        if last == 257:
            break
    return b"".join(out)[:size]


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; the table is cleared when it is full."""
    codes, widths = [256], [np.array([9])]
    table: dict[int, int] = {}
    find, add = table.get, codes.append
    held, size, after = -1, 258, len(codes)  # ``after``: codes up to the last clear code
    for byte in data:
        if held < 0:
            held = byte
            continue
        key = held << 8 | byte
        known = find(key)
        if known is not None:
            held = known
            continue
        add(held)
        table[key] = size
        size += 1
        held = byte
        if size == 258 + _FULL:
            widths += [_WIDTHS[: len(codes) - after], np.array([12])]
            add(256)
            table.clear()
            size, after = 258, len(codes)
    if held >= 0:
        add(held)
    add(257)
    widths.append(_WIDTHS[: len(codes) - after])
    values, sizes = np.array(codes), np.concatenate(widths)
    bit = np.arange(11, -1, -1)
    return np.packbits(((values[:, None] >> bit) & 1).astype(np.uint8)[bit < sizes[:, None]]).tobytes()


def _inflate(data: bytes, size: int) -> bytes:
    try:
        return zlib.decompressobj().decompress(data, size)
    except zlib.error as why:
        raise TiffError(f"deflate: {why}") from why


_DECODERS: dict[int, Callable[[bytes, int], bytes]] = {
    NONE: lambda data, size: data[:size],
    PACKBITS: unpackbits,
    LZW: unlzw,
    DEFLATE: _inflate,
    OLD_DEFLATE: _inflate,
}


def _undo(rows: np.ndarray, predictor: int, samples: int, size: int, order: str) -> np.ndarray:
    """rows: bytes as (height, row bytes). Returns samples little-endian as (height, row bytes)."""
    height = rows.shape[0]
    if predictor == 3:
        planes = np.cumsum(rows.reshape(height, -1, samples), axis=1, dtype=np.uint8).reshape(height, size, -1)
        return np.ascontiguousarray(planes[:, ::-1, :].transpose(0, 2, 1)).reshape(height, -1)
    values = rows.view(f"{order}u{size}") if size > 1 else rows
    if predictor == 2:
        values = np.cumsum(values.reshape(height, -1, samples), axis=1, dtype=values.dtype.newbyteorder("="))
    return np.ascontiguousarray(values.astype(f"<u{size}")).reshape(height, -1).view(np.uint8)


def _packed_rows(rows: np.ndarray) -> bytes:
    """PackBits of each row by itself; rows without a run of three bytes are all literal."""
    same = rows[:, 1:] == rows[:, :-1]
    runs = (same[:, 1:] & same[:, :-1]).any(axis=1)
    width = rows.shape[1]
    out = []
    for row, run in zip(rows, runs.tolist(), strict=True):
        data = row.tobytes()
        out.append(packbits(data) if run else b"".join(bytes([min(width - i, 128) - 1]) + data[i : i + 128] for i in range(0, width, 128)))
    return b"".join(out)


# --- reading ------------------------------------------------------------------------------


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    if at + 2 > len(data):
        raise TiffError("a directory beyond the end")
    (n,) = struct.unpack_from(f"{order}H", data, at)
    if at + 6 + 12 * n > len(data):
        raise TiffError("a directory beyond the end")
    fields = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * i)
        size = FIELD_SIZES.get(kind, 0) * count
        place = at + 10 + 12 * i
        if size > 4:
            (place,) = struct.unpack_from(f"{order}I", data, place)
        code = {1: "B", 3: "H", 4: "I"}.get(kind)
        if code and place + size <= len(data):
            fields[tag] = struct.unpack_from(f"{order}{count}{code}", data, place)
    return fields, struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]


def read_pages(data: bytes, most: int | None = MAX_PAGE, broken: Callable[[int, str], None] | None = None) -> Iterator[Page]:
    """The pages of a file, in order, one at a time.

    A page that can't be read, or claims more than ``most`` bytes of samples, is reported to ``broken`` with its
    number and the reason, and the walk goes on to the next directory; without ``broken`` it raises TiffError. A file
    without a header, and a directory beyond the end or met before, always raise: nothing stands behind them.
    """
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise TiffError("no TIFF header")
    (at,) = struct.unpack_from(f"{order}I", data, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise TiffError("directories in a circle")
        seen.add(at)
        fields, then = _directory(data, at, order)
        try:
            page = _page(data, fields, len(seen) - 1, order, most)
        except TiffError as why:
            if broken is None:
                raise
            broken(len(seen) - 1, str(why))
        else:
            yield page
        at = then


def _page(data: bytes, fields: dict[int, tuple], number: int, order: str, most: int | None) -> Page:
    one = lambda tag, default=0: (fields.get(tag) or (default,))[0]
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    bits, compression, predictor = one(BITS, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
    size = bits // 8
    if bits not in (8, 16, 32, 64) or set(fields.get(BITS, ())) - {bits}:
        raise TiffError(f"samples of {fields.get(BITS)} bits")
    if compression not in _DECODERS or predictor not in (1, 2, 3):
        raise TiffError(f"compression {compression}, predictor {predictor}")
    whole = width * height * samples * size
    if whole <= 0 or (most is not None and whole > most):
        raise TiffError(f"a page of {width} x {height} x {samples}")
    planes = samples if one(PLANAR, 1) == 2 else 1
    inner = samples // planes
    tiled = TILE_OFFSETS in fields
    across, down = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    if not across or not down or (most is not None and across * down * inner * size > max(most, whole)):
        raise TiffError("strips or tiles of no size, or too large")
    offsets = fields.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, ())
    counts = fields.get(TILE_COUNTS if tiled else STRIP_COUNTS, ())
    wide, high = -(-width // across), -(-height // down)
    if len(offsets) < wide * high * planes or len(counts) < wide * high * planes:
        raise TiffError("strips or tiles are missing")
    image = np.zeros((height, width, samples, size), dtype=np.uint8)
    for k in range(wide * high * planes):
        plane, (y, x) = k // (wide * high), divmod(k % (wide * high), wide)
        rows = down if tiled else min(down, height - y * down)
        need = rows * across * inner * size
        raw = _DECODERS[compression](data[offsets[k] : offsets[k] + counts[k]], need)
        if len(raw) < need:
            raise TiffError("a strip or tile is short")
        part = _undo(np.frombuffer(raw, np.uint8).reshape(rows, -1), predictor, inner, size, order).reshape(rows, across, inner, size)
        y, x = y * down, x * across
        image[y : y + rows, x : x + across, plane * inner : (plane + 1) * inner] = part[: height - y, : width - x]
    return Page(number, width, height, samples, bits, compression, predictor, image.tobytes())


# --- writing ------------------------------------------------------------------------------

#: Stored payloads: RGB rows of 192 pixels, pages of at most 64 rows, strips of 16 rows, tiles of 64 x 16.
ROW = 576
PAGE_ROWS, STRIP_ROWS, TILE = 64, 16, (64, 16)
#: The forms of pages, in turn.
FORMS = (("strips", DEFLATE, 2), ("tiles", PACKBITS, 1), ("strips", LZW, 2))


def _chunk(part: np.ndarray, compression: int, predictor: int) -> bytes:
    """part: (rows, width, 3)."""
    if predictor == 2:
        part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
    if compression == PACKBITS:
        return _packed_rows(np.ascontiguousarray(part).reshape(len(part), -1))
    raw = part.tobytes()
    return {NONE: lambda: raw, DEFLATE: lambda: zlib.compress(raw, 1), LZW: lambda: lzw(raw)}[compression]()


def _heights(rows: int, least: int) -> list[int]:
    """Rows of each page: as equal as can be, at most PAGE_ROWS, and ``least`` pages where there are as many rows."""
    n = max(-(-rows // PAGE_ROWS), min(least, rows))
    return [rows // n + (k < rows % n) for k in range(n)]


def write_payload(payload: bytes, forms: tuple = FORMS) -> bytes:
    """Store a payload, a positive multiple of 576 bytes, as pages of 8-bit RGB samples.

    Pages take the ``forms`` in turn, and a payload of at least as many rows as there are forms has a page of each; which
    form comes first hangs on the payload, so that short ones are spread over the forms too.
    """
    if not payload or len(payload) % ROW:
        raise ValueError(f"{len(payload)} bytes are no positive multiple of {ROW}")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW // 3, 3)
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    first, top = zlib.crc32(payload), 0
    for k, height in enumerate(_heights(len(rows), len(forms))):
        image = rows[top : top + height]
        top += height
        layout, compression, predictor = forms[(first + k) % len(forms)]
        width = image.shape[1]
        if layout == "tiles":
            padded = np.zeros((-(-height // TILE[1]) * TILE[1], width, 3), np.uint8)
            padded[:height] = image
            parts = [padded[y : y + TILE[1], x : x + TILE[0]] for y in range(0, len(padded), TILE[1]) for x in range(0, width, TILE[0])]
            tags = {TILE_WIDTH: [TILE[0]], TILE_HEIGHT: [TILE[1]]}
        else:
            parts = [image[y : y + STRIP_ROWS] for y in range(0, height, STRIP_ROWS)]
            tags = {ROWS_PER_STRIP: [STRIP_ROWS]}
        places, sizes = [], []
        for part in parts:
            data = _chunk(part, compression, predictor)
            places.append(len(out))
            sizes.append(len(data))
            out += data
        tags |= {WIDTH: [width], HEIGHT: [height], BITS: [8, 8, 8], COMPRESSION: [compression], PHOTOMETRIC: [2], SAMPLES: [3], PLANAR: [1], PREDICTOR: [predictor]}
        tags |= {TILE_OFFSETS: places, TILE_COUNTS: sizes} if layout == "tiles" else {STRIP_OFFSETS: places, STRIP_COUNTS: sizes}
        link = _write_directory(out, tags, link)
    return bytes(out)


def _write_directory(out: bytearray, tags: dict[int, list[int]], link: int) -> int:
    """Append a directory and point to it from ``link``; returns the place of the next link."""
    long = {STRIP_OFFSETS, STRIP_COUNTS, TILE_OFFSETS, TILE_COUNTS, WIDTH, HEIGHT}
    entries = b""
    for tag in sorted(tags):
        kind, code = (4, "I") if tag in long else (3, "H")
        value = struct.pack(f"<{len(tags[tag])}{code}", *tags[tag])
        if len(value) > 4:
            out += b"\0" * (len(out) % 2)
            value, at = struct.pack("<I", len(out)), value
            out += at
        entries += struct.pack("<HHI", tag, kind, len(tags[tag])) + value.ljust(4, b"\0")
    out += b"\0" * (len(out) % 2)
    struct.pack_into("<I", out, link, len(out))
    out += struct.pack("<H", len(tags)) + entries
    out += b"\0\0\0\0"
    return len(out) - 4


# --- DataFrames ---------------------------------------------------------------------------

_PAGE = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("page", "width", "height", "samples", "bits", "compression", "predictor")]
    + [T.StructField("pixels", T.BinaryType()), T.StructField("error", T.StringType())]
)
Fold = Callable[[Iterator[Page]], dict]


def pages(df: DataFrame, media: str = "media", fold: tuple[Fold, str] | None = None, most: int | None = MAX_PAGE) -> DataFrame:
    """One row per page of each TIFF file in the binary column ``media``.

    Other columns of ``df`` are repeated in front. The page's own columns are page (from 0),
    width, height, samples, bits, compression, predictor, pixels and error; columns of ``df`` of
    those names are replaced. A null or empty file has no page. A page that can't be read, or holds more than
    ``most`` bytes of samples (None: any), has a row with its number and ``error`` and nothing else, and
    the pages behind it are read; a file whose walk ends early has a last row with ``error`` and no number.

    ``fold``, a function from a file's pages to a dict and that dict's schema, gives one row
    per file instead, without handing pixels back to Spark, and the column ``error``: the first reason
    why a page of the file can't be read, whose other fold columns are then null. Map only.
    """
    bounded_batches(df.sparkSession)
    made = T.StructType([*T._parse_datatype_string(fold[1]).fields, T.StructField("error", T.StringType())]) if fold else _PAGE
    keep = [f for f in df.schema.fields if f.name != media and f.name not in made.names]
    schema = T.StructType(keep + made.fields)
    names, folder = [f.name for f in keep], fold[0] if fold else None
    arrow = _arrow(schema)
    blank = dict.fromkeys(made.names)

    def rows(data: bytes | None) -> Iterator[dict]:
        wrong: list[tuple[int | None, str]] = []
        found = read_pages(data, most, lambda number, why: wrong.append((number, why))) if data else iter(())
        if folder:
            try:
                row = folder(found) | {"error": None}
            except TiffError as why:
                wrong.append((None, str(why)))
            yield blank | {"error": wrong[0][1]} if wrong else row
            return
        try:
            for p in found:
                yield from (blank | {"page": number, "error": why} for number, why in wrong)
                wrong.clear()
                yield {"page": p.number, "width": p.width, "height": p.height, "samples": p.samples, "bits": p.bits, "compression": p.compression, "predictor": p.predictor, "pixels": p.data, "error": None}
        except TiffError as why:
            wrong.append((None, str(why)))
        yield from (blank | {"page": number, "error": why} for number, why in wrong)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others, files = batch.select(names), utf8(batch.column(media))
            taken: list[int] = []
            out: list[dict] = []
            held = 0
            for i, data in enumerate(files):
                for row in rows(data):
                    taken.append(i)
                    out.append(row)
                    held += len(row.get("pixels") or b"")
                    if held > 4 << 20:
                        yield _batch(others, taken, out, made.names, arrow)
                        taken, out, held = [], [], 0
            if out:
                yield _batch(others, taken, out, made.names, arrow)

    return df.select(*names, media).mapInArrow(read, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _batch(others: pa.RecordBatch, taken: list[int], out: list[dict], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    kept = others.take(pa.array(taken, pa.int32()))
    columns = [kept.column(i).cast(schema.field(i).type) for i in range(kept.num_columns)]
    columns += [pa.array([row[n] for row in out], schema.field(n).type) for n in names]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def stored(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``df`` without ``text``, with ``n_bytes`` (UTF-8, null: 0) and the text's payload as a TIFF file in ``media``.

    The payload is the text's bytes with bytes 255 up to a positive multiple of 576; null counts as empty, equal texts
    have equal files. Columns named ``n_bytes`` and ``media`` are replaced. Map only.
    """
    bounded_batches(df.sparkSession)
    keep = [f for f in df.schema.fields if f.name not in (text, media, "n_bytes")]
    schema = T.StructType([*keep, T.StructField("n_bytes", T.LongType()), T.StructField(media, T.BinaryType())])
    names, arrow = [f.name for f in keep], _arrow(schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, others = utf8(batch.column(text)), batch.select(names)
            for i in range(0, len(texts), 256):
                own = [t or b"" for t in texts[i : i + 256]]
                files = [write_payload(t + b"\xff" * (-len(t) % ROW or (0 if t else ROW))) for t in own]
                kept = others.slice(i, len(own))
                columns = [kept.column(k).cast(arrow.field(k).type) for k in range(kept.num_columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([len(t) for t in own], pa.int64()), pa.array(files, pa.binary())], schema=arrow)

    return df.select(*names, text).mapInArrow(write, schema)


def payload_digest(found: Iterator[Page]) -> dict:
    """Digest of the samples of all pages in order, with a short feature of the image.

    The feature has the number of pages, the size, the mean sample and the share of each of the
    four quarters of the sample range, in thousandths.
    """
    sha, crc, size, total = hashlib.sha256(), 0, 0, 0
    quarters = np.zeros(4, dtype=np.int64)
    number = width = height = 0
    tail = b""
    for page in found:
        values = np.frombuffer(page.data, np.uint8)
        sha.update(page.data)
        size += len(page.data)
        total += int(values.sum(dtype=np.int64))
        quarters += np.bincount(values >> 6, minlength=4)
        number, width, height = number + 1, page.width, height + page.height
        tail = (tail + page.data)[-32:]
    crc = zlib.crc32(tail)
    shares = "-".join(str(int(1000 * q // max(size, 1))) for q in quarters)
    return {"payload_bytes": size, "payload_sha256": sha.hexdigest(), "tail_crc32": crc, "feature": f"p{number}w{width}h{height}m{total // max(size, 1)}q{shares}"}


DIGEST_SCHEMA = "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"


def stored_digests(df: DataFrame) -> DataFrame:
    """Store each text as TIFF, read the stored bytes back, and digest what was read."""
    files = stored(df)
    files = files.withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    return pages(files, fold=(payload_digest, DIGEST_SCHEMA))
