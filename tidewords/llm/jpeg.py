"""Baseline JPEG media columns: a lossless payload in quantised coefficients, a parser, and DC-only thumbnails.

The Huffman decoder works on many scans at once: every restart interval of every image of a batch is a lane,
and each step decodes one symbol of all lanes with table lookups.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewords.llm.common import batches, by_document, read, record, slices, utf8

BLOCK = 64
ENCODE_BYTES, DECODE_BYTES, LANES = 4 << 20, 6 << 20, 1 << 15
_SOI, _EOI = b"\xff\xd8", b"\xff\xd9"
#: One bit for a coefficient of eight bits, two for zero differences and ends of blocks.
_DC, _AC = (bytes([1, 1] + [0] * 14), bytes([0x08, 0x00])), (bytes([1, 1] + [0] * 14), bytes([0x08, 0x00]))
_QUANT = bytes([4] + [1] * 63)
_EMPTY = b"\xaf"  # a block of zeros: both two-bit codes, padded with ones


class NotBaseline(ValueError):
    """The bytes are not a JPEG that this module reads."""


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def grid(blocks: int) -> tuple[int, int]:
    """Columns and rows of a nearly square grid that holds so many blocks."""
    columns = max(1, int(np.ceil(np.sqrt(blocks))))
    return columns, -(-blocks // columns)


def _header(n_bytes: int, columns: int, rows: int) -> bytes:
    return b"".join(
        (
            _SOI,
            _segment(0xFE, b"bytes=%d" % n_bytes),
            _segment(0xDB, b"\0" + _QUANT),
            _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * rows, 8 * columns, 1, 1, 0x11, 0)),
            _segment(0xC4, b"\x00" + _DC[0] + _DC[1]),
            _segment(0xC4, b"\x10" + _AC[0] + _AC[1]),
            _segment(0xDD, struct.pack(">H", 1)),
            _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        )
    )


def encode_payloads(raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A grey baseline JPEG for each of the byte strings that lie end to end.

    A string is padded with zeros to a positive multiple of 64. Its bytes become the quantised coefficients of
    8x8 blocks in zigzag order, each with eight significant bits (0-127 stand for -255 to -128), so any decoder
    that keeps coefficients gets them back. Blocks are restart intervals of their own; the grid's last blocks
    may be empty; a comment holds the unpadded length.
    """
    lens = np.diff(offsets)
    blocks = np.maximum(1, -(-lens // BLOCK))
    if len(lens) == 1:  # a long text goes part by part
        step = ENCODE_BYTES // BLOCK
        bodies = [_body(raw[k * BLOCK : (k + step) * BLOCK], np.zeros(1, np.int64), min(step, int(blocks[0]) - k), np.arange(k, min(k + step, int(blocks[0]))))[0] for k in range(0, int(blocks[0]), step)]
        return [_image(int(lens[0]), int(blocks[0]), b"".join(bodies))]
    ends = np.cumsum(blocks)
    firsts = ends - blocks
    total = int(ends[-1]) if len(ends) else 0
    flat, stops = _body(raw, np.repeat(firsts * BLOCK - offsets[:-1], lens), total, np.arange(total) - np.repeat(firsts, blocks))
    places = zip(lens.tolist(), blocks.tolist(), firsts.tolist(), ends.tolist(), strict=True)
    return [_image(n, k, flat[int(stops[a - 1]) if a else 0 : int(stops[b - 1])]) for n, k, a, b in places]


def _body(raw: np.ndarray, shift: np.ndarray, blocks: int, number: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Coded blocks, each closed by the restart marker of its number, and where they end; bytes are moved by ``shift``."""
    payload = np.zeros(blocks * BLOCK, np.uint8)
    payload[np.arange(len(raw)) + shift] = raw
    bits = np.zeros((len(payload), 9), np.uint8)
    bits[:, 1:] = np.unpackbits(payload[:, None], axis=1)
    rows = np.empty((blocks, 74), np.uint8)
    rows[:, :72] = np.packbits(bits.reshape(blocks, -1), axis=1)
    rows[:, 72], rows[:, 73] = 0xFF, 0xD0 + number % 8
    full = rows == 0xFF
    full[:, 72] = False
    return np.insert(rows.ravel(), np.flatnonzero(full) + 1, 0).tobytes(), np.cumsum(74 + full.sum(1))


def _image(n_bytes: int, blocks: int, body: bytes) -> bytes:
    columns, high = grid(blocks)
    rest = b"".join(_EMPTY + bytes([0xFF, 0xD0 + i % 8]) for i in range(blocks, columns * high))
    return _header(n_bytes, columns, high) + (body + rest)[:-2] + _EOI


@dataclass
class Frame:
    """What an image's markers say."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, bytes] = field(default_factory=dict)  # class and number: lengths and symbols
    interval: int = 0
    comment: bytes = b""
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component, DC and AC table
    start: int = 0  # of the entropy-coded bytes


def parse(image: bytes) -> Frame:
    """Markers up to the first scan that has the first component (the luminance)."""
    if image[:2] != _SOI:
        raise NotBaseline("no start marker")
    frame, at = Frame(), 2
    while True:
        at = image.find(b"\xff", at)
        if at < 0 or at + 4 > len(image):
            raise NotBaseline("no scan")
        marker = image[at + 1]
        if marker in (0, 0x01, 0xFF) or 0xD0 <= marker <= 0xD8:
            at += 1 if marker == 0xFF else 2
            continue
        size = int.from_bytes(image[at + 2 : at + 4])
        body = image[at + 4 : at + 2 + size]
        if marker == 0xD9 or size < 2 or len(body) != size - 2:
            raise NotBaseline("cut short")
        at += 2 + size
        try:
            if _read(frame, marker, body):
                frame.start = at
                return frame
        except (IndexError, struct.error) as e:
            raise NotBaseline("bad segment") from e


def _read(frame: Frame, marker: int, body: bytes) -> bool:
    if marker == 0xDB:
        while body:
            wide, number = body[0] >> 4, body[0] & 15
            n = 64 * (1 + wide)
            frame.quantisers[number] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
            body = body[1 + n :]
    elif marker == 0xC4:
        while body:
            n = 17 + sum(body[1:17])
            frame.tables[body[0]] = body[1:n]
            body = body[n:]
    elif marker in (0xC0, 0xC1):
        depth, frame.height, frame.width, n = struct.unpack(">BHHB", body[:6])
        if depth != 8 or not frame.height or not frame.width or not n:
            raise NotBaseline("not 8 bits deep")
        frame.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
    elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
        raise NotBaseline("not baseline")
    elif marker == 0xDD:
        frame.interval = int.from_bytes(body[:2])
    elif marker == 0xFE:
        frame.comment = body
    elif marker == 0xDA:
        ids = {c[0]: i for i, c in enumerate(frame.components)}
        frame.scan = [(ids.get(body[1 + 2 * i], -1), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
        if any(c < 0 or d not in frame.tables or a | 16 not in frame.tables for c, d, a in frame.scan):
            raise NotBaseline("scan without tables")
        return frame.scan[0][0] == 0
    return False


def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits ahead: code length << 8 | symbol; 0 where no code fits."""
    out, code, symbol = np.zeros(1 << 16, np.int32), 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            out[code << 16 - length : code + 1 << 16 - length] = length << 8 | table[symbol]
            code, symbol = code + 1, symbol + 1
        code <<= 1
    return out


@dataclass
class Decoded:
    frame: Frame | None
    error: str | None
    thumbnail: np.ndarray | None = None  # luminance means of blocks
    coefficients: np.ndarray | None = None  # of luminance blocks in scan order, zigzag inside


def decode(images: list[bytes], keep: bool = False) -> list[Decoded]:
    """DC-only luminance of each image, and with ``keep`` the luminance coefficients; errors are per image."""
    out: list[Decoded] = []
    for image in images:
        try:
            out.append(Decoded(parse(image), None))
        except NotBaseline as e:
            out.append(Decoded(None, str(e)))
    groups: dict[tuple, list[int]] = {}
    for i, d in enumerate(out):
        if d.frame:
            layout = [(c, d.frame.components[c][1:3]) for c, _, _ in d.frame.scan]
            groups.setdefault(tuple(layout), []).append(i)
    for layout, members in groups.items():
        _decode_alike([images[i] for i in members], [out[i] for i in members], layout, keep)
    return out


def _lanes(images: list[bytes], frames: list[Frame]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Entropy-coded bytes without stuffing and markers, and where each image's restart intervals start in them."""
    whole = np.frombuffer(b"".join(images) + b"\xff\xd9", np.uint8)
    begins = np.concatenate(([0], np.cumsum([len(i) for i in images])))
    full = np.flatnonzero(whole[:-1] == 0xFF)
    after = whole[full + 1]
    restart = (after >= 0xD0) & (after <= 0xD7)
    other = full[(after != 0) & (after != 0xFF) & ~restart]
    keep = np.zeros(len(whole) + 1, np.int8)
    starts = begins[:-1] + [f.start for f in frames]
    stops = np.minimum(other[np.minimum(np.searchsorted(other, starts), len(other) - 1)], begins[1:])
    np.add.at(keep, starts, 1)
    np.add.at(keep, stops, -1)
    keep = np.cumsum(keep[:-1], dtype=np.int8).astype(bool)
    keep[full[after == 0] + 1] = False
    keep[full[restart]] = keep[full[restart] + 1] = False
    gone = np.flatnonzero(~keep)
    at = lambda x: x - np.searchsorted(gone, x)
    marks = full[restart]
    a, b = np.searchsorted(marks, starts), np.searchsorted(marks, stops)
    return whole[keep], [np.concatenate(([at(s)], at(marks[x:y] + 2))) for s, x, y in zip(starts, a, b, strict=True)]


def _decode_alike(images: list[bytes], outs: list[Decoded], layout: tuple, keep: bool) -> None:
    """Images whose scans have the same components and sampling."""
    frames = [d.frame for d in outs]
    data, lanes = _lanes(images, frames)
    one = len(layout) == 1
    units = [(1, 1)] if one else [hv for _, hv in layout]
    order = [(c, y, x) for c, (h, v) in enumerate(units) for y in range(v) for x in range(h)]
    first, number, size, base, ids, owner = [], [], [], [], {}, []
    for i, (f, d) in enumerate(zip(frames, outs, strict=True)):
        h, v = f.components[layout[0][0]][1:3]
        h_max, v_max = max(c[1] for c in f.components), max(c[2] for c in f.components)
        across = (-(-f.width * h // (8 * h_max)), -(-f.height * v // (8 * v_max))) if one else (-(-f.width // (8 * h_max)), -(-f.height // (8 * v_max)))
        mcus = across[0] * across[1]
        per = f.interval or mcus
        need = -(-mcus // per)
        if len(lanes[i]) < need:
            d.error = "scan cut short"
            continue
        first.append(lanes[i][:need])
        number.append(np.minimum(per, mcus - per * np.arange(need)))
        size.append((i, need, across, per))
        base.append([(ids.setdefault(f.tables[dc], len(ids)), ids.setdefault(f.tables[16 | ac], len(ids))) for _, dc, ac in f.scan])
        owner.append(np.full(need, len(size) - 1))
    if not size:
        return
    lut = np.concatenate([_lookup(t) for t in ids])
    bit, n_mcu, who = np.concatenate(first) * 8, np.concatenate(number), np.concatenate(owner)
    tables = (np.array(base, np.int64) << 16)[who]
    lumas = sum(c == 0 for c, _, _ in order)
    at = np.concatenate(([0], np.cumsum(n_mcu * lumas)))
    dc = np.zeros(int(at[-1]), np.int32)
    coefficients = np.zeros((len(dc), 64), np.int16) if keep else None
    wrong = np.zeros(len(bit), bool)
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    window = np.ndarray((len(padded) - 8,), ">u8", padded, strides=(1,))
    for a in range(0, len(bit), LANES):
        some = np.arange(a, min(a + LANES, len(bit)))
        _decode_lanes(window, lut, bit, n_mcu, tables, some, order, at, lumas, dc, coefficients, wrong)
    lane_at = np.concatenate(([0], np.cumsum([s[1] for s in size])))
    for k, (i, need, across, per) in enumerate(size):
        d, part = outs[i], slice(int(at[lane_at[k]]), int(at[lane_at[k + 1]]))
        if wrong[lane_at[k] : lane_at[k + 1]].any():
            d.error = "bad code"
            continue
        h, v = units[0]
        q = d.frame.quantisers.get(d.frame.components[0][3])
        if q is None or len(q) != 64:
            d.error = "no quantiser"
            continue
        mean = np.clip(np.rint(128 + dc[part] * int(q[0]) / 8), 0, 255).astype(np.uint8)
        d.thumbnail = mean.reshape(across[1], across[0], v, h).swapaxes(1, 2).reshape(across[1] * v, across[0] * h)
        if keep:
            d.coefficients = coefficients[part]


def _decode_lanes(window, lut, bit, n_mcu, tables, some, order, at, lumas, dc, coefficients, wrong) -> None:
    limit = np.int64(len(window) - 1)
    position, left = bit[some], n_mcu[some]
    previous = np.zeros((len(some), 1 + max(c for c, _, _ in order)), np.int64)

    def symbols(p: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbol, signed value, next position and whether there was a code."""
        ahead = window[np.minimum(p >> 3, limit)].astype(np.uint64) << (p & 7).astype(np.uint64)
        entry = lut[table + (ahead >> np.uint64(48)).astype(np.int64)]
        length, symbol = entry >> 8, entry & 255
        size = symbol & 15
        extra = ((ahead << length.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        value = np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra)
        return symbol, value, p + length + size, entry == 0

    for mcu in range(int(left.max())):
        live = np.flatnonzero(mcu < left)
        luma = 0
        for c, _, _ in order:
            lanes, p = live, position[live]
            row = at[some[lanes]] + mcu * lumas + luma
            _, value, p, bad = symbols(p, tables[some[lanes], c, 0])
            wrong[some[lanes[bad]]] = True
            previous[lanes, c] += value
            if c == 0:
                dc[row] = previous[lanes, 0]
                if coefficients is not None:
                    coefficients[row, 0] = previous[lanes, 0]
            table, k = tables[some[lanes], c, 1], np.ones(len(lanes), np.int64)
            while len(lanes):
                symbol, value, p, bad = symbols(p, table)
                if bad.any():
                    wrong[some[lanes[bad]]] = True
                k = np.where((symbol == 0) | bad, 64, k + (symbol >> 4))
                put = (symbol & 15 > 0) & (k < 64)
                if c == 0 and coefficients is not None:
                    if put.all():
                        coefficients[row, k] = value
                    else:
                        coefficients[row[put], k[put]] = value[put]
                k += 1
                if (done := k >= 64).any():
                    position[lanes[done]] = p[done]
                    on = ~done
                    lanes, p, k, row, table = lanes[on], p[on], k[on], row[on], table[on]
            luma += c == 0


def average_hash(thumbnail: np.ndarray) -> int:
    """64 bits: which of 8x8 evenly spaced thumbnail points are above their mean."""
    rows, columns = (np.arange(8) * n // 8 for n in thumbnail.shape)
    points = thumbnail[rows[:, None], columns[None, :]].astype(np.int64)
    return int.from_bytes(np.packbits(points.ravel() * 64 > points.sum()).tobytes())


def payload(d: Decoded) -> tuple[int, bytes]:
    """The unpadded length and the padded payload that encode_payloads stored."""
    n = int(d.frame.comment.removeprefix(b"bytes="))
    size = BLOCK * max(1, -(-n // BLOCK))
    values = d.coefficients.reshape(-1)[:size]
    return n, np.where(values < 0, values + 255, values).astype(np.uint8).tobytes()


def _encode(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(source, ENCODE_BYTES):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(encode_payloads(*utf8(batch.column("text"))), pa.binary())], ["doc_id", "media"])


def to_jpeg(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each whole text as a JPEG; null counts as empty; an empty text is one block of zeros.

    Repeated rows and null ids stay, other columns go, an empty table gives no rows.
    """
    return docs.select("doc_id", "text").mapInArrow(_encode, by_document(docs, "media binary")[0])


def _media_batches(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in source:
        images = [m or b"" for m in batch.column("media").to_pylist()]
        offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, images), np.int64, len(images)))))
        for a, b in slices(offsets, DECODE_BYTES):
            yield batch.slice(a, b - a), images[a:b]


def jpeg_thumbnails(media: DataFrame) -> DataFrame:
    """(doc_id, width, height, components, thumbnail, thumbnail_hash, error) of a column ``media``.

    The thumbnail holds a byte of mean luminance for each 8x8 block, row by row. Null, empty and non-baseline
    media have an error and nulls. Repeated rows and null ids stay; an empty table gives no rows.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, images in _media_batches(source):
            got = decode(images)
            ok = [d if d.thumbnail is not None else None for d in got]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array([d and f(d.frame) for d in ok], pa.int32()) for f in (lambda f: f.width, lambda f: f.height, lambda f: len(f.components))),
                    pa.array([d and d.thumbnail.tobytes() for d in ok], pa.binary()),
                    pa.array([d and f"{average_hash(d.thumbnail):016x}" for d in ok], pa.string()),
                    pa.array([d.error for d in got], pa.string()),
                ],
                ["doc_id", "width", "height", "components", "thumbnail", "thumbnail_hash", "error"],
            )

    return media.select("doc_id", "media").mapInArrow(run, by_document(media, "width int, height int, components int, thumbnail binary, thumbnail_hash string, error string")[0])


def _read_back(schema: pa.Schema):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, images in _media_batches(source):
            rows = []
            for image, d in zip(images, decode(images, keep=True), strict=True):
                n, stored = payload(d)
                feature = f"{d.frame.width}x{d.frame.height}:{average_hash(d.thumbnail):016x}:{zlib.crc32(d.thumbnail.tobytes()):08x}"
                rows.append((n, len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-64:]), len(image), hashlib.sha256(image).hexdigest(), feature))
            yield record(schema, doc_id=batch.column("doc_id"), **dict(zip(schema.names[1:], zip(*rows, strict=True), strict=True)))

    return run


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as JPEG and read back; see ``to_jpeg`` for nulls, empty and long texts and repeated rows."""
    docs = read(spark, sf_dir, "documents")
    fields, schema = by_document(docs, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return to_jpeg(docs).mapInArrow(_read_back(schema), fields)
