"""Media columns: baseline JPEG with luminance thumbnails from DC coefficients."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .repeats import text_bytes
from .tables import documents, stage

#: Blocks in a row of an image: the payload's unit.
ACROSS = 192
#: Rows of blocks that fit into one image (65,535 lines at most).
DOWN = 8191
#: Quantizer of the DC coefficient: one step of it is one grey level of the block.
STEP = 8

# Fixed values of the format (ITU-T T.81): the order of coefficients in a quantization table does
# not matter here, since all entries are equal.
_DQT = b"\xff\xdb" + (67).to_bytes(2, "big") + b"\x00" + bytes([STEP] * 64)


def _dht(kind: int, lengths: list[int], symbols: list[int]) -> bytes:
    return b"\xff\xc4" + (19 + len(symbols)).to_bytes(2, "big") + bytes([kind]) + bytes(lengths) + bytes(symbols)


# A DC difference of size class s gets a code of 9 - s bits and s more bits: 9 together. The only
# AC symbol is end-of-block, of one bit, so that every block takes 10 bits.
_TABLES = _dht(0x00, [1] * 9 + [0] * 7, list(range(8, -1, -1))) + _dht(0x10, [1] + [0] * 15, [0])


def _codes(lengths: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(length, code, symbol) of a Huffman table, by the canonical rule."""
    out, code, at = [], 0, 0
    for length, count in enumerate(lengths, 1):
        for _ in range(count):
            out.append((length, code, symbols[at]))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _encode_table() -> np.ndarray:
    """The 10 bits of a block by its DC difference + 255."""
    code = {s: c for _, c, s in _codes(bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1)))}
    table = np.zeros(511, np.uint64)
    for diff in range(-255, 256):
        s = abs(diff).bit_length()
        table[diff + 255] = ((code[s] << s) | (diff if diff > 0 else diff + (1 << s) - 1)) << 1
    return table


_BLOCK = _encode_table()


def encode_image(samples: np.ndarray) -> bytes:
    """A grey baseline JPEG, ACROSS blocks wide, whose block means are the given samples."""
    level = samples.astype(np.int16) - 128
    bits = _BLOCK[np.diff(level, prepend=np.int16(0)) + 255].reshape(-1, 4)
    packed = (bits[:, 0] << np.uint64(30)) | (bits[:, 1] << np.uint64(20)) | (bits[:, 2] << np.uint64(10)) | bits[:, 3]
    scan = packed.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().replace(b"\xff", b"\xff\x00")
    height = len(samples) // ACROSS * 8
    frame = b"\xff\xc0\x00\x0b\x08" + height.to_bytes(2, "big") + (ACROSS * 8).to_bytes(2, "big") + b"\x01\x01\x11\x00"
    return b"\xff\xd8" + _DQT + frame + _TABLES + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00" + scan + b"\xff\xd9"


def encode_payload(payload: np.ndarray) -> bytes:
    """One image, or several one after another if the payload needs more lines than an image has."""
    return b"".join(encode_image(payload[at : at + ACROSS * DOWN]) for at in range(0, len(payload), ACROSS * DOWN))


@dataclass
class Image:
    width: int = 0
    height: int = 0
    #: (id, horizontal, vertical sampling, quantization table)
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)
    quant: dict[int, int] = field(default_factory=dict)
    huffman: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)
    restart: int = 0
    thumbnail: np.ndarray | None = None


def _uniform(image: Image, dc: int, ac: int) -> int:
    """Bits of every block, if the tables give each the same number; else 0."""
    sizes = {n + s for n, _, s in image.huffman[dc]}
    end = image.huffman[0x10 | ac]
    if len(image.parts) == 1 and not image.restart and len(sizes) == 1 and [s for _, _, s in end] == [0]:
        return sizes.pop() + end[0][0]
    return 0


def _value(bits: int, size: int) -> int:
    return bits if size == 0 or bits >> (size - 1) else bits - (1 << size) + 1


def _uniform_scan(scan: bytes, image: Image, dc: int, bits: int, blocks: int) -> np.ndarray:
    """DC coefficients where each block has the same number of bits: a table look-up for all at once."""
    data = np.frombuffer(scan.replace(b"\xff\x00", b"\xff"), np.uint8)
    if bits == 10 and blocks % 4 == 0:
        wide = np.zeros((blocks // 4, 8), np.uint8)
        wide[:, 3:] = data[: blocks // 4 * 5].reshape(-1, 5)
        packed = wide.reshape(-1).view(">u8").astype(np.uint64)
        words = np.stack([(packed >> np.uint64(s)) & np.uint64(1023) for s in (30, 20, 10, 0)], axis=1).ravel().astype(np.int64)
    else:
        flat = np.unpackbits(data)[: blocks * bits].reshape(blocks, bits)
        words = flat @ (1 << np.arange(bits - 1, -1, -1))
    table = np.zeros(1 << bits, np.int64)
    for length, code, size in image.huffman[dc]:
        rest = bits - length - size
        for extra in range(1 << size):
            at = ((code << size) | extra) << rest
            table[at : at + (1 << rest)] = _value(extra, size)
    return np.cumsum(table[words])


def _general_scan(scan: bytes, image: Image, using: dict[int, tuple[int, int]]) -> list[np.ndarray]:
    """DC coefficients of each component of an interleaved or single-component scan, block by block."""
    look = {k: {(n, c): s for n, c, s in codes} for k, codes in image.huffman.items()}
    data, at, have, count = scan, 0, 0, 0

    def take(n: int) -> int:
        nonlocal at, have, count
        while count < n:
            byte = data[at] if at < len(data) else 0xFF
            at += 2 if byte == 0xFF and at + 1 < len(data) and data[at + 1] == 0 else 1
            have, count = (have << 8) | byte, count + 8
        count -= n
        value = (have >> count) & ((1 << n) - 1)
        have &= (1 << count) - 1
        return value

    def symbol(table: int) -> int:
        code = length = 0
        while (length, code) not in look[table]:
            code, length = (code << 1) | take(1), length + 1
            if length > 16:
                raise ValueError("no such Huffman code")
        return look[table][(length, code)]

    parts = [p for p in image.parts if p[0] in using]
    top_h, top_v = max(p[1] for p in image.parts), max(p[2] for p in image.parts)
    if len(parts) == 1:
        _, h, v, _ = parts[0]
        across, down = -(-image.width * h // (8 * top_h)), -(-image.height * v // (8 * top_v))
        shapes, units = [(1, 1)], (across, down)
    else:
        shapes, units = [(p[1], p[2]) for p in parts], (-(-image.width // (8 * top_h)), -(-image.height // (8 * top_v)))
    grids = [np.zeros((units[1] * v, units[0] * h), np.int64) for h, v in shapes]
    before = [0] * len(parts)
    for unit in range(units[0] * units[1]):
        if image.restart and unit and unit % image.restart == 0:
            have = count = 0
            while not (data[at] == 0xFF and 0xD0 <= data[at + 1] <= 0xD7):
                at += 1
            at, before = at + 2, [0] * len(parts)
        y, x = divmod(unit, units[0])
        for k, (part, (h, v)) in enumerate(zip(parts, shapes)):
            dc, ac = using[part[0]]
            for b in range(h * v):
                size = symbol(dc)
                before[k] += _value(take(size), size)
                grids[k][y * v + b // h, x * h + b % h] = before[k]
                place = 1
                while place < 64:
                    run = symbol(0x10 | ac)
                    if run == 0:
                        break
                    place += (run >> 4) + 1
                    take(run & 15)
    return grids


def decode_images(media: bytes) -> list[Image]:
    """The baseline JPEGs in ``media``: dimensions and the DC-only luminance thumbnail of each."""
    images: list[Image] = []
    at = 0
    while at < len(media):
        if media[at : at + 2] != b"\xff\xd8":
            raise ValueError("no image starts here")
        image, at = Image(), at + 2
        while (marker := media[at + 1]) != 0xD9:
            length = int.from_bytes(media[at + 2 : at + 4], "big")
            body, at = media[at + 4 : at + 2 + length], at + 2 + length
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    image.quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    image.huffman[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                image.restart = int.from_bytes(body, "big")
            elif marker == 0xC0:
                image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                image.parts = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, len(body), 3)]
            elif 0xC1 <= marker <= 0xCF and marker != 0xCC:
                raise ValueError("only baseline images are read")
            elif marker == 0xDA:
                using = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
                end = at
                while True:
                    end = media.index(b"\xff", end)
                    if media[end + 1] == 0 or 0xD0 <= media[end + 1] <= 0xD7:
                        end += 2
                        continue
                    break
                light = image.parts[0]
                if light[0] in using:
                    image.thumbnail = _thumbnail(media[at:end], image, using)
                at = end
        images.append(image)
        at += 2
    return images


def _thumbnail(scan: bytes, image: Image, using: dict[int, tuple[int, int]]) -> np.ndarray:
    dc, ac = using[image.parts[0][0]]
    across, down = -(-image.width // 8), -(-image.height // 8)
    if bits := _uniform(image, dc, ac):
        grid = _uniform_scan(scan, image, dc, bits, across * down).reshape(down, across)
    else:
        grids = _general_scan(scan, image, using)
        top_h, top_v = max(p[1] for p in image.parts), max(p[2] for p in image.parts)
        _, h, v, _ = image.parts[0]
        grid = grids[0][: -(-image.height * v // (8 * top_v)), : -(-image.width * h // (8 * top_h))]
    return np.clip(grid * image.quant[image.parts[0][3]] // 8 + 128, 0, 255).astype(np.uint8)


def thumbnail_hash(thumbnail: np.ndarray) -> str:
    """64 bits: whether the mean grey rises from one of nine columns to the next, in eight bands."""
    down, across = thumbnail.shape
    columns = np.add.reduceat(thumbnail.astype(np.int64), np.arange(9) * across // 9, axis=1) if across >= 9 else thumbnail[:, np.arange(9) * across // 9].astype(np.int64)
    rows = np.arange(8) * down // 8
    means = np.add.reduceat(columns, rows, axis=0) if down >= 8 else columns[rows]
    widths = np.diff(np.append(np.arange(9) * across // 9, across)).clip(1) if across >= 9 else np.ones(9, np.int64)
    rising = means[:, 1:] * widths[:-1] > means[:, :-1] * widths[1:]
    return np.packbits(rising.ravel()).tobytes().hex()


def with_media(docs: DataFrame) -> DataFrame:
    """Columns doc_id, n_bytes, media: each whole text as JPEG.

    The UTF-8 bytes (null: none), padded by spaces to a positive multiple of
    ACROSS, are the grey levels of 8 x 8 blocks, row by row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                data, offsets = text_bytes(part.column("text"))
                sizes = np.diff(offsets)
                media = []
                for a, n in zip(offsets[:-1], sizes):
                    payload = np.full(max(1, -(-int(n) // ACROSS)) * ACROSS, 32, np.uint8)
                    payload[:n] = data[a : a + n]
                    media.append(encode_payload(payload))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def media_features(table: DataFrame) -> DataFrame:
    """What the stored images say: the payload read back, checksums, and ``feature`` (dimensions and thumbnail hash of each image)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column("media"):
                media = value.as_py()
                images = decode_images(media)
                payload = b"".join(i.thumbnail.tobytes() for i in images)
                feature = ",".join(f"{i.width}x{i.height}:{thumbnail_hash(i.thumbnail)}" for i in images)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", "n_bytes", *names]
            )

    kind = table.schema["doc_id"].dataType.simpleString()
    return table.mapInArrow(
        run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``media_features`` of the table that ``with_media`` of documents is written to; edge cases as there."""
    return media_features(stage(with_media(documents(spark, sf_dir)), "media"))
