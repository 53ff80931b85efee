"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized by integral images, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import append_columns, table

ROW = 192
WIDTH = ROW // 3


def decode(media: bytes) -> np.ndarray:
    """Height x width x channels, 8 bits a sample; ValueError for other formats and for images without pixels."""
    if media[:2] == b"BM":
        samples = decode_bmp(media)
    elif media[:1] == b"P" and media[1:2] in b"123456" and len(media) > 2:
        samples = decode_netpbm(media)
    else:
        raise ValueError("neither Netpbm nor BMP")
    if not samples.size:
        raise ValueError("an image without pixels")
    return samples


TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def decode_netpbm(media: bytes) -> np.ndarray:
    kind, at, head = media[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = TOKEN.match(media, at)
        if not m:
            raise ValueError("short Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    width, height, top = (*head, 1)[:3]
    if not 0 < top < 1 << 16:
        raise ValueError("samples of no size that is read")
    channels = 3 if kind in (3, 6) else 1
    n = width * height * channels
    if kind == 4:
        rows = np.frombuffer(media, np.uint8, height * ((width + 7) // 8), at + 1).reshape(height, -1)
        return ((1 - np.unpackbits(rows, axis=1)[:, :width]) * 255).astype(np.uint8)[..., None]
    if kind == 1:
        bits = re.sub(rb"#[^\n]*|\s", b"", media[at:])[:n]
        return ((49 - np.frombuffer(bits, np.uint8)) * 255).astype(np.uint8).reshape(height, width, 1)
    if kind in (2, 3):
        samples = np.array(re.sub(rb"#[^\n]*", b"", media[at:]).split()[:n], dtype=np.int64)
    else:
        samples = np.frombuffer(media, np.uint8 if top < 256 else ">u2", n, at + 1)
    if top != 255:
        samples = (samples.astype(np.int64) * 255 + top // 2) // top
    return samples.astype(np.uint8).reshape(height, width, channels)


def decode_bmp(media: bytes) -> np.ndarray:
    offset, = struct.unpack_from("<I", media, 10)
    head, width, height, _, depth, packed = struct.unpack_from("<IiiHHI", media, 14)
    if packed not in (0, 3) or depth not in (8, 16, 24, 32) or packed == 3 and depth not in (16, 32):
        raise ValueError("BMP of a kind that isn't read")
    stride = (width * depth // 8 + 3) // 4 * 4
    rows = np.frombuffer(media, np.uint8, stride * abs(height), offset).reshape(abs(height), stride)[:, : width * depth // 8]
    rows = rows[::-1] if height > 0 else rows
    if depth == 8:
        n = struct.unpack_from("<I", media, 46)[0] or 256
        palette = np.frombuffer(media, np.uint8, 4 * n, 14 + head).reshape(n, 4)
        return palette[rows][..., 2::-1].copy()
    if packed == 3 or depth == 16:
        masks = struct.unpack_from("<III", media, 54) if packed == 3 else (0x7C00, 0x3E0, 0x1F)
        return masked(np.ascontiguousarray(rows).view("<u2" if depth == 16 else "<u4").astype(np.int64), masks)
    return rows.reshape(abs(height), width, depth // 8)[..., 2::-1].copy()


def masked(pixels: np.ndarray, masks: tuple[int, int, int]) -> np.ndarray:
    """Red, green and blue as the masks' bits of each pixel say, to 8 bits; an empty mask is a channel of zeros."""
    out = np.zeros((*pixels.shape, 3), np.uint8)
    for k, mask in enumerate(masks):
        if mask:
            low = (mask & -mask).bit_length() - 1
            top = mask >> low
            out[..., k] = (((pixels & mask) >> low) * 255 + top // 2) // top
    return out


def encode_ppm(samples: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """24 bits, rows from the bottom up, each padded to a multiple of four bytes."""
    height, width, _ = samples.shape
    stride = (width * 3 + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = samples[::-1, :, ::-1].reshape(height, -1)
    size = 54 + rows.size
    return struct.pack("<2sIHHI", b"BM", size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def area_resize(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the target's cells, whose edges may cut a pixel: differences of the integral image, linear between its points."""
    h, w, c = samples.shape
    total = np.zeros((h + 1, w + 1, c))
    np.cumsum(np.cumsum(samples, 0, dtype=np.float64), 1, out=total[1:, 1:])

    def cut(values: np.ndarray, n: int, size: int) -> np.ndarray:
        at = np.arange(n + 1) * (size / n)
        low = np.minimum(at.astype(np.int64), size - 1)
        part = (at - low).reshape(-1, *[1] * (values.ndim - 1))
        return values[low] * (1 - part) + values[low + 1] * part

    rows = np.diff(cut(total, height, h), axis=0)
    cells = np.diff(cut(rows.transpose(1, 0, 2), width, w), axis=0).transpose(1, 0, 2)
    return cells / (h / height * w / width)


def difference_hash(samples: np.ndarray) -> str:
    """64 bits: whether brightness rises to the right in a 9 x 8 thumbnail; 16 hexadecimal digits."""
    gray = samples.astype(np.float64) @ np.array([0.299, 0.587, 0.114]) if samples.shape[2] == 3 else samples[..., 0].astype(np.float64)
    small = np.round(area_resize(gray[..., None], 8, 9)[..., 0], 6)
    return f"{int.from_bytes(np.packbits(small[:, 1:] > small[:, :-1]).tobytes(), 'big'):016x}"


def npy_tile(samples: np.ndarray, side: int) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(samples, side, side)), 0, 255).astype(np.uint8))
    return out.getvalue()


def text_to_media(text: str | None) -> tuple[bytes, bytes]:
    """(stored bytes, payload). The payload is the UTF-8 text and spaces up to a positive multiple of 192, as rows of 64 RGB pixels; an even number of rows is stored as PPM, an odd one as BMP."""
    raw = (text or "").encode()
    payload = raw + b" " * (-len(raw) % ROW or (ROW if not raw else 0))
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3)
    return (encode_bmp if len(samples) % 2 else encode_ppm)(samples), payload


def pack_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with ``media``, the text stored losslessly as an image. Null counts as empty; an empty text is one row of spaces."""
    return append_columns(docs, [text_col], [T.StructField("media", T.BinaryType())], lambda: lambda texts: [[text_to_media(t)[0] for t in texts]])


FEATURES = [("media_height", T.IntegerType()), ("media_width", T.IntegerType()), ("media_channels", T.IntegerType()), ("dhash", T.StringType()), ("tile", T.BinaryType()), ("media_error", T.StringType())]


def describe(media: bytes | None, side: int) -> tuple:
    if media is None:
        return (None,) * 6
    try:
        samples = decode(media)
        return (*samples.shape, difference_hash(samples), npy_tile(samples, side) if side else None, None)
    except (ValueError, struct.error, IndexError, OverflowError) as e:
        return (None,) * 5 + (str(e)[:200],)


def decode_media(df: DataFrame, media_col: str = "media", tile_side: int = 32) -> DataFrame:
    """df with size, difference hash and NPY tile of each image.

    Null media give nulls; what can't be decoded gives nulls and media_error, and doesn't fail the job.
    Columns of the same names are replaced. Row by row, without a shuffle.
    """
    fields = [T.StructField(n, t) for n, t in FEATURES]
    return append_columns(df, [media_col], fields, lambda: lambda media: [list(c) for c in zip(*(describe(m, tile_side) for m in media))])


def write_tiles(df: DataFrame, path: str, media_col: str = "media", tile_side: int = 32) -> None:
    """Tiles and hashes as Parquet at path, which may be any store that Spark writes to."""
    decode_media(df, media_col, tile_side).drop(media_col).write.mode("overwrite").parquet(path)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: digests of the stored image and of the payload read back from it, with the image's difference hash."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = [("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("tile_sha256", T.StringType())]

    def row(text):
        media, _ = text_to_media(text)
        samples = decode(media)
        back = samples.tobytes()
        tile = npy_tile(samples, 32)
        return (len((text or "").encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(samples), hashlib.sha256(tile).hexdigest())

    fields = [T.StructField(n, t) for n, t in names]
    return append_columns(docs, ["text"], fields, lambda: lambda texts: [list(c) for c in zip(*map(row, texts))]).drop("text")
