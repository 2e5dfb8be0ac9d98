"""Kinds and sizes of images from their headers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions.text import mime_of
from evalloom.sources import ranges

#: First bytes of the formats, and the JPEG markers whose segment tells the size (C4, C8 and CC mean other things).
PNG, JPEG, GIF = b"\x89PNG\r\n\x1a\n", b"\xff\xd8", b"GIF8"
#: Bytes of a JPEG that are searched for its size at most.
MOST_HEADER = 16 << 20
SIZE_MARKERS = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}


def size_of(data: bytes | None) -> tuple[int | None, int | None]:
    """(width, height); both None for other formats, torn headers and null."""
    try:
        if data is None:
            return None, None
        if data.startswith(PNG):
            return struct.unpack_from(">II", data, 16)
        if data.startswith(GIF):
            return struct.unpack_from("<HH", data, 6)
        at = data.find(b"\xff", 2) if data.startswith(JPEG) else -1
        while at >= 0:
            marker = data[at + 1]
            if marker in SIZE_MARKERS:
                return struct.unpack_from(">HH", data, at + 5)[::-1]
            at = at + 1 if marker == 0xFF else data.find(b"\xff", at + 2 + struct.unpack_from(">H", data, at + 2)[0])
    except (struct.error, IndexError):
        pass  # the header ends too early
    return None, None


def header_of(path: str) -> tuple[str, int | None, int | None]:
    """(first bytes as hex, width, height): reads on only where a JPEG's size stands further behind."""
    size = ranges.HEADER
    while True:
        data = ranges.read_head(path, size)
        found = size_of(data)
        if found[0] is not None or len(data) < size or not data.startswith(JPEG) or size >= MOST_HEADER:
            return data[:16].hex().upper(), *found
        size *= 16


def image_headers(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, mime, width, height, length) of the images below path, each once; of a file the first KB is read, of some JPEGs more."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([header_of(x) for x in batch["file"]], columns=["head", "width", "height"], index=batch.index)
            yield batch.join(found.astype({"head": "string", "width": "Int32", "height": "Int32"}))

    sized = ranges.spread(ranges.listing(spark, path, glob).select("file", "length")).mapInPandas(read, "file string, length long, head string, width int, height int")
    return sized.select("file", mime_of(F.col("head")).alias("mime"), "width", "height", "length")
