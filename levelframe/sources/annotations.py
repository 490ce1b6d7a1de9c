"""Frames with lines drawn on them, encoded as PNG in the tasks.

A line is drawn by scan conversion: a place is on it if it lies within half its thickness; a dashed line has the places
whose distance along it, from its point, falls into a dash. Later lines lie over earlier ones.

Nulls and edge cases: a frame without lines, or with null ones, is encoded as it is; what lies outside is not drawn; a
grayscale frame becomes one of three equal channels.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelframe.operators.batches import LINE

#: What is drawn: a line, its colour (red, green, blue), thickness, and dash and gap, both 0 for a whole line.
DRAWN = f"array<struct<line:{LINE},red:int,green:int,blue:int,thickness:double,dash:double,gap:double>>"


def drawn(line: Column, colour: tuple[int, int, int], thickness: float = 2.0, dash: float = 0.0, gap: float = 0.0) -> Column:
    """One entry of DRAWN."""
    values = (*((k, F.lit(v)) for k, v in zip(("red", "green", "blue"), colour, strict=True)), *((k, F.lit(float(v))) for k, v in (("thickness", thickness), ("dash", dash), ("gap", gap))))
    return F.struct(line.cast(LINE).alias("line"), *(v.alias(k) for k, v in values))


def places(height: int, width: int, ln: dict, thickness: float, dash: float, gap: float) -> np.ndarray:
    """Which places of a frame a line covers."""
    y, x = np.mgrid[:height, :width]
    size = np.hypot(ln["vx"], ln["vy"])
    vx, vy = ln["vx"] / size, ln["vy"] / size
    dx, dy = x - ln["x0"], y - ln["y0"]
    on = np.abs(dx * vy - dy * vx) <= thickness / 2
    return on & ((dx * vx + dy * vy) % (dash + gap) < dash) if dash + gap > 0 else on


def png(rgb: np.ndarray) -> bytes:
    """height x width x 3 bytes (red, green, blue) as a PNG file."""
    h, w = rgb.shape[:2]
    rows = np.zeros((h, 1 + 3 * w), np.uint8)  # each row begins with its filter: none
    rows[:, 1:] = rgb.reshape(h, 3 * w)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes(), 6)) + part(b"IEND", b"")


def annotated(images: DataFrame, lines: Column) -> DataFrame:
    """filename and png of images (filename, height, width, nChannels, data, and what lines reads), with lines (DRAWN)
    drawn on each."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a frame at a time bounds the memory
                name, h, w, n, data, entries = (batch.column(k)[i] for k in ("filename", "height", "width", "nChannels", "data", "lines"))
                h, w, n = h.as_py(), w.as_py(), n.as_py()
                raw = np.frombuffer(data.as_buffer(), np.uint8).reshape(h, w, n)
                rgb = np.repeat(raw, 3, axis=2) if n == 1 else raw[:, :, 2::-1].copy()
                for e in entries.as_py() or []:
                    if e is not None and e["line"] is not None:
                        rgb[places(h, w, e["line"], e["thickness"], e["dash"], e["gap"])] = e["red"], e["green"], e["blue"]
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([png(rgb)], pa.binary())], ["filename", "png"])

    return images.select("filename", "height", "width", "nChannels", "data", lines.cast(DRAWN).alias("lines")).mapInArrow(of, "filename string, png binary")
