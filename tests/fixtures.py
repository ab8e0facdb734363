"""Small literal tables with known results, and a writer for tiny PNG files."""

from __future__ import annotations

import struct
import zlib
from pathlib import Path

import numpy as np


def orchard() -> list[dict]:
    """Samples of three classes of unequal size in two source splits.

    Of each class's training rows, two triplets and one pair share a key; one key recurs in the other split.
    """
    rows = []
    for label, size in (("apple", 21), ("plum", 16), ("quince", 13)):
        for i in range(size):
            key = f"{label}-t{i // 3}" if i < 6 else f"{label}-p" if i < 8 else f"{label}-{i}"
            rows.append({"sample_id": f"{label}/{i:02d}", "original_split": "train", "class_label": label,
                         "rgb_sha256": key, "input_sha256": key})
        for i in range(3):
            key = f"{label}-8" if i == 0 else f"{label}-v{i}"
            rows.append({"sample_id": f"{label}/v{i}", "original_split": "val", "class_label": label,
                         "rgb_sha256": key, "input_sha256": key})
    return rows


def partitioned_orchard() -> list[dict]:
    """Rows already in partitions: of each class, three fitting rows recur in evaluation and one in development."""
    rows = []
    for label, size in (("apple", 11), ("plum", 9)):
        keys = {
            "fitting": [f"{label}-e0", f"{label}-e0", f"{label}-e2", f"{label}-d1"] + [f"{label}-f{i}" for i in range(4, size)],
            "development": [f"{label}-d{i}" for i in range(3)],
            "evaluation": [f"{label}-e{i}" for i in range(4)],
        }
        for partition, values in keys.items():
            rows += [{"sample_id": f"{partition[:3]}-{label}-{i}", "class_label": label, "partition": partition,
                      "rgb_sha256": key, "input_sha256": key} for i, key in enumerate(values)]
    return rows


def write_png(path: Path, pixels: np.ndarray) -> None:
    height, width = pixels.shape[:2]
    colour = 2 if pixels.ndim == 3 else 0
    lines = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(height))

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0))
        + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    )
