"""Arrow string columns as numpy bytes, without a Python object per row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all values and the n + 1 offsets into them; nulls are empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    bytes_ = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return bytes_[at[0] : at[-1]], at - at[0]
