"""Column expressions over text, all inside the JVM, and tokens of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data contract.
WHITE_SPACE = " \t\n\u000b\f\r"
MIN_TOKEN_LEN = 2
CHARS_PER_TOKEN = 4.0
EXCERPT_CHARS = 3000
EXCERPT_MIN_CHARS = 200


def strip(col: Column) -> Column:
    """Trim every kind of ASCII white space (``trim`` alone only removes blanks)."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def collapse(col: Column) -> Column:
    """White-space runs become one blank; ends trimmed."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def is_blank(col: Column) -> Column:
    return col.isNull() | (strip(col.cast("string")) == "")


def is_placeholder(col: Column) -> Column:
    """Null, blank, or a value that starts with ``TODO``."""
    text = strip(col.cast("string"))
    return col.isNull() | (text == "") | text.startswith("TODO")


def normalize_filename(col: Column) -> Column:
    """Lower-case stem without punctuation, blanks as ``_``; a name without a dot is kept."""
    stem = F.regexp_extract(col, r"^(?s)(.*)\.([^.]*)$", 1)
    ext = F.regexp_extract(col, r"^(?s)(.*)\.([^.]*)$", 2)
    stem = F.regexp_replace(F.lower(stem), r"""[.,&'"():;?!/\\]""", "")
    stem = F.regexp_replace(stem, r"\s+", "_")
    stem = F.regexp_replace(stem, r"_+", "_")
    stem = F.regexp_replace(stem, r"^_|_$", "")
    return F.when(~F.contains(col, F.lit(".")), col).otherwise(F.concat(stem, F.lit("."), F.lower(ext)))


def normalize_query(col: Column) -> Column:
    """Cache key form: lower, trim, collapse, then drop sentence-final marks.

    The marks go last, so a blank in front of them stays.
    """
    return F.regexp_replace(collapse(F.lower(col)), r"[.!?,;:]+$", "")


def question_key(col: Column) -> Column:
    """Grouping key for repeated questions; punctuation is kept."""
    return collapse(F.lower(col))


def search_text(col: Column) -> Column:
    """Lower case, section sign spelled out."""
    return F.replace(F.lower(col), F.lit("§"), F.lit("section "))


def tokens(col: Column) -> Column:
    """Search tokens: whole runs of ``[a-z0-9_]`` in the search text.

    One matching pass; shorter runs never become array elements.
    """
    return F.regexp_extract_all(search_text(col), F.lit("[a-z0-9_]{%d,}" % MIN_TOKEN_LEN), F.lit(0))


TOKEN_BYTES = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789_", np.uint8))


def token_lists(texts: pa.Array) -> pa.ListArray:
    """The same tokens of search texts in an Arrow batch; null has none.

    Bytes of other characters in UTF-8 are no token bytes, so runs of bytes will do.
    """
    filled = pc.fill_null(texts.cast(pa.string()), "")
    _, ends, data = filled.buffers()
    rows = np.frombuffer(ends, np.int32)[filled.offset : filled.offset + len(filled) + 1] if len(filled) else np.zeros(1, np.int32)
    data = np.frombuffer(data or b"", np.uint8)[rows[0] : rows[-1]]
    rows = rows - rows[0]
    inside = TOKEN_BYTES[data]
    # A run also starts and ends where its row does.
    before, after = np.zeros((2, len(data)), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[rows[:-1][rows[:-1] < len(data)]] = False
    after[rows[1:][rows[1:] > 0] - 1] = False
    begin = np.flatnonzero(inside & ~before)
    size = np.flatnonzero(inside & ~after) + 1 - begin
    long = size >= MIN_TOKEN_LEN
    kept = data[inside]
    if not long.all():
        kept = kept[np.repeat(long, size)]
    at = np.concatenate([[0], np.cumsum(size[long])]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(kept))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(begin[long], rows), pa.int32()), words)


def token_estimate(col: Column) -> Column:
    """Characters over four, rounded half to even, at least one."""
    return F.greatest(F.lit(1), F.bround(F.length(col) / F.lit(CHARS_PER_TOKEN)).cast("int"))


def strip_markup(col: Column) -> Column:
    """Tags become blanks; white space collapsed."""
    return collapse(F.regexp_replace(col, r"<[^>]*>", " "))


def excerpt(col: Column, max_chars: int = EXCERPT_CHARS) -> Column:
    """The text, or its first ``max_chars`` cut back to a word end plus `` ...``."""
    head = F.substring(col, 1, max_chars)
    cut = F.when(F.contains(head, F.lit(" ")), F.regexp_extract(head, "^(.*) [^ ]*$", 1)).otherwise(head)
    return F.when(F.length(col) <= max_chars, col).otherwise(F.concat(cut, F.lit(" ...")))


def content_hash(model: str, task: str, col: Column) -> Column:
    """Content key of a text under one model and task."""
    return F.sha2(F.concat_ws("\u0000", F.lit(model), F.lit(task), col), 256)


def hashed_address(salt: str, address: Column) -> Column:
    return F.sha2(F.concat(F.lit(salt + ":"), address), 256)
