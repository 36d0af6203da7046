"""Text helpers shared by the operators: ASCII lowering and the two word rules.

The native helpers build Columns; the ``*_words`` functions do the same on
UTF-8 bytes inside Python tasks.  A null text is the empty text.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Anything that is no ASCII letter, ASCII digit or non-ASCII character.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Runs of anything but ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"

_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
_WORDS = bytes(
    b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else ord(chr(b).lower()) if chr(b).isupper() else 0x20
    for b in range(256)
)
#: Texts handled at once in a Python task (bytes), whatever the batch holds.
SLICE_BYTES = 8 << 20


def lower_ascii(text: Column) -> Column:
    """A-Z lowered, every other character as it is; null gives ''.  ``lower``
    does this for pure ASCII texts and is many times faster than ``translate``."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def spaced_words(text: Column) -> Column:
    """The words of a text joined by single spaces ('' without words)."""
    return F.trim(F.regexp_replace(lower_ascii(text), NOT_WORD, " "))


def split_spaced(spaced: Column) -> Column:
    return F.array_remove(F.split(spaced, " "), "")


def n_tokens(text: Column) -> Column:
    """Number of white-space tokens: each, with the space around it, becomes one mark."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), rf"{SPACE}*{TOKEN}{SPACE}*", "x")
    return F.when(marks.startswith("x"), F.char_length(marks)).otherwise(0).cast("long")


def n_spaced(spaced: Column) -> Column:
    """Number of words of a single-spaced text."""
    gaps = F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(" "), F.lit("")))
    return F.when(spaced == "", 0).otherwise(gaps + 1).cast("long")


def token_bytes(text: str | None) -> list[bytes]:
    """White-space tokens of the lowered text."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def word_bytes(text: str | None) -> list[bytes]:
    """Alphanumeric words of the lowered text."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about ``size`` bytes of text; a
    longer single text is a slice of its own."""
    for batch in batches:
        held = batch.column(batch.schema.get_field_index(text)).nbytes
        rows = max(1, int(batch.num_rows * size / max(held, size)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def row_key(doc_id: Column, hashed: Column) -> Column:
    """Names a row by its id and text hash; rows alike in both share it."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), hashed.cast("string"))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id's text modulo ``folds`` is ``fold``; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold
