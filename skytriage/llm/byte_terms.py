"""Lower-case terms of a text, cut on its UTF-8 bytes.

Every byte of a character outside ASCII is 0x80 or more, so a table over bytes that keeps
these, lower-cases A-Z and turns the other ASCII characters into blanks cuts a text at the
same places as a pattern over characters would.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of a text that are split at a time.
CHUNK = 1 << 20


def byte_table(digits: bool) -> bytes:
    """Table for ``bytes.translate``: letters, bytes from 0x80 and, if ``digits``, 0-9 make terms."""

    def mapped(b: int) -> int:
        if 0x41 <= b <= 0x5A:
            return b + 32
        return b if b >= 0x80 or 0x61 <= b <= 0x7A or digits and 0x30 <= b <= 0x39 else 0x20

    return bytes(mapped(b) for b in range(256))


LETTERS = byte_table(False)
LETTERS_AND_DIGITS = byte_table(True)


def text_bytes(value: pa.Scalar) -> bytes:
    """UTF-8 of an Arrow string; null is empty."""
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def terms(text: bytes, table: bytes) -> Iterator[list[bytes]]:
    """All terms of ``text`` in order, in lists of about ``CHUNK`` bytes."""
    if len(text) <= CHUNK:
        yield text.translate(table).split()
        return
    clean, at = text.translate(table), 0
    while at < len(clean):
        to = clean.find(b" ", at + CHUNK)
        to = len(clean) if to < 0 else to
        yield clean[at:to].split()
        at = to
