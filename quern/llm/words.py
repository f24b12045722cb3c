"""Words of UTF-8 bytes for the operators that hash or match words on the executors."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of text whose words are held as objects at a time.
BLOCK_BYTES = 1 << 20
#: A word is a maximal run of digits, letters and bytes beyond ASCII; only A-Z have their case changed.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_blocks(data: bytes, size: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in order, some at a time, so that a very long text needs little more memory than its bytes."""
    clean, at = data.translate(_CLEAN), 0
    while at < len(clean):
        stop = clean.find(b" ", at + size)
        stop = len(clean) if stop < 0 else stop
        yield clean[at:stop].split()
        at = stop
