"""How a ``b``-bit code is stored in BIGINT words and cut into sections.

Bit positions count from the right (the last character of the text form is
position 0).  Sections count from the left, as they are read in the text form.
"""

from __future__ import annotations

from dataclasses import dataclass

# One BIGINT holds up to 63 bits without touching the sign.  Wider codes use
# several words of 60 bits, which ten 6-bit slices fill without a remainder.
NARROW_BITS = 63
WIDE_WORD_BITS = 60

# A slice of 6 bits has 64 possible values: one BIGINT is a complete
# presence bitmap for it.
SLICE_BITS = 6


@dataclass(frozen=True)
class Slice:
    """``width`` neighbouring bits of one word; ``section`` is the caller's label."""

    section: int
    word: int
    offset: int  # position of the lowest bit inside the word
    width: int
    position: int  # position of the lowest bit inside the code

    @property
    def mask(self) -> int:
        return ((1 << self.width) - 1) << self.offset


@dataclass(frozen=True)
class Layout:
    b: int

    def __post_init__(self):
        if self.b < 1:
            raise ValueError(f"b must be at least 1, got {self.b}")

    @property
    def narrow(self) -> bool:
        return self.b <= NARROW_BITS

    @property
    def words(self) -> list[tuple[int, int]]:
        """``(lowest position, width)`` of every word, lowest word first."""
        size = NARROW_BITS if self.narrow else WIDE_WORD_BITS
        return [(low, min(size, self.b - low)) for low in range(0, self.b, size)]

    def word_of(self, position: int) -> tuple[int, int]:
        """``(word, offset inside the word)`` of a bit position."""
        size = NARROW_BITS if self.narrow else WIDE_WORD_BITS
        return divmod(position, size)

    def word_masks(self, low: int, high: int) -> list[int]:
        """Per word, the mask of positions ``low <= position < high``."""
        masks = []
        for start, width in self.words:
            a, z = max(low, start), min(high, start + width)
            masks.append(((1 << (z - a)) - 1) << (a - start) if z > a else 0)
        return masks

    def slices(self, ranges: list[tuple[int, int]], width: int = SLICE_BITS) -> list[Slice]:
        """Cut every ``[low, high)`` range into near-equal slices of at most ``width`` bits.

        Slice ``i`` of range ``r`` carries ``section=r``.  No slice crosses a word.
        """
        out = []
        for section, (low, high) in enumerate(ranges):
            for start, size in self.words:
                a, z = max(low, start), min(high, start + size)
                if z <= a:
                    continue
                pieces = -(-(z - a) // width)
                cuts = [a + (z - a) * i // pieces for i in range(pieces + 1)]
                for lo, hi in zip(cuts, cuts[1:]):
                    word, offset = self.word_of(lo)
                    out.append(Slice(section, word, offset, hi - lo, lo))
        return out


def section_ranges(b: int, section: int) -> list[tuple[int, int]]:
    """``section`` near-equal ranges covering all ``b`` bits, leftmost first.

    Each entry is ``(low, high)`` in bit positions.
    """
    if not 1 <= section <= b:
        raise ValueError(f"section must lie in 1..{b}, got {section}")
    cuts = [b * m // section for m in range(section + 1)]
    return [(b - right, b - left) for left, right in zip(cuts, cuts[1:])]


def section_masks(b: int, section: int) -> list[int]:
    """The integer mask of every section, leftmost section first."""
    return [(1 << high) - (1 << low) for low, high in section_ranges(b, section)]
