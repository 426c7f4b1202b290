"""The five ways to find distance-1 pairs, as validated parameter sets."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.layout import SLICE_BITS, Layout, Slice, section_ranges

SERIAL = "serial"
HASHING = "hashing"
GROUP = "group"
MAXPARALLEL = "maxparallel"
MULTISECTION = "multisection"
STRATEGIES = (SERIAL, HASHING, GROUP, MAXPARALLEL, MULTISECTION)


@dataclass(frozen=True)
class Strategy:
    """A key generator and its parameter.

    serial        one cell for everything
    hashing       ``J`` value blocks, one cell per unordered block pair
    group         cells of the grid of half weights, ``u`` weights per cell
    maxparallel   one cell per code with one bit masked out
    multisection  one cell per code with one of ``section`` ranges masked out
    """

    name: str
    b: int
    param: int = 0
    block_by: str = "hash"

    @property
    def layout(self) -> Layout:
        return Layout(self.b)

    @property
    def free_ranges(self) -> list[tuple[int, int]]:
        """The bit ranges in which two codes of one cell may differ."""
        if self.name == MULTISECTION:
            return section_ranges(self.b, self.param)
        if self.name == MAXPARALLEL:
            return [(p, p + 1) for p in range(self.b)]
        return [(0, self.b)]

    @property
    def slices(self) -> list[Slice]:
        return self.layout.slices(self.free_ranges)

    @property
    def exactly_once(self) -> bool:
        """Whether every pair meets in one cell only."""
        return self.name not in (HASHING, GROUP)

    @property
    def cell_bound(self) -> int | None:
        """Most distinct codes one cell can hold, where ``b`` alone bounds it."""
        if self.name in (MAXPARALLEL, MULTISECTION):
            return 1 << max(high - low for low, high in self.free_ranges)
        return None


def strategy(
    name: str,
    b: int,
    *,
    J: int | None = None,
    u: int | None = None,
    section: int | None = None,
    block_by: str | None = None,
) -> Strategy:
    """Check the parameters of a strategy; ``auto`` picks one from ``b`` alone.

    ``auto`` is multisection with the fewest sections whose codes fit one
    presence bitmap: it needs no look at the data, because a section of ``w``
    bits bounds every cell at ``2^w`` distinct codes.
    """
    Layout(b)
    given = {k: v for k, v in dict(J=J, u=u, section=section, block_by=block_by).items()
             if v is not None}

    def only(*allowed: str) -> None:
        extra = set(given) - set(allowed)
        if extra:
            raise ValueError(f"{name} does not take {', '.join(sorted(extra))}")

    if name == "auto":
        only()
        return Strategy(MULTISECTION, b, min(b, max(2, -(-b // SLICE_BITS))))
    if name in (SERIAL, MAXPARALLEL):
        only()
        return Strategy(name, b)
    if name == HASHING:
        only("J", "block_by")
        if J is None or J < 1:
            raise ValueError("hashing needs J >= 1 blocks")
        if block_by not in (None, "hash", "mod", "placement"):
            raise ValueError("block_by is one of hash, mod, placement")
        if block_by == "mod" and not Layout(b).narrow:
            raise ValueError("block_by='mod' needs b <= 63")
        return Strategy(name, b, J, block_by or "hash")
    if name == GROUP:
        only("u")
        if b % 2:
            raise ValueError(f"group needs an even b, got {b}")
        if u is None or u < 1 or (b // 2) % u:
            raise ValueError(f"group needs a width u that divides b/2 = {b // 2}, got {u}")
        return Strategy(name, b, u)
    if name == MULTISECTION:
        only("section")
        if section is None:
            raise ValueError("multisection needs section")
        section_ranges(b, section)
        return Strategy(name, b, section)
    raise ValueError(f"unknown strategy {name!r}; use one of {', '.join(STRATEGIES)} or auto")
