"""Schemas and constants of the data model."""

from __future__ import annotations

from dataclasses import dataclass

POSITIONS = 15  # looked at from each end of a molecule
MIN_LENGTH, LENGTH_LIMIT = 30, 150  # the limit itself is out
NO_QUALITY = 255  # a missing base quality
BASES = "ACGT"
CELLS = [a + b for a in BASES for b in BASES]  # reference base, read base

READS = (
    "qname string, flag int, rname string, pos long, mapq int, cigar string, seq string, qual array<int>, tags map<string,string>, tag_types map<string,string>, rnext string, pnext long, tlen int"
)
#: One row for a read whose bases are aligned: codes in the order of the forward reference.
ALIGNED = "read_id long, flag int, length int, ref array<int>, read array<int>, qual array<int>"


@dataclass(frozen=True)
class Options:
    """What a run needs; defaults are those of the command line."""

    model: str = "nb"  # "b": biotin, "nb": non-biotin
    eps: float = 0.0  # contamination with modern molecules, [0, 1)
    isrecal: int = 0  # 1: the lengths of ancient and modern molecules are fitted and used
    len_limit: int = LENGTH_LIMIT
    mapped_only: bool = False
    single_end: bool = True
    min_mapq: int | None = None
    min_quality: int | None = None
    tolerance: float = 1e-8
    #: Keep known oddities of earlier results (see README) instead of their corrected forms.
    compat: bool = True

    @property
    def limit(self) -> int:
        """The first length that is out; a len_limit of zero or less means 512."""
        return self.len_limit if self.len_limit > 0 else 512

    def __post_init__(self):
        if self.model not in ("b", "nb"):
            raise ValueError(f"model is b or nb, not {self.model!r}")
        if not 0 <= self.eps < 1:
            raise ValueError(f"eps is in [0, 1), not {self.eps}")
