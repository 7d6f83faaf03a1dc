"""Settings that fix a vector space, and the constants of the algebra."""

from __future__ import annotations

from dataclasses import dataclass

#: Norms below this count as zero.
DEGENERATE = 1e-10


@dataclass(frozen=True)
class Space:
    """Dimensions and seed: two spaces that are equal give equal vectors on any cluster, without exchange."""

    dims: int = 4096
    seed: int = 0
