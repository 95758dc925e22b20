"""Default parameters of SOAP and ACSF from bond lengths of the species at hand."""

from __future__ import annotations

import math

import numpy as np

# Fixed values: (typical bond length, shortest bond length) by atomic number; other elements are a parameter.
BONDS = {
    1: (1.2, 0.75), 3: (3, 2.4), 4: (2.2, 2.1), 5: (1.8, 1.6), 6: (1.4, 1.3), 7: (1.6, 1.1), 8: (1.7, 1.2), 9: (2.1, 1.4), 11: (3.7, 2.9), 12: (3.2, 2.9), 13: (2.9, 2.5),
    14: (2.4, 2.3), 15: (2.5, 1.9), 16: (2.3, 1.9), 17: (2.6, 2), 19: (4.6, 3.5), 20: (3.8, 3), 21: (3.2, 2.6), 22: (2.9, 2.4), 23: (2.6, 1.8), 24: (2.5, 1.9),
    26: (2.5, 1.8), 27: (2.5, 2), 28: (2.5, 2.1), 29: (2.6, 2.2), 30: (2.8, 2.5), 31: (3, 2.5), 32: (2.5, 2.1), 33: (2.7, 2.1), 34: (2.8, 2.2), 35: (2.8, 2.3),
    37: (4.7, 3.7), 38: (4.2, 3.8), 39: (3.6, 2.9), 40: (3.2, 2.3), 41: (2.9, 2.1), 42: (2.7, 2), 43: (2.7, 2), 44: (2.7, 2.1), 45: (2.7, 2.2), 46: (2.8, 2.4),
    47: (2.9, 2.6), 48: (3.2, 2.9), 49: (3.4, 2.8), 50: (2.9, 2.6), 51: (3.1, 2.5), 52: (3.2, 2.6), 53: (3.2, 2.7), 56: (4.3, 3.5), 57: (3.7, 2.6), 58: (3.4, 2.6),
    59: (3.7, 2.8), 60: (3.7, 2.6), 61: (3.6, 2.7), 62: (3.6, 2.7), 64: (3.6, 2.9), 65: (3.6, 2.9), 66: (3.5, 3.1), 69: (3.5, 3.1), 70: (3.8, 3.3), 72: (3.2, 2.6),
    73: (2.9, 2.1), 74: (2.8, 2.1), 75: (2.8, 2), 76: (2.7, 2.1), 77: (2.7, 2.2), 78: (2.8, 2.3), 79: (2.9, 2.5), 80: (3.3, 3), 81: (3.4, 2.9), 82: (3.5, 2.9),
    83: (3.3, 2.7), 84: (3.3, 2.8), 89: (4, 3.5), 90: (3.6, 2.7), 91: (3.3, 2.4),
}
# Name -> (number of sets, scale of the range, n, l, sharpness).
PRESETS = {"smart": (2, 1.2, 8, 4, 1.0), "minimal": (1, 0.85, 4, 3, 1.0), "longrange": (2, 1.8, 8, 4, 1.2)}


def significant(v: float, n: int) -> float:
    """v rounded to n significant figures."""
    return 0.0 if v == 0 else float(f"{v:.{n}g}")


def bond_range(species: list[int], bonds: dict[int, tuple[float, float]] | None = None) -> tuple[float, float]:
    """The shortest and the longest bond among species."""
    table = BONDS | (bonds or {})
    if missing := [z for z in species if z not in table]:
        raise KeyError(f"no bond lengths of elements {missing}")
    return min(table[z][1] for z in species), max(table[z][0] for z in species)


def soap(species: list[int], preset: str | None = None, sets: int = 2, scale: float = 1.0, n: int = 8, l: int = 4, sharpness: float = 1.0, bonds=None) -> dict[str, dict]:  # noqa: E741
    """SOAP specs: one of the longest cutoff, and with two sets or more one of the next shorter cutoff."""
    if preset:
        sets, scale, n, l, sharpness = PRESETS[preset]  # noqa: E741
    shortest, longest = bond_range(species, bonds)
    low = max(2.0, 1.3 * scale * shortest)
    high = max(1.2 * low, 1.3 * scale * longest)
    cutoffs = [high]
    if sets >= 2:
        cutoffs.append(high / (high / low) ** (1 / (sets - 1)))
    return {f"soap{k}": {"type": "SOAP", "species": species, "cutoff": significant(c, 2), "n": n, "l": l, "atom_gaussian_width": significant(c / 8 / sharpness, 2)} for k, c in enumerate(cutoffs, 1)}


def acsf(species: list[int], scale: float = 1.0, sharpness: float = 1.0, cutoff: float | None = None, bonds=None) -> dict[str, dict]:
    """An ACSF spec with radial functions at and around shrinking radii, and angular ones over decades of width."""
    shortest, longest = bond_range(species, bonds)
    cutoff = cutoff or max(significant(1.3 * scale * longest, 2), 2.0)
    n = int(sharpness * (cutoff - shortest) / 0.5)
    radii = cutoff * (1 / n) ** (np.arange(n + 1) / n)
    g2 = [[significant(1 / r**2, 2), 0.0] for r in radii if 3 * r > shortest]
    for centre, wider in zip(radii[::-1], radii[-2::-1], strict=False):
        gap = wider - centre
        if centre + 3 * gap > shortest:
            g2.append([significant(1 / gap**2, 2), significant(centre, 2)])
    g4 = [[significant(eta, 2), zeta, sign] for eta in np.logspace(-3, 0, n // 2) for zeta in (1.0, 4.0, 16.0) if 3 / math.sqrt(eta) > shortest for sign in (1, -1)]
    return {f"acsf-{cutoff}": {"type": "ACSF", "cutoff": cutoff, "g2_params": g2, "g4_params": g4}}
