"""Fixed values of the method: measures, breakpoint sets, labels, sorts, factor weights."""

from __future__ import annotations

from itertools import combinations, product

# --- fixed values -------------------------------------------------------------------------
MEASURES = ("bm", "inv", "op", "nf")
BP_SETS = ("10_90", "20_80", "30_70", "40_60")
DEFAULT_SET = "30_70"
# sets evaluated when some measure uses alternative breakpoints (the default set is left out)
ROBUST_SETS = ("10_90", "20_80", "40_60")
SET_PROBS = (0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9)
QUINTILE_PROBS = (0.2, 0.4, 0.6, 0.8)
QUARTILE_PROBS = (0.25, 0.5, 0.75)
HALF_PROBS = (0.5,)
COMMON_SHARE_CODES = (10, 11)
REFERENCE_EXCHANGE = 1
EDGE_EPSILON = 1e-11
# column sorted on, eligibility flag and low/middle/high labels of each measure
VALUE_COL = {"size": "me", "bm": "beme", "inv": "inv", "op": "op", "nf": "nf"}
FLAG_COL = {"size": "is_size_ok", "bm": "is_beme_ok", "inv": "is_inv_ok", "op": "is_op_ok", "nf": "is_nf_ok"}
LABELS3 = {"bm": ("L", "N", "H"), "op": ("W", "N", "R"), "inv": ("C", "N", "A"), "nf": ("Y", "N", "X")}
SIZE_LABELS = ("S", "B")
# order of the measures in the sorted test portfolios
SORT_MEASURES = ("bm", "op", "inv", "nf")
FACTORS = ("SMB", "HML", "CMA", "RMW", "XMY")
FACTOR_OF = {"bm": "HML", "inv": "CMA", "op": "RMW", "nf": "XMY"}
# long and short label of each long-short factor (investment: conservative is long)
LONG_SHORT = {"bm": ("H", "L"), "inv": ("C", "A"), "op": ("R", "W"), "nf": ("X", "Y")}
PUBLISHED_FACTORS = ("Mkt-RF", "SMB", "HML", "RMW", "CMA")
PUBLISHED_BIVARIATE = ("size_bm", "size_inv", "size_op", "bm_inv", "bm_op", "op_inv")
PUBLISHED_THREEWAY = ("size_bm_op", "size_bm_inv", "size_op_inv")
VW_MONTHLY_MARKER = "Average Value Weighted Returns -- Monthly"
# ------------------------------------------------------------------------------------------

FIVE = ("size",) + MEASURES
LABELS2 = {m: (LABELS3[m][0], LABELS3[m][2]) for m in MEASURES}


def port(measure: str) -> str:
    """Bucket column of the two/three-way factor sorts."""
    return "szport" if measure == "size" else f"{measure}port"


def ntile_port(measure: str) -> str:
    """Bucket column of the n-tile sorts."""
    return f"{measure}port"


def bivariate_sorts() -> list[tuple[str, ...]]:
    return list(combinations(("size",) + SORT_MEASURES, 2))


def threeway_sorts() -> list[tuple[str, ...]]:
    return [("size",) + c for c in combinations(SORT_MEASURES, 2)]


def set_prob_index(bp: str) -> tuple[int, int]:
    """Positions of the low and high edge of a breakpoint set in ``SET_PROBS``."""
    lo, hi = bp.split("_")
    return SET_PROBS.index(int(lo) / 100), SET_PROBS.index(int(hi) / 100)


def evaluated_sets(robust: tuple[str, ...]) -> tuple[str, ...]:
    return ROBUST_SETS if robust else (DEFAULT_SET,)


def pair_codes(labels: dict[str, tuple[str, ...]]) -> list[str]:
    """Portfolio codes of size crossed with one other measure at a time."""
    return [f"{s}{v}_{m}port" for m in MEASURES for v in labels[m] for s in SIZE_LABELS]


PAIR_CODES_3 = pair_codes(LABELS3)
PAIR_CODES_2 = pair_codes(LABELS2)
# letter positions of the five-way code: size, bm, op, inv, nf
FIVE_ORDER = ("size", "bm", "op", "inv", "nf")
FIVE_CODES = ["".join(p) for p in product(SIZE_LABELS, *[LABELS2[m] for m in FIVE_ORDER[1:]])]


def pair_weights(labels: dict[str, tuple[str, ...]]) -> dict[str, dict[str, float]]:
    """Weights of every factor on the size-by-measure portfolios; each factor sums to zero."""
    weights: dict[str, dict[str, float]] = {}
    for m in MEASURES:
        long, short = LONG_SHORT[m]
        weights[FACTOR_OF[m]] = {
            f"{s}{v}_{m}port": sign / 2 for s in SIZE_LABELS for v, sign in ((long, 1.0), (short, -1.0))
        }
        k = len(labels[m])
        weights[f"SMB_{m.upper()}"] = {
            f"{s}{v}_{m}port": sign / k for s, sign in (("S", 1.0), ("B", -1.0)) for v in labels[m]
        }
    weights["SMB"] = {
        code: w / len(MEASURES) for m in MEASURES for code, w in weights[f"SMB_{m.upper()}"].items()
    }
    return weights


def five_way_weights() -> dict[str, dict[str, float]]:
    """Each factor: half of the 32 portfolios long, the other half short, 1/16 each."""
    weights = {"SMB": {c: (1 if c[0] == "S" else -1) / 16 for c in FIVE_CODES}}
    for pos, m in enumerate(FIVE_ORDER[1:], start=1):
        weights[FACTOR_OF[m]] = {c: (1 if c[pos] == LONG_SHORT[m][0] else -1) / 16 for c in FIVE_CODES}
    return weights
