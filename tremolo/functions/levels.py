"""Severity levels: bands, classifiers, gates on levels, temperatures and magnitudes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, r4

# Bands [low, high) of levels 1 to 5.
TCR_BANDS = {
    "SV": [(0.05, 0.15), (0.15, 0.35), (0.35, 0.60), (0.60, 0.85), (0.85, 0.95)],
    "IQ": [(0.0, 0.05), (0.03, 0.10), (0.08, 0.18), (0.15, 0.30), (0.25, 0.50)],
    "F": [(0.01, 0.06), (0.04, 0.10), (0.08, 0.15), (0.12, 0.22), (0.18, 0.35)],
    "CI": [(0.05, 0.15), (0.12, 0.25), (0.20, 0.38), (0.28, 0.48), (0.38, 0.65)],
    "CL": [],
    "CIS": [],
    "KB": [],
}
FALLBACK = [(0.0, 0.10), (0.10, 0.25), (0.25, 0.50), (0.50, 0.75), (0.75, 1.01)]
WEIGHTS = {"SV": (0.7, 0.3), "IQ": (0.4, 0.6), "F": (0.3, 0.7), "CI": (0.7, 0.3), "CL": (0.5, 0.5), "CIS": (0.5, 0.5), "KB": (0.5, 0.5)}
CES_CUTS = [0.13, 0.38, 0.63, 0.88]
DEFINITION_CUTS = [0.16, 0.32, 0.52, 0.76]
CTX_BANDS = [(1.1, 1.2), (1.2, 1.3), (1.3, 1.4), (1.4, 1.5), (1.5, 1.6)]
#: Bands of the metric-based classifier: metric, edges of levels 1 to 5; weights of its score, and whether more means more perturbed.
SPEC_EDGES = {
    "IQ": {"cer": [0.0, 0.02, 0.05, 0.10, 0.18, 0.30], "wcr": [0.0, 0.05, 0.10, 0.20, 0.35, 0.501]},
    "F": {"ccr": [0.0, 0.03, 0.07, 0.12, 0.18, 0.25], "lcs": [0.0, 0.2, 0.4, 0.6, 0.8, 1.01]},
    "CI": {"ale_norm": [0.0, 0.15, 0.30, 0.50, 0.70, 1.01]},
    "CL": {"ctx_cer": [1.1, 1.2, 1.3, 1.4, 1.5, 1.6]},
    "CIS": {"ces_norm": [0.0, 0.13, 0.38, 0.63, 0.88, 1.01]},
}
SPEC_WEIGHTS = {
    "SV": {"sim": 0.7, "tcr": 0.3},
    "IQ": {"cer": 0.4, "wcr": 0.4, "sds": 0.2},
    "F": {"ccr": 0.4, "lcs": 0.6},
    "CI": {"ale_norm": 0.5, "dc_norm": 0.3, "dnd_norm": 0.2},
    "CL": {"ctx_cer_norm": 0.4, "cdp": 0.3, "adi_norm": 0.3},
    "CIS": {"ces_norm": 0.5, "cc_norm": 0.3, "ihd_norm": 0.2},
}
#: Metrics of which less means more perturbed.
FALLING = {"sim"}
#: Largest value of each normalised metric.
NORMALISERS = {"ale_norm": 12.0, "dc_norm": 6.0, "dnd_norm": 4.0, "cc_norm": 5.0, "ihd_norm": 4.0, "adi_norm": 0.80}
BASE_TEMPERATURES = {"format": [0.1, 0.2, 0.3, 0.4, 0.6]}
CAP = 0.95


def level_int(level: Column) -> Column:
    """L3 to 3; -1 for what is no level."""
    return F.coalesce(F.replace(F.upper(F.trim(level)), F.lit("L"), F.lit("")).try_cast("int"), F.lit(-1))


def _first(value: Column, bands: list[tuple[float, float]], otherwise: Column) -> Column:
    for i in reversed(range(len(bands))):
        lo, hi = bands[i]
        otherwise = F.when((value >= lo) & (value < hi), F.lit(f"L{i + 1}")).otherwise(otherwise)
    return otherwise


def tcr_level(tcr: Column, family: str) -> Column:
    """The first band of the family that holds the change rate, else the first common band, else L5."""
    return _first(tcr, TCR_BANDS.get(family, []), _first(tcr, FALLBACK, F.lit("L5")))


def tcr_level_of(tcr: Column, family: Column) -> Column:
    out = tcr_level(tcr, "")
    for name in TCR_BANDS:
        out = F.when(family == name, tcr_level(tcr, name)).otherwise(out)
    return out


def cut_level(value: Column, cuts: list[float]) -> Column:
    def place(x: Column) -> Column:
        out = F.lit(f"L{len(cuts) + 1}")
        for i in reversed(range(len(cuts))):
            out = F.when(x < cuts[i], F.lit(f"L{i + 1}")).otherwise(out)
        return out

    return let(value, place)


def ces_norm(ces: Column) -> Column:
    return let(ces, lambda x: F.when(x == 0, F.lit(0.0)).otherwise((x - 1) / F.lit(4.0)))


def normalised(value: Column, name: str) -> Column:
    return F.least(F.lit(1.0), value / F.lit(NORMALISERS[name]))


def spec_level(metrics: dict[str, Column], family: str) -> Column:
    """Level whose bands hold all metrics of the family; else by its first metric alone; else 1."""
    edges = {k: v for k, v in SPEC_EDGES[family].items() if k in metrics}
    out = F.lit(1)
    for only in (list(edges)[:1], list(edges)):
        for level in range(5, 0, -1):
            inside = F.lit(True)
            for k in only:
                inside = inside & (metrics[k] >= edges[k][level - 1]) & (metrics[k] < edges[k][level])
            out = F.when(inside, F.lit(level)).otherwise(out)
    return out


def spec_score(metrics: dict[str, Column], family: str) -> Column:
    """Weighted mean of the family's metrics that are given, each seen so that more is more perturbed."""
    own = {k: w for k, w in SPEC_WEIGHTS[family].items() if k in metrics}
    if not own:
        return F.lit(0.0)
    parts = [w * ((1 - metrics[k]) if k in FALLING else metrics[k]) for k, w in own.items()]
    return r4(sum(parts[1:], parts[0]) / sum(own.values()))


def level_gate(tcr: Column, level: Column, family: str) -> Column:
    """Whether the change rate is in the target level's band; without one, whether anything changed."""
    out = tcr > 0.005
    for i, (lo, hi) in enumerate(TCR_BANDS.get(family, [])):
        out = F.when(level == f"L{i + 1}", (tcr >= lo) & (tcr < hi)).otherwise(out)
    return out


def context_gate(ctx_cer: Column, level: Column) -> Column:
    out = F.lit(False)
    for i, (lo, hi) in enumerate(CTX_BANDS):
        out = F.when(level == f"L{i + 1}", (ctx_cer >= lo) & (ctx_cer < hi)).otherwise(out)
    return out


def temperature(base: Column, attempt: Column, step: float = 0.10) -> Column:
    """Rises with each attempt up to the cap."""
    return F.round(F.least(F.lit(CAP), base + step * F.greatest(F.lit(0), attempt - 1)), 2)


def magnitude(sim: Column, tcr: Column, family: str) -> Column:
    a, b = WEIGHTS[family]
    return r4(((1 - sim) * a + tcr * b) / (a + b))
