"""What is asked for: named quantities, parsed once on the driver into frozen records in registry order.

A name is a prefix (which pixels count, and how) and a family (what is computed of them), for example
`unweightedBoundaryMean` or `quantile-0p25`. Quantities that need the pixel-centre test are asked for in a list of
their own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from fractions import Fraction

#: coverage rule by prefix part; "c" is what counts as coverage, "where" the pixels that count.
COVERAGE_RULES = ("", "fullyContained", "partiallyContained", "boundary", "allTouched")
CENTROID_RULES = ("centroidBased", "centroidBasedFullyContained", "centroidBasedBoundary")
FAMILIES = ("EmpDist", "EmpDigest", "Quantile", "Median", "Mean", "Var", "Std", "Weight")
OBJECTS = ("EmpDist", "EmpDigest")


def joined(weighted: bool, rule: str, family: str) -> str:
    name = ("" if weighted else "unweighted") + (rule if weighted else rule[:1].upper() + rule[1:]) + family
    return name[:1].lower() + name[1:]


@dataclass(frozen=True)
class Quantity:
    suffix: str
    rule: str
    weighted: bool
    family: str
    q: Fraction | None = None
    options: tuple[tuple[str, object], ...] = field(default=())

    @property
    def kind(self) -> tuple[str, bool]:
        return self.rule, self.weighted

    @property
    def ignored(self) -> tuple | None:
        """Values to ignore in place of the common ones, where the request has its own."""
        return dict(self.options).get("ignoreValues")


REGISTRY = {joined(w, rule, f): (rule, w, f) for rules in (COVERAGE_RULES, CENTROID_RULES) for f in FAMILIES for rule in rules for w in (True, False)}


def parse_quantile(name: str) -> tuple[str, Fraction] | None:
    """Base name and level of a name such as quantile-0p975; None if it is none; ValueError if the level is no share."""
    m = re.fullmatch(r"(.+)-([01])p(\d+)", name)
    if not m:
        return None
    q = Fraction(f"{m[2]}.{m[3]}")
    if q > 1:
        raise ValueError(f"{name}: a quantile's level is at most 1")
    return m[1], q


def quantile_suffix(base: str, q: Fraction) -> str:
    return f"{base}-{str(float(q)).replace('.', 'p')}"


def _one(entry: str | dict, rules: tuple[str, ...]) -> list[Quantity]:
    items = list(entry.items()) if isinstance(entry, dict) else [(entry, None)]
    out = []
    for name, options in items:
        level = parse_quantile(name) if options is None else None
        base = level[0] if level else name
        if base not in REGISTRY or (REGISTRY[base][2] == "Quantile") != bool(level):
            raise ValueError(f"unknown quantity {name!r}")
        rule, weighted, family = REGISTRY[base]
        if rule not in rules:
            raise ValueError(f"{name!r} belongs in the other list of quantities")
        if family in OBJECTS and options is None:
            raise ValueError(f"{name!r} takes options: write {{{name!r}: {{}}}}")
        if options is not None and family not in OBJECTS:
            raise ValueError(f"{name!r} takes no options")
        flat = {**(options or {}).get("pdfMethodParams", {}), **{k: v for k, v in (options or {}).items() if k != "pdfMethodParams"}}
        flat = {k: tuple(v) if isinstance(v, list) else v for k, v in flat.items()}
        out.append(Quantity(quantile_suffix(base, level[1]) if level else name, rule, weighted, family, level[1] if level else None, tuple(sorted(flat.items()))))
    return out


def parse(quantities: list[str | dict] = (), centroid_quantities: list[str | dict] = ()) -> list[Quantity]:
    """The quantities in registry order: by list, family and prefix; quantiles of a prefix by request; no repeats."""
    out: list[Quantity] = []
    for entries, rules in ((quantities, COVERAGE_RULES), (centroid_quantities, CENTROID_RULES)):
        found = [x for e in entries for x in _one(e, rules)]
        place = {name: i for i, name in enumerate(REGISTRY)}
        found.sort(key=lambda x: place[joined(x.weighted, x.rule, x.family)])
        out += found
    unique = {x.suffix: x for x in reversed(out)}
    out = [x for x in out if unique.get(x.suffix) is x]
    if not out:
        raise ValueError("nothing is asked for")
    return out


def band_names(stems: dict[str, int]) -> list[str]:
    """{stem}_band_{b} for the number of bands of each raster stem."""
    return [f"{stem}_band_{b}" for stem, n in stems.items() for b in range(1, n + 1)]


def stems_of(paths: list[str], bands: list[int]) -> dict[str, int]:
    """Raster stems and their numbers of bands; two rasters of one stem would share their columns, so they are refused."""
    out: dict[str, int] = {}
    for path, n in zip(paths, bands, strict=True):
        stem = re.sub(r"\.[^.]*$", "", path.rstrip("/").rsplit("/", 1)[-1])
        if stem in out:
            raise ValueError(f"two rasters are named {stem!r}")
        out[stem] = n
    return out


def column_names(bands: list[str], ops: list[str]) -> list[str]:
    return [f"{b}_{op}" for b in bands for op in ops]


def column_names_per_band(bands: list[str], ops: list[str]) -> dict[str, list[str]]:
    return {b: [f"{b}_{op}" for op in ops] for b in bands}


def column_names_per_operation(bands: list[str], ops: list[str]) -> dict[str, list[str]]:
    return {op: [f"{b}_{op}" for b in bands] for op in ops}


def broadcast_list(value, n: int) -> list:
    """A scalar or a list of one for each of n, or the list itself."""
    values = list(value) if isinstance(value, (list, tuple)) else [value]
    if len(values) == 1:
        values = values * n
    if len(values) != n:
        raise ValueError(f"{len(values)} values for {n}")
    return values
