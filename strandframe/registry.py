"""Feature plug-ins: DataFrame functions over the atom table, with what they support."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .operators.joins import combine_features


@dataclass
class Feature:
    name: str
    fn: Callable[..., DataFrame]
    supported: tuple[str, ...] | None = None
    reason: str = ""
    defaults: dict[str, dict] = field(default_factory=dict)
    group: tuple[str, ...] = ()


FEATURES: dict[str, Feature] = {}
# Shorthands for several features.
SHORTHANDS = {"melodia": ("curvature", "writhing", "torsion", "arc_length", "phi", "psi")}
# End of the fixed values.


def register_feature(name: str, fn: Callable[..., DataFrame], supported: tuple[str, ...] | None = None, reason: str = "", defaults: dict[str, dict] | None = None) -> None:
    """fn(atoms, **options) -> (structure, chain, resid, values). defaults: options for a residue, under the user's."""
    FEATURES[name] = Feature(name, fn, supported, reason, defaults or {})


def scan_plugins(package) -> dict[str, str]:
    """Import every module of a package, each of which registers its features; the failures by name."""
    failed = {}
    for m in pkgutil.iter_modules(package.__path__):
        try:
            importlib.import_module(f"{package.__name__}.{m.name}")
        except Exception as e:  # noqa: BLE001
            failed[m.name] = str(e)
    return failed


def resolve(wanted: list[str] | dict[str, dict], residue: str) -> tuple[list[tuple[Feature, dict]], dict[str, str]]:
    """(features with their options, dropped ones with the reason)."""
    options = wanted if isinstance(wanted, dict) else {w: {} for w in wanted}
    names = [n for w in options for n in (FEATURES if w == "all" else SHORTHANDS.get(w, (w,)))]
    kept, dropped = [], {}
    for n in dict.fromkeys(names):
        if n not in FEATURES:
            dropped[n] = "not registered"
            continue
        f = FEATURES[n]
        if f.supported is not None and residue not in f.supported:
            dropped[n] = f.reason or f"not for {residue}"
        else:
            kept.append((f, f.defaults.get(residue, {}) | options.get(n, {})))
    return kept, dropped


def measure(atoms: DataFrame, base: DataFrame, wanted, residue: str, how: str = "inner") -> tuple[DataFrame, dict[str, str]]:
    """Join the features of all structures onto `base` (structure, chain, resid, ...)."""
    kept, dropped = resolve(wanted, residue)
    frames = [f.fn(atoms, **options) for f, options in kept]
    return combine_features([base, *frames], ["structure", "chain", "resid"], how), dropped
