"""One registered query per operator, each beside its SQL counterpart."""

from importlib import import_module
from pkgutil import iter_modules

from tarn.checks.base import ORACLES, QUERIES

for _m in sorted(m.name for m in iter_modules(__path__)):
    import_module(f"{__name__}.{_m}")

__all__ = ["ORACLES", "QUERIES"]
