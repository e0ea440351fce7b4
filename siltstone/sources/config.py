"""User settings from TOML: a global file, and one of the working folder that may override it."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from ..operators.filters import merge_skips

#: Bytes of the local cache, unless set.
CACHE_SIZE = 1 << 30
_UNITS = {"": 1, "k": 10**3, "m": 10**6, "g": 10**9, "t": 10**12}


@dataclass
class Settings:
    """``skips`` of the working folder replace the global ones; its ``output`` wins if set; its cache size
    does not count."""

    cache_size: int = CACHE_SIZE
    skips: list[str] = field(default_factory=list)
    dereference: bool = False
    output: str | None = None

    def skips_with(self, args: list[str]) -> list[str]:
        return merge_skips(self.skips, args)


def _bytes(value: int | str) -> int:
    if isinstance(value, int):
        return value
    m = re.fullmatch(r"\s*([0-9.]+)\s*([kmgt]?)(i?)b?\s*", value, re.I)
    if not m:
        raise ValueError(f"{value!r} is no size")
    unit = _UNITS[m[2].lower()]
    return int(float(m[1]) * (1 << (10 * "kmgt".index(m[2].lower()) + 10) if m[3] and m[2] else unit))


def _read(path: str | Path | None) -> dict | None:
    if path is None or not Path(path).is_file():
        return None
    return tomllib.loads(Path(path).read_text())


def load(main: str | Path | None, local: str | Path | None = None) -> Settings:
    """Settings of the two files; either may be missing."""
    out = Settings()
    for values, own in ((_read(main), False), (_read(local), True)):
        if values is None:
            continue
        out.skips = list(values.get("skips", []))
        out.output = values.get("restore", {}).get("output", out.output)
        if not own:
            out.cache_size = _bytes(values.get("cache_size", CACHE_SIZE))
            out.dereference = bool(values.get("backup", {}).get("dereference", False))
    return out
