"""Facts in named slots (os, shell, runtime ...) against what a question says outright."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Slots whose values carry versions or editions, and what goes with which system.
TECH_SLOTS = ("os", "shell", "package_manager", "database", "runtime", "container")
UNIX = ("linux", "macos")
UNIX_SHELLS = ("bash", "zsh")
WINDOWS_SHELLS = ("powershell", "cmd")


def contradicted(slot: Column, value: Column, explicit: Column) -> Column:
    """Whether a fact can't hold beside ``explicit`` (map of slot to values; a leading ! rules a value out).

    In technical slots ``x`` and ``x 1.2`` agree, whichever side has more words; elsewhere only equal values do. A
    shell also contradicts a system that it doesn't run on, and the other way round. A null value agrees with nothing; a null map says nothing.
    """
    v = F.lower(F.coalesce(value, F.lit("")))
    none = F.array().cast("array<string>")
    said = lambda s: F.transform(F.coalesce(F.try_element_at(explicit, s), none), lambda x: F.lower(x))
    wanted = lambda s: F.filter(said(s), lambda x: ~F.startswith(x, F.lit("!")))
    off = F.transform(F.filter(said(slot), lambda x: F.startswith(x, F.lit("!"))), lambda x: F.substring(x, 2, 1 << 30))
    tech = slot.isin(*TECH_SLOTS)
    agrees = lambda x: (v == x) | (tech & (F.startswith(v, F.concat(x, F.lit(" "))) | F.startswith(x, F.concat(v, F.lit(" ")))))
    direct = F.exists(off, agrees) | ((F.size(wanted(slot)) > 0) & ~F.exists(wanted(slot), agrees))
    systems, shells = wanted(F.lit("os")), wanted(F.lit("shell"))
    any_of = lambda xs, names: F.exists(xs, lambda x: x.isin(*names))
    holds = lambda names: F.exists(F.array(*map(F.lit, names)), lambda x: F.contains(v, x))
    unix = F.forall(systems, lambda x: x.isin(*UNIX))
    by_shell = (slot == "shell") & (F.size(systems) > 0) & F.when(unix, holds(WINDOWS_SHELLS)).otherwise(holds(UNIX_SHELLS))
    by_system = (slot == "os") & ((any_of(shells, UNIX_SHELLS) & (v == "windows")) | (any_of(shells, WINDOWS_SHELLS) & v.isin(*UNIX)))
    return F.coalesce(direct | by_shell | by_system, F.lit(False))
