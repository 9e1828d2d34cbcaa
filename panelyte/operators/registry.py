"""A registry of named factors and the plan for any wanted set of them.

A factor is a Column over an entity's rows that may refer to other factors, to columns that a step adds (a grouped pass
such as exponential means), and to the columns of the bars. plan() walks the names from the wanted ones down and applies
as few stages as their depth asks for: all factors of one depth are one select, each step that is needed is applied
once, nothing else is computed. Every stage works by entity, so they share one partitioning.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")


@dataclass(frozen=True)
class Step:
    """A transformation that adds columns; `each` makes it for the wanted ones of its columns alone."""

    adds: Callable[[str], bool]
    apply: Callable[[DataFrame, list[str]], DataFrame]
    needs: tuple[str, ...]


class Registry:
    def __init__(self):
        self._factors: dict[str, Callable[[], Column]] = {}
        self._templates: list[tuple[re.Pattern, Callable[..., Column]]] = []
        self._families: list[Callable[[], dict[str, Column]]] = []
        self._steps: list[Step] = []
        self._seen: dict[str, Column | None] = {}
        self._refers: dict[str, list[str]] = {}

    # registering

    def factor(self, name: str) -> Callable:
        """Decorator: a function without arguments that gives the factor's Column. A name with {n}-like parts stands for
        every whole number there, which the function gets as keyword arguments: "ma{n}" serves ma7 as well as ma250."""

        def add(build: Callable[..., Column]) -> Callable[..., Column]:
            if "{" in name:
                pattern = re.compile("".join(rf"(?P<{p[1:-1]}>[0-9]+)" if p.startswith("{") else re.escape(p) for p in re.split(r"(\{[a-z]+\})", name)))
                self._templates.append((pattern, build))
            else:
                if name in self._factors:
                    raise ValueError(f"{name} is registered already")
                self._factors[name] = build
            self._forget()
            return build

        return add

    def family(self, build: Callable[[DataFrame | None], dict[str, Column]]) -> Callable:
        """Decorator, or call: every factor of a function that gives {name: Column}."""
        self._families.append(build)
        self._forget()
        return build

    def _forget(self) -> None:
        self._seen.clear()
        self._refers.clear()

    def step(self, adds: str | Iterable[str], needs: Iterable[str] = ()) -> Callable:
        """Decorator: a function (rows, names) -> rows that adds the columns of the list, or those that match the
        pattern; names are the ones that the plan wants of them."""

        def add(apply: Callable[[DataFrame, list[str]], DataFrame]) -> Callable:
            holds = re.compile(adds).fullmatch if isinstance(adds, str) else frozenset(adds).__contains__
            self._steps.append(Step(lambda name: bool(holds(name)), apply, tuple(needs)))
            return apply

        return add

    # asking

    def get(self, name: str) -> Column | None:
        """The Column of a factor; None for a name that no factor has. Later registrations hide families and templates."""
        if not self._seen:
            for family in self._families:
                for known, column in family(None).items():
                    self._seen.setdefault(known, column)
        if name in self._factors and name not in self._refers:
            self._seen[name], self._refers[name] = self._factors[name](), []
        if name not in self._seen:
            found = next(((build, m) for pattern, build in self._templates if (m := pattern.fullmatch(name))), None)
            self._seen[name] = found[0](**{k: int(v) for k, v in found[1].groupdict().items()}) if found else None
        return self._seen[name]

    def names(self) -> list[str]:
        """All names that stand for one factor (templates have no end of them)."""
        return sorted({*self._factors, *(n for family in self._families for n in family(None))})

    def needs(self, name: str) -> list[str]:
        """The names that a factor's expression, or the step that adds a column, refers to."""
        column = self.get(name)
        if column is None:
            return [n for s in self._steps if s.adds(name) for n in s.needs]
        if not self._refers.get(name):
            self._refers[name] = sorted(set(_NAME.findall(str(column).removeprefix("Column"))) - {name})
        return self._refers[name]

    def stages(self, wanted: Iterable[str], given: Iterable[str]) -> list[tuple[Step | None, list[str]]]:
        """[(step or None for a select, names it adds)] in order, for the wanted names over given columns."""
        given, depth, under = set(given), {}, []

        def level(name: str) -> int:
            if name in given:
                return 0
            if name in depth:
                return depth[name]
            if name in under:
                raise ValueError(" needs ".join([*under[under.index(name) :], name]))
            known = self.get(name) is not None or any(s.adds(name) for s in self._steps)
            if not known:
                raise KeyError(f"no factor {name}" + (f", needed by {under[-1]}" if under else ""))
            under.append(name)
            parts = [n for n in self.needs(name) if n in given or self._known(n)]
            depth[name] = 1 + max((level(n) for n in parts), default=0)
            under.pop()
            return depth[name]

        for name in wanted:
            level(name)
        out: list[tuple[Step | None, list[str]]] = []
        stepped = {n: next(s for s in self._steps if s.adds(n)) for n in depth if self.get(n) is None}
        for s in {id(s): s for s in stepped.values()}.values():  # a step is applied once, where the last of its inputs is there
            for n, at in stepped.items():
                if at is s:
                    depth[n] = max(depth[m] for m, other in stepped.items() if other is s)
        for k in range(1, max(depth.values(), default=0) + 1):
            now = [n for n, d in depth.items() if d == k]
            for s in {id(stepped[n]): stepped[n] for n in now if n in stepped}.values():
                out.append((s, [n for n in now if stepped.get(n) is s]))
            if plain := [n for n in now if n not in stepped]:
                out.append((None, plain))
        return out

    def _known(self, name: str) -> bool:
        return name in self._factors or self.get(name) is not None or any(s.adds(name) for s in self._steps)

    def plan(self, bars: DataFrame, wanted: list[str], keep: tuple[str, ...] = ("entity", "date")) -> DataFrame:
        """keep and the wanted factors of bars (entity, date and what the factors start from)."""
        rows = bars
        for step, names in self.stages(wanted, bars.columns):
            rows = rows.select("*", *[self.get(n).alias(n) for n in names]) if step is None else step.apply(rows, names)
        return rows.select(*[F.col(c) for c in dict.fromkeys([*keep, *wanted])])
