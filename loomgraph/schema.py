"""Schemas: tables, foreign keys, attributes and path equations."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Schema:
    """``homs``: name -> (table, table); ``attrs``: name -> (table, Spark type); ``eqs``: pairs of hom paths."""

    obs: tuple[str, ...]
    homs: dict[str, tuple[str, str]] = field(default_factory=dict)
    attrs: dict[str, tuple[str, str]] = field(default_factory=dict)
    eqs: tuple[tuple[tuple[str, ...], tuple[str, ...]], ...] = ()

    def __post_init__(self):
        for h, (s, t) in self.homs.items():
            if s not in self.obs or t not in self.obs:
                raise ValueError(f"hom {h}: unknown table in {s} -> {t}")
        for a, (s, _) in self.attrs.items():
            if s not in self.obs:
                raise ValueError(f"attribute {a}: unknown table {s}")
        for left, right in self.eqs:
            if self.path_ends(left) != self.path_ends(right):
                raise ValueError(f"paths {left} and {right} are not parallel")

    def path_ends(self, path: tuple[str, ...]) -> tuple[str, str]:
        for f, g in zip(path, path[1:]):
            if self.homs[f][1] != self.homs[g][0]:
                raise ValueError(f"{f} and {g} don't compose")
        return self.homs[path[0]][0], self.homs[path[-1]][1]

    def homs_from(self, ob: str) -> list[str]:
        return [h for h, (s, _) in self.homs.items() if s == ob]

    def homs_to(self, ob: str) -> list[str]:
        return [h for h, (_, t) in self.homs.items() if t == ob]

    def attrs_of(self, ob: str) -> list[str]:
        return [a for a, (s, _) in self.attrs.items() if s == ob]

    def topological(self) -> list[str]:
        """Tables so that foreign keys point backwards; ``ValueError`` if they form a cycle."""
        left, out = set(self.obs), []
        while left:
            ready = [o for o in self.obs if o in left and not any(self.homs[h][1] in left for h in self.homs_from(o))]
            if not ready:
                raise ValueError("foreign keys form a cycle")
            out += ready
            left -= set(ready)
        return out

    def is_cyclic(self) -> bool:
        try:
            self.topological()
        except ValueError:
            return True
        return False

    def extend(self, obs=(), homs=None, attrs=None, eqs=()) -> Schema:
        return Schema((*self.obs, *obs), {**self.homs, **(homs or {})}, {**self.attrs, **(attrs or {})}, (*self.eqs, *eqs))

    def without_attrs(self) -> Schema:
        return Schema(self.obs, dict(self.homs), {}, self.eqs)

    def ddl(self, ob: str) -> str:
        return ", ".join(["id bigint", *(f"`{h}` bigint" for h in self.homs_from(ob)), *(f"`{a}` {self.attrs[a][1]}" for a in self.attrs_of(ob))])


GRAPH = Schema(("V", "E"), {"src": ("E", "V"), "tgt": ("E", "V")})


def weighted_graph(kind: str = "bigint") -> Schema:
    return GRAPH.extend(attrs={"weight": ("E", kind)})
