"""DOT text for patterns, morphisms and trajectories."""

from __future__ import annotations

from ..pattern import Morphism, Pattern, Var


def pattern_dot(p: Pattern, name: str = "G", prefix: str = "") -> str:
    ident = lambda o, k: f'"{prefix}{o}_{k}"'
    lines = []
    for o, k in p.elements():
        attrs = "".join(f"\\n{a}={'?' if isinstance(p.attrs[a][k], Var) else p.attrs[a][k]}" for a in p.schema.attrs_of(o))
        lines.append(f'  {ident(o, k)} [label="{o} {k}{attrs}"];')
    for h, f in p.homs.items():
        s, t = p.schema.homs[h]
        lines += [f'  {ident(s, k)} -> {ident(t, v)} [label="{h}"];' for k, v in f.items()]
    return "\n".join([f"digraph {name} {{", *lines, "}"])


def morphism_dot(f: Morphism) -> str:
    body = lambda p, tag: pattern_dot(p, "x", tag).split("\n")[1:-1]
    lines = ["digraph f {", " subgraph cluster_0 {", *body(f.dom, "d"), " }", " subgraph cluster_1 {", *body(f.cod, "c"), " }"]
    lines += [f'  "d{o}_{k}" -> "c{o}_{v}" [style=dashed];' for o, m in f.maps.items() for k, v in m.items()]
    return "\n".join([*lines, "}"])


def trajectory_dot(log: list[tuple]) -> str:
    lines = [f'  s{i} [label="{box}: {said}"];' for i, (_, box, _, said) in enumerate(log)]
    lines += [f'  s{i} -> s{i + 1} [label="{log[i][2]}"];' for i in range(len(log) - 1)]
    return "\n".join(["digraph trajectory {", *lines, "}"])
