"""Fitted models as text: Spark SQL, SAS, C#, VBA, DOT, and an indented listing."""

from __future__ import annotations

import json
from collections.abc import Callable

from ..operators.boost import Boosted
from ..operators.tree import Node, Tree, condition


def tree_sql(tree: Tree, value: Callable[[Node], str] | None = None, i: int = 1) -> str:
    """One nested ``case`` over the features' values, for Spark SQL."""
    value = value or (lambda n: f"{n.ratio!r}D")
    node = tree.nodes[i]
    if node.feature is None:
        return value(node)
    return f"case when {condition(node)} then {tree_sql(tree, value, 2 * i)} else {tree_sql(tree, value, 2 * i + 1)} end"


def boosted_sql(model: Boosted) -> str:
    """The raw estimate as one expression."""
    parts = [tree_sql(t, lambda n, r=r: f"{(n.ratio - 1.0) * r + 1.0!r}D") for t, r in zip(model.trees, model.rates, strict=True)]
    return " * ".join([f"{model.mean!r}D", *[f"({p})" for p in parts]])


def tree_text(tree: Tree) -> str:
    """Nodes and leaves, a line each, indented by depth, then the features' importance."""
    lines: list[str] = []

    def write(i: int) -> None:
        node = tree.nodes[i]
        pad = "  " * node.depth
        if node.feature is None:
            lines.append(f"{pad}leaf {node.leaf}: ratio {node.ratio:.6g}, weight {node.weight:.6g}, rows {node.count}")
        else:
            lines.append(f"{pad}node {i}: {condition(node)}")
            write(2 * i)
            write(2 * i + 1)

    write(1)
    lines += ["", "importance", *(f"  {k}: {v:.4f}" for k, v in tree.importance().items())]
    return "\n".join(lines) + "\n"


def tree_dot(tree: Tree) -> str:
    """A digraph; left branches are those where the condition holds."""
    out = ["digraph tree {", "  node [shape=box];"]
    for i, node in sorted(tree.nodes.items()):
        label = f"leaf {node.leaf}\\nratio {node.ratio:.6g}\\nweight {node.weight:.6g}" if node.feature is None else condition(node).replace("`", "").replace('"', "'").replace("\\", "\\\\")
        out.append(f'  n{i} [label="{label}"];')
        if node.feature is not None:
            out += [f'  n{i} -> n{2 * i} [label="yes"];', f'  n{i} -> n{2 * i + 1} [label="no"];']
    return "\n".join([*out, "}"]) + "\n"


def _branches(tree: Tree, test: Callable[[Node], str], leaf: Callable[[Node], str], shape: tuple[str, str, str], i: int = 1, depth: int = 0) -> list[str]:
    """The tree as nested branches of another language: ``shape`` is how a branch opens, turns and closes."""
    node, pad = tree.nodes[i], "  " * depth
    if node.feature is None:
        return [pad + leaf(node)]
    opens, turns, closes = shape
    return [pad + opens.format(test(node)), *_branches(tree, test, leaf, shape, 2 * i, depth + 1), pad + turns, *_branches(tree, test, leaf, shape, 2 * i + 1, depth + 1), *([pad + closes] if closes else [])]


def _name(feature: str) -> str:
    return "".join(c if c.isalnum() else "_" for c in feature)


def _trees(model: Tree | Boosted) -> tuple[list[Tree], list[float] | None, float]:
    return (model.trees, model.rates, model.mean) if isinstance(model, Boosted) else ([model], None, 1.0)


def _leaf_value(node: Node, rate: float | None) -> float:
    return node.ratio if rate is None else (node.ratio - 1.0) * rate + 1.0


def sas(model: Tree | Boosted) -> str:
    """A data step's statements that set ``estimate`` (and, for boosted models, ``score``)."""
    def test(node: Node) -> str:
        if node.numeric:
            return f"{_name(node.feature)} <= {node.bound!r}"
        return f"upcase({_name(node.feature)}) in ({', '.join(chr(39) + t.upper().replace(chr(39), chr(39) * 2) + chr(39) for t in node.texts)})"

    trees, rates, mean = _trees(model)
    out = [f"estimate = {mean!r};"]
    for i, tree in enumerate(trees):
        rate = rates[i] if rates else None
        out += [f"/* tree {i + 1} */", *_branches(tree, test, lambda n, r=rate: f"estimate = estimate * {_leaf_value(n, r)!r};", ("if {} then do;", "end; else do;", "end;"))]
    if isinstance(model, Boosted):
        out += [f"relativity = estimate / {mean!r};", *_score_lines(model, "if relativity <= {} then do; score = {}; smoothed = {}; end;", "else do; score = {}; smoothed = {}; end;", "else ")]
    return "\n".join(out) + "\n"


def _score_lines(model: Boosted, some: str, last: str, joint: str) -> list[str]:
    table = model.scores
    lines = [some.format(repr(b), i, repr(s)) for b, i, s in zip(table.bounds, table.numbers, table.smoothed, strict=False)]
    lines = [line if i == 0 else joint + line for i, line in enumerate(lines)]
    return [*lines, last.format(table.numbers[-1], repr(table.smoothed[-1])) if lines else f"score = 1; smoothed = {table.smoothed[-1]!r};"]


def csharp(model: Tree | Boosted, name: str = "Model") -> str:
    """A static class: one method for each tree, one for the estimate, and for boosted models one for the score."""
    trees, rates, mean = _trees(model)
    kinds = {n.feature: n.numeric for t in trees for n in t.nodes.values() if n.feature}
    takes = ", ".join(f"{'double' if numeric else 'string'} {_name(f)}" for f, numeric in kinds.items())
    passes = ", ".join(map(_name, kinds))

    def test(node: Node) -> str:
        if node.numeric:
            return f"{_name(node.feature)} <= {node.bound!r}"
        return " || ".join(f"{_name(node.feature)} == {json.dumps(t)}" for t in node.texts)

    out = [f"public static class {name}", "{"]
    for i, tree in enumerate(trees):
        rate = rates[i] if rates else None
        body = _branches(tree, test, lambda n, r=rate: f"return {_leaf_value(n, r)!r};", ("if ({}) {{", "} else {", "}"))
        out += [f"  public static double Tree{i + 1}({takes})", "  {", *(f"    {line}" for line in body), "  }"]
    product = " * ".join([repr(mean), *[f"Tree{i + 1}({passes})" for i in range(len(trees))]])
    out += [f"  public static double Estimate({takes})", "  {", f"    return {product};", "  }"]
    if isinstance(model, Boosted):
        bounds = ", ".join(map(repr, model.scores.bounds))
        out += ["  public static int Score(double relativity)", "  {", f"    double[] bounds = {{ {bounds} }};", f"    int[] numbers = {{ {', '.join(map(str, model.scores.numbers))} }};", "    int i = 0;", "    while (i < bounds.Length && relativity > bounds[i]) i++;", "    return numbers[i];", "  }"]
    return "\n".join([*out, "}"]) + "\n"


def vba(model: Tree | Boosted) -> str:
    """Functions for a spreadsheet: one for each tree, and the estimate."""
    trees, rates, mean = _trees(model)
    names = list(dict.fromkeys(n.feature for t in trees for n in t.nodes.values() if n.feature))
    takes = ", ".join(f"{_name(f)} As Variant" for f in names)
    passes = ", ".join(map(_name, names))

    def test(node: Node) -> str:
        if node.numeric:
            return f"{_name(node.feature)} <= {node.bound!r}"
        return " Or ".join("UCase({}) = \"{}\"".format(_name(node.feature), t.upper().replace('"', '""')) for t in node.texts)

    out: list[str] = []
    for i, tree in enumerate(trees):
        rate = rates[i] if rates else None
        body = _branches(tree, test, lambda n, r=rate, i=i: f"Tree{i + 1} = {_leaf_value(n, r)!r}", ("If {} Then", "Else", "End If"))
        out += [f"Function Tree{i + 1}({takes}) As Double", *(f"  {line}" for line in body), "End Function", ""]
    out += [f"Function Estimate({takes}) As Double", "  Estimate = " + " * ".join([repr(mean), *[f"Tree{i + 1}({passes})" for i in range(len(trees))]]), "End Function"]
    return "\n".join(out) + "\n"


def chart_data(report, kind: str, x: str, y: list[str]) -> dict:  # noqa: ANN001
    """What a chart shows, from a report's table: its kind, the names, and the values in order of x."""
    rows = report.select(x, *y).orderBy(x).collect()  # a report has a row for each band, leaf or level
    return {"kind": kind, "x": {x: [r[0] for r in rows]}, "y": {c: [r[c] for r in rows] for c in y}}
