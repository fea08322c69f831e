"""Single trees: one aggregate over the rows for each level of the tree, all of its open nodes together."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce
from itertools import combinations
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import ModelSettings
from .histogram import Cells, LocalCells, at_hand, cells, long_sums
from .prepare import Prepared, code
from .sampling import sampled
from .splits import Split, best_split


@dataclass
class Node:
    """A node; leaves have no feature. ``codes`` and ``texts`` (categorical) or ``bound`` (numeric, inclusive) say what goes left."""

    id: int
    depth: int
    numerator: float
    denominator: float
    weight: float
    count: int
    feature: str | None = None
    numeric: bool = False
    codes: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    bound: float | None = None
    value: float | None = None
    leaf: int | None = None  # leaves are numbered from 1 by rising ratio

    @property
    def ratio(self) -> float:
        return self.numerator / self.denominator if self.denominator else 0.0


@dataclass
class Tree:
    nodes: dict[int, Node]  # the children of i are 2i and 2i + 1
    features: list[str]

    @property
    def leaves(self) -> list[Node]:
        return sorted((n for n in self.nodes.values() if n.feature is None), key=lambda n: n.leaf or 0)

    @property
    def depth(self) -> int:
        return max(n.depth for n in self.nodes.values())

    @property
    def mean(self) -> float:
        return self.nodes[1].ratio

    def path(self, leaf: Node) -> list[tuple[Node, bool]]:
        """The nodes above a leaf from the root on, and whether the way goes left."""
        out, i = [], leaf.id
        while i > 1:
            out.append((self.nodes[i // 2], i % 2 == 0))
            i //= 2
        return out[::-1]

    def levels_used(self) -> Counter:
        """How many splits use each feature."""
        return Counter(n.feature for n in self.nodes.values() if n.feature)

    def importance(self, pairs: bool = False) -> dict:
        """The share of each feature, or pair of features, in the count of leaves whose way uses it."""
        found: Counter = Counter()
        for leaf in self.leaves:
            used = sorted({n.feature for n, _ in self.path(leaf)}, key=self.features.index)
            found.update(combinations(used, 2) if pairs else used)
        total = sum(found.values())
        return {k: v / total for k, v in found.most_common()}

    def leaf_table(self, spark) -> DataFrame:  # noqa: ANN001
        rows = [(n.leaf, n.id, n.depth, int(n.count), n.weight, n.numerator, n.denominator, n.ratio, " and ".join(condition(m, left) for m, left in self.path(n))) for n in self.leaves]
        return spark.createDataFrame(rows, "leaf int, node long, depth int, n_rows long, weight double, numerator double, denominator double, ratio double, rule string")

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "nodes": [asdict(n) for n in self.nodes.values()]})

    @staticmethod
    def from_json(text: str) -> Tree:
        data = json.loads(text)
        return Tree({n["id"]: Node(**n) for n in data["nodes"]}, data["features"])


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def condition(node: Node, left: bool = True) -> str:
    """What goes to one side of a node, as SQL over values."""
    name = f"`{node.feature}`"
    if node.numeric:
        return f"{name} {'<=' if left else '>'} {node.bound!r}D"
    return f"{name} {'' if left else 'not '}in ({', '.join(map(quoted, node.texts))})"


def _goes_left(node: Node, by_code: bool) -> Column:
    if by_code:
        column = F.col(f"`{code(node.feature)}`")
        return column <= max(node.codes) if node.numeric else column.isin(node.codes)
    column = F.col(f"`{node.feature}`")
    return column.cast("double") <= F.lit(node.bound) if node.numeric else F.coalesce(column.cast("string").isin(node.texts), F.lit(False))


def walk(tree: Tree, result, by_code: bool = False, i: int = 1) -> Column:  # noqa: ANN001
    """Nested cases down to ``result(leaf)``."""
    node = tree.nodes[i]
    if node.feature is None:
        return F.lit(result(node))
    return F.when(_goes_left(node, by_code), walk(tree, result, by_code, 2 * i)).otherwise(walk(tree, result, by_code, 2 * i + 1))


def fit_tree(data: Prepared, settings: ModelSettings, rows: DataFrame | None = None, rng: np.random.Generator | None = None) -> Tree:
    """A tree on the training rows of ``data`` (or on ``rows``, which must have roles and codes)."""
    rng = rng or np.random.default_rng(settings.seed)
    rows = rows if rows is not None else data.rows.where("is_train")
    if settings.sample_rows < 1:
        rows = rows.where(sampled(rows, settings.sample_rows, int(rng.integers(1 << 31))))
    found = cells(rows, data.features, settings.criterion)
    try:
        return grow(data, settings, at_hand(found, data.features) or found, rng)
    finally:
        found.free()


class Frontier:
    """The rows of open nodes, which carry their node's number from level to level; each level's sums are one aggregate over them."""

    def __init__(self, base: Cells, features: list[str]):
        self.features, self.wanted = features, base.sums
        self.rows, self.held = base.rows.withColumn("node", F.lit(1).cast("long")), None

    def sums(self, chosen: list[str], much: bool) -> dict | DataFrame:
        """The open nodes' level sums; if they are too much for the driver, the table that has them."""
        found = level_table(self.rows, chosen, self.wanted)
        return found if much else _by_node(found.toArrow(), chosen)

    def split(self, done: list[Node], still: frozenset[int]) -> None:
        before, self.rows = self.held, advance(self.rows, done, self.features, still).persist(StorageLevel.MEMORY_AND_DISK)
        if before is not None:
            self.rows.count()  # kept before what it is made of goes
            before.unpersist()
        self.held = self.rows

    def close(self) -> None:
        if self.held is not None:
            self.held.unpersist()


class LocalFrontier:
    """The same for cells at hand."""

    def __init__(self, base: LocalCells, pools: Counter):
        self.base, self.pools = base, pools
        self.node = np.ones(len(base.sums["c"]), dtype=np.int64)

    def sums(self, chosen: list[str], much: bool) -> dict:
        nodes, place = np.unique(self.node, return_inverse=True)
        out: dict[int, dict] = {int(i): {} for i in nodes if i}
        for f in chosen:
            pool = self.pools[f]
            key = place * pool + self.base.codes[f]
            table = {s: np.bincount(key, v, len(nodes) * pool).reshape(-1, pool) for s, v in self.base.sums.items()}
            for k, i in enumerate(nodes):
                if i:
                    codes = np.flatnonzero(table["c"][k])
                    out[int(i)][f] = (codes, {s: v[k, codes] for s, v in table.items()})
        return out

    def split(self, done: list[Node], still: frozenset[int]) -> None:
        new = np.zeros_like(self.node)
        for n in done:
            at = np.flatnonzero(self.node == n.id)
            codes = self.base.codes[n.feature][at]
            new[at] = 2 * n.id + ~(codes <= n.codes[0] if n.numeric else np.isin(codes, n.codes))
        self.node = np.where(np.isin(new, list(still)), new, 0)

    def close(self) -> None:
        pass


def leaves_of(tree: Tree, codes: dict[str, np.ndarray]) -> np.ndarray:
    """The number of the leaf of each of some combinations of codes."""
    node = np.ones(len(next(iter(codes.values()))), dtype=np.int64)
    for n in sorted((n for n in tree.nodes.values() if n.feature), key=lambda n: n.id):
        at = np.flatnonzero(node == n.id)
        values = codes[n.feature][at]
        node[at] = 2 * n.id + ~(values <= n.codes[0] if n.numeric else np.isin(values, n.codes))
    number = {n.id: n.leaf for n in tree.leaves}
    found, place = np.unique(node, return_inverse=True)
    return np.array([number[int(i)] for i in found])[place]


def grow(data: Prepared, settings: ModelSettings, base: Cells | LocalCells, rng: np.random.Generator) -> Tree:
    """A tree on sums."""
    levels = data.levels.collect()  # at most MOST_LEVELS a feature
    pools = Counter(r["feature"] for r in levels)
    texts = {(r["feature"], r["code"]): r["text"] for r in levels}
    bounds = {(r["feature"], r["code"]): r["number"] for r in levels}
    chosen = _sampled(data.features, settings.sample_features, rng)
    front = LocalFrontier(base, pools) if isinstance(base, LocalCells) else Frontier(base, data.features)
    sides = front.sums(chosen, False)
    # every feature's levels add up to the node's rows, so the first pass also gives the root
    whole = {s: float(v.sum()) for s, v in next(iter(sides[1].values()))[1].items()} if sides else dict.fromkeys("ndwc", 0.0)
    tree = Tree({1: Node(1, 0, whole["n"], whole["d"], whole["w"], int(round(whole["c"])))}, data.features)
    root = tree.nodes[1]
    least = root.weight * -settings.min_weight if settings.min_weight < 0 else settings.min_weight
    open_nodes = [1] if sides and root.weight >= 2 * least and settings.max_depth > 0 else []
    while open_nodes:
        find = Search(chosen, set(data.numeric), dict(pools), settings, least, int(rng.integers(1 << 31)) if settings.random_top else 0)
        cuts = {i: find.best(i, sides[i]) for i in open_nodes if i in sides} if isinstance(sides, dict) else find.on_executors(sides)
        following, done = [], []
        for i in open_nodes:
            cut, node = cuts.get(i), tree.nodes[i]
            if cut is None:
                continue
            split = cut.split
            node.feature, node.numeric, node.value = split.feature, split.numeric, split.value
            node.codes = [max(split.left)] if split.numeric else sorted(split.left)
            if split.numeric:
                node.bound = bounds[split.feature, node.codes[0]]
            else:
                node.texts = [texts[split.feature, c] for c in node.codes]
            done.append(node)
            for child, part in ((2 * i, cut.left), (2 * i + 1, cut.right)):
                tree.nodes[child] = Node(child, node.depth + 1, part["n"], part["d"], part["w"], int(round(part["c"])))
                if part["w"] >= 2 * least and node.depth + 1 < settings.max_depth:
                    following.append(child)
        open_nodes = sorted(following)
        if open_nodes:
            if not settings.random_only_at_root:
                chosen = _sampled(data.features, settings.sample_features, rng)
            front.split(done, frozenset(open_nodes))
            sides = front.sums(chosen, len(open_nodes) * sum(pools[f] for f in chosen) > DRIVER_LEVELS)
    front.close()
    for number, leaf in enumerate(sorted((n for n in tree.nodes.values() if n.feature is None), key=lambda n: (n.ratio, n.id)), 1):
        leaf.leaf = number
    return tree


#: So many sums of a level of the tree are searched on the driver, some megabytes; more on executors, with the same result.
DRIVER_LEVELS = 200_000


def level_table(rows: DataFrame, features: list[str], sums: list[str]) -> DataFrame:
    return long_sums(rows, {f: code(f) for f in features}, sums)


def advance(rows: DataFrame, done: list[Node], features: list[str], still: frozenset[int]) -> DataFrame:
    """The rows of nodes that are split, with their child's number, of those children that stay open. The splits, one row for each node of a level, are broadcast."""
    table = rows.sparkSession.createDataFrame([(n.id, features.index(n.feature) + 1, [int(c) for c in n.codes], n.numeric, 2 * n.id in still, 2 * n.id + 1 in still) for n in done], "node long, _at int, _codes array<int>, _numeric boolean, _l boolean, _r boolean")
    level = F.element_at(F.array(*[F.col(f"`{code(f)}`") for f in features]), F.col("_at"))
    left = F.when(F.col("_numeric"), level <= F.col("_codes")[0]).otherwise(F.array_contains("_codes", level))
    out = rows.join(F.broadcast(table), "node").withColumn("_left", left).where(F.when(F.col("_left"), F.col("_l")).otherwise(F.col("_r")))
    return out.select(F.when(F.col("_left"), F.col("node") * 2).otherwise(F.col("node") * 2 + 1).alias("node"), *[c for c in (f"`{x}`" for x in rows.columns if x != "node")])


@dataclass
class Cut:
    """A node's split with the sums c, n, d and w of both sides."""

    split: Split
    left: dict[str, float]
    right: dict[str, float]


@dataclass
class Search:
    """The search for splits of nodes; the same on driver and executors, as a node's random choice depends on its number and ``salt`` alone."""

    features: list[str]
    numeric: set[str]
    pools: dict[str, int]
    settings: ModelSettings
    least: float
    salt: int

    def best(self, node: int, sums: dict) -> Cut | None:
        top = self.settings.random_top if node == 1 or not self.settings.random_only_at_root else 0.0
        rng = np.random.default_rng([self.salt, node])
        split = best_split(sums, self.numeric, self.pools, self.settings.criterion, self.least, self.settings.sort_categories_above, top, rng)
        if split is None:
            return None
        codes, parts = sums[split.feature]
        left = codes <= max(split.left) if split.numeric else np.isin(codes, split.left)
        return Cut(split, *({s: float(parts[s][side].sum()) for s in "cndw"} for side in (left, ~left)))

    def on_executors(self, found: DataFrame) -> dict[int, Cut]:
        """One row for each node comes to the driver."""

        def run(key: tuple, table: pa.Table) -> pa.Table:
            node = key[0].as_py()
            cut = self.best(node, _by_node(table, self.features)[node])
            rows = [] if cut is None else [{"node": node, "feature": cut.split.feature, "numeric": cut.split.numeric, "codes": cut.split.left, "value": cut.split.value, "sums": [*cut.left.values(), *cut.right.values()]}]
            return pa.Table.from_pylist(rows, schema=pa.schema([("node", pa.int64()), ("feature", pa.string()), ("numeric", pa.bool_()), ("codes", pa.list_(pa.int32())), ("value", pa.float64()), ("sums", pa.list_(pa.float64()))]))

        rows = found.groupBy("node").applyInArrow(run, "node long, feature string, numeric boolean, codes array<int>, value double, sums array<double>").collect()
        return {r["node"]: Cut(Split(r["feature"], r["numeric"], r["codes"], r["value"], r["sums"][3], r["sums"][7]), dict(zip("cndw", r["sums"][:4], strict=True)), dict(zip("cndw", r["sums"][4:], strict=True))) for r in rows}


def _sampled(features: list[str], share: float, rng: np.random.Generator) -> list[str]:
    if share >= 1:
        return features
    pick = sorted(rng.choice(len(features), max(1, int(np.ceil(len(features) * share))), replace=False))
    return [features[i] for i in pick]


def _by_node(found, features: list[str]) -> dict[int, dict]:  # noqa: ANN001
    """node -> feature -> (codes, sums), features in their own order, codes rising."""
    names = [c for c in found.column_names if c not in ("node", "feature", "level")]
    nodes, levels = found["node"].to_numpy(), found["level"].to_numpy()
    feature = np.array([features.index(f) for f in found["feature"].to_pylist()], dtype=int)
    values = {c: found[c].to_numpy().astype(float) for c in names}
    order = np.lexsort((levels, feature, nodes))
    out: dict[int, dict] = {}
    if not len(order):
        return out
    edge = np.flatnonzero(np.append(True, (np.diff(nodes[order]) != 0) | (np.diff(feature[order]) != 0)))
    for a, b in zip(edge, [*edge[1:], len(order)], strict=True):
        part = order[a:b]
        out.setdefault(int(nodes[part[0]]), {})[features[feature[part[0]]]] = (levels[part], {c: v[part] for c, v in values.items()})
    return out


#: A nested case of more leaves than this could pass the JVM's limit for a method and would then be interpreted.
NESTED_LEAVES = 64


def with_leaf(df: DataFrame, tree: Tree, columns: dict[str, Callable[[Node], Any]], by_code: bool = False) -> DataFrame:
    """``df`` with a column for each of ``columns``, a function of the leaf. Large trees go level by level, with the nodes' splits in a map, and look the leaf up in a broadcast table."""
    if len(tree.leaves) <= NESTED_LEAVES:
        out = df.withColumn("_leaf", walk(tree, lambda n: n.leaf, by_code))
        return out.withColumns({name: _lookup(F.col("_leaf"), [f(n) for n in tree.leaves]) for name, f in columns.items()}).drop("_leaf")
    out = df.withColumn("_node", F.lit(1).cast("long"))
    for depth in range(tree.depth):
        inner = [n for n in tree.nodes.values() if n.depth == depth and n.feature]
        step = reduce(lambda e, n: e.when(F.col("_node") == n.id, F.when(_goes_left(n, by_code), 2 * n.id).otherwise(2 * n.id + 1)), inner[1:], F.when(F.col("_node") == inner[0].id, F.when(_goes_left(inner[0], by_code), 2 * inner[0].id).otherwise(2 * inner[0].id + 1)))
        out = out.withColumn("_node", F.coalesce(step, F.col("_node")).cast("long"))
    kinds = ", ".join(f"`{name}` {'int' if isinstance(f(tree.leaves[0]), int) else 'double'}" for name, f in columns.items())
    table = df.sparkSession.createDataFrame([(n.id, *(f(n) for f in columns.values())) for n in tree.leaves], f"_node long, {kinds}")
    return out.join(F.broadcast(table), "_node").drop("_node")  # a row for each leaf


def apply_tree(df: DataFrame, tree: Tree, fitted: str = "fitted", leaf: str = "leaf") -> DataFrame:
    """``df`` with the ratio and the number of the leaf of each row, by the features' values. Levels that training has not seen go right."""
    return with_leaf(df, tree, {leaf: lambda n: n.leaf, fitted: lambda n: float(n.ratio)})


def _lookup(place: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), place)


def check_features(df: DataFrame, tree: Tree) -> None:
    if missing := [f for f in tree.levels_used() if f not in df.columns]:
        raise ValueError(f"the model needs columns that are not there: {', '.join(missing)}")


def predict_tree(df: DataFrame, tree: Tree) -> DataFrame:
    check_features(df, tree)
    return apply_tree(df, tree)


def importance_table(trees: list[Tree], spark, pairs: bool = False) -> DataFrame:  # noqa: ANN001
    """feature (or feature, other), importance: the trees' importances summed and scaled to 1."""
    total: Counter = Counter()
    for tree in trees:
        total.update(tree.importance(pairs))
    scale = sum(total.values()) or 1.0
    rows = [(*(k if pairs else (k,)), v / scale) for k, v in total.most_common()]
    return spark.createDataFrame(rows, "feature string, other string, importance double" if pairs else "feature string, importance double")
