"""Trees, boosting and their reports in SQL for DuckDB, unrolled level by level, as an independent check of the model queries.

Rows are summed to different combinations of feature values (``cells``), training rows apart from others. Each level of a tree lists every
split of every open node, takes the best, and sends the cells to its children. Values that agree in ten digits are ties, which go to the
earlier feature and the earlier split, as in the engine.
"""

from __future__ import annotations

NUMERIC, CATEGORICAL = ["l_quantity", "l_tax", "l_linenumber"], ["l_returnflag", "l_linestatus"]
FEATURES = [*NUMERIC, *CATEGORICAL]

#: Criteria over sums of the left (l), right (r) and both (t) sides.
VALUES = {
    "difference": "abs(ln / ld - rn / rd)",
    "poissondeviance": "ln * ln(ln / ld) + rn * ln(rn / rd) - tn * ln(tn / td)",
    "sse": "ln * ln / ld + rn * rn / rd - tn * tn / td",
}


SUMS = """sum(n) as n, sum(d) as d, sum(w) as w, cast(count(*) as double) as c, sum(n / d) as r, sum((n / d) * (n / d)) as r2, sum(n * n) as nn, sum(n * d) as nd, sum(d * d) as dd,
  sum(case when n > 0 then n * ln(d / n) else 0 end) as nl"""


def cells(source: str, train: str = "is_train", features: list[str] = FEATURES, name: str = "cells", more: str = "") -> str:
    """``{name}``: feature values, is_train, and sums of rows of ``source`` (with n, d, w)."""
    return f"{name} as materialized (select {', '.join(features)}, cast({train} as boolean) as is_train, {more} {SUMS} from {source} group by all)"


def hashed(key: str, seed: int) -> str:
    return f"cast('0x' || substr(md5({key} || ':{seed}'), 1, 15) as bigint)"


def cutoff(source: str, share: float) -> str:
    """The hash (column h) up to which ``share`` of the rows of ``source`` go."""
    return f"(select max(h) from (select h, row_number() over (order by h) as i, count(*) over () as m from {source}) where i <= round({share} * m))"


def tree(name: str, base: str, criterion: str, least: float, depth: int, features: list[str] = FEATURES) -> str:
    """CTEs of a tree on the training cells of ``base``: ``{name}`` (cells with node), ``{name}_nodes`` (node, depth, sums, and how its split reads) and ``{name}_leaves`` (node, leaf, depth, sums, ratio)."""
    out = [f"{name}_0 as materialized (select *, cast(1 as bigint) as node from {base})", f"{name}_least as materialized (select {least} * sum(w) as least from {base} where is_train)"]
    for k in range(depth):
        live = f"(select * from {name}_{k} where is_train and node >= {2**k})"
        out.append(f"{name}_t{k} as materialized (select node, sum(n) as tn, sum(d) as td, sum(w) as tw from {live} group by 1 having sum(w) >= 2 * (select least from {name}_least))")
        found = []
        for i, f in enumerate(features):
            if f in NUMERIC:
                out.append(f"""{name}_c{k}_{i} as (select node, {i} as feat, row_number() over up as pos, cast({f} as double) as bound, cast(null as varchar[]) as left_set, cast(null as varchar[]) as right_set,
  sum(n) over up as ln, sum(d) over up as ld, sum(w) over up as lw from (select node, {f}, sum(n) as n, sum(d) as d, sum(w) as w from {live} group by all) window up as (partition by node order by {f} rows between unbounded preceding and current row))""")
            else:
                out.append(f"{name}_l{k}_{i} as materialized (select node, {f} as level, row_number() over (partition by node order by {f}) - 1 as place, count(*) over (partition by node) as k, sum(n) as n, sum(d) as d, sum(w) as w from {live} group by 1, 2)")
                out.append(f"""{name}_c{k}_{i} as (select node, {i} as feat, i as pos, cast(null as double) as bound, list(level order by level) filter ((xor(i, i >> 1) >> place) & 1 = 1) as left_set,
  list(level order by level) filter ((xor(i, i >> 1) >> place) & 1 = 0) as right_set, sum(n) filter ((xor(i, i >> 1) >> place) & 1 = 1) as ln, sum(d) filter ((xor(i, i >> 1) >> place) & 1 = 1) as ld,
  sum(w) filter ((xor(i, i >> 1) >> place) & 1 = 1) as lw from {name}_l{k}_{i}, range(1, 128) t(i) where i < (cast(1 as bigint) << (k - 1)) group by node, i)""")
            found.append(f"select * from {name}_c{k}_{i}")
        out.append(f"""{name}_s{k} as materialized (select *, case when lw > tw - lw then right_set else left_set end as goes_left from (
  select *, cast(format('{{:.9e}}', {VALUES[criterion]}) as double) as value from (select c.*, tn, td, tw, tn - ln as rn, td - ld as rd from ({' union all '.join(found)}) c join {name}_t{k} using (node))
  where lw > (select least from {name}_least) and tw - (select least from {name}_least) > lw) qualify row_number() over (partition by node order by value desc, feat, pos) = 1)""")
        out.append(_step(name, name, k, features))
    out.append(f"{name} as materialized (select * from {name}_{depth})")
    numeric = " ".join(f"when {i} then '`{f}` <= ' || bound || 'D'" for i, f in enumerate(features) if f in NUMERIC)
    other = " ".join(f"when {i} then '`{f}` > ' || bound || 'D'" for i, f in enumerate(features) if f in NUMERIC)
    texts = "array_to_string(list_transform(goes_left, lambda x: chr(39) || x || chr(39)), ', ')"
    left = f"case feat {numeric} " + " ".join(f"when {i} then '`{f}` in (' || {texts} || ')'" for i, f in enumerate(features) if f not in NUMERIC) + " end"
    right = f"case feat {other} " + " ".join(f"when {i} then '`{f}` not in (' || {texts} || ')'" for i, f in enumerate(features) if f not in NUMERIC) + " end"
    out.append(f"{name}_splits as materialized ({' union all '.join(f'select node, feat, {left} as goes_left, {right} as goes_right from {name}_s{k}' for k in range(depth))})")
    out.append(f"""{name}_leaves as materialized (select *, cast(row_number() over (order by ratio, node) as integer) as leaf from (
  select node, cast(floor(log2(node)) as integer) as depth, sum(n) as numerator, sum(d) as denominator, sum(w) as weight, cast(sum(c) as bigint) as n_rows, sum(n) / sum(d) as ratio from {name} where is_train group by 1))""")
    out.append(f"""{name}_paths as materialized (select l.node, l.leaf, s.node as above, feat, case when (l.node >> (l.depth - cast(floor(log2(s.node)) as integer) - 1)) & 1 = 0 then goes_left else goes_right end as rule
  from {name}_leaves l join {name}_splits s on s.node < l.node and (l.node >> (l.depth - cast(floor(log2(s.node)) as integer))) = s.node)""")
    return ",\n".join(out)


def _step(out: str, name: str, k: int, features: list[str]) -> str:
    goes = "case feat " + " ".join(f"when {i} then " + (f"cast({f} as double) <= bound" if f in NUMERIC else f"list_contains(goes_left, {f})") for i, f in enumerate(features)) + " end"
    return f"{out}_{k + 1} as materialized (select x.* replace (case when feat is null then node when {goes} then 2 * node else 2 * node + 1 end as node) from {out}_{k} x left join {name}_s{k} using (node))"


def applied(out: str, name: str, base: str, depth: int, features: list[str] = FEATURES, value: str = "ratio", column: str = "fitted") -> str:
    """``{out}``: the rows of ``base`` with a leaf's ``value`` as ``column``."""
    steps = [f"{out}_0 as materialized (select *, cast(1 as bigint) as node from {base})", *(_step(out, name, k, features) for k in range(depth))]
    return ",\n".join([*steps, f"{out} as materialized (select x.* exclude (node), l.{value} as {column} from {out}_{depth} x join {name}_leaves l using (node))"])


def importance(paths: list[str], pairs: bool = False) -> str:
    """``importance``: the shares of features, or pairs of them, in the leaves whose way uses them, a mean over trees."""
    parts = []
    for p in paths:
        used = f"(select distinct leaf, feat from {p})"
        found = f"select a.feat as f, b.feat as g from {used} a join {used} b on a.leaf = b.leaf and a.feat < b.feat" if pairs else f"select feat as f, -1 as g from {used}"
        parts.append(f"select f, g, count(*) / sum(count(*)) over () as share from ({found}) group by 1, 2")
    return f"importance as (select f, g, sum(share) / sum(sum(share)) over () as importance from ({' union all '.join(parts)}) group by 1, 2)"


def feature_name(column: str, features: list[str] = FEATURES) -> str:
    return f"case {column} " + " ".join(f"when {i} then '{f}'" for i, f in enumerate(features)) + " end"


def boosted(base: str, iterations: int, rate: float, least: float, depth: int, criterion: str = "poissondeviance") -> str:
    """``e0`` to ``e{iterations}``: the cells of ``base`` with d0 (the denominator), e (the estimate), and from the first iteration on leaf; trees are ``b1``, ``b2``, ..."""
    out = [f"mean as (select sum(n) / sum(d) as mean from {base} where is_train)", f"e0 as materialized (select x.* exclude (d), d as d0, d * mean as d, mean as e, 0 as leaf from {base} x, mean)"]
    for i in range(1, iterations + 1):
        out.append(tree(f"b{i}", f"e{i - 1}", criterion, least, depth))
        new = f"e * ((l.ratio - 1) * {rate} + 1)"
        out.append(f"e{i} as materialized (select x.* exclude (node, d, e, leaf), d0 * ({new}) as d, {new} as e, l.leaf from b{i} x join b{i}_leaves l using (node))")
    return ",\n".join(out)


def scores(base: str, count: int) -> str:
    """``scored``: the cells of ``base`` with score, observed and smoothed ratios of their score."""
    return f"""rel as materialized (select *, e / mean as rel from {base}, mean),
rel_l as (select rel, sum(w) as w from rel where is_train group by 1), rel_c as materialized (select rel, sum(w) over (order by rel) as cum, sum(w) over () as total from rel_l),
cuts as materialized (select row_number() over (order by cut) as place, cut, number from (select cut, min(i) as number from (select i, (select min(rel) from rel_c where cum >= i / {count} * total * (1 - 1e-12)) as cut from range(1, {count + 1}) t(i)) group by 1)),
ranges as materialized (select place, any_value(number) as number, sum(n) / sum(d0) as observed, sum(e * d0) / sum(d0) as modelled, max(rel) as hi, min(rel) as lo
  from (select r.*, least(1 + (select count(*) from cuts where cut < rel), (select count(*) from cuts)) as place from rel r where is_train) join cuts using (place) group by 1),
spans as (select greatest(1, least(50, cast(ceil(0.05 * count(*)) as integer))) as span from ranges),
near as (select a.place as i, b.place - a.place as x, 1 - power((b.place - a.place) / (span + 1), 2) as u, b.observed / b.modelled as y from ranges a, ranges b, spans where abs(a.place - b.place) <= span),
lines as (select i, sum(u * y) / sum(u) as my, sum(u * x) / sum(u) as mx, sum(u * x * x) - sum(u * x) * sum(u * x) / sum(u) as sxx, sum(u * x * y) - sum(u * x) * sum(u * y) / sum(u) as sxy from near group by 1),
smoothed as materialized (select place, number, observed, case when (select count(*) from ranges) > 1 then max((my + case when sxx <> 0 then sxy / sxx * -mx else 0 end) * modelled) over (order by place) else observed end as smoothed,
  (hi + lead(lo) over (order by place)) / 2 as bound from ranges join lines on i = place),
scored as materialized (select r.*, s.number as score, s.observed as unsmoothed, s.smoothed from (select *, 1 + (select count(*) from smoothed where bound < rel) as place from rel) r join smoothed s using (place))"""


def run_measures(name: str) -> str:
    """``{name}_m``: one row of the measures of a tree run without ginis, of the tree ``{name}`` on cells that keep all sums."""
    parts = []
    for s, which in (("trn", "is_train"), ("val", "not is_train")):
        parts.append(f"""sum(2 * (ratio * d - n - (n * ln(ratio) + nl))) filter ({which}) / sum(c) filter ({which}) as poisson_error_{s},
  1 - (sum(nn - 2 * ratio * nd + ratio * ratio * dd) filter ({which})) / (sum(nn) filter ({which}) - power(sum(n) filter ({which}), 2) / sum(c) filter ({which})) as r2_{s},
  sum(nn - 2 * ratio * nd + ratio * ratio * dd) filter ({which}) as rss_{s}, sum(r2 - 2 * ratio * r + ratio * ratio * c) filter ({which}) as rss_ratio_{s},
  1 - (sum(r2 - 2 * ratio * r + ratio * ratio * c) filter ({which})) / (sum(r2) filter ({which}) - power(sum(r) filter ({which}), 2) / sum(c) filter ({which})) as r2_ratio_{s}""")
    return f"""{name}_r as materialized (select x.*, l.leaf, l.ratio, l.ratio as estimate from {name} x join {name}_leaves l using (node)),
{grouped(f'{name}_r', f'{name}_st', 'leaf')},
{band_measures(f'{name}_st', f'{name}_bm')},
{name}_m as (select * from {name}_bm, (select {', '.join(parts)} from {name}_r))"""


def grouped(source: str, name: str = "stats", group: str = "grp") -> str:
    """``{name}``: what ``grouped_stats`` gives for rows of ``source`` (``group``, is_train, n, d, w, estimate)."""
    return f"""{name}_g as (select is_train, {group} as grp, grouping({group}) as tot, sum(w) as weight, sum(n) as numerator, sum(d) as denominator, sum(estimate * d) as estimated from {source} group by rollup (is_train, {group}) having is_train is not null),
{name} as materialized (select grp, tot, is_train, weight, numerator, denominator, numerator / denominator as observed, estimated, estimated / denominator as fitted,
  numerator / denominator / max(case when tot = 1 then numerator / denominator end) over (partition by is_train) as relativity from {name}_g)"""


BAND_MEASURES = ["correlation", *(f"{m}_{s}" for s in ("trn", "val") for m in ("lift", "reversals", "std", "min_relativity", "max_relativity", "min_observed", "max_observed")), "rel_diff", "rel_diff_fitted", "std_ratio"]


def band_measures(stats: str, name: str = "measures") -> str:
    """``{name}``: one row of what ``band_metrics`` gives."""
    sides = ", ".join(f"max({c}) filter ({'' if s == 'trn' else 'not '}is_train) as {c}_{s}" for c in ("relativity", "observed", "fitted", "estimated", "weight") for s in ("trn", "val"))
    parts = []
    for s in ("trn", "val"):
        parts.append(f"""arg_max(relativity_{s}, grp) / arg_min(relativity_{s}, grp) as lift_{s}, count(*) filter (x_{s}) as reversals_{s}, sum(weight_{s} * (observed_{s} - o_{s}) * (observed_{s} - o_{s})) / sum(weight_{s}) as std_{s},
  min(relativity_{s}) as min_relativity_{s}, max(relativity_{s}) as max_relativity_{s}, min(observed_{s}) as min_observed_{s}, max(observed_{s}) as max_observed_{s}""")
    return f"""{name}_b as (select grp, {sides} from {stats} where tot = 0 group by 1),
{name}_o as (select max(observed) filter (is_train) as o_trn, max(observed) filter (not is_train) as o_val from {stats} where tot = 1),
{name}_x as (select *, relativity_trn < lag(relativity_trn) over (order by grp) as x_trn, relativity_val < lag(relativity_val) over (order by grp) as x_val from {name}_b, {name}_o),
{name} as (select *, std_val / std_trn as std_ratio from (select case when count(*) > 1 then corr(relativity_trn, relativity_val) end as correlation, {", ".join(parts)},
  sum(abs(relativity_trn - relativity_val) * estimated_trn) / sum(estimated_trn) as rel_diff, sum(abs(relativity_val - fitted_trn) * estimated_trn) / sum(estimated_trn) as rel_diff_fitted from {name}_x))"""
