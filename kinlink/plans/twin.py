"""DuckDB SQL that computes the same as the engine, written from the formulas.

Wide comparisons use HUGEINT cross products instead of the engine's keys, so the
two agree only if the keys order quotients exactly.
"""

from __future__ import annotations

from itertools import permutations

from kinlink.plans.config import LinkageConfig
from kinlink.plans.fixtures import View
from kinlink.plans.precision import Precision


def _eq_value(config: LinkageConfig, side: str, name: str) -> str:
    """A value that is equal where the encoded bytes are equal."""
    f, c = config.fields[name], f'{side}."{name}"'
    if f.ftype == "integer":
        return f"(CAST({c} AS BIGINT) & {(1 << 8 * f.nbytes) - 1})"
    return f"left({c}, {f.nbytes})" if f.ftype == "string" else c


def term(config: LinkageConfig, p: Precision, a: str, b: str) -> tuple[str, str]:
    f, w = config.fields[a], p.pair_weight(config, a, b)
    here = f'(l."{a}" IS NOT NULL AND r."{b}" IS NOT NULL)'
    zero = "CAST(0 AS DOUBLE)" if p.exact else "CAST(0 AS BIGINT)"
    wt = f"CAST({w!r} AS DOUBLE)" if p.exact else f"CAST({w} AS BIGINT)"
    if f.comparator == "binary":
        one = "CAST(1 AS DOUBLE)" if p.exact else f"CAST({1 << p.dice} AS BIGINT)"
        comp = f"CASE WHEN {_eq_value(config, 'l', a)} = {_eq_value(config, 'r', b)} THEN {one} ELSE {zero} END"
    else:
        both = f'CAST(bit_count(l."{a}" & r."{b}") AS BIGINT)'
        total = f'(CAST(bit_count(l."{a}") AS BIGINT) + CAST(bit_count(r."{b}") AS BIGINT))'
        value = f"(2 * {both}) / CAST({total} AS DOUBLE)" if p.exact else f"(({both} << {p.dice + 1}) + ({total} >> 1)) // {total}"
        comp = f"CASE WHEN {total} = 0 THEN {zero} ELSE {value} END"
    return f"CASE WHEN {here} THEN ({comp}) * {wt} ELSE {zero} END", f"CASE WHEN {here} THEN {wt} ELSE {zero} END"


def _less(a: tuple[str, str], b: tuple[str, str], exact: bool) -> str:
    """Quotient a below quotient b; equal ones by denominator; denominator 0 lowest."""
    kind = "DOUBLE" if exact else "HUGEINT"
    (fa, wa), (fb, wb) = a, b
    left, right = f"CAST({fa} AS {kind}) * {wb}", f"CAST({fb} AS {kind}) * {wa}"
    return f"(CASE WHEN {wa} = 0 THEN {wb} <> 0 WHEN {wb} = 0 THEN false WHEN {left} = {right} THEN {wa} < {wb} ELSE {left} < {right} END)"


def scores_cte(view: View, p: Precision) -> str:
    """CTEs l, r, terms, and scores (record_idx, row_idx, id, num, den)."""
    config = view.config
    pairs = [(n, n) for n in config.single_fields] + [(a, b) for g in config.groups for a in g for b in g]
    cols = []
    for a, b in pairs:
        f, w = term(config, p, a, b)
        cols += [f'{f} AS "f_{a}_{b}"', f'{w} AS "w_{a}_{b}"']
    out = f"l AS MATERIALIZED ({view.client_sql}), r AS MATERIALIZED ({view.server_sql}),\n terms AS (SELECT record_idx, row_idx, id, {', '.join(cols)} FROM l, r)"
    num = [f'"f_{n}_{n}"' for n in config.single_fields]
    den = [f'"w_{n}_{n}"' for n in config.single_fields]
    last = "terms"
    for k, g in enumerate(config.groups):
        perms = [("(" + " + ".join(f'"f_{a}_{b}"' for a, b in zip(g, q)) + ")", "(" + " + ".join(f'"w_{a}_{b}"' for a, b in zip(g, q)) + ")") for q in permutations(g)]
        named = ", ".join(f"{f} AS p{k}_{i}_f, {w} AS p{k}_{i}_w" for i, (f, w) in enumerate(perms))
        out += f",\n g{k}_0 AS (SELECT *, {named} FROM {last}),\n g{k}_0b AS (SELECT *, p{k}_0_f AS b{k}_0_f, p{k}_0_w AS b{k}_0_w FROM g{k}_0)"
        last = f"g{k}_0b"
        for i in range(1, len(perms)):
            up = _less((f"b{k}_{i - 1}_f", f"b{k}_{i - 1}_w"), (f"p{k}_{i}_f", f"p{k}_{i}_w"), p.exact)
            out += f",\n g{k}_{i} AS (SELECT *, CASE WHEN {up} THEN p{k}_{i}_f ELSE b{k}_{i - 1}_f END AS b{k}_{i}_f, CASE WHEN {up} THEN p{k}_{i}_w ELSE b{k}_{i - 1}_w END AS b{k}_{i}_w FROM {last})"
            last = f"g{k}_{i}"
        num.append(f"b{k}_{len(perms) - 1}_f")
        den.append(f"b{k}_{len(perms) - 1}_w")
    return out + f",\n scores AS (SELECT record_idx, row_idx, id, {' + '.join(num)} AS num, {' + '.join(den)} AS den FROM {last})"


def _order(p: Precision) -> str:
    """Orders scores from best to worst; whole numbers by an exact HUGEINT quotient."""
    q = "num / den" if p.exact else "(CAST(num AS HUGEINT) << 60) // den"
    return f"CASE WHEN den = 0 THEN -1 ELSE {q} END DESC, den DESC, row_idx"


def best_cte(view: View, p: Precision) -> str:
    return scores_cte(view, p) + f",\n best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_idx ORDER BY {_order(p)}) AS rn FROM scores) WHERE rn = 1)"


def _limit(p: Precision, threshold: float) -> str:
    return f"CAST({threshold!r} AS DOUBLE)" if p.exact else str(p.limit(threshold))


def link_sql(view: View, mode: str, digits: int | None = None) -> str:
    p = Precision.of(mode, view.config)
    rnd = (lambda x: f"round({x}, {digits})") if digits is not None else (lambda x: x)
    den = "den" if p.exact else f"(den << {p.dice})"
    return f"""WITH {best_cte(view, p)}
    SELECT record_idx, row_idx AS best_index, id AS best_id, {_limit(p, view.config.threshold)} * den < num AS match,
           {_limit(p, view.config.tentative_threshold)} * den < num AS tentative_match, {rnd('num')} AS sum_field_weights, {rnd(den)} AS sum_weights FROM best"""


def count_sql(view: View, mode: str) -> str:
    p = Precision.of(mode, view.config)
    return f"""WITH {best_cte(view, p)}
    SELECT CAST(count(*) FILTER (WHERE {_limit(p, view.config.threshold)} * den < num) AS BIGINT) AS matches,
           CAST(count(*) FILTER (WHERE {_limit(p, view.config.tentative_threshold)} * den < num) AS BIGINT) AS tentative_matches FROM best"""
