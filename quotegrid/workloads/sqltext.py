"""SQL building blocks for the model queries: moments, closed-form fits, draws, tails."""

from __future__ import annotations

from quotegrid.functions import exprs as X

M = X.DRAW_MODULUS


def draw_sql(slot: str, replicate: str) -> str:
    i, r = f"(cast({slot} as bigint) % {M})", f"(cast({replicate} as bigint) % {M})"
    x = f"(({i} * {X.DRAW_ROW} + {r} * {X.DRAW_REPLICATE} + {X.DRAW_OFFSET}) % {M})"
    x = f"(({x} * {x} + {i} + 1) % {M})"
    x = f"(({x} * {X.DRAW_MIX} + {r} * 7 + 3) % {M})"
    x = f"(({x} * {x} + {r} + 1) % {M})"
    y = f"(({x} * {X.DRAW_ROW} + {i} * 5 + {r}) % {M})"
    return f"({x} * {M} + (({y} * {y} + {x} + 1) % {M}))"


def moments_sql(cols: list[str]) -> str:
    parts = ["count(*) as n", *[f"avg({c}) as m_{c}" for c in cols]]
    parts += [f"covar_pop({a}, {b}) as v_{a}_{b}" for i, a in enumerate(cols) for b in cols[i:]]
    return ", ".join(parts)


def weighted_moments_sql(cols: list[str], w: str = "w") -> str:
    parts = ["count(*) as n", f"sum({w}) as sw", f"sum(ln({w})) as slw"]
    parts += [f"sum({w}*{c})/sum({w}) as m_{c}" for c in cols]
    parts += [
        f"sum({w}*{a}*{b})/sum({w}) - (sum({w}*{a})/sum({w}))*(sum({w}*{b})/sum({w})) as v_{a}_{b}"
        for i, a in enumerate(cols)
        for b in cols[i:]
    ]
    return ", ".join(parts)


def _v(a: str, b: str, order: list[str]) -> str:
    return f"v_{a}_{b}" if order.index(a) <= order.index(b) else f"v_{b}_{a}"


class Fit:
    """Closed-form least squares with one or two features as SQL expressions over moments."""

    def __init__(self, feats: list[str], order: list[str], y: str = "y"):
        self.feats, self.k = feats, len(feats) + 1
        v = lambda a, b: _v(a, b, order)
        vy = v(y, y)
        if len(feats) == 1:
            f = feats[0]
            self.b = [f"({v(f, y)}/{v(f, f)})"]
            self.rv = f"({vy} - {v(f, y)}*{v(f, y)}/{v(f, f)})"
            self.inv = [f"(1.0/{v(f, f)})"]
            self.mm = f"(m_{f}*m_{f}/{v(f, f)})"
        else:
            f, g = feats
            det = f"({v(f, f)}*{v(g, g)} - {v(f, g)}*{v(f, g)})"
            self.b = [
                f"(({v(f, y)}*{v(g, g)} - {v(g, y)}*{v(f, g)})/{det})",
                f"(({v(g, y)}*{v(f, f)} - {v(f, y)}*{v(f, g)})/{det})",
            ]
            self.rv = f"({vy} - {self.b[0]}*{v(f, y)} - {self.b[1]}*{v(g, y)})"
            self.inv = [f"({v(g, g)}/{det})", f"({v(f, f)}/{det})"]
            self.mm = f"((m_{f}*m_{f}*{v(g, g)} - 2*m_{f}*m_{g}*{v(f, g)} + m_{g}*m_{g}*{v(f, f)})/{det})"
        self.a = f"(m_{y} - " + " - ".join(f"{b}*m_{f}" for b, f in zip(self.b, feats)) + ")"
        self.aic = f"(n*(ln(2*pi())+ln({self.rv})+1)+2*{self.k})"
        self.bic = f"(n*(ln(2*pi())+ln({self.rv})+1)+{self.k}*ln(n))"
        self.waic = f"(n*(ln(2*pi())+ln({self.rv}*sw/n)+1)+2*{self.k}-slw)"
        self.r2 = f"(1-{self.rv}/{vy})"
        self.adj = f"(1-({self.rv}/{vy})*(n-1)/(n-{self.k}))"
        self.se = [f"sqrt({self.rv}/(n-{self.k})*{i})" for i in self.inv]
        self.se0 = f"sqrt({self.rv}/(n-{self.k})*(1+{self.mm}))"


def erf_sql(x: str) -> str:
    """Error function for x > 0 from its all-positive series."""
    return (
        f"(case when {x} <= 0 then 0.0 when {x} >= 6 then 1.0 else list_sum(list_transform(range(0, 150), "
        f"lambda k: exp((2*k+1)*ln({x}) - lgamma(k+1.5) - {x}*{x}))) end)"
    )


def chi2_1_sf_sql(d: str) -> str:
    return f"(1 - {erf_sql(f'sqrt(({d})/2)')})"


def chi2_even_sf_sql(x: str, df: int) -> str:
    from math import factorial

    return f"(exp(-({x})/2)*(" + "+".join(f"power(({x})/2, {i})/{factorial(i)}" for i in range(df // 2)) + "))"


def t_critical_sql(v: str, z: float) -> str:
    """Expansion of the t quantile in 1/df; exact to 1e-10 for df above 100."""
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    return f"({z!r} + {g1!r}/{v} + {g2!r}/power({v},2) + {g3!r}/power({v},3) + {g4!r}/power({v},4))"


def content_sql(name: str, source: str, columns: dict[str, str]) -> str:
    """Table ``name`` with n_rows, n_duplicates and content_hash of a source; columns in order with their types."""
    text = ", ".join(f"coalesce({c if ty not in ('double', 'float') else f'{c}::decimal(38,6)'}::varchar, chr(30))" for c, ty in columns.items())
    half = lambda at: f"sum(('0x' || substr(d, {at}, 15))::bigint::hugeint * n)"
    return f"""{name} as (select n_rows, n_rows - u as n_duplicates, substr(md5(n_rows || ':' || s1 || ':' || s16), 1, 16) as content_hash from (
  select sum(n)::bigint as n_rows, count(*) as u, {half(1)} as s1, {half(16)} as s16 from (select md5(concat_ws(chr(31), {text})) as d, count(*) as n from {source} group by 1)))"""


def schema_hash_sql(columns: dict[str, str]) -> str:
    import json

    body = {"columns": sorted(columns), "rows": None, "types": columns}
    return f"substr(md5('{json.dumps(body, sort_keys=True)}'), 1, 12)"


def rnd(expr: str, name: str, decimals: int = 6) -> str:
    """Rounded column without a signed zero."""
    return f"round({expr}, {decimals}) + 0.0 as {name}"
