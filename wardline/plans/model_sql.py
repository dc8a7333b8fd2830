"""Cox models with one to three terms in plain SQL, as oracles for the Spark fits.

Rows need the columns ``cut, tstop, x, s, w`` (group, time, covariate, status,
weight) and cover one day each.  Newton steps are a recursive query.
"""

from __future__ import annotations

STEPS = 14

_SUMS = """
  sum(s)::BIGINT AS d, sum(s * w) / nullif(sum(s), 0) AS wbar, sum(s * w * x) AS wx,
  sum(w * exp(b * x)) AS s0, sum(x * w * exp(b * x)) AS s1, sum(x * x * w * exp(b * x)) AS s2,
  sum(s * w * exp(b * x)) AS t0, sum(s * x * w * exp(b * x)) AS t1,
  sum(s * x * x * w * exp(b * x)) AS t2"""


def _steps(expression: str) -> str:
    """Sum over the tie steps k = 0..d-1; ``expression`` may use f, z0, z1 and z2."""
    for name in ("0", "1", "2"):
        expression = expression.replace(f"z{name}", f"(s{name} - k / d * t{name})")
    expression = expression.replace("ff", "(k / d)")
    return f"list_sum(list_transform(range(d), lambda k: {expression}))"


def fit(name: str, rows: str) -> str:
    """CTEs ``name_b`` (cut, b), ``name_t`` (sums per time at b) and ``name_j`` (jumps)."""
    return f"""
{name}_n(step, cut, b) AS (
  SELECT 0, cut, 0.0::DOUBLE FROM (SELECT DISTINCT cut FROM {rows})
  UNION ALL
  SELECT step + 1, cut, any_value(b) + sum(wx - wbar * {_steps("z1 / z0")})
           / sum(wbar * {_steps("z2 / z0 - (z1 / z0) ** 2")})
  FROM (SELECT step, n.cut, b, tstop, {_SUMS} FROM {name}_n n JOIN {rows} r ON n.cut = r.cut
        WHERE step < {STEPS} GROUP BY step, n.cut, b, tstop)
  WHERE d > 0 GROUP BY step, cut),
{name}_b AS (SELECT cut, b FROM {name}_n WHERE step = {STEPS}),
{name}_t AS (SELECT n.cut, b, tstop, {_SUMS} FROM {name}_b n JOIN {rows} r ON n.cut = r.cut
             GROUP BY n.cut, b, tstop HAVING sum(s) > 0),
{name}_j AS (SELECT cut, b, tstop, wbar * {_steps("1.0 / z0")} AS jump FROM {name}_t)"""


def null_jumps(name: str, rows: str) -> str:
    """CTE ``name_j`` with the jumps of a model without terms."""
    return f"""
{name}_j AS (
  SELECT cut, 0.0::DOUBLE AS b, tstop,
         list_sum(list_transform(range(d), lambda k: 1.0::DOUBLE / (n - k))) AS jump
  FROM (SELECT cut, tstop, count(*) AS n, sum(s)::BIGINT AS d FROM {rows} GROUP BY cut, tstop)
  WHERE d > 0)"""


def weights(name: str, panel: str, exposure: str) -> str:
    """CTE ``name_w`` (cut, user_id, tstop, w): null numerator, ``vmin`` in the denominator."""
    return f"""
{name}_all AS (
  SELECT *, coalesce(sum({exposure}) OVER (PARTITION BY cut, user_id ORDER BY tstop
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS sel FROM {panel}),
{name}_rows AS (SELECT cut, tstop, vmin AS x, {exposure} AS s, 1.0::DOUBLE AS w
                FROM {name}_all WHERE sel),
{fit(name + "_den", name + "_rows")},
{null_jumps(name + "_num", name + "_rows")},
{name}_p AS (
  SELECT a.cut, user_id, a.tstop, sel, {exposure} AS e,
         coalesce(n.jump, 0) AS hn, coalesce(d.jump * exp(d.b * vmin), 0) AS hd
  FROM {name}_all a
  LEFT JOIN {name}_num_j n ON n.cut = a.cut AND n.tstop = a.tstop
  LEFT JOIN {name}_den_j d ON d.cut = a.cut AND d.tstop = a.tstop),
{name}_w AS (
  SELECT cut, user_id, tstop,
         product(CASE WHEN NOT sel THEN 1 WHEN e = 1 THEN (1 - exp(-hn)) / (1 - exp(-hd))
                      ELSE exp(-hn) / exp(-hd) END)
           OVER (PARTITION BY cut, user_id ORDER BY tstop) AS w
  FROM {name}_p)"""


def effects(name: str, rows: str) -> str:
    """CTEs after :func:`fit`: ``name_e`` with coefficient and robust error per cut-off.

    ``rows`` also has ``id``, the cluster.
    """
    return f"""
{name}_q AS (
  SELECT cut, tstop, d, {_steps("z1 / z0")} / d AS mean,
         wbar * {_steps("1.0 / z0")} AS a, wbar * {_steps("z1 / z0 ** 2")} AS v,
         wbar * {_steps("(1 - ff) / z0")} AS ea, wbar * {_steps("(1 - ff) * z1 / z0 ** 2")} AS ev,
         wbar * {_steps("z2 / z0 - (z1 / z0) ** 2")} AS info
  FROM {name}_t),
{name}_u AS (
  SELECT r.cut, id, sum(w * (s * (x - coalesce(mean, 0)) - exp(b * x)
           * CASE WHEN s = 1 THEN x * ea - ev ELSE x * coalesce(a, 0) - coalesce(v, 0) END)) AS u
  FROM {rows} r JOIN {name}_b n ON n.cut = r.cut
  LEFT JOIN {name}_q q ON q.cut = r.cut AND q.tstop = r.tstop
  GROUP BY r.cut, id),
{name}_e AS (
  SELECT n.cut, b, sqrt(meat) / info AS se, d
  FROM {name}_b n
  JOIN (SELECT cut, sum(u * u) AS meat FROM {name}_u GROUP BY cut) m ON m.cut = n.cut
  JOIN (SELECT cut, sum(info) AS info, sum(d) AS d FROM {name}_q GROUP BY cut) i
    ON i.cut = n.cut)"""


def effect_columns(name: str, digits: int = 5) -> str:
    z = 1.959963984540054
    return f"""round(b, {digits}) AS coef, round(se, {digits}) AS se, round(exp(b), {digits}) AS hr,
  round(exp(-b), {digits}) AS inv_hr, round(exp(b - {z}::DOUBLE * se), {digits}) AS lo95,
  round(exp(b + {z}::DOUBLE * se), {digits}) AS hi95, d::BIGINT AS n_events FROM {name}_e"""


# --------------------------------------------------------------------------
# models with up to three terms: columns x1, x2, x3; the systems are solved by cofactors


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(1, p + 1) for j in range(i, p + 1)]


def _terms(p: int, form: str) -> list[str]:
    return [form.format(i=i) for i in range(1, p + 1)]


def _list(parts: list[str]) -> str:
    return "".join(f", {part}" for part in parts)


def _z(index: str) -> str:
    """Risk set less the share of the events at tie step k."""
    return f"(s{index} - k / d * t{index})"


def _over_steps(expression: str) -> str:
    return f"list_sum(list_transform(range(d), lambda k: {expression}))"


def _time_sums(p: int) -> str:
    """Sums per time of rows with coefficients ``b1`` and so on."""
    hazard = f"w * exp({' + '.join(_terms(p, 'b{i} * x{i}'))})"
    out = ["sum(s)::BIGINT AS d", "sum(s * w) / nullif(sum(s), 0) AS wbar", *_terms(p, "sum(s * w * x{i}) AS wx{i}")]
    for name, factor in (("s", ""), ("t", "s * ")):
        out.append(f"sum({factor}{hazard}) AS {name}0")
        out += [f"sum({factor}x{i} * {hazard}) AS {name}{i}" for i in range(1, p + 1)]
        out += [f"sum({factor}x{i} * x{j} * {hazard}) AS {name}{i}{j}" for i, j in _pairs(p)]
    return ", ".join(out)


def _information(p: int) -> list[str]:
    return [
        f"sum(wbar * {_over_steps(f'{_z(f"{i}{j}")} / {_z("0")} - {_z(str(i))} * {_z(str(j))} / {_z("0")} ** 2')}) AS i{i}{j}"
        for i, j in _pairs(p)
    ]


def _determinant(rows: list[int], columns: list[int]) -> str:
    if not rows:
        return "1.0::DOUBLE"
    parts = [
        f"{'-' if k % 2 else '+'} i{min(rows[0], c)}{max(rows[0], c)} * ({_determinant(rows[1:], columns[:k] + columns[k + 1 :])})"
        for k, c in enumerate(columns)
    ]
    return " ".join(parts)


def _solved(p: int, row: int, vector: str) -> str:
    """Element ``row`` of the inverse information times a vector."""
    every = list(range(1, p + 1))
    parts = []
    for i in every:
        minor = _determinant([r for r in every if r != i], [c for c in every if c != row])
        parts.append(f"{'-' if (i + row) % 2 else '+'} ({minor}) * {vector}{i}")
    return f"({' '.join(parts)}) / ({_determinant(every, every)})"


def fit_terms(name: str, rows: str, p: int) -> str:
    """CTEs like those of :func:`fit` for ``p`` terms, with coefficients ``b1`` and so on."""
    bs = _list(_terms(p, "b{i}"))
    return f"""
{name}_n(step, cut{bs}) AS (
  SELECT 0, cut{_list(_terms(p, "0.0::DOUBLE"))} FROM (SELECT DISTINCT cut FROM {rows})
  UNION ALL
  SELECT step + 1, cut{_list([f"b{j} + {_solved(p, j, 'g')}" for j in range(1, p + 1)])}
  FROM (SELECT step, cut{_list(_terms(p, "any_value(b{i}) AS b{i}"))}
               {_list([f"sum(wx{i} - wbar * {_over_steps(f'{_z(str(i))} / {_z("0")}')}) AS g{i}" for i in range(1, p + 1)])}
               {_list(_information(p))}
        FROM (SELECT step, n.cut{bs}, tstop, {_time_sums(p)} FROM {name}_n n JOIN {rows} r ON n.cut = r.cut
              WHERE step < {STEPS} GROUP BY step, n.cut{bs}, tstop)
        WHERE d > 0 GROUP BY step, cut)),
{name}_b AS (SELECT cut{bs} FROM {name}_n WHERE step = {STEPS}),
{name}_t AS (SELECT n.cut{bs}, tstop, {_time_sums(p)} FROM {name}_b n JOIN {rows} r ON n.cut = r.cut
             GROUP BY n.cut{bs}, tstop HAVING sum(s) > 0),
{name}_j AS (SELECT cut{bs}, tstop, wbar * {_over_steps(f"1.0 / {_z('0')}")} AS jump FROM {name}_t)"""


def weights_terms(name: str, panel: str, exposure: str, top: list[str], bottom: list[str]) -> str:
    """CTE ``name_w`` (cut, user_id, tstop, w); ``top`` and ``bottom`` are the terms of numerator and denominator."""

    def model(side: str, xs: list[str]) -> str:
        rows = f"{name}_{side}_rows"
        columns = _list([f"{x} AS x{i}" for i, x in enumerate(xs, 1)])
        made = f"{rows} AS (SELECT cut, tstop{columns}, {exposure} AS s, 1.0::DOUBLE AS w FROM {name}_all WHERE sel)"
        return f"{made},{fit_terms(f'{name}_{side}', rows, len(xs)) if xs else null_jumps(f'{name}_{side}', rows)}"

    def hazard(alias: str, xs: list[str]) -> str:
        linear = " + ".join(["0.0::DOUBLE", *[f"{alias}.b{i} * {x}" for i, x in enumerate(xs, 1)]])
        return f"coalesce({alias}.jump * exp({linear}), 0)"

    return f"""
{name}_all AS (
  SELECT *, coalesce(sum({exposure}) OVER (PARTITION BY cut, user_id ORDER BY tstop
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS sel FROM {panel}),
{model("num", top)},
{model("den", bottom)},
{name}_p AS (
  SELECT a.cut, user_id, a.tstop, sel, {exposure} AS e, {hazard("n", top)} AS hn, {hazard("d", bottom)} AS hd
  FROM {name}_all a
  LEFT JOIN {name}_num_j n ON n.cut = a.cut AND n.tstop = a.tstop
  LEFT JOIN {name}_den_j d ON d.cut = a.cut AND d.tstop = a.tstop),
{name}_w AS (
  SELECT cut, user_id, tstop,
         product(CASE WHEN NOT sel THEN 1 WHEN e = 1 THEN (1 - exp(-hn)) / (1 - exp(-hd))
                      ELSE exp(-hn) / exp(-hd) END)
           OVER (PARTITION BY cut, user_id ORDER BY tstop) AS w
  FROM {name}_p)"""


def effects_terms(name: str, rows: str, labels: list[str]) -> str:
    """CTEs after :func:`fit_terms`: ``name_e`` with one row for each cut-off and term, as :func:`effect_columns` reads it."""
    p = len(labels)
    every = range(1, p + 1)
    steps0 = _z("0")
    at_times = []
    for i in every:
        z = _z(str(i))
        at_times += [
            f"{_over_steps(f'{z} / {steps0}')} / d AS mean{i}",
            f"wbar * {_over_steps(f'{z} / {steps0} ** 2')} AS v{i}",
            f"wbar * {_over_steps(f'(1 - k / d) * {z} / {steps0} ** 2')} AS ev{i}",
        ]
    scores = [
        f"sum(w * (s * (x{i} - coalesce(mean{i}, 0)) - exp({' + '.join(_terms(p, 'n.b{i} * x{i}'))})"
        f" * CASE WHEN s = 1 THEN x{i} * ea - ev{i} ELSE x{i} * coalesce(a, 0) - coalesce(v{i}, 0) END)) AS u{i}"
        for i in every
    ]
    table = " UNION ALL ".join(
        f"SELECT cut, '{label}' AS term, b{i} AS b, sqrt(m{i}) AS se, d FROM {name}_v" for i, label in enumerate(labels, 1)
    )
    return f"""
{name}_q AS (
  SELECT cut, tstop{_list(at_times)}, wbar * {_over_steps(f"1.0 / {steps0}")} AS a,
         wbar * {_over_steps(f"(1 - k / d) / {steps0}")} AS ea
  FROM {name}_t),
{name}_i AS (SELECT cut, sum(d) AS d{_list(_information(p))} FROM {name}_t GROUP BY cut),
{name}_u AS (
  SELECT r.cut, id{_list(scores)}
  FROM {rows} r JOIN {name}_b n ON n.cut = r.cut
  LEFT JOIN {name}_q q ON q.cut = r.cut AND q.tstop = r.tstop
  GROUP BY r.cut, id),
{name}_m AS (
  SELECT u.cut{_list([f"sum(({_solved(p, j, 'u')}) ** 2) AS m{j}" for j in every])}
  FROM {name}_u u JOIN {name}_i i ON i.cut = u.cut GROUP BY u.cut),
{name}_v AS (
  SELECT n.cut{_list(_terms(p, "n.b{i}"))}{_list(_terms(p, "m.m{i}"))}, i.d
  FROM {name}_b n JOIN {name}_m m ON m.cut = n.cut JOIN {name}_i i ON i.cut = n.cut),
{name}_e AS ({table})"""
