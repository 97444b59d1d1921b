"""SQL fragments the checks share."""

STEPS = 100_000


def f_tail(source: str, f: str, d1: str, d2: str, keep: str) -> str:
    """P(F > f) by the midpoint rule, one row per row of ``source``.

    With tan^2(x) = d1 f / d2 the tail is the integral of cos^(d2-1) sin^(d1-1).
    """
    return f"""SELECT {keep}, CASE WHEN a >= pi() / 2 THEN 0.0 ELSE
        (pi() / 2 - a) * avg(pow(cos(a + (pi() / 2 - a) * (i + 0.5) / {STEPS}), e2 - 1) * pow(sin(a + (pi() / 2 - a) * (i + 0.5) / {STEPS}), e1 - 1))
        / (pi() / 2 * avg(pow(cos(pi() / 2 * (i + 0.5) / {STEPS}), e2 - 1) * pow(sin(pi() / 2 * (i + 0.5) / {STEPS}), e1 - 1))) END AS p
      FROM (SELECT *, atan(sqrt(({d1}) * ({f}) / ({d2}))) AS a, ({d1}) AS e1, ({d2}) AS e2 FROM {source}), range({STEPS}) r(i) GROUP BY {keep}, a, e1, e2"""


def chi2_tail(source: str, x: str, dof: str, keep: str) -> str:
    """P(chi-square > x) by the midpoint rule in u = sqrt(x)."""
    return f"""SELECT {keep}, 14 * avg(pow(u + 14 * (i + 0.5) / {STEPS}, k - 1) * exp(-pow(u + 14 * (i + 0.5) / {STEPS}, 2) / 2))
        / ((sqrt(k) + 14) * avg(pow((sqrt(k) + 14) * (i + 0.5) / {STEPS}, k - 1) * exp(-pow((sqrt(k) + 14) * (i + 0.5) / {STEPS}, 2) / 2))) AS p
      FROM (SELECT *, sqrt({x}) AS u, ({dof}) AS k FROM {source}), range({STEPS}) r(i) GROUP BY {keep}, u, k"""


def t_two_sided(source: str, t: str, dof: str, keep: str) -> str:
    return f_tail(source, f"({t}) * ({t})", "1", dof, keep)


def rank_avg(col: str) -> str:
    """Tie-averaged rank of a column."""
    return f"(rank() OVER (ORDER BY {col}) + (count(*) OVER (PARTITION BY {col}) - 1) / 2.0)"
