"""The registered queries once more, as SQL text that another engine can run on the same tables."""

from __future__ import annotations

A = """
a_types AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS col_id
            FROM (SELECT DISTINCT event_type FROM events)),
a AS MATERIALIZED (SELECT e.user_id AS row_id, t.col_id, sum(e.value) AS value
                   FROM events e JOIN a_types t USING (event_type) GROUP BY 1, 2),
a_n AS (SELECT count(DISTINCT user_id) AS n, count(DISTINCT event_type) AS d FROM events)
"""
B = """
b AS MATERIALIZED (SELECT o_custkey AS row_id, CAST(l_partkey AS INTEGER) AS col_id, sum(l_quantity) AS value
                   FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),
b_n AS (SELECT (SELECT count(*) FROM customer) AS n, (SELECT count(*) FROM part) AS d)
"""
C = """
c AS MATERIALIZED (SELECT row_id, CAST(col_id AS INTEGER) AS col_id, value FROM (
                     SELECT vec_id AS row_id, unnest(range(len(embedding))) AS col_id,
                            CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)),
c_n AS (SELECT count(*) AS n, max(len(embedding)) AS d FROM embeddings)
"""
BASES = {"a": A, "b": B, "c": C}


def rnd(expr: str, digits: int = 6) -> str:
    """Rounded, and never a negative zero."""
    return f"(round({expr}, {digits}) + 0.0)"


def query(bases: str, ctes: str, select: str) -> str:
    parts = [BASES[b].strip() for b in bases] + ([ctes.strip().rstrip(",")] if ctes.strip() else [])
    return "WITH " + ",\n".join(parts) + "\n" + select


def spine(t: str) -> str:
    return f"{t}_cols AS (SELECT CAST(unnest(range(d)) AS INTEGER) AS col_id FROM {t}_n)"


def mean(t: str) -> str:
    return f"""{spine(t)},
{t}_mean AS MATERIALIZED (SELECT s.col_id, coalesce(sum(v.value), 0.0) / (SELECT n FROM {t}_n) AS m
  FROM {t}_cols s LEFT JOIN {t} v USING (col_id) GROUP BY 1)"""


def fixed(t: str, name: str = "f") -> str:
    """The fixed two-column start on the columns of a matrix."""
    return (
        f"{name} AS MATERIALIZED (SELECT col_id, CAST(col_id % 10 + 1 AS DOUBLE) AS c_0, "
        f"CAST((col_id + 1) % 10 + 1 AS DOUBLE) AS c_1 FROM {t}_cols)"
    )


def data_factor(t: str, name: str = "f") -> str:
    """Cells of each column and the sum of their values."""
    return f"{name} AS MATERIALIZED (SELECT col_id, CAST(count(*) AS DOUBLE) AS c_0, sum(value) AS c_1 FROM {t} GROUP BY 1)"


def scores(t: str, factor: str = "f", name: str = "x") -> str:
    return f"""{name} AS MATERIALIZED (SELECT v.row_id, sum(v.value * g.c_0) AS x_0, sum(v.value * g.c_1) AS x_1
  FROM {t} v JOIN {factor} g USING (col_id) GROUP BY 1)"""


def shift(t: str, factor: str = "f", name: str = "xm") -> str:
    return f"""{name} AS (SELECT sum(m * c_0) AS s_0, sum(m * c_1) AS s_1
  FROM {t}_mean JOIN {factor} USING (col_id))"""


NORM = """
{t}_norm AS (SELECT sum(q) AS norm2 FROM (
  SELECT coalesce(sum((v.value - w.m) * (v.value - w.m)), 0.0) + ((SELECT n FROM {t}_n) - count(v.value)) * max(w.m * w.m) AS q
  FROM {t}_mean w LEFT JOIN {t} v USING (col_id) GROUP BY w.col_id))"""


def inverse2(a: str, b: str, d: str) -> tuple[str, str, str]:
    det = f"(({a}) * ({d}) - ({b}) * ({b}))"
    return f"(({d}) / {det})", f"(-({b}) / {det})", f"(({a}) / {det})"


def cross(cells: str, x: str, factor: str, name: str) -> str:
    """``y = Σ v·x`` on all columns of ``factor``."""
    return f"""{name} AS MATERIALIZED (SELECT g.col_id, g.m, g.c_0, g.c_1, coalesce(p.y_0, 0.0) AS y_0, coalesce(p.y_1, 0.0) AS y_1
  FROM {factor} g LEFT JOIN (SELECT v.col_id, sum(v.value * x.x_0) AS y_0, sum(v.value * x.x_1) AS y_1
    FROM {cells} v JOIN {x} x USING (row_id) GROUP BY 1) p USING (col_id))"""


def em_round(t: str, r: int, cells: str | None = None, norm: str | None = None) -> str:
    """Round ``r``: from ``st{r}(col_id, m, c_0, c_1)`` and ``ss{r}(ss)`` to those of ``r + 1``."""
    cells, norm = cells or t, norm or f"(SELECT norm2 FROM {t}_norm)"
    i0, i1, i2 = inverse2("g00 + ss", "g01", "g11 + ss")
    w0, w1, w2 = inverse2("t00", "t01", "t11")
    n, d = f"(SELECT n FROM {t}_n)", f"(SELECT d FROM {t}_n)"
    return f"""
g{r} AS (SELECT sum(c_0 * c_0) AS g00, sum(c_0 * c_1) AS g01, sum(c_1 * c_1) AS g11, sum(m * c_0) AS mc0, sum(m * c_1) AS mc1,
  (SELECT ss FROM ss{r}) AS ss FROM st{r}),
i{r} AS MATERIALIZED (SELECT *, mc0 * i00 + mc1 * i01 AS xb0, mc0 * i01 + mc1 * i11 AS xb1
  FROM (SELECT *, {i0} AS i00, {i1} AS i01, {i2} AS i11 FROM g{r})),
x{r} AS MATERIALIZED (SELECT v.row_id, sum(v.value * (g.c_0 * i00 + g.c_1 * i01)) - max(xb0) AS x_0,
  sum(v.value * (g.c_0 * i01 + g.c_1 * i11)) - max(xb1) AS x_1 FROM {cells} v JOIN st{r} g USING (col_id), i{r} GROUP BY 1),
{cross(cells, f"x{r}", f"st{r}", f"y{r}")},
t{r} AS MATERIALIZED (SELECT sum(x_0 * x_0) + ({n} - count(*)) * max(xb0 * xb0) + {n} * max(ss * i00) AS t00,
  sum(x_0 * x_1) + ({n} - count(*)) * max(xb0 * xb1) + {n} * max(ss * i01) AS t01,
  sum(x_1 * x_1) + ({n} - count(*)) * max(xb1 * xb1) + {n} * max(ss * i11) AS t11 FROM x{r}, i{r}),
w{r} AS MATERIALIZED (SELECT *, {w0} AS w00, {w1} AS w01, {w2} AS w11 FROM t{r}),
n{r} AS MATERIALIZED (SELECT col_id, m, c_0 AS o_0, c_1 AS o_1, y_0 * w00 + y_1 * w01 AS c_0, y_0 * w01 + y_1 * w11 AS c_1, y_0, y_1 FROM y{r}, w{r}),
ss{r + 1} AS MATERIALIZED (SELECT ({norm} + max(t00) * sum(c_0 * c_0) + 2 * max(t01) * sum(c_0 * c_1) + max(t11) * sum(c_1 * c_1)
  - 2 * sum(c_0 * y_0 + c_1 * y_1)) / ({n} * CAST({d} AS DOUBLE)) AS ss FROM n{r}, w{r})"""


def em(t: str, rounds: int) -> str:
    parts = [
        mean(t),
        NORM.format(t=t).strip(),
        fixed(t),
        f"st0 AS MATERIALIZED (SELECT col_id, m, c_0, c_1 FROM f JOIN {t}_mean USING (col_id))",
        "ss0 AS (SELECT 0.9644868606768501 AS ss)",
    ]
    for r in range(rounds):
        parts.append(em_round(t, r).strip())
        parts.append(f"st{r + 1} AS MATERIALIZED (SELECT col_id, m, c_0, c_1 FROM n{r})")
    return ",\n".join(parts)


MASK = """
b_ranked AS (SELECT row_id, col_id, row_number() OVER (ORDER BY md5('42:' || row_id || ':' || col_id)) AS r FROM b WHERE value <> 0),
mask AS MATERIALIZED (SELECT row_id, col_id FROM b_ranked WHERE r <= (SELECT count(*) * 10 // 100 FROM b WHERE value <> 0)),
obs AS MATERIALIZED (SELECT * FROM b ANTI JOIN mask USING (row_id, col_id))
"""
FILL_HASH = "CAST(CAST('0x' || substr(md5('{seed}:' || row_id || ':' || col_id), 1, 8) AS BIGINT) % 5 AS DOUBLE)"


def fill(seed: int, mean_table: str) -> str:
    return (
        f"SELECT k.row_id, k.col_id, CASE WHEN w.m <> 0 THEN w.m ELSE {FILL_HASH.format(seed=seed)} END AS value "
        f"FROM mask k JOIN {mean_table} w USING (col_id)"
    )


def em_missing(rounds: int, seed: int = 0) -> str:
    """EM with imputation on the masked customer × part matrix."""
    n = "(SELECT n FROM b_n)"
    parts = [
        MASK.strip(),
        spine("b"),
        f"""obs_mean AS MATERIALIZED (SELECT s.col_id, coalesce(sum(v.value), 0.0) / {n} AS m
  FROM b_cols s LEFT JOIN obs v USING (col_id) GROUP BY 1)""",
        f"miss0 AS MATERIALIZED ({fill(seed, 'obs_mean')})",
        fixed("b"),
        "ss0 AS (SELECT 0.9644868606768501 AS ss)",
    ]
    for r in range(rounds + 1):
        loadings = "f" if r == 0 else f"n{r - 1}"
        parts.append(
            f"""st{r} AS MATERIALIZED (SELECT g.col_id, w.m + coalesce(e.v, 0.0) AS m, g.c_0, g.c_1 FROM {loadings} g JOIN obs_mean w USING (col_id)
  LEFT JOIN (SELECT col_id, sum(value) / {n} AS v FROM miss{r} GROUP BY 1) e USING (col_id))"""
        )
        if r == rounds:
            break
        parts.append(
            f"all{r} AS MATERIALIZED (SELECT row_id, col_id, value FROM obs UNION ALL SELECT row_id, col_id, value FROM miss{r})"
        )
        parts.append(
            f"""norm{r} AS MATERIALIZED (SELECT sum(q) AS norm2 FROM (
  SELECT coalesce(sum((v.value - w.m) * (v.value - w.m)), 0.0) + ({n} - count(v.value)) * max(w.m * w.m) AS q
  FROM st{r} w LEFT JOIN all{r} v USING (col_id) GROUP BY w.col_id))"""
        )
        parts.append(em_round("b", r, f"all{r}", f"(SELECT norm2 FROM norm{r})").strip())
        parts.append(
            f"""miss{r + 1} AS MATERIALIZED (SELECT k.row_id, k.col_id, g.m + x.x_0 * g.c_0 + x.x_1 * g.c_1 AS value
  FROM mask k JOIN n{r} g USING (col_id) JOIN x{r} x USING (row_id))"""
        )
    return ",\n".join(parts)


def gauss(j: int, seed: int = 0) -> str:
    """The seeded normal number of a column id."""
    key = f"md5('{seed}:' || col_id || ':{j}')"
    word = "(CAST(CAST('0x' || substr({key}, {at}, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0"
    first, second = word.format(key=key, at=1), word.format(key=key, at=9)
    return f"sqrt(-2.0 * ln({first})) * cos(({second}) * (2.0 * 3.141592653589793))"


def uniform(j: int, seed: int) -> str:
    return f"(CAST(CAST('0x' || substr(md5('{seed}:' || col_id || ':{j}'), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0"


def eigen2(a: str, b: str, d: str) -> dict[str, str]:
    """Eigenvalues and vectors of a symmetric 2×2 matrix with ``b <> 0``."""
    half, root = f"(({a}) + ({d})) / 2", f"sqrt((({a}) - ({d})) * (({a}) - ({d})) / 4 + ({b}) * ({b}))"
    return {
        "l0": f"({half} + {root})",
        "l1": f"({half} - {root})",
        "u": f"({b})",
        "v0": f"({half} + {root} - ({a}))",
        "v1": f"({half} - {root} - ({a}))",
    }


def subspace_round(t: str, r: int, vectors: bool = False) -> str:
    """One subspace step from ``st{r}(col_id, m, c_0, c_1)``: ``q{r}`` small results, ``st{r + 1}`` next start."""
    n = f"(SELECT n FROM {t}_n)"
    # With L·Lᵀ = ZᵀZ the whitener is the inverse of Lᵀ.
    return f"""
b{r} AS (SELECT sum(m * c_0) AS xb0, sum(m * c_1) AS xb1 FROM st{r}),
x{r} AS MATERIALIZED (SELECT v.row_id, sum(v.value * g.c_0) - max(xb0) AS x_0, sum(v.value * g.c_1) - max(xb1) AS x_1
  FROM {t} v JOIN st{r} g USING (col_id), b{r} GROUP BY 1),
{cross(t, f"x{r}", f"st{r}", f"y{r}")},
z{r} AS (SELECT sum(x_0 * x_0) + ({n} - count(*)) * max(xb0 * xb0) AS z00, sum(x_0 * x_1) + ({n} - count(*)) * max(xb0 * xb1) AS z01,
  sum(x_1 * x_1) + ({n} - count(*)) * max(xb1 * xb1) AS z11 FROM x{r}, b{r}),
l{r} AS MATERIALIZED (SELECT sqrt(z00) AS l00, z01 / sqrt(z00) AS l10, sqrt(z11 - z01 * z01 / z00) AS l11 FROM z{r}),
st{r + 1} AS MATERIALIZED (SELECT col_id, m, y_0 / l00 AS c_0, (y_1 - y_0 * l10 / l00) / l11 AS c_1 FROM y{r}, l{r})"""


def subspace_values(r: int) -> str:
    e = eigen2("a", "b", "d")
    return f"""h{r} AS (SELECT sum(c_0 * c_0) AS a, sum(c_0 * c_1) AS b, sum(c_1 * c_1) AS d FROM st{r + 1}),
v{r} AS MATERIALIZED (SELECT sqrt({e['l0']}) AS s0, sqrt({e['l1']}) AS s1, {e['u']} AS u, {e['v0']} AS v0, {e['v1']} AS v1 FROM h{r})"""


def subspace(t: str, rounds: int) -> str:
    parts = [
        mean(t),
        fixed(t),
        f"st0 AS MATERIALIZED (SELECT col_id, m, c_0, c_1 FROM f JOIN {t}_mean USING (col_id))",
    ]
    for r in range(rounds):
        parts += [subspace_round(t, r).strip(), subspace_values(r)]
    return ",\n".join(parts)


def oriented(source: str, columns: list[str], digits: int = 6) -> str:
    """Columns of ``source(col_id, …)`` with the entry of largest magnitude made positive."""
    picks = ", ".join(
        rnd(f"{c} * (SELECT sign({c}) FROM {source} ORDER BY abs({c}) DESC, col_id LIMIT 1)", digits) + f" AS {c}"
        for c in columns
    )
    return f"SELECT col_id, {picks} FROM {source}"


def right_vectors(r: int) -> str:
    """``V`` of a step: ``st{r+1}`` times the unit eigenvectors over the singular values."""
    return f"""rv AS MATERIALIZED (SELECT col_id, (c_0 * u + c_1 * v0) / sqrt(u * u + v0 * v0) / s0 AS c_0,
  (c_0 * u + c_1 * v1) / sqrt(u * u + v1 * v1) / s1 AS c_1 FROM st{r + 1}, v{r})"""


def residual(t: str, rounds: int) -> str:
    """Subspace iteration on the residual of one fixed direction ``bv(col_id, v)``."""
    parts = [
        mean(t),
        fixed(t),
        "bv AS MATERIALIZED (SELECT col_id, c_0 / (SELECT sqrt(sum(c_0 * c_0)) FROM f) AS v FROM f)",
        f"""rs0 AS MATERIALIZED (SELECT col_id, m, {gauss(0)} AS c_0, {gauss(1)} AS c_1 FROM {t}_mean)""",
    ]
    for r in range(rounds):
        # Without the part in v before the pass, and again after it.
        parts.append(
            f"""st{r} AS MATERIALIZED (SELECT g.col_id, g.m, g.c_0 - v.v * k.k0 AS c_0, g.c_1 - v.v * k.k1 AS c_1
  FROM rs{r} g JOIN bv v USING (col_id), (SELECT sum(v * c_0) AS k0, sum(v * c_1) AS k1 FROM rs{r} JOIN bv USING (col_id)) k)"""
        )
        parts.append(subspace_round(t, r).strip().replace(f"st{r + 1} AS", f"rt{r + 1} AS"))
        parts.append(
            f"""rs{r + 1} AS MATERIALIZED (SELECT g.col_id, g.m, g.c_0 - v.v * k.k0 AS c_0, g.c_1 - v.v * k.k1 AS c_1
  FROM rt{r + 1} g JOIN bv v USING (col_id), (SELECT sum(v * c_0) AS k0, sum(v * c_1) AS k1 FROM rt{r + 1} JOIN bv USING (col_id)) k)"""
        )
        e = eigen2("a", "b", "d")
        parts.append(
            f"""rh{r} AS (SELECT sum(c_0 * c_0) AS a, sum(c_0 * c_1) AS b, sum(c_1 * c_1) AS d FROM rs{r + 1}),
rv{r} AS MATERIALIZED (SELECT sqrt({e['l0']}) AS s0 FROM rh{r})"""
        )
    return ",\n".join(parts)


def wide_subspace(t: str, rounds: int) -> str:
    """Subspace iteration with three seeded columns; ``ws{rounds}`` is the last table, ``wv(sigma)`` its second singular value.

    A round is ``x = Yc·C``, ``C' = (Ycᵀx)·L⁻ᵀ`` with ``L·Lᵀ = xᵀx``, columns being solved for one after the other.
    """
    n = f"(SELECT n FROM {t}_n)"
    parts = [f"ws0 AS MATERIALIZED (SELECT col_id, m, {', '.join(f'{gauss(j)} AS c_{j}' for j in range(3))} FROM {t}_mean)"]
    pairs = [(i, j) for i in range(3) for j in range(i + 1)]
    for r in range(rounds):
        products = ", ".join(f"sum(x_{i} * x_{j}) + ({n} - count(*)) * max(b_{i} * b_{j}) AS z{i}{j}" for i, j in pairs)
        parts += [
            f"wb{r} AS (SELECT {', '.join(f'sum(m * c_{j}) AS b_{j}' for j in range(3))} FROM ws{r})",
            f"wx{r} AS MATERIALIZED (SELECT v.row_id, {', '.join(f'sum(v.value * g.c_{j}) - max(b_{j}) AS x_{j}' for j in range(3))} "
            f"FROM {t} v JOIN ws{r} g USING (col_id), wb{r} GROUP BY 1)",
            f"wz{r} AS MATERIALIZED (SELECT {products} FROM wx{r}, wb{r})",
            f"wk{r} AS (SELECT *, sqrt(z00) AS l00, z10 / sqrt(z00) AS l10, z20 / sqrt(z00) AS l20 FROM wz{r})",
            f"wm{r} AS (SELECT *, sqrt(z11 - l10 * l10) AS l11, (z21 - l20 * l10) / sqrt(z11 - l10 * l10) AS l21 FROM wk{r})",
            f"wl{r} AS MATERIALIZED (SELECT *, sqrt(z22 - l20 * l20 - l21 * l21) AS l22 FROM wm{r})",
            f"wy{r} AS (SELECT v.col_id, {', '.join(f'sum(v.value * x.x_{j}) AS y_{j}' for j in range(3))} FROM {t} v JOIN wx{r} x USING (row_id) GROUP BY 1)",
            f"wc{r} AS (SELECT g.col_id, g.m, {', '.join(f'coalesce(y_{j}, 0.0) AS y_{j}' for j in range(3))} FROM ws{r} g LEFT JOIN wy{r} USING (col_id))",
            f"wd{r} AS (SELECT wc{r}.*, wl{r}.*, y_0 / l00 AS c_0 FROM wc{r}, wl{r})",
            f"we{r} AS (SELECT *, (y_1 - l10 * c_0) / l11 AS c_1 FROM wd{r})",
            f"ws{r + 1} AS MATERIALIZED (SELECT col_id, m, c_0, c_1, (y_2 - l20 * c_0 - l21 * c_1) / l22 AS c_2 FROM we{r})",
        ]
    # Eigenvalues of a symmetric 3×3 matrix by the cosine formula; the one between the others is the trace less both.
    parts += [
        f"wg AS (SELECT {', '.join(f'sum(c_{i} * c_{j}) AS h{i}{j}' for i, j in pairs)} FROM ws{rounds})",
        "wq AS (SELECT *, (h00 + h11 + h22) / 3 AS q FROM wg)",
        "wp AS (SELECT *, sqrt(((h00 - q) * (h00 - q) + (h11 - q) * (h11 - q) + (h22 - q) * (h22 - q) + 2 * (h10 * h10 + h20 * h20 + h21 * h21)) / 6) AS p FROM wq)",
        "wt AS (SELECT *, ((h00 - q) * ((h11 - q) * (h22 - q) - h21 * h21) - h10 * (h10 * (h22 - q) - h21 * h20) "
        "+ h20 * (h10 * h21 - (h11 - q) * h20)) / (2 * p * p * p) AS u FROM wp)",
        "wa AS (SELECT *, acos(greatest(-1.0, least(1.0, u))) / 3 AS phi FROM wt)",
        "wv AS MATERIALIZED (SELECT sqrt(q - 2 * p * cos(phi) - 2 * p * cos(phi + 2 * pi() / 3)) AS sigma FROM wa)",
    ]
    return ",\n".join(parts)
