"""Colours: from screen values to L*a*b*, and the CIEDE2000 difference, as columns in steps that both engines read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The sRGB curve and matrix, the white point D65, and the constants of the L*a*b* and CIEDE2000 formulas.
_LINEAR = "CASE WHEN {c} / 255.0D <= 0.04045D THEN {c} / 255.0D / 12.92D ELSE pow(({c} / 255.0D + 0.055D) / 1.055D, 2.4D) END"
_F = "CASE WHEN {t} > 0.008856D THEN pow({t}, 1 / 3.0D) ELSE 7.787D * {t} + 16 / 116.0D END"

Steps = list[dict[str, str]]


def lab(side: str) -> Steps:
    """Steps from r, g, b (0 to 255) to l, a, b of one side: columns r1, g1, v1 (blue) give l1, a1, b1."""
    s = side
    return [
        {f"lin_{c}{s}": _LINEAR.format(c=f"{c}{s}") for c in "rgv"},
        {f"t_x{s}": f"(0.412453D * lin_r{s} + 0.357580D * lin_g{s} + 0.180423D * lin_v{s}) / 0.95047D", f"t_y{s}": f"0.212671D * lin_r{s} + 0.715160D * lin_g{s} + 0.072169D * lin_v{s}", f"t_z{s}": f"(0.019334D * lin_r{s} + 0.119193D * lin_g{s} + 0.950227D * lin_v{s}) / 1.08883D"},
        {f"f_{c}{s}": _F.format(t=f"t_{c}{s}") for c in "xyz"},
        {f"l{s}": f"116 * f_y{s} - 16", f"a{s}": f"500 * (f_x{s} - f_y{s})", f"b{s}": f"200 * (f_y{s} - f_z{s})"},
    ]


_HUE = "CASE WHEN p{s} = 0 AND b{s} = 0 THEN 0 WHEN b{s} < 0 THEN degrees(atan2(b{s}, p{s})) + 360 ELSE degrees(atan2(b{s}, p{s})) END"

#: l1, a1, b1, l2, a2, b2 to delta_e.
DELTA_E: Steps = [
    {"chroma7": "pow((sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2, 7)"},
    {"stretch": "1 + 0.5D * (1 - sqrt(chroma7 / (chroma7 + 6103515625.0D)))"},
    {"p1": "stretch * a1", "p2": "stretch * a2"},
    {"q1": "sqrt(p1 * p1 + b1 * b1)", "q2": "sqrt(p2 * p2 + b2 * b2)", "h1": _HUE.format(s=1), "h2": _HUE.format(s=2)},
    {"turn": "CASE WHEN q1 * q2 = 0 THEN 0 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 WHEN h2 - h1 < -180 THEN h2 - h1 + 360 ELSE h2 - h1 END"},
    {
        "d_hue": "2 * sqrt(q1 * q2) * sin(radians(turn / 2))",
        "q": "(q1 + q2) / 2",
        "off": "pow((l1 + l2) / 2 - 50, 2)",
        "h": "CASE WHEN q1 * q2 = 0 THEN h1 + h2 WHEN abs(h1 - h2) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END",
    },
    {"t": "1 - 0.17D * cos(radians(h - 30)) + 0.24D * cos(radians(2 * h)) + 0.32D * cos(radians(3 * h + 6)) - 0.2D * cos(radians(4 * h - 63))", "rotation": "-sin(radians(60 * exp(-pow((h - 275) / 25, 2)))) * 2 * sqrt(pow(q, 7) / (pow(q, 7) + 6103515625.0D))"},
    {"by_l": "(l2 - l1) / (1 + 0.015D * off / sqrt(20 + off))", "by_c": "(q2 - q1) / (1 + 0.045D * q)", "by_h": "d_hue / (1 + 0.015D * q * t)"},
    {"delta_e": "sqrt(by_l * by_l + by_c * by_c + by_h * by_h + rotation * by_c * by_h)"},
]


def stepped(rows: DataFrame, steps: Steps) -> DataFrame:
    """The rows with each step's columns; what only leads to later ones is pruned by the caller's selection."""
    for step in steps:
        rows = rows.withColumns({name: F.expr(e) for name, e in step.items()})
    return rows


def stepped_sql(inner: str, steps: Steps, rest: str) -> str:
    """The same for the other engine: the query ``rest`` over ``steps``, the rows of the query ``inner`` with each step's columns."""
    tables = [f"t0 AS MATERIALIZED ({inner})"]
    for k, step in enumerate(steps):
        tables.append(f"t{k + 1} AS MATERIALIZED (SELECT *, {', '.join(f'{e} AS {name}' for name, e in step.items())} FROM t{k})")
    tables.append(f"steps AS (SELECT * FROM t{len(steps)})")
    return f"WITH {', '.join(re.sub(r'(?<=[0-9])D' + chr(92) + 'b', '', t) for t in tables)} {rest}"


def delta_e(rows: DataFrame) -> DataFrame:
    """The rows with delta_e, the CIEDE2000 difference of two colours in L*a*b*: l1, a1, b1 and l2, a2, b2. A null gives null."""
    found = stepped(rows, DELTA_E)
    return found.select(*rows.columns, "delta_e")


def delta_e_rgb(rows: DataFrame) -> DataFrame:
    """The rows with delta_e of two screen colours, 0 to 255: r1, g1, v1 and r2, g2, v2."""
    found = stepped(rows, [*lab("1"), *lab("2"), *DELTA_E])
    return found.select(*rows.columns, "delta_e")


#: A colour of a smaller share (per cent) is not looked at; a difference over the limit is a change.
LEAST_SHARE = 3.0
LIMIT = 5.0


def palette_verdicts(a: DataFrame, b: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(doc, n_colours, n_changed, max_delta_e, changed) of two palettes (doc, place, r, g, v, share) of each document.

    Each colour of ``a`` that has ``LEAST_SHARE`` per cent or more is held against the nearest of ``b`` in the same
    document; one further than ``limit`` is changed, and so is the document. Without a colour in ``b`` the
    difference is null and counts as a change; documents of ``b`` alone, and without such colours, have no row.
    """
    one = a.filter(F.col("share") >= LEAST_SHARE).select("doc", "place", F.col("r").alias("r1"), F.col("g").alias("g1"), F.col("v").alias("v1"))
    other = b.select("doc", F.col("r").alias("r2"), F.col("g").alias("g2"), F.col("v").alias("v2"))
    nearest = delta_e_rgb(one.join(other, "doc", "left")).groupBy("doc", "place").agg(F.min("delta_e").alias("delta_e"))
    apart = F.coalesce(F.col("delta_e") > limit, F.lit(True))
    told = nearest.groupBy("doc").agg(F.count(F.lit(1)).alias("n_colours"), F.count_if(apart).alias("n_changed"), F.max("delta_e").alias("max_delta_e"))
    return told.withColumn("changed", F.col("n_changed") > 0)
