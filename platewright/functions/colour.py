"""Colour science as staged projections: each step adds columns, so no expression is repeated."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# sRGB (D65) to XYZ, Bradford adaptation to D50, D50 white, CIE constants.
SRGB_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
BRADFORD = ((1.0478112, 0.0228866, -0.0501270), (0.0295424, 0.9904844, -0.0170491), (-0.0092345, 0.0150436, 0.7521316))
WHITE = (0.96422, 1.0, 0.82521)
EPSILON, KAPPA = 216 / 24389, 24389 / 27

TO_XYZ = tuple(tuple(sum(BRADFORD[i][k] * SRGB_XYZ[k][j] for k in range(3)) for j in range(3)) for i in range(3))


def linear(c: Column) -> Column:
    """Gamma expansion of a channel in 0..1."""
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def gamma(c: Column) -> Column:
    """Clamped gamma compression of a linear channel."""
    held = F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return F.when(held <= 0.0031308, held * 12.92).otherwise(1.055 * F.pow(held, F.lit(1 / 2.4)) - 0.055)


def with_lab(df: DataFrame, r: str = "r", g: str = "g", b: str = "b", prefix: str = "") -> DataFrame:
    """Adds L, a, b (D50) of sRGB bytes as `{prefix}L`, `{prefix}a`, `{prefix}b`."""
    df = df.withColumns({f"_l{i}": linear(F.col(c) / 255.0) for i, c in enumerate((r, g, b))})
    df = df.withColumns({f"_x{i}": sum((F.col(f"_l{j}") * TO_XYZ[i][j] for j in range(1, 3)), F.col("_l0") * TO_XYZ[i][0]) / WHITE[i] for i in range(3)})
    df = df.withColumns({f"_f{i}": F.when(F.col(f"_x{i}") > EPSILON, F.cbrt(f"_x{i}")).otherwise((F.col(f"_x{i}") * KAPPA + 16) / 116) for i in range(3)})
    lab = {f"{prefix}L": F.col("_f1") * 116 - 16, f"{prefix}a": (F.col("_f0") - F.col("_f1")) * 500, f"{prefix}b_": (F.col("_f1") - F.col("_f2")) * 200}
    return df.withColumns(lab).drop(*(f"_{k}{i}" for k in "lxf" for i in range(3)))


def delta_e76(one: tuple[str, str, str], two: tuple[str, str, str]) -> Column:
    return F.sqrt(sum((F.pow(F.col(a) - F.col(b), F.lit(2)) for a, b in zip(one[1:], two[1:], strict=True)), F.pow(F.col(one[0]) - F.col(two[0]), F.lit(2))))


def with_delta_e2000(df: DataFrame, one: tuple[str, str, str], two: tuple[str, str, str], name: str = "de", weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Adds the CIEDE2000 difference of two Lab triples; weights are those of lightness, chroma and hue."""
    c, rad = F.col, math.pi / 180
    df = df.withColumns({"_c1": F.hypot(one[1], one[2]), "_c2": F.hypot(two[1], two[2])})
    df = df.withColumn("_m7", F.pow((c("_c1") + c("_c2")) / 2, F.lit(7)))
    df = df.withColumn("_g", 0.5 * (1 - F.sqrt(c("_m7") / (c("_m7") + 25.0**7))))
    df = df.withColumns({"_a1": c(one[1]) * (1 + c("_g")), "_a2": c(two[1]) * (1 + c("_g"))})
    df = df.withColumns({"_p1": F.hypot(c("_a1"), c(one[2])), "_p2": F.hypot(c("_a2"), c(two[2]))})
    hue = lambda a, b: F.when((c(a) == 0) & (c(b) == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(c(b), c(a))), F.lit(360.0)))
    df = df.withColumns({"_h1": hue("_a1", one[2]), "_h2": hue("_a2", two[2])})
    gray = c("_p1") * c("_p2") == 0
    turn = c("_h2") - c("_h1")
    df = df.withColumn("_dh", F.when(gray, 0.0).when(turn > 180, turn - 360).when(turn < -180, turn + 360).otherwise(turn))
    both = c("_h1") + c("_h2")
    df = df.withColumns({"_dl": c(two[0]) - c(one[0]), "_dc": c("_p2") - c("_p1"), "_dH": 2 * F.sqrt(c("_p1") * c("_p2")) * F.sin(c("_dh") / 2 * rad), "_lm": (c(one[0]) + c(two[0])) / 2, "_cm": (c("_p1") + c("_p2")) / 2, "_hm": F.when(gray, both).when(F.abs(turn) <= 180, both / 2).when(both < 360, (both + 360) / 2).otherwise((both - 360) / 2)})
    cos = lambda x: F.cos(x * rad)
    df = df.withColumns({"_t": 1 - 0.17 * cos(c("_hm") - 30) + 0.24 * cos(2 * c("_hm")) + 0.32 * cos(3 * c("_hm") + 6) - 0.20 * cos(4 * c("_hm") - 63), "_l50": F.pow(c("_lm") - 50, F.lit(2)), "_c7": F.pow(c("_cm"), F.lit(7))})
    df = df.withColumns({"_sl": 1 + 0.015 * c("_l50") / F.sqrt(20 + c("_l50")), "_sc": 1 + 0.045 * c("_cm"), "_sh": 1 + 0.015 * c("_cm") * c("_t"), "_rt": -F.sin(60 * F.exp(-F.pow((c("_hm") - 275) / 25, F.lit(2))) * rad) * 2 * F.sqrt(c("_c7") / (c("_c7") + 25.0**7))})
    df = df.withColumns({"_u": c("_dl") / (weights[0] * c("_sl")), "_v": c("_dc") / (weights[1] * c("_sc")), "_w": c("_dH") / (weights[2] * c("_sh"))})
    out = F.sqrt(F.greatest(c("_u") * c("_u") + c("_v") * c("_v") + c("_w") * c("_w") + c("_rt") * c("_v") * c("_w"), F.lit(0.0)))
    extra = "_c1 _c2 _m7 _g _a1 _a2 _p1 _p2 _h1 _h2 _dh _dl _dc _dH _lm _cm _hm _t _l50 _c7 _sl _sc _sh _rt _u _v _w".split()
    return df.withColumn(name, out).drop(*extra)


def hex_of(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *(F.lpad(F.hex(x.cast("long")), 2, "0") for x in (r, g, b)))


def from_hex(value: Column, at: int) -> Column:
    """Byte `at` (0..2) of '#RRGGBB'."""
    return F.conv(F.substring(value, 2 + 2 * at, 2), 16, 10).cast("int")


def light(de: Column) -> Column:
    """Traffic light of a colour difference."""
    return F.when(de <= 2, "green").when(de <= 4, "yellow").otherwise("red")


def gained(cov: Column, gain: float) -> Column:
    """Coverage in 0..1 after dot gain `gain` at one half, as a byte (cut, not rounded)."""
    c = cov + gain * 4 * cov * (1 - cov)
    return F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")


def density(channel: Column) -> Column:
    return -F.log10(F.greatest(channel, F.lit(1e-4)))


# ---------------------------------------------------------------- the way back, densities and mixtures

D65 = (0.95047, 1.0, 1.08883)
# Linear wide-gamut RGB (D50) to XYZ, the space inks are mixed in; Lab of the reference paper.
WIDE_XYZ = ((0.7976749, 0.1351917, 0.0313534), (0.2880402, 0.7118741, 0.0000857), (0.0, 0.0, 0.8252100))
PAPER = (95.0, 0.0, -2.0)


def _inverse(m: tuple) -> tuple:
    """Inverse of a 3 by 3 matrix."""
    cofactor = lambda i, j: m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3]
    determinant = sum(m[0][j] * cofactor(0, j) for j in range(3))
    return tuple(tuple(cofactor(j, i) / determinant for j in range(3)) for i in range(3))


FROM_XYZ, XYZ_WIDE = _inverse(TO_XYZ), _inverse(WIDE_XYZ)


def _row(matrix: tuple, i: int, x: Column, y: Column, z: Column) -> Column:
    return x * matrix[i][0] + y * matrix[i][1] + z * matrix[i][2]


def with_xyz_of_lab(df: DataFrame, lab: tuple[str, str, str], names: tuple[str, str, str] = ("X", "Y", "Z"), white: tuple = WHITE) -> DataFrame:
    """Adds XYZ of a Lab triple."""
    df = df.withColumn("_fy", (F.col(lab[0]) + 16) / 116)
    df = df.withColumns({"_fx": F.col("_fy") + F.col(lab[1]) / 500, "_fz": F.col("_fy") - F.col(lab[2]) / 200})
    back = lambda f: F.when(F.pow(F.col(f), F.lit(3)) > EPSILON, F.pow(F.col(f), F.lit(3))).otherwise((116 * F.col(f) - 16) / KAPPA)
    y = F.when(F.col(lab[0]) > KAPPA * EPSILON, F.pow("_fy", F.lit(3))).otherwise(F.col(lab[0]) / KAPPA)
    return df.withColumns({names[0]: back("_fx") * white[0], names[1]: y * white[1], names[2]: back("_fz") * white[2]}).drop("_fx", "_fy", "_fz")


def with_srgb_of_xyz(df: DataFrame, xyz: tuple[str, str, str] = ("X", "Y", "Z"), names: tuple[str, str, str] = ("sr", "sg", "sb")) -> DataFrame:
    """Adds sRGB in 0..1, clamped, of XYZ (D50)."""
    return df.withColumns({n: gamma(_row(FROM_XYZ, i, *map(F.col, xyz))) for i, n in enumerate(names)})


def with_hex_of_lab(df: DataFrame, lab: tuple[str, str, str], name: str = "hex") -> DataFrame:
    """Adds '#RRGGBB' of a Lab triple, rounded half to even."""
    df = with_srgb_of_xyz(with_xyz_of_lab(df, lab, ("_X", "_Y", "_Z")), ("_X", "_Y", "_Z"), ("_r", "_g", "_b"))
    byte = lambda c: F.rint(F.col(c) * 255).cast("int")
    return df.withColumn(name, hex_of(byte("_r"), byte("_g"), byte("_b"))).drop("_X", "_Y", "_Z", "_r", "_g", "_b")


def with_lab_d65(df: DataFrame, r: str, g: str, b: str, prefix: str = "") -> DataFrame:
    """Adds Lab of sRGB bytes at their own white, as image libraries do."""
    df = df.withColumns({f"_l{i}": linear(F.col(c) / 255.0) for i, c in enumerate((r, g, b))})
    df = df.withColumns({f"_x{i}": _row(SRGB_XYZ, i, *(F.col(f"_l{j}") for j in range(3))) / D65[i] for i in range(3)})
    df = df.withColumns({f"_f{i}": F.when(F.col(f"_x{i}") > EPSILON, F.cbrt(f"_x{i}")).otherwise((F.col(f"_x{i}") * KAPPA + 16) / 116) for i in range(3)})
    lab = {f"{prefix}L": F.col("_f1") * 116 - 16, f"{prefix}a": (F.col("_f0") - F.col("_f1")) * 500, f"{prefix}b_": (F.col("_f1") - F.col("_f2")) * 200}
    return df.withColumns(lab).drop(*(f"_{k}{i}" for k in "lxf" for i in range(3)))


def luminance_density(r: Column, g: Column, b: Column) -> Column:
    """Visual density of linear channels."""
    held = lambda c: F.least(F.greatest(c, F.lit(1e-4)), F.lit(1.0))
    return density(F.least(sum((held(c) * k for c, k in zip((g, b), SRGB_XYZ[1][1:], strict=True)), held(r) * SRGB_XYZ[1][0]), F.lit(1.0)))


def swatch(lab_hex: Column, cmyk: Column) -> Column:
    """Hex of an ink: of its Lab, else of its CMYK array, else null."""
    channel = lambda i: F.rint(255 * (1 - F.element_at(cmyk, i)) * (1 - F.element_at(cmyk, 4)))
    return F.coalesce(lab_hex, F.when(F.size(cmyk) == 4, hex_of(channel(1), channel(2), channel(3))))


def red_contrast(bar_red: Column, paper_red: Column) -> Column:
    """Print contrast under red light of sRGB red channels in 0..1."""
    return 1 - linear(bar_red) / F.greatest(linear(paper_red), F.lit(1e-6))


def with_paper_flag(df: DataFrame, lab: tuple[str, str, str], name: str = "paper", below: float = 10.0) -> DataFrame:
    """Adds whether a Lab triple is near the reference paper."""
    df = df.withColumns({f"_p{i}": F.lit(v) for i, v in enumerate(PAPER)})
    return with_delta_e2000(df, lab, ("_p0", "_p1", "_p2"), "_de").withColumn(name, F.col("_de") < below).drop("_p0", "_p1", "_p2", "_de")


def with_mixture(df: DataFrame, inks: str, substrate: tuple = PAPER, n: float | Column = 1.7, prefix: str = "m") -> DataFrame:
    """Adds Lab of inks printed one after another on a substrate, as `{prefix}L`, `{prefix}a`, `{prefix}b_`.

    `inks` is array<struct<L, a, b, opacity, cov>> in printing order, cov in 0..1.  Transparent inks
    multiply what is below, opaque ones cover it; reflectances are raised to 1/n.
    """
    plain = lambda lab: F.struct(F.lit(float(lab[0])).alias("L"), F.lit(float(lab[1])).alias("a"), F.lit(float(lab[2])).alias("b"), F.lit(0.0).alias("opacity"), F.lit(0.0).alias("cov"))
    d = lambda i, f: i[f].cast("double")
    given = F.transform(inks, lambda i: F.struct(d(i, "L").alias("L"), d(i, "a").alias("a"), d(i, "b").alias("b"), d(i, "opacity").alias("opacity"), F.least(F.greatest(d(i, "cov"), F.lit(0.0)), F.lit(1.0)).alias("cov")))
    df = df.withColumn("_i", F.concat(F.array(plain(substrate), plain(PAPER)), given))
    df = df.withColumn("_i", F.transform("_i", lambda i: F.struct(((i["L"] + 16) / 116 + i["a"] / 500).alias("x"), ((i["L"] + 16) / 116).alias("y"), ((i["L"] + 16) / 116 - i["b"] / 200).alias("z"), i["L"].alias("L"), i["opacity"].alias("o"), i["cov"].alias("t"))))
    back = lambda f: F.when(f * f * f > EPSILON, f * f * f).otherwise((116 * f - 16) / KAPPA)
    df = df.withColumn("_i", F.transform("_i", lambda i: F.struct((back(i["x"]) * WHITE[0]).alias("x"), F.when(i["L"] > KAPPA * EPSILON, i["y"] * i["y"] * i["y"]).otherwise(i["L"] / KAPPA).alias("y"), (back(i["z"]) * WHITE[2]).alias("z"), i["o"].alias("o"), i["t"].alias("t"))))
    root = lambda v: F.pow(F.least(F.greatest(v, F.lit(1e-4)), F.lit(1.5)), 1 / n if isinstance(n, Column) else F.lit(1 / n))
    df = df.withColumn("_i", F.transform("_i", lambda i: F.struct(*(root(_row(XYZ_WIDE, k, i["x"], i["y"], i["z"])).alias(c) for k, c in enumerate("rgb")), i["o"].alias("o"), i["t"].alias("t"))))
    df = df.withColumns({"_paper": F.element_at("_i", 2), "_start": F.element_at("_i", 1)})

    def printed(below: Column, i: Column) -> Column:
        def channel(c: str) -> Column:
            through = F.least(F.greatest(i[c] / F.col(f"_paper.{c}"), F.lit(0.0)), F.lit(1.5))
            clear = below[c] * (1 - i["t"] * (1 - through))
            alpha = F.least(i["t"] * i["o"], F.lit(1.0))
            cover = alpha * i[c] + (1 - alpha) * below[c]
            return F.when(i["o"] <= 0, clear).when(i["o"] >= 0.999, cover).otherwise((1 - i["o"]) * clear + i["o"] * cover)

        return F.struct(*(channel(c).alias(c) for c in "rgb"))

    start = F.struct(*(F.col(f"_start.{c}").alias(c) for c in "rgb"))
    df = df.withColumn("_m", F.aggregate(F.slice("_i", 3, F.greatest(F.size("_i") - 2, F.lit(0))), start, printed))
    df = df.withColumns({f"_w{c}": F.pow(F.col(f"_m.{c}"), n if isinstance(n, Column) else F.lit(n)) for c in "rgb"})
    df = df.withColumns({f"_x{k}": _row(WIDE_XYZ, k, F.col("_wr"), F.col("_wg"), F.col("_wb")) / WHITE[k] for k in range(3)})
    df = df.withColumns({f"_f{k}": F.when(F.col(f"_x{k}") > EPSILON, F.cbrt(f"_x{k}")).otherwise((F.col(f"_x{k}") * KAPPA + 16) / 116) for k in range(3)})
    lab = {f"{prefix}L": F.col("_f1") * 116 - 16, f"{prefix}a": (F.col("_f0") - F.col("_f1")) * 500, f"{prefix}b_": (F.col("_f1") - F.col("_f2")) * 200}
    return df.withColumns(lab).drop("_i", "_paper", "_start", "_m", "_wr", "_wg", "_wb", *(f"_{k}{j}" for k in "xf" for j in range(3)))


def limited(cmyk: list[Column], limit: float) -> list[Column]:
    """CMYK percentages with the coloured inks scaled down to a total of `limit`; black stays."""
    c, m, y, k = cmyk
    coloured = c + m + y
    scale = F.when(coloured + k > limit, F.least(F.greatest(F.lit(limit) - k, F.lit(0.0)) / F.greatest(coloured, F.lit(1e-6)), F.lit(1.0))).otherwise(1.0)
    return [c * scale, m * scale, y * scale, k]


def jpeg_quality(table: Column, standard_sum: float = 3688.0) -> Column:
    """Quality by the sum of a luminance quantisation table; 3688 is the standard table's."""
    scale = 100.0 * F.aggregate(table, F.lit(0.0), lambda s, q: s + q) / standard_sum
    return F.round(F.when(scale > 100, 5000 / scale).otherwise((200 - scale) / 2), 1)


def jpeg_quality_of_mean(table: Column) -> Column:
    """Quality by the table's mean (57.6 at quality 50), held in 1..100; null without a table."""
    scale = F.aggregate(table, F.lit(0.0), lambda s, q: s + q) / F.nullif(F.size(table), F.lit(0)) / 57.6 * 100
    return F.when(F.size(table) > 0, F.least(F.greatest(F.when(scale <= 100, (200 - scale) / 2).otherwise(5000 / scale), F.lit(1.0)), F.lit(100.0)))
