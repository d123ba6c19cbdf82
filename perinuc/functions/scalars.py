"""Scalar rules over columns: text, units, boxes, angles, curve models."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Physical pixel size and the half width of the crop box.
PIXEL_NM = 128.0
RADIUS_PX = 37.5


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- text ---------------------------------------------------------------------------------


def first_digits(text: Column | str) -> Column:
    """First run of digits, or NULL."""
    return F.nullif(F.regexp_extract(col(text), r"\d+", 0), F.lit(""))


def split_tokens(text: Column | str, sep: str, names: Sequence[str]) -> list[Column]:
    """Split into as many columns as there are names; the rest stays in the last one, missing ones are NULL."""
    parts = F.split(col(text), sep, len(names))
    return [F.try_element_at(parts, F.lit(i + 1)).alias(n) for i, n in enumerate(names)]


def undouble(text: Column | str) -> Column:
    """Collapse a token that is written twice in a row (``_X_X`` becomes ``_X``), first place only.

    Only the first match is replaced, so the text is cut into before, token and rest.
    """
    hit = r"^(.*?)(_[A-Z0-9]+)\2(.*)$"
    return F.regexp_replace(col(text), hit, "$1$2$3")


def fixed(value: Column | str, digits: int = 3) -> Column:
    """Text with a fixed number of digits, rounded from the exact binary value as C's ``%.3f`` does, exact ties to even.

    Java's ``format_string`` rounds the shortest decimal spelling instead, so 1.0005, which lies below that, becomes 1.001.
    """
    v, scale = F.abs(col(value)), 10**digits
    # v in two parts whose products with 2 * scale are exact: the sign of what lies beyond the middle is exact, too
    wide = v * F.lit(134217729.0)
    head = wide - (wide - v)
    low = F.floor(v * F.lit(float(scale))) - F.lit(1)

    def beyond(k: Column) -> Column:
        return (head * F.lit(2.0 * scale) - (F.lit(2) * k + F.lit(1)).cast("double")) + (v - head) * F.lit(2.0 * scale)

    def up(k: Column) -> Column:
        return F.when((beyond(k) > 0) | ((beyond(k) == 0) & (k % 2 != 0)), F.lit(1)).otherwise(F.lit(0))

    k = F.greatest(low + up(low) + up(low + F.lit(1)) + up(low + F.lit(2)), F.lit(0))
    sign = F.when(F.signum(col(value)) < 0, F.lit("-")).otherwise(F.lit(""))
    text = F.concat(sign, F.floor(k / scale).cast("string"), F.lit("."), F.lpad((k % scale).cast("string"), digits, "0"))
    # beyond that, and for values that are no numbers, there is no digit left to round
    return F.when(v < F.lit(1e12 / scale), text).when(v.isNotNull(), F.format_string(f"%.{digits}f", col(value)))


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def stem(path: Column | str) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def parse_run_name(path: Column | str, prefix: str) -> Column:
    """Struct of strain, date, acquisition settings and batch, NULL when the name has fewer than seven parts."""
    name = stem(path)
    bare = F.when(name.startswith(prefix), F.substr(name, F.lit(len(prefix) + 1))).otherwise(name)
    p = F.split(bare, "_")
    return F.when(
        F.size(p) >= 7,
        F.struct(
            p[1].alias("strain"),
            F.concat_ws("_", p[2], p[3], p[4]).alias("date"),
            F.replace(p[5], F.lit("aqsettings"), F.lit("")).alias("aqsettings"),
            F.replace(p[6], F.lit("batch"), F.lit("")).alias("batch"),
        ),
    )


# ---- units and magnitudes -----------------------------------------------------------------


def to_nm(px: Column | str, px_nm: float = PIXEL_NM) -> Column:
    return col(px) * F.lit(px_nm)


def magnitude(dy: Column | str, dx: Column | str) -> Column:
    return F.sqrt(col(dy) * col(dy) + col(dx) * col(dx))


def rss(dy, dx, angle, dscale, radius: float = RADIUS_PX) -> Column:
    """Root sum of squares in pixels; rotation and scaling count by their effect at the radius."""
    a = col(angle) * F.lit(radius)
    s = col(dscale) * F.lit(radius)
    return F.sqrt(col(dy) * col(dy) + col(dx) * col(dx) + a * a + s * s)


def exceeds(value: Column, limit: Column) -> Column:
    """``value > limit`` on operands rounded to nine digits, so that engines agree on near ties."""
    return F.round(value, 9) > F.round(limit, 9)


# ---- boxes --------------------------------------------------------------------------------


def box_iou(a: str, b: str) -> Column:
    """Overlap share of two boxes held in ``{prefix}left/top/right/bottom``."""
    left, top = F.greatest(f"{a}left", f"{b}left"), F.greatest(f"{a}top", f"{b}top")
    right, bottom = F.least(f"{a}right", f"{b}right"), F.least(f"{a}bottom", f"{b}bottom")
    both = (right - left) * (bottom - top)

    def area(p: str) -> Column:
        return (F.col(f"{p}right") - F.col(f"{p}left")) * (F.col(f"{p}bottom") - F.col(f"{p}top"))

    union = area(a) + area(b) - both
    apart = (right < left) | (bottom < top) | (union == 0)
    return F.when(apart, F.lit(0.0)).otherwise(both.cast("double") / union)


def pair_score(iou: Column | str, dist: Column | str) -> Column:
    return col(iou) / (F.lit(1.0) + col(dist))


def range_overlap(s1, e1, s2, e2) -> Column:
    return F.greatest(F.least(col(e1), col(e2)) - F.greatest(col(s1), col(s2)), F.lit(0.0))


# ---- angles and points --------------------------------------------------------------------


def wrap_angle(a: Column | str) -> Column:
    """Map to [-pi, pi)."""
    return F.pmod(col(a) + F.lit(math.pi), F.lit(2 * math.pi)) - F.lit(math.pi)


def similarity(y, x, scale, angle, shift_y, shift_x, cy, cx) -> tuple[Column, Column]:
    """Rotate and scale row vectors about a centre, then translate; rows point down."""
    y, x, scale, angle = col(y), col(x), col(scale), col(angle)
    shift_y, shift_x, cy, cx = col(shift_y), col(shift_x), col(cy), col(cx)
    dy, dx = y - cy, x - cx
    cos, sin = F.cos(angle), F.sin(angle)
    return (
        (dy * cos - dx * sin) * scale + cy + shift_y,
        (dy * sin + dx * cos) * scale + cx + shift_x,
    )


def unit(ty: Column | str, tx: Column | str) -> tuple[Column, Column]:
    """Unit vector with a tiny guard against zero length."""
    size = magnitude(ty, tx) + F.lit(1e-9)
    return col(ty) / size, col(tx) / size


def normal_ends(y, x, ty, tx, length: float) -> dict[str, Column]:
    """Both ends of the line that crosses the curve at a right angle, half the length each way."""
    uy, ux = unit(ty, tx)
    ny, nx = -ux, uy
    half = F.lit(length / 2.0)
    return {
        "y0": col(y) + half * ny,
        "x0": col(x) + half * nx,
        "y1": col(y) - half * ny,
        "x1": col(x) - half * nx,
    }


def move_along_normal(y, x, ty, tx, mu, length: float) -> tuple[Column, Column]:
    uy, ux = unit(ty, tx)
    step = col(mu) - F.lit(length / 2.0)
    return col(y) - ux * step, col(x) + uy * step


def clip(c: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


# ---- profile models -----------------------------------------------------------------------

# Guards of the profile models.
MODEL_GUARD = 1e-6
MODEL_FLOOR = 1e-9


def gaussian_linear(t, slope, intercept, mu, sigma, amplitude) -> Column:
    d = col(t) - col(mu)
    bump = col(amplitude) * F.exp(-(d * d) / (F.lit(2.0) * col(sigma) * col(sigma)))
    return F.greatest(col(slope) * col(t) + col(intercept) + bump, F.lit(MODEL_FLOOR))


def richards_gaussian(t, a, k, b, c, nu, q, m, mu, sigma, amplitude, offset) -> Column:
    guard = F.lit(MODEL_GUARD)
    nu, c, sigma = (F.greatest(col(v), guard) for v in (nu, c, sigma))
    base = F.greatest(c + col(q) * F.exp(-col(b) * (col(t) - col(m))), guard)
    rise = col(a) + (col(k) - col(a)) / F.pow(base, F.lit(1.0) / nu)
    d = col(t) - col(mu)
    bump = col(amplitude) * F.exp(-(d * d) / (F.lit(2.0) * sigma * sigma))
    return F.greatest(rise + bump + col(offset), F.lit(MODEL_FLOOR))


MODELS = {"richards_gaussian": richards_gaussian, "gaussian_linear": gaussian_linear}


def eval_model(name: str, t: Column | str, theta: Sequence[Column | str]) -> Column:
    """Value of a named profile model at ``t`` with its parameters in order."""
    return MODELS[name](t, *theta)
