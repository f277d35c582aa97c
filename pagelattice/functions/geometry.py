"""Column functions over points and boxes. Boxes are structs with corners bl, br, tl, tr (_x, _y); y grows downward."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The zoom ladder.
ZOOM = (0.08, 0.125, 0.25, 0.33, 0.5, 0.67, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0, 24.0, 32.0, 48.0, 64.0)
#: Pixels of a point, and the height of a thumbnail.
PPI_SCALE, THUMBNAIL = 144 / 72, 135


def euclidean(x1, y1, x2, y2, wx: float = 1.0, wy: float = 1.0) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(wx * dx * dx + wy * dy * dy)


def manhattan(x1, y1, x2, y2) -> Column:
    return F.abs(x1 - x2) + F.abs(y1 - y2)


def vertical(y1, y2) -> Column:
    return F.abs(y2 - y1)


def horizontal(x1, x2) -> Column:
    return F.abs(x2 - x1)


def angle(x1, y1, x2, y2) -> Column:
    """Degrees of the way from the first point to the second."""
    return F.degrees(F.atan2(y2 - y1, x2 - x1))


def bound_180(a: Column) -> Column:
    return F.pmod(a + 180, F.lit(360.0)) - 180


def bound_360(a: Column) -> Column:
    return F.pmod(a, F.lit(360.0))


def almost_equal(a: Column, b: Column, eps: float = 1e-5) -> Column:
    return F.abs(a - b) < eps


def within(a: Column, low: float, high: float) -> Column:
    return a.between(low, high)


def projection(px, py, ax, ay, bx, by) -> Column:
    """Place of a point's projection on the line a-b: 0 at a, 1 at b; null for a line of no length."""
    dx, dy = bx - ax, by - ay
    return ((px - ax) * dx + (py - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))


def projected(px, py, ax, ay, bx, by) -> tuple[Column, Column]:
    s = projection(px, py, ax, ay, bx, by)
    return ax + s * (bx - ax), ay + s * (by - ay)


def point_in_line(px, py, ax, ay, bx, by, eps: float = 1e-3) -> Column:
    """Whether a point of the line through a-b lies between both."""
    s = F.when(F.abs(bx - ax) >= F.abs(by - ay), (px - ax) / F.nullif(bx - ax, F.lit(0.0))).otherwise((py - ay) / F.nullif(by - ay, F.lit(0.0)))
    return F.coalesce(s.between(-eps, 1 + eps), F.lit(False))


def line_pair(p: tuple, q: tuple, eps: float = 1e-3, points: bool = True) -> dict[str, Column]:
    """Of lines p and q (x and y of both ends): `turn`, degrees from p to q; `share` of q that p's ends, moved square to p onto q, overlap with
    (negative: the gap); `square`, the signed distance square to p of the middle of that share; `overlaps`. Lines square to each other have no share and no
    distance (null) and don't overlap; equal lines have no turn and no distance. The rule of `operators.layout.blocking`, for tables.

    points: whether equal lines of no length are equal lines too; else they are lines square to each other."""
    (px1, py1, px2, py2), (qx1, qy1, qx2, qy2) = p, q
    vx, vy, ux, uy = px2 - px1, py2 - py1, qx2 - qx1, qy2 - qy1
    same = F.lit(True)
    for a, b in zip(p, q, strict=True):
        same = same & (F.abs(a - b) < eps)
    along = ux * vx + uy * vy
    along = F.when(F.abs(along) >= eps, along)
    if not points:
        same = same & along.isNotNull()
    place = lambda x, y: ((x - qx1) * vx + (y - qy1) * vy) / along  # noqa: E731  of a moved end on q: 0 at its start, 1 at its end
    a, b = place(px1, py1), place(px2, py2)
    # greatest and least pass nulls over
    c, d = (F.when(along.isNotNull(), x) for x in (F.greatest(F.least(a, b), F.lit(0.0)), F.least(F.greatest(a, b), F.lit(1.0))))
    half = (c + d) / 2
    mx, my = qx1 + half * ux - px1, qy1 + half * uy - py1
    square = F.when(F.abs(vy) < eps, my).otherwise(F.signum(vy) * (mx * vy - my * vx) / F.sqrt(vx * vx + vy * vy))
    turn = bound_180(F.degrees(F.atan2(uy, ux) - F.atan2(vy, vx)))
    return {
        "turn": F.when(same, 0.0).otherwise(turn),
        "share": F.when(same, 1.0).otherwise(d - c),
        "square": F.when(same, 0.0).otherwise(square),
        "overlaps": F.coalesce(same | (c <= d), F.lit(False)),
    }


def orientation(sx, sy, ex, ey, rotation=None, eps: float = 1e-4) -> Column:
    """Orientation of a baseline; one of no length takes the rotation (degrees) of its box. Rotate90 reads upward, Rotate270 downward."""
    dx, dy = ex - sx, ey - sy
    flat, upright = F.abs(dy) < eps, F.abs(dx) < eps
    by_line = F.when(flat, F.when(dx > 0, "Horizontal").otherwise("Rotate180")).when(upright, F.when(dy < 0, "Rotate90").otherwise("Rotate270")).otherwise("Other")
    if rotation is None:
        return by_line
    r = F.pmod(rotation, F.lit(360.0))
    near = lambda v: F.abs(r - v) < eps
    by_box = F.when(near(0) | near(360), "Horizontal").when(near(180), "Rotate180").when(near(270), "Rotate90").when(near(90), "Rotate270").otherwise("Other")
    return F.when(flat & upright, by_box).otherwise(by_line)


def group_orientation(o: Column) -> Column:
    """Aggregate: the common orientation, else Other."""
    return F.when(F.min(o) == F.max(o), F.min(o)).otherwise("Other")


def in_box(px, py, left, top, right, bottom) -> Column:
    """The border counts as inside."""
    return px.between(left, right) & py.between(top, bottom)


def overlap_area(l1, t1, r1, b1, l2, t2, r2, b2) -> Column:
    zero = F.lit(0.0)
    return F.greatest(F.least(r1, r2) - F.greatest(l1, l2), zero) * F.greatest(F.least(b1, b2) - F.greatest(t1, t2), zero)


def overlap(a: tuple, b: tuple) -> tuple[Column, Column, Column, Column]:
    """The intersection of two boxes (left, top, right, bottom); empty where it is inside out."""
    return F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])


def flip_y(y: Column, height: Column) -> Column:
    return height - y


def quarter_turn(r: Column, back: bool = False) -> Column:
    return (r + (270 if back else 90)) % 360


def shown_size(w: Column, h: Column, rotation: Column) -> tuple[Column, Column]:
    turned = rotation.isin(90, 270)
    return F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)


def thumbnail_width(w: Column, h: Column) -> Column:
    return F.greatest(F.floor(w / h * THUMBNAIL), F.lit(1)).cast("int")


def visible_area(rotation: Column, page: tuple, view: tuple) -> tuple[Column, Column, Column, Column]:
    """x, y, width, height of what a view (left, top, right, bottom) shows of a page (the same), in the page's own turn."""
    x, y = view[0] - page[0], view[1] - page[1]
    r, b = view[2] - page[0], view[3] - page[1]
    w, h, pw, ph = r - x, b - y, page[2] - page[0], page[3] - page[1]
    turn = lambda v0, v90, v180, v270: F.when(rotation == 90, v90).when(rotation == 180, v180).when(rotation == 270, v270).otherwise(v0)
    return turn(x, y, pw - r, ph - b), turn(y, pw - r, ph - b, x), turn(w, h, w, h), turn(h, w, h, w)


def goto_offset(offset: Column, height: Column, rotation: Column, from_bottom: Column) -> Column:
    """Where to scroll within a page: at most its height; counted from the bottom, or 0 on a turned page."""
    top = F.least(offset, height)
    return F.when(from_bottom, F.when(rotation == 0, height - top).otherwise(0.0)).otherwise(top)


def zoom_step(level: Column, up: bool = True) -> Column:
    """The next rung of the zoom ladder."""
    rungs = F.array(*(F.lit(z) for z in ZOOM))
    found = F.array_min(F.filter(rungs, lambda z: z > level)) if up else F.array_max(F.filter(rungs, lambda z: z < level))
    return F.coalesce(found, F.lit(ZOOM[-1 if up else 0]))


def highest_one_bit(n: Column) -> Column:
    """The highest set bit of a 32-bit number, as a 32-bit number; 0 for 0."""
    bits = F.length(F.bin(n.cast("int").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))))
    return F.when(n.cast("int") == 0, F.lit(0)).otherwise(F.pow(F.lit(2.0), bits - 1).cast("bigint"))


def strokes(mode: Column) -> Column:
    """Text render modes that draw outlines."""
    return mode.isin(1, 2, 5, 6)


def fills(mode: Column) -> Column:
    return mode.isin(0, 2, 4, 6)


def letter_box(position_from, position_to, o: Column, left, top, right, bottom) -> tuple[Column, Column, Column, Column]:
    """The box of a letter from its cumulative positions along a word's box."""
    pick = lambda h, r180, r90, r270: F.when(o == "Rotate180", r180).when(o == "Rotate90", r90).when(o == "Rotate270", r270).otherwise(h)
    return (
        pick(left + position_from, right - position_to, left, left),
        pick(top, top, bottom - position_to, top + position_from),
        pick(left + position_to, right - position_from, right, right),
        pick(bottom, bottom, bottom - position_from, top + position_to),
    )
