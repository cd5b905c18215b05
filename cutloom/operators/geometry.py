"""Where a picture lies: crop rectangles, placement, canvas and layers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import numeric as N

NEUTRAL = (1.0, 0.0, 0.0, 0.0)  # scale, x, y and rotation of a picture that is fitted whole


def crop_origin(v) -> Column:
    """A crop may start one picture outside of the picture."""
    return N.clamp(v, -1.0, 2.0)


def crop_extent(v) -> Column:
    return N.clamp(v, 0.05, 3.0)


def has_crop(x, y, w, h) -> Column:
    return ~((N.col(x) == 0) & (N.col(y) == 0) & (N.col(w) == 1) & (N.col(h) == 1))


def conformed(rate="rate") -> Column:
    """Whether a clip is retimed."""
    return N.col(rate) != 1.0


def transform_of(scale, x, y, rotation) -> list[Column]:
    """A clip's placement; what is not set is neutral."""
    return [F.coalesce(N.col(c), F.lit(d)) for c, d in zip((scale, x, y, rotation), NEUTRAL, strict=True)]


def set_transform(scale, x, y, rotation) -> list[Column]:
    """The same with what is set held to its range."""
    ends = ((0.1, 4.0), (-1.0, 1.0), (-1.0, 1.0), (-180.0, 180.0))
    return transform_of(*(F.when(N.col(c).isNotNull(), N.clamp(c, *e)) for c, e in zip((scale, x, y, rotation), ends, strict=True)))


def is_neutral_frame(scale, x, y, rotation) -> Column:
    s, x, y, r = transform_of(scale, x, y, rotation)
    return (s == 1) & (x == 0) & (y == 0) & (r == 0)


def matte_layer_size(w, h, width, height) -> list[Column]:
    """Pixels of the cropped layer, one at least."""
    return [F.greatest(N.half_even(N.col(a) * N.col(b)), F.lit(1)) for a, b in ((w, width), (h, height))]


def trackable(x, y, width, height, half: int, reach: int) -> Column:
    """Whether a feature's window, moved by ``reach`` at most, stays inside the picture; pixels count from 1."""
    inside = lambda c, n: (N.half_even(N.col(c)) - half - reach >= 1) & (N.half_even(N.col(c)) + half - 1 + reach <= N.col(n))
    return inside(x, width) & inside(y, height)


def layer_matrix(crop: tuple, layer: tuple, canvas: tuple, transform: tuple) -> list[Column]:
    """(a, b, c, d, tx, ty): canvas pixels to layer pixels, u = a x + b y + tx and v = c x + d y + ty, centres at halves.

    The crop (x, y, w, h as shares of the layer) is fitted whole into the canvas, then scaled, turned about its centre and moved by
    shares of the canvas.
    """
    (x, y, w, h), (lw, lh), (cw, ch), (scale, px, py, rotation) = ([N.col(v) for v in part] for part in (crop, layer, canvas, transform))
    size = F.least(cw / (w * lw), ch / (h * lh)) * scale
    cos, sin = F.cos(F.radians(rotation)) / size, F.sin(F.radians(rotation)) / size
    at_x, at_y = cw / 2 + 0.5 + px * cw, ch / 2 + 0.5 + py * ch
    return [cos, sin, -sin, cos, (x + w / 2) * lw + 0.5 - cos * at_x - sin * at_y, (y + h / 2) * lh + 0.5 + sin * at_x - cos * at_y]


def canvas_rect(matrix: list[Column], layer: tuple, canvas: tuple) -> list[Column]:
    """(x, y, w, h): the part of the layer, in shares of it, that the canvas shows: the box around all four corners."""
    a, b, c, d, tx, ty = matrix
    corners = [(x, y) for x in (F.lit(0.5), N.col(canvas[0]) + 0.5) for y in (F.lit(0.5), N.col(canvas[1]) + 0.5)]
    us = [(a * x + b * y + tx - 0.5) / N.col(layer[0]) for x, y in corners]
    vs = [(c * x + d * y + ty - 0.5) / N.col(layer[1]) for x, y in corners]
    left, top = F.least(*us), F.least(*vs)
    return [left, top, F.greatest(*us) - left, F.greatest(*vs) - top]


def dragged_crop(ax, ay, bx, by, width, height) -> Column:
    """The crop (x, y, w, h) between two corners of a preview, not held to the picture; null where under a hundredth wide or high."""
    ends = [(F.least(N.col(p), N.col(q)) / N.col(n), F.greatest(N.col(p), N.col(q)) / N.col(n)) for p, q, n in ((ax, bx, width), (ay, by, height))]
    (x0, x1), (y0, y1) = ends
    rect = F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))
    return F.when((x1 - x0 >= 0.01) & (y1 - y0 >= 0.01), rect)


def even_canvas(w, h, width, height) -> list[Column]:
    """The canvas that a crop sets: even sides, two pixels at least."""
    return [F.greatest(2 * N.div(N.half_even(N.col(a) * N.col(b)), 2), F.lit(2)).cast("long") for a, b in ((w, width), (h, height))]


def cropped(crop, scope, width, height, canvas_w, canvas_h, now_w, now_h) -> list[Column]:
    """The canvas after a crop: in scope ``canvas`` the crop's size, else the one it has, pinned at its present size where it had none."""
    new = even_canvas(N.col(crop)["w"], N.col(crop)["h"], width, height)
    return [F.when(N.col(crop).isNotNull() & (N.col(scope) == "canvas"), n).otherwise(F.coalesce(N.col(kept), F.when(N.col(crop).isNotNull(), N.col(now)))) for n, kept, now in zip(new, (canvas_w, canvas_h), (now_w, now_h), strict=True)]


def conform_note(source_fps, fps) -> Column:
    """What conforming does to a source, in words; empty where the rates agree."""
    rate = N.conform_rate(source_fps, fps)
    text = lambda c, n: F.round(c, n).cast("string")
    how = F.when(rate < 1, F.concat(F.lit("each frame held "), text(1 / rate, 1), F.lit("×"))).otherwise(F.concat(F.lit("every "), text(rate, 1), F.lit("ᵗʰ frame kept")))
    return F.when(rate == 1, F.lit("")).otherwise(F.concat(F.lit("conformed "), text(N.col(source_fps), 2), F.lit(" → "), text(N.col(fps), 2), F.lit(" fps ("), how, F.lit(")")))


def clock(n, total, fps: float) -> Column:
    """mm:ss.mmm and the frame of the last frame."""
    seconds = N.col(n) / fps
    minutes = N.floor_long(seconds / 60)
    return F.format_string("%02d:%06.3f  %d/%d", minutes, seconds - 60 * minutes, N.col(n), F.greatest(N.col(total) - 1, F.lit(0)))


def share(value, low, high) -> Column:
    """A parameter's place in its range, 0 to 1."""
    return N.clamp((N.col(value) - N.col(low)) / (N.col(high) - N.col(low)), 0.0, 1.0)


def from_share(at, low, high) -> Column:
    return N.col(low) + N.clamp(at, 0.0, 1.0) * (N.col(high) - N.col(low))


def locked_height(w, aspect, width, height) -> Column:
    """The height, as a share of the picture's, that gives a crop of this width the aspect."""
    return N.col(w) / (N.col(aspect) * N.col(height) / N.col(width))


def intersected(x, y, w, h, left, top, right, bottom) -> list[Column]:
    """A crop held inside a rectangle, a hundredth wide and high at least; as it is where it lies inside."""
    x, y, w, h, left, top, right, bottom = map(N.col, (x, y, w, h, left, top, right, bottom))
    inside = (x >= left) & (y >= top) & (x + w <= right) & (y + h <= bottom)
    nx, ny = F.greatest(x, left), F.greatest(y, top)
    held = nx, ny, F.greatest(F.least(x + w, right) - nx, F.lit(0.01)), F.greatest(F.least(y + h, bottom) - ny, F.lit(0.01))
    return [F.when(inside, a).otherwise(b) for a, b in zip((x, y, w, h), held, strict=True)]


def pixel_span(at, size, pixels) -> list[Column]:
    """First and last pixel, counted from 1, that a crop's side touches."""
    at, n = N.col(at), N.col(pixels)
    return [N.floor_long(at * n) + 1, F.ceil((at + N.col(size)) * n).cast("long")]


def region_span(at, size, pixels) -> list[Column]:
    """The same with both ends rounded and inside the picture, one pixel at least."""
    at, n = N.col(at), N.col(pixels)
    first = N.clamp(N.half_even(at * n) + 1, 1, n).cast("long")
    return [first, F.least(F.greatest(N.half_even((at + N.col(size)) * n), first), n).cast("long")]


def lane_at(y, height, last) -> Column:
    """The lane band that a position falls in."""
    return N.clamp(N.floor_long(N.col(y) / N.col(height)), 0, last).cast("long")
