"""Affine registrations: 15 parameters, 4x4 matrices, fits from landmarks.

Parameters come in five rows of three: translation t, rotation (degrees), scale,
shear and centre c.  A point p goes to ``R U (p - c) + c + t`` where R turns about
x, y and z and U is upper triangular with the scales on its diagonal and the
shears above it.  Parameters and matrices are small arrays; tables of points are
transformed by expressions, landmark sets are fitted one Arrow call a set.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .geometry import AXES, transform_points

IDENTITY = np.array([[0, 0, 0], [0, 0, 0], [1, 1, 1], [0, 0, 0], [0, 0, 0]], dtype=float)


def turn(degrees: np.ndarray) -> np.ndarray:
    (c0, s0), (c1, s1), (c2, s2) = ((math.cos(math.radians(d)), math.sin(math.radians(d))) for d in degrees)
    return np.array([[c2, s2, 0], [-s2, c2, 0], [0, 0, 1]]) @ np.array([[c1, 0, s1], [0, 1, 0], [-s1, 0, c1]]) @ np.array([[1, 0, 0], [0, c0, -s0], [0, s0, c0]])


def compose(params: np.ndarray) -> np.ndarray:
    """4x4 matrix (column vectors) of 5x3 parameters."""
    move, degrees, scale, shear, centre = np.asarray(params, dtype=float).reshape(5, 3)
    linear = turn(degrees) @ np.array([[scale[0], shear[0], shear[1]], [0, scale[1], shear[2]], [0, 0, scale[2]]])
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = linear, move + centre - linear @ centre
    return out


def decompose(matrix: np.ndarray, centre: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> np.ndarray:
    """5x3 parameters of a 4x4 matrix around ``centre``; a reflection makes the x scale negative."""
    m, c = np.asarray(matrix, dtype=float), np.asarray(centre, dtype=float)
    r, u = np.linalg.qr(m[:3, :3])
    sign = np.where(np.diag(u) < 0, -1.0, 1.0)
    sign[0] *= np.linalg.det(r * sign)
    r, u = r * sign, sign[:, None] * u
    c1 = math.hypot(r[2, 1], r[2, 2])
    degrees = np.degrees([math.atan2(r[2, 1], r[2, 2]), math.atan2(-r[2, 0], c1), math.atan2(-r[1, 0], r[0, 0])])
    return np.array([m[:3, 3] - c + m[:3, :3] @ c, degrees, np.diag(u), [u[0, 1], u[0, 2], u[1, 2]], c])


def inverse_rotation(x: float, y: float, z: float, degrees: bool = False) -> np.ndarray:
    """Rz Ry Rx as 4x4, the product of :func:`geometry.rotation` in the other order."""
    from .geometry import rotation

    return rotation(0, 0, z, degrees) @ rotation(0, y, 0, degrees) @ rotation(x, 0, 0, degrees)


def flip(axis: int, n: int, voxel: float) -> np.ndarray:
    """Parameters that mirror one axis of a volume of ``n`` voxels onto itself."""
    out = IDENTITY.copy()
    out[2, axis], out[0, axis] = -1.0, (n - 1) * voxel
    return out


def registration(params: np.ndarray, reference: str = "dummy", model: str = "dummy", legacy: bool = False) -> dict:
    """The parameters as a typed-stream document; ``legacy`` names the moving side as old versions do."""
    move, degrees, scale, shear, centre = np.asarray(params, dtype=float).reshape(5, 3).tolist()
    moving = "model_study" if legacy else "floating_study"
    return {"registration": {"reference_study": reference, moving: model, "affine_xform": {"xlate": move, "rotate": degrees, "scale": scale, "shear": shear, "center": centre}}}


def params_of(document: dict) -> np.ndarray:
    """5x3 parameters of a registration document; a warp's own affine part comes first."""
    reg = document["registration"]
    affine = reg.get("spline_warp", {}).get("affine_xform") or reg["affine_xform"]
    return np.array([affine[k] for k in ("xlate", "rotate", "scale", "shear", "center")], dtype=float)


def matrix_of(document: dict, inverse: bool = False) -> np.ndarray:
    m = compose(params_of(document))
    return np.linalg.inv(m) if inverse else m


def global_scale(document: dict) -> float:
    """Volume factor of a registration: the product of its scales."""
    return float(np.prod(params_of(document)[2]))


# ---------------------------------------------------------------- landmark fits
def least_squares(p: np.ndarray, q: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    w = np.ones(len(p)) if weight is None else weight
    a = np.c_[p, np.ones(len(p))] * np.sqrt(w)[:, None]
    out = np.eye(4)
    out[:3] = np.linalg.lstsq(a, q * np.sqrt(w)[:, None], rcond=None)[0].T
    return out


def least_absolute(p: np.ndarray, q: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Affine matrix with the least sum of absolute residuals of each axis, by reweighting."""
    out = np.eye(4)
    for axis in range(3):
        a, row = np.c_[p, np.ones(len(p))], None
        w = np.ones(len(p))
        for _ in range(rounds):
            new = np.linalg.lstsq(a * np.sqrt(w)[:, None], q[:, axis] * np.sqrt(w), rcond=None)[0]
            if row is not None and np.allclose(new, row, rtol=1e-12, atol=1e-12):
                break
            row = new
            w = 1 / np.maximum(np.abs(a @ row - q[:, axis]), 1e-9)
        out[axis] = row
    return out


def rigid(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Rotation and translation with the least squares, from the singular vectors of the covariance."""
    mp, mq = p.mean(axis=0), q.mean(axis=0)
    u, _, vt = np.linalg.svd((q - mq).T @ (p - mp))
    r = u @ np.diag([1, 1, np.linalg.det(u @ vt)]) @ vt
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = r, mq - r @ mp
    return out


def fit_params(p: np.ndarray, q: np.ndarray, dofs: int = 9, start: np.ndarray | None = None, rounds: int = 200) -> np.ndarray:
    """First 3, 6, 9 or 12 parameters by damped least squares, the others as ``start`` has them."""
    if dofs not in (3, 6, 9, 12):
        raise ValueError("3, 6, 9 or 12 parameters can be fitted")
    x = (IDENTITY if start is None else np.asarray(start, dtype=float).reshape(5, 3)).ravel().copy()

    def gap(v):
        m = compose(v)
        return (p @ m[:3, :3].T + m[:3, 3] - q).ravel()

    damp, now = 1e-3, gap(x)
    for _ in range(rounds):
        slope = np.stack([(gap(x + 1e-6 * np.eye(15)[i]) - now) / 1e-6 for i in range(dofs)], axis=1)
        square = slope.T @ slope
        step = np.linalg.solve(square + damp * np.diag(np.diag(square) + 1e-12), -slope.T @ now)
        new = x.copy()
        new[:dofs] += step
        after = gap(new)
        if after @ after < now @ now:
            done = now @ now - after @ after < 1e-18 * (1 + now @ now)
            x, now, damp = new, after, damp / 3
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return x.reshape(5, 3)


FITS = {"affine": least_squares, "affine_l1": least_absolute, "rigid": rigid, **{f"params{n}": (lambda p, q, n=n: compose(fit_params(p, q, n))) for n in (3, 6, 9, 12)}}


def fit_landmarks(landmarks: DataFrame, kind: str = "affine_l1", swap: bool = False) -> DataFrame:
    """``pair_id, matrix`` (16 values, row by row) that takes set 1 of a pair to set 2 (``swap``: back)."""
    fit = FITS[kind]
    own = landmarks.schema["pair_id"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("set_no", "ascending"), ("marker_no", "ascending")])
        sets = np.asarray(t.column("set_no").to_numpy())
        xyz = np.stack([t.column(c).to_numpy() for c in AXES], axis=1).astype(float)
        p, q = xyz[sets == 1], xyz[sets == 2]
        m = fit(q, p) if swap else fit(p, q)
        return pa.table({"pair_id": t.column("pair_id").slice(0, 1), "matrix": pa.array([m.ravel().tolist()])})

    return landmarks.select("pair_id", "set_no", "marker_no", *AXES).groupBy("pair_id").applyInArrow(run, f"pair_id {own}, matrix array<double>")


def transform_by(points: DataFrame, transforms: DataFrame, key: str) -> DataFrame:
    """x, y, z through the matrix that ``transforms(key, matrix)`` has for a row's key; rows without one get nulls."""
    m = lambda i, j: F.get("matrix", F.lit(4 * i + j))
    joined = points.join(transforms.select(key, "matrix"), key, "left")
    moved = {a: m(i, 0) * F.col("x") + m(i, 1) * F.col("y") + m(i, 2) * F.col("z") + m(i, 3) for i, a in enumerate(AXES)}
    return joined.withColumns(moved).drop("matrix")


def invert(points: DataFrame, matrix: np.ndarray) -> DataFrame:
    return transform_points(points, np.linalg.inv(matrix))


def invert_by(points: DataFrame, transforms: DataFrame, key: str) -> DataFrame:
    """x, y, z through the inverse of the matrix that ``transforms(key, matrix)`` has for a row's key.

    Rows without a matrix, or with a singular one, get nulls.
    """
    m = lambda i, j: F.get("matrix", F.lit(4 * i + j))
    joined = points.join(transforms.select(key, "matrix"), key, "left")
    moved = [F.col(a) - m(i, 3) for i, a in enumerate(AXES)]
    solved = solve3([[m(i, j) for j in range(3)] for i in range(3)], moved)
    return joined.withColumns(dict(zip(AXES, solved))).drop("matrix")


def det3(m: list[list[Column]]) -> Column:
    return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])


def solve3(m: list[list[Column]], right: list[Column]) -> list[Column]:
    """Solution of three linear equations (null where they are singular)."""
    whole = F.nullif(det3(m), F.lit(0.0))
    swapped = [[[right[i] if j == c else m[i][j] for j in range(3)] for i in range(3)] for c in range(3)]
    return [det3(s) / whole for s in swapped]


# --------------------------------------------------------------- spline warps
def bspline_weights(u: np.ndarray) -> np.ndarray:
    """The four uniform cubic B-spline weights of fractions, one row each."""
    return np.stack([(1 - u) ** 3, 3 * u**3 - 6 * u**2 + 4, -3 * u**3 + 3 * u**2 + 3 * u + 1, u**3], axis=1) / 6


def bspline_slopes(u: np.ndarray) -> np.ndarray:
    """Derivatives of the four weights by the fraction."""
    return np.stack([-((1 - u) ** 2), 3 * u**2 - 4 * u, -3 * u**2 + 2 * u + 1, u**2], axis=1) / 2


CELL = ["_ci", "_cj", "_ck"]


def warp_cells(controls: DataFrame) -> DataFrame:
    """For each cell of a control grid that has all of them, its 64 control points: arrays ``_px, _py, _pz``.

    A control point belongs to the 64 cells whose lowest index is up to three less on
    each axis; of several with one index the least counts.
    """
    one = _single_controls(controls)
    spread = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("o")
    rows = one.select("i", "j", "k", "c", spread)
    place = {"_ci": F.col("i") - F.floor(F.col("o") / 16), "_cj": F.col("j") - F.floor(F.col("o") / 4) % 4, "_ck": F.col("k") - F.col("o") % 4}
    rows = rows.select(*[v.cast("long").alias(n) for n, v in place.items()], "o", "c")
    listed = F.array_sort(F.collect_list(F.struct("o", "c")))
    cells = rows.groupBy(*CELL).agg(listed.alias("l")).where(F.size("l") == 64)
    return cells.select(*CELL, *[F.col(f"l.c.c{n}").alias(f"_p{n}") for n in AXES])


IMAGES = [f"_t{a}" for a in AXES]
SLOPES = [f"_j{a}{b}" for a in AXES for b in AXES]


#: Control points of a grid that every task may hold whole (24 bytes each); the cells of larger grids are joined to the points.
HELD = 1 << 18


class HeldGrid(NamedTuple):
    """A control grid over its box: lowest indices, places (0 where one is missing) and the cells that have all 64."""

    low: np.ndarray
    places: np.ndarray
    whole: np.ndarray

    def evaluated(self, at: np.ndarray, spacing: tuple[float, float, float], slopes: bool) -> tuple[np.ndarray, np.ndarray]:
        """Images of (n, 3) places in the first column of (n, 3, 1 or 4), derivatives by each axis in the others; and which places have a cell."""
        own = at / np.array(spacing, dtype=float)
        floor = np.clip(np.nan_to_num(np.floor(own)), -(2.0**60), 2.0**60)
        cell = floor.astype(np.int64) - self.low
        known = ((cell >= 0) & (cell < self.whole.shape)).all(axis=1)
        known[known] = self.whole[tuple(cell[known].T)]
        out = np.zeros((len(at), 3, 4 if slopes else 1))
        windows = np.moveaxis(np.lib.stride_tricks.sliding_window_view(self.places, (4, 4, 4), axis=(0, 1, 2)), 3, -1)
        rows = np.flatnonzero(known)
        for lo in range(0, len(rows), 1024):
            lot = rows[lo : lo + 1024]
            n, u = len(lot), own[lot] - floor[lot]
            # an axis after the other is contracted, by weights and, if asked, by slopes
            sets = [np.stack([bspline_weights(u[:, a]), *([bspline_slopes(u[:, a]) / spacing[a]] if slopes else [])], axis=1) for a in range(3)]
            m = sets[0].shape[1]
            value = sets[0] @ windows[tuple(cell[lot].T)].reshape(n, 4, 48)
            value = sets[1][:, None] @ value.reshape(n, m, 4, 12)
            value = sets[2][:, None, None] @ value.reshape(n, m, m, 4, 3)
            out[lot, :, 0] = value[:, 0, 0, 0]
            if slopes:
                out[lot, :, 1], out[lot, :, 2], out[lot, :, 3] = value[:, 1, 0, 0], value[:, 0, 1, 0], value[:, 0, 0, 1]
        return out, known


def _single_controls(controls: DataFrame) -> DataFrame:
    """Control points ``i, j, k, c`` (the least of several with one index) that are whole."""
    one = controls.groupBy("i", "j", "k").agg(F.min(F.struct("cx", "cy", "cz")).alias("c"))
    return one.where("i is not null and j is not null and k is not null and c.cx is not null and c.cy is not null and c.cz is not null")


def held_grid(controls: DataFrame, most: int | None = None) -> HeldGrid | None:
    """The control grid as arrays, or None where it (or its box, four times as much) has more than ``most`` points."""
    most = HELD if most is None else most
    rows = _single_controls(controls).select("i", "j", "k", *[F.col(f"c.c{a}").cast("double") for a in AXES]).limit(most + 1).toArrow()
    if rows.num_rows > most:
        return None
    index = np.stack([rows.column(n).to_numpy().astype(np.int64) for n in range(3)], axis=1)
    low, high = (index.min(axis=0), index.max(axis=0)) if len(index) else (np.zeros(3, dtype=np.int64),) * 2
    shape = [max(4, int(h) - int(lo) + 1) for lo, h in zip(low, high)]
    if math.prod(shape) > max(4 * most, 64):
        return None
    places, there = np.zeros((*shape, 3)), np.zeros(shape, dtype=bool)
    at = tuple((index - low).T)
    places[at] = np.stack([rows.column(n).to_numpy() for n in (3, 4, 5)], axis=1)
    there[at] = True
    return HeldGrid(low, places, np.lib.stride_tricks.sliding_window_view(there, (4, 4, 4)).all(axis=(3, 4, 5)))


def _contracted(control: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """Sums of (n, 4, 4, 4) control points by three (n, 4) weights."""
    for w in reversed(weights):
        control = (control * w.reshape(len(w), *[1] * (control.ndim - 2), 4)).sum(axis=-1)
    return control


def _in_batches(points: DataFrame, at: list[Column], fn: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], added: list[str]) -> DataFrame:
    """Adds columns ``added``: values (n, columns) that ``fn`` gives at (n, 3) places ``at``, null where its mask says so or a place is null."""
    rows = points.select("*", *[c.cast("double").alias(f"_at{n}") for n, c in enumerate(at)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *own, x, y, z = batch.columns
            there = np.flatnonzero(np.all([c.is_valid().to_numpy(zero_copy_only=False) for c in (x, y, z)], axis=0))
            values, missing = np.zeros((batch.num_rows, len(added))), np.ones(batch.num_rows, dtype=bool)
            found, known = fn(np.stack([c.take(pa.array(there)).to_numpy() for c in (x, y, z)], axis=1))
            values[there], missing[there] = found, ~known
            yield pa.record_batch([*own, *[pa.array(v, mask=missing) for v in values.T.copy()]], names=[*batch.schema.names[: len(own)], *added])

    schema = T.StructType([*points.schema.fields, *[T.StructField(c, T.DoubleType()) for c in added]])
    return rows.mapInArrow(run, schema)


def _warped(points: DataFrame, controls: DataFrame, spacing: tuple[float, float, float], slopes: bool) -> DataFrame:
    """Adds the warp's images and derivatives at the points, by tasks that hold the grid or, for a large one, by a join with its cells."""
    grid = held_grid(controls)
    if grid is None:
        return _evaluated(points, warp_cells(controls), spacing, AXES, slopes)
    shared = points.sparkSession.sparkContext.broadcast(grid)

    def values(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, known = shared.value.evaluated(at, spacing, slopes)
        return np.concatenate([found[:, :, 0], found[:, :, 1:].reshape(len(at), 9 * slopes)], axis=1), known

    return _in_batches(points, [F.col(a) for a in AXES], values, IMAGES + (SLOPES if slopes else []))


def _evaluated(points: DataFrame, cells: DataFrame, spacing: tuple[float, float, float], at: tuple[str, ...], slopes: bool) -> DataFrame:
    """Adds the warp's images ``_tx`` .. of the places ``at`` and, if asked, its derivatives ``_jxx`` (of x by x) ..; null without a cell."""
    place = {c: F.floor(F.col(a) / d).cast("long") for c, a, d in zip(CELL, at, spacing)}
    fractions = [(F.col(a) / d - F.floor(F.col(a) / d)).alias(f"_u{n}") for n, a, d in zip(AXES, at, spacing)]
    met = points.withColumns(place).join(cells, CELL, "left").select(*points.columns, *fractions, *[f"_p{a}" for a in AXES])
    added = IMAGES + (SLOPES if slopes else [])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *own, ux, uy, uz, px, py, pz = batch.columns
            known = np.flatnonzero(px.is_valid().to_numpy(zero_copy_only=False))
            taken = pa.array(known)
            u = [c.take(taken).to_numpy(zero_copy_only=False) for c in (ux, uy, uz)]
            control = [c.take(taken).flatten().to_numpy().reshape(-1, 4, 4, 4) for c in (px, py, pz)]
            weights = [bspline_weights(x) for x in u]
            values = [_contracted(c, weights) for c in control]
            if slopes:
                by_axis = [[bspline_slopes(u[n]) / spacing[n] if n == axis else weights[n] for n in range(3)] for axis in range(3)]
                values += [_contracted(c, by_axis[axis]) for c in control for axis in range(3)]
            columns = []
            for value in values:
                whole = np.zeros(batch.num_rows)
                whole[known] = value
                columns.append(pa.array(whole, mask=~px.is_valid().to_numpy(zero_copy_only=False)))
            yield pa.record_batch([*own, *columns], names=[*batch.schema.names[: len(own)], *added])

    schema = T.StructType([*points.schema.fields, *[T.StructField(c, T.DoubleType()) for c in added]])
    return met.mapInArrow(run, schema)


def warp_points(points: DataFrame, controls: DataFrame, spacing: tuple[float, float, float]) -> DataFrame:
    """Points through a B-spline warp given by absolute control points ``controls(i, j, k, cx, cy, cz)``.

    Control point (i, j, k) stands at ``(index - 1) * spacing``.  A grid of at most
    :data:`HELD` control points is held by every task; of a larger one each point meets
    its cell, one row with 64.  Where the cell lacks one the result is null.  ``from_x``, ``from_y`` and ``from_z`` keep the places before.
    """
    met = _warped(points, controls, spacing, slopes=False)
    return met.withColumns({f"from_{a}": F.col(a) for a in AXES}).withColumns({a: F.col(f"_t{a}") for a in AXES}).drop(*IMAGES)


def warp_jacobians(points: DataFrame, controls: DataFrame, spacing: tuple[float, float, float]) -> DataFrame:
    """Adds the warp's derivatives at each point, ``jxx`` (of x by x), ``jxy`` ..., and their determinant ``change``."""
    met = _warped(points, controls, spacing, slopes=True).drop(*IMAGES)
    named = met.withColumnsRenamed({c: c[1:] for c in SLOPES})
    return named.withColumn("change", det3([[F.col(f"j{a}{b}") for b in AXES] for a in AXES]))


def _newton(grid: HeldGrid, places: np.ndarray, spacing: tuple[float, float, float], rounds: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Where (n, 3) places come from, as :func:`unwarp_points` finds it, and which were found."""
    found, known = places.copy(), np.zeros(len(places), dtype=bool)
    cells = np.argwhere(grid.whole)
    if not len(cells):
        return found, known
    d = np.array(spacing, dtype=float)
    low, high = (grid.low + cells.min(axis=0)) * d, np.nextafter((grid.low + cells.max(axis=0) + 1) * d, -np.inf)
    hold = lambda c: np.fmin(np.fmax(c, low), high)
    at, guess = np.arange(len(places)), hold(places)
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            value, there = grid.evaluated(guess, spacing, True)
            rest = places[at] - value[:, :, 0]
            slope, right = [[value[:, i, j + 1] for j in range(3)] for i in range(3)], rest.T
            whole = det3(slope)
            swapped = [det3([[right[i] if j == c else slope[i][j] for j in range(3)] for i in range(3)]) for c in range(3)]
            step = np.stack(swapped, axis=1) / np.where(whole == 0, np.nan, whole)[:, None]
            moved = hold(guess + np.where(np.isnan(step), d, np.clip(step, -d, d)))
            done = there & (np.abs(rest).max(axis=1) <= tolerance)
            found[at[done]], known[at[done]] = guess[done], True
            on = there & ~done & (moved != guess).any(axis=1)
            at, guess = at[on], moved[on]
            if not len(at):
                break
    return found, known


def _unwarped(points: DataFrame, grid: HeldGrid, spacing: tuple[float, float, float], rounds: int, tolerance: float) -> DataFrame:
    shared = points.sparkSession.sparkContext.broadcast(grid)
    back = _in_batches(points, [F.col(a) for a in AXES], lambda at: _newton(shared.value, at, spacing, rounds, tolerance), IMAGES)
    own = [F.col(f"_t{c}").alias(c) if c in AXES else F.col(f"`{c}`") for c in points.columns]
    return back.select(*own, *[F.col(a).cast("double").alias(f"from_{a}") for a in AXES])


def unwarp_points(points: DataFrame, controls: DataFrame, spacing: tuple[float, float, float], rounds: int = 20, tolerance: float = 1e-9) -> DataFrame:
    """Places that a warp takes to the points: Newton steps with the warp's own derivatives.

    Tasks that hold the grid take all steps of a batch at once; with a grid of more than
    :data:`HELD` control points the rows that are not done meet the cell of their present
    guess each round.  They are done when the guess's image is within ``tolerance`` on every axis.  Guesses
    start at the point, move by a spacing at most and stay within the grid.  Rows that
    stand still, meet an incomplete cell or are not done after ``rounds`` get nulls.
    """
    grid = held_grid(controls)
    if grid is not None:
        return _unwarped(points, grid, spacing, rounds, tolerance)
    from arborkit.sources.files import scratch

    spark = points.sparkSession
    cells = warp_cells(controls)
    path = scratch(spark, "warp-cells")
    cells.write.parquet(path)
    cells = spark.read.parquet(path)
    ends = cells.agg(*[f(c) for c in CELL for f in (F.min, F.max)]).first()
    if ends[0] is None:
        return points.withColumns({f"from_{a}": F.col(a) for a in AXES} | {a: F.lit(None).cast("double") for a in AXES})
    box = [(float(lo) * d, float(np.nextafter((hi + 1) * d, -np.inf))) for lo, hi, d in zip(ends[::2], ends[1::2], spacing)]
    guess = [f"_g{a}" for a in AXES]
    hold = lambda c, n: F.least(F.greatest(c, F.lit(box[n][0])), F.lit(box[n][1]))
    state = points.withColumns({g: hold(F.col(a).cast("double"), n) for n, (g, a) in enumerate(zip(guess, AXES))})
    columns, finished = points.columns, []

    def ended(rows: DataFrame, found: bool) -> DataFrame:
        own = {a: F.col(g) if found else F.lit(None).cast("double") for a, g in zip(AXES, guess)}
        return rows.select(*[own.get(c, F.col(f"`{c}`")).alias(c) for c in columns], *[F.col(a).cast("double").alias(f"from_{a}") for a in AXES])

    for _ in range(rounds):
        met = _evaluated(state, cells, spacing, tuple(guess), slopes=True).withColumns({f"_r{a}": F.col(a) - F.col(f"_t{a}") for a in AXES})
        step = solve3([[F.col(f"_j{a}{b}") for b in AXES] for a in AXES], [F.col(f"_r{a}") for a in AXES])
        moved = [hold(F.col(g) + F.greatest(F.least(s, F.lit(float(d))), F.lit(-float(d))), n) for n, (g, s, d) in enumerate(zip(guess, step, spacing))]
        miss = F.greatest(*[F.abs(f"_r{a}") for a in AXES])
        known = F.col("_rx").isNotNull() & F.col("_ry").isNotNull() & F.col("_rz").isNotNull()
        rows = met.withColumn("_miss", F.when(known, miss)).withColumns({f"_n{a}": v for a, v in zip(AXES, moved)})
        still = F.coalesce((F.col("_nx") == F.col("_gx")) & (F.col("_ny") == F.col("_gy")) & (F.col("_nz") == F.col("_gz")), F.lit(True))
        rows = rows.withColumn("_state", F.when(F.col("_miss") <= tolerance, 0).when(F.col("_miss").isNull() | still, 1).otherwise(2))
        path = scratch(spark, "warp-round")
        rows.select(*columns, *guess, *[f"_n{a}" for a in AXES], "_state").write.parquet(path)
        rows = spark.read.parquet(path)
        finished += [ended(rows.where("_state = 0"), True), ended(rows.where("_state = 1"), False)]
        state = rows.where("_state = 2").select(*columns, *[F.col(f"_n{a}").alias(g) for a, g in zip(AXES, guess)])
        if not state.take(1):
            break
    else:
        finished.append(ended(state, False))
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out


def with_fallback(warped: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Points that a warp left null take the affine transform of where they came from."""
    m = np.asarray(matrix, dtype=float)
    affine = {a: sum((float(m[i, j]) * F.col(f"from_{b}") for j, b in enumerate(AXES)), F.lit(float(m[i, 3]))) for i, a in enumerate(AXES)}
    return warped.withColumns({a: F.coalesce(F.col(a), affine[a]) for a in AXES})


def tetrahedra(points: DataFrame, side: float = 1.0) -> DataFrame:
    """Four corners (``corner`` 0..3) of a regular tetrahedron around every point."""
    h = side / math.sqrt(8)
    corners = F.array(*[F.struct(*[F.lit(h * s).alias(f"d{a}") for a, s in zip(AXES, signs)]) for signs in ((1, 1, 1), (1, -1, -1), (-1, 1, -1), (-1, -1, 1))])
    return points.select("*", F.posexplode(corners).alias("corner", "_d")).withColumns({a: F.col(a) + F.col(f"_d.d{a}") for a in AXES}).drop("_d")


def corner_volume(corners: DataFrame, keys: list[str], before: bool = False) -> DataFrame:
    """Absolute ``volume`` of each tetrahedron; ``before``: that of the places that a warp took it from, too (``from_x`` ..)."""
    sides = {"volume": ""} | ({"before": "from_"} if before else {})
    at = {f"_{p}{a}{n}": F.max(F.when(F.col("corner") == n, F.col(p + a))) for p in sides.values() for a in AXES for n in range(4)}

    def volume(p: str) -> Column:
        e = lambda a, n: F.col(f"_{p}{a}{n}") - F.col(f"_{p}{a}0")
        cross = [e("y", 2) * e("z", 3) - e("z", 2) * e("y", 3), e("z", 2) * e("x", 3) - e("x", 2) * e("z", 3), e("x", 2) * e("y", 3) - e("y", 2) * e("x", 3)]
        return F.abs(sum((e(a, 1) * c for a, c in zip(AXES, cross)), F.lit(0.0))) / 6

    return corners.groupBy(*keys).agg(*[c.alias(n) for n, c in at.items()]).select(*keys, *[volume(p).alias(n) for n, p in sides.items()])
