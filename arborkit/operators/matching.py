"""Joins between segment sets and point clouds: synapses, neighbours, pair scores."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .geometry import angle_between, with_segment_distance
from .neighbours import squares
from .similarity import half_up

#: Longest prefix by which names are met.
MOST_LENGTHS = 64
SEG = [a + e for e in "01" for a in "xyz"]
#: Segments of a block of neurons, and pairs of segments that one step holds.
BLOCK_SEGMENTS, STEP_PAIRS = 20_000, 400_000
#: Segments of a block at most, however many blocks that makes; rows and columns of a table of pairs that stays in a core's cache; contacts held at once.
MOST_SEGMENTS, TILE, HELD = 1_000_000, (64, 1024), 2_000_000
#: Segments of a block of neurons that meet others over a grid, and the most blocks, as each segment travels once a block.
GRID_SEGMENTS, GRID_BLOCKS = 200_000, 24
#: A grid that leaves more than one pair of segments in so many is passed over for blocks; in so many times as many where blocks tell far segments by products.
PRUNED, CHEAPER = 8, 25


def _cells(df: DataFrame, size: float, prefix: str) -> DataFrame:
    return df.withColumns({f"c{a}": F.floor(F.col(f"{prefix}{a}0") / size) for a in "xyz"})


def _covered(df: DataFrame, size: float, s: float) -> DataFrame:
    """A row for each cell that a segment meets, as ``cx, cy, cz``.

    A segment is cut into pieces no longer than a cell; each piece takes the
    cells of its bounding box, grown by a little over half of ``s``.
    """
    length = F.sqrt(sum(((F.col(f"{n}1") - F.col(f"{n}0")) ** 2 for n in "xyz"), F.lit(0.0)))
    pieces = F.greatest(F.lit(1), F.ceil(length / size))
    grown = 0.51 * s + 1e-6 * size

    def cells(piece):
        spans = []
        for n in "xyz":
            ends = [F.col(f"{n}0") + (F.col(f"{n}1") - F.col(f"{n}0")) * (piece + e) / F.col("pieces") for e in (0, 1)]
            spans.append(F.sequence(F.floor((F.least(*ends) - grown) / size), F.floor((F.greatest(*ends) + grown) / size)))
        along = lambda x, y: F.transform(spans[2], lambda z: F.struct(x.alias("cx"), y.alias("cy"), z.alias("cz")))
        return F.flatten(F.transform(spans[0], lambda x: F.flatten(F.transform(spans[1], lambda y: along(x, y)))))

    cut = df.where(length.isNotNull()).withColumn("pieces", pieces)
    met = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1), cells)))
    return cut.withColumn("cell", F.explode(met)).select(*df.columns, "cell.*")


def _kept(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both segment sets from a scratch table, so that they are found once, however many steps read them."""
    from arborkit.sources.files import scratch

    def kept(df):
        path = scratch(df.sparkSession, "segments")
        df.select("neuron_id", *SEG).write.parquet(path)
        return df.sparkSession.read.parquet(path)

    one = kept(a)
    return one, one if a is b else kept(b)


def _all_synapses(a: DataFrame, b: DataFrame, s: float) -> DataFrame:
    """Pairs within ``s`` whatever the segments' lengths.

    Two segments within ``s`` share a cell.  The mean length sets the cells'
    size, so that the cells covered grow with the number of segments only.
    """
    def numbered(df):
        return df.select("neuron_id", *SEG, F.xxhash64("neuron_id", *SEG).alias("key")).groupBy("neuron_id", *SEG, "key").agg(F.count("*").alias("copies"))

    a, b = _kept(a, b)
    length = F.sqrt(sum(((F.col(f"{n}1") - F.col(f"{n}0")) ** 2 for n in "xyz"), F.lit(0.0)))
    mean = a.select(*SEG).unionAll(b.select(*SEG)).agg(F.avg(length)).first()[0] or 0.0
    size = max(mean / 16, 2 * s, 1e-9)
    sides = []
    for df, t in ((a, "a"), (b, "b")):
        side = _covered(numbered(df), size, s)
        sides.append(side.select("cx", "cy", "cz", F.col("neuron_id").alias(f"neuron_{t}"), F.col("key").alias(f"key_{t}"), F.col("copies").alias(f"copies_{t}"), *[F.col(c).alias(t + c) for c in SEG]))
    if _crowded(*sides, a, b, CHEAPER):
        return _dealt_blocks(a, None if a is b else b, SEG, partial(_contacts_of_neurons, s=s), "n", "long")
    pairs = sides[0].join(sides[1], ["cx", "cy", "cz"]).where("neuron_a < neuron_b")
    for n in "xyz":  # bounding boxes within s
        low, high = ([f([F.col(f"{t}{n}{e}") for e in "01"]) for t in "ab"] for f in (lambda x: F.least(*x), lambda x: F.greatest(*x)))
        pairs = pairs.where((low[0] <= high[1] + s * 1.01) & (low[1] <= high[0] + s * 1.01))
    ends = [[f"{t}{n}{e}" for n in "xyz"] for t in "ab" for e in "01"]
    # exploded, as a plain filter would be pushed down and repeat the arithmetic
    near = F.explode(F.array(F.col("distance") <= s)).alias("near")
    met = with_segment_distance(pairs, *ends).select("neuron_a", "neuron_b", "key_a", "key_b", (F.col("copies_a") * F.col("copies_b")).alias("n"), near).where("near")
    return met.distinct().groupBy("neuron_a", "neuron_b").agg(F.sum("n").alias("n"))


def segment_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared closest distances of all segments ``a`` (rows x0 .. z1) from all of ``b``: :func:`with_segment_distance` in numpy."""
    u, v = a[:, 3:] - a[:, :3], b[:, 3:] - b[:, :3]
    inner = lambda x, y: sum(x[:, n, None] * y[None, :, n] for n in range(3))
    uu, vv, uv = (u**2).sum(axis=1)[:, None], (v**2).sum(axis=1)[None, :], inner(u, v)
    uw = (u * a[:, :3]).sum(axis=1)[:, None] - inner(u, b[:, :3])
    vw = inner(a[:, :3], v) - (v * b[:, :3]).sum(axis=1)[None, :]
    ww, area = squares(a[:, :3], b[:, :3]), uu * vv - uv * uv
    squared = lambda s, t: ww + s * s * uu + t * t * vv + 2 * s * uw - 2 * t * vw - 2 * s * t * uv
    with np.errstate(invalid="ignore", divide="ignore"):
        held = lambda x: np.clip(np.nan_to_num(x, nan=0.0), 0.0, 1.0)
        least = squared(0.0, held(vw / vv))
        for s, t in ((1.0, held((vw + uv) / vv)), (held(-uw / uu), 0.0), (held((uv - uw) / uu), 1.0)):
            np.minimum(least, squared(s, t), out=least)
        s, t = (uv * vw - vv * uw) / area, (uu * vw - uv * uw) / area
        inside = (area > 1e-12 * uu * vv) & (s >= 0) & (s <= 1) & (t >= 0) & (t <= 1)
        return np.maximum(0.0, np.where(inside, np.minimum(least, squared(s, t)), least))


def _lines(segments: np.ndarray, middle: np.ndarray, s: float, first: bool) -> tuple[np.ndarray, ...]:
    """Factors, in single precision, of what :func:`contacts` asks of two segments' lines and of the spheres about them."""
    head, step = segments[:, :3] - middle, segments[:, 3:] - segments[:, :3]
    length = np.sqrt((step**2).sum(axis=1, keepdims=True))
    unit = np.divide(step, length, out=np.zeros_like(step), where=length > 0)
    moment, centre, half = np.cross(head, unit), head + step / 2, length / 2 + (s if first else 0.0)
    square, ones = (centre**2).sum(axis=1, keepdims=True) - half**2, np.ones_like(half)
    line = [unit, moment] if first else [moment, unit]
    sphere = [-2 * centre, -2 * half, square, ones] if first else [centre, half, ones, square]
    return tuple(np.concatenate(x, axis=1).astype(np.float32) for x in (line, [s * unit if first else unit], sphere))


def contacts(one: np.ndarray, two: np.ndarray, s: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of two sets of segments (x0 .. z1) whose closest distance is at most ``s``: each pair once, lot by lot.

    Segments are apart where their lines are, or spheres about them; both follow from
    matrix products in single precision, with its error on the safe side.  What is left
    is measured as by :func:`segment_squares`.
    """
    whole = [np.flatnonzero(np.isfinite(x).all(axis=1)) for x in (one, two)]
    one, two = one[whole[0]], two[whole[1]]
    if not len(one) or not len(two):
        return
    middle = (one[:, :3].mean(axis=0) + two[:, :3].mean(axis=0)) / 2
    reach = max(np.abs(x.reshape(len(x), 2, 3) - middle).max() for x in (one, two)) * 3 + s
    error = 32 * float(np.finfo(np.float32).eps)
    apart = np.float32(s**2 * (1 + error) + 2 * s * error * reach + (error * reach) ** 2)
    far = np.float32(error * 4 * reach**2)
    with np.errstate(over="ignore", invalid="ignore"):
        a, b = _lines(one, middle, s, True), _lines(two, middle, s, False)
        other = [np.ascontiguousarray(x.T) for x in b]
        for lo in range(0, len(one), TILE[0]):
            own, left = slice(lo, lo + TILE[0]), []
            for at in range(0, len(two), TILE[1]):
                d = a[0][own] @ other[0][:, at : at + TILE[1]]
                d *= d
                c = a[1][own] @ other[1][:, at : at + TILE[1]]
                c *= c
                d += c
                ball = a[2][own] @ other[2][:, at : at + TILE[1]]
                p, q = np.divmod(np.flatnonzero(~((d > apart) | (ball > far))), d.shape[1])  # what is no number is measured
                left.append((p + lo, q + at))
            p, q = (np.concatenate(x) for x in zip(*left))
            for n in range(0, len(p), STEP_PAIRS // 40):
                i, j = (x[n : n + STEP_PAIRS // 40] for x in (p, q))
                hit = np.sqrt(pair_squares(one.take(i, axis=0).T, two.take(j, axis=0).T)) <= s
                yield whole[0][i[hit]], whole[1][j[hit]]


def pair_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """:func:`segment_squares` of one segment and another (columns), pair by pair."""
    u, v, w = a[3:] - a[:3], b[3:] - b[:3], a[:3] - b[:3]
    inner = lambda x, y: x[0] * y[0] + x[1] * y[1] + x[2] * y[2]
    uu, vv, uv, uw, vw, ww = inner(u, u), inner(v, v), inner(u, v), inner(u, w), inner(v, w), inner(w, w)
    area = uu * vv - uv * uv
    squared = lambda s, t: ww + s * s * uu + t * t * vv + 2 * s * uw - 2 * t * vw - 2 * s * t * uv
    with np.errstate(invalid="ignore", divide="ignore"):
        held = lambda x: np.clip(np.where(np.isnan(x), 0.0, x), 0.0, 1.0)
        least = squared(0.0, held(vw / vv))
        for s, t in ((1.0, held((vw + uv) / vv)), (held(-uw / uu), 0.0), (held((uv - uw) / uu), 1.0)):
            np.minimum(least, squared(s, t), out=least)
        s, t = (uv * vw - vv * uw) / area, (uu * vw - uv * uw) / area
        inside = (area > 1e-12 * uu * vv) & (s >= 0) & (s <= 1) & (t >= 0) & (t <= 1)
        return np.maximum(0.0, np.where(inside, np.minimum(least, squared(s, t)), least))


def _contacts_of_neurons(one: np.ndarray, two: np.ndarray, of_one: np.ndarray, of_two: np.ndarray, s: float) -> Iterator[tuple]:
    """Pairs of neurons, the first with the smaller number, and their contacts, some whole neurons of ``one`` at a time."""
    width, at = int(of_two.max(initial=0)) + 1, 0
    while at < len(one):
        lo = int(np.searchsorted(of_two, of_one[at], side="right"))
        if lo == len(two):
            break
        hi = int(np.searchsorted(of_one, of_one[min(len(one), at + 4 * TILE[0]) - 1], side="right"))  # whole neurons
        parts, held, n = [], [], 0
        for p, q in contacts(one[at:hi], two[lo:], s):
            first, second = of_one[at + p], of_two[lo + q]
            held.append((first * width + second)[first < second])
            n += len(held[-1])
            if n > HELD:
                parts.append(np.unique(np.concatenate(held), return_counts=True))
                held, n = [], 0
        parts.append(np.unique(np.concatenate([*held, np.zeros(0, dtype=np.int64)]), return_counts=True))
        keys, counts = parts[0]
        if len(parts) > 1:
            keys, of = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
            counts = np.bincount(of, np.concatenate([x[1] for x in parts])).astype(np.int64)
        yield keys // width, keys % width, counts
        at = hi


def grid_blocks(n: int) -> int:
    return max(min(-(-n // GRID_SEGMENTS), GRID_BLOCKS), min(8, -(-n // 256)), 1)


def dense_blocks(n: int) -> int:
    return max(min(-(-n // BLOCK_SEGMENTS), GRID_BLOCKS), -(-n // MOST_SEGMENTS), min(8, -(-n // 256)), 1)


def _firsts(of: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, of[1:] != of[:-1]])


def _by_neuron(table: np.ndarray, starts: np.ndarray, axis: int, add: np.ufunc) -> np.ndarray:
    """Runs of rows or columns put together: most are of one, few of more."""
    if len(starts) == table.shape[axis]:
        return table
    sizes = np.diff(np.r_[starts, table.shape[axis]])
    if sizes.max() > 8:
        return add.reduceat(table, starts, axis=axis)
    out = table.take(starts, axis=axis)
    for n in range(1, sizes.max()):
        who = np.flatnonzero(sizes > n)
        at = (who, slice(None)) if axis == 0 else (slice(None), who)
        out[at] = add(out[at], table.take(starts[who] + n, axis=axis))
    return out


def _expected_of_neurons(one: np.ndarray, two: np.ndarray, of_one: np.ndarray, of_two: np.ndarray, reach: float, spread: float, factor: float, digits: int | None) -> Iterator[tuple]:
    """Pairs of neurons, the first with the smaller number, and what their segments with middles within ``reach`` add up to.

    Some whole neurons meet some others at once; a table of their segments stays in a core's cache.
    """
    if not len(one) or not len(two):
        return

    def parts(x):
        step = x[:, 3:] - x[:, :3]
        length = np.sqrt((step**2).sum(axis=1))
        return np.asfortranarray((x[:, :3] + x[:, 3:]) / 2), step / length[:, None], length

    (middle, unit, length), (middles, units, lengths) = parts(one), parts(two)
    first, others = (np.r_[_firsts(of), len(of)] for of in (of_one, of_two))

    def neurons(firsts, size):
        """Ranges of neurons of about ``size`` segments."""
        n = 0
        while n < len(firsts) - 1:
            end = max(n + 1, int(np.searchsorted(firsts, firsts[n] + size, side="right")) - 1)
            yield n, end
            n = end

    for n, end in neurons(first, TILE[0]):
        for m, last in neurons(others, TILE[1]):
            if of_two[others[last] - 1] <= of_one[first[n]]:
                continue
            total, hits = np.zeros((end - n, last - m)), np.zeros((end - n, last - m), dtype=bool)
            for lo in range(first[n], first[end], TILE[0] * 2):
                own = slice(lo, min(lo + TILE[0] * 2, first[end]))
                rows = _firsts(of_one[own])
                r = int(np.searchsorted(first, lo, side="right")) - 1 - n
                for at in range(others[m], others[last], TILE[1] * 2):
                    met = slice(at, min(at + TILE[1] * 2, others[last]))
                    with np.errstate(invalid="ignore", over="ignore"):
                        r2, angle = squares(middle[own], middles[met]), unit[own] @ units[met].T
                        hit = r2 <= reach**2
                        np.arccos(np.clip(angle, -1.0, 1.0, out=angle), out=angle)
                        r2 *= -1 / spread
                        angle *= np.exp(r2, out=r2)
                        angle *= length[own, None] * factor
                        angle *= lengths[None, met]
                    np.copyto(angle, 0.0, where=~hit)
                    columns = _firsts(of_two[met])
                    c = int(np.searchsorted(others, at, side="right")) - 1 - m
                    place = slice(r, r + len(rows)), slice(c, c + len(columns))
                    total[place] += _by_neuron(_by_neuron(angle, rows, 0, np.add), columns, 1, np.add)
                    hits[place] |= _by_neuron(_by_neuron(hit, rows, 0, np.logical_or), columns, 1, np.logical_or)
            a, b = of_one[first[n:end]], of_two[others[m:last]]
            if a[-1] >= b[0]:
                hits &= a[:, None] < b
            p, q = np.divmod(np.flatnonzero(hits), len(b))
            found = total[hits]
            yield a[p], b[q], found if digits is None else half_up(found, digits)


def _dealt_blocks(a: DataFrame, b: DataFrame | None, columns: list[str], met: Callable[..., Iterator[tuple]], name: str, kind: str, blocks_of: Callable[[int], int] = dense_blocks) -> DataFrame:
    """``met`` of every block of ``a``'s neurons and every block of ``b``'s: their segments, in order of neurons, and the neurons' numbers.

    With ``b`` None two blocks of ``a`` meet in one group, either way round.
    """
    dtype = a.schema["neuron_id"].dataType.simpleString()
    whole = " and ".join(f"{c} is not null" for c in ["neuron_id", *columns])
    sides = [df.select("neuron_id", *[F.col(c).cast("double").alias(c) for c in columns]).where(whole) for df in ([a] if b is None else [a, b])]
    blocks = [blocks_of(df.count()) for df in sides]
    block = lambda n: F.pmod(F.xxhash64("neuron_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    if b is None:
        rows = sides[0].withColumn("own", block(blocks[0])).withColumn("other", every(blocks[0]))
        dealt = rows.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "neuron_id", *columns)
    else:
        one = sides[0].withColumn("i", block(blocks[0])).withColumn("j", every(blocks[1])).withColumn("side", F.lit(0))
        two = sides[1].withColumn("j", block(blocks[1])).withColumn("i", every(blocks[0])).withColumn("side", F.lit(1))
        dealt = one.select("i", "j", "side", "neuron_id", *columns).unionByName(two)
    same = b is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).sort_by("neuron_id").combine_chunks()
        side, codes = t.column("side").to_numpy(), t.column("neuron_id").combine_chunks().dictionary_encode()
        ids, code = codes.dictionary, codes.indices.to_numpy().astype(np.int64)  # in order, as the rows are
        xyz = np.stack([t.column(c).to_numpy() for c in columns], axis=1)
        (one, of_one), (two, of_two) = ((xyz[side == n], code[side == n]) for n in (0, 1))
        turns = [(one, two, of_one, of_two)]
        if same:
            within = t.column("i")[0].as_py() == t.column("j")[0].as_py()
            turns = [(one, one, of_one, of_one)] if within else [*turns, (two, one, of_two, of_one)]
        for first, second, found in (x for turn in turns for x in met(*turn)):
            yield pa.record_batch([ids.take(pa.array(first)), ids.take(pa.array(second)), pa.array(found)], names=["neuron_a", "neuron_b", name])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of blocks that come one after another."""
        held, at = [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in (0, 1)], axis=1)
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True]) if len(keys) else []
            for lo, hi in zip(cuts, cuts[1:]):
                if held and tuple(keys[lo]) != at:
                    yield from run(held)
                    held = []
                at = tuple(keys[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from run(held)

    out = f"neuron_a {dtype}, neuron_b {dtype}, {name} {kind}"
    if blocks_of is dense_blocks:
        return dealt.repartition(blocks[0] * blocks[-1], "i", "j").groupBy("i", "j").applyInArrow(run, out)
    # large blocks of unlike work: as many partitions as pairs of blocks
    return dealt.repartition(blocks[0] * blocks[-1], "i", "j").sortWithinPartitions("i", "j").mapInArrow(groups, out)


def _cell_codes(xyz: np.ndarray, low: np.ndarray, spans: np.ndarray, size: float, shift: tuple[int, int] = (0, 0)) -> np.ndarray:
    """Numbers of cells, those of one column of the third axis in a row; ``shift``: of the column so far away."""
    c = np.clip(np.floor((xyz - low) / size), -1, spans - 2).astype(np.int64) + 1
    return ((c[:, 0] + shift[0]) * int(spans[1]) + c[:, 1] + shift[1]) * int(spans[2]) + c[:, 2]


def candidates(one: np.ndarray, two: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of two sets of places that may lie within ``reach``: each pair once, lot by lot in the order of ``one``."""
    if not len(one) or not len(two):
        return
    low, high = two.min(axis=0), two.max(axis=0)
    inside = np.flatnonzero(((one >= low - reach) & (one <= high + reach)).all(axis=1))
    size = max(reach * (1 + 1e-9), float((high - low).max()) / 2**19)
    spans = np.floor((high - low) / size) + 4
    codes = _cell_codes(two, low, spans, size)
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    columns = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    own = one[inside]
    first, counts = np.empty((len(own), 9), dtype=np.int64), np.empty((len(own), 9), dtype=np.int64)
    for n, shift in enumerate(columns):
        at = _cell_codes(own, low, spans, size, shift)
        first[:, n] = np.searchsorted(codes, at - 1, side="left")
        counts[:, n] = np.searchsorted(codes, at + 1, side="right") - first[:, n]
    ends = np.cumsum(counts.sum(axis=1))
    lo = 0
    while lo < len(own):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP_PAIRS, side="right")))
        n, begin = counts[lo:hi].ravel(), first[lo:hi].ravel()
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(inside[lo:hi], counts[lo:hi].sum(axis=1)), order[np.repeat(begin, n) + within]
        lo = hi


def _sparse_by_blocks(a: DataFrame, b: DataFrame | None, reach: float, terms: Callable[[np.ndarray, np.ndarray], np.ndarray], value: str, digits: int | None = None) -> DataFrame:
    """``neuron_a < neuron_b`` and the sum of ``terms`` over their segments whose middles lie within ``reach``.

    Blocks of neurons meet as in :func:`_by_blocks`; within two blocks segments find each
    other over a grid, and a pair of neurons is summed where it is found: what is shuffled
    is the segments, once a block, and no pair.  ``b`` None: the segments of ``a`` again.
    """
    name, kind = value.split()
    done = lambda x: x if digits is None else half_up(x, digits)

    def met(one, two, of_one, of_two):
        middles = [(x[:, :3] + x[:, 3:]) / 2 for x in (one, two)]
        keys, sums, width = np.zeros(0, dtype=np.int64), np.zeros(0), int(of_two.max(initial=0)) + 1
        for p, q in candidates(*middles, reach):
            r2 = sum((middles[0][p, n] - middles[1][q, n]) ** 2 for n in range(3))
            near = (r2 <= reach**2) & (of_one[p] < of_two[q])
            p, q, r2 = p[near], q[near], r2[near]
            own, at = np.unique(np.r_[keys, of_one[p] * width + of_two[q]], return_inverse=True)
            total = np.bincount(at, np.r_[sums, terms(one[p], two[q], r2)], len(own))
            last = int(np.searchsorted(own, own[-1] // width * width)) if len(own) else 0  # its neuron may go on
            yield own[:last] // width, own[:last] % width, done(total[:last])
            keys, sums = own[last:], total[last:]
        yield keys // width, keys % width, done(sums)

    return _dealt_blocks(a, b, SEG, met, name, kind, grid_blocks)


def _crowded(cells_a: DataFrame, cells_b: DataFrame, a: DataFrame, b: DataFrame, cheaper: int = 1) -> bool:
    """Whether rows that share a cell are so many of all pairs that the cells are of no use."""
    cell = ["cx", "cy", "cz"]
    counts = [df.groupBy(*cell).agg(F.count("*").cast("double").alias(f"n{t}")) for df, t in ((cells_a, "a"), (cells_b, "b"))]
    shared = counts[0].join(counts[1], cell).agg(F.sum(F.col("na") * F.col("nb"))).first()[0] or 0.0
    return shared * PRUNED * cheaper > float(a.count()) * float(b.count())


def direct_synapses(a: DataFrame, b: DataFrame, s: float, max_length: float | None = 0.5) -> DataFrame:
    """Segment pairs of different neurons within ``s``: ``neuron_a, neuron_b, n``.

    With ``max_length`` None every pair is found.  Otherwise, as in the reference,
    candidates have heads within ``2 max_length + 2 s`` on every axis.  A grid
    whose cells are that wide turns the band join into an equi-join: the second
    side is copied to its 27 neighbouring cells, the first is not.
    """
    if max_length is None:
        return _all_synapses(a, b, s)
    reach = 2 * max_length + 2 * s
    left = _cells(a.select(F.col("neuron_id").alias("neuron_a"), *[F.col(c).alias("a" + c) for c in SEG]), reach, "a")
    right = b.select(F.col("neuron_id").alias("neuron_b"), *[F.col(c).alias("b" + c) for c in SEG])
    around = F.explode(F.array(*[F.struct(*[F.lit(d).alias(f"d{n}") for n, d in zip("xyz", (i, j, k))]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]))
    right = _cells(right, reach, "b").withColumn("d", around).withColumns({f"c{n}": F.col(f"c{n}") + F.col(f"d.d{n}") for n in "xyz"}).drop("d")
    pairs = left.join(right, ["cx", "cy", "cz"]).where("neuron_a < neuron_b")
    for n in "xyz":
        pairs = pairs.where(F.abs(F.col(f"a{n}0") - F.col(f"b{n}0")) <= reach)
    ends = [[f"{t}{n}{e}" for n in "xyz"] for t in "ab" for e in "01"]
    # counted, not filtered: a filter would be pushed down and repeat the arithmetic
    met = with_segment_distance(pairs, *ends).groupBy("neuron_a", "neuron_b").agg(F.count_if(F.col("distance") <= s).alias("n"))
    return met.where("n > 0")


def expected_synapses(pairs: DataFrame, sigma: float, s: float, angle: str = "theta") -> DataFrame:
    """Expected synapse count of neuron pairs from mid points, lengths and directions.

    ``pairs`` holds ``neuron_a, neuron_b`` and for both sides (prefix a, b) the
    mid point x, y, z, the length l and the direction dx, dy, dz.
    """
    theta = angle_between(("adx", "ady", "adz"), ("bdx", "bdy", "bdz"))
    factor = theta if angle == "theta" else F.sin(theta)
    r2 = sum(((F.col(f"a{c}") - F.col(f"b{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    term = F.col("al") * F.col("bl") * factor * F.exp(-r2 / (4 * sigma**2)) / (4 * math.pi * sigma**2) ** 1.5
    return pairs.where("al > 0 and bl > 0").groupBy("neuron_a", "neuron_b").agg((2 * s * F.sum(term)).alias("expected"))


def potential_synapses(a: DataFrame, b: DataFrame, s: float, method: str = "direct", scale: float | None = None, digits: int | None = None) -> DataFrame:
    """Contacts of two segment sets: counted (``direct``; ``scale`` is the longest segment, None for any) or ``expected``.

    Expected counts take middles within ten ``scale`` (sigma) of each other, which
    meet over a grid of that width; further ones add less than 1e-10 of a term.
    ``digits``: they are rounded so, as Spark's ``round`` does.
    """
    if method == "direct":
        return direct_synapses(a, b, s, scale)
    a, b = _kept(a, b)
    reach, sides = 10 * scale, []
    for df, t in ((a, "a"), (b, "b")):
        mid = {f"{t}{n}": (F.col(n + "0") + F.col(n + "1")) / 2 for n in "xyz"}
        step = {f"{t}d{n}": F.col(n + "1") - F.col(n + "0") for n in "xyz"}
        length = F.sqrt(sum(((F.col(n + "1") - F.col(n + "0")) ** 2 for n in "xyz"), F.lit(0.0)))
        rows = df.select(F.col("neuron_id").alias(f"neuron_{t}"), *[c.alias(n) for n, c in (mid | step).items()], length.alias(f"{t}l"))
        sides.append(rows.withColumns({f"c{n}": F.floor(F.col(f"{t}{n}") / reach) for n in "xyz"}))
    around = F.explode(F.array(*[F.struct(*[F.lit(d).alias(f"d{n}") for n, d in zip("xyz", (i, j, k))]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]))
    right = sides[1].withColumn("d", around).withColumns({f"c{n}": F.col(f"c{n}") + F.col(f"d.d{n}") for n in "xyz"}).drop("d")
    if _crowded(sides[0], right, a, b):
        length = F.sqrt(sum(((F.col(n + "1") - F.col(n + "0")) ** 2 for n in "xyz"), F.lit(0.0)))
        met = partial(_expected_of_neurons, reach=reach, spread=4 * scale**2, factor=2 * s / (math.pi * 4 * scale**2) ** 1.5, digits=digits)
        return _dealt_blocks(a.where(length > 0), None if a is b else b.where(length > 0), SEG, met, "expected", "double")
    spread = 4 * scale**2

    def pair_terms(x, y, r2):
        u, v = ([t[:, n + 3] - t[:, n] for n in range(3)] for t in (x, y))
        inner = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
        size = np.sqrt(inner(u, u)) * np.sqrt(inner(v, v))
        theta = np.arccos(np.clip(np.divide(inner(u, v), size, out=np.zeros(len(size)), where=size > 0), -1.0, 1.0))
        return 2 * s * size * theta * np.exp(-r2 / spread) / (math.pi * spread) ** 1.5

    length = F.sqrt(sum(((F.col(n + "1") - F.col(n + "0")) ** 2 for n in "xyz"), F.lit(0.0)))
    return _sparse_by_blocks(a.where(length > 0), None if a is b else b.where(length > 0), reach, pair_terms, "expected double", digits)


def neighbour_score(nearest: DataFrame, sd: float = 4.0) -> DataFrame:
    """Mean normal density of nearest-neighbour distances."""
    density = F.exp(-(F.col("distance") ** 2) / (2 * sd**2)) / (sd * math.sqrt(2 * math.pi))
    return nearest.groupBy("query_id", "target_id").agg(F.avg(density).alias("score"))


def median_min_distance(nearest: DataFrame) -> DataFrame:
    return nearest.groupBy("query_id", "target_id").agg(F.percentile("distance", F.lit(0.5)).alias("median"))


def symmetrise(distances: DataFrame, how: str = "mean") -> DataFrame:
    """One row per unordered pair of an asymmetric distance table ``(a, b, d)``."""
    f = {"mean": F.avg, "min": F.min, "max": F.max}[how]
    return distances.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(f("d").alias("d"))


def subset(distances: DataFrame, kept: DataFrame) -> DataFrame:
    """Distances both of whose ends are among ``kept(id)``."""
    ids = kept.select("id").distinct()
    return distances.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b", "d")


def matched_distances(one: DataFrame, two: DataFrame) -> DataFrame:
    """Both distances of the pairs that two tables share."""
    return one.select("a", "b", F.col("d").alias("d1")).join(two.select("a", "b", F.col("d").alias("d2")), ["a", "b"])


def _names(distances: DataFrame) -> DataFrame:
    return distances.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def randomise(distances: DataFrame, seed: int) -> DataFrame:
    """The same distances under a random bijection of the names (rows and columns alike).

    Names in order meet names in the order of a seeded hash; both numberings are
    range-partitioned, so no task holds all names.
    """
    names = _names(distances)
    order, mixed = numbered(names, [F.col("id")]), numbered(names.withColumn("h", F.xxhash64("id", F.lit(seed))), [F.col("h"), F.col("id")])
    renamed = order.select("place", F.col("id").alias("old")).join(mixed.select("place", F.col("id").alias("new")), "place").select("old", "new")
    a, b = renamed.withColumnsRenamed({"old": "a", "new": "na"}), renamed.withColumnsRenamed({"old": "b", "new": "nb"})
    return distances.join(a, "a").join(b, "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"), "d")


def numbered(df: DataFrame, order: list) -> DataFrame:
    """Adds ``place`` from 0 in an order of all rows, without one task holding them all.

    Rows are range-partitioned and sorted; the partitions' counts give each its start.
    """
    from arborkit.sources.files import scratch

    path = scratch(df.sparkSession, "ordered")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    counts = rows.groupBy("_part").agg(F.count("*").alias("n"))
    # one row a partition: their running sum is small
    starts = counts.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_part").withColumn("place", F.col("_start") + F.col("_row")).drop("_part", "_row", "_start")


def numbered_within(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Adds ``name``, the number (from 1) of each row among its key's, in an order; a key may have any number of rows."""
    rows = numbered(df, [key, *order])
    first = rows.groupBy(F.col(key).alias("_key")).agg(F.min("place").alias("_first"))
    return rows.join(first, F.col(key).eqNullSafe(F.col("_key"))).withColumn(name, (F.col("place") - F.col("_first") + 1).cast("int")).drop("place", "_key", "_first")


def spearman(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation (average ranks for ties) of two columns.

    Ranks come from counts per distinct value; the running sum over distinct
    values goes by range partitions, each starting where those before it end.
    """
    def ranked(c):
        n = numbered_sums(pairs.groupBy(c).agg(F.count("*").alias("n")), c)
        return n.select(c, (F.col("before") + (F.col("n") + 1) / 2).alias(f"rank_{c}"))

    return pairs.join(ranked(x), x).join(ranked(y), y).agg(F.corr(f"rank_{x}", f"rank_{y}").alias("rho"))


def numbered_sums(counts: DataFrame, value: str) -> DataFrame:
    """Adds ``before``, the sum of ``n`` over all smaller values, range partition by range partition."""
    from arborkit.sources.files import scratch

    path = scratch(counts.sparkSession, "ranks")
    counts.repartitionByRange(value).sortWithinPartitions(value).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    rows = counts.sparkSession.read.parquet(path)
    starts = rows.groupBy("_part").agg(F.sum("n").alias("m"))
    starts = starts.select("_part", F.coalesce(F.sum("m").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_own", own).join(F.broadcast(starts), "_part").withColumn("before", F.col("_start") + F.col("_own")).drop("_part", "_own", "_start")


def permuted_names(distances: DataFrame, permutations: int, seed: int) -> DataFrame:
    """``permutation, old, new``: names in order against names in the order of a seeded hash, for each permutation.

    Permutation 0 leaves all names as they are.
    """
    names = _names(distances).withColumn("permutation", F.explode(F.sequence(F.lit(1), F.lit(permutations)))) if permutations else None
    same = _names(distances).select(F.lit(0).alias("permutation"), F.col("id").alias("old"), F.col("id").alias("new"))
    if names is None:
        return same
    each = Window.partitionBy("permutation")
    mixed = F.xxhash64("id", F.lit(seed - 1) + F.col("permutation"))
    placed = names.select("permutation", "id", F.row_number().over(each.orderBy("id")).alias("place"), F.row_number().over(each.orderBy(mixed, "id")).alias("other"))
    old, new = placed.select("permutation", "place", F.col("id").alias("old")), placed.select("permutation", F.col("other").alias("place"), F.col("id").alias("new"))
    return same.unionByName(old.join(new, ["permutation", "place"]).select("permutation", "old", "new"))


def permuted_correlations(one: DataFrame, two: DataFrame, permutations: int, seed: int) -> DataFrame:
    """``permutation, r, n``: correlation of two distance tables under every renaming of the second, in one plan."""
    names = permuted_names(two, permutations, seed)
    a, b = (names.select("permutation", F.col("old").alias(side), F.col("new").alias(f"n{side}")) for side in "ab")
    moved = two.select("a", "b", "d").join(a, "a").join(b, ["permutation", "b"])
    moved = moved.select("permutation", F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"), F.col("d").alias("d2"))
    own = one.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("d").alias("d1"))
    return moved.join(own, ["a", "b"]).groupBy("permutation").agg(F.corr("d1", "d2").alias("r"), F.count("*").alias("n"))


def mantel(one: DataFrame, two: DataFrame, permutations: int, seed: int) -> DataFrame:
    """Correlation of two distance tables, and the share of random renamings that reach it."""
    found = permuted_correlations(one, two, permutations, seed)
    least = F.max(F.when(F.col("permutation") == 0, F.col("r")))
    reached = found.crossJoin(F.broadcast(found.agg(least.alias("r0"))))
    share = (1 + F.count_if((F.col("permutation") > 0) & (F.col("r") >= F.col("r0")))) / F.lit(1.0 + permutations)
    return reached.agg(F.max("r0").alias("r"), share.alias("p"))


def prefix_match(keys: DataFrame, key: str, names: DataFrame, name: str) -> DataFrame:
    """Case-insensitive unique prefix (or exact) match; ambiguous or none: null.

    Names give their prefixes of the lengths that keys have (at most
    ``MOST_LENGTHS`` of them; longer keys meet by their longest such prefix and
    are compared after), so that the match is an equi-join.
    """
    k, n = F.upper(F.col(key)), F.upper(F.col(name))
    lengths = sorted(x[0] for x in keys.select(F.least(F.length(key), F.lit(MOST_LENGTHS)).alias("n")).where("n is not null").distinct().collect())
    cuts = names.select(name, F.explode(F.array_distinct(F.transform(F.array(*map(F.lit, lengths or [0])), lambda i: F.substring(n, F.lit(1), i)))).alias("_cut"))
    met = keys.withColumn("_cut", F.substring(k, F.lit(1), F.least(F.length(key), F.lit(MOST_LENGTHS)))).join(cuts, "_cut", "left")
    name_of = F.when(n.startswith(k), F.col(name))
    exact = F.max(F.when(n == k, F.col(name)))
    one = F.when(F.countDistinct(name_of) == 1, F.max(name_of))
    return met.groupBy(key).agg(F.coalesce(exact, one).alias("matched"))
