"""Images and spectra of visibilities by gridding: a kernel, tiles, sums of tiles, fast transforms.

A visibility is spread by a separable kernel (the exponential of a semicircle) onto a grid of twice the
wanted size.  The grid is cut in tiles with a margin of the kernel's width, so each visibility falls into one
tile.  Visibilities are dealt in ranges of (frame, tile, plane), so a task fills few tiles at a time, and a
frame or tile that holds all rows is filled by many tasks; a tile leaves a task once, or as parts where ranges
meet.  The tiles of a frame and plane then come to one task, one after another, which adds them to a grid,
transforms it, cuts the margin off and divides by the kernel's transform.  The cost is visibilities times the kernel's area plus grids times their logarithm, where
direct sums cost visibilities times pixels.

The w term is a third axis: a visibility is spread onto the planes of a lattice of w as well, each
plane's image is turned by its own phase, and the planes' images are added up.  Planes are a key like the
frame.  Tiles are the larger part of what is shuffled then: planes times grids, whatever the number of rows.

The transform in three dimensions goes axis by axis: tiles of (v, u, t) are filled, the tiles of a place
in (v, u) are transformed along t, and slabs of a few frequencies then meet and are transformed along v
and u.  No task holds more than one column of tiles or one slab.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sky import K_DM

TILE, TILE_SKY, TILE_TIME, SLAB = 32, 24, 32, 8
CHUNK_ROWS, CHUNK_BYTES, HELD_BYTES = 2048, 4 << 20, 64 << 20


def kernel_width(epsilon: float) -> int:
    return min(16, max(4, math.ceil(math.log10(1 / epsilon)) + 2))


def kernel(x: np.ndarray, width: int) -> np.ndarray:
    z = 1 - np.minimum(1, (2 * x / width) ** 2)
    return np.exp(2.3 * width * (np.sqrt(z) - 1))


def kernel_transform(frequency: np.ndarray, width: int) -> np.ndarray:
    """The kernel's Fourier transform at frequencies in cycles a cell."""
    x, weight = np.polynomial.legendre.leggauss(8 * width)
    x = x * width / 2
    flat = np.asarray(frequency, float).ravel()
    out = np.empty(len(flat))
    for a in range(0, len(flat), 1 << 14):
        out[a : a + (1 << 14)] = np.cos(2 * math.pi * np.outer(flat[a : a + (1 << 14)], x)) @ (weight * kernel(x, width)) * width / 2
    return out.reshape(np.shape(frequency))


def grid_size(n: int, width: int) -> int:
    """At least twice n, and of small prime factors."""
    size = max(2 * n, 2 * width)
    while True:
        rest = size
        for p in (2, 3, 5):
            while rest % p == 0:
                rest //= p
        if rest == 1 and size % 2 == 0:
            return size
        size += 1


def footprint(at: np.ndarray, size: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first cell modulo size, kernel values of `width` cells) for places on the grid."""
    first = np.ceil(at - width / 2).astype(np.int64)
    return first % size, kernel(first[:, None] + np.arange(width) - at[:, None], width)


def tile_column(x, size: int, tile: int, width: int):
    """About the tile that a visibility falls into: what it is dealt by."""
    first = F.pmod(F.ceil(F.pmod(x, F.lit(1.0)) * size - width / 2), F.lit(size))
    return F.floor(first / tile)


class Tiles:
    """Partial tiles of a task by key, given out when they fill HELD_BYTES."""

    def __init__(self, shape: tuple[int, ...], names: list[str], kinds: list[pa.DataType]):
        self.shape, self.names, self.kinds, self.held = shape, names, kinds, {}
        self.bytes = math.prod(shape) * 16

    def add(self, keys: np.ndarray, named, local: list[np.ndarray], weights: list[np.ndarray], values: np.ndarray, count: np.ndarray):
        """Spread values and give out what fills up; keys: a number of a tile for each, named(number) its key; local: first cells in the tile by axis."""
        order = np.argsort(keys, kind="stable")
        for a in range(0, len(order), CHUNK_ROWS):
            rows = order[a : a + CHUNK_ROWS]
            own, slot = np.unique(keys[rows], return_inverse=True)
            step = max(1, CHUNK_BYTES // self.bytes)
            for b in range(0, len(own), step):
                some = np.flatnonzero((slot >= b) & (slot < b + step))
                r, tiles = rows[some], own[b : b + step]
                cell, value = slot[some] - b, values[r]
                for first, weight, extent in zip(local, weights, self.shape, strict=True):
                    shape = (len(r), *[1] * (cell.ndim - 1), weight.shape[1])
                    cell = cell[..., None] * extent + (first[r][:, None] + np.arange(weight.shape[1])).reshape(shape)
                    value = value[..., None] * weight[r].reshape(shape)
                many = len(tiles) * math.prod(self.shape)
                flat = np.bincount(cell.ravel(), value.real.ravel(), many) + 1j * np.bincount(cell.ravel(), value.imag.ravel(), many)
                counts = np.bincount(slot[some] - b, count[r], len(tiles))
                for number, tile, n in zip(tiles.tolist(), flat.reshape(len(tiles), *self.shape), counts.tolist(), strict=True):
                    key = named(number)
                    if key in self.held:
                        self.held[key][0] += tile
                        self.held[key][1] += int(n)
                    else:
                        self.held[key] = [tile.copy(), int(n)]
                if len(self.held) * self.bytes > HELD_BYTES:
                    yield from self.given_out()

    def given_out(self):
        many = max(1, CHUNK_BYTES // self.bytes)
        while self.held:
            part = [(k, *self.held.pop(k)) for k in list(self.held)[:many]]
            keys = [pa.array([p[0][c] for p in part], kind) for c, kind in enumerate(self.kinds)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array([n for *_, n in part], pa.int64()), pa.array([t.tobytes() for _, t, _ in part], pa.binary())], names=[*self.names, "n", "tile"])


def by_key(batches, keys: list[str], begin, add, end):
    """Rows in the order of keys, one at a time: begin() a state, add(state, row), end(key, state) gives record batches."""
    now, state = None, None
    for batch in batches:
        names = batch.schema.names
        for i in range(len(batch)):
            # Tiles are looked at where they lie in the batch; nothing is copied.
            row = {c: x.as_buffer() if isinstance(x := batch.column(c)[i], pa.BinaryScalar) else x.as_py() for c in names}
            key = tuple(row[c] for c in keys)
            if key != now or state is None:
                if state is not None:
                    yield from end(now, state)
                now, state = key, begin()
            add(state, row)
    if state is not None:
        yield from end(now, state)


def small_batches(df: DataFrame) -> None:
    """Arrow batches of about 16 MB from now on, unless the session has its own limit: a row can be a tile."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name) == "67108864b":  # what Spark says where nothing is set
        df.sparkSession.conf.set(name, "16m")


def gridded_image(vis: DataFrame, n: int, cell: float, by: list[str] = ("t",), w_term: bool = False, epsilon: float = 1e-6, centre: float | None = None) -> DataFrame:
    """(by..., y, x, flux): what imaging.dirty_image gives, by gridding, within epsilon of the summed weights.

    vis: (by..., u, v, w, re, im, weight) in wavelengths, w where the w term is asked for.  Pixel i lies
    at (i - centre) cell, from the middle of the grid where centre isn't given.  With the w term
    phases are u l + v m - w (n - 1), and fluxes are over n = sqrt(1 - l**2 - m**2); pixels beyond the horizon are null.
    """
    small_batches(vis)
    by, width = list(by), kernel_width(epsilon)
    centre = (n - 1) / 2 if centre is None else centre
    size = grid_size(n, width)
    tile = min(TILE, size - width)
    extent, across = tile + width, -(-size // tile)
    axis = (np.arange(n) - centre) * cell
    far = np.minimum(1, axis[:, None] ** 2 + axis[None, :] ** 2)
    bent = -far / (1 + np.sqrt(1 - far))  # n - 1
    step = 1 / (4 * float(-bent.min())) if w_term and bent.min() < 0 else None  # between planes of w
    kinds = vis.select(*by).schema
    names = [*by, "plane", "ty", "tx"]
    more = lambda fields: T.StructType([*kinds.fields, *T.StructType.fromDDL(fields).fields])
    schema = more("plane long, ty long, tx long, n long, tile binary")
    shift = n // 2 - centre
    columns = ["u", "v", *(["w"] if step else []), "re", "im", "weight"]
    src = vis.where("weight > 0").select(*by, *(F.col(c).cast("double").alias(f"__{c}") for c in columns))
    order = [*by, *(tile_column(F.col(c) * cell, size, tile, width) for c in ("__v", "__u")), *([F.floor(F.col("__w") / step)] if step else [])]
    src = src.repartitionByRange(*order, "__u").sortWithinPartitions(*order)

    def spread(batches):
        tiles = Tiles((extent, extent), names, [])
        for batch in batches:
            tiles.kinds = [*(batch.schema.field(c).type for c in by), *[pa.int64()] * 3]
            u, v, *w, re, im, weight = (batch.column(f"__{c}").to_numpy(zero_copy_only=False) for c in columns)
            if by:
                frames = pa.table([batch.column(c) for c in by], names=by).to_pandas().groupby(by, dropna=False, sort=False)
                group = frames.ngroup().to_numpy()
                first = np.unique(group, return_index=True)[1]
                keys = list(zip(*(batch.column(c).take(pa.array(first)).to_pylist() for c in by), strict=True))
            else:
                group, keys = np.zeros(len(u), np.int64), [()]
            value = weight * (re + 1j * im) * np.exp(2j * math.pi * cell * shift * (u + v))
            cu, ku = footprint((u * cell % 1) * size, size, width)
            cv, kv = footprint((v * cell % 1) * size, size, width)
            ty, tx = cv // tile, cu // tile
            at, lowest = (group * across + ty) * across + tx, 0
            if step:
                plane = np.ceil(w[0] / step - width / 2).astype(np.int64)
                lowest = int(plane.min()) if len(plane) else 0
                planes = range(width)
            else:
                planes = [0]
            many = len(keys) * across * across
            for j in planes:
                if step:
                    p = plane + j
                    own, number = value * kernel(p - w[0] / step, width), (p - lowest) * many + at
                else:
                    own, number = value, at

                def named(k):
                    p, rest = divmod(k, many)
                    g, rest = divmod(rest, across * across)
                    return (*keys[g], p + lowest, *divmod(rest, across))

                yield from tiles.add(number, named, [cv - ty * tile, cu - tx * tile], [kv, ku], own, np.full(len(own), j == 0, float))
        yield from tiles.given_out()

    whole = src.mapInArrow(spread, schema)
    at = (np.arange(n) - n // 2) % size
    fade = 1 / kernel_transform((np.arange(n) - n // 2) / size, width)
    pixel = [pa.array(np.repeat(np.arange(n), n)), pa.array(np.tile(np.arange(n), n))]
    out = more("y long, x long, total double, n long")

    def transform(batches):
        key_kinds: list = []

        def add(state, row):
            y, x = ((row[c] * tile + np.arange(extent)) % size for c in ("ty", "tx"))
            state[0][np.ix_(y, x)] += np.frombuffer(row["tile"], np.complex128).reshape(extent, extent)
            state[1] += row["n"]

        def end(key, state):
            image = np.fft.ifft2(state[0])[np.ix_(at, at)] * size**2 * fade[:, None] * fade[None, :]
            if step:
                turned = image * np.exp(-2j * math.pi * key[-1] * step * bent) / kernel_transform(bent * step, width) / (1 + bent)
                image = np.where(far < 1, turned, np.nan)
            cols = [pa.repeat(pa.scalar(v, k), n * n) for v, k in zip(key, key_kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([*cols[: len(by)], *pixel, pa.array(image.real.ravel(), from_pandas=True), pa.array(np.full(n * n, state[1]))], names=out.names)

        def watched():
            for batch in batches:
                key_kinds[:] = [batch.schema.field(c).type for c in by]
                yield batch

        yield from by_key(watched(), [*by, "plane"], lambda: [np.zeros((size, size), complex), 0], add, end)

    images = whole.repartition(*by, "plane").sortWithinPartitions(*by, "plane").mapInArrow(transform, out)
    return images.groupBy(*by, "y", "x").agg((F.sum("total") / F.sum("n")).alias("flux"))


def gridded_spectrum(vis: DataFrame, npix: int, cell: float, dt: float, nf: int, fmin: float = 0.0, dm: float = 0.0, epsilon: float = 1e-6) -> DataFrame:
    """(y, x, k, re, im): what periodicity.stitched gives of periodicity.adjoint_blocks, of all rows at once, by gridding."""
    small_batches(vis)
    width, df = kernel_width(epsilon), 1.0 / (nf * dt)
    low, high = math.ceil(fmin / df - 1e-9), (nf + 1) // 2
    size, long_size = grid_size(npix, width), grid_size(nf, width)
    tile, tile_time = min(TILE_SKY, size - width), min(TILE_TIME, long_size - width)
    sent = np.complex64 if epsilon >= 1e-6 else np.complex128  # tones between the axes: what a spectrum shuffles most
    shape = (tile + width, tile + width, tile_time + width)
    across, along = -(-size // tile), -(-long_size // tile_time)
    start = vis.where("not flag").agg(F.min(F.col("time").cast("double")).alias("t")).first().t or 0.0
    src = vis.where("not flag").select(*(F.col(c).cast("double") for c in ("time", "u", "v", "freq_hz", "re", "im")))
    names = ["ty", "tx", "tt"]
    order = [*(tile_column(F.col(c) * cell, size, tile, width) for c in ("v", "u")), tile_column((F.col("time") - start) * df, long_size, tile_time, width)]
    src = src.repartitionByRange(*order, "u").sortWithinPartitions(*order)

    def spread(batches):
        tiles = Tiles(shape, names, [pa.int64()] * 3)
        for batch in batches:
            time, u, v, freq, re, im = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("time", "u", "v", "freq_hz", "re", "im"))
            t = time - start - K_DM * dm * 1e-3 / (freq * 1e-6) ** 2
            (cv, kv), (cu, ku), (ct, kt) = (footprint((x % 1) * s, s, width) for x, s in ((v * cell, size), (u * cell, size), (t * df, long_size)))
            ty, tx, tt = cv // tile, cu // tile, ct // tile_time

            def named(k):
                k, c = divmod(k, along)
                return (*divmod(k, across), c)

            for a in range(0, len(u), 1 << 12):
                r = slice(a, a + (1 << 12))
                yield from tiles.add(((ty * across + tx) * along + tt)[r], named, [(cv - ty * tile)[r], (cu - tx * tile)[r], (ct - tt * tile_time)[r]], [kv[r], ku[r], kt[r]], (re + 1j * im)[r], np.ones(len(u[r])))
        yield from tiles.given_out()

    whole = src.mapInArrow(spread, "ty long, tx long, tt long, n long, tile binary")
    bins = np.arange(low, high)

    def along_time(batches):
        fade = 1 / kernel_transform(bins / long_size, width)

        def add(state, row):
            state[:, :, (row["tt"] * tile_time + np.arange(shape[2])) % long_size] += np.frombuffer(row["tile"], np.complex128).reshape(shape)

        def end(key, state):
            tones = np.empty((len(bins), *shape[:2]), sent)
            for a in range(shape[0]):  # a row of columns at a time
                tones[:, a] = (np.fft.ifft(state[a], axis=-1)[:, bins] * long_size * fade).T
            cuts = range(0, len(bins), SLAB)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cuts))), pa.array(np.full(len(cuts), key[0])), pa.array(np.full(len(cuts), key[1])), pa.array([tones[c : c + SLAB].tobytes() for c in cuts], pa.binary())], names=["slab", "ty", "tx", "tones"])

        yield from by_key(batches, ["ty", "tx"], lambda: np.zeros((*shape[:2], long_size), complex), add, end)

    columns = whole.repartition("ty", "tx").sortWithinPartitions("ty", "tx").mapInArrow(along_time, "slab long, ty long, tx long, tones binary")
    at = (np.arange(npix) - npix // 2) % size
    y, x = pa.array(np.repeat(np.arange(npix), npix)), pa.array(np.tile(np.arange(npix), npix))

    def across_sky(batches):
        fade = 1 / kernel_transform((np.arange(npix) - npix // 2) / size, width)

        def add(state, row):
            r, c = ((row[k] * tile + np.arange(shape[0])) % size for k in ("ty", "tx"))
            tones = np.frombuffer(row["tones"], sent).reshape(-1, *shape[:2])
            for b in range(len(tones)):
                state[b][np.ix_(r, c)] += tones[b]

        def end(key, state):
            for b in range(SLAB):
                k = low + key[0] * SLAB + b
                if k >= high:
                    break
                image = np.fft.fft2(state[b])[np.ix_(at, at)] * fade[:, None] * fade[None, :] * np.exp(2j * math.pi * (k * df * start % 1))
                yield pa.RecordBatch.from_arrays([y, x, pa.array(np.full(npix * npix, k)), pa.array(image.real.ravel()), pa.array(image.imag.ravel())], names=["y", "x", "k", "re", "im"])

        yield from by_key(batches, ["slab"], lambda: np.zeros((SLAB, size, size), complex), add, end)

    return columns.repartition("slab").sortWithinPartitions("slab").mapInArrow(across_sky, "y long, x long, k long, re double, im double")
