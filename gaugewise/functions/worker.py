"""Code that runs inside Python workers; Spark delivers rows partitioned and sorted."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa


def codes(column: pa.ChunkedArray) -> np.ndarray:
    """Equal numbers for equal values."""
    column = column.combine_chunks().dictionary_encode()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.indices.fill_null(-1).to_numpy()


def begins(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the row before in any of the columns."""
    return np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0)))


def whole_groups(batches: Iterator[pa.RecordBatch], starts: Callable[[pa.Table], np.ndarray], block: int
                 ) -> Iterator[pa.Table]:
    """Sorted rows as tables of whole groups, at least ``block`` rows at a time; ``starts`` tells which rows begin one."""
    held, rows, wanted = [], 0, block
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < wanted:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = int(np.flatnonzero(starts(table))[-1])
        if cut:
            yield table.slice(0, cut)
        held, rows = table.slice(cut).to_batches(), rows - cut
        wanted = max(block, 2 * rows)  # a group that goes on is not taken apart for every batch
    if rows:
        yield pa.Table.from_batches(held)


class Sequence:
    """Ranks in a fixed order, ready to count those below a bound within any range: a wavelet matrix, one level of
    prefix counts for each bit of a rank. ``weights``: how often each rank stands (else once)."""

    def __init__(self, ranks: np.ndarray, bits: int, weights: np.ndarray | None = None) -> None:
        self.levels = []
        for bit in reversed(range(bits)):
            zero = (ranks >> bit) & 1 == 0
            before = np.concatenate(([0], np.cumsum(zero)))
            heavy = before if weights is None else np.concatenate(([0], np.cumsum(np.where(zero, weights, 0))))
            self.levels.append((before, heavy))
            order = np.concatenate((np.flatnonzero(zero), np.flatnonzero(~zero)))
            ranks = ranks[order]
            weights = None if weights is None else weights[order]


Ranges = list[tuple[np.ndarray, np.ndarray]]


def nth_ranks(sequences: list[Sequence], ranges: Ranges, n: np.ndarray, bits: int) -> np.ndarray:
    """For each query the ``n``-th smallest rank (from 0) among its ranges of all sequences together."""
    out = np.zeros(len(n), np.int64)
    for i in range(bits):
        levels = [s.levels[i] for s in sequences]
        low = sum(heavy[hi] - heavy[lo] for (_, heavy), (lo, hi) in zip(levels, ranges))
        up = n >= low
        n = n - np.where(up, low, 0)
        out = out * 2 + up
        ranges = [tuple(np.where(up, before[-1] + at - before[at], before[at]) for at in pair)
                  for (before, _), pair in zip(levels, ranges)]
    return out


@dataclass
class QuantileScan:
    """Quantiles over [t - width, t) for groups of rows sorted by (station, chunk, kind, t).

    A chunk's own rows (kind 2) enter its frames one by one, the rows of the first chunk its frames reach (kind 1) leave
    them one by one, and the chunks between stand in all of them, as counted values (kind 0). So a frame is one range
    of each, and order statistics of ranges come from ``nth_ranks`` for all rows at once. Whole groups are in memory, at
    least ``block`` rows at a time; the chunk length bounds a group.
    """

    variables: tuple[str, ...]
    quantiles: tuple[float, ...]
    width: int
    chunk: int
    min_rows: int
    names: list[str]
    block: int = 65_536

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(self._scanned, whole_groups(batches, self._begins, self.block))

    def _begins(self, table: pa.Table) -> np.ndarray:
        """Which rows begin a group."""
        return begins(codes(table["station_id"]), table["_c"].to_numpy())

    def _scanned(self, table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        group, kind = np.cumsum(self._begins(table)) - 1, table["_kind"].to_numpy()
        # Leaving rows are one width older, so both count time from the start of their own chunk.
        back = np.where(kind == 1, self.width // self.chunk, 0)
        at = group * self.chunk + table["t"].to_numpy() - (table["_c"].to_numpy() - back) * self.chunk
        row = table["_row"].combine_chunks()
        row = (row.chunk(0) if isinstance(row, pa.ChunkedArray) else row).filter(pa.array(kind == 2))
        which, n = table["_v"].to_numpy(), table["_n"].to_numpy()
        columns = row.flatten()
        for i, v in enumerate(self.variables):
            x = table[f"_u_{v}"].to_numpy()
            parts = [np.flatnonzero((kind == k) & np.isfinite(x)) for k in (1, 2)]
            parts.append(np.flatnonzero((kind == 0) & (which == i)))
            columns += self._quantiles(x, group, at, n, np.flatnonzero(kind == 2), *parts)
        return pa.RecordBatch.from_arrays(columns, [*(f.name for f in row.type), *self.names])

    def _quantiles(self, x: np.ndarray, group: np.ndarray, at: np.ndarray, n: np.ndarray, own: np.ndarray,
                   leave: np.ndarray, enter: np.ndarray, counted: np.ndarray) -> list[pa.Array]:
        """One column for each quantile. ``own``, ``leave``, ``enter``, ``counted``: row numbers by their part."""
        frames, when = group[own], at[own]
        sides = [(np.searchsorted(at[leave], when), np.searchsorted(group[leave], frames, "right")),
                 (np.searchsorted(group[enter], frames), np.searchsorted(at[enter], when))]
        # An enter row of a later group is past every time of this one, so ranges stay within their group.
        size = sum(hi - lo for lo, hi in sides)
        if len(counted):
            sides.append((np.searchsorted(group[counted], frames), np.searchsorted(group[counted], frames, "right")))
            heavy = np.concatenate(([0], np.cumsum(n[counted])))
            size = size + heavy[sides[2][1]] - heavy[sides[2][0]]
        full = np.flatnonzero(size >= max(self.min_rows, 1))
        out = np.full((len(self.quantiles), len(own)), np.nan)
        if len(full):
            domain, ranks = np.unique(x[np.concatenate((leave, enter, counted))], return_inverse=True)
            bits = int(len(domain) - 1).bit_length()
            cuts = np.cumsum([len(leave), len(enter)])
            ranks = np.split(ranks.reshape(-1), cuts)[:len(sides)]
            matrices = [Sequence(r, bits, n[counted] if k == 2 else None) for k, r in enumerate(ranks)]
            for begin in range(0, len(full), self.block):
                some = full[begin:begin + self.block]
                ranges = [(lo[some], hi[some]) for lo, hi in sides]
                for k, q in enumerate(self.quantiles):
                    place = q * (size[some] - 1)
                    low = place.astype(np.int64)
                    a, b = (domain[nth_ranks(matrices, ranges, np.minimum(nth, size[some] - 1), bits)]
                            for nth in (low, low + 1))
                    out[k, some] = a + (place - low) * (b - a)
        return [pa.array(q, mask=np.isnan(q)) for q in out]


def seen_rows(t: np.ndarray, place: np.ndarray, same: np.ndarray, tell: np.ndarray, x: np.ndarray, low: float,
              high: float) -> np.ndarray:
    """Usable rows by place and time. Among a place's values of one time that of the largest reading_id counts."""
    rows = np.flatnonzero(tell & (x >= low) & (x <= high))
    rows = rows[np.lexsort((x[rows], same[rows]))]
    return rows[np.concatenate((begins(place[rows], t[rows])[1:], [True]))] if len(rows) else rows


def near_sites(sites: np.ndarray, one: int, degrees: float, most_km: float) -> tuple[np.ndarray, np.ndarray]:
    """Sites (sorted by latitude) within the radius of a site, and how far they are."""
    lat, lon = sites[one]
    a, b = np.searchsorted(sites[:, 0], (lat - degrees, lat + degrees))
    p, q = np.radians(sites[a:b, 0]), np.radians(lat)
    h = np.sin((p - q) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(sites[a:b, 1] - lon) / 2) ** 2
    km = 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(1.0, h)))
    near = np.flatnonzero(km <= most_km)
    return a + near, km[near]


def spread_out(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


@dataclass
class PairScan:
    """A row per asking reading and place of another station near its own that has a usable value within the tolerance, for
    groups of rows sorted by (tile, chunk, place, t, reading_id): of each variable the number, sum and square sum of the
    centred values within the tolerance, or of the one nearest in time (``nearest``; an earlier value wins a tie).

    All rows of a group stand in one order of (place, t), so a reading's span in a place's timeline is two searches, and what
    is in it is the difference of two prefix sums. About ``pairs`` of readings and places are spread out at once.
    """

    variables: tuple[str, ...]
    bounds: list[tuple[float, float]]
    centre: list[float]
    tol: int
    km: float
    degrees: float
    nearest: bool
    names: list[str]
    block: int = 65_536
    pairs: int = 1 << 19

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, self._begins, self.block):
            table = table.combine_chunks()
            at = [*np.flatnonzero(self._begins(table)), table.num_rows]
            for a, b in zip(at[:-1], at[1:]):
                yield from self._scanned(table.slice(a, b - a))

    def _begins(self, table: pa.Table) -> np.ndarray:
        return begins(*(table[c].to_numpy() for c in ("_band", "_col", "_c")))

    def _scanned(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        lat, lon, ask, tell = (table[c].to_numpy() for c in ("latitude", "longitude", "_ask", "_tell"))
        t = table["t"].combine_chunks().fill_null(0).to_numpy()
        t = t - t.min()
        station = codes(table["station_id"])
        new = begins(station, lat, lon)
        place, first = np.cumsum(new) - 1, np.flatnonzero(new)
        sites, site = np.unique(np.round(np.column_stack((lat[new], lon[new] % 360)), 10), axis=0, return_inverse=True)
        site = site.reshape(-1)
        by_site = np.argsort(site, kind="stable")
        at_site = np.searchsorted(site[by_site], np.arange(len(sites) + 1))
        same = np.cumsum(begins(place, t, codes(table["reading_id"])))
        # A place's times are apart from the next place's by more than the tolerance.
        width = int(t.max()) + 2 * self.tol + 2
        told = self._told(table, t, place, same, tell, place * width + t + self.tol)
        own = np.flatnonzero(ask)
        own = own[np.argsort(site[place[own]], kind="stable")]
        of_site = site[place[own]]
        held, size = [], 0
        for a, b in zip(*(np.searchsorted(of_site, np.unique(of_site), side) for side in ("left", "right"))):
            beside, km = near_sites(sites, of_site[a], self.degrees, self.km)
            n = at_site[beside + 1] - at_site[beside]
            places, km = by_site[np.repeat(at_site[beside], n) + spread_out(n)], np.repeat(km, n)
            step = max(1, self.pairs // len(places))
            for i in range(a, b, step):
                some = own[i:min(i + step, b)]
                held.append((np.repeat(some, len(places)), np.tile(places, len(some)), np.tile(km, len(some))))
                size += len(some) * len(places)
                if size >= self.pairs:
                    yield self._paired(table, t, station, place, first, width, told, *map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if held:
            yield self._paired(table, t, station, place, first, width, told, *map(np.concatenate, zip(*held)))

    def _told(self, table: pa.Table, t: np.ndarray, place: np.ndarray, same: np.ndarray, tell: np.ndarray,
              key: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """Of each variable the usable rows' keys in order, with their values (``nearest``) or prefix sums; prefix sums are
        kept in extended precision, as small sums are differences of large ones."""
        out = []
        for v, c, (low, high) in zip(self.variables, self.centre, self.bounds):
            x = table[v].to_numpy()
            if self.nearest:
                rows = seen_rows(t, place, same, tell, x, low, high)
                out.append((key[rows], x[rows] - c))
            else:
                rows = np.flatnonzero(tell & (x >= low) & (x <= high))
                y = (x[rows] - c).astype(np.longdouble)
                out.append((key[rows], *(np.concatenate(([0], np.cumsum(e))) for e in (y, y * y))))
        return out

    def _paired(self, table: pa.Table, t: np.ndarray, station: np.ndarray, place: np.ndarray, first: np.ndarray, width: int,
                told: list[tuple[np.ndarray, ...]], who: np.ndarray, there: np.ndarray, km: np.ndarray) -> pa.RecordBatch:
        other = station[who] != station[first[there]]
        who, there, km = who[other], there[other], km[other]
        now = there * width + t[who] + self.tol
        found = [(self._nearest if self.nearest else self._within)(now, *x) for x in told]
        seen = np.flatnonzero(np.any([n > 0 for n, *_ in found], axis=0))
        who, there, km = who[seen], there[seen], km[seen]
        times = table["_times"].to_numpy()
        often = times[who] * times[first[there]]
        if (often > 1).any():
            again = np.repeat(np.arange(len(who)), often)
            who, there, km, seen = who[again], there[again], km[again], seen[again]
        take = lambda c, rows: table[c].combine_chunks().take(pa.array(rows))
        columns = [take("reading_id", who), take("station_id", who), take("station_id", first[there]), take("t", who),
                   *[take(v, who) for v in self.variables], pa.array(km)]
        columns += [pa.array(np.asarray(e[seen], float)) for f in found for e in f]
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        return pa.RecordBatch.from_arrays(columns, self.names)

    def _within(self, now: np.ndarray, key: np.ndarray, s: np.ndarray, ss: np.ndarray) -> tuple[np.ndarray, ...]:
        lo, hi = np.searchsorted(key, now - self.tol, "left"), np.searchsorted(key, now + self.tol, "right")
        return hi - lo, s[hi] - s[lo], ss[hi] - ss[lo]

    def _nearest(self, now: np.ndarray, key: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        if len(key) == 0:
            return (np.zeros(len(now)),) * 3
        after = np.searchsorted(key, now, "right")
        before = np.maximum(after - 1, 0)
        gap_before = np.where(after > 0, now - key[before], self.tol + 1)
        gap_after = np.where(after < len(key), key[np.minimum(after, len(key) - 1)] - now, self.tol + 1)
        later = gap_after < gap_before
        y = x[np.where(later, np.minimum(after, len(key) - 1), before)]
        n = np.minimum(gap_before, gap_after) <= self.tol
        y = np.where(n, y, 0.0)
        return n.astype(float), y, y * y


@dataclass
class NearestScan:
    """Per asking reading, sums over the places near its own of the value nearest in time, for groups of rows sorted by
    (tile, chunk, place, t, reading_id).

    Of a place's usable values each is the nearest one during one span of time: to the middle between it and the value
    before or after it, and no longer than the tolerance. So it meets a run of a near place's readings in order of time,
    found by two searches. Runs are spread out for ``pairs`` values and readings at once.
    """

    variables: tuple[str, ...]
    bounds: list[tuple[float, float]]
    centre: list[float]
    scale: list[float]
    tol: int
    km: float
    degrees: float
    min_km: float
    power: float
    names: list[str]
    block: int = 65_536
    pairs: int = 1 << 20

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, self._begins, self.block):
            table = table.combine_chunks()
            at = [*np.flatnonzero(self._begins(table)), table.num_rows]
            for a, b in zip(at[:-1], at[1:]):
                yield self._scanned(table.slice(a, b - a))

    def _begins(self, table: pa.Table) -> np.ndarray:
        return begins(*(table[c].to_numpy() for c in ("_band", "_col", "_c")))

    def _scanned(self, table: pa.Table) -> pa.RecordBatch:
        t, lat, lon, times = (table[c].to_numpy() for c in ("t", "latitude", "longitude", "_times"))
        ask, tell = (table[c].to_numpy() for c in ("_ask", "_tell"))
        station = codes(table["station_id"])
        new = begins(station, lat, lon)
        place, own = np.cumsum(new) - 1, np.flatnonzero(ask)
        # Places less than a hundredth of a millimetre apart are one site.
        sites, site = np.unique(np.round(np.column_stack((lat[new], lon[new] % 360)), 10), axis=0, return_inverse=True)
        site = site.reshape(-1)[place]
        own = own[np.lexsort((t[own], site[own]))]
        same = np.cumsum(begins(place, t, codes(table["reading_id"])))
        told = [self._spans(t, place, same, site, tell, table[v].to_numpy(), *b)
                for v, b in zip(self.variables, self.bounds)]
        out = np.zeros((len(self.names), len(own)))
        of_site = site[own]
        for a, b in zip(*(np.searchsorted(of_site, np.unique(of_site), side) for side in ("left", "right"))):
            beside, km = near_sites(sites, of_site[a], self.degrees, self.km)
            weight = 1 / np.maximum(km, self.min_km) ** self.power
            for i, v in enumerate(self.variables):
                rows, lo, hi, first, last = told[i]
                begin, end = first[beside], last[beside]
                n = end - begin
                pick = np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)
                if len(pick) == 0:
                    continue
                x, mine = table[v].to_numpy()[rows[pick]], table[v].to_numpy()[own[a:b]]
                who, times_of, w = station[rows[pick]], times[rows[pick]], np.repeat(weight, n)
                step = max(1, self.pairs // len(np.unique(place[rows[pick]])))
                for at in range(a, b, step):
                    out[6 * i:6 * i + 6, at:min(at + step, b)] = self._sums(
                        t[own[at:min(at + step, b)]], station[own[at:min(at + step, b)]], mine[at - a:at - a + step],
                        lo[pick], hi[pick], x, who, times_of, w, self.centre[i], self.scale[i])
        out *= times[own]
        seen = out[2::6].any(axis=0)
        ids = table["reading_id"].combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        return pa.RecordBatch.from_arrays([ids.take(pa.array(own[seen])), *[pa.array(c) for c in out[:, seen]]],
                                          ["reading_id", *self.names])

    def _spans(self, t: np.ndarray, place: np.ndarray, same: np.ndarray, site: np.ndarray, tell: np.ndarray,
               x: np.ndarray, low: float, high: float) -> tuple[np.ndarray, ...]:
        """Usable rows by site, the first and last time at which each is its place's nearest, and where sites begin and
        end."""
        rows = seen_rows(t, place, same, tell, x, low, high)
        at, lo, hi = t[rows], t[rows] - self.tol, t[rows] + self.tol
        next_one = place[rows[1:]] == place[rows[:-1]]
        middle = (at[1:] + at[:-1]) // 2  # a tie belongs to the earlier value
        hi[:-1] = np.where(next_one, np.minimum(hi[:-1], middle), hi[:-1])
        lo[1:] = np.where(next_one, np.maximum(lo[1:], middle + 1), lo[1:])
        order = np.argsort(site[rows], kind="stable")
        ends = [np.searchsorted(site[rows[order]], np.arange(site.max() + 1), side) for side in ("left", "right")]
        return rows[order], lo[order], hi[order], *ends

    @staticmethod
    def _sums(t: np.ndarray, asker: np.ndarray, mine: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray,
              who: np.ndarray, times: np.ndarray, w: np.ndarray, centre: float, scale: float) -> np.ndarray:
        first = np.searchsorted(t, lo, "left")
        n = np.searchsorted(t, hi, "right") - first
        value = np.repeat(np.arange(len(n)), n)
        reading = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
        other = who[value] != asker[reading]
        value, reading = value[other], reading[other]
        m, s = times[value].astype(float), x[value] - centre
        agree = np.abs(centre + s - mine[reading]) <= scale
        return np.array([np.bincount(reading, e, len(t)) for e in (
            w[value] * s * m, w[value] * m, m, agree * m, s * m, s * s * m)])


def mean_path(n: int) -> float:
    """Expected path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    return 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


@dataclass
class ForestScorer:
    """Walks all trees for a batch of rows at once; arrays are (trees, nodes), the children of node i are 2i and 2i + 1."""

    feature: np.ndarray
    at: np.ndarray
    path: np.ndarray
    depth: int
    scale: float

    def __call__(self, columns: list[pd.Series]) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in columns])
        trees = np.arange(len(self.feature))[:, None]
        node = np.ones((len(self.feature), len(x)), dtype=np.int64)
        rows = np.arange(len(x))[None, :]
        for _ in range(self.depth):
            f = self.feature[trees, node]
            above = x[rows, np.maximum(f, 0)] > self.at[trees, node]
            node = np.where(f >= 0, 2 * node + above, node)
        score = np.power(2.0, -self.path[trees, node].mean(axis=0) / self.scale)
        score[np.isnan(x).any(axis=1)] = np.nan
        return pd.Series(score)
