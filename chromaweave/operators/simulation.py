"""Monte-Carlo simulation of loop extrusion: a kernel over tasks (interval, cell).

A task is one row; its barriers travel with it as arrays. The kernel steps many tasks at once: their units lie on one
line, each interval in a stretch of its own that no move can leave, so one sort and one search an epoch serve all of
them. It emits pixel counts, occupancies and epoch statistics, already summed. Random numbers depend on the seed, the
interval and the cell alone, so results do not depend on how tasks are dealt out or put together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaweave.functions.formulas import cell_target, contacts_per_epoch, lefs_of
from chromaweave.operators.intervals import overlap_join
from chromaweave.tables import numbered

NONE, BOUNDARY, BARRIER, PRIMARY, SECONDARY = range(5)
#: Units that one run of the kernel steps together, unless one task has more.
_TOGETHER = 20_000
#: Barriers that one run of the kernel steps together, unless one task has more.
_BARRIERS = 1_000_000
#: Epochs for which units' luck is drawn at once.
_AHEAD = 16
#: Tasks of a lot, while that makes some lots for each core and no more than ``_LOTS`` for one.
_LOT, _LOTS = 200, 16


@dataclass(frozen=True)
class SimulationConfig:
    """Options and their defaults; speeds are per epoch, distances in base pairs.

    Speeds that are not given are 0.8 of a bin; ``speed_std`` below 1 is a fraction of the speed. ``occupancy``
    replaces that of all barriers. ``target_epochs`` (after burn-in) takes the place of ``contact_density``. Chances
    hold for moves of ``probability_factor`` base pairs an epoch and are brought to the speeds chosen unless
    ``normalise`` is off. A task that registers nothing in ``idle_epochs`` epochs on end is given up.
    """

    bin_size: int = 5_000
    diagonal_width: int = 3_000_000
    cells: int = 512
    lefs_per_mbp: float = 20.0
    processivity: int = 300_000
    rev_speed: int | None = None
    fwd_speed: int | None = None
    speed_std: float = 0.05
    stp_active: float = 0.7
    stp_inactive: float = 0.7
    occupancy: float | None = None
    major_block: float = 1.0
    minor_block: float = 0.0
    bypass: float = 0.1
    soft_stall: float = 1.0
    hard_stall: float = 5.0
    contact_density: float = 1.0
    target_epochs: int | None = None
    sampling_interval: int = 50_000
    tad_to_loop: float = 5.0
    noise: tuple[float, float, float] = (0.0, 5_000.0, 0.001)
    burnin: bool = True
    min_burnin: int = 0
    max_burnin: int = 20_000
    burnin_history: int = 100
    burnin_window: int = 5
    burnin_speed: float = 1.0
    probability_factor: int = 8_000
    normalise: bool = True
    without_barriers: bool = False
    max_epochs: int | None = None
    idle_epochs: int = 10_000
    seed: int = 0

    @property
    def nrows(self) -> int:
        return math.ceil(self.diagonal_width / self.bin_size)

    @property
    def speeds(self) -> tuple[int, int]:
        default = self.bin_size * 8 // 10
        return tuple(default if v is None else v for v in (self.rev_speed, self.fwd_speed))

    @property
    def burnin_speeds(self) -> tuple[int, int]:
        return tuple(math.floor(self.burnin_speed * v + 0.5) for v in self.speeds)

    @property
    def speed_stds(self) -> tuple[float, float]:
        return tuple(self.speed_std * v if 0 < self.speed_std < 1 else self.speed_std for v in self.speeds)

    @property
    def release_chance(self) -> float:
        return sum(self.speeds) / self.processivity

    @property
    def burnin_release_chance(self) -> float:
        return sum(self.burnin_speeds) / self.processivity

    @property
    def burnin_epochs(self) -> int:
        """Epochs over which units become active."""
        return min(self.max_burnin, 5 * self.processivity // max(1, sum(self.burnin_speeds)))

    @property
    def barrier_occupancy(self) -> float:
        """Share of time that a barrier without a score of its own is active."""
        if self.occupancy is not None:
            return self.occupancy
        leave, come = 1 - self.stp_active, 1 - self.stp_inactive
        return come / (leave + come) if leave + come else 1.0

    def rescaled(self, ratio: float) -> SimulationConfig:
        """For epochs ``ratio`` times as long: chances to stay inactive and blocks to the power, bypass in proportion; the
        chance to stay active follows from the occupancy, which stays."""
        inactive, share = self.stp_inactive**ratio, self.barrier_occupancy
        active = max(0.0, 1 - (1 - inactive) * (1 - share) / share) if share else 0.0
        bypass = min(1.0, self.bypass * ratio) if self.bypass not in (0, 1) else self.bypass
        return replace(self, stp_active=active, stp_inactive=inactive, major_block=self.major_block**ratio, minor_block=self.minor_block**ratio, bypass=bypass)

    def resolved(self) -> SimulationConfig:
        """With speeds filled in, the chances of ``occupancy``, and chances brought to the speeds."""
        rev, fwd = self.speeds
        own = replace(self, rev_speed=rev, fwd_speed=fwd)
        if self.occupancy is not None:
            own = own.rescaled(1.0)
        if self.normalise and rev + fwd != self.probability_factor:
            own = own.rescaled((rev + fwd) / self.probability_factor)
        return replace(own, normalise=False)


def target_epochs_of(lefs: int, npixels: int, config: SimulationConfig) -> int:
    """Epochs that all cells of an interval need together."""
    if config.target_epochs is not None:
        return config.cells * config.target_epochs
    per_epoch = max(1, math.floor(lefs * sum(config.speeds) / config.sampling_interval + 0.5))
    return math.floor(max(1.0, math.floor(config.contact_density * npixels + 0.5)) / per_epoch + 0.5)


def plan_cells(intervals: DataFrame, config: SimulationConfig) -> DataFrame:
    """One row per interval and cell: how many units, contacts per epoch and in total."""
    ncols = F.ceil((F.col("end") - F.col("start")) / config.bin_size).cast("bigint")
    size = F.col("end") - F.col("start")
    sized = intervals.withColumns({"lefs": lefs_of(size, config.lefs_per_mbp), "npixels": ncols * F.least(ncols, F.lit(config.nrows))})
    totals = sized.withColumns({"per_epoch": contacts_per_epoch(F.col("lefs"), *config.speeds, config.sampling_interval), "total": F.round(F.col("npixels") * config.contact_density).cast("bigint")})
    cells = totals.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(config.cells - 1))))
    return cells.withColumn("target", cell_target(F.col("total"), config.cells, F.col("cell"))).drop("npixels", "total")


def plan_tasks(intervals: DataFrame, barriers: DataFrame, config: SimulationConfig) -> DataFrame:
    """``plan_cells`` with the interval's barriers. They are as many as pairs of intervals and barriers that overlap; ``simulate_intervals``
    does without this table.

    Intervals without barriers are left out, as they have no contacts, unless ``config.without_barriers``.
    """
    owned = barriers.groupBy("interval_id").agg(F.array_sort(F.collect_list(F.struct("pos", "stp_active", "stp_inactive", "blocks"))).alias("barriers"))
    return plan_cells(intervals, config).join(owned, "interval_id", "left" if config.without_barriers else "inner")


def interval_report(intervals: DataFrame, barriers: DataFrame, config: SimulationConfig) -> DataFrame:
    """(chrom, start, end, barriers, simulated) of every interval, those without barriers too."""
    counted = barriers.groupBy("interval_id").agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    return intervals.join(counted, "interval_id", "left").select("chrom", "start", "end", n.alias("barriers"), ((n > 0) | F.lit(config.without_barriers)).alias("simulated"))


def rank(pos: np.ndarray, epoch: np.ndarray, rev: bool) -> np.ndarray:
    """Units by position; of equal ones the older rev unit, or the younger fwd unit, comes first."""
    return np.lexsort((np.arange(len(pos)), epoch if rev else -epoch, pos))


def adjust_moves(pos: np.ndarray, move: np.ndarray, order: np.ndarray, rev: bool) -> np.ndarray:
    """Moves lengthened so that targets are strictly ordered as positions are."""
    steps = np.arange(len(pos))
    out = move.copy()
    if rev:
        target = np.minimum.accumulate((pos[order] - move[order] - steps)[::-1])[::-1] + steps
        out[order] = pos[order] - target
    else:
        target = np.maximum.accumulate(pos[order] + move[order] - steps) + steps
        out[order] = target - pos[order]
    return out


#: A place below all others.
_FAR = np.int64(-(2**62))
#: Barriers that a unit looks at first.
_FEW = 4


class _Luck:
    """Numbers in [0, 1) for barriers, made when they are asked for, by a SplitMix64 sequence for each task from its ``keys``;
    sequences of other ``stream`` numbers lie far apart. ``of`` and ``at`` tell a barrier's task and that one's first barrier."""

    def __init__(self, keys: np.ndarray, of: np.ndarray, at: np.ndarray, stream: int):
        self.keys, self.of, self.at, self.stream = keys, of, at, stream << 40

    def __getitem__(self, which: np.ndarray) -> np.ndarray:
        task = self.of[which]
        z = self.keys[task] + (which - self.at[task] + self.stream).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


class _States:
    """Which barriers are active, epoch by epoch. A byte of luck decides a barrier, unless it is that of the chance itself; then
    the rest of the chance does, so chances are not rounded."""

    def __init__(self, active: np.ndarray, stay_on: np.ndarray, stay_off: np.ndarray):
        self.active = active
        self.on, self.off = stay_on * 256, (1 - stay_off) * 256
        self.off_byte = np.minimum(self.off, 255).astype(np.uint8)
        self.differ = np.minimum(self.on, 255).astype(np.uint8) ^ self.off_byte
        self.least, self.even = np.empty(len(active), np.uint8), np.zeros(-(-len(active) // 8) * 8, bool)

    def step(self, luck: np.ndarray, rest: _Luck) -> None:
        """An epoch on, by a byte for each barrier."""
        least = np.negative(self.active.view(np.uint8), out=self.least)
        least &= self.differ
        least ^= self.off_byte
        np.equal(luck, least, out=self.even[: len(luck)])
        k = (np.flatnonzero(self.even.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()  # eight at a time
        k = k[self.even[k]]
        chance = np.where(self.active[k], self.on[k], self.off[k]) - least[k]
        np.less(luck, least, out=self.active)
        self.active[k] = rest[k] < chance


class Epoch:
    """Moves of one epoch and the collisions that shorten them. Units are bound; arrays are indexed by unit. ``cell`` tells
    apart units that do not meet; those of one cell lie together, and cells further apart than any two moves."""

    def __init__(self, start, end, rev: np.ndarray, fwd: np.ndarray, born: np.ndarray, rev_move: np.ndarray, fwd_move: np.ndarray, cell: np.ndarray | None = None):
        self.start, self.end, self.rev, self.fwd = (np.broadcast_to(start, len(rev)), np.broadcast_to(end, len(rev)), rev, fwd)
        self.cell = np.zeros(len(rev), np.int64) if cell is None else cell
        self.rev_order, self.fwd_order = rank(rev, born, True), rank(fwd, born, False)
        self.rev_move = np.minimum(adjust_moves(rev, rev_move, self.rev_order, True), rev - start)
        self.fwd_move = np.minimum(adjust_moves(fwd, fwd_move, self.fwd_order, False), end - 1 - fwd)
        n = len(rev)
        self.rev_event, self.fwd_event = np.zeros(n, np.int8), np.zeros(n, np.int8)
        self.rev_with, self.fwd_with = np.full(n, -1), np.full(n, -1)

    def boundaries(self) -> None:
        """Units at an end of the interval, and the outermost one that comes there without a unit of the other kind ahead."""
        for rev in (True, False):
            order, other = (self.rev_order, self.fwd_order) if rev else (self.fwd_order[::-1], self.rev_order[::-1])
            at, across, event = (self.rev, self.fwd, self.rev_event) if rev else (self.fwd, self.rev, self.fwd_event)
            group, outermost = np.cumsum(_heads(self.cell[order])) - 1, across[other][_heads(self.cell[other])]
            place, edge, limit = at[order], (self.start if rev else self.end - 1)[order], outermost[group]
            target = place - self.rev_move[order] if rev else place + self.fwd_move[order]
            there = place == edge
            comes = np.flatnonzero(~there & (target == edge) & (place <= limit if rev else place >= limit))
            event[order[there]] = event[order[comes[_heads(group[comes])]]] = BOUNDARY

    def barriers(self, pos: np.ndarray, blocks_rev: np.ndarray, active: np.ndarray, major: float, minor: float, rev_luck, fwd_luck, ordered: bool = False) -> None:
        """Units that cross an active barrier are stopped one base short, by chance ``major`` where it blocks their
        direction and ``minor`` elsewhere. Luck is by barrier, an array or what gives it for those asked; barriers that are
        ``ordered`` by place are taken as they are."""
        self._rev_before, self._fwd_before = self.rev_move.copy(), self.fwd_move.copy()
        sorted_ = None if ordered else np.argsort(pos, kind="stable")
        line = pos if ordered else pos[sorted_]
        for rev, luck in ((True, rev_luck), (False, fwd_luck)):
            at, move, event, partner = (self.rev, self.rev_move, self.rev_event, self.rev_with) if rev else (self.fwd, self.fwd_move, self.fwd_event, self.fwd_with)
            order = self.rev_order if rev else self.fwd_order
            # a unit faces the barriers up to the next unit ahead, as far as it moves; of units at one place the nearest to them does
            place, reach = at[order], move[order]
            if rev:
                first, limit = np.searchsorted(line, place) - 1, np.maximum(np.append(_FAR, place)[:-1], place - reach)
            else:
                first, limit = np.searchsorted(line, place, "right"), np.minimum(np.append(place, -_FAR)[1:], place + reach)

            def faced(on_line: np.ndarray, limit: np.ndarray) -> np.ndarray:
                there = (on_line >= 0) & (on_line < len(line))
                found = line[np.where(there, on_line, 0)] if len(line) else limit
                return there & ((found >= limit) if rev else (found <= limit))

            def hits(first: np.ndarray, n: np.ndarray, limit: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                """Which of ``n`` barriers from ``first`` on stop their unit: unit's number here, place on the line, barrier."""
                which = np.repeat(np.arange(len(n)), n)
                on_line = first[which] + step * (np.arange(len(which)) - _offsets(n)[which])
                k = np.flatnonzero(faced(on_line, limit[which]))
                own = on_line[k] if ordered else sorted_[on_line[k]]
                up = np.flatnonzero(active[own])
                k, own = k[up], own[up]
                stops = luck[own] < np.where(blocks_rev[own] == rev, major, minor)
                k = k[stops]
                return which[k], on_line[k], own[stops]

            # the nearest one counts, so few are looked at first and more where none of these stops
            facing, few, step = np.flatnonzero(faced(first, limit)), _FEW, -1 if rev else 1
            first, limit = first[facing], limit[facing]
            while len(facing):
                which, on_line, own = hits(first, np.full(len(facing), few), limit, step)
                nearest = _heads(which)
                which, on_line, own = which[nearest], on_line[nearest], own[nearest]
                if not rev:  # of several at one place the last
                    k = np.flatnonzero(line[np.minimum(on_line + 1, len(line) - 1)] == line[on_line])
                    if len(k):
                        more = np.searchsorted(line, line[on_line[k]], "right") - on_line[k]
                        tied, _, last = hits(on_line[k], more, limit[which[k]], 1)
                        own[k[tied]] = last
                unit = order[facing[which]]
                distance = at[unit] - pos[own] if rev else pos[own] - at[unit]
                event[unit], partner[unit], move[unit] = BARRIER, own, distance - 1
                first = first + step * few
                open_ = faced(first, limit)
                open_[which] = False
                facing, first, limit, few = facing[open_], first[open_], limit[open_], 8 * few

    def primary(self, bypass: float, luck: np.ndarray) -> None:
        """Neighbours that move towards each other meet; one that a barrier stops before is met where it stands."""
        if not hasattr(self, "_rev_before"):
            self._rev_before, self._fwd_before = self.rev_move.copy(), self.fwd_move.copy()
        kinds = np.concatenate([np.zeros(len(self.rev), int), np.ones(len(self.fwd), int)])
        unit = np.concatenate([self.rev_order, self.fwd_order])
        at = np.concatenate([self.rev[self.rev_order], self.fwd[self.fwd_order]])
        order = np.argsort(at * 2 + kinds, kind="stable")
        k = np.flatnonzero((kinds[order][:-1] == 1) & (kinds[order][1:] == 0))
        f, r = unit[order[k]], unit[order[k + 1]]
        delta = self.rev[r] - self.fwd[f]
        rev_raw, fwd_raw = self._rev_before[r], self._fwd_before[f]
        near = (delta > 0) & (delta < rev_raw + fwd_raw) & (luck[f] >= bypass)
        near &= (self.rev_event[r] != BARRIER) | (self.fwd_event[f] != BARRIER)  # two that barriers hold do not meet
        f, r, gap, rm, fm = f[near], r[near], delta[near], rev_raw[near], fwd_raw[near]  # no unit is in two pairs
        meet = np.maximum(self.fwd[f] + np.floor(gap * fm / (rm + fm) + 0.5).astype(np.int64), self.fwd[f] + 1)
        rev_stop, fwd_stop = self.rev[r] - self.rev_move[r], self.fwd[f] + self.fwd_move[f]
        rev_first = (self.rev_event[r] == BARRIER) & (rev_stop >= meet)
        fwd_first = (self.fwd_event[f] == BARRIER) & (fwd_stop <= meet - 1)
        k = ~rev_first & np.where(fwd_first, self.rev[r] - rm <= fwd_stop, True)
        self._stop_rev(r[k], np.where(fwd_first, fwd_stop + 1, meet)[k], PRIMARY, f[k])
        k = ~fwd_first & np.where(rev_first, self.fwd[f] + fm >= rev_stop, True)
        self._stop_fwd(f[k], np.where(rev_first, rev_stop - 1, meet - 1)[k], PRIMARY, r[k])

    def _stop_rev(self, unit: np.ndarray, pos: np.ndarray, event: int, partner: np.ndarray) -> None:
        self.rev_move[unit], self.rev_event[unit], self.rev_with[unit] = self.rev[unit] - pos, event, partner

    def _stop_fwd(self, unit: np.ndarray, pos: np.ndarray, event: int, partner: np.ndarray) -> None:
        self.fwd_move[unit], self.fwd_event[unit], self.fwd_with[unit] = pos - self.fwd[unit], event, partner

    def secondary(self, bypass: float, rev_luck: np.ndarray, fwd_luck: np.ndarray) -> None:
        """Units that run into a stalled one ahead of them stop behind it; such a stall may stall the next one, so the
        units newly stalled are followed until there are none. Those that luck lets past change places with the unit
        that stands in their way."""
        last = len(self.rev) - 1
        order = self.rev_order
        passed = []
        stalled = np.flatnonzero(self.rev_event[order] != NONE)
        while len(stalled := stalled[stalled < last]):
            a, b = order[stalled], order[stalled + 1]
            stop = self.rev[a] - self.rev_move[a]
            met = (self.cell[a] == self.cell[b]) & (self.rev_event[b] == NONE) & (self.rev[b] - self.rev_move[b] <= stop)
            k = met & (rev_luck[b] >= bypass)
            self._stop_rev(b[k], np.minimum(stop + 1, self.rev[b])[k], SECONDARY, a[k])
            passed.append(stalled[met & ~k])
            stalled = stalled[k] + 1
        at = np.concatenate(passed) if passed else np.zeros(0, np.int64)
        self._rev_swapped(order[at], order[at + 1])
        order[at], order[at + 1] = order[at + 1], order[at]
        order = self.fwd_order
        passed = []
        stalled = np.flatnonzero(self.fwd_event[order] != NONE)
        while len(stalled := stalled[stalled > 0]):
            a, b = order[stalled], order[stalled - 1]
            stop = self.fwd[a] + self.fwd_move[a]
            met = (self.cell[a] == self.cell[b]) & (self.fwd_event[b] == NONE) & (self.fwd[b] + self.fwd_move[b] >= stop)
            k = met & (fwd_luck[b] >= bypass)
            self._stop_fwd(b[k], np.maximum(stop - 1, self.fwd[b])[k], SECONDARY, a[k])
            passed.append(stalled[met & ~k])
            stalled = stalled[k] - 1
        at = np.concatenate(passed) if passed else np.zeros(0, np.int64)
        self._fwd_swapped(order[at], order[at - 1])
        order[at], order[at - 1] = order[at - 1], order[at]

    def _rev_swapped(self, ahead: np.ndarray, behind: np.ndarray) -> None:
        """Each pair trades positions, moves and events; who stands behind afterwards stops a base short of the other.
        No unit is in two pairs."""
        stop = self.rev[ahead] - self.rev_move[ahead]
        follows = np.maximum(self.rev[behind] - stop - 1, 0)
        self.rev[ahead], self.rev[behind] = np.minimum(self.fwd[ahead], self.rev[behind]), np.minimum(self.fwd[behind], self.rev[ahead])
        self.rev_move[ahead], self.rev_move[behind] = follows, self.rev_move[ahead]
        self.rev_event[ahead], self.rev_event[behind] = SECONDARY, self.rev_event[ahead]
        self.rev_with[ahead], self.rev_with[behind] = ahead, self.rev_with[ahead]
        for unit in (ahead, behind):
            self.rev_move[unit] = np.minimum(self.rev_move[unit], self.rev[unit] - self.start[unit])

    def _fwd_swapped(self, ahead: np.ndarray, behind: np.ndarray) -> None:
        stop = self.fwd[ahead] + self.fwd_move[ahead]
        follows = np.maximum(stop - self.fwd[behind] - 1, 0)
        self.fwd[ahead], self.fwd[behind] = np.maximum(self.rev[ahead], self.fwd[behind]), np.maximum(self.rev[behind], self.fwd[ahead])
        self.fwd_move[ahead], self.fwd_move[behind] = follows, self.fwd_move[ahead]
        self.fwd_event[ahead], self.fwd_event[behind] = SECONDARY, self.fwd_event[ahead]
        self.fwd_with[ahead], self.fwd_with[behind] = ahead, self.fwd_with[ahead]
        for unit in (ahead, behind):
            self.fwd_move[unit] = np.minimum(self.fwd_move[unit], self.end[unit] - 1 - self.fwd[unit])

    def extruded(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions after the moves."""
        return self.rev - self.rev_move, self.fwd + self.fwd_move


def _heads(group: np.ndarray) -> np.ndarray:
    """Which elements are the first of their group; groups lie together."""
    out = np.ones(len(group), bool)
    out[1:] = group[1:] != group[:-1]
    return out


def stable(history: np.ndarray, window: int) -> np.ndarray:
    """For each line of values by epoch: whether the smoothed values fall about as often as they rise."""
    size = history.shape[1]
    sums = np.cumsum(np.concatenate([np.zeros((len(history), 1)), history], 1), 1)
    smooth = (sums[:, window:size] - sums[:, : size - window]) / window
    falls = (smooth[:, :-1] > smooth[:, 1:]).sum(1)
    rises = size - window - falls
    return (falls >= 0.95 * rises) & (falls <= 1.05 * rises) & (rises > 0)


class _Counts:
    """How often each number came, summed whenever enough have gathered."""

    def __init__(self, most: int = 1_000_000):
        self.most, self.held, self.size = most, [], 0
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        self.held.append(keys)
        self.size += len(keys)
        if self.size >= self.most:
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if self.held:
            keys, where = np.unique(np.concatenate([self.keys, *self.held]), return_inverse=True)
            self.n = np.bincount(where, weights=np.concatenate([self.n, np.ones(self.size, np.int64)])).astype(np.int64)
            self.keys, self.held, self.size = keys, [], 0
        return self.keys, self.n


#: Numbers of an epoch row, after interval, cell and epoch.
EPOCH_COLUMNS = ("burnin", "barrier_occupancy", "num_active_lefs", "num_stalls_rev", "num_stalls_fwd", "num_stalls_both", "num_lef_bar_collisions", "num_primary_lef_lef_collisions", "num_secondary_lef_lef_collisions", "avg_loop_size", "num_boundary_collisions", "num_contacts")


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _barrier_arrays(barriers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """pos, stp_active, stp_inactive and whether rev units are blocked, of a task's list of barriers; arrays stay as they are."""
    if isinstance(barriers, tuple):
        return barriers
    own = list(barriers or [])
    return np.array([b["pos"] for b in own], np.int64), np.array([b["stp_active"] for b in own], float), np.array([b["stp_inactive"] for b in own], float), np.array([b["blocks"] == "rev" for b in own], bool)


class _Cells:
    """Some tasks on one line. Positions are relative to it: ``base`` is where a task's interval starts."""

    def __init__(self, tasks: list[dict], config: SimulationConfig, noted: bool = True):
        self.config, self.noted = config, noted
        self.gens = [np.random.Generator(np.random.SFC64(np.random.SeedSequence([config.seed, crc32(f"{t['chrom']}:{t['start']}-{t['end']}".encode()), int(t["cell"])]))) for t in tasks]
        self.size, self.lefs, self.per_epoch, self.target = (np.array(x, np.int64) for x in ([t["end"] - t["start"] for t in tasks], [t["lefs"] for t in tasks], [t["per_epoch"] for t in tasks], [t["target"] for t in tasks]))
        bars = [_barrier_arrays(t["barriers"]) for t in tasks]
        self.bars = np.array([len(b[0]) for b in bars])
        count = len(tasks)
        self.base = _offsets(self.size + 2 * int(self.size.max()) + int(self.lefs.sum()) + 10)
        self.unit_at, self.bar_at, self.contact_at = _offsets(self.lefs), _offsets(self.bars), _offsets(self.per_epoch)
        self.of = np.repeat(np.arange(count), self.lefs)
        self.nth = np.arange(len(self.of)) - self.unit_at[self.of]
        self.low = self.base[self.of]
        self.high = self.low + self.size[self.of]
        self.bar_of = np.repeat(np.arange(count), self.bars)
        pos, self.stay_on, self.stay_off, self.blocks_rev = (np.concatenate(x) for x in zip(*bars))
        self.pos = pos - np.array([t["start"] for t in tasks], np.int64)[self.bar_of] + self.base[self.bar_of]
        self.ordered = bool((self.pos[1:] >= self.pos[:-1]).all())
        # pixels and places of an interval's cells are summed together
        names = {name: k for k, name in enumerate(dict.fromkeys(t["interval_id"] for t in tasks))}
        self.interval = np.array([names[t["interval_id"]] for t in tasks])
        first = np.unique(self.interval, return_index=True)[1]
        self.columns = -(-self.size[first] // config.bin_size)
        self.pixel_at, self.spot_at = _offsets(self.columns * config.nrows), _offsets(self.columns)
        self.pixels, self.spots = _Counts(), _Counts()
        self.log: list[np.ndarray] = []

    def run(self) -> None:
        c = self.config
        count, units = len(self.lefs), len(self.of)
        lots_of_luck, lots_of_moves, bar_luck, contact_luck = np.empty((_AHEAD, units, 5)), np.empty((_AHEAD, units, 2)), np.empty(len(self.pos)), np.empty((int(self.per_epoch.sum()), 8))
        bytes_, keys = np.zeros(len(self.pos), np.uint8), np.zeros(count, np.uint64)

        def parts(at: np.ndarray, sizes: np.ndarray) -> list[slice]:
            return [slice(a, a + n) for a, n in zip(at.tolist(), sizes.tolist())]

        unit_part, bar_part, contact_part = parts(self.unit_at, self.lefs), parts(self.bar_at, self.bars), parts(self.contact_at, self.per_epoch)
        for gen, own in zip(self.gens, bar_part):
            gen.random(out=bar_luck[own])
        free = (1 - self.stay_off) + (1 - self.stay_on)
        states = _States(bar_luck < np.where(free > 0, (1 - self.stay_off) / np.where(free > 0, free, 1), 0.5), self.stay_on, self.stay_off)
        rest, rev_luck, fwd_luck = (_Luck(keys, self.bar_of, self.bar_at, stream) for stream in range(3))
        rev, fwd, born, bound = self.low.copy(), self.low.copy(), np.zeros(units, np.int64), np.zeros(units, bool)
        burning = np.full(count, c.burnin)
        awake = np.where(burning, 0, self.lefs)
        alive = np.ones(count, bool) if c.target_epochs is not None else self.target > 0
        sampled, idle, self.done = np.zeros(count, np.int64), np.zeros(count, np.int64), np.zeros(count, np.int64)
        history, seen = np.zeros((2, count, c.burnin_history)), np.zeros(count, np.int64)
        rate = self.lefs / max(1, c.burnin_epochs)
        chances = np.array([c.release_chance, c.burnin_release_chance])[:, None] / np.array([1.0, c.soft_stall, c.hard_stall])
        speeds = np.array([c.speeds, c.burnin_speeds], float)
        bars, words, lefs = self.bars.tolist(), (-(-self.bars // 8) + 1).tolist(), self.lefs.tolist()
        raw = [gen.bit_generator.random_raw for gen in self.gens]
        epoch = 0
        while alive.any() and (c.max_epochs is None or epoch < c.max_epochs):
            full = np.flatnonzero(alive & burning & (awake == self.lefs))
            for k in np.flatnonzero(alive & burning & (awake < self.lefs)).tolist():
                awake[k] = min(self.lefs[k], awake[k] + self.gens[k].poisson(rate[k]))
                while awake[k] == 0:
                    awake[k] = min(self.lefs[k], self.gens[k].poisson(rate[k]))
            if len(full):
                loops = np.where(bound, fwd - rev, 0).astype(float)
                mean = np.bincount(self.of, weights=loops, minlength=count) / self.lefs
                spread = np.sqrt(np.maximum(np.bincount(self.of, weights=loops * loops, minlength=count) / self.lefs - mean * mean, 0))
                history[:, full, :-1] = history[:, full, 1:]
                history[0, full, -1], history[1, full, -1] = mean[full], spread[full] / np.where(mean[full] > 0, mean[full], 1)
                seen[full] += 1
                ripe = full[seen[full] >= c.burnin_history]
                settled = ripe[stable(history[0, ripe], c.burnin_window) & stable(history[1, ripe], c.burnin_window)] if epoch > c.min_burnin else ripe[:0]
                burning[settled] = False
                if epoch >= c.max_burnin:
                    burning[full] = False
            living = np.flatnonzero(alive).tolist()
            if epoch % _AHEAD == 0:
                for k in living:
                    lots_of_luck[:, unit_part[k]] = self.gens[k].random((_AHEAD, lefs[k], 5))
                    lots_of_moves[:, unit_part[k]] = self.gens[k].standard_normal((_AHEAD, lefs[k], 2))
            unit_luck, moves = lots_of_luck[epoch % _AHEAD], lots_of_moves[epoch % _AHEAD]
            for k in living:
                drawn = raw[k](words[k])
                keys[k], bytes_[bar_part[k]] = drawn[-1], drawn.view(np.uint8)[: bars[k]]
            on = np.flatnonzero(alive[self.of] & (self.nth < awake[self.of]))
            new = on[~bound[on]]
            rev[new] = fwd[new] = self.low[new] + np.floor(unit_luck[new, 0] * self.size[self.of[new]]).astype(np.int64)
            born[new], bound[new] = epoch, True
            open_ = np.flatnonzero(alive & ~burning)
            if len(open_):
                for k in open_.tolist():
                    self.gens[k].random(out=contact_luck[contact_part[k]])
                n = self.per_epoch[open_] if c.target_epochs is not None else np.minimum(self.per_epoch[open_], self.target[open_] - self.done[open_])
                got = self._sample(open_, n, rev, fwd, contact_luck)
                self.done[open_] += got
                sampled[open_] += 1
                idle[open_] = np.where(got > 0, 0, idle[open_] + 1)
                over = sampled[open_] >= c.target_epochs if c.target_epochs is not None else self.done[open_] >= self.target[open_]
                alive[open_[over | (idle[open_] >= c.idle_epochs)]] = False
                on = on[alive[self.of[on]]]
                if not len(on):
                    break
            of = self.of[on]
            slow = burning[of].astype(int)
            step = [np.minimum(np.floor(np.maximum(speeds[slow, side] + c.speed_stds[side] * moves[on, side], 0) + 0.5).astype(np.int64), self.size[of]) for side in (0, 1)]
            states.step(bytes_, rest)
            e = Epoch(self.low[on], self.high[on], rev[on], fwd[on], born[on], *step, of)
            e.boundaries()
            e.barriers(self.pos, self.blocks_rev, states.active, c.major_block, c.minor_block, rev_luck, fwd_luck, self.ordered)
            e.primary(c.bypass, unit_luck[on, 4])
            e.secondary(c.bypass, unit_luck[on, 2], unit_luck[on, 3])
            rev[on], fwd[on] = e.extruded()
            held = np.zeros(len(on), int)
            for event, partner, side in ((e.rev_event, e.rev_with, True), (e.fwd_event, e.fwd_with, False)):
                k = np.flatnonzero(event == BARRIER)
                held[k] += self.blocks_rev[partner[k]] == side
            bound[on] = unit_luck[on, 1] >= chances[slow, held]
            if self.noted:
                self._note(epoch, np.flatnonzero(alive), e, of, burning, np.array([np.count_nonzero(states.active[part]) for part in bar_part]), rev[on], fwd[on])
            epoch += 1

    def _sample(self, tasks: np.ndarray, n: np.ndarray, rev: np.ndarray, fwd: np.ndarray, luck: np.ndarray) -> np.ndarray:
        """``n`` contacts for each task, of loops or of places inside them, with noise at the ends, and as many positions of
        units; what falls out of the interval is not registered. How many contacts of each task were."""
        c = self.config
        task = np.repeat(tasks, n)
        nth = np.arange(len(task)) - np.repeat(_offsets(n), n)
        luck = luck[self.contact_at[task] + nth]
        if c.tad_to_loop == 0:
            loops = n
        elif math.isfinite(c.tad_to_loop):
            loops = np.array([self.gens[k].binomial(m, 1 / (c.tad_to_loop + 1)) for k, m in zip(tasks.tolist(), n.tolist())], np.int64)
        else:
            loops = np.zeros(len(n), np.int64)
        first, last = self.base[task] + 1, self.base[task] + self.size[task] - 1

        def ends(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            unit = self.unit_at[task] + np.floor(u[:, 0] * self.lefs[task]).astype(np.int64)
            mu, sigma, xi = c.noise
            v = -np.log(np.maximum(u[:, 1:3], 1e-300))
            jitter = mu + sigma * (v**-xi - 1) / xi if xi else mu - sigma * np.log(v)
            a, b = rev[unit] - jitter[:, 0], fwd[unit] + jitter[:, 1]
            a, b = np.minimum(a, b), np.maximum(a, b)
            good = (rev[unit] > first) & (fwd[unit] < last) & (fwd[unit] > first) & (rev[unit] < last) & (a >= first) & (b < last)
            return np.floor(np.where(good, a, first)).astype(np.int64), np.floor(np.where(good, b, first)).astype(np.int64), good

        a, b, good = ends(luck[:, :3])
        inside = nth >= np.repeat(loops, n)
        width = b - a + 1
        one, two = (a + np.floor(luck[:, k] * width).astype(np.int64) for k in (3, 4))
        a, b = np.where(inside, np.minimum(one, two), a), np.where(inside, np.maximum(one, two), b)
        own = self.interval[task]
        x, y = (a - first) // c.bin_size, (b - first) // c.bin_size
        k = np.flatnonzero(good & (y - x < c.nrows))
        self.pixels.add(self.pixel_at[own[k]] + x[k] * c.nrows + y[k] - x[k])
        p, q, fine = ends(luck[:, 5:8])
        spot = self.spot_at[own]
        self.spots.add(np.concatenate([(spot + (z - first) // c.bin_size)[fine] for z in (p, q)]))
        return np.bincount(np.searchsorted(tasks, task[good]), minlength=len(tasks))

    def _note(self, epoch: int, tasks: np.ndarray, e: Epoch, of: np.ndarray, burning: np.ndarray, active: np.ndarray, rev: np.ndarray, fwd: np.ndarray) -> None:
        count = len(self.lefs)

        def units(flag: np.ndarray) -> np.ndarray:
            return np.bincount(of, weights=flag, minlength=count)[tasks]

        n = np.maximum(np.bincount(of, minlength=count)[tasks], 1)
        kinds = [units((e.rev_event == kind).astype(float) + (e.fwd_event == kind)) for kind in (BARRIER, PRIMARY, SECONDARY, BOUNDARY)]
        up, down = e.rev_event != NONE, e.fwd_event != NONE
        share = active[tasks] / np.maximum(self.bars[tasks], 1)
        self.log.append(np.stack([tasks, np.full(len(tasks), epoch), burning[tasks], share, n, units(up), units(down), units(up & down), *kinds[:3], units(fwd - rev) / n, kinds[3], self.done[tasks]], 1))


def run_task(task: dict, config: SimulationConfig) -> tuple[dict, dict, list]:
    """Pixels {(bin1, bin2): n}, occupancies {bin: n} and epoch statistics (epoch, then ``EPOCH_COLUMNS``) of one task."""
    cells = _Cells([task], config.resolved())
    cells.run()
    rows = config.nrows
    return {(k // rows, k // rows + k % rows): n for k, n in zip(*(x.tolist() for x in cells.pixels.total()))}, dict(zip(*(x.tolist() for x in cells.spots.total()))), [tuple(x) for log in cells.log for x in log[:, 1:].tolist()]


_OUT = "kind string, interval_id bigint, chrom string, cell int, a bigint, b bigint, n bigint, stats array<double>"


def _batch(kind: str, tasks: list[dict], which: np.ndarray, **columns) -> pa.RecordBatch:
    size = len(which)
    types = {"cell": pa.int32(), "a": pa.int64(), "b": pa.int64(), "n": pa.int64(), "stats": pa.list_(pa.float64())}
    ids, names = np.array([t["interval_id"] for t in tasks], np.int64), pa.array([t["chrom"] for t in tasks], pa.string())
    rest = [pa.array(columns[name], t) if name in columns else pa.nulls(size, t) for name, t in types.items()]
    return pa.RecordBatch.from_arrays([pa.array([kind] * size, pa.string()), pa.array(ids[which]), names.take(pa.array(which)), *rest], names=["kind", "interval_id", "chrom", *types])


def _simulated(config: SimulationConfig, with_epochs: bool, read=None):
    read = read or _planned_tasks

    def answer(tasks: list[dict]) -> Iterator[pa.RecordBatch]:
        cells = _Cells(tasks, config, with_epochs)
        cells.run()
        owner = np.unique(cells.interval, return_index=True)[1]
        keys, n = cells.pixels.total()
        own = np.searchsorted(cells.pixel_at, keys, "right") - 1
        x = (keys - cells.pixel_at[own]) // config.nrows
        yield _batch("pixel", tasks, owner[own], a=x, b=x + (keys - cells.pixel_at[own]) % config.nrows, n=n)
        keys, n = cells.spots.total()
        own = np.searchsorted(cells.spot_at, keys, "right") - 1
        yield _batch("spot", tasks, owner[own], a=keys - cells.spot_at[own], n=n)
        if with_epochs and cells.log:
            log = np.concatenate(cells.log)
            which = log[:, 0].astype(np.int64)
            yield _batch("epoch", tasks, which, cell=np.array([t["cell"] for t in tasks], np.int32)[which], a=log[:, 1].astype(np.int64), stats=list(log[:, 2:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, units, bars = [], 0, 0
        for task in read(batches):
            own = len(task["barriers"][0]) if isinstance(task["barriers"], tuple) else len(task["barriers"] or [])
            if held and (units + task["lefs"] > _TOGETHER or bars + own > _BARRIERS):
                yield from answer(held)
                held, units, bars = [], 0, 0
            held.append(task)
            units, bars = units + task["lefs"], bars + own
        if held:
            yield from answer(held)

    return run


def _planned_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _tasks_of_lots(without_barriers: bool):
    """A reader of lots, one a line: a list of tasks and a list of all barriers that any of them may have."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for k in range(batch.num_rows):
                near = batch.column("near")[k].values
                chrom, start, end, pos, on, off, blocks = (near.field(c).to_numpy(zero_copy_only=False) for c in _NEAR) if near is not None else [np.zeros(0)] * 7
                rev = blocks == "rev"
                order = np.lexsort((rev, off, on, pos))
                chrom, (start, end), arrays = chrom[order], (start[order], end[order]), (pos[order].astype(np.int64), on[order].astype(float), off[order].astype(float), rev[order].astype(bool))
                parts, last = {}, None
                for task in batch.column("tasks")[k].as_py():
                    if task["chrom"] not in parts:
                        parts[task["chrom"]] = np.flatnonzero(chrom == task["chrom"])
                    if last is None or last[0] != (task["chrom"], task["start"], task["end"]):
                        part = parts[task["chrom"]]
                        met = part[(start[part] < task["end"]) & (task["start"] < end[part])]
                        last = (task["chrom"], task["start"], task["end"]), tuple(a[met] for a in arrays)
                    if len(last[1][0]) or without_barriers:
                        yield task | {"barriers": last[1]}

    return read


_TASK = ("interval_id", "chrom", "start", "end", "cell", "lefs", "per_epoch", "target")
_NEAR = ("chrom", "start", "end", "pos", "stp_active", "stp_inactive", "blocks")


def simulate_raw(tasks: DataFrame, config: SimulationConfig, with_epochs: bool = False) -> DataFrame:
    """What the kernel emits, all kinds in one table; ``outputs`` tells them apart. To use more than one of them, write
    this table first, so that the kernel runs once.

    Tasks are few bytes and much work: they are dealt to a fixed number of partitions, at least two for each core
    while there are as many tasks, and at most some ``_TOGETHER`` units in each where there are more.
    """
    size = tasks.agg(F.count("*").alias("n"), F.sum("lefs").alias("units")).first()
    wanted = max(2 * tasks.sparkSession.sparkContext.defaultParallelism, (size["units"] or 0) // _TOGETHER)
    spread = tasks.repartition(max(1, min(size["n"], wanted)))
    return spread.select(*_TASK, "barriers").mapInArrow(_simulated(config.resolved(), with_epochs), _OUT)


def simulate_intervals_raw(intervals: DataFrame, barriers: DataFrame, config: SimulationConfig, with_epochs: bool = False) -> DataFrame:
    """``simulate_raw`` of all cells of ``intervals`` with the ``barriers`` (chrom, start, end, pos, ...) that overlap them.

    Tasks lie in lots by place, and a lot gets the barriers of its stretch once: the kernel picks each task's. There are so many
    lots for each core, however many tasks, so what is shuffled grows with intervals and with barriers, not with their pairs.
    """
    cells = plan_cells(intervals, config).select(*_TASK)
    n, cores = cells.count(), intervals.sparkSession.sparkContext.defaultParallelism
    lots = max(1, min(n, max(2 * cores, min(_LOTS * cores, n // _LOT))))
    placed = numbered(cells, [], ["chrom", "start", "end", "interval_id", "cell"], "_place").withColumn("_lot", F.floor(F.col("_place") / math.ceil(max(n, 1) / lots)))
    stretches = placed.groupBy("_lot", "chrom").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    near = overlap_join(stretches, barriers.select(*_NEAR)).groupBy("_lot").agg(F.collect_list(F.struct(*[F.col(f"r_{c}").alias(c) for c in _NEAR])).alias("near"))
    tasks = placed.groupBy("_lot").agg(F.array_sort(F.collect_list(F.struct("_place", *_TASK))).alias("tasks"))
    dealt = tasks.join(near, "_lot", "left").select("tasks", "near").repartition(lots)
    return dealt.mapInArrow(_simulated(config.resolved(), with_epochs, _tasks_of_lots(config.without_barriers)), _OUT)


def outputs(raw: DataFrame) -> dict[str, DataFrame]:
    """``pixels`` (interval_id, chrom, bin1, bin2, count), ``occupancy`` (interval_id, chrom, bin, n) and ``epochs``
    (interval_id, chrom, cell, epoch, ...). Bins count from the interval's start."""
    return {
        "pixels": raw.where("kind = 'pixel'").groupBy("interval_id", "chrom", F.col("a").alias("bin1"), F.col("b").alias("bin2")).agg(F.sum("n").alias("count")),
        "occupancy": raw.where("kind = 'spot'").groupBy("interval_id", "chrom", F.col("a").alias("bin")).agg(F.sum("n").alias("n")),
        "epochs": raw.where("kind = 'epoch'").select("interval_id", "chrom", "cell", F.col("a").alias("epoch"), *[F.col("stats")[k].alias(name) for k, name in enumerate(EPOCH_COLUMNS)]),
    }


def simulate(tasks: DataFrame, config: SimulationConfig, with_epochs: bool = False) -> dict[str, DataFrame]:
    """``outputs`` of ``tasks``; each of them runs the kernel when it is computed."""
    return outputs(simulate_raw(tasks, config, with_epochs))


def simulate_intervals(intervals: DataFrame, barriers: DataFrame, config: SimulationConfig, with_epochs: bool = False) -> dict[str, DataFrame]:
    """``outputs`` of ``simulate_intervals_raw``; each of them runs the kernel when it is computed."""
    return outputs(simulate_intervals_raw(intervals, barriers, config, with_epochs))
