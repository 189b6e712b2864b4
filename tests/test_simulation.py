"""Hand-drawn layouts with known moves and collisions, and invariants of the simulation."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaweave.functions.formulas import genomic_distance
from chromaweave.operators import collisions
from chromaweave.operators.barriers import map_to_intervals
from chromaweave.operators.simulation import BARRIER, BOUNDARY, NONE, PRIMARY, SECONDARY, Epoch, SimulationConfig, interval_report, plan_tasks, rank, run_task, simulate, simulate_intervals, stable, target_epochs_of


def half(n):
    return np.full(n, 0.5)


def epoch(start, end, lefs, rev_move, fwd_move):
    lefs = np.array(lefs)
    return Epoch(start, end, lefs[:, 0].copy(), lefs[:, 1].copy(), np.zeros(len(lefs), int), np.array(rev_move), np.array(fwd_move))


@pytest.mark.parametrize(
    ("start", "end", "lefs", "rev", "fwd", "rev_out", "fwd_out"),
    [
        (0, 101, [(5, 25), (10, 20), (90, 90)], [5, 10, 15], [10, 20, 10], [5, 10, 15], [16, 20, 10]),
        (10, 400, [(20, 50), (60, 60), (200, 310), (220, 300), (240, 250), (125, 305)], [10, 10, 5, 25, 50, 10], [25, 10, 5, 20, 20, 0], [10, 10, 12, 31, 50, 10], [25, 16, 12, 20, 20, 16]),
    ],
)
def test_adjusted_moves(start, end, lefs, rev, fwd, rev_out, fwd_out):
    e = epoch(start, end, lefs, rev, fwd)
    assert e.rev_move.tolist() == rev_out and e.fwd_move.tolist() == fwd_out


def test_adjusted_moves_of_tables(spark):
    rows = [(0, k, r, f, 0, a, b) for k, ((r, f), a, b) in enumerate(zip([(20, 50), (60, 60), (200, 310), (220, 300), (240, 250), (125, 305)], [10, 10, 5, 25, 50, 10], [25, 10, 5, 20, 20, 0]))]
    df = spark.createDataFrame(rows, "cell int, lef_id int, rev long, fwd long, epoch int, rev_move long, fwd_move long")
    out = collisions.adjusted_moves(collisions.ranked(df, ["cell"]), ["cell"]).orderBy("lef_id").collect()
    assert [r.rev_move for r in out] == [10, 10, 12, 31, 50, 10] and [r.fwd_move for r in out] == [25, 16, 12, 20, 20, 16]


def test_ranks_with_ties():
    lefs = np.array([(95, 100, 0), (101, 103, 0), (102, 110, 0), (104, 111, 0), (105, 112, 0), (102, 102, 1)])
    assert rank(lefs[:, 0], lefs[:, 2], True).tolist() == [0, 1, 2, 5, 3, 4]
    assert rank(lefs[:, 1], lefs[:, 2], False).tolist() == [0, 5, 1, 2, 3, 4]


def test_units_meet():
    e = epoch(0, 30, [(0, 2), (4, 8), (14, 14), (18, 23)], [0, 3, 3, 3], [2] * 4)
    e.boundaries()
    e.primary(0, half(len(e.rev)))
    assert e.rev_event.tolist() == [BOUNDARY, PRIMARY, NONE, PRIMARY] and e.rev_with.tolist() == [-1, 0, -1, 2]
    assert e.fwd_event.tolist() == [PRIMARY, NONE, PRIMARY, NONE] and e.fwd_with.tolist() == [1, -1, 3, -1]
    assert e.rev_move.tolist() == [0, 1, 3, 2] and e.fwd_move.tolist() == [0, 2, 1, 2]


def test_units_meet_in_tables(spark):
    rows = [(0, k, r, f, 0, a, 2) for k, ((r, f), a) in enumerate(zip([(0, 2), (4, 8), (14, 14), (18, 23)], [0, 3, 3, 3]))]
    df = spark.createDataFrame(rows, "cell int, lef_id int, rev long, fwd long, epoch int, rev_move long, fwd_move long")
    out = collisions.primary_collisions(collisions.ranked(df, ["cell"]), ["cell"]).orderBy("pos").collect()
    assert [(r.fwd_lef, r.rev_lef, r.pos) for r in out] == [(0, 1, 3), (2, 3, 16)]


def test_barriers_stop_units():
    e = epoch(0, 1000, [(0, 1), (3, 4), (5, 5)], [0, 2, 2], [2, 2, 2])
    e.barriers(np.array([2, 4, 8]), np.array([True] * 3), np.array([True] * 3), 1, 0, half(3), half(3))
    assert e.rev_event.tolist() == [NONE, BARRIER, BARRIER] and e.rev_with.tolist() == [-1, 0, 1]
    assert e.rev_move.tolist() == [0, 0, 0] and e.fwd_move.tolist() == [2, 2, 2]


N, C, D = (NONE, -1), (BOUNDARY, -1), (BOUNDARY, -1)
B, P, S = ([(kind, k) for k in range(7)] for kind in (BARRIER, PRIMARY, SECONDARY))
_SEVEN = [(200, 375), (350, 350), (575, 575), (601, 770), (650, 800), (850, 850), (970, 975)]
_FIVE = [(150, False), (400, True), (600, True), (895, False), (900, True)]
_STACKED = [(95, 100), (101, 103), (102, 110), (104, 111), (105, 112)]

#: Layouts of units and barriers (position, blocks rev) on an interval, their moves, and what comes of them.
#: Units that are not bound are left out.
LAYOUTS = {
    "all kinds": (1000, 75, [(25, 30), (150, 150), (200, 350), (230, 399), (425, 425), (625, 800), (650, 650)], [(100, False), (105, True), (400, False), (600, False), (850, True)], 0, True, [C, B[1], P[1], S[2], P[3], N, N], [B[0], P[2], S[3], B[2], N, N, N], [25, 44, 25, 54, 25, 75, 75], [69, 24, 48, 0, 75, 75, 75]),
    "boundary": (1000, 75, _SEVEN, _FIVE, 0, True, [N, N, N, B[2], S[3], P[4], B[4]], [N, N, P[3], S[4], P[5], B[3], D], [75, 75, 75, 0, 48, 25, 69], [75, 75, 25, 53, 24, 44, 24]),
    "soft collisions": (1000, 75, _SEVEN, _FIVE, 1, True, [B[0], N, N, B[2], S[3], P[4], B[4]], [B[1], S[0], B[2], S[4], P[5], B[3], D], [49, 75, 75, 0, 48, 25, 69], [24, 48, 24, 53, 24, 44, 24]),
    "inactive barriers": (1000, 75, _SEVEN, _FIVE, 0, False, [N, N, N, P[2], S[3], P[4], P[5]], [N, N, P[3], S[4], P[5], P[6], D], [75, 75, 75, 13, 61, 25, 60], [75, 75, 12, 53, 24, 59, 24]),
    "one place": (150, (25, [25, 25, 25, 24, 8, 9]), [(30, 50), (60, 80), (60, 80), (65, 125), (140, 140), (140, 140)], [(100, False)], 0, True, [N, P[0], S[1], S[2], P[3], S[4]], [P[1], S[2], B[0], P[4], S[5], D], [25, 5, 4, 8, 8, 7], [4, 18, 19, 6, 8, 9]),
    "few bound": (150, (25, [25, 25, 24, 9]), [(30, 50), (60, 80), (65, 125), (140, 140)], [(100, False)], 0, True, [N, P[0], S[1], P[2]], [P[1], B[0], P[3], D], [25, 5, 9, 8], [4, 19, 6, 9]),
    "unit before barrier, rev": (200, 20, [(50, 95), (110, 150)], [(100, True)], 0, True, [N, P[0]], [P[1], N], [20, 7], [7, 20]),
    "unit before barrier, fwd": (200, 20, [(50, 90), (105, 150)], [(100, False)], 0, True, [N, P[0]], [P[1], N], [20, 7], [7, 20]),
    "stacked": (200, 10, _STACKED, [(100, True), (105, False)], 0, True, [N, B[0], S[1], P[1], S[3]], [P[1], P[3], N, N, N], [10, 0, 0, 0, 0], [0, 0, 10, 10, 10]),
    "stacked, one more": (200, 10, [*_STACKED, (102, 102)], [(100, True), (105, False)], 0, True, [N, B[0], S[1], P[1], S[3], S[2]], [P[1], P[3], N, N, N, S[1]], [10, 0, 0, 0, 0, 0], [0, 0, 10, 10, 10, 0]),
}


def moves_of(speed, n):
    return [np.broadcast_to(m, n).copy() for m in (speed if isinstance(speed, tuple) else (speed, speed))]


def stepped(size, speed, lefs, bars, minor, active, bypass=0.0, shift=0, born=None):
    lefs = np.array(lefs) + shift
    n, pos = len(lefs), np.array([p for p, _ in bars]) + shift
    e = Epoch(shift, size + shift, lefs[:, 0].copy(), lefs[:, 1].copy(), np.zeros(n, int) if born is None else np.array(born), *moves_of(speed, n))
    e.boundaries()
    e.barriers(pos, np.array([r for _, r in bars]), np.full(len(bars), active), 1, minor, half(len(bars)), half(len(bars)))
    e.primary(0, half(n))
    e.secondary(bypass, half(n), half(n))
    return e


@pytest.mark.parametrize("name", LAYOUTS)
def test_collisions(name):
    size, speed, lefs, bars, minor, active, rev, fwd, rev_move, fwd_move = LAYOUTS[name]
    # the unit bound last is the younger one where two stand at one place
    e = stepped(size, speed, lefs, bars, minor, active, born=[0] * 5 + [1] if name == "stacked, one more" else None)
    assert list(zip(e.rev_event.tolist(), e.rev_with.tolist())) == rev
    assert list(zip(e.fwd_event.tolist(), e.fwd_with.tolist())) == fwd
    assert e.rev_move.tolist() == rev_move and e.fwd_move.tolist() == fwd_move


def test_units_let_past_change_places():
    """Two units before one barrier, the second let past the first."""
    e = stepped(200, 10, [(25, 95), (50, 99)], [(100, False)], 0, True, bypass=1.0)
    assert e.fwd.tolist() == [99, 95] and e.fwd_move.tolist() == [0, 3] and e.rev_move.tolist() == [10, 10]
    assert e.fwd_event.tolist() == [BARRIER, SECONDARY] and e.fwd_with.tolist() == [0, 1] and e.fwd_order.tolist() == [1, 0]
    e = stepped(200, 10, [(26, 75), (30, 80)], [(25, True)], 0, True, bypass=1.0)
    assert e.rev.tolist() == [30, 26] and e.rev_move.tolist() == [3, 0] and e.fwd_move.tolist() == [10, 10]
    assert e.rev_event.tolist() == [SECONDARY, BARRIER] and e.rev_with.tolist() == [0, 0] and e.rev_order.tolist() == [1, 0]


def test_cells_on_one_line_do_not_meet():
    """All layouts in one epoch, each as a cell of its own, come out as they do alone."""
    same = [v for v in LAYOUTS.values() if v[4] == 0 and v[5]]
    far = 5_000
    lefs = np.concatenate([np.array(v[2]) + k * far for k, v in enumerate(same)])
    cell = np.repeat(np.arange(len(same)), [len(v[2]) for v in same])
    moves = [np.concatenate(m) for m in zip(*(moves_of(v[1], len(v[2])) for v in same))]
    bars = [(p + k * far, r) for k, v in enumerate(same) for p, r in v[3]]
    born = np.concatenate([[0] * 5 + [1] if len(v[2]) == 6 and v[2][5] == (102, 102) else [0] * len(v[2]) for v in same]).astype(int)
    e = Epoch(cell * far, cell * far + np.array([v[0] for v in same])[cell], lefs[:, 0].copy(), lefs[:, 1].copy(), born, *moves, cell)
    e.boundaries()
    e.barriers(np.array([p for p, _ in bars]), np.array([r for _, r in bars]), np.ones(len(bars), bool), 1, 0, half(len(bars)), half(len(bars)))
    e.primary(0, half(len(lefs)))
    e.secondary(0, half(len(lefs)), half(len(lefs)))
    assert e.rev_move.tolist() == [m for v in same for m in v[8]] and e.fwd_move.tolist() == [m for v in same for m in v[9]]
    assert e.rev_event.tolist() == [k for v in same for k, _ in v[6]] and e.fwd_event.tolist() == [k for v in same for k, _ in v[7]]


TASK = {"interval_id": 1, "chrom": "c", "start": 1000, "end": 401000, "cell": 0, "lefs": 8, "per_epoch": 5, "target": 400, "barriers": [{"pos": 100_000, "stp_active": 0.9, "stp_inactive": 0.7, "blocks": "rev"}, {"pos": 300_000, "stp_active": 0.9, "stp_inactive": 0.7, "blocks": "fwd"}]}


def test_task_is_reproducible_and_in_bounds():
    config = SimulationConfig(diagonal_width=100_000, seed=3)
    cells, spots, log = run_task(TASK, config)
    again = run_task(TASK, config)
    assert (cells, spots, log) == again
    assert run_task(TASK | {"cell": 1}, config)[0] != cells
    assert 0 < sum(cells.values()) <= 400  # contacts beyond the band are registered, but have no pixel
    assert all(0 <= a <= b < 80 and b - a < 20 for a, b in cells) and all(0 <= s < 80 for s in spots)
    assert sum(spots.values()) % 2 == 0 and abs(sum(spots.values()) - 800) < 200
    done = [row[-1] for row in log]
    assert done == sorted(done) and 390 <= done[-1] < 400  # the epoch that reaches the target makes no moves


def test_burn_in_lasts_until_loops_are_stable():
    log = run_task(TASK, SimulationConfig(diagonal_width=100_000, seed=3))[2]
    burning = [row[1] for row in log]
    last = int(sum(burning))
    assert burning == sorted(burning, reverse=True) and last > 187 and log[last - 1][-1] == 0
    assert len([r for r in run_task(TASK, SimulationConfig(diagonal_width=100_000, seed=3, min_burnin=last + 50))[2] if r[1]]) > last + 50
    assert len([r for r in run_task(TASK, SimulationConfig(diagonal_width=100_000, seed=3, max_burnin=60))[2] if r[1]]) < 150
    assert not any(r[1] for r in run_task(TASK, SimulationConfig(diagonal_width=100_000, burnin=False))[2])


def test_stability_is_that_of_the_table(spark):
    rng = np.random.default_rng(5)
    history = rng.normal(size=(60, 41))  # of 36 smoothed values, 35 steps: 18 falls
    history[:20] = np.sort(history[:20], 1)
    rows = [(k, e, float(v), float(v)) for k, line in enumerate(history) for e, v in enumerate(line)]
    got = {r.cell: r.stable for r in collisions.burnin_stable(spark.createDataFrame(rows, "cell int, epoch int, cv double, loop double"), ["cell"], 41, 5).collect()}
    assert [got[k] for k in range(60)] == stable(history, 5).tolist() and 0 < sum(got.values()) < 60


def test_target_in_epochs():
    log = run_task(TASK, SimulationConfig(diagonal_width=100_000, burnin=False, target_epochs=12))[2]
    assert len(log) == 11
    config = SimulationConfig(cells=4, target_epochs=7)
    assert target_epochs_of(4979, 29_875_200, config) == 28
    assert target_epochs_of(4979, 29_875_200, SimulationConfig()) == 37485


def test_options_that_follow_from_others():
    config = SimulationConfig(bin_size=10_000, occupancy=0.8)
    assert config.speeds == (8000, 8000) and config.release_chance == pytest.approx(16 / 300) and config.speed_stds == (400, 400)
    own = config.resolved()
    assert own.stp_inactive == pytest.approx(0.49) and own.barrier_occupancy == 0.8 and own.stp_active == pytest.approx(1 - 0.51 * 0.25) and own.bypass == pytest.approx(0.2)
    assert own.resolved() == own and SimulationConfig(rev_speed=4000, fwd_speed=4000).resolved() == SimulationConfig().resolved()
    assert SimulationConfig(burnin_speed=0.5).burnin_speeds == (2000, 2000) and SimulationConfig(speed_std=30).speed_stds == (30, 30)


def test_results_do_not_depend_on_partitions(spark):
    intervals = spark.createDataFrame([(1, "c", 0, 400_000), (2, "d", 0, 200_000), (3, "e", 0, 90_000)], "interval_id long, chrom string, start long, end long")
    barriers = spark.createDataFrame([(1, 100_000, 0.9, 0.7, "rev"), (2, 50_000, 0.9, 0.7, "fwd")], "interval_id long, pos long, stp_active double, stp_inactive double, blocks string")
    config = SimulationConfig(cells=3, diagonal_width=100_000, contact_density=0.05)
    tasks = plan_tasks(intervals, barriers, config)
    assert tasks.count() == 6  # no task for the interval without barriers
    assert {(r.chrom, r.simulated) for r in interval_report(intervals, barriers, config).collect()} == {("c", True), ("d", True), ("e", False)}
    every = plan_tasks(intervals, barriers, replace(config, without_barriers=True))
    assert every.count() == 9 and simulate(every.where("chrom = 'e'"), config)["occupancy"].count() > 0
    one = {tuple(r) for r in simulate(tasks, config)["pixels"].collect()}
    two = {tuple(r) for r in simulate(tasks.coalesce(1), config)["pixels"].collect()}
    assert one and one == two


def test_planning_numbers(spark):
    """A chromosome of 248,956,422 bp at default options."""
    from chromaweave.functions.formulas import contacts_per_epoch, lefs_of

    row = spark.range(1).select(lefs_of(F.lit(248_956_422), 20.0).alias("n"), contacts_per_epoch(F.lit(4979), 4000, 4000, 50_000).alias("c"), (F.ceil(F.lit(248_956_422) / 5000) * 600).alias("p")).first()
    assert (row.n, row.c, row.p) == (4979, 797, 29_875_200)


def test_distances():
    for text, bp in {"10kb": 10_000, "10k": 10_000, "10KBP": 10_000, "5.5kb": 5_500, "1e6kb": 10**9, "1gbp": 10**9, "7": 7}.items():
        assert genomic_distance(text) == bp
    for text in ("10kbpp", "0.0001kb", "!10gbp", " 10gbp", "", "kb"):
        with pytest.raises(ValueError):
            genomic_distance(text)


def test_lots_with_their_stretchs_barriers_give_what_planned_tasks_give(spark, monkeypatch):
    monkeypatch.setattr("chromaweave.operators.simulation._LOT", 4)
    monkeypatch.setattr("chromaweave.operators.simulation._BARRIERS", 30)
    config = SimulationConfig(cells=2, diagonal_width=100_000, target_epochs=5, burnin=False, seed=3)
    intervals = spark.createDataFrame([(k, "cd"[k % 2], k * 37_000, k * 37_000 + 200_000) for k in range(24)] + [(99, "e", 0, 100_000)], "interval_id long, chrom string, start long, end long")
    rows = [("cd"[k % 2], k * 9_000 % 900_000, k * 9_000 % 900_000 + (20 if k % 5 else 60_000), k * 9_000 % 900_000 + 10, 0.5 + k % 3 / 10, 0.6, ("rev", "fwd")[k // 2 % 2]) for k in range(160)]
    barriers = spark.createDataFrame(rows, "chrom string, start long, end long, pos long, stp_active double, stp_inactive double, blocks string")
    for own in (config, replace(config, without_barriers=True)):
        one = simulate(plan_tasks(intervals, map_to_intervals(barriers, intervals), own), own, with_epochs=True)
        two = simulate_intervals(intervals, barriers, own, with_epochs=True)
        for name in ("pixels", "occupancy", "epochs"):
            assert sorted(map(tuple, one[name].collect())) == sorted(map(tuple, two[name].collect())) != []


class Asked:
    """Luck by barrier that notes how many are asked for."""

    def __init__(self, luck):
        self.luck, self.n = luck, 0

    def __getitem__(self, which):
        self.n += len(which)
        return self.luck[which]


def test_units_look_at_the_nearest_barriers_only():
    lefs = [(k * 20_000 + 9_000, k * 20_000 + 10_000) for k in range(10)]
    e = epoch(0, 200_000, lefs, [8_000] * 10, [8_000] * 10)
    pos, luck = np.arange(0, 200_000, 2), [Asked(half(100_000)) for _ in range(2)]
    e.barriers(pos, np.arange(100_000) % 2 == 0, np.ones(100_000, bool), 1, 0, *luck)
    assert set(e.rev_event.tolist() + e.fwd_event.tolist()) == {BARRIER} and max(e.rev_move.max(), e.fwd_move.max()) < 4
    assert luck[0].n + luck[1].n <= 20 * 4


@pytest.mark.parametrize("seed", range(4))
def test_the_nearest_barrier_that_stops_counts(seed):
    rng = np.random.default_rng(seed)
    n, bars, size = 30, 900, 20_000
    rev = rng.integers(0, size - 300, n)
    e = epoch(0, size, np.stack([rev, rev + rng.integers(0, 300, n)], 1), rng.integers(0, 900, n), rng.integers(0, 900, n))
    before = e.rev_move.copy(), e.fwd_move.copy()
    pos = rng.integers(0, size, bars) // 3 * 3  # some at one place
    blocks, active, lucks = rng.random(bars) < 0.5, rng.random(bars) < 0.15, (rng.random(bars), rng.random(bars))
    e.barriers(pos, blocks, active, 0.4, 0.1, *lucks)
    for at, order, move, event, luck, was, way in ((e.rev, e.rev_order, e.rev_move, e.rev_event, lucks[0], before[0], -1), (e.fwd, e.fwd_order[::-1], e.fwd_move, e.fwd_event, lucks[1], before[1], 1)):
        behind = dict(zip(order.tolist(), [None, *order[:-1].tolist()]))  # the next unit ahead, in the order of the line
        for unit in range(n):
            ahead = at[behind[unit]] if behind[unit] is not None else None
            stops = [abs(p - at[unit]) - 1 for p, b, a, u in zip(pos.tolist(), blocks, active, luck) if a and u < (0.4 if b == (way < 0) else 0.1) and 0 < (p - at[unit]) * way <= was[unit] and (ahead is None or (p - ahead) * way <= 0)]
            assert (event[unit] == BARRIER) == bool(stops) and move[unit] == (min(stops) if stops else was[unit])


def test_states_of_barriers_have_the_chances_asked_for():
    from chromaweave.operators.simulation import _Luck, _States

    rng = np.random.default_rng(4)
    kinds = [(0.7, 0.7), (0.999, 0.003), (1.0, 1.0), (0.0, 0.0), (1 / 3, 0.9), (0.5 / 256, 1 - 0.5 / 256), (1.0, 0.0)]
    each, keys = 200_000, np.zeros(1, np.uint64)
    on, off = (np.repeat([k[side] for k in kinds], each) for side in (0, 1))
    states = _States(np.tile([True, False], len(on) // 2), on, off)
    for epoch in range(3):
        was, keys[0] = states.active.copy(), epoch + 1
        states.step(rng.integers(0, 256, len(on), dtype=np.uint8), _Luck(keys, np.zeros(len(on), np.int64), np.zeros(1, np.int64), 0))
        for k, (a, b) in enumerate(kinds):
            now, old = (x[k * each : (k + 1) * each] for x in (states.active, was))
            for held, chance in ((now[old], a), (now[~old], 1 - b)):
                assert abs(held.sum() - len(held) * chance) <= 5 * (len(held) * chance * (1 - chance)) ** 0.5
