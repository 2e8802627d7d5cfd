"""Routing, equilibrium, estimation and scenarios on small networks with known answers."""

import dataclasses
import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import columns, estimation, loading, report, routing, scenario, simulate
from netloom.plans import assignment
from netloom.sources import derive


def corridors(spark, demand):
    """Two roads of two links from zone 1 to zone 2, of 20 and 30 minutes."""
    rows = [(13, 1, 3, 10.0, 4000.0), (32, 3, 2, 10.0, 4000.0), (14, 1, 4, 15.0, 3000.0), (42, 4, 2, 15.0, 3000.0)]
    links = spark.createDataFrame(rows, "link_id long, from_node_id long, to_node_id long, fftt double, capacity double")
    links = links.selectExpr("*", "1.0D AS lanes", "60.0D AS vf", "51.0D AS vc", "10.0D AS distance_km", "10000.0D AS length_m", "0.0D AS toll_auto", "CAST(NULL AS DOUBLE) AS ref_volume", "2000.0D AS spatial_capacity")
    modes = spark.createDataFrame([("auto", 0, 10.0, 1.0, 1.0)], "mode string, mode_no int, vot double, occupancy double, pce double")
    periods = spark.createDataFrame([("am", 0, 7.0, 8.0, 1.0)], "period string, period_no int, start_hour double, end_hour double, hours double")
    od = spark.createDataFrame([(1, 2, "auto", "am", float(demand))], "o long, d long, mode string, period string, volume double")
    return assignment.Inputs(links, modes, periods, od, 1.0)


def flows(pool):
    return [r.volume for r in pool.orderBy("path").collect()]


@pytest.mark.parametrize("demand, short, long, minutes", [(7000, 5447.853, 1552.147, 30.32245)])
def test_equilibrium_of_two_corridors(spark, demand, short, long, minutes):
    out = assignment.run(corridors(spark, demand), rounds=4, updates=25)
    assert flows(out.pool) == pytest.approx([short, long], abs=0.5)
    routes = report.route_measures(out.pool, out.performance).collect()
    assert [r.minutes for r in routes] == pytest.approx([minutes] * 2, abs=0.01)
    assert out.gap_percent < 0.01


def test_a_lag_of_one_round(spark):
    i = corridors(spark, 8000)
    assert flows(assignment.generate(i, 2, lag=1)) == [8000]
    pool = assignment.generate(i, 3, lag=1)
    assert flows(pool) == pytest.approx([5333.333, 2666.667], abs=1e-3)
    assert flows(assignment.update(i, pool, 11).pool) == pytest.approx([5628.2, 2371.8], abs=0.5)


def test_estimation_steps(spark):
    pool = spark.createDataFrame([(1, 2, "auto", "am", "a", [13, 32], 5447.853), (1, 2, "auto", "am", "b", [14, 42], 1552.147)], "o long, d long, mode string, period string, path string, link_seq array<long>, volume double")
    sensors = spark.createDataFrame([(14, 1000.0)], "link_id long, observed double")
    seen = []
    for n in range(3):
        pool = estimation.step(pool, estimation.deviations(pool, sensors), n)
        seen.append(flows(pool)[1])
    assert seen == pytest.approx([1396.9323, 1264.6215, 1198.4661], abs=1e-3)
    _, log = assignment.estimate(corridors(spark, 7000), pool, sensors, rounds=4)
    assert log[-1]["mae"] < log[0]["mae"]


def test_closures_and_diversion(spark):
    i = corridors(spark, 1000)
    rules = spark.createDataFrame([(1, 3, "lane_closure", 0.0, None), (1, 4, "dynamic_toll", None, 2.0), (4, 2, "dms", None, None)], "from_node_id long, to_node_id long, dtm_type string, final_lanes double, toll double")
    got = {r.link_id: r for r in scenario.managed(i.links, rules).collect()}
    assert got[13].closed and not got[32].closed and got[14].toll_auto == 2.0 and got[42].sign
    paths = spark.createDataFrame([(1, 2, "auto", "am", "x", 100.0, 40.0), (1, 2, "auto", "am", "y", 100.0, 21.0)], "o long, d long, mode string, period string, path string, volume double, minutes double")
    alternatives = spark.createDataFrame([(1, 2, "auto", "am", 20.0)], "o long, d long, mode string, period string, alt_minutes double")
    got = {r.path: r for r in scenario.diverted(paths, alternatives).collect()}
    assert got["x"].diverted == pytest.approx(100 / (1 + np.exp(-2))) and got["x"].uninformed == 100 and got["y"].uninformed == 0


def test_closures_move_the_informed_alone(spark):
    i = corridors(spark, 1000)
    pool = assignment.generate(i, 1)
    assert flows(pool) == [1000]
    closed = spark.createDataFrame([(32,)], "link_id long")
    moved = assignment.sensitivity(i, pool, closed, ["auto"], 6)
    assert flows(moved.pool)[1] > 900 and sum(flows(moved.pool)) == pytest.approx(1000)
    still = assignment.sensitivity(i, pool, closed, ["other"], 2)
    assert flows(still.pool) == [1000]
    with pytest.raises(ValueError):
        assignment.sensitivity(i, pool, closed, [])


def random_network(rng, nodes=30, links=120):
    made = {}
    for _ in range(links):
        a, b = rng.sample(range(nodes), 2)
        made[100 * a + b] = (a, b, rng.randrange(1, 6))
    return made


def test_trees_against_a_plain_search(spark):
    rng = random.Random(2)
    made = random_network(rng)
    rows = [(k, a, b, "auto", "am", c * 1000) for k, (a, b, c) in made.items()]
    costs = spark.createDataFrame(rows, "link_id long, from_node_id long, to_node_id long, mode string, period string, cost long")
    net = routing.network(costs)
    origins = spark.createDataFrame([(o, "auto", "am") for o in range(30)], "o long, mode string, period string")
    got = {(r.o, r.d): (r.cost, list(r.link_seq)) for r in routing.trees(origins, net).collect()}
    want = {}
    for o in range(30):
        heap, best = [(0, [], o)], {}
        while heap:
            cost, seq, at = heapq.heappop(heap)
            if at in best:
                continue
            best[at] = (cost, seq)
            for k, (a, b, c) in made.items():
                if a == at and b not in best:
                    heapq.heappush(heap, (cost + c * 1000, [*seq, k], b))
        want |= {(o, d): v for d, v in best.items() if d != o}
    assert got == want
    labels = {(r.o, r.node): r.cost for r in routing.labels_by_rounds(origins.where("o < 4"), costs, 9).collect() if r.o != r.node}
    assert labels == {k: v[0] for k, v in want.items() if k[0] < 4}


def test_turn_bans_and_reversed_trees(spark):
    rows = [(12, 1, 2, 1), (23, 2, 3, 1), (24, 2, 4, 5), (43, 4, 3, 1)]
    costs = spark.createDataFrame([(k, a, b, "auto", "am", c) for k, a, b, c in rows], "link_id long, from_node_id long, to_node_id long, mode string, period string, cost long")
    origins = spark.createDataFrame([(1, "auto", "am")], "o long, mode string, period string")
    banned = spark.createDataFrame([(12, 23)], "link_id long, next_link_id long")
    got = {r.d: (r.cost, list(r.link_seq)) for r in routing.trees(origins, routing.network(costs, banned=banned)).collect()}
    assert got[3] == (7, [12, 24, 43])
    net = routing.network(costs, reverse=True)
    label, link = routing.tree(net.star, net.costs["auto", "am"], net.star.index()[3])
    assert label[net.star.index()[1]] == 2
    assert routing.forward(net.star, link, net.star.index()[1]) == [12, 23]


@pytest.fixture(scope="module")
def sample(spark):
    i = assignment.sample_inputs(spark, "/root/testdata/sf0.001")
    return i, assignment.generate(i, 2)


def test_volumes_are_kept_and_flow_is_conserved(spark, sample):
    i, pool = sample
    cell = ["o", "d", "mode", "period"]
    both = pool.groupBy(*cell).agg(F.sum("volume").alias("p")).join(i.demand, cell, "full")
    assert both.where("p IS NULL OR volume IS NULL OR abs(p - volume) > 1e-6").count() == 0
    shifted = columns.shift(columns.with_costs(pool, assignment.link_costs(i, pool)), 0)
    again = shifted.groupBy(*cell).agg(F.sum("volume").alias("p")).join(i.demand, cell, "full")
    assert again.where("p IS NULL OR volume IS NULL OR abs(p - volume) > 1e-6").count() == 0
    assert shifted.where("volume < 0").count() == 0
    tallied = loading.volumes(loading.tally(pool, i.modes)).join(i.links, "link_id")
    out = tallied.groupBy(F.col("from_node_id").alias("n")).agg(F.sum("volume").alias("out"))
    into = tallied.groupBy(F.col("to_node_id").alias("n")).agg(F.sum("volume").alias("into"))
    made = i.demand.groupBy(F.col("o").alias("n")).agg(F.sum("volume").alias("made"))
    taken = i.demand.groupBy(F.col("d").alias("n")).agg(F.sum("volume").alias("taken"))
    met = out.join(into, "n", "full").join(made, "n", "full").join(taken, "n", "full").fillna(0.0)
    assert met.where("abs(into + made - out - taken) > 1e-6").count() == 0 and met.count() > 20


def test_gap_falls_with_updates(spark, sample):
    i, pool = sample
    before = columns.gap(columns.with_costs(pool, assignment.link_costs(i, pool))).first().gap_percent
    after = assignment.update(i, pool, 4).gap_percent
    assert 0 <= after < before


def test_simulation_keeps_vehicles(spark, sample):
    i, pool = sample
    cars = simulate.vehicles(pool, {"am": 420.0, "md": 720.0, "pm": 1020.0}).where("period = 'am'")
    events = simulate.simulate(cars, i.links)
    events = events.cache()
    trips = simulate.trips(events, i.links)
    assert trips.count() <= cars.count() and trips.where("done").count() > 0.5 * cars.count()
    wait = events.join(i.links, "link_id").where("departure_s - arrival_s < fftt * 60 - 1e-6")
    assert wait.count() == 0
    cum = simulate.cumulative(simulate.minute_counts(events).drop("period"), ["link_id"], 420, 500)
    assert cum.where("ca < cd").count() == 0
    order = events.selectExpr("agent_id", "k", "arrival_s", "lag(departure_s) OVER (PARTITION BY agent_id ORDER BY k) AS left_s")
    assert order.where("k > 0 AND left_s <> arrival_s").count() == 0
    assert simulate.trajectories(events).count() == trips.count()


def test_generator():
    got = simulate.lcg(3)
    first = 17364 * 101 % 65521
    assert got[0] == first / 65521 and got[1] == (17364 * first % 65521) / 65521


def test_message_signs_reroute_by_number(spark):
    cars = spark.createDataFrame([(k, 1, 2, "auto", "am", [1, 2], 25200.0 + k) for k in range(200)], "agent_id long, o long, d long, mode string, period string, link_seq array<long>, departure_s double")
    alternatives = spark.createDataFrame([(1, 2, "auto", "am", [3])], "o long, d long, mode string, period string, alt_seq array<long>")
    got = simulate.rerouted(cars, alternatives, 421.0, 50).where("rerouted")
    assert {r.agent_id for r in got.collect()} == {k for k in range(60, 200) if k % 100 < 50}


def one_road(spark, cars, **columns):
    links = {"link_id": 1, "to_node_id": 2, "fftt": 1.0, "capacity": 3600.0, "lanes": 1.0, "spatial_capacity": 100.0, "distance_km": 1.0} | columns
    rows = [tuple(links.values()), *(tuple((links | {"link_id": k, "to_node_id": k + 1}).values()) for k in (2, 3))]
    net = spark.createDataFrame(rows, list(links))
    table = spark.createDataFrame([("am", i, route, float(t)) for i, (route, t) in enumerate(cars)], "period string, agent_id long, link_seq array<long>, departure_s double")
    return table, net


def test_vehicles_leave_one_a_second_after_their_free_flow_time(spark):
    cars, net = one_road(spark, [([1], 0.0)] * 5)
    got = sorted((r.agent_id, r.arrival_s, r.departure_s) for r in simulate.simulate(cars, net, step_s=1.0).collect())
    assert got == [(i, 0.0, 60.0 + i) for i in range(5)]
    waits = simulate.minute_waits(simulate.simulate(cars, net, step_s=1.0), net).first()
    assert waits.vehicles == 5 and waits.wait_min == pytest.approx(sum(r[2] - 60 for r in got) / 60)


def test_a_signal_lets_vehicles_out_in_green_alone(spark):
    cars, net = one_road(spark, [([1], 0.0)] * 8, cycle_s=40.0, green_s=10.0, green_len_s=10.0)
    out = sorted(r.departure_s for r in simulate.simulate(cars, net, step_s=1.0).collect())
    assert all(10 <= t % 40 < 20 for t in out) and out[0] in (90.0, 91.0)
    assert max(sum(a <= t < a + 40 for t in out) for a in range(80, 300, 40)) <= 6  # a vehicle every other second of ten


def test_a_sign_sends_its_share_another_way(spark):
    cars, net = one_road(spark, [([1, 2], 0.0)] * 10)
    detours = spark.createDataFrame([(1, 2, [3], 4)], "link_id long, last_link long, rest array<long>, rate int")
    got = {}
    for r in simulate.simulate(cars, net, step_s=1.0, detours=detours).collect():
        got.setdefault(r.agent_id, []).append((r.k, r.link_id))
    assert {i: [x for _, x in sorted(v)] for i, v in got.items()} == {i: [1, 3] if i < 4 else [1, 2] for i in range(10)}


def test_new_paths_make_their_links_dearer_for_those_who_follow(spark):
    i = corridors(spark, 1000)
    i = dataclasses.replace(i, demand=i.demand.union(spark.createDataFrame([(3, 2, "auto", "am", 5.0)], i.demand.schema)))
    pool = assignment.generate(i, 1)
    closed = spark.createDataFrame([(99,)], "link_id long")
    for turns in (1, 2, 7):
        again = assignment.regenerate(i, pool, closed, ["auto"], turns)
        assert {tuple(r.link_seq) for r in again.collect()} >= {(13, 32), (32,)} and sum(r.volume for r in again.collect()) == pytest.approx(1005)


def test_a_bound_on_what_a_path_gives(spark):
    rows = [(1, 2, "auto", "am", "a", [1], 60.0, 10_000_000), (1, 2, "auto", "am", "b", [2], 40.0, 20_000_000)]
    costed = spark.createDataFrame(rows, "o long, d long, mode string, period string, path string, link_seq array<long>, volume double, cost long")
    free = 0.5 / 7 * 100 * 2 / 2  # half of the cost is excess: 1 / (5 + 2) * 0.5 * 100
    assert flows(columns.shift(costed, 5)) == pytest.approx([60 + free, 40 - free])
    assert flows(columns.shift(costed, 5, bound=2.0)) == pytest.approx([62, 38])
    assert flows(columns.shift(costed, 4, bound=2.0)) == pytest.approx([60 + 100 / 12, 40 - 100 / 12])
