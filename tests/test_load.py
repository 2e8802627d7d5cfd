"""A run from files: two corridors, with estimation, and with a subarea."""

import pytest

from netloom.plans import load

SETTINGS = """
assignment: {number_of_iterations: 3, number_of_column_updating_iterations: 8, number_of_odme_iterations: 6, UE_convergence_percentage: 0.001, odme_activate: ODME}
unit: {length_unit: meter, speed_unit: kmph}
mode_types: [{mode_type: auto, vot: 10}]
demand_periods: [{period: am, demand_period_id: 1, time_period: '0700_0800'}]
link_types: [{link_type: 1}, {link_type: 2}]
demand_files: [{file_sequence_no: 1, file_name: demand.csv, demand_period: am, mode_type: auto}]
"""


def folder(tmp_path, odme=0, more=""):
    (tmp_path / "settings.yml").write_text(SETTINGS.replace("ODME", str(odme)) + more)
    (tmp_path / "node.csv").write_text("node_id,x_coord,y_coord,zone_id\n1,0,0,1\n2,4,0,2\n3,2,1,0\n4,2,-1,0\n")
    (tmp_path / "link.csv").write_text("link_id,from_node_id,to_node_id,link_type,length,lanes,free_speed,capacity,ref_volume\n1,1,3,1,10000,1,60,4000,\n2,3,2,1,10000,1,60,4000,\n3,1,4,2,15000,1,60,3000,1000\n4,4,2,2,15000,1,60,3000,\n")
    (tmp_path / "demand.csv").write_text("o_zone_id,d_zone_id,volume\n1,1,5\n1,2,7000\n2,1,0\n9,1,3\n")
    return str(tmp_path)


def test_equilibrium(spark, tmp_path):
    result = load.run(spark, folder(tmp_path), str(tmp_path / "out"))
    flows = sorted(r.volume for r in result.pool.collect())
    assert flows == pytest.approx([1552.147, 5447.853], abs=60)
    links = spark.read.parquet(str(tmp_path / "out" / "link_performance"))
    assert links.count() == 4 and links.where("volume > 5300").count() == 2
    assert spark.read.parquet(str(tmp_path / "out" / "od_performance")).first().volume == pytest.approx(7000)


def test_estimation(spark, tmp_path):
    result = load.run(spark, folder(tmp_path, 1))
    flows = sorted(r.volume for r in result.pool.collect())
    assert flows[0] == pytest.approx(1150, abs=120) and flows[1] > 5000


def test_subarea_keeps_what_passes_it(spark, tmp_path):
    more = "subarea_analysis: [{activate: 1, subarea_geometry: 'POLYGON((1.5 -0.5, 2.5 -0.5, 2.5 0.5, 1.5 0.5, 1.5 -0.5))'}]\n"
    inputs, _, cfg = load.load(spark, folder(tmp_path, 0, more))
    assert cfg.subarea and [r.volume for r in inputs.demand.collect()] == [7000]
    away = more.replace("-0.5", "7.5").replace("0.5", "8.5")
    inputs, _, _ = load.load(spark, folder(tmp_path, 0, away))
    assert inputs.demand.count() == 0


TWO_MODES = """
assignment: {number_of_iterations: 2, number_of_column_updating_iterations: 0, simulation_output: 0}
unit: {length_unit: meter, speed_unit: kmph}
mode_types: [{mode_type: auto, vot: 10, DTM_real_time_info_type: 1}, {mode_type: truck, vot: 10}]
demand_periods: [{period: am, demand_period_id: 1, time_period: '0700_0800'}]
link_types: [{link_type: 1, allowed_uses_p1: 'auto'}, {link_type: 2}]
demand_files: [{file_sequence_no: 1, file_name: a.csv, demand_period: am, mode_type: auto}, {file_sequence_no: 2, file_name: t.csv, demand_period: am, mode_type: truck}]
"""
NODES = "node_id,x_coord,y_coord,zone_id\n1,0,0,1\n2,4,0,2\n3,2,1,0\n4,2,-1,0\n"
LINKS = "link_id,from_node_id,to_node_id,link_type,length,lanes,free_speed,capacity\n1,1,3,1,10000,1,60,4000\n2,3,2,1,10000,1,60,4000\n3,1,4,2,15000,1,60,4000\n4,4,2,2,15000,1,60,4000\n"


def made(tmp_path, settings=TWO_MODES, nodes=NODES, links=LINKS, **files):
    for name, text in {"settings.yml": settings, "node.csv": nodes, "link.csv": links, "a.csv": "o_zone_id,d_zone_id,volume\n1,2,100\n", "t.csv": "o_zone_id,d_zone_id,volume\n1,2,50\n", **{k.replace("_csv", ".csv"): v for k, v in files.items()}}.items():
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def used(result):
    return {(r.mode, tuple(r.link_seq)): round(r.volume, 6) for r in result.pool.collect() if r.volume > 1e-9}


def test_links_closed_to_a_mode(spark, tmp_path):
    result = load.run(spark, made(tmp_path))
    assert used(result) == {("auto", (1, 2)): 100, ("truck", (3, 4)): 50}
    assert {(r.o, r.d) for r in result.pool.collect()} == {(1, 2)}


def test_tolls_and_penalties_by_mode(spark, tmp_path):
    # 20 minutes on 1, 2 and 30 on 3, 4: two at a value of time of 10 an hour are 12 minutes, so each mode leaves what it pays for
    links = LINKS.replace("capacity\n", "capacity,toll_auto,penalty_truck\n").replace(",4000\n", ",4000,0,0\n").replace("2,3,2,1,10000,1,60,4000,0,0", "2,3,2,2,10000,1,60,4000,2,9").replace("1,1,3,1", "1,1,3,2")
    assert used(load.run(spark, made(tmp_path, links=links))) == {("auto", (3, 4)): 100, ("truck", (1, 2)): 50}
    links = links.replace(",2,9", ",1,11")
    assert used(load.run(spark, made(tmp_path, links=links))) == {("auto", (1, 2)): 100, ("truck", (3, 4)): 50}


def test_zone_of_several_nodes(spark, tmp_path):
    nodes = NODES.replace("4,2,-1,0", "4,2,-1,1")  # a trip from zone 1 may begin at node 4: 15 minutes, against 20
    result = load.run(spark, made(tmp_path, nodes=nodes), str(tmp_path / "out"))
    assert used(result) == {("auto", (4,)): 100, ("truck", (4,)): 50}
    assert {r.node_sequence for r in spark.read.parquet(str(tmp_path / "out" / "route_assignment")).collect()} == {"4;2"}


def test_turn_ban_of_the_first_mode(spark, tmp_path):
    links = LINKS.replace("capacity\n", "capacity,restricted_turn_nodes\n").replace(",4000\n", ",4000,\n").replace("1,1,3,1,10000,1,60,4000,", "1,1,3,2,10000,1,60,4000,2").replace("2,3,2,1", "2,3,2,2")
    assert used(load.run(spark, made(tmp_path, links=links))) == {("auto", (3, 4)): 100, ("truck", (1, 2)): 50}


def test_queue_based_run_with_parameters_of_a_link(spark, tmp_path):
    links = LINKS.replace(",4000", ",100").replace(",1,10000", ",2,10000")
    qvdf = "data_type,vdf_code,from_node_id,to_node_id,QVDF_alpha1,QVDF_beta1,QVDF_cd1,QVDF_n1,QVDF_cp1,QVDF_s1\nvdf_code,all,,,0.5,1,1,1,0.3,4\nlink,,4,2,1.0,1,1,1,0.3,4\n"
    result = load.run(spark, made(tmp_path, links=links, link_qvdf_csv=qvdf, t_csv="o_zone_id,d_zone_id,volume\n"))
    # round 1 puts 100 on 1, 2: doc 1, speed 0.85 * 60 / 1.5 = 34, time 10 * 60 / 34 each, 35.3 in all against 30: half goes to 3, 4
    assert used(result) == {("auto", (1, 2)): 50, ("auto", (3, 4)): 50}
    minutes = {r.link_id: r.minutes for r in result.performance.collect()}
    # doc 0.5: 60 / (1 + (1.5 * 60 / 51 - 1) * 0.5 ** 4) km/h, with 2 in place of 1.5 on link 4
    assert minutes[1] == pytest.approx(10 * (1 + (1.5 * 60 / 51 - 1) * 0.0625)) and minutes[4] == pytest.approx(15 * (1 + (2 * 60 / 51 - 1) * 0.0625))


def test_preloaded_routes_take_the_place_of_demand(spark, tmp_path):
    routes = "o_zone_id,d_zone_id,volume,node_sequence\n1,2,70,1;4;2\n1,2,9,1;2\n"
    result = load.run(spark, made(tmp_path, route_csv=routes))
    assert used(result) == {("auto", (3, 4)): 70}
    assert {r.link_id: r.volume for r in result.performance.collect()} == {1: 0, 2: 0, 3: 70, 4: 70}


def test_demand_is_made_up_where_there_is_none(spark, tmp_path):
    inputs, _, _ = load.load(spark, made(tmp_path, TWO_MODES.split("demand_files")[0], nodes=NODES.replace("4,0,2", "0.1,0,2")))
    assert {(r.o, r.d): r.volume for r in inputs.demand.collect()} == {(-1, -2): 10, (-2, -1): 10}


def test_closure_and_simulation_from_settings(spark, tmp_path):
    more = TWO_MODES.replace("simulation_output: 0", "simulation_output: 1, number_of_sensitivity_analysis_iterations: 4").replace("'auto'}", "''}") + "dynamic_traffic_management_data: [{dtm_id: 1, dtm_type: lane_closure, from_node_id: 3, to_node_id: 2, final_lanes: 0, activate: 1}]\n"
    result = load.run(spark, made(tmp_path, more), str(tmp_path / "out"))
    flows = used(result)
    assert flows["auto", (3, 4)] > 80 and flows["truck", (1, 2)] == 50  # trucks are not told
    table = lambda name: spark.read.parquet(str(tmp_path / "out" / name)).collect()
    change = {r.link_id: r.change for r in table("link_before_after")}
    assert change[4] == pytest.approx(flows["auto", (3, 4)]) and change[2] == pytest.approx(-flows["auto", (3, 4)])
    assert sum(r.path_impacted for r in table("impacted_routes")) == 2
    trips = table("trips")
    assert len(trips) == 150 and len(table("link_minutes")) and len(table("trajectories")) == 150
