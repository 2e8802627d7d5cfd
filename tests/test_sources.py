"""Files: settings, networks, demand in text and binary, routes, parameters, sinks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.functions import scalar
from netloom.operators import space, subarea
from netloom.sources import readers, settings, sinks

YAML = """
assignment: {number_of_iterations: 5, route_output: 1, simulation_output: 0, UE_convergence_percentage: 0.001, odme_activate: 0, number_of_cpu_processors: 6}
unit: {length_unit: mile, speed_unit: mph}
mode_types:
  - {mode_type: auto, vot: 10, person_occupancy: 1, pce: 1, DTM_real_time_info_type: 1}
  - {mode_type: truck, vot: 10, pce: 2}
demand_periods:
  - {period: AM, demand_period_id: 1, time_period: '0700_0800'}
link_types:
  - {link_type: 1, link_type_name: road, k_jam_km: 150, allowed_uses_p1: 'auto;truck', emissions_auto_co2: '1;2;3;4'}
  - {link_type: 1, link_type_name: twice}
demand_files:
  - {file_sequence_no: 2, file_name: b.csv, demand_period: am, mode_type: truck, scale_factor: 0.5}
  - {file_sequence_no: 1, file_name: a.csv, demand_period: am, mode_type: auto}
  - {file_sequence_no: 3, file_name: c.csv, demand_period: am, mode_type: auto, scale_factor: 0}
  - {file_sequence_no: 4, file_name: d.csv, demand_period: night, mode_type: auto}
departure_time_profile:
  - {departure_time_profile_no: 1, time_period: '0700_0710', T0700: 0.5, T0425: 0.25}
dynamic_traffic_management_data:
  - {activate: 1, dtm_id: 1, dtm_type: lane_closure, from_node_id: 1, to_node_id: 2, final_lanes: 0}
  - {activate: 0, dtm_id: 2, dtm_type: dms, from_node_id: 1, to_node_id: 2}
subarea: [{activate: 1, subarea_geometry: 'POLYGON((0 0,1 0,1 1,0 0))'}]
"""


def test_settings():
    s = settings.parse(YAML)
    assert (s.iterations, s.gap_percent, s.processors, s.length_unit) == (5, 0.001, 6, "mile")
    assert [m.vot for m in s.mode_types] == [10, 10] and s.periods[0].period == "am" and s.periods[0].end_hour == 8
    assert len(s.link_types) == 1 and s.link_types[0].emissions == {"emissions_auto_co2": [1, 2, 3, 4]}
    assert [f.file_name for f in s.demand_files] == ["a.csv", "b.csv"]
    assert s.profiles[1] == {84: 0.5, 85: 0.25, 86: 1.0}
    assert len(s.management) == 1 and s.subarea.startswith("POLYGON")
    with pytest.raises(ValueError):
        settings.parse(YAML.replace("DTM_real_time_info_type: 1", "DTM_real_time_info_type: 0"))
    assert settings.parse("") == settings.Settings()
    assert settings.key_values([(" a ", "1"), ("a", " 2 ")]) == {"a": "2"}


def test_network_files(spark, tmp_path):
    (tmp_path / "node.csv").write_text("﻿ node_id ,x_coord,y_coord,zone_id,name\n1,0,0,1,\"a, b\"\n2,0,1,2,\n3,1,1,0,\n3,2,2,0,\n")
    (tmp_path / "link.csv").write_text("from_node_id,to_node_id,link_type,length,lanes,free_speed,capacity,dir_flag,toll_auto\n1,2,1,15,2,60,1800,1,0.5\n2,3,1,1,1,60,1800,2,\n3,1,1,,1,,1800,-1,\n1,9,1,1,1,60,1,1,\n1,2,7,1,1,60,1,1,\n")
    cfg = settings.parse(YAML)
    nodes = readers.read_nodes(spark, str(tmp_path / "node.csv"))
    assert {(r.node_id, r.x, r.zone_id) for r in nodes.collect()} == {(1, 0, 1), (2, 0, 2), (3, 1, None)}
    got = {(r.from_node_id, r.to_node_id): r for r in readers.read_links(spark, str(tmp_path / "link.csv"), nodes, cfg).collect()}
    assert set(got) == {(1, 2), (2, 3), (3, 2), (1, 3)}
    first = got[1, 2]
    assert (first.distance_km, first.vf, first.fftt) == pytest.approx((24.135, 96.54, 15.0))
    assert first.spatial_capacity == pytest.approx(24.135 * 2 * 150) and first.toll_auto == 0.5 and first.penalty_truck == 0
    assert got[1, 3].length_m == 1 and got[1, 3].vc == pytest.approx(0.85 * 100 * 1.609)
    (tmp_path / "bad.csv").write_text("x_coord\n1\n")
    with pytest.raises(readers.MissingColumn):
        readers.read_nodes(spark, str(tmp_path / "bad.csv"))


def test_demand_files(spark, tmp_path):
    (tmp_path / "demand.csv").write_text("o_zone_id,d_zone_id,volume\n1,2,10\n1,,5\n2,1,-100\n2,1,\n")
    rows = readers.read_demand(spark, str(tmp_path / "demand.csv"), "auto", "am", 0.5).collect()
    assert {(r.o, r.d, r.volume) for r in rows} == {(1, 2, 5.0), (2, 1, 0.0)}
    records = np.array([(1, 2, 0, 1, 3.5), (2, 1, 1, 0, 4.5)], readers.DEMAND_RECORD)
    assert records.dtype.itemsize == 24
    (tmp_path / "demand.bin").write_bytes(records.tobytes() + b"xx")
    got = readers.read_demand_binary(spark, str(tmp_path / "demand.bin"))
    assert {tuple(r) for r in got.collect()} == {(1, 2, 0, 1, 3.5), (2, 1, 1, 0, 4.5)}
    assert {tuple(r) for r in readers.unpack_demand(readers.pack_demand(got)).collect()} == {tuple(r) for r in got.collect()}


def test_sections(spark, tmp_path):
    (tmp_path / "s.csv").write_text("[a]\nk,v\n1, 2\n\n[b]\nx\n")
    got = [(r.section, r.cells) for r in readers.read_sections(spark, str(tmp_path / "s.csv")).orderBy("row").collect()]
    assert got == [("a", ["k", "v"]), ("a", ["1", "2"]), ("b", ["x"])]


def test_routes_and_chains(spark):
    links = spark.createDataFrame([(12, 1, 2), (23, 2, 3)], "link_id long, from_node_id long, to_node_id long")
    raw = spark.createDataFrame([("a", 1, 3, 10.0, "1;2;3"), ("b", 1, 3, 10.0, "1;3"), ("c", 1, 1, 1.0, "1")], "path_id string, o long, d long, volume double, node_sequence string")
    assert [(r.path_id, r.volume, r.link_seq) for r in readers.routes(raw, links, 0.1).collect()] == [("a", 1.0, [12, 23])]
    choices = spark.createDataFrame([("1;2;1", 4.0), ("1;2", 1.0), ("5", 9.0)], "zone_chain string, volume double")
    assert {tuple(r) for r in readers.choice_demand(choices).collect()} == {(1, 2, 5.0), (2, 1, 4.0)}


def test_subarea_and_hulls(spark):
    square = spark.createDataFrame([("POLYGON((0 0, 4 0, 4 4, 0 4))",)], "wkt string").select(scalar.wkt_points(F.col("wkt")).alias("points"))
    sides = space.polygon_segments(square)
    assert sides.count() == 4
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 1.0), (3, 2.0, 3.9), (4, -1.0, 2.0)], "zone_id long, x double, y double")
    assert {r.zone_id for r in space.inside(points, sides, ["zone_id"]).where("inside").collect()} == {1, 3}
    many = spark.createDataFrame([(k % 2, float(k % 7), float(k * k % 11)) for k in range(200)], "g long, x double, y double")
    got = {r.g: r.wkt for r in space.hulls(many, "g").collect()}
    for g in (0, 1):
        ring = space.hull([(float(k % 7), float(k * k % 11)) for k in range(200) if k % 2 == g])
        assert got[g] == "POLYGON((" + ", ".join(f"{x:.6f} {y:.6f}" for x, y in [*ring, ring[0]]) + "))"
    assert space.hull([(0, 0), (2, 0), (1, 0), (2, 2), (1, 1)]) == [(0, 0), (2, 0), (2, 2)]
    zones = spark.createDataFrame([(k, k / 10, 0.0) for k in range(20)], "zone_id long, x double, y double")
    assert subarea.super_zones(zones, 30, space.nearest).where("zone_id <> seed").count() == 0
    few = subarea.super_zones(zones, 5, space.nearest)
    assert few.count() == 20 and few.select("seed").distinct().count() <= 5


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], {"a": 1.5})], "k long, s array<long>, m map<string,double>")
    sinks.write(df, str(tmp_path / "out"), "csv")
    row = spark.read.csv(str(tmp_path / "out"), header=True).first()
    assert (row.k, row.s, row.m) == ("1", "1;2", "a:1.5")
    events = spark.createDataFrame([(7, 0, 12, 1.0, None), (7, 1, 23, 2.0, 3.0)], "agent_id long, k int, link_id long, arrival_s double, departure_s double")
    raw = b"".join(bytes(r.part) for r in sinks.pack_steps(events).collect())
    got = np.frombuffer(raw, sinks.STEP)
    assert sorted(got["k"].tolist()) == [0, 1] and np.isnan(got["departure_s"][got["k"] == 0][0])
