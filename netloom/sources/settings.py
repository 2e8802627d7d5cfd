"""Settings of a run: a YAML file with sections, read into dataclasses and checked."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

import yaml


@dataclass(frozen=True)
class Mode:
    mode_type: str
    vot: float = 20.0
    person_occupancy: float = 1.0
    pce: float = 1.0
    desired_speed_ratio: float = 1.0
    time_headway_in_sec: float = 1.0
    real_time_info_type: int = 0


@dataclass(frozen=True)
class Period:
    period: str
    demand_period_id: int
    start_hour: float
    end_hour: float


@dataclass(frozen=True)
class LinkType:
    link_type: int
    link_type_name: str = ""
    type_code: str = ""
    traffic_flow_model: str = "point_queue"
    k_jam: float = 200.0
    allowed_uses: dict[int, str] = field(default_factory=dict)  #: by demand_period_id
    emissions: dict[str, list[float]] = field(default_factory=dict)


@dataclass(frozen=True)
class DemandFile:
    file_name: str
    demand_period: str
    mode_type: str
    format_type: str = "column"
    scale_factor: float = 1.0
    departure_time_profile_no: int = 1


@dataclass(frozen=True)
class Management:
    dtm_id: int
    dtm_type: str
    from_node_id: int
    to_node_id: int
    final_lanes: float
    demand_period: str = ""
    mode_type: str = ""
    toll: float = 0.0


@dataclass(frozen=True)
class Settings:
    iterations: int = 20
    updates: int = 40
    gap_percent: float = 0.1
    odme: bool = False
    odme_iterations: int = 50
    route_output: bool = True
    simulation: bool = False
    processors: int = 4
    length_unit: str = "meter"
    speed_unit: str = "kmph"
    mode_types: tuple[Mode, ...] = (Mode("auto"),)
    periods: tuple[Period, ...] = (Period("am", 1, 7.0, 8.0),)
    link_types: tuple[LinkType, ...] = ()
    demand_files: tuple[DemandFile, ...] = ()
    management: tuple[Management, ...] = ()
    profiles: dict[int, dict[int, float]] = field(default_factory=dict)
    subarea: str = ""
    max_super_zones: int = 100
    scenario_iterations: int = 20  #: shifts after a closure


def _minutes(code: str) -> float:
    digits = code.strip()
    days = int(digits[:2]) if len(digits) == 6 else 0
    return days * 1440 + int(digits[-4:-2]) * 60 + int(digits[-2:])


def profile_slots(row: dict) -> dict[int, float]:
    """Ratio of each 5-minute slot in the row's period, 1 where it names none; keys are ``T`` and HHMM or minutes of the day."""
    start, end = (_minutes(x) for x in str(row["time_period"]).split("_"))
    out = {}
    for slot in range(int(start) // 5, int(end) // 5 + 1):
        minute = slot * 5
        named = [row.get(f"T{minute // 60:02d}{minute % 60:02d}"), row.get(f"T{minute:04d}")]
        out[slot] = float(next((x for x in named if x is not None), 1.0))
    return out


def parse(text: str) -> Settings:
    """Settings of YAML text; both places of ``number_of_cpu_processors`` and both names of the subarea section are taken."""
    data = yaml.safe_load(text) or {}
    run, unit = data.get("assignment") or {}, data.get("unit") or {}
    area = next(iter(data.get("subarea_analysis") or data.get("subarea") or []), {}) if isinstance(data.get("subarea_analysis") or data.get("subarea"), list) else (data.get("subarea_analysis") or data.get("subarea") or {})
    periods = []
    for row in data.get("demand_periods") or []:
        start, end = (_minutes(x) for x in str(row["time_period"]).split("_"))
        periods.append(Period(str(row["period"]).lower(), int(row["demand_period_id"]), start / 60, end / 60))
    modes = [Mode(str(r["mode_type"]), float(r.get("vot", 20)), float(r.get("person_occupancy", 1)), float(r.get("pce", 1)), float(r.get("desired_speed_ratio", 1)), float(r.get("time_headway_in_sec", 1)), int(r.get("DTM_real_time_info_type", 0))) for r in data.get("mode_types") or []]
    kinds, seen = [], set()
    for r in data.get("link_types") or []:
        if int(r["link_type"]) in seen:
            continue
        seen.add(int(r["link_type"]))
        emitted = {k: [float(x) for x in str(v).split(";") if x.strip()] for k, v in r.items() if str(k).startswith("emissions_")}
        kinds.append(LinkType(int(r["link_type"]), str(r.get("link_type_name", "")), str(r.get("type_code", "")), str(r.get("traffic_flow_model", "point_queue")), float(r.get("k_jam_km", 200)), {int(k.removeprefix("allowed_uses_p")): str(v or "") for k, v in r.items() if str(k).removeprefix("allowed_uses_p").isdigit()}, emitted))
    files = [DemandFile(str(r["file_name"]), str(r["demand_period"]).lower(), str(r["mode_type"]), str(r.get("format_type", "column")), float(r.get("scale_factor", 1)), int(r.get("departure_time_profile_no", 1))) for r in sorted(data.get("demand_files") or [], key=lambda r: r.get("file_sequence_no", 0))]
    managed = [Management(int(r["dtm_id"]), str(r["dtm_type"]), int(r["from_node_id"]), int(r["to_node_id"]), float(r.get("final_lanes", 0)), str(r.get("demand_period", "")).lower(), str(r.get("mode_type", "")), float(r.get("toll", 0) or 0)) for r in data.get("dynamic_traffic_management_data") or [] if int(r.get("activate", 0)) == 1]
    known = {p.period for p in periods}
    files = [f for f in files if f.scale_factor >= 1e-4 and f.format_type != "null" and (not known or f.demand_period in known)]
    if any(m.dtm_type == "lane_closure" for m in managed) and not any(m.real_time_info_type for m in modes):
        raise ValueError("a lane closure needs a mode with real-time information")
    return Settings(
        int(run.get("number_of_iterations", 20)), int(run.get("number_of_column_updating_iterations", 40)), float(run.get("UE_convergence_percentage", 0.1)), bool(int(run.get("odme_activate", 0))), int(run.get("number_of_odme_iterations", 50)), bool(int(run.get("route_output", 1))), bool(int(run.get("simulation_output", 0))),
        int((data.get("cpu") or {}).get("number_of_cpu_processors", run.get("number_of_cpu_processors", 4))), str(unit.get("length_unit", "meter")), str(unit.get("speed_unit", "kmph")), tuple(modes) or (Mode("auto"),), tuple(periods) or (Period("am", 1, 7.0, 8.0),),
        tuple(kinds), tuple(files), tuple(managed), {int(r["departure_time_profile_no"]): profile_slots(r) for r in data.get("departure_time_profile") or []},
        str(area.get("subarea_geometry", "")) if int(area.get("activate", 0)) == 1 else "", int(area.get("max_number_of_super_zones", 100)), int(run.get("number_of_sensitivity_analysis_iterations", 20)),
    )


def read(path: str) -> Settings:
    """Settings of a file, or the defaults where there is none."""
    file = Path(path)
    return parse(file.read_text(encoding="utf-8-sig")) if file.exists() else Settings()


def key_values(rows: list[tuple[str, str]]) -> dict[str, str]:
    """A two-column settings table as a dictionary; of repeated keys the last counts."""
    return {k.strip(): v.strip() for k, v in rows}
