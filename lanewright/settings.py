"""Settings of the lane planner and the batch maps."""

from __future__ import annotations

from dataclasses import dataclass

EARTH_RADIUS_M = 6371000.0


@dataclass(frozen=True)
class Settings:
    """Defaults that results depend on."""

    lane_type_ids: tuple[int, ...] = (101,)
    temporary_type_id: int = 116
    use_temporary_lanes: bool = True
    connect_distance_m: float = 100.0  # inclusive
    snap_candidates: int = 5
    snap_penalty: float = 5.0
    jump_penalty: float = 10.0
    max_history_points: int = 5000
    max_lane_points: int = 100
    batch_task_points: int = 1200
    batch_lane_points: int = 300
    bbox_margin_deg: float = 0.01
    fit_padding_deg: float = 0.001


DEFAULT = Settings()
