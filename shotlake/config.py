"""Settings: a nested dictionary of defaults under what a JSON file says."""

from __future__ import annotations

import copy
import json
from pathlib import Path
from typing import Any

#: Defaults of the data model.
DEFAULTS: dict[str, Any] = {
    "segmentation": {"enabled": True, "min_segment_sec": 1.0, "max_segment_sec": 15.0, "max_split_iterations": 5, "sensitivity": "medium", "min_scene_len_sec": 0.5, "long_shot_subdetect": True, "long_shot_subdetect_sensitivity": "high"},
    "frame_quality": {"black_mean": 15, "black_std": 10, "white_mean": 240, "white_std": 10, "low_info_std": 8},
    "trim": {"trim_tolerance_frames": 2, "min_valid_frames": 2, "invalid_black_ratio": 0.9},
    "sampling": {"k_short": 7, "k_normal": 10, "k_long": 14},
    "reference": {"grid_rows": 3, "grid_cols": 3, "select_tolerance_ms": 50.0},
    "asr": {"language": "auto", "cam_threshold": 0.30, "eres_threshold": 0.55, "cluster_threshold": 0.55, "merge_gap_sec": 0.8},
    "persons": {"enabled": True, "fps_target": 1.0, "candidates_per_window": 5, "high": 0.45, "low": 0.35, "dedup": 0.92, "max_per_person": 300},
    "describe": {"enabled": True, "mode": "storyboard", "fps": 2.0, "limit": 0},
}


def merged(base: dict, over: dict) -> dict:
    """base with over laid on it, dictionary by dictionary; neither is changed."""
    out = copy.deepcopy(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


def load(path: str | None = None) -> dict:
    """DEFAULTS under the file's settings; DEFAULTS alone if there is no readable one."""
    try:
        over = json.loads(Path(path).read_text("utf-8")) if path else {}
    except (OSError, ValueError):
        over = {}
    return merged(DEFAULTS, over if isinstance(over, dict) else {})
