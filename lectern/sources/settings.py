"""Settings from defaults, a YAML file, the environment and the caller, each over the one before."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

PREFIX = "LECTERN_"


@dataclass
class Settings:
    video_dir: str = "videos"
    output_dir: str = "output"
    merge_gap_ms: int = 1000
    most_window_ms: int = 300_000
    least_window_ms: int = 300
    batch_size: int = 10
    accept_confidence: float = 0.85
    force: bool = False
    llm_model: str | None = None

    @classmethod
    def load(cls, path: str | None = None, environment: dict[str, str] | None = None, **given: object) -> Settings:
        """Unknown names in the file or the call are errors; None in the call means not given."""
        import yaml

        kinds = {f.name: f.type for f in fields(cls)}
        values: dict[str, object] = {}
        if path:
            with open(path, encoding="utf-8") as f:
                values |= yaml.safe_load(f) or {}
        for name, text in (os.environ if environment is None else environment).items():
            if name.startswith(PREFIX) and (key := name[len(PREFIX) :].lower()) in kinds:
                kind = str(kinds[key])
                values[key] = text.lower() in ("1", "true", "yes") if kind == "bool" else int(text) if kind == "int" else float(text) if kind == "float" else text
        values |= {k: v for k, v in given.items() if v is not None}
        if unknown := set(values) - set(kinds):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**values)
