"""Settings, kept as a JSON file; unknown keys are ignored and a broken file means defaults."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields

from .schema import MODEL_ORDER

#: The roster's version, and the models that each newer version adds once to older files.
MODELS_VERSION = 4
ADDED = {3: ("m2dclap", "muq", "muqlan"), 4: ("lpmc", "qwen2audio")}


@dataclass
class Config:
    chunk_seconds: float = 20.0
    overlap_percent: float = 50.0
    models: list[str] = field(default_factory=lambda: [m for m in MODEL_ORDER if m != "mert330"])
    text_host: str = "http://127.0.0.1:11434"
    text_model: str | None = None
    use_text: bool = True
    similarity_method: str = "auto"
    playlist_length: int = 15
    fft_window_sec: float = 10.0
    tag_top_k: int = 5
    batch_size: int = 8
    tags: dict[str, list[str]] = field(default_factory=dict)
    skip_long: bool = False
    analyze_wav: bool = False
    models_version: int = MODELS_VERSION

    @classmethod
    def load(cls, path: str) -> Config:
        try:
            with open(path, encoding="utf-8") as f:
                raw = json.load(f)
        except (OSError, ValueError):
            return cls()
        if not isinstance(raw, dict):
            return cls()
        known = {f.name for f in fields(cls)}
        out = cls(**{k: v for k, v in raw.items() if k in known})
        had = raw.get("models_version", 0)
        if isinstance(out.models, list) and "models" in raw:
            for version in sorted(ADDED):
                if had < version:
                    out.models += [m for m in ADDED[version] if m not in out.models]
        out.models_version = MODELS_VERSION
        return out

    def save(self, path: str) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(f"{path}.tmp", "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=2)
        os.replace(f"{path}.tmp", path)

    def excluded_extensions(self) -> tuple[str, ...]:
        return () if self.analyze_wav else ("wav",)
