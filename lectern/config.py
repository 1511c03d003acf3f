"""Job settings. A plain frozen dataclass replaces an application's preference store."""
from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class JobConfig:
    endpoint: str = "https://models.example/v1/chat/completions"
    model: str = "default-model"
    language: str = "zh"
    max_input_chars: int = 100_000
    timeout_ms: int = 600_000
    highlight_count: int = 0          # 0 = range chosen from the length sent
    owner_tag: str = "lectern"        # tag that proves an annotation is ours
    export_tag: str = "lectern-export"  # tag on exported copies, never analysed again
    mark_prefix: str = "[LN·"         # comment prefix of our annotations
    store_capacity: int = 500
    guide_title: str = "导读"
