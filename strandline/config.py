"""Settings of an import, with their defaults."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class Settings:
    target_folder: str = "AI Chats"
    naming_template: str = "{{topic}}"
    tag_prefix: str = "ai-chat"
    folder_structure: str = "nested"  # or flat
    granularity: str = "medium"
    speaker_style: str = "callouts"  # blockquotes, bold, plain
    show_timestamps: bool = False
    collapse_threshold: int = 800
    keep_full_transcript: bool = False
    custom_frontmatter: str = ""
    date: str = "1970-01-01"  # stands for "now" where a conversation has no date, so results repeat
    imported: str = "1970-01-01T00:00:00.000Z"

    def __post_init__(self) -> None:
        for name, allowed in (("folder_structure", ("nested", "flat")), ("speaker_style", ("callouts", "blockquotes", "bold", "plain")), ("granularity", ("coarse", "medium", "fine"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def loads(cls, text: str | None) -> Settings:
        """Saved values over the defaults; unknown names are ignored."""
        saved = json.loads(text) if text else {}
        return replace(cls(), **{k: v for k, v in saved.items() if k in cls.__dataclass_fields__})
