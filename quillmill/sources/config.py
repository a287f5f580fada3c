"""Typed settings: defaults, overridden by a YAML-like file, overridden by arguments."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path

# Keys of earlier versions, which are read and ignored.
IGNORED = (
    "preprocessing_enabled", "preprocessing_mode",
    "save_history", "history_db_path", "max_history_items",
    "show_confidence_overlay", "context_aware_detection", "num_threads",
)


@dataclass(frozen=True)
class Config:
    hotkey: str = "<ctrl>+<alt>+t"
    display_server: str = "auto"
    ocr_engine: str = "ensemble"
    ocr_model_path: str | None = None
    ocr_language: str = "eng"
    ocr_confidence_threshold: float = 0.6
    adaptive_ensemble: bool = True
    max_image_size: int = 4096
    use_gpu: bool = True
    notification_enabled: bool = True
    enable_text_correction: bool = True
    aggressive_correction: bool = False

    @classmethod
    def load(cls, path: str | Path, ignored: tuple[str, ...] = IGNORED, **overrides) -> Config:
        """A missing file is created with the defaults; an unknown key raises TypeError."""
        path = Path(path).expanduser()
        if not path.exists():
            cls().save(path)
        given = {k: v for k, v in _parse(path.read_text(encoding="utf-8")).items() if k not in ignored}
        if given.get("ocr_model_path"):
            given["ocr_model_path"] = str(Path(given["ocr_model_path"]).expanduser())
        return replace(cls(**given), **{k: v for k, v in overrides.items() if v is not None})

    def save(self, path: str | Path) -> None:
        path = Path(path).expanduser()
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("".join(f"{f.name}: {_shown(asdict(self)[f.name])}\n" for f in fields(self)), encoding="utf-8")


def _shown(value) -> str:
    return "null" if value is None else str(value).lower() if isinstance(value, bool) else repr(value) if isinstance(value, str) else str(value)


def _parse(text: str) -> dict:
    """YAML where its parser is installed; else flat ``key: value`` lines, comments and quotes, which is all these settings need."""
    try:
        import yaml
    except ImportError:
        return _parse_flat(text)
    return yaml.safe_load(text) or {}


def _parse_flat(text: str) -> dict:
    out = {}
    for line in text.splitlines():
        key, colon, value = line.partition(":")
        value = value.strip()
        if not colon or line.lstrip().startswith("#"):
            continue
        if value[:1] not in "'\"" or not value:
            value = value.partition(" #")[0].strip()
        if value[:1] in "'\"" and value[-1:] == value[:1] and len(value) > 1:
            out[key.strip()] = value[1:-1]
        elif value.lower() in ("null", "~", ""):
            out[key.strip()] = None
        elif value.lower() in ("true", "false"):
            out[key.strip()] = value.lower() == "true"
        else:
            out[key.strip()] = next((kind(value) for kind in (int, float) if _is(kind, value)), value)
    return out


def _is(kind, value: str) -> bool:
    try:
        kind(value)
    except ValueError:
        return False
    return True


def first_available(*candidates: tuple[str, bool]) -> str | None:
    """The first name that is available: the rule of all capability fallbacks."""
    return next((name for name, there in candidates if there), None)


def display_server(configured: str, wayland_display: str) -> str:
    return configured if configured != "auto" else "wayland" if wayland_display else "x11"
