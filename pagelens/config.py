"""Settings of an extraction: presets, page-type nudges, overrides."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

# Thresholds of the three presets, and what page types change.
PRESETS = {
    "coverage": {"max_link_density": 0.70, "min_text_density": 0.08, "min_chars": 25, "noise_similarity": 0.55, "max_dropped_chars": 250, "template_frequency": 0.85},
    "balanced": {},
    "precision": {"max_link_density": 0.40, "min_text_density": 0.18, "min_chars": 50, "noise_similarity": 0.32, "max_dropped_chars": 600, "template_frequency": 0.55, "template_max_chars": 3500},
}


@dataclass(frozen=True)
class Config:
    preset: str = "balanced"
    page_type: str = "unknown"
    min_chars: int = 40
    max_link_density: float = 0.55
    min_text_density: float = 0.12
    noise_similarity: float = 0.42
    max_dropped_chars: int = 400
    max_noise_chars: int = 4000
    template_min_pages: int = 5
    template_frequency: float = 0.80
    template_max_chars: int = 1500
    front_matter: bool = True
    tables: bool = True
    table_format: str = "markdown"
    links: bool = False
    similarity: bool = True
    prune: bool = True
    micro: bool = True
    link_blocks: bool = True
    rules: bool = True
    detectors: bool = True
    disabled: tuple[str, ...] = ()
    extra: tuple[str, ...] = ()  # detectors that run only where named: pager, related, micro
    extra_rules: tuple = ()  # as detectors.load_rules reads them

    @classmethod
    def of(cls, preset: str = "balanced", page_type: str = "unknown", **overrides) -> Config:
        if preset not in PRESETS:
            raise ValueError(f"unknown preset: {preset}")
        known = {f.name for f in fields(cls)}
        for k in overrides:
            if k not in known:
                raise ValueError(f"unknown setting: {k}")
        c = replace(cls(preset=preset, page_type=page_type), **PRESETS[preset])
        if page_type == "marketing":
            c = replace(c, max_link_density=min(c.max_link_density, 0.50), noise_similarity=min(c.noise_similarity, 0.38))
        elif page_type == "docs":
            c = replace(c, max_link_density=max(c.max_link_density, 0.60))
        elif page_type == "pricing":
            c = replace(c, max_dropped_chars=min(c.max_dropped_chars, 300))
        return replace(c, **overrides)

    def with_page_type(self, page_type: str) -> Config:
        """The same settings for a page type; what the caller set stays."""
        plain, typed = Config.of(self.preset), Config.of(self.preset, page_type)
        keep = {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) != getattr(plain, f.name)}
        return replace(typed, **{**keep, "page_type": page_type})
