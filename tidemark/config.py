"""Knobs of the library, read from INI-like text."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    # fixed values: defaults
    enabled: bool = True
    show_header: bool = True
    max_lines: int = 120
    dedup_min: int = 2
    git_log_max_commits: int = 20
    git_diff_max_lines: int = 150
    docker_logs_max_lines: int = 100
    find_max_results: int = 50
    bypass: tuple[str, ...] = ("docker exec", "psql", "mysql", "ssh")
    compact_threshold_tokens: int = 90_000
    memory_retention_days: int = 30
    adaptive_intensity: bool = True
    context_cache_enabled: bool = True
    redundancy_cache_enabled: bool = True
    summarize_threshold_lines: int = 300
    auto_compress_md: bool = True
    lang: str = "en"
    agent_warn_threshold_pct: float = 0.50
    burn_rate_warn_calls: int = 30
    agent_spawn_cost: int = 350_000
    read_max_lines: int = 300
    grep_max_results: int = 100
    max_call_log: int = 32
    recent_window: int = 16
    similarity_threshold: float = 0.85
    ultra_trigger_pct: float = 0.65
    mcp_prior_summaries_default: int = 5
    mcp_recent_calls_default: int = 10
    state_warn_calls: int = 10
    sig_mode_enabled: bool = True
    sig_mode_threshold_lines: int = 400
    memory_file_warn_tokens: int = 1000
    summary_format: str = "auto"
    agent_prompt_max_tokens: int = 2000
    plan_mode_passthrough: bool = True

    @property
    def budget(self) -> int:
        return self.compact_threshold_tokens * 5 // 4


def parse(text: str, base: Config | None = None) -> Config:
    """Reads ``key = value`` lines; comments, unknown keys and values that don't fit are passed over."""
    base = base or Config()
    kinds = {f.name: type(getattr(base, f.name)) for f in fields(base)}
    found: dict[str, object] = {}
    for line in text.splitlines():
        key, mark, value = line.split("#", 1)[0].partition("=")
        key, value = key.strip(), value.strip()
        kind = kinds.get(key)
        if not mark or kind is None:
            continue
        if kind is bool:
            if value.lower() in ("true", "false"):
                found[key] = value.lower() == "true"
        elif kind is tuple:
            found[key] = tuple(x.strip() for x in value.strip("[]").split(",") if x.strip())
        else:
            try:
                found[key] = kind(value)
            except ValueError:
                continue
    return replace(base, **found)


#: Tiers scale these limits: name and floor.
SCALED = (("max_lines", 20), ("git_log_max_commits", 5), ("git_diff_max_lines", 20), ("docker_logs_max_lines", 20), ("find_max_results", 10), ("summarize_threshold_lines", 50))
#: Per tier the tenths of a line limit and the hundredths of the dedup threshold that stay.
TIERS = {"lite": (10, 100), "full": (6, 66), "ultra": (3, 50)}


def scaled(config: Config, tier: str) -> Config:
    """The limits under a tier, not below their floors."""
    if tier == "lite":
        return config
    lines, dedup = TIERS[tier]
    limits = {name: max(getattr(config, name) * lines // 10, floor) for name, floor in SCALED}
    return replace(config, **limits, dedup_min=max(config.dedup_min * dedup // 100, 2))


#: What calibration sets, by profile.
PROFILES = {
    "aggressive": dict(max_lines=120, dedup_min=2, summarize_threshold_lines=300, auto_compress_md=True, ultra_trigger_pct=0.70, read_max_lines=300, grep_max_results=100),
    "balanced": dict(max_lines=200, dedup_min=3, summarize_threshold_lines=500, auto_compress_md=True, ultra_trigger_pct=0.80, read_max_lines=0, grep_max_results=0),
    "conservative": dict(max_lines=350, dedup_min=5, summarize_threshold_lines=800, auto_compress_md=False, ultra_trigger_pct=0.90, read_max_lines=0, grep_max_results=0),
}
