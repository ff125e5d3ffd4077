"""Settings and thresholds, passed to operators explicitly."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    # Defaults of the detection settings.
    session_gap_minutes: int = 30
    window_minutes: int = 5
    max_sequence_len: int = 64
    correlation_window_minutes: int = 20
    incident_min_signals: int = 2
    signal_min_score: float = 0.25
    severity_medium: float = 0.45
    severity_high: float = 0.75
    recent_minutes: int = 360
    token_min_count: int = 2
    rare_command_max: int = 3
    profile_min_logins: int = 5
    # True treats only 172.16/12 as internal; False treats every 172.* as internal.
    rfc1918: bool = False


DEFAULTS = Options()
