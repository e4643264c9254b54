"""The bounds that every search and call works under."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    """Sizes in bytes, times in seconds."""

    entries: int = 100_000
    batch_items: int = 128
    navigation_bytes: int = 38_000
    chunk_bytes: int = 12_000
    inspected_bytes: int = 1_000_000
    file_bytes: int = 16 * 1024 * 1024
    preview_bytes: int = 16_384
    preview_json: int = 24_000
    declared_json: int = 32_000
    directory_entries: int = 64
    directory_bytes: int = 4_096
    sample_bytes: int = 16_000
    sample_chars: int = 80
    sampled_json: int = 28_000
    anchor_bytes: int = 4_000
    unit_bytes: int = 24_000
    fallback_unit_bytes: int = 3_000
    block_lines: int = 16
    group_units: int = 128
    group_bytes: int = 42_000
    state_bytes: int = 80_000
    evidence_bytes: int = 64_000
    whole_file_bytes: int = 16_000
    opening_lines: int = 20
    context_lines: int = 8
    window_lines: int = 3
    neighbour_lines: int = 40
    threshold: float = 0.5
    default_results: int = 10
    most_results: int = 100
    ranges_shown: int = 5
    requests: int = 50_000
    concurrent: int = 32
    tokens_per_second: int = 250_000
    requests_per_minute: int = 1_200
    token_cap: int = 65_536
    token_base: int = 512
    token_question: int = 32
    attempts: int = 2
    attempt_seconds: float = 60.0
    retry_seconds: float = 1.0
    ask_bytes: int = 256 * 1024
    ask_questions: int = 64
    question_bytes: int = 2_048
    ask_seconds: float = 60.0
    shown_bytes: int = 2_048


LIMITS = Limits()
