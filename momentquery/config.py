"""Parameters of the operators, checked on construction."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Durations:
    """Window lengths that are kept, in seconds."""

    least: float = 15.0
    most: float = 45.0

    def __post_init__(self) -> None:
        if self.least <= 0 or self.most <= 0:
            raise ValueError("durations must be positive")
        if self.most < self.least:
            raise ValueError("the longest duration is below the shortest")


# Results depend on these weights, penalties, floors and limits being exactly so.
WEIGHTS: dict[str, float] = {
    "hook": 0.12,
    "keyword": 0.12,
    "numeric": 0.05,
    "interjection": 0.05,
    "payoff": 0.12,
    "question_to_answer": 0.08,
    "motion": 0.08,
    "shot_change": 0.05,
    "face_presence": 0.05,
    "speaker_interaction": 0.12,
    "delivery_variance": 0.03,
    "interview_keyword": 0.12,
}
BASE = 0.10
PENALTIES: dict[str, float] = {"buried_lead": 0.18, "dangling_question": 0.08, "rambling_middle": 0.12}


@dataclass(frozen=True)
class Mining:
    durations: Durations = field(default_factory=Durations)
    base: float = BASE
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    penalties: dict[str, float] = field(default_factory=lambda: dict(PENALTIES))
    floor: float = 0.35
    block_floor: float = 0.20
    least_clips: int = 5
    most_clips: int = 12
    overlap: float = 0.5
    still_motion: float = 0.25
    still_keyword: float = 0.05
    interview_gate: float = 0.1
    block_seconds: float = 30.0
    block_transitions: int = 2
    merge_gap: float = 10.0
    bookend_gap: float = 5.0


@dataclass(frozen=True)
class Captions:
    words: int = 5
    seconds: float = 1.2
    gap: float = 0.35
    emphasis_length: int = 6

    def __post_init__(self) -> None:
        if self.words <= 0 or self.seconds <= 0:
            raise ValueError("caption limits must be positive")


@dataclass(frozen=True)
class Camera:
    """Normalised units; rates are per second."""

    safe_zone: float = 0.08
    slow: float = 0.05
    fast: float = 0.25
    fast_from: float = 0.15
    epsilon: float = 0.005


@dataclass(frozen=True)
class OneEuro:
    min_cutoff: float = 1.0
    beta: float = 0.0
    derivative_cutoff: float = 1.0

    def __post_init__(self) -> None:
        if self.min_cutoff <= 0 or self.derivative_cutoff <= 0:
            raise ValueError("cutoff frequencies must be positive")


#: Width : height of the outputs.
RATIOS: dict[str, tuple[int, int]] = {"9:16": (9, 16), "1:1": (1, 1), "16:9": (16, 9)}
