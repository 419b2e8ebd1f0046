"""Parameters of the text engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TaggingConfig:
    """Weights of the tagging model; they are weights, not probabilities."""

    # fixed values: tuned constants that results depend on
    lambda_uni: float = 0.059549
    lambda_bi: float = 5.260
    lambda_tri: float = 2.218
    lambda_tri_exp: float = 0.17452
    epsilon_tri: float = 0.006042
    lambda_extra: float = 1.041e-4
    alpha_extra: float = 1e-4
    epsilon_extra: float = 5.9014e-7
    lambda_19: float = 3.33e-6
    alpha_last: tuple[float, ...] = (0.03227, 0.08662, 0.2241, 0.8162, 4.373)
    alpha_suffix: float = 40.0
    alpha_member: float = 3.91e-5
    alpha_cap: float = 23.15
    alpha_no_cap: float = 0.02243
    alpha_unknown_cap: float = 27.06
    alpha_unknown_no_cap: float = 0.0205
    known_readings: int = 4
    unknown_readings: int = 6
    min_prefix: int = 2
    compound_min: int = 3
    compound_min_prefix: int = 1
    compound_min_suffix: int = 2


@dataclass(frozen=True)
class DetectorConfig:
    """The statistical error detector."""

    threshold: float = 0.5
    representatives: int = 10
    first_representatives: int = 3
    scheme: int = 4


@dataclass(frozen=True)
class RuleConfig:
    """Reports of the rules."""

    max_suggestions: int = 10
    accept_repeated_suggestions: bool = False
    same_as_original_is_false_alarm: bool = True
    accept_not_improving: bool = False


TAGGING, DETECTOR, RULES = TaggingConfig(), DetectorConfig(), RuleConfig()
