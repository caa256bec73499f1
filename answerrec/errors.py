"""Errors raised while a plan is built; none of them needs a Spark job."""

from __future__ import annotations

from collections.abc import Iterable


class AnswerRecError(Exception):
    """Base class of every error of this package."""


class MissingAttribute(AnswerRecError):
    """A column that an operator needs is not in its input."""

    def __init__(self, attribute: str, valid: Iterable[str]):
        super().__init__(f"column {attribute!r} is missing; available: {', '.join(sorted(valid))}")


class InputDataError(AnswerRecError):
    """An input cannot be found or parsed."""


class BadEvaluationMetric(AnswerRecError):
    """A metric name is not one of the known metrics."""

    def __init__(self, metric: str, valid: Iterable[str]):
        super().__init__(f"unknown metric {metric!r}; available: {', '.join(valid)}")


class InvalidTag(AnswerRecError):
    """An option value is not one of its allowed values."""

    def __init__(self, tag: object, valid: Iterable[str]):
        super().__init__(f"invalid option {tag!r}; allowed: {', '.join(valid)}")


class KeywordExtractorError(AnswerRecError):
    """A keyword extractor is used wrongly, for example before it is fitted."""


def need_columns(available: Iterable[str], *needed: str) -> None:
    """Raise MissingAttribute for the first needed column that is absent."""
    available = list(available)
    for name in needed:
        if name not in available:
            raise MissingAttribute(name, available)


def need_option(value: object, allowed: Iterable[str]) -> str:
    """Return `value` if it is allowed, else raise InvalidTag."""
    allowed = list(allowed)
    if value not in allowed:
        raise InvalidTag(value, allowed)
    return str(value)
