"""Errors of the adapters to outside services."""

from __future__ import annotations


class ContextualCompletionError(RuntimeError):
    """A generation that failed; safe to show."""


class ContextualConfigurationError(ContextualCompletionError):
    """The service is not configured."""


class ContextualServiceError(ContextualCompletionError):
    """The service could not be reached or did not finish."""


class InvalidResponseError(ContextualCompletionError):
    """The service's answer cannot be used."""


class TranslationError(RuntimeError):
    """A translation that failed; safe to show."""
