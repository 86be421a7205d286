"""Errors of the engine; their texts are part of the API."""


class DocframeError(Exception):
    """Anything the caller did that the engine rejects."""
