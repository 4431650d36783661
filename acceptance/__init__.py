"""Acceptance queries over the given test tables."""


def load_all() -> None:
    """Import every module that registers queries."""
    from acceptance import detection_queries, report_queries, state_queries, stream_queries  # noqa: F401
