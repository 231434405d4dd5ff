"""Structured Streaming forms of the intake jobs."""

from seatwise.streaming.intake import (
    changes_sink, current_firsts, final_submissions, finish, first_submissions, response_stream,
)

__all__ = ["changes_sink", "current_firsts", "final_submissions", "finish", "first_submissions", "response_stream"]
