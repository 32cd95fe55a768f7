"""Continuously running jobs."""

from .requests import start_request_stats

__all__ = ["start_request_stats"]
