"""Inputs: table schemas, tables, key lists and the request log."""

from .request_log import append_requests, read_requests, stream_requests
from .schemas import SCHEMAS
from .tables import key_table, read_table, read_tables, register_views

__all__ = [
    "SCHEMAS",
    "append_requests",
    "key_table",
    "read_requests",
    "read_table",
    "read_tables",
    "register_views",
    "stream_requests",
]
