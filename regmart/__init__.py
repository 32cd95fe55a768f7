"""Analytics jobs over company-register, property-deal, property-advert and construction tables, on Spark."""

from . import functions, operators, plans, sources
from .session import get_session

__all__ = ["functions", "get_session", "operators", "plans", "sources"]
