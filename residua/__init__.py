"""residua: find where a model is systematically wrong on a table, on Spark."""

from residua.config import Options
from residua.session import get_session

__all__ = ["Options", "get_session"]
