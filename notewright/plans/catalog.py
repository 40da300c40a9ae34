"""All queries of the library and their SQL."""

from . import evaluation, mechanisms  # noqa: F401
from .queries import QUERIES, SQL  # noqa: F401
