"""Query plans over the driver's tables; importing the package registers them."""

from . import composites, files, learning, more, panels, relational, snapshots, tape, text  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
