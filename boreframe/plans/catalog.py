"""All registered queries: importing this module fills the registry."""

from . import q_analytics, q_eval, q_ingest, q_models, q_quality  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
