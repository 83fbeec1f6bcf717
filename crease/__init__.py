"""crease: sports-statistics analytics as Spark DataFrame operators.

Sub-packages
------------
sources    table / document readers, sinks, target schemas, test-table derivation
functions  column-level helpers that pin SQL semantics (rounding, null-strict least, ...)
operators  ingest (flatten / dedupe / keys), constraint checks, change sets, data products
plans      the named analytic questions (Q1-Q25, K1-K3) as DataFrame plans
streaming  incremental (insert-if-absent) loading with Structured Streaming
"""

from crease.session import get_session, ensure_checkpoint_dir

__all__ = ["get_session", "ensure_checkpoint_dir"]
