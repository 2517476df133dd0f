"""evtide: product-event analytics as Spark DataFrame operators.

Every operator is a function ``DataFrame(s) -> DataFrame`` built from built-in
Spark expressions, so Catalyst plans it and the cluster scales it.
"""

from evtide.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
__version__ = "0.1.0"
