"""vigil — incident analytics as Spark DataFrame jobs.

Every operator takes DataFrames plus plain parameters and returns a lazy
DataFrame; nothing here triggers an action except the explicit sinks in
``vigil.sources.files`` and the streaming drivers in ``vigil.streaming``.
"""

from vigil.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
