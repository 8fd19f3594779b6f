"""taxolens: Spark-native taxonomy discovery and audit over short texts.

Every public function takes and returns pyspark DataFrames. Labelings are
``(row_id, cluster)`` frames with ``-1`` meaning noise; ground truth is a
nullable string column. See README.md for the module map.
"""

from taxolens.schema import NOISE

__all__ = ["NOISE"]
