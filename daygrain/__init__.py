"""daygrain: participant x day analytics over wearable and questionnaire data.

Every public function takes and returns Spark DataFrames or Columns.  The
library pins nothing itself; sessions are expected to run with
``spark.sql.session.timeZone=UTC`` because all timestamps are zone-less wall
clock (``TIMESTAMP_NTZ``).
"""

from daygrain.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
