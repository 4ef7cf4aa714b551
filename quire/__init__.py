"""quire: document and form-record analytics on Spark DataFrames.

Every operator takes and returns DataFrames (or Columns for the scalar
functions) and leaves physical planning to Catalyst and AQE.
"""

from quire.session import build_session, checkpoint_dir, read_table

__all__ = ["build_session", "checkpoint_dir", "read_table"]
