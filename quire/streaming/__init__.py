"""Applying fitted batch models to streaming DataFrames.

The operators being reproduced are batch-only (no windows, watermarks or
state). A fitted preprocessing / reduction model is a pure projection, so the
same ``transform`` applies unchanged to a streaming DataFrame; this module
only wires that to a ``readStream`` source and a ``foreachBatch`` sink.
"""
from quire.streaming.scoring import score_stream  # noqa: F401
