"""Log onboarding on Spark: detect, extract, type, map, find personal data, redact.

Every operator is a function ``Column -> Column`` or ``DataFrame -> DataFrame``, so the same
rule specification drives a batch table and a stream.
"""

from logsluice.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
