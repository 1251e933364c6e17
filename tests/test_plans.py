"""What the physical plans must and must not contain."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers the queries)
from logsluice.operators import redaction
from logsluice.operators.detectors import DETECTORS
from logsluice.plans import apply as A
from logsluice.plans.queries_rules import KV_SPEC
from logsluice.plans.registry import QUERIES
from logsluice.sources.tables import table

# Streams are planned per batch; their tables are read back with a plain scan.
BATCH = sorted(n for n in QUERIES if not n.startswith(("stream_", "src_lines", "src_delim", "sink_")))


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", BATCH)
def test_no_pairwise_join(spark, folder, name):
    text = plan(QUERIES[name](spark, folder))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_apply_does_not_shuffle(spark, folder):
    lines = table(spark, folder, "documents").select("doc_id", F.col("text").alias("raw"))
    assert "Exchange" not in plan(A.apply(lines, KV_SPEC))
    assert "Exchange" not in plan(redaction.redact_spans(lines, "raw", [DETECTORS["EmailDetector"]]))


def test_scan_reads_only_what_is_needed(spark, folder):
    docs = table(spark, folder, "documents")
    text = plan(redaction.redact_spans(docs, "text", [DETECTORS["EmailDetector"]]).select("doc_id", "redacted"))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_known_values_does_not_force_a_broadcast(spark, folder):
    import inspect

    from logsluice.operators import pii

    assert "broadcast(" not in inspect.getsource(pii)


def test_spans_are_computed_once(spark, folder):
    """A filter on the size of the array would evaluate the detectors a second time."""
    from logsluice.operators import pii

    text = plan(pii.span_table(
        table(spark, folder, "documents"), ["doc_id"], "text", [DETECTORS["EmailDetector"]]))
    conditions = [line for line in text.splitlines() if line.startswith("Condition") or "Filters" in line]
    assert not any("size(" in line for line in conditions)
    assert text.count("Generate explode") <= 2 and "Exchange" not in text
