"""Every query of the core against its SQL twin, and the rules that all queries keep."""

import re
from pathlib import Path

import pytest

from tidemark.plans import CATALOG
from tidemark.plans.compare import compare

QUERIES = {k: v for c in CATALOG for k, v in c.QUERIES.items()}
ORACLES = {k: v for c in CATALOG for k, v in c.ORACLES.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_twin(spark, sf, name):
    outcome = compare(spark, QUERIES, ORACLES, sf, [name])[name]
    assert outcome.startswith("same" if name in ORACLES else "rows only"), outcome


def test_core_never_names_the_subpackage_of_training_data():
    root = Path(__file__).resolve().parents[1] / "tidemark"
    for p in root.rglob("*.py"):
        if root / "llm" not in p.parents:
            assert not re.search(r"tidemark\.llm|from \.llm|import llm", p.read_text()), p


def test_no_local_checkpoint():
    root = Path(__file__).resolve().parents[1] / "tidemark"
    assert not [p for p in root.rglob("*.py") if "localCheckpoint" in p.read_text()]


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["surface_id", "timeline", "gap_start", "gap_end"]
