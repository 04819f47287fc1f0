"""The driver's contract, and that nothing but the entry knows of the training-data part."""

import re
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["n_name", "customers", "balance"]
    assert df.count() > 0


def test_sql_is_for_known_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_does_not_import_the_training_data_part():
    for path in [*ROOT.glob("plankit/**/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"(import|from)\s+[\w.]*\b(llm|corpus_pipeline)\b", path.read_text()), path
