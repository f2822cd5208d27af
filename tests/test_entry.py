import subprocess
import sys

import __spark_entry__ as entry


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 50


def test_works_without_the_training_data_folder():
    code = "import sys; sys.modules['glyphmill.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nq = e.queries()\nassert 'ngram_counts' in q and not any(k.startswith('op1') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], check=True)
