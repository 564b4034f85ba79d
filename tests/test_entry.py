"""The entry lists the library's own queries also where a package of the others is missing."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def counted(hidden: str) -> tuple[int, int]:
    code = f"import sys; sys.modules[{hidden!r}] = None\nimport __spark_entry__ as e\nprint(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    return tuple(map(int, out.split()))


def test_a_missing_package_hides_no_other_query():
    from foliolens.plans.expected_sql import expected_sql
    from foliolens.plans.queries import QUERIES

    own = len(QUERIES), len(expected_sql())
    assert counted("xxhash") == counted("foliolens.llm") == own
    everything, without = counted("nothing_of_this_name"), counted("corpus_pipeline")
    assert everything[0] - without[0] in (0, 1) and without[0] >= own[0]
