"""What the driver finds."""

import re

import __spark_entry__ as entry


def test_one_query_for_each_operator():
    numbers = sorted(int(m[1]) for name in entry.queries() if (m := re.match(r"op(\d+)_", name)))
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()
