"""What the README's coverage names is there."""

import os
import re

import __spark_entry__ as entry

README = open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "README.md"), encoding="utf-8").read()


def test_items_without_code_are_named():
    left_out = README[README.index("Left out:") : README.index("## Measured")]
    for item in ("K8", "S8", "S21", "U3", "X3", "K4", "U6", "U7", "X46", "A28", "A5"):
        assert re.search(rf"\b{item}\b", left_out), item


def test_core_queries_are_in_the_coverage():
    named = set(re.findall(r"`([a-z0-9_]+)`", README))
    assert {k for k in entry.queries() if not re.match(r"p[0-9]_", k)} <= named
