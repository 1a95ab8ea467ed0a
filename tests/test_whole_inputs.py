"""Registered queries read their tables as a whole."""

import inspect

from labelframe.plans import queries


def test_no_row_cap_in_the_report():
    source = inspect.getsource(queries).split("def q_incompatible_report")[1].split("\ndef ")[0]
    assert ".limit(" not in source
