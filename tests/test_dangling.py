from datetime import datetime as T

import pytest

from factloom.operators import dangling as D

REFS = "ref_table string, ref_field string, kind string, row_id bigint, key string, at timestamp_ntz, period string"
TARGETS = "kind string, key string, at timestamp_ntz, live boolean"


def brute(refs, targets):
    out = []
    for table, field, kind, row, key, at, _ in refs:
        if key is None:
            continue
        mine = [t for t in targets if t[0] == kind and t[1] == key]
        live = [t[2] or T(1000, 1, 1) for t in mine if t[3]]
        cause = "missing" if not mine else "deleted" if not live else "late" if at is not None and min(live) > at else None
        if cause:
            out.append((table, field, row, at and at.strftime("%Y-%m"), cause))
    return sorted(out, key=repr)


REF = [
    ("t", "f", "class", 1, "a", T(2024, 1, 5), "x"),
    ("t", "f", "class", 2, "gone", T(2024, 1, 5), "x"),
    ("t", "f", "class", 2, "gone", T(2024, 1, 5), "x"),
    ("t", "f", "class", 3, "dead", T(2024, 2, 5), "x"),
    ("t", "f", "class", 4, "later", T(2024, 2, 5), "x"),
    ("t", "f", "class", 5, "later", T(2024, 5, 5), "x"),
    ("t", "f", "class", 6, None, T(2024, 5, 5), "x"),
    ("t", "f", "class", 7, "later", None, "x"),
    ("t", "f", "class", 8, "gone", None, "x"),
    ("u", "g", "file", 9, "a", T(2024, 5, 5), "x"),
    ("t", "f", "class", 10, "same", T(2024, 3, 1), "x"),
    ("t", "f", "class", 11, "untimed", T(2024, 3, 1), "x"),
]
TARGET = [
    ("class", "a", T(2024, 1, 1), True),
    ("class", "dead", T(2024, 1, 1), False),
    ("class", "later", T(2024, 3, 1), True),
    ("class", "later", T(2024, 1, 1), False),
    ("class", "same", T(2024, 3, 1), True),
    ("class", "untimed", None, True),
    ("class", None, T(2024, 3, 1), True),
]


@pytest.mark.parametrize("share", [1, 3, 1000])
@pytest.mark.parametrize("refs,targets", [(REF, TARGET), (REF, []), ([], TARGET), (REF * 40, TARGET)])
def test_against_brute_force(spark, rows, share, refs, targets):
    found = D.dangling_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(targets, TARGETS), share)
    assert rows(found) == brute(refs, targets)


def test_report_counts_rows(spark, rows):
    found = D.dangling_references(spark.createDataFrame(REF, REFS), spark.createDataFrame(TARGET, TARGETS))
    assert ("t", "f", "2024-01", "missing", 2) in rows(D.dangling_report(found))
