"""The registered queries cover every row of the operator inventory."""

from acceptance.catalog import CHECKS

INVENTORY = {"S": 9, "P": 15, "G": 2, "F": 15, "J": 5, "A": 16, "O": 6, "U": 3, "M": 8, "E": 6}


def test_every_row_has_a_query():
    covered = {row for check in CHECKS.values() for row in check.covers.split()}
    wanted = {f"{group}{i}" for group, n in INVENTORY.items() for i in range(1, n + 1)}
    assert wanted <= covered, sorted(wanted - covered)
    assert covered <= wanted, sorted(covered - wanted)


def test_most_queries_have_a_twin():
    without = {name for name, check in CHECKS.items() if check.sql is None}
    assert len(without) <= 9, sorted(without)
