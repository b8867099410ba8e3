"""Notices that contain or follow each other."""

import pytest

license_notices = pytest.importorskip("taxon.llm.license_notices")


@pytest.fixture(scope="module")
def scanner():
    return license_notices.Scanner(license_notices.Search())


def notices(scanner, text):
    return [(label, edits) for label, _, _, edits in scanner.fuzzy(license_notices.normalise(text)[0])]


def test_a_longer_notice_wins_over_one_within_it(scanner):
    assert notices(scanner, "Creative Commons Attribution-Share Alike") == [("cc-by-sa", 1)]
    assert notices(scanner, "Creative Commons Attribution-Non-Commercial") == [("cc-by-nc", 1)]
    assert notices(scanner, "creative commons attribution noncomercial") == [("cc-by-nc", 1)]
    assert notices(scanner, "creative commons attribution and more") == [("cc-by", 0)]
    assert notices(scanner, "licensed under the gnu general public license version 3") == [("gpl-3.0", 0)]


def test_a_misspelt_notice_before_an_exact_one(scanner):
    text = "realeased under the mit license released under the mit license"
    assert notices(scanner, text) == [("mit", 1), ("mit", 0)]
    assert notices(scanner, " ".join([text] * 50)) == [("mit", 1), ("mit", 0)] * 50
