"""Notices in longer lines, dual notices and wrapped notices, each by the scanner alone."""

import pytest
from tessella.llm import licenses

SHORT = [t for t in licenses.TEMPLATES if len(t.text) < 100]
PROSE = " ".join(f"prose{i} of the day" for i in range(20))
scanner = licenses.Scanner(licenses.TEMPLATES)


def ids(text):
    return [m.license_id for m in scanner.scan(text)]


@pytest.mark.parametrize("t", licenses.TEMPLATES, ids=lambda t: t.text[:30])
def test_notice_in_a_longer_line_and_over_line_ends(t):
    for text in (f"{PROSE} {t.text} {PROSE}", f"{PROSE}\n" + t.text.replace(" ", "\n# ") + f"\n{PROSE}"):
        found = scanner.scan(text)
        assert [m.license_id for m in found] == [t.license_id]
        assert licenses.wording(text[found[0].start : found[0].end].replace("# ", "")) == licenses.wording(t.text)


def test_both_notices_of_a_dual_licence():
    for a in SHORT:
        for b in SHORT:
            for gap in (" ", "\n", f" {PROSE} "):
                assert ids(f"{PROSE} {a.text}{gap}{b.text} {PROSE}") == [a.license_id, b.license_id], (a, b, gap)


def test_talk_of_licences_is_no_notice():
    for text in (f"{PROSE} copyright by me, no permission {PROSE}", "We met under the MIT dome and spoke about a licence to fish.", "Free software is a creative commons of the day."):
        assert ids(text) == []
