"""Valid values behind or inside longer candidates, and forms of dates."""

import re

import pytest

from churnscope.llm import pseudonyms

F = pseudonyms.Feistel(b"k")
IBANS = ["ES91 2100 0418 4502 0005 1332", "AT61 1904 3002 3457 3201", "BE68 5390 0754 7034", "PL61 1090 1014 0000 0712 1981 2874", "SE45 5000 0000 0583 9825 7466", "CZ65 0800 0000 1920 0014 5399", "LU28 0019 4006 4475 0000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"]


def shape(s):
    return re.sub(r"\d", "9", re.sub("[A-Z]", "A", s))


@pytest.mark.parametrize("behind", ["", " EUR", " BIC", " IN", " 20", " CODE 12", " 4111"])
@pytest.mark.parametrize("value", IBANS)
def test_ibans_with_words_behind(value, behind):
    out, n = pseudonyms.pseudonymise_text(f"to {value}{behind}, please", F)
    new = out[3 : 3 + len(value)]
    assert n == 1 and new != value and out == f"to {new}{behind}, please" and shape(new)[:2] == "AA" and new[:2] == value[:2]
    assert pseudonyms.is_iban(new.replace(" ", "")) and pseudonyms.pseudonymise_text(out, F, True) == (f"to {value}{behind}, please", 1)


def test_values_behind_and_inside_failed_candidates():
    for text, n in ((f"{IBANS[0]} 4111 1111 1111 1111", 2), ("AB12 4111 1111 1111 1111", 1), ("+44 20 7946 0958 12345 12345", 1), (f"{IBANS[0]} {IBANS[1]}", 2)):
        out, found = pseudonyms.pseudonymise_text(text, F)
        assert found == n and "4111" not in out and "7946 0958" not in out and pseudonyms.pseudonymise_text(out, F, True) == (text, n)
    assert pseudonyms.pseudonymise_text("ES92 2100 0418 4502 0005 1332 EUR", F)[1] == 0


def test_dates_before_a_time():
    for s in ("2024-01-05T10:00:00", "2024-01-05T10:00:00.5+02:00", "2024/01/05t10:00Z", "05.01.2024T10:00"):
        out, n = pseudonyms.pseudonymise_text(f"at {s} it", F)
        at = max(s.find("T"), s.find("t"))
        assert n == 1 and out[3 : 3 + at] != s[:at] and out[3 + at :] == s[at:] + " it"
        assert pseudonyms.pseudonymise_text(out, F, True)[0] == f"at {s} it"
    assert pseudonyms.pseudonymise_text("2024-01-05Test 2024-01-05-7", F)[1] == 0


def test_dates_of_mixed_padding():
    seen = set()
    for s in ("03/7/1985", "3/07/1985", "1985-3-07", "1985.03.7", "09-9-2001"):
        out, n = pseudonyms.pseudonymise_text(s, F)
        assert n == 1 and out != s and shape(out) == shape(s) and pseudonyms.pseudonymise_text(out, F, True)[0] == s
        assert [w[0] == "0" for w in re.split("[-/.]", out)] == [w[0] == "0" for w in re.split("[-/.]", s)]
        seen.add(out)
    assert len(seen) == 5
