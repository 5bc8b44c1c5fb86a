"""Numbers that are followed by more digits or words."""

import pytest

from quillspark.llm import secrets


@pytest.mark.parametrize(
    ("before", "number", "after"),
    [
        ("card ", "4111111111111111", " 12/26"), ("card: ", "4111 1111 1111 1111", " 03/27"), ("Card no. ", "4111-1111-1111-1111", " 123"), ("card ", "4222222222222", " 1 2 3 4 5 6"),
        ("IBAN: ", "DE89370400440532013000", " BIC COBADEFF"), ("iban ", "DE89 3704 0044 0532 0130 00", " AND MORE"), ("IBAN ", "NO9386011117947", " OK"), ("card ", "4111111111111111", " 12345678"),
        ("IBAN ", "DE89370400440532013000", " BIC COBADEFFXXX AND MORE WORDS"), ("card ", "4111 1111 1111 1111", " 12345678 9"), ("IBAN ", "MT84MALT011000012345MTLCAST001S", " BIC COBADEFF"),
    ],
)
def test_number_before_more(before, number, after):
    text = before + number + after
    kind = "card" if number[0] == "4" else "iban"
    assert secrets.listed(secrets.scan(text)) == f"{kind}:{len(before)}:{len(before + number)}"
    assert secrets.redacted(text) == f"{before}[secret]{after}"


def test_wrong_numbers_before_more_stay():
    for text in ("card 4111111111111112 12/26", "IBAN DE89370400440532013001 BIC COBADEFF", "card 123456789012 12"):
        assert not secrets.scan(text)


def test_two_numbers_after_two_keywords():
    text = "card 4111111111111111 12/26, card 4111 1111 1111 1111 03/27"
    assert secrets.redacted(text) == "card [secret] 12/26, card [secret] 03/27"
