import datetime as dt
import re

import pytest

from mixledger.llm import pii

KEY = b"k" * 32


@pytest.mark.parametrize("a,b", [(1, 1), (1, 7), (6, 9), (27, 31)])
def test_feistel_is_a_permutation(a, b):
    got = [pii.permute(KEY, "t", v, a, b) for v in range(a * b)]
    assert sorted(got) == list(range(a * b))
    assert a * b < 50 or got != [pii.permute(b"z" * 32, "t", v, a, b) for v in range(a * b)]


def test_texts_keep_their_format_and_stay_apart():
    values = [f"{a}{b}.É{c}" for a in "abc" for b in "xyz" for c in "012"]
    got = [pii.permute_text(KEY, "t", v) for v in values]
    assert len(set(got)) == len(values)
    assert all(re.fullmatch(r"[a-z]{2}\.[À-Þ]\d", g) for g in got)


def test_days_are_permuted_within_the_calendar():
    days = [pii.FIRST_DAY + dt.timedelta(d) for d in range(0, pii.DAYS, 37)]
    got = {pii.permute_day(KEY, d) for d in days}
    assert len(got) == len(days) and max(got) <= dt.date(2099, 12, 31)
    assert pii.permute_day(KEY, dt.date(1500, 1, 1)) is None


VALID = [
    ("mail", "chein.36@mail5.example.com", r"[a-z]{5}\.\d\d@mail5\.example\.com"),
    ("mail", "élé+x@a-b.org", r"[à-ÿ][a-z][à-ÿ]\+[a-z]@a-b\.org"),
    ("card", "4111 1111 1111 1111", r"\d{4} \d{4} \d{4} \d{4}"),
    ("iban", "DE89 3704 0044 0532 0130 00", r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d"),
    ("social", "123-45-6789", r"\d{3}-\d\d-\d{4}"),
    ("date", "2024-02-29", r"\d{4}-\d\d-\d\d"),
    ("date", "29.02.2024", r"\d\d\.\d\d\.\d{4}"),
    ("date", "12/31/1999", r"\d\d/\d\d/\d{4}"),
    ("ip", "175.102.247.55", r"\d+\.\d+\.\d+\.\d+"),
    ("phone", "+1 (974) 555-3436", r"\+1 \(\d{3}\) \d{3}-\d{4}"),
    ("phone", "555-123-4567", r"\d{3}-\d{3}-\d{4}"),
    ("secret", 'token = "681c09b8e90e7e8c9575180f595f646cf2969054', r'token = "[0-9a-f]{40}'),
]


@pytest.mark.parametrize("kind,value,shape", VALID)
def test_valid_values_are_replaced_in_format(kind, value, shape):
    new, counts = pii.pseudonymize(KEY, f"so {value}, and {value} again.")
    assert counts == {kind: 2}
    found = re.fullmatch(rf"so ({shape}), and ({shape}) again\.", new)
    assert found and found[1] == found[2] != value
    assert pii.pseudonymize(KEY, found[1])[1] == {kind: 1}  # the pseudonym passes the same check


@pytest.mark.parametrize(
    "text", ["4111 1111 1111 1112", "2023-02-29", "000-12-3456", "300.1.1.1", "GB82 WEST 1234 5698 7654 33", "no digits", "a @ b", "12:30", "v1.2.3.4.5", "key = value", "x1234567890123456y"]
)
def test_invalid_values_stay(text):
    assert pii.pseudonymize(KEY, text) == (text, {})


BESIDE = [
    ("card", "", "4111 1111 1111 1111", " 123"),
    ("card", "", "4111-1111-1111-1111", "-123"),
    ("card", "", "4111111111111111", " 12/27"),
    ("card", "", "4111111111111111", " 123"),
    ("card", "1234567 ", "4111 1111 1111 1111", ""),
    ("card", "123-", "4111-1111-1111-1111", ""),
    ("card", "", "3782 822463 10005", " 1234"),
    ("iban", "", "BE68 5390 0754 7034", " 2024"),
    ("iban", "", "BE68 5390 0754 7034", " USED CARS"),
    ("iban", "", "BE68539007547034", " 2024"),
    ("iban", "AB13 ", "BE68 5390 0754 7034", " 20"),
]


@pytest.mark.parametrize("kind,before,value,after", BESIDE)
def test_neighbours_do_not_hide_a_value(kind, before, value, after):
    new, counts = pii.pseudonymize(KEY, f"so {before}{value}{after}.")
    alone = pii.pseudonymize(KEY, value)[0]
    assert counts == {kind: 1} and alone != value and new == f"so {before}{alone}{after}."


def test_a_card_behind_an_iban_and_dates_in_a_row():
    new, counts = pii.pseudonymize(KEY, "BE68 5390 0754 7034 4111 1111 1111 1111")
    assert counts == {"iban": 1, "card": 1} and "4111 1111" not in new and "0754" not in new
    days = " ".join(f"2024-01-{d:02d}" for d in range(1, 9))
    assert set(pii.pseudonymize(KEY, days)[1]) <= {"date", "card"} and pii.pseudonymize(KEY, "2024-01-02 2024-01-03")[1] == {"date": 2}


def test_documents(spark):
    rows = [(1, "a@b.org", 5, "q"), (2, None, 5, "q"), (None, "", 5, None), (1, "a@b.org", 5, "q"), (3, "x " * 50000 + "a@b.org", 5, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_mail int, kind string")
    got = pii.pseudonymize_documents(docs, "one").collect()
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    assert [r.n_mail for r in got] == [1, 0, 0, 1, 1] and [r.kind for r in got] == [r[3] for r in rows]
    assert got[0].text == got[3].text == got[4].text[-7:] != "a@b.org" and got[1].text is None and got[2].text == ""
    assert pii.pseudonymize_documents(docs, "two").first().text != got[0].text
    assert pii.pseudonymize_documents(docs.limit(0)).count() == 0
