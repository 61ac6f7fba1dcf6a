import datetime
import random
import re

from pathweave.llm.pii import op2_pii, pseudonymise
from pathweave.llm.secret_scan import luhn
from tests.llm.conftest import as_dir


def iban_ok(value):
    v = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def shape(value):
    return re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", value)))


VALUES = {
    "email": ["jo.81@mail8.example.com", "Ann_B+x@sub.example.co.uk"],
    "ip": ["61.131.143.218", "8.8.4.4"],
    "phone": ["+1 (264) 555-1012", "+49 30 1234 5678"],
    "card": ["4111111111111111", "4111-1111-1111-1111", "4111 1111 1111 1111", "5500005555555559", "378282246310005"],
    "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
    "iso_date": ["1987-02-28", "2024-02-29", "2099-12-31", "1900-01-01"],
    "day_date": ["28.02.1987", "31/12/1999"],
    "ssn": ["123-45-6789"],
}
INVALID = ["4111111111111112", "1234567890123456", "256.1.1.1", "2023-02-29", "2023-13-01", "32.01.1999", "000-12-3456", "DE88370400440532013000", "1.2.3", "4.0", "12345"]


def one(spark, texts, key="k"):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["_row"].doc_id: r for r in pseudonymise(frame, key).collect()}


def test_formats_and_validity(spark):
    flat = [(k, v) for k, vs in VALUES.items() for v in vs]
    got = one(spark, [f"é {v}, and" for _, v in flat])
    for i, (kind, value) in enumerate(flat):
        row = got[i]
        assert [f.kind for f in row.found] == [kind], (value, row)
        new = row.found[0].pseudonym
        assert row.text == f"é {new}, and" and new != value and row.found[0].start == 2
        if kind != "ip":
            assert shape(new) == shape(value), (value, new)
        if kind == "card":
            assert luhn(re.sub(r"\D", "", new))
        if kind == "iban":
            assert iban_ok(new)
        if kind == "iso_date":
            datetime.date.fromisoformat(new)
        if kind == "day_date":
            datetime.date(int(new[6:]), int(new[3:5]), int(new[:2]))
        if kind == "ip":
            assert len(new.split(".")) == 4 and all(0 <= int(o) <= 255 for o in new.split("."))
    # formats of one value are linked
    cards = {re.sub(r"\D", "", got[i].found[0].pseudonym) for i, (k, v) in enumerate(flat) if v.startswith("4111")}
    assert len(cards) == 1
    dates = [got[i].found[0].pseudonym for i, (k, v) in enumerate(flat) if v in ("1987-02-28", "28.02.1987")]
    assert dates[0] == "-".join(reversed(dates[1].split(".")))


def test_invalid_and_clean_texts_stay(spark, texts):
    got = one(spark, [*INVALID, *texts])
    for i, t in enumerate([*INVALID, *texts]):
        assert got[i].text == t and got[i].found == []


def test_permutations(spark):
    """Different values keep different pseudonyms, another key gives others."""
    rng = random.Random(4)
    ips = sorted({".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(300)})
    days = [str(datetime.date(1999, 1, 1) + datetime.timedelta(days=d)) for d in range(400)]
    phones = [f"+1 (212) 555-{n:04d}" for n in range(300)]
    for values in (ips, days, phones):
        got = one(spark, values)
        assert len({r.text for r in got.values()}) == len(values)
    assert one(spark, ips[:1], "other")[0].text != one(spark, ips[:1])[0].text


def test_marks_in_texts(spark):
    texts = ["\u0001a\u0002b 8.8.8.8 \u0002\u0001", "\u0002a\u0002b\u0001"]
    got = one(spark, texts)
    assert got[1].text == texts[1]
    assert got[0].text.startswith("\u0001a\u0002b ") and got[0].text.endswith(" \u0002\u0001") and len(got[0].found) == 1


def test_query_and_edge_cases(spark, docs, empty, nulls, tmp_path):
    got = op2_pii(spark, as_dir(docs, tmp_path)).collect()
    assert len(got) == docs.count()
    assert pseudonymise(empty).count() == 0
    assert sorted((r.text is None, len(r.found)) for r in pseudonymise(nulls).collect()) == [(False, 0)] * 2 + [(True, 0)] * 3


def test_values_next_to_others(spark):
    """A longer match that is not valid hides no valid value inside it."""
    cases = [
        ("4111 1111 1111 1111 123", "card", "4111 1111 1111 1111"), ("4111111111111111 12/27", "card", "4111111111111111"),
        ("1234 4111 1111 1111 1111", "card", "4111 1111 1111 1111"), ("7 2024-01-15 123456", "iso_date", "2024-01-15"),
        ("7 123-45-6789 4242", "ssn", "123-45-6789"), ("ES9121000418450200051332 EUR", "iban", "ES9121000418450200051332"),
        ("AB12 DE89370400440532013000 AND", "iban", "DE89370400440532013000"), ("on 12/25/1990", "month_date", "12/25/1990"),
    ]
    got = one(spark, [text for text, *_ in cases])
    for i, (text, kind, value) in enumerate(cases):
        (f,) = got[i].found
        assert (f.kind, f.start) == (kind, text.index(value)), (text, got[i])
        assert shape(f.pseudonym) == shape(value) and f.pseudonym != value and got[i].text == text.replace(value, f.pseudonym)
        if kind == "month_date":
            datetime.date(int(f.pseudonym[6:]), int(f.pseudonym[:2]), int(f.pseudonym[3:5]))
