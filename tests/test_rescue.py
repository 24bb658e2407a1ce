from datetime import date

import pytest

from loanmart.sources import raw
from tests.conftest import rows

COLUMNS = {"id": "int", "amount": "double", "day": "date", "note": "string"}
LINES = [
    "id,amount,day,note",
    "1,2.5,2024-01-01,fine",
    "2.7,x_,2024-02-30,_",
    ",,,",
    "3,NaN,2024-03-01",
    "4,1,2024-04-01,more,than,four",
    "4,1,2024-04-01,more,than,four",
    "99999999999,1e3,,é",
]


@pytest.fixture()
def scanned(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join(LINES) + "\n")
    return raw.read_csv_rescued(spark, str(tmp_path / "a.csv"), COLUMNS)


def test_values_stay_beside_what_did_not_parse(scanned):
    got = {r["note"] or r["id"]: r for r in scanned.collect()}
    fine, bad, big, short = got["fine"], got["_"], got["é"], got[3]
    assert (fine["id"], fine["amount"], fine["day"], fine["rescued"], fine["malformed"]) == (1, 2.5, date(2024, 1, 1), [], None)
    assert (bad["id"], bad["amount"], bad["day"]) == (2, None, None)
    assert [tuple(e) for e in bad["rescued"]] == [
        ("id", "2.7", "truncated"),
        ("amount", "x_", "unreadable"),
        ("day", "2024-02-30", "unreadable"),
    ]
    assert big["id"] is None and [tuple(e) for e in big["rescued"]] == [("id", "99999999999", "unreadable")]
    assert short["malformed"] == LINES[4] and [tuple(e) for e in short["rescued"]] == [("amount", "NaN", "unreadable")]
    assert got[None]["rescued"] == [] and got["more"]["malformed"] == LINES[5]


def test_counts(scanned):
    assert rows(raw.rescue_counts(scanned), "column", "reason", "n") == [
        (None, "fields", 3),
        ("amount", "unreadable", 2),
        ("day", "unreadable", 1),
        ("id", "truncated", 1),
        ("id", "unreadable", 1),
    ]


def test_nothing_to_lose(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("id,note\n")
    empty = raw.read_csv_rescued(spark, str(tmp_path / "empty.csv"), {"id": "int", "note": "string"})
    assert empty.count() == 0 and raw.rescue_counts(empty).count() == 0
    (tmp_path / "text.csv").write_text("note\na\n")
    text = raw.read_csv_rescued(spark, str(tmp_path / "text.csv"), {"note": "string"})
    assert text.first()["rescued"] == [] and raw.rescue_counts(text).count() == 0
    with pytest.raises(ValueError):
        raw.read_csv_rescued(spark, "any", {"rescued": "int"})
