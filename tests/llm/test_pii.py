import re
from datetime import date

import pytest

from cohortweave.llm import pii

F = pii.Feistel(b"key")


def swap(text):
    return pii.pseudonymised(text, F)


def test_permutations():
    for a, b in ((1, 1), (1, 9), (7, 11), (10, 10), (3, 100)):
        assert sorted(F.permute(v, a, b, "t") for v in range(a * b)) == list(range(a * b))
    kept = [v for v in range(100) if v % 3]
    assert sorted(F.within(v, 10, 10, "t", lambda n: n % 3 > 0) for v in kept) == kept
    assert F.permute(5, 100, 100, "x") != pii.Feistel(b"other").permute(5, 100, 100, "x")
    assert len({F.characters(f"{a}{b}{c}", "t") for a in "xyz" for b in "XY" for c in range(10)}) == 60


@pytest.mark.parametrize(
    "text, kind",
    [
        ("jo.doe42@mail4.example.com", "email"), ("+1 (535) 555-5412", "phone"), ("(535) 555-5412", "phone"),
        ("+49 30 12345678", "phone"), ("4111 1111 1111 1111", "card"), ("4111111111111111", "card"),
        ("DE89 3704 0044 0532 0130 00", "iban"), ("GB82WEST12345698765432", "iban"), ("123-45-6789", "ssn"),
        ("10.0.0.1", "ip"), ("1980-02-29", "date"), ("29.02.1980", "date"), ("02/29/1980", "date"), ("31/12/1999", "date"),
    ],
)
def test_format_stays_valid_and_values_stay_linked(text, kind):
    out, spans = swap(f"see {text}### and {text}, end.")
    assert [(k, e - s) for k, s, e in spans] == [(kind, len(text))] * 2
    first, second = re.fullmatch("see (.*)### and (.*), end[.]", out).groups()
    assert first == second != text and text not in out
    # the pseudonym is a valid value of the same kind
    assert [k for k, _, _ in swap(first)[1]] == [kind]
    if kind != "ip":
        assert re.sub("[0-9]", "0", re.sub("[A-Za-z]", "a", first.partition("@")[0])) == re.sub(
            "[0-9]", "0", re.sub("[A-Za-z]", "a", text.partition("@")[0])
        )


def test_invalid_values_stay():
    for text in ("4111111111111112", "999.1.1.1", "2001-02-30", "000-12-1234", "DE00 3704 0044 0532 0130 00", "x" * 99, "1.2.3"):
        assert swap(text) == (text, [])
    assert swap(None) == (None, []) and swap("") == ("", [])


def test_equal_numbers_are_linked_across_separators_and_dates():
    cards = [re.sub("[^0-9]", "", swap(t)[0]) for t in ("4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111")]
    assert len(set(cards)) == 1
    days = {date(*map(int, p)) for p in (
        swap("1980-02-29")[0].split("-"), swap("29.02.1980")[0].split(".")[::-1])}
    assert len(days) == 1


def test_neighbours_are_told_apart():
    out, spans = swap("call +1 (826) 555-4081 190.137.223.204 or +49 30 1234567890 10.1.1.1 now")
    assert [k for k, _, _ in spans] == ["phone", "ip", "phone", "ip"]
    assert "555-4081" not in out and "190.137.223.204" not in out


@pytest.mark.parametrize(
    "text, value, kind",
    [
        ("card 4111111111111111 12/25", "4111111111111111", "card"),
        ("4111 1111 1111 1111 123", "4111 1111 1111 1111", "card"),
        ("4111-1111-1111-1111-123 ok", "4111-1111-1111-1111", "card"),
        ("order 12 4111 1111 1111 1111 123", "4111 1111 1111 1111", "card"),
        ("no 7 4111111111111111 12 25", "4111111111111111", "card"),
        ("DE89370400440532013000 BIC", "DE89370400440532013000", "iban"),
        ("DE89 3704 0044 0532 0130 00 12 EUR", "DE89 3704 0044 0532 0130 00", "iban"),
        ("DE89 3704 0044 0532 0130 00 BIC COBADEFF", "DE89 3704 0044 0532 0130 00", "iban"),
        ("AB12 DE89370400440532013000 EUR", "DE89370400440532013000", "iban"),
        ("+49 30 1234567890 2024", "+49 30 1234567890", "phone"),
    ],
)
def test_values_are_found_within_longer_matches(text, value, kind):
    out, spans = swap(text)
    at = text.index(value)
    assert spans == [(kind, at, at + len(value))]
    assert value not in out and out[:at] == text[:at] and out.endswith(text[at + len(value) :])


def test_long_runs_are_linear():
    assert swap("a1" * 200_000)[1] == []
    assert swap("1 " * 100_000 + "x@y.zz")[1][-1][0] == "email"


def test_frame(frame):
    docs = frame(
        "found string, doc_id long, text string",
        [("f", 1, "me@x.org"), ("f", None, None), ("f", 2, ""), ("f", 2, ""), ("f", 3, "plain")],
    )
    rows = sorted(pii.pseudonymise(docs, b"key").collect(), key=repr)
    assert sorted((repr(r.doc_id), r.text, len(r.found)) for r in rows if r.text is not None) == [
        ("1", swap("me@x.org")[0], 1), ("2", "", 0), ("2", "", 0), ("3", "plain", 0),
    ]
    assert [(r.doc_id, r.found) for r in rows if r.text is None] == [(None, [])]
    assert pii.pseudonymise(docs.limit(0), b"key").count() == 0


def test_no_place_of_a_long_value_stays_in_clear():
    for length in (1, 2, 3, 7, 40, 117, 198, 396, 1000):
        kept = [True] * length
        for i in range(12):
            name = "".join("abcdefghijklmnopqrstuvwxyz"[(i * 7 + k * (i + 3)) % 26] for k in range(length))
            out = F.characters(name, "email:x")
            assert len(out) == length and out.isalpha() and out.islower()
            kept = [k and a == b for k, a, b in zip(kept, name, out)]
        assert not any(kept)


def test_every_part_depends_on_every_other():
    a, b = ("x" * 400 + last for last in "yz")
    assert sum(c != d for c, d in zip(F.characters(a, "t"), F.characters(b, "t"))) > 350


def test_long_values_take_linear_time():
    import time

    begin = time.perf_counter()
    assert len(F.characters("ab" * 200_000, "t")) == 400_000
    assert time.perf_counter() - begin < 20
