import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leadloom.operators.packed_cells import LEAD_FIELDS, PackedField, split_buffer, split_cells

ISSUES, EMAILS, _ = LEAD_FIELDS
PLAIN = PackedField("x")


def items(cell, field=PLAIN):
    return split_buffer(pa.array([cell], pa.string()), field)[1].to_pylist()


@pytest.mark.parametrize(
    ("cell", "found"),
    [
        (None, []), ("", []), ("  ", []), ("-", []), ("n/a", []), ("None", []), ("[]", []), ("x", ["x"]), ("a; b;; c ;", ["a", "b", "c"]), ("a|b || c", ["a", "b", "c"]),
        ("a, b", ["a", "b"]), ("a, b; c", ["a, b", "c"]), ("a<br/>\nb<br>c", ["a", "b", "c"]), ("1. a\n2. b", ["a", "b"]), ("1) a 2) b 3) c", ["a", "b", "c"]),
        ("• a • b", ["a", "b"]), ("- a\n- b", ["a", "b"]), ('"a; b"; c', ["a; b", "c"]), ('"say ""hi"""; c', ['say "hi"', "c"]), ("“a; b”; “c | d”", ["a; b", "c | d"]),
        ('["a \\"b\\"; c", "d"]', ['a "b"; c', "d"]), ("['a', 'b']", ["a", "b"]), ('["caf\\u00e9"]', ["café"]), ('5" pipe; b', ['5" pipe', "b"]), ("a；b", ["a", "b"]), ("a; a", ["a", "a"]),
        ("a / b", ["a", "b"]), ("Gate/Railing", ["Gate/Railing"]), ("flat 3) b; c", ["flat 3) b", "c"]), ("\ta\tb", ["a", "b"]), ('""', []), ("[a, b]", ["a", "b"]),
    ],
)
def test_cells(cell, found):
    assert items(cell) == found


def test_labels_guard_commas_and_slashes():
    assert items("LOW: a, b, HIGH: c / not d / critical : e", ISSUES) == ["LOW: a, b", "HIGH: c / not d", "critical : e"]


def test_blanks_part_atomic_values():
    assert items("a@x.example b@x.example , mailto:c@x.example", EMAILS) == ["a@x.example", "b@x.example", "mailto:c@x.example"]


def plain(cell: str) -> list[str]:
    """The same for semicolons and CSV quotes, character by character."""
    if cell.count('"') % 2:
        parts = cell.split(";")
    else:
        parts, now, inside = [], "", False
        for ch in cell:
            inside ^= ch == '"'
            if ch == ";" and not inside:
                parts.append(now)
                now = ""
            else:
                now += ch
        parts.append(now)
    out = []
    for p in parts:
        p = p.strip(" ")
        if len(p) > 1 and p[0] == p[-1] == '"':
            p = p[1:-1].replace('""', '"').strip(" ")
        if p:
            out.append(p)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='ab; "é', max_size=12), max_size=5))
def test_against_a_plain_scanner(cells):
    owner, found = split_buffer(pa.array(cells, pa.string()), PLAIN)
    found = found.to_pylist()
    assert [[x for o, x in zip(owner, found, strict=True) if o == i] for i in range(len(cells))] == [plain(c) for c in cells]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abcé ,|/", min_size=1, max_size=8).map(str.strip).filter(bool), min_size=1, max_size=6))
def test_quoted_lists_round_trip(values):
    assert items(";".join('"' + v.replace('"', '""') + '"' for v in values)) == values


def test_table(spark):
    rows = [(1, "a; b", "x"), (None, "c", "y"), (1, "a; b", "z"), (2, None, "w"), (3, "q" * 200_000 + "; r", "v")]
    df = spark.createDataFrame(rows, "id bigint, x string, item string")
    got = sorted((r.record_id or 0, r.pos, len(r.item)) for r in split_cells(df, "id", [PLAIN]).collect())
    assert got == [(0, 1, 1), (1, 1, 1), (1, 1, 1), (1, 2, 1), (1, 2, 1), (3, 1, 200_000), (3, 2, 1)]
    assert split_cells(df.limit(0), "id", [PLAIN]).count() == 0
    assert "Exchange" not in split_cells(df, "id", [PLAIN])._jdf.queryExecution().executedPlan().toString()
