import datetime
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from enanto.operators import parse

SCHEMA = "line_id bigint, load_id bigint, file_name string, raw_line string, reason string, L string"
GOOD = "case_1,2001-01-04 17:14:02.111,96.0,R,17.75,5.5,fine"


def found(spark, lines):
    df = spark.createDataFrame([(i, 1, "f", x, "clash", "clash") for i, x in enumerate(lines)], SCHEMA)
    return dict(map(tuple, parse.failed_lines(df).collect()))


CASES = [
    (GOOD, None),
    ("", "column_count"),
    (None, "column_count"),
    ("a,b", "column_count"),
    (GOOD + ",x", "column_count"),
    ('"case_1","2001-01-04T17:14:02Z","9.6e+01","L","","",""', None),
    ('case_1,2001-01-04 17:14:02,96,R,1,,"two\nlines, ""quoted"""', None),
    ('case_1,2001-01-04 17:14:02,96,R,1,,"open', "quoting"),
    ('case_1,2001-01-04 17:14:02,96,R,1,,"x" y', "quoting"),
    ('case_1,2001-01-04 17:14:02,96,R,1,,in"side', "quoting"),
    ('case_1,2001-01-04 17:14:02,96,R,1,, "x"', "quoting"),
    ('"a,b', "quoting"),
    (" case_1 ,2001-01-04 17:14:02, 96 , R , 1 ,,", None),
    ("Case_1,2001-01-04 17:14:02,96,R,1,,", "case_id"),
    (",2001-01-04 17:14:02,96,R,1,,", "case_id"),
    ("case_1\n,2001-01-04 17:14:02,96,R,1,,", "case_id"),
    ("null,2001-01-04 17:14:02,96,R,1,,", "case_id"),
    ("case_,2001-01-04 17:14:02,96,R,1,,", "case_id"),
    ("_case_1,2001-01-04 17:14:02,96,R,1,,", "case_id"),
    ("case1,2001-01-04 17:14:02,96,R,1,,", "case_id"),
    ("0001,2001-01-04 17:14:02,96,R,1,,", "case_id"),
    ("case_1_2,2001-01-04 17:14:02,96,R,1,,", "case_id"),
    ("case_id,t,L,hand,O,omega,note", "case_id"),
    ("case_1,2001-01-04 17:14:02,96,R,1,1e999,", None),
    ("case_1,2001-01-04 17:14:02.1234567890123,96,R,1,,\u00a0", None),
    (GOOD + "x" * 30_000, None),
    (GOOD[:-4] + "\t", None),
    ("case_1,2001-02-30 17:14:02,96,R,1,,", "t"),
    ("case_1,2001-02-28 24:00:00,96,R,1,,", "t"),
    ("case_1,2001-2-28 04:00:00,96,R,1,,", "t"),
    ("case_1,0000-02-28 04:00:00,96,R,1,,", "t"),
    ("case_1,2000-02-29 04:00:00.5Z,96,R,1,,", None),
    ("case_1,2001-01-04 17:14:02,0,R,1,,", "L"),
    ("case_1,2001-01-04 17:14:02,-3,R,1,,", "L"),
    ("case_1,2001-01-04 17:14:02,nan,R,1,,", "L"),
    ("case_1,2001-01-04 17:14:02,1e999,R,1,,", "L"),
    ("case_1,2001-01-04 17:14:02,1d,R,1,,", "L"),
    ("case_1,2001-01-04 17:14:02,1.2.3,R,1,,", "L"),
    ("case_1,2001-01-04 17:14:02,.5,R,1,,", None),
    ("case_1,2001-01-04 17:14:02,5.,R,1,,", None),
    ("case_1,2001-01-04 17:14:02,.,R,1,,", "L"),
    ("case_1,2001-01-04 17:14:02,١,R,1,,", "L"),
    ("case_1,2001-01-04 17:14:02,1,r,1,,", "hand"),
    ("case_1,2001-01-04 17:14:02,1,Ｒ,1,,", "hand"),
    ("case_1,2001-01-04 17:14:02,1,R,x,,", "O"),
    ("case_1,2001-01-04 17:14:02,1,R,,,", None),
    ("case_1,2001-01-04 17:14:02,1,R,Infinity,,", "O"),
    ("case_1,2001-01-04 17:14:02,1,R,-1.5E-3,not a number,", None),
    ("," * 30_000, "column_count"),
    ('case_1,2001-01-04 17:14:02,1,R,1,,"' + 'x""y,\n' * 200_000 + '"', None),
    ('case_1,2001-01-04 17:14:02,1,R,1,,"' + 'x""y,\n' * 200_000, "quoting"),
]


def test_reasons(spark):
    got = found(spark, [x for x, _ in CASES])
    for i, (line, reason) in enumerate(CASES):
        assert got.get(i) == reason, (line or "")[:80]


def test_repeats_and_empty_table(spark):
    assert found(spark, ["", "", GOOD, GOOD]) == {0: "column_count", 1: "column_count"}
    assert found(spark, []) == {}


def test_loaded_values(spark):
    df = spark.createDataFrame([(1, 7, "f", '"c_1",2001-01-04T17:14:02.1234567Z, 9.6e1 ,L,,x," a ""b"" "', "", "")], SCHEMA)
    r = parse.loaded_rows(df).collect()[0]
    assert (r.case_id, r.L, r.hand, r.O, r.omega, r.note, r.load_id) == ("c_1", 96.0, "L", None, None, 'a "b"', 7)
    assert r.t == datetime.datetime(2001, 1, 4, 17, 14, 2, 123456)
    assert parse.classify_lines(df).collect()[0].corrupt is None


def plain(line):
    """The statement, word for word, one character at a time."""
    fields, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            j = i + 1
            while True:
                if j >= n:
                    return "quoting"
                if line[j] == '"':
                    if j + 1 < n and line[j + 1] == '"':
                        j += 2
                        continue
                    break
                j += 1
            fields.append(line[i + 1 : j].replace('""', '"'))
            i = j + 1
            if i < n and line[i] != ",":
                return "quoting"
        else:
            j = line.find(",", i)
            j = n if j < 0 else j
            if '"' in line[i:j]:
                return "quoting"
            fields.append(line[i:j])
            i = j
        if i >= n:
            break
        i += 1
    if len(fields) != 7:
        return "column_count"
    f = [x.strip(" ") for x in fields]
    number = lambda x: re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", x) and abs(float(x)) < float("inf")
    if not re.fullmatch("[a-z]+_[0-9]+", f[0]):
        return "case_id"
    m = re.fullmatch(r"([0-9]{4}-[0-9]{2}-[0-9]{2})[ T]([0-9]{2}:[0-9]{2}:[0-9]{2})(\.[0-9]+)?Z?", f[1])
    try:
        datetime.datetime.fromisoformat(f"{m[1]} {m[2]}")
        if m[2][:2] == "24":
            return "t"
    except (TypeError, ValueError):
        return "t"
    if not number(f[2]) or float(f[2]) <= 0:
        return "L"
    if f[3] not in ("L", "R"):
        return "hand"
    return None if f[4] == "" or number(f[4]) else "O"


PIECES = st.sampled_from(['"', '""', ",", " ", "\n", "a", "case_1", "2001-01-04 17:14:02", "1", "1e5", "R", "L", ".", "é"])


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(PIECES, max_size=16).map("".join), min_size=40, max_size=80))
def test_any_line(spark, lines):
    lines += [GOOD.replace("96.0", x.replace(",", "")) for x in lines]
    got = found(spark, lines)
    for i, x in enumerate(lines):
        assert got.get(i) == plain(x), repr(x)
