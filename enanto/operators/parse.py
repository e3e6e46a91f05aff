"""Problem 1: rows that fail to parse.

The lines are read permissively under an explicit typed schema whose corrupt column keeps the raw text (``from_csv``).
Lines that the reader accepts and that are plain to see as valid keep its values. Every other line, corrupt or doubtful
(the reader takes "1d" for a number and lets quotes pass), is cut again from its raw text and reclassified: quoting,
column count, then a check of each value. One narrow pass, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("case_id", "t", "L", "hand", "O", "omega", "note")
REASONS = ("quoting", "column_count", "case_id", "t", "L", "hand", "O")

_TYPES = ("STRING", "TIMESTAMP_NTZ", "DOUBLE", "STRING", "DOUBLE", "DOUBLE", "STRING")
_SCHEMA = ", ".join(f"`__read_{n}` {k}" for n, k in zip(FIELDS, _TYPES)) + ", `__corrupt` STRING"
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt", "quote": '"', "escape": '"', "sep": ",", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
#: Longer lines may hold more columns than the CSV reader allows; they are cut from their raw text at once.
_READER_MAX = 20_000

# Possessive throughout: one pass over a line of any length, no backtracking and no deep recursion.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
_LINE = rf"(?s)\A(?:,{_FIELD})*+\z"
_CUT = rf"(?s),({_FIELD})"
_PLAIN_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_PLAIN_TIME = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[ T](?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?Z?"
_NUMBER = rf"\A{_PLAIN_NUMBER}\z"
_TIME = rf"\A{_PLAIN_TIME}\z"
#: ASCII lower-case letters, then an underscore, then ASCII digits.
_PLAIN_CASE = "[a-z]+_[0-9]+"
_CASE = rf"\A{_PLAIN_CASE}\z"
#: A line without quotes and control characters whose shape leaves nothing to check but what the values amount to.
_VALID = rf"\A *{_PLAIN_CASE} *, *{_PLAIN_TIME} *, *{_PLAIN_NUMBER} *, *[LR] *, *(?:{_PLAIN_NUMBER})? *, *(?:{_PLAIN_NUMBER})? *,[^\x00-\x1f\x7f\",]*+\z"


def _number(c: Column) -> Column:
    """The finite double that a string spells, else null."""
    value = c.try_cast("double")
    return F.when(c.rlike(_NUMBER) & (F.abs(value) < float("inf")), value)


def _timestamp(c: Column) -> Column:
    """The timestamp that a string spells, else null; the date must exist (year 1 or later)."""
    day = F.substring(c, 1, 10)
    ok = c.rlike(_TIME) & day.try_cast("date").isNotNull() & (F.substring(c, 1, 4) != "0000")
    return F.when(ok, F.concat(day, F.lit(" "), F.substring(F.regexp_replace(c, "Z$", ""), 12, 15)).try_cast("timestamp_ntz"))


def classify_lines(df: DataFrame, line: str = "raw_line", keep: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """Cut and check each line.

    Returns the ``keep`` columns, ``reason`` (the first failing check of ``REASONS``, null for a valid line), ``corrupt``
    (the raw text of a failing line, else null) and the typed fields (null where the line fails; ``omega`` is null where
    it isn't a number). A null line counts as an empty one, which has one column. Other input columns are left out, so
    names that clash with the fields do no harm. Repeated lines are judged one by one. Spaces (U+0020) around a value
    don't count; a date before year 1 doesn't exist; fractions of a second are kept to the microsecond.
    """
    raw = F.coalesce(F.col(f"`{line}`"), F.lit(""))
    kept = [F.col(f"`{k}`") for k in keep]
    read = df.select(*kept, raw.alias("__raw"), F.inline(F.array(F.from_csv(F.when(F.length(raw) <= _READER_MAX, raw), _SCHEMA, _OPTIONS))))
    as_read = [f"__read_{n}" for n in FIELDS]
    within = F.col("__read_t").isNotNull() & (F.year("__read_t") > 0) & (F.col("__read_L") > 0) & (F.col("__read_L") < float("inf"))
    within = within & F.coalesce(F.abs("__read_O") < float("inf"), F.lit(True)) & F.coalesce(F.abs("__read_omega") < float("inf"), F.lit(True))
    plain = F.col("__corrupt").isNull() & F.coalesce(within, F.lit(False)) & F.col("__raw").rlike(_VALID)
    # inline(array(struct)) gives its values names of their own: what follows reads them instead of computing them again.
    read = read.select(*kept, "__raw", *as_read, F.inline(F.array(F.struct(plain.alias("__plain")))))
    lead = F.when(~F.col("__plain"), F.concat(F.lit(","), F.col("__raw")))
    cut = read.select(*kept, "__raw", *as_read, "__plain", F.inline(F.array(F.struct(lead.rlike(_LINE).alias("__quoted"), F.regexp_extract_all(lead, F.lit(_CUT), F.lit(1)).alias("__cut")))))

    def value(i: int) -> Column:
        x = F.coalesce(F.get("__cut", F.lit(i)), F.lit(""))
        bare = F.when(x.startswith('"'), F.regexp_replace(F.expr(f"substring(__cut[{i}], 2, length(__cut[{i}]) - 2)"), '""', '"')).otherwise(x)
        return F.trim(bare)

    shaped = F.col("__quoted") & (F.size("__cut") == len(FIELDS))
    texts = [F.when(shaped, value(i)).alias(f"__{n}") for i, n in enumerate(FIELDS)]
    fields = cut.select(*kept, "__raw", *as_read, "__plain", F.inline(F.array(F.struct("__quoted", F.size("__cut").alias("__n"), *texts))))
    again = {"t": _timestamp(F.col("__t")), **{c: _number(F.col(f"__{c}")) for c in ("L", "O", "omega")}, **{c: F.col(f"__{c}") for c in ("case_id", "hand", "note")}}
    # The reader gives null for an empty note.
    taken = {c: F.trim(F.coalesce("__read_note", F.lit(""))) if c == "note" else F.col(f"__read_{c}") for c in FIELDS}
    values = [F.when(F.col("__plain"), taken[c]).otherwise(again[c]).alias(f"__{c}") for c in FIELDS]
    typed = fields.select(*kept, "__raw", F.inline(F.array(F.struct("__plain", "__quoted", "__n", F.col("__O").alias("__Otext"), *values))))
    reason = (
        F.when(F.col("__plain"), None)
        .when(~F.col("__quoted"), "quoting")
        .when(F.col("__n") != len(FIELDS), "column_count")
        .when(~F.col("__case_id").rlike(_CASE), "case_id")
        .when(F.col("__t").isNull(), "t")
        .when(F.col("__L").isNull() | (F.col("__L") <= 0), "L")
        .when(~F.col("__hand").isin("L", "R"), "hand")
        .when((F.col("__Otext") != "") & F.col("__O").isNull(), "O")
    )
    out = typed.select(*typed.columns, F.inline(F.array(F.struct(reason.alias("__reason")))))
    ok = F.col("__reason").isNull()
    return out.select(
        *kept,
        F.col("__reason").alias("reason"),
        F.when(~ok, F.col("__raw")).alias("corrupt"),
        *[F.when(ok, F.col(f"__{n}")).alias(n) for n in FIELDS],
    )


def failed_lines(df: DataFrame) -> DataFrame:
    """line_id and first failing check of the lines that fail."""
    return classify_lines(df).where(F.col("reason").isNotNull()).select("line_id", "reason")


def loaded_rows(df: DataFrame) -> DataFrame:
    """The valid lines as typed samples rows."""
    return classify_lines(df, keep=("line_id", "load_id")).where(F.col("reason").isNull()).select("line_id", "load_id", *FIELDS)


def failure_counts(df: DataFrame) -> DataFrame:
    """Lines per file and outcome (``ok`` or the reason)."""
    out = classify_lines(df, keep=("file_name",)).select("file_name", F.coalesce("reason", F.lit("ok")).alias("outcome"))
    return out.groupBy("file_name", "outcome").agg(F.count("*").alias("n_lines"))
