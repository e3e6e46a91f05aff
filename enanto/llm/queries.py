"""Registered queries of problems 5 to 8, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table, written
from . import leakage, packing, percentiles, spans

_RESULTS, _LOADS = ["test_name"], ["load_id"]
_DAILY = ["test_name", "run_date"]


def _nine(df):
    """Nine decimals, so that the last bit of an interpolation doesn't show."""
    return df.withColumn("value", F.round("value", 9))


def _combined(s, d):
    daily = percentiles.summarise(table(s, d, "results"), _DAILY, "eta")
    return percentiles.combine(daily, _RESULTS, ["run_date"])


def _whole_l(s, d):
    """Each load's percentiles of L beside those of all loads, which are combined from the loads' summaries."""
    runs = percentiles.SortedRuns(table(s, d, "samples"), _LOADS, "L")
    whole = percentiles.combine(runs.summaries(), [], _LOADS)
    w = whole.select(F.col("p").alias("__p"), F.col("value").alias("value_of_all"), F.col("n").alias("n_of_all"), F.col("rank_error").alias("rank_error_of_all"))
    return _nine(runs.percentiles()).join(w, F.col("p") == F.col("__p")).drop("__p")


def _bounds(s, d):
    """Whether each combined percentile's rank lies within its stated bound, counted over all values."""
    c = _combined(s, d).select(F.col("test_name").alias("__g"), "p", "value", "n", "rank_error")
    x = table(s, d, "results").where(F.col("eta").isNotNull() & ~F.isnan("eta")).select("test_name", "eta")
    j = x.join(c, F.col("test_name").eqNullSafe(F.col("__g")))
    g = j.groupBy("test_name", "p", "n", "value", "rank_error").agg(F.count_if(F.col("eta") < F.col("value")).alias("below"), F.count_if(F.col("eta") <= F.col("value")).alias("upto"))
    at, room = F.col("p") * (F.col("n") - 1), F.col("rank_error") * F.col("n") + 1
    return g.select("test_name", "p", "n", ((F.col("below") - at <= room) & (at - F.col("upto") <= room)).alias("within"), (F.col("rank_error") <= percentiles.EPSILON).alias("bounded"))


def _invariants(s, d):
    """What any packing must keep: no container over capacity, every text's tokens once and in order, only long ones split."""
    p = written(packing.pack(table(s, d, "documents")), "packed")
    over = p.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > packing.CAPACITY).alias("containers_over"))
    pieces = p.groupBy("doc_id").agg(F.count("*").alias("k"), F.count_distinct("piece").alias("d"), F.max("piece").alias("last"), F.sum("n_tokens").alias("n"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"))
    broken = (F.col("k") != F.col("d")) | (F.col("last") != F.col("k") - 1) | (F.col("n") != F.col("end")) | (F.col("k") != F.greatest(F.lit(1), F.ceil(F.col("n") / packing.CAPACITY)))
    docs = pieces.agg(F.count("*").alias("n_documents"), F.count_if(broken).alias("texts_broken"))
    one = lambda df: df.withColumn("__one", F.lit(1))
    return one(docs).join(one(over), "__one").drop("__one")  # one row each


def _verbatim(s, d):
    return leakage.leaks(table(s, d, "documents"), table(s, d, "eval_items")).where("kind = 'verbatim'").select("doc_id", "item_id")


def _clean(s, d):
    kept = leakage.clean_documents(table(s, d, "documents"), table(s, d, "eval_items"))
    return kept.select("doc_id", "page_id", "lang", F.length("text").cast("long").alias("n_chars"))


def queries() -> dict:
    return {
        "p5_percentiles": lambda s, d: _nine(percentiles.percentiles(table(s, d, "results"), _RESULTS, "eta")),
        "p5_daily": lambda s, d: _nine(percentiles.percentiles(table(s, d, "results"), _DAILY, "eta")).withColumn("run_date", F.col("run_date").cast("string")),
        "p5_loads": lambda s, d: _nine(percentiles.percentiles(table(s, d, "samples"), _LOADS, "L")),
        "p5_combined": _combined,
        "p5_combined_loads": _whole_l,
        "p5_bounds": _bounds,
        "p6_packing": lambda s, d: packing.pack(table(s, d, "documents")),
        "p6_quality": lambda s, d: packing.pack_quality(packing.pack(table(s, d, "documents"))),
        "p7_found": lambda s, d: leakage.leaks(table(s, d, "documents"), table(s, d, "eval_items")).select("doc_id", "item_id"),
        "p6_invariants": _invariants,
        "p7_verbatim": _verbatim,
        "p7_matches": lambda s, d: leakage.leaks(table(s, d, "documents"), table(s, d, "eval_items")),
        "p7_clean": _clean,
        "p8_found": lambda s, d: spans.sharing_pages(table(s, d, "documents")),
        "p8_spans": lambda s, d: spans.shared_spans(table(s, d, "documents")),
        "p8_shares": lambda s, d: spans.shared_shares(table(s, d, "documents")),
    }


def _exact(source: str, value: str, keys: str) -> str:
    return f"""
WITH q AS (
  SELECT {keys}, count({value}) AS n, quantile_cont({value}, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS v
  FROM {source} WHERE {value} IS NOT NULL AND NOT isnan({value}) GROUP BY {keys})
SELECT {keys}, unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]::DOUBLE[]) AS p, round(unnest(v), 9) AS "value", n, 0.0::DOUBLE AS rank_error FROM q"""


#: All windows of 200 characters, and those that more than one page has.
_SHARED = """
WITH u AS (SELECT doc_id, page_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE page_id IS NOT NULL AND doc_id IS NOT NULL AND length(text) >= 200),
w AS (SELECT doc_id, page_id, i, md5_number(substr(text, i, 200)) AS h FROM u),
m AS (SELECT h FROM w GROUP BY 1 HAVING min(page_id) < max(page_id)),
s AS (SELECT DISTINCT doc_id, page_id, i, w.h FROM w JOIN m ON w.h = m.h)"""


def _word_list(text: str) -> str:
    """The compared words of a text in SQL, as :func:`.leakage.words` takes them."""
    for pattern in ("<[^<>]*>", r"\[\[[^\[\]|]*\|", "''''+", "&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"):
        text = f"regexp_replace({text}, '{pattern}', ' ', 'g')"
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')"


def oracle_sql() -> dict:
    return {
        "p5_bounds": """SELECT test_name, unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]::DOUBLE[]) AS p, n, true AS within, true AS bounded
            FROM (SELECT test_name, count(*) AS n FROM results WHERE eta IS NOT NULL AND NOT isnan(eta) GROUP BY 1)""",
        "p6_invariants": "SELECT count(DISTINCT doc_id) AS n_documents, 0::BIGINT AS texts_broken, 0::BIGINT AS containers_over FROM documents",
        "p7_verbatim": f"""WITH i AS (SELECT item_id, {_word_list('passage')} AS w FROM eval_items WHERE item_id IS NOT NULL AND passage IS NOT NULL), d AS (SELECT doc_id, {_word_list('text')} AS w FROM documents WHERE text IS NOT NULL),
            ig AS (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i), ik AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM ig),
            dg AS (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)
            SELECT DISTINCT doc_id, item_id FROM dg JOIN ik ON array_to_string(w[k:k + 11], ' ') = g""",
        "p8_found": _SHARED
        + """, p AS (SELECT DISTINCT page_id, h FROM s)
            SELECT DISTINCT a.page_id AS page_id_a, b.page_id AS page_id_b FROM p a JOIN p b ON a.h = b.h AND a.page_id < b.page_id""",
        "p8_spans": """
WITH u AS (SELECT doc_id, page_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE page_id IS NOT NULL AND doc_id IS NOT NULL AND length(text) >= 200),
w AS (SELECT doc_id, page_id, i, md5_number(substr(text, i, 200)) AS h, CASE WHEN length(text) >= i + 200 THEN md5_number(substr(text, i, 201)) END AS g FROM u),
ph AS (SELECT h FROM w GROUP BY 1 HAVING min(page_id) < max(page_id)),
pg AS (SELECT g FROM w WHERE g IS NOT NULL GROUP BY 1 HAVING min(page_id) < max(page_id)),
h AS (SELECT DISTINCT page_id, w.h FROM w JOIN ph ON w.h = ph.h), g AS (SELECT DISTINCT page_id, w.g FROM w JOIN pg ON w.g = pg.g),
s AS (SELECT doc_id, w.i, h.page_id AS other FROM w JOIN h ON w.h = h.h AND w.page_id <> h.page_id),
e AS (SELECT doc_id, w.i, g.page_id AS other FROM w JOIN g ON w.g = g.g AND w.page_id <> g.page_id),
k AS (SELECT s.*, (e.i IS NULL)::INT AS new FROM s LEFT JOIN e ON s.doc_id = e.doc_id AND s.other = e.other AND e.i = s.i - 1),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, other ORDER BY i) AS run FROM k),
q AS (SELECT doc_id, other, (min(i) - 1)::INT AS "start", (max(i) + 199)::INT AS "end" FROM r GROUP BY doc_id, other, run)
SELECT doc_id, "start", "end", count(DISTINCT other) AS n_partners FROM q GROUP BY 1, 2, 3""",
        "p8_shares": _SHARED
        + """, c AS (SELECT doc_id, least(coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 200), 200) AS k FROM s),
            t AS (SELECT doc_id, sum(k)::BIGINT AS k FROM c GROUP BY 1)
            SELECT d.doc_id, coalesce(length(text), 0) AS n_chars, coalesce(k, 0) AS shared_chars, coalesce(k, 0) / nullif(coalesce(length(text), 0), 0) AS share FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id""",
        "p5_percentiles": _exact("results", "eta", "test_name"),
        "p5_daily": _exact("(SELECT test_name, run_date::VARCHAR AS run_date, eta FROM results)", "eta", "test_name, run_date"),
        "p5_loads": _exact("samples", "L", "load_id"),
    }
