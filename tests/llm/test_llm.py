import bisect
import datetime as dt
import math
import os
import sys
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
from enanto.llm import leakage, packing, percentiles, spans
from enanto.llm import queries as registered

SMALL = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


# -- percentiles ------------------------------------------------------------------------------------------------------


def frame(spark, data):
    return spark.createDataFrame(data, "g string, d int, x double, p string, value string, n string")


def test_percentiles_exact(spark):
    rng = np.random.default_rng(0)
    groups = {"hot": rng.choice([1.0, 2.0, 3.0], 5000), "fine": rng.lognormal(0, 3, 701), "one": np.array([4.0]), None: rng.normal(0, 1, 50), "two": np.array([1.0, 2.0])}
    data = [(g, 0, float(v), "clash", "clash", "clash") for g, x in groups.items() for v in x] + [("hot", 0, NAN, "", "", ""), ("hot", 0, None, "", "", ""), ("void", 0, NAN, "", "", "")]
    got = {(r.g, r.p): r for r in percentiles.percentiles(frame(spark, data), ["g"], "x").collect()}
    assert len(got) == 7 * len(groups)
    for g, x in groups.items():
        for p in percentiles.POINTS:
            assert got[g, p].value == pytest.approx(np.quantile(x, p), abs=1e-12) and got[g, p].n == len(x) and got[g, p].rank_error == 0
    assert percentiles.percentiles(frame(spark, []), ["g"], "x").count() == 0


def test_percentiles_of_infinite_values_and_without_groups(spark):
    data = [("a", 0, v, "", "", "") for v in (-INF, 1.0, 2.0, INF)]
    got = {r.p: r.value for r in percentiles.percentiles(frame(spark, data), ["g"], "x", (0.0, 0.5, 1.0)).collect()}
    assert got == {0.0: -INF, 0.5: 1.5, 1.0: INF}
    assert percentiles.percentiles(frame(spark, data), [], "x", (0.5,)).first().value == 1.5


def test_summaries_combine_within_their_bound(spark):
    rng = np.random.default_rng(1)
    parts = {d: rng.normal(d, 1 + d, 200 * (d + 1)) for d in range(6)}
    data = [("a", d, float(round(v, 2)), "", "", "") for d, x in parts.items() for v in x]
    x = np.sort([r[2] for r in data])
    s = percentiles.summarise(frame(spark, data), ["g", "d"], "x", 0.02)
    assert s.agg(F.sum("weight")).first()[0] == len(x) and s.count() < len(x) / 5
    for r in percentiles.combine(s, ["g"], ["d"]).collect():
        assert r.n == len(x) and 0 < r.rank_error <= 0.02
        lo, hi = (np.searchsorted(x, r.value, side) for side in ("left", "right"))
        at = r.p * (len(x) - 1)
        assert lo - at <= r.rank_error * len(x) + 1 and at - hi <= r.rank_error * len(x) + 1
    exact = percentiles.combine(percentiles.summarise(frame(spark, data), ["g", "d"], "x", 1e-9), ["g"], ["d"])
    assert all(r.rank_error == 0 and r.value == pytest.approx(np.quantile(x, r.p)) for r in exact.collect())


# -- packing ----------------------------------------------------------------------------------------------------------


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 9) for i, t in texts], "doc_id bigint, text string, container_id string, piece int")


def test_packing_keeps_every_token_and_every_text_whole(spark):
    rng = np.random.default_rng(2)
    texts = [(i, " ".join(["word"] * int(rng.integers(0, 900)))) for i in range(400)] + [(1000, None), (1001, ""), (1002, "a b " * 3000), (1003, " ".join(["word"] * 128)), (1004, " ".join(["word"] * 64))]
    d = docs(spark, texts)
    count = {r.doc_id: r.n_tokens for r in packing.token_counts(d).collect()}
    out = packing.pack(d, capacity=64).collect()
    fill, pieces = {}, {}
    for r in out:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        pieces.setdefault(r.doc_id, []).append(r)
    assert max(fill.values()) <= 64 and set(pieces) == {i for i, _ in texts}
    for i, p in pieces.items():
        assert sum(r.n_tokens for r in p) == count[i] and len(p) == max(1, math.ceil(count[i] / 64))
        starts = sorted((r.start_token, r.n_tokens) for r in p)
        assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0
    q = packing.pack_quality(packing.pack(d, capacity=64), 64).first()
    assert q.containers == len(fill) and q.unused < 0.02
    assert packing.pack(d.limit(0)).count() == 0
    a, b = (sorted(map(tuple, packing.pack(d.repartition(n), capacity=64).collect())) for n in (1, 5))
    assert a == b


def test_many_blocks_and_copies(spark):
    d = docs(spark, [(i % 50, " ".join(["word"] * (i % 40))) for i in range(300)])
    out = packing.pack(d, capacity=64, block=40).groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    assert out.agg(F.max("n")).first()[0] <= 64


def test_sum_of_squares_chooses_the_least_change():
    def plain(sizes, cap):
        bins, out = [], []
        for s in sizes:
            best = None
            for gap in sorted({cap - sum(b) for b in bins if cap - sum(b) >= s}) or [None]:
                trial = [cap - sum(b) for b in bins]
                if gap is None:
                    trial.append(cap - s)
                else:
                    trial[trial.index(gap)] -= s
                cost = sum(trial.count(g) ** 2 for g in set(trial) if 0 < g < cap)
                if best is None or cost < best[0]:
                    best = (cost, gap)
            if best[1] is None:
                bins.append([s])
                out.append(cap - s)
            else:
                b = next(b for b in bins if cap - sum(b) == best[1])
                b.append(s)
                out.append(best[1] - s)
        return out, len(bins)

    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 11, 60)
    b = packing.sum_of_squares(sizes, 10)
    level, gaps = {}, []
    for s, k in zip(sizes, b):
        level[k] = level.get(k, 0) + s
        gaps.append(10 - level[k])
    want, n = plain(sizes.tolist(), 10)
    assert gaps == want and b.max() + 1 == n


def test_sum_of_squares_fills_as_well_as_tightest_fit():
    rng = np.random.default_rng(15)
    sizes = np.sort(np.minimum(rng.lognormal(6, 1, 20_000).astype(int) + 1, 2048))[::-1]
    tight = 0
    gaps: list[int] = []
    for x in sizes.tolist():
        k = bisect.bisect_left(gaps, x)
        if k == len(gaps):
            tight += 1
            bisect.insort(gaps, 2048 - x)
        else:
            bisect.insort(gaps, gaps.pop(k) - x)
    b = packing.sum_of_squares(sizes, 2048)
    fill = np.bincount(b, weights=sizes)
    assert fill.max() <= 2048 and len(fill) <= 1.002 * tight


@pytest.mark.parametrize("text", [" " * 400_000, "a" * 400_000, "\n" * 400_000, "ab " * 150_000, "あ" * 100_000, "\x00<|endoftext|>'s"])
def test_odd_and_long_texts(spark, text):
    assert packing.token_counts(docs(spark, [(1, text)])).first().n_tokens > 0


# -- leakage ----------------------------------------------------------------------------------------------------------

WORDS = [f"w{i}" for i in range(3000)]


def passages(rng, n, size=60):
    return [list(rng.choice(WORDS, size)) for _ in range(n)]


def table(spark, texts):
    return spark.createDataFrame([(i, t, 1, "clash", "clash") for i, t in texts], "doc_id bigint, text string, item_id bigint, passage string, kind string")


def items(spark, ps):
    return spark.createDataFrame([(i, p, "clash") for i, p in ps], "item_id bigint, passage string, text string")


def hits(spark, texts, ps):
    return {(r.doc_id, r.item_id): (r.n_words, r.kind) for r in leakage.leaks(table(spark, texts), items(spark, ps)).collect()}


def test_words():
    t = "The <ref name='x'>Big</ref> [[target page|Label One]] [[plain]] '''bold''' don't a&nbsp;b&#160;c &amp; X_1 ÉTÉ2"
    assert leakage.words(t) == "the big label one plain bold don t a b c x 1 été2".split()


def test_verbatim_changed_and_near_misses(spark):
    rng = np.random.default_rng(4)
    p = passages(rng, 6)
    noise = lambda n: list(rng.choice(WORDS, n))

    def edit(ws, at):
        ws = list(ws)
        for i in at:
            ws[i] = "changed"
        return ws

    left_out = [w for i, w in enumerate(p[3][:30]) if i not in (5, 11, 17, 23)]
    added = [x for i, w in enumerate(p[4][:24]) for x in ([w, "extra"] if i in (5, 11, 17) else [w])]
    texts = [
        (1, " ".join(noise(50) + p[0][10:22] + noise(50))),
        (2, " ".join(noise(50) + p[0][10:21] + noise(50))),
        (3, " ".join(noise(9) + edit(p[1][:24], (5, 11, 17, 20)) + noise(9))),
        (4, " ".join(noise(9) + edit(p[1][:24], (4, 8, 11, 14, 18, 21)) + noise(9))),
        (5, " ".join(p[2][:6]).upper() + " <b>'''" + "''' </b>&nbsp; [[gone|".join(p[2][6:14]) + "]]"),
        (6, " ".join(noise(4) + left_out + noise(4))),
        (7, " ".join(added)),
        (8, " ".join(edit(p[5], range(3, 60, 4)))),
        (9, None),
        (10, ""),
        (11, " ".join(p[0][10:16])),
        (12, " ".join(p[0][16:22])),
        (13, " ".join(noise(200_000) + p[5] + noise(1000))),
    ]
    ps = [(i, " ".join(x).capitalize() + ".") for i, x in enumerate(p)] + [(90, None), (91, ""), (92, "short one"), (0, " ".join(p[0]))]
    got = hits(spark, texts + [(14, texts[0][1])], ps)
    assert got == {(1, 0): (12, "verbatim"), (14, 0): (12, "verbatim"), (3, 1): (5, "changed"), (5, 2): (14, "verbatim"), (6, 3): (6, "changed"), (7, 4): (6, "changed"), (13, 5): (60, "verbatim")}


def test_against_every_alignment(spark):
    rng = np.random.default_rng(5)
    p = passages(rng, 4, 40)
    texts = []
    for k in range(80):
        ws = list(p[k % 4][rng.integers(0, 10) :])
        for _ in range(rng.integers(0, 11)):
            i = int(rng.integers(0, len(ws)))
            kind = rng.integers(0, 3)
            ws = ws[:i] + ([] if kind == 0 else ["z"] if kind == 1 else [ws[i], "z"]) + ws[i + 1 :]
        texts.append((k, " ".join(["q"] * 5 + ws + ["q"] * 5)))

    def plain(P, D):
        for i in range(len(P) - 11):
            if any(P[i : i + 12] == D[j : j + 12] for j in range(len(D) - 11)):
                return True
        for a in range(len(P)):
            row = [0] * (len(D) + 1)
            for b in range(a, len(P)):
                new = [row[0] + 1]
                for j in range(1, len(D) + 1):
                    new.append(min(row[j - 1] + (D[j - 1] != P[b]), row[j] + 1, new[-1] + 1))
                row = new
                if b - a + 1 >= 24 and 6 * min(row) <= b - a + 1:
                    return True
        return False

    want = {(k, i) for k, t in texts for i, w in enumerate(p) if plain(w, t.split())}
    got = set(hits(spark, texts, [(i, " ".join(w)) for i, w in enumerate(p)]))
    assert got == want and 10 < len(want) < 75


def test_shards_blocks_and_empty_tables(spark, monkeypatch):
    rng = np.random.default_rng(6)
    p = passages(rng, 5)
    texts = [(i, " ".join(list(rng.choice(WORDS, 100)) + p[i % 5][5:30])) for i in range(60)]
    ps = [(i, " ".join(x)) for i, x in enumerate(p)]
    whole = hits(spark, texts, ps)
    assert set(whole) == {(i, i % 5) for i in range(60)}
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 300)
    assert len(list(leakage._blocks(items(spark, ps)))) > 2 and hits(spark, texts, ps) == whole
    assert hits(spark, [], ps) == {} and hits(spark, texts, []) == {}
    left = leakage.clean_documents(table(spark, texts + [(None, "x"), (99, None)]), items(spark, ps))
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 99]


def test_long_texts_in_stretches(spark, monkeypatch):
    rng = np.random.default_rng(11)
    p = passages(rng, 3, 50)
    ws = list(rng.choice(WORDS, 4000))
    changed = [w if i % 8 else "z" for i, w in enumerate(p[2])]
    for at, x in ((990, p[0][:30]), (1985, p[1]), (2970, changed)):
        ws[at : at + len(x)] = x
    want = hits(spark, [(1, " ".join(ws))], [(i, " ".join(x)) for i, x in enumerate(p)])
    assert want == {(1, 0): (30, "verbatim"), (1, 1): (50, "verbatim"), (1, 2): (7, "changed")}
    monkeypatch.setattr(leakage, "SHARD_WORDS", 1000)
    assert hits(spark, [(1, " ".join(ws))], [(i, " ".join(x)) for i, x in enumerate(p)]) == want


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(13)
    p = leakage._Passages([(i, " ".join(rng.choice(list("abc"), 40))) for i in range(3)])
    train = rng.integers(0, 4, 400)
    s = leakage._Suffixes(train, p)
    whole = [tuple(s.ids[i : i + s.rest[i]][:40].tolist()) for i in range(len(s.ids))]
    at = np.flatnonzero(s.rest > 0)
    order = at[np.argsort(s.rank[-1][at], kind="stable")]
    assert [whole[i] for i in order] == sorted(whole[i] for i in at)
    i, j = rng.choice(at, 2000), rng.choice(at, 2000)
    for a, b, n in zip(i, j, s.common(i, j)):
        k = 0
        while k < min(len(whole[a]), len(whole[b])) and whole[a][k] == whole[b][k]:
            k += 1
        assert min(n, 40) == k
    # What was left out can't match: every window of four words of the shard that a passage has is still there.
    have = {tuple(p.ids[k : k + 4]) for k in range(len(p.ids) - 3) if (p.ids[k : k + 4] > 0).all()}
    kept = set(s.origin[s.rest[: s.size] > 0].tolist())
    assert all(k in kept for k in range(397) if tuple(train[k : k + 4]) in have)


def test_equal_words_stay_small():
    p = leakage._Passages([(i, " ".join(["a"] * 200)) for i in range(50)])
    train = np.array([1] * 9000 + [0])
    tracemalloc.start()
    got = leakage._shard([7], [0], [9001], train, p)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(7, i, 200, 0, 0, "verbatim") for i in range(50)] and most < 100e6


def test_locations(spark):
    rng = np.random.default_rng(14)
    p = passages(rng, 2)
    noise = list(rng.choice(WORDS, 300))
    changed = [w if i % 8 else "z" for i, w in enumerate(p[1])]
    got = {(r.doc_id, r.item_id): r for r in leakage.leaks(table(spark, [(1, " ".join(noise + p[0][20:45] + noise + p[0][5:18])), (2, " ".join(noise[:50] + changed))]), items(spark, [(i, " ".join(x)) for i, x in enumerate(p)])).collect()}
    a, b = got[1, 0], got[2, 1]
    assert (a.n_words, a.text_word, a.passage_word, a.kind) == (25, 300, 20, "verbatim")
    assert (b.n_words, b.text_word, b.passage_word, b.kind) == (7, 51, 1, "changed")


# -- spans ------------------------------------------------------------------------------------------------------------


def pages(spark, data):
    return spark.createDataFrame([(p, d, t, 1, "clash") for p, d, t in data], "page_id bigint, doc_id bigint, text string, place int, h string")


def text(rng, n):
    return "".join(rng.choice(list("abcdefghij é日\n"), n))


def shared(data, k=200):
    seen = {}
    for p, _, t in data:
        if p is not None and t:
            for i in range(len(t) - k + 1):
                seen.setdefault(t[i : i + k], set()).add(p)
    return {(a, b) for s in seen.values() for a in s for b in s if a < b}


def fixture(rng):
    base = [text(rng, 900) for _ in range(12)]
    data = [(i, i, t) for i, t in enumerate(base)]
    data.append((100, 100, text(rng, 50) + base[0][100:300] + text(rng, 50)))  # just long enough
    data.append((101, 101, text(rng, 50) + base[1][100:299] + "#" + text(rng, 50)))  # one short
    data.append((102, 102, base[2][:200]))  # whole text
    data.append((103, 103, base[3][-250:] + base[4][:220]))  # two partners
    data.append((5, 104, base[5] + "more"))  # another revision of the same page
    data += [(200 + i, 200 + i, text(rng, 30) + base[6][300:520] + text(rng, 30)) for i in range(5)]  # boilerplate
    data += [(300, 300, "x" * 1000), (301, 301, "x" * 199), (302, 302, "x" * 200), (303, 303, "ab" * 400), (304, 304, "ba" * 100)]
    data += [(400, 400, None), (401, 401, ""), (None, 402, base[0]), (403, 403, "𝒜" * 3 + base[7][:230])]
    return data


@pytest.mark.parametrize("anchor", [64, 100, 200])
def test_sharing_pages(spark, anchor):
    data = fixture(np.random.default_rng(7))
    got = spans.sharing_pages(pages(spark, data), anchor=anchor).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == shared(data)
    assert spans.sharing_pages(pages(spark, [])).count() == 0


def test_sharing_pages_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(spans, "STRETCH", 150)
    monkeypatch.setattr(spans, "BATCH_CHARS", 400)
    data = fixture(np.random.default_rng(12))
    assert {tuple(r) for r in spans.sharing_pages(pages(spark, data)).collect()} == shared(data)


def test_spans_and_shares(spark):
    data = fixture(np.random.default_rng(8))
    want = {}
    for p, d, t in data:
        if p is None or not t:
            continue
        others = {u[i : i + 200] for q, _, u in data if q is not None and q != p and u for i in range(len(u) - 199)}
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if t[i : i + 200] in others:
                mask[i : i + 200] = True
        want[d] = int(mask.sum())
    got = {r.doc_id: r for r in spans.shared_shares(pages(spark, data)).collect()}
    assert {d: got[d].shared_chars for d in want} == want
    assert got[400].share is None and got[401].n_chars == 0 and got[302].share == 1.0
    assert {tuple(r) for r in spans.shared_spans(pages(spark, data)).collect()} == repeats(data)


def repeats(data, k=200):
    """(doc, start, end, partners) of all maximal spans, page by page."""
    has = {}
    for p, _, t in data:
        if p is not None and t:
            for n in (k, k + 1):
                for i in range(len(t) - n + 1):
                    has.setdefault(t[i : i + n], set()).add(p)
    out = {}
    for p, d, t in data:
        if p is None or not t:
            continue
        open_ = {}
        for i in range(len(t) - k + 2):
            here = has[t[i : i + k]] - {p} if i + k <= len(t) else set()
            on = has[t[i - 1 : i + k]] - {p} if i and i + k <= len(t) else set()
            for x in [x for x in open_ if x not in on]:
                out.setdefault((d, open_.pop(x), i + k - 1), set()).add(x)
            for x in here - set(open_):
                open_[x] = i
    return {(*key, len(v)) for key, v in out.items()}


def test_spans_of_several_partners_stay_apart(spark):
    rng = np.random.default_rng(16)
    a = text(rng, 900)
    data = [(1, 1, a), (2, 2, "#" * 40 + a[:300]), (3, 3, a[250:600] + "#" * 40), (4, 4, "#" * 9 + a[50:450] + "#" * 9), (5, 5, a[50:450]), (5, 6, a[:450]), (6, 7, a)]
    got = {tuple(r) for r in spans.shared_spans(pages(spark, data)).collect()}
    assert got == repeats(data) and {(1, 0, 300, 1), (1, 250, 600, 1), (1, 50, 450, 1), (1, 0, 450, 1), (1, 0, 900, 1)} <= got
    assert spans.shared_spans(pages(spark, [])).count() == 0 and spans.shared_shares(pages(spark, [])).count() == 0


def test_winnowing_keeps_an_anchor_of_every_shared_span():
    rng = np.random.default_rng(9)
    span = text(rng, 200)
    for _ in range(20):
        a, b = text(rng, int(rng.integers(0, 400))) + span + text(rng, 90), text(rng, int(rng.integers(0, 400))) + span
        w = spans.winnow([a, b, "short"])
        both = [set(w[2][(w[0] == i)]) for i in (0, 1)]
        assert both[0] & both[1] and not (w[0] == 2).any()


def test_very_long_text_is_taken_in_stretches(monkeypatch):
    monkeypatch.setattr(spans, "_PLACE_BITS", np.uint64(10))
    t = text(np.random.default_rng(10), 5000)
    w = spans.winnow([t])
    assert w[1].min() < 200 and w[1].max() > 4700 and np.diff(np.sort(w[1])).max() <= 137
    alone = spans.winnow([t[3000:3400]])
    assert set(alone[2]) & set(w[2])


# -- registered queries -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_queries_run(spark, name):
    df = registered.queries()[name](spark, SMALL)
    assert df.count() == df.distinct().count()


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("results", "samples", "documents", "eval_items"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    key = lambda rows, cols: sorted([tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in (r[c] for c in cols)) for r in rows])
    a = [r.asDict() for r in registered.queries()[name](spark, SMALL).collect()]
    b = con.sql(registered.oracle_sql()[name]).df().to_dict("records")
    assert key(a, sorted(a[0])) == key(b, sorted(a[0])) and dt
