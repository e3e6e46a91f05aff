"""Problem 8: long exact spans shared between records.

Seeds are winnowed anchors: of the hashes of all ``ANCHOR``-character windows the least of every run of
``length - ANCHOR + 1`` is kept, so any span of ``length`` characters that two texts share holds an anchor of both. The
anchors of different pages are joined by hash; only where a hash occurs in more than one page are they extended, both
ways, to every span of ``length`` characters that has them as its least anchor, and to that span's next character. Anchors
with the same neighbourhood are one, whatever the number of their copies, and carry the set of their pages as a mergeable
signature, so no two records are ever compared pair by pair. ``sharing_pages`` pairs pages where their sets meet in a
span, compared character by character. ``shared_spans`` goes on from there: a span is extended as long as a page that has
it has the next character too, and where the last does or a page comes or goes, its maximal repeat ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import map_arrow, written

LENGTH = 200  # fixed by the problem statement
ANCHOR = 64
BATCH_CHARS = 1_000_000
#: Longer texts are taken in stretches of so many characters, each seeing two lengths of its neighbours.
STRETCH = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PLACE_BITS = np.uint64(24)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Hashes:
    """Rolling 64-bit hashes of all windows of an array of characters."""

    def __init__(self, chars: np.ndarray):
        n = len(chars)
        power = np.empty(n + 1, np.uint64)
        power[0] = 1
        power[1:] = _BASE
        np.multiply.accumulate(power, out=power)
        self.back = np.full(n + 1, _INVERSE, np.uint64)
        self.back[0] = 1
        np.multiply.accumulate(self.back, out=self.back)
        self.upto = np.zeros(n + 1, np.uint64)
        np.cumsum(_mix(chars.astype(np.uint64) + _M2) * power[:n], out=self.upto[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.upto[end] - self.upto[start]) * self.back[start])


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w successive values, from running minima within blocks of w."""
    n = len(x) - w + 1
    pad = (-len(x)) % w
    y = np.concatenate((x, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, w)
    right = np.minimum.accumulate(y, axis=1).ravel()
    left = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[:n], right[w - 1 : w - 1 + n])


def winnow(texts: list[str], length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(text, place, hash of the anchor, hash of its neighbourhood) of the winnowed anchors of texts of at least ``length``.

    Windows that cross from one text into the next only add anchors; the extension settles what they are worth. Of equal
    hashes the first in a window is kept, in every text alike.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    none = np.zeros(0, np.int64)
    if len(chars) < length:
        return none, none, none, none
    h = _Hashes(chars)
    at = np.arange(len(chars) - anchor + 1)
    grams = h.of(at, at + anchor)
    low = np.uint64((1 << int(_PLACE_BITS)) - 1)
    picked = []
    w = length - anchor + 1
    # A place fits the low bits: longer texts are taken in overlapping stretches.
    most = 1 << int(_PLACE_BITS)
    for s in range(0, len(grams), most - w):
        part = grams[s : s + most]
        if len(part) < w:
            break
        tagged = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        picked.append(np.unique(_window_min(tagged, w) & low).astype(np.int64) + s)
    pos = np.unique(np.concatenate(picked)) if picked else none
    text = np.searchsorted(starts, pos, side="right") - 1
    inside = (pos + anchor <= starts[text + 1]) & (sizes[text] >= length)
    pos, text = pos[inside], text[inside]
    lo, hi = np.maximum(pos - (length - anchor), starts[text]), np.minimum(pos + length + 1, starts[text + 1])
    around = _mix(h.of(lo, hi) + (pos - lo).astype(np.uint64) * _M1 + (hi - pos).astype(np.uint64) * _M2)
    return text, pos - starts[text], grams[pos].view(np.int64), around.view(np.int64)


_OCC = "page_id bigint, doc_id bigint, place int, h bigint, around bigint"


def _occurrences(documents: DataFrame, length: int, anchor: int, once: bool) -> DataFrame:
    """Anchors of all texts; with ``once``, of those that look alike in one page one per batch."""

    def batch(held: list) -> pa.RecordBatch:
        page, doc, texts, offset, lo, hi = (list(x) for x in zip(*held))
        t, place, h, around = winnow(texts, length, anchor)
        whole = place + np.array(offset, np.int64)[t]
        core = (whole >= np.array(lo, np.int64)[t]) & (whole < np.array(hi, np.int64)[t])
        t, place, h, around = t[core], whole[core], h[core], around[core]
        p, d = np.array(page, np.int64)[t], np.array(doc, np.int64)[t]
        if once and len(t):
            # The neighbourhood's hash stands for the anchor's: both name the same characters.
            order = np.lexsort((around, p))
            first = np.ones(len(order), bool)
            first[1:] = (p[order][1:] != p[order][:-1]) | (around[order][1:] != around[order][:-1])
            keep = order[first]
            p, d, place, h, around = p[keep], d[keep], place[keep], h[keep], around[keep]
        return pa.RecordBatch.from_arrays([pa.array(p), pa.array(d), pa.array(place.astype(np.int32)), pa.array(h), pa.array(around)], names=["page_id", "doc_id", "place", "h", "around"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for p, d, t in zip(b["page_id"].to_pylist(), b["doc_id"].to_pylist(), b["text"].to_pylist()):
                for s in range(0, len(t), STRETCH):
                    begin = max(0, s - 2 * length)
                    part = t[begin : s + STRETCH + 2 * length] if len(t) > STRETCH else t
                    held.append((p, d, part, begin, s, s + STRETCH))
                    size += len(part)
                    if size >= BATCH_CHARS:
                        yield batch(held)
                        held, size = [], 0
        if held:
            yield batch(held)

    used = documents.where(F.col("page_id").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") >= length))
    return map_arrow(used.select("page_id", "doc_id", "text"), run, _OCC)


#: So many ids at most are sent to all tasks (4 MB) to leave out rows before they move; beyond that nothing is left out.
IDS = 500_000


def _pruned(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` is among ``ids`` (one column), where these are few enough to be sent to all tasks."""
    ids = written(ids.distinct().toDF("__id"), "ids")
    return df.join(F.broadcast(ids), F.col(column) == F.col("__id"), "left_semi") if ids.count() <= IDS else df


def _neighbourhoods(distinct: DataFrame) -> DataFrame:
    """Anchors by neighbourhood: h, around, a place to read it at (doc_id, place), its pages' range lo..hi and their set ``ps``.

    Only those whose anchor occurs in more than one page. Two sets of pages have the same ``ps`` where number, sum and
    exclusive or of the pages' hashes and their range agree.
    """
    c = distinct.groupBy("h", "around").agg(
        F.min(F.struct("doc_id", "place")).alias("rep"),
        F.count("*").alias("n"),
        F.sum(F.xxhash64("page_id").cast("decimal(38,0)")).alias("s"),
        F.bit_xor(F.xxhash64("page_id", F.lit(1))).alias("x"),
        F.min("page_id").alias("lo"),
        F.max("page_id").alias("hi"),
    )
    c = written(c.select("h", "around", "rep.doc_id", "rep.place", "lo", "hi", F.xxhash64("n", F.col("s").cast("string"), "x", "lo", "hi").alias("ps")), "neighbourhoods")
    shared = c.groupBy("h").agg(F.min("lo").alias("a"), F.max("hi").alias("b")).where("a < b").select(F.col("h").alias("__h"))
    return written(c.join(shared, F.col("h") == F.col("__h"), "left_semi"), "seeds")


_OWN = ("around", "lo", "hi", "ps")
_WINDOWS = "h bigint, left int, w bigint, w1 bigint, doc_id bigint, start int, around bigint, lo bigint, hi bigint, ps bigint"


def _extended(seeds: DataFrame, documents: DataFrame, length: int, anchor: int) -> DataFrame:
    """Each seed extended both ways to every ``length`` characters that hold it as their least anchor.

    h, left (characters before the anchor), the span's hash w and that of one character more (w1, null at a text's end),
    where it was read (doc_id, start), and the seed's around, lo, hi, ps. A span has one least anchor, in every text.
    """
    by_doc = seeds.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_list(F.struct("h", "place", *_OWN)).alias("anchors"))  # as many as one text has
    by_doc = written(by_doc, "seeds-by-text")  # of known size, so that Spark can tell whether the texts need to move
    low = np.uint64((1 << int(_PLACE_BITS)) - 1)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text, anchors in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["anchors"].to_pylist()):
                anchors.sort(key=lambda a: a["place"])
                h, place, *own = (np.array([a[k] for a in anchors], np.int64) for k in ("h", "place", *_OWN))
                s = 0
                while s < len(h):
                    # Anchors near each other share the hashes of the stretch around them.
                    e = min(s + 2000, int(np.searchsorted(place, place[s] + STRETCH)))
                    base = max(0, int(place[s]) - length)
                    part = np.frombuffer(text[base : int(place[e - 1]) + length + 1].encode("utf-32-le", "surrogatepass"), np.uint32)
                    hashes = _Hashes(part)
                    at = np.arange(len(part) - anchor + 1)
                    least = (_window_min((hashes.of(at, at + anchor) & ~low) | at.astype(np.uint64), length - anchor + 1) & low).astype(np.int64)
                    begin = np.arange(len(least))
                    k = np.minimum(np.searchsorted(place[s:e], least + base), e - s - 1)
                    begin = begin[place[s:e][k] == least + base]
                    k = k[begin] + s
                    more = np.minimum(begin + length + 1, len(part))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(h[k]),
                            pa.array((least[begin] - begin).astype(np.int32)),
                            pa.array(hashes.of(begin, begin + length).view(np.int64)),
                            pa.array(hashes.of(begin, more).view(np.int64), mask=begin + length + 1 > len(part)),
                            pa.array(np.full(len(k), doc)),
                            pa.array((begin + base).astype(np.int32)),
                            *[pa.array(x[k]) for x in own],
                        ],
                        names=[f.split()[0] for f in _WINDOWS.split(", ")],
                    )
                    s = e

    texts = _pruned(documents.where(F.col("page_id").isNotNull()).select("doc_id", "text"), "doc_id", by_doc.select("__doc"))
    return map_arrow(texts.join(by_doc, F.col("doc_id") == F.col("__doc")).select("doc_id", "text", "anchors"), extend, _WINDOWS)


def _distinct_anchors(occurrences: DataFrame) -> DataFrame:
    rep = occurrences.groupBy("h", "page_id", "around").agg(F.min(F.struct("doc_id", "place")).alias("rep"))
    return rep.select("h", "page_id", "around", "rep.doc_id", "rep.place")


def _set_of_sets() -> list[Column]:
    return [F.count("*").alias("n"), F.sum(F.col("ps").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("ps")).alias("x"), F.min("ps").alias("a"), F.max("ps").alias("b")]


def _pages_of(distinct: DataFrame, seeds: DataFrame) -> DataFrame:
    """The pages of each set ``ps``, read from one neighbourhood that has it."""
    named = seeds.groupBy("ps").agg(F.min(F.struct("h", "around")).alias("k")).select("ps", F.col("k.h").alias("__h"), F.col("k.around").alias("__r"))
    return distinct.join(named, (F.col("h") == F.col("__h")) & (F.col("around") == F.col("__r"))).select("ps", "page_id")


def sharing_pages(documents: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """page_id_a < page_id_b of the pages of which some revisions share at least ``length`` consecutive characters.

    Characters are code points of the text as it is. Rows with null page_id, doc_id or text and texts shorter than
    ``length`` share nothing. Repeated revisions and copies within a page count once. An empty table gives no rows.
    """
    distinct = written(_distinct_anchors(_occurrences(documents, length, anchor, once=True)), "anchors")
    seeds = _neighbourhoods(distinct)
    span = ["h", "left", "w"]
    seen = _extended(seeds, documents, length, anchor).groupBy(*span, "ps", "lo", "hi").agg(F.min(F.struct("doc_id", "start")).alias("rep"))
    seen = written(seen.select(*span, "ps", "lo", "hi", "rep.doc_id", "rep.start"), "spans")
    # Sets of pages that meet: in one span two different sets, or one set of several pages with itself.
    classes = seen.groupBy(*span).agg(*_set_of_sets()).where("n > 1")
    kept = classes.groupBy("n", "s", "x", "a", "b").agg(F.min(F.struct(*span)).alias("k")).select("k.*")
    member = written(seen.join(kept, span).select(*span, "ps", F.col("doc_id").alias("__doc"), "start"), "meetings")
    # What meets by hash is compared character by character.
    read = _pruned(documents.select("doc_id", "text"), "doc_id", member.select("__doc")).join(member, F.col("doc_id") == F.col("__doc"))
    read = read.select(*span, "ps", F.expr(f"substring(text, start + 1, {length})").alias("chars"))
    cross = read.withColumnRenamed("ps", "ps_a").join(read.withColumnRenamed("ps", "ps_b"), [*span, "chars"]).where("ps_a < ps_b").select("ps_a", "ps_b")
    alone = seen.where("lo < hi").select(F.col("ps").alias("ps_a"), F.col("ps").alias("ps_b"))
    met = cross.unionByName(alone).distinct()
    pages = _pages_of(distinct, seeds)
    a = pages.select(F.col("ps").alias("ps_a"), F.col("page_id").alias("pa"))
    b = pages.select(F.col("ps").alias("ps_b"), F.col("page_id").alias("pb"))
    both = met.join(a, "ps_a").join(b, "ps_b").where("pa <> pb")
    return both.select(F.least("pa", "pb").alias("page_id_a"), F.greatest("pa", "pb").alias("page_id_b")).distinct()


class _Repeats:
    """Where the texts' spans of ``length`` characters are shared, as stretches with one set of pages each."""

    def __init__(self, documents: DataFrame, length: int, anchor: int):
        self.length = length
        occurrences = written(_occurrences(documents, length, anchor, once=False), "occurrences")
        self.distinct = written(_distinct_anchors(occurrences), "anchors")
        self.seeds = _neighbourhoods(self.distinct)
        self.spans = written(_extended(self.seeds, documents, length, anchor), "spans")
        self.sets = {w: written(self._sets(w), f"sets-{w}") for w in ("w", "w1")}
        p = self.sets["w"].select("h", "left", "w", F.col("set").alias("p"))
        e = self.sets["w1"].select("h", "left", "w1", F.col("set").alias("e"))
        x = self.spans.select("h", "left", "w", "w1", "around").join(p, ["h", "left", "w"]).join(e, ["h", "left", "w1"], "left").distinct()
        # Spans that follow each other in a neighbourhood and are extended by all pages that have them are one stretch.
        o = Window.partitionBy("h", "around").orderBy(F.desc("left"))  # at most length - anchor + 1
        same = (F.lag("left").over(o) == F.col("left") + 1) & (F.lag("p").over(o) == F.col("p")) & (F.lag("e").over(o) == F.col("p"))
        x = x.withColumn("k", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("k", F.sum("k").over(o))
        x = x.groupBy("h", "around", "k").agg(F.max("left").alias("first"), F.min("left").alias("last"), F.max("p").alias("p"), F.min_by("e", "left").alias("e"))
        x = written(x.select(F.col("h").alias("__h"), F.col("around").alias("__r"), "first", "last", "p", "e"), "stretches")
        j = _pruned(occurrences, "h", x.select("__h")).join(x, (F.col("h") == F.col("__h")) & (F.col("around") == F.col("__r")))
        j = j.select("page_id", "doc_id", (F.col("place") - F.col("first")).alias("s0"), (F.col("place") - F.col("last")).alias("s1"), "p", "e")
        o = Window.partitionBy("doc_id").orderBy("s0")  # the stretches of one text
        follows = F.coalesce((F.lag("s1").over(o) == F.col("s0") - 1) & F.lag("e").over(o).isNotNull(), F.lit(False))
        same = follows & (F.lag("p").over(o) == F.col("p")) & F.coalesce(F.lag("e").over(o) == F.col("p"), F.lit(False))
        j = j.select("*", F.when(follows, 0).otherwise(1).alias("new"), F.when(same, 0).otherwise(1).alias("step"))
        j = j.withColumn("chain", F.sum("new").over(o)).withColumn("seg", F.sum("step").over(o))
        m = j.groupBy("page_id", "doc_id", "chain", "seg").agg(F.min("s0").alias("s0"), F.max("s1").alias("s1"), F.max("p").alias("p"), F.max_by("e", "s0").alias("e"))
        parts = F.sort_array(F.collect_list(F.struct("s0", "s1", "p", "e"))).alias("parts")  # of one text
        self.chains = m.groupBy("page_id", "doc_id", "chain").agg(F.min("s0").alias("start"), (F.max("s1") + length).alias("end"), parts)

    def _sets(self, w: str) -> DataFrame:
        """The spans (of ``length`` characters, or one more) that several pages have, with the set of these pages."""
        g = self.spans.where(F.col(w).isNotNull()).groupBy("h", "left", w, "ps").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        g = g.groupBy("h", "left", w).agg(*_set_of_sets(), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
        return g.select("h", "left", w, F.xxhash64("n", F.col("s").cast("string"), "x", "a", "b").alias("set"))

    def members(self) -> DataFrame:
        """The pages of each set of :meth:`_sets`."""
        out = None
        for w, sets in self.sets.items():
            k = sets.groupBy("set").agg(F.min(F.struct("h", "left", w)).alias("k")).select("set", "k.*")
            one = self.spans.select("h", "left", w, "ps").join(k, ["h", "left", w]).select("set", "ps").distinct()
            out = one if out is None else out.unionByName(one)
        return out.distinct().join(_pages_of(self.distinct, self.seeds), "ps").select("set", "page_id").distinct()


def shared_spans(documents: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, start, end of the maximal spans that each revision shares with other pages, and n_partners: how many.

    A span is maximal for a page that has it where that page has no character more on either side; spans that several
    pages have in the same extent come once, those of different extents each, whether they overlap or not. A page has
    what its revisions have. Where all partners of a stretch agree no page is looked at; only where partners come or go
    within it are their pages followed, once for all texts that have the same stretch.
    """
    r = _Repeats(documents, length, anchor)
    chains = written(r.chains, "chains")
    members = written(r.members(), "members")
    sizes = members.groupBy("set").agg(F.count("*").alias("n"))
    single = chains.where(F.size("parts") == 1).withColumn("__set", F.col("parts")[0]["p"])
    single = single.join(sizes, F.col("__set") == F.col("set")).select("doc_id", "start", "end", (F.col("n") - 1).alias("n_partners"))
    many = chains.where(F.size("parts") > 1)
    shape = F.transform("parts", lambda x: F.struct((x["s0"] - F.col("start")).alias("s0"), (x["s1"] - F.col("start")).alias("s1"), x["p"].alias("p"), x["e"].alias("e")))
    many = many.withColumn("shape", F.xxhash64(shape))
    each = many.groupBy("shape").agg(F.first("parts").alias("parts")).select("shape", F.posexplode("parts").alias("k", "x")).select("shape", "k", "x.p", "x.e")
    has = each.join(members, F.col("p") == F.col("set")).select("shape", "k", "page_id")
    on = each.where(F.col("e").isNotNull()).join(members, F.col("e") == F.col("set")).select("shape", "k", "page_id", F.lit(True).alias("on"))
    o = Window.partitionBy("shape", "page_id").orderBy("k")  # one page in one stretch
    j = has.join(on, ["shape", "k", "page_id"], "left")
    follows = F.coalesce((F.lag("k").over(o) == F.col("k") - 1) & F.lag("on").over(o), F.lit(False))
    j = j.withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("run", F.sum("new").over(o))
    runs = j.groupBy("shape", "page_id", "run").agg(F.min("k").alias("k0"), F.max("k").alias("k1"))
    runs = runs.groupBy("shape", "k0", "k1").agg(F.count_distinct("page_id").alias("n"))
    # A text's own page has the whole stretch.
    whole = (F.col("k0") == 0) & (F.col("k1") == F.size("parts") - 1)
    found = many.join(runs, "shape").select("doc_id", F.expr("parts[k0].s0").alias("start"), (F.expr("parts[k1].s1") + length).alias("end"), (F.col("n") - F.when(whole, 1).otherwise(0)).alias("n_partners"))
    return single.unionByName(found.where("n_partners > 0"))


def shared_shares(documents: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_chars, shared_chars and share of every revision; null and empty texts have a null share."""
    o = Window.partitionBy("doc_id").orderBy("start")  # the stretches of one text
    fresh = F.col("end") - F.greatest(F.col("start"), F.coalesce(F.lag("end").over(o), F.lit(0)))
    spans = _Repeats(documents, length, anchor).chains.select("doc_id", fresh.alias("fresh")).groupBy(F.col("doc_id").alias("__doc")).agg(F.sum("fresh").alias("chars"))
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    x = documents.select("doc_id", n.alias("n_chars")).join(spans, F.col("doc_id") == F.col("__doc"), "left")
    chars = F.coalesce("chars", F.lit(0)).cast("long")
    return x.select("doc_id", "n_chars", chars.alias("shared_chars"), F.try_divide(chars, F.col("n_chars")).alias("share"))
