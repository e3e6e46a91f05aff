"""Problem 7: evaluation texts leaking into training text.

Each task cuts its documents into shards and builds the suffix array of a shard's words by prefix doubling, down to the
length of the longest passage. Every suffix of every test passage is binary-searched in it for the interval of suffixes
that begin with the same words; the lengths of longest common prefixes come by binary descent over the doubling's ranks.
Intervals are met as groups and laid out in bounded pieces, so that frequent phrases don't multiply. Matches too short to
count by themselves seed an exact check for stretches with few changed words. Documents never leave the task that reads
them: no shuffle, no group, and skewed pages cost nothing extra.

Test passages are the stated query set. They go to the tasks in blocks of bounded size, one pass over the documents each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow, written

# Limits fixed by the problem statement.
VERBATIM = 12
STRETCH = 24
ONE_IN = 6

SEED = 4  # a stretch of 24 words with at most 4 changed keeps 4 in a row
LEAST_SEEDS = STRETCH - SEED + 1 - SEED * (STRETCH // ONE_IN)  # and at least so many such seeds
REACH = 2 * STRETCH - 1  # a longer stretch holds a shorter one that counts too
BAND = REACH // ONE_IN + 1
SHARD_WORDS = 1_000_000
BLOCK_CHARS = 8_000_000

_TAG = re.compile(r"<[^<>]*>")
_TARGET = re.compile(r"\[\[[^\[\]|]*\|")
_QUOTES = re.compile(r"''+")
_ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters or digits in lower case; tags, targets of piped links, apostrophe pairs and entities don't count."""
    text = _TAG.sub(" ", text)
    text = _TARGET.sub(" ", text)
    text = _QUOTES.sub(" ", text)
    text = _ENTITY.sub(" ", text)
    return _WORD.findall(text.lower())


def _dense(codes: np.ndarray) -> np.ndarray:
    """Order-preserving ranks from 1."""
    order = np.argsort(codes, kind="stable")
    s = codes[order]
    step = np.ones(len(s), np.int64)
    step[1:] = s[1:] != s[:-1]
    out = np.empty(len(s), np.int64)
    out[order] = np.cumsum(step)
    return out


class _Passages:
    """The words of a block of test passages, numbered in their sorted order, and the 2- and 4-word windows they have."""

    def __init__(self, items: list[tuple[int, str]]):
        cut = [(i, words(p)) for i, p in items]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in cut for w in ws}))}
        ids, item, place = [], [], []
        for i, ws in cut:
            ids += [self.vocabulary[w] for w in ws] + [0]
            item += [i] * (len(ws) + 1)
            place += list(range(len(ws) + 1))
        self.ids, self.item, self.place = (np.array(x, np.int64) for x in (ids, item, place))
        self.longest = int(self.place.max(initial=0))
        self.twos = np.unique(self._twos(self.ids)[0])
        self.fours = np.unique(self._fours(self._ranks(self.ids))[0])

    def _twos(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        return ids[at] * (len(self.vocabulary) + 1) + ids[at + 1], at

    def _ranks(self, ids: np.ndarray) -> np.ndarray:
        code, at = self._twos(ids)
        out = np.zeros(len(ids), np.int64)
        if len(self.twos):
            k = np.minimum(np.searchsorted(self.twos, code), len(self.twos) - 1)
            out[at] = np.where(self.twos[k] == code, k + 1, 0)
        return out

    def _fours(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero((ranks[:-2] > 0) & (ranks[2:] > 0))
        return ranks[at] * (len(self.twos) + 1) + ranks[at + 2], at

    def covered(self, train: np.ndarray) -> np.ndarray:
        """The places of a shard that lie in windows of SEED words which some passage has."""
        hit = np.zeros(len(train) + SEED, bool)
        if len(self.fours) and len(train) > SEED:
            code, at = self._fours(self._ranks(train))
            k = np.minimum(np.searchsorted(self.fours, code), len(self.fours) - 1)
            hit[at[self.fours[k] == code]] = True
        for step in (1, 2):
            hit[step:] |= hit[:-step].copy()
        return np.flatnonzero(hit[: len(train)])


class _Suffixes:
    """Suffix array of a shard, with the passages ranked beside it: ``rank[k]`` orders suffixes by their first 2^k words.

    Of the shard only runs of words are kept that lie in windows of SEED words of some passage: no suffix that starts
    elsewhere can match one. A 0 ends each run and each passage; what lies beyond it doesn't count.
    """

    def __init__(self, train: np.ndarray, p: _Passages):
        place = p.covered(train)
        gap = np.ones(len(place), np.int64)
        gap[1:] = place[1:] != place[:-1] + 1
        at = np.arange(len(place)) + np.cumsum(gap)
        size = int(at[-1]) + 2 if len(at) else 1
        self.ids = np.concatenate((np.zeros(size, np.int64), p.ids))
        self.ids[at] = train[place]
        self.origin = np.zeros(size, np.int64)
        self.origin[at] = place
        self.size = size
        zero = np.where(self.ids == 0, np.arange(len(self.ids)), len(self.ids))
        self.rest = np.minimum.accumulate(zero[::-1])[::-1] - np.arange(len(self.ids))
        self.before = np.concatenate(([0], self.ids[:-1]))
        self.rank = [self.ids]
        while 1 << (len(self.rank) - 1) < max(p.longest, VERBATIM):
            self.rank.append(_dense(self.pair(len(self.rank) - 1, len(self.rank) - 1)))

    def pair(self, k: int, m: int) -> np.ndarray:
        """Order of all suffixes by their first 2^k + 2^m words (m at most k)."""
        span = 1 << k
        nxt = np.zeros(len(self.ids), np.int64)
        nxt[:-span] = self.rank[m][span:]
        nxt[self.rest < span] = 0
        return self.rank[k] * (int(self.rank[m].max()) + 1) + nxt

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes i and j, by binary descent over the ranks."""
        most = np.minimum(self.rest[i], self.rest[j])
        off = np.zeros(len(i), np.int64)
        top = len(self.ids) - 1
        for k in range(len(self.rank) - 1, -1, -1):
            same = (off < most) & (self.rank[k][np.minimum(i + off, top)] == self.rank[k][np.minimum(j + off, top)])
            off[same] += 1 << k
        return np.minimum(off, most)


def _errors(train: np.ndarray, p: _Passages, at: np.ndarray, q: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: int) -> np.ndarray:
    """Fewest changes that align the 0..REACH passage words from q on (or back from q - 1) with the text [lo, hi) at the place."""
    n, width = len(at), 2 * BAND + 1
    shift = np.arange(-BAND, BAND + 1)
    row = np.where(shift >= 0, shift, REACH * 4)[None, :].repeat(n, 0)  # words of the text left over at the start
    best = np.full((n, REACH + 1), REACH * 4)
    best[:, 0] = 0
    for k in range(1, REACH + 1):
        w = q + (k - 1) if step > 0 else q - k
        inside = (w >= 0) & (w < len(p.ids))
        word = np.where(inside, p.ids[np.clip(w, 0, len(p.ids) - 1)], 0)
        col = (at[:, None] + (k - 1) + shift) if step > 0 else (at[:, None] - k - shift)
        text = np.where((col >= lo[:, None]) & (col < hi[:, None]), train[np.clip(col, 0, max(len(train) - 1, 0))], -1)
        new = row + (text != word[:, None])  # the same word, or a changed one
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)  # a word of the passage left out
        for d in range(1, width):  # words added
            np.minimum(new[:, d], new[:, d - 1] + 1, out=new[:, d])
        new[word == 0] = REACH * 4  # beyond the passage
        row = new
        best[:, k] = row.min(axis=1)
    return best


def _expand(lo: np.ndarray, hi: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the interval, member) of all members of intervals [lo, hi), about ``most`` at a time."""
    upto = np.cumsum(hi - lo)
    s = 0
    while s < len(lo):
        done = int(upto[s - 1]) if s else 0
        e = max(s + 1, int(np.searchsorted(upto, done + most, "right")))
        n = hi[s:e] - lo[s:e]
        which = np.repeat(np.arange(s, e), n)
        yield which, np.repeat(lo[s:e] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        s = e


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys (the first is the primary one), and start and end of each run of equal ones."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    start = np.flatnonzero(new)
    return order, start, np.append(start[1:], len(order)).astype(np.int64)


class _Best:
    """The longest match of each (document, item) so far, the earliest of equals."""

    def __init__(self, items: int):
        self.items, self.parts = items, []

    def add(self, doc: np.ndarray, item: np.ndarray, n: np.ndarray, at: np.ndarray, q: np.ndarray) -> None:
        self.parts.append(self._first(np.stack((doc * self.items + item, n, at, q))))
        if len(self.parts) > 16:
            self.parts = [self._first(np.concatenate(self.parts, axis=1))]

    @staticmethod
    def _first(x: np.ndarray) -> np.ndarray:
        x = x[:, np.lexsort((x[3], x[2], -x[1], x[0]))]
        return x[:, np.concatenate(([True], x[0, 1:] != x[0, :-1]))[: x.shape[1]]]

    def table(self) -> np.ndarray:
        return self._first(np.concatenate(self.parts, axis=1)) if self.parts else np.zeros((4, 0), np.int64)


PAIRS_AT_ONCE = 500_000


def _verbatim(s: _Suffixes, doc: np.ndarray, item: np.ndarray, n_items: int) -> np.ndarray:
    """The longest match of at least VERBATIM words of each (document, item), as columns pair, words, place, passage place.

    Every suffix of every passage is searched in the shard's suffix array for the interval of suffixes that share so many
    words. Suffixes of one document (or item) that are equal as far as any passage goes count once, and of matches only
    those are measured that no equal words precede: the others are parts of longer ones.
    """
    best = _Best(n_items)
    code = s.pair(3, 2)
    long = s.rest >= VERBATIM
    text, test = np.flatnonzero(long[: s.size]), s.size + np.flatnonzero(long[s.size :])
    text = text[np.isin(code[text], code[test])]
    order, first, _ = _groups(s.rank[-1][text], doc[text], s.before[text])
    suffixes = text[order[first]]  # in the order of the suffix array
    order, first, _ = _groups(s.rank[-1][test], item[test - s.size], s.before[test])
    test = test[order[first]]
    keys = code[suffixes]
    lo, hi = np.searchsorted(keys, code[test], "left"), np.searchsorted(keys, code[test], "right")
    for which, member in _expand(lo, hi, PAIRS_AT_ONCE):
        i, j = suffixes[member], test[which]
        head = (s.before[i] != s.before[j]) | (s.before[i] == 0)
        i, j = i[head], j[head]
        if len(i):
            best.add(doc[i], item[j - s.size], s.common(i, j), i, j)
    return best.table()


def _changed(s: _Suffixes, p: _Passages, train: np.ndarray, start: np.ndarray, doc: np.ndarray, item: np.ndarray, n_items: int, known: np.ndarray) -> np.ndarray:
    """As :func:`_verbatim`, for pairs not ``known`` that have a stretch with few changed words.

    Documents and items meet in intervals of SEED words, counted as groups; only pairs with enough seeds are laid out,
    and only matches that no equal words precede are aligned.
    """
    rank = s.rank[2]
    full = s.rest >= SEED
    text, test = np.flatnonzero(full[: s.size]), s.size + np.flatnonzero(full[s.size :])
    t_order, t_lo, t_hi = _groups(rank[text], doc[text])
    q_order, q_lo, q_hi = _groups(rank[test], item[test - s.size])
    text, test = text[t_order], test[q_order]
    t_rank, q_rank = rank[text[t_lo]], rank[test[q_lo]]
    lo, hi = np.searchsorted(t_rank, q_rank, "left"), np.searchsorted(t_rank, q_rank, "right")

    def met() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for q, t in _expand(lo, hi, PAIRS_AT_ONCE):
            yield q, t, doc[text[t_lo[t]]] * n_items + item[test[q_lo[q]] - s.size]

    pairs, seeds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for q, t, pair in met():
        u, inverse = np.unique(pair, return_inverse=True)
        pairs.append(u)
        seeds.append(np.bincount(inverse, weights=(t_hi[t] - t_lo[t]) * (q_hi[q] - q_lo[q]), minlength=len(u)))
    u, inverse = np.unique(np.concatenate(pairs), return_inverse=True)
    maybe = np.setdiff1d(u[np.bincount(inverse, weights=np.concatenate(seeds), minlength=len(u)) >= LEAST_SEEDS], known)
    best = _Best(n_items)
    near = np.zeros(len(maybe), bool)
    for q, t, pair in met() if len(maybe) else ():
        wanted = np.isin(pair, maybe)
        q, t, pair = q[wanted], t[wanted], pair[wanted]
        # Each test suffix of a group meets the interval of the document's suffixes.
        g, member = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*_expand(q_lo[q], q_hi[q], PAIRS_AT_ONCE))) if len(q) else (np.zeros(0, np.int64),) * 2
        for which, m in _expand(t_lo[t[g]], t_hi[t[g]], PAIRS_AT_ONCE):
            i, j, of = text[m], test[member[which]], np.searchsorted(maybe, pair[g[which]])
            head = (s.before[i] != s.before[j]) | (s.before[i] == 0)
            i, j, of = i[head], j[head], of[head]
            if not len(i):
                continue
            best.add(doc[i], item[j - s.size], s.common(i, j), i, j)
            for b in range(0, len(i), 4096):
                part = slice(b, b + 4096)
                open_ = np.flatnonzero(~near[of[part]]) + b
                if len(open_):
                    near[of[open_[_aligned(train, p, s.origin[i[open_]], j[open_] - s.size, start)]]] = True
    x = best.table()
    return x[:, np.isin(x[0], maybe[near])]


def _aligned(train: np.ndarray, p: _Passages, at: np.ndarray, q: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which matches lie in a stretch of at least STRETCH words of which at most one in ONE_IN is changed."""
    own = np.searchsorted(start, at, side="right") - 1
    ahead, back = (_errors(train, p, at, q, start[own], start[own + 1] - 1, way) for way in (1, -1))
    hit = np.zeros(len(at), bool)
    for k in range(REACH + 1):
        total = np.arange(REACH + 1) + k
        hit |= ((total >= STRETCH) & (ONE_IN * (ahead + back[:, k : k + 1]) <= total)).any(axis=1)
    return hit


def _shard(docs: list, offsets: list[int], lengths: list[int], train: np.ndarray, p: _Passages) -> list[tuple]:
    """(doc, item, longest verbatim match in words, its place in the text and in the passage, kind) of one shard."""
    s = _Suffixes(train, p)
    start = np.concatenate(([0], np.cumsum(lengths)))
    doc = np.searchsorted(start, s.origin, side="right") - 1
    names, item = np.unique(p.item, return_inverse=True)
    verbatim = _verbatim(s, doc, item, len(names))
    changed = _changed(s, p, train, start, doc, item, len(names), verbatim[0])
    out = []
    for x, kind in ((verbatim, "verbatim"), (changed, "changed")):
        d, at, q = x[0] // len(names), s.origin[x[2]], x[3] - s.size
        where = at - start[d] + np.array(offsets, np.int64)[d]
        out += [(docs[a], int(names[b]), n, t, w, kind) for a, b, n, t, w in zip(d.tolist(), (x[0] % len(names)).tolist(), x[1].tolist(), where.tolist(), p.place[q].tolist())]
    return out


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Passages in blocks of about BLOCK_CHARS, one at a time: none outgrows it by more than a passage."""
    used = items.where(F.col("item_id").isNotNull() & F.col("passage").isNotNull()).select("item_id", "passage").sort("item_id", "passage")
    block, size = [], 0
    for r in used.toLocalIterator():
        block.append((r["item_id"], r["passage"]))
        size += len(r["passage"])
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


_SCHEMA = "doc_id bigint, item_id bigint, n_words bigint, text_word bigint, passage_word bigint, kind string"


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, the longest verbatim match (n_words, and where it starts: text_word, passage_word, in compared words
    from 0; the earliest of equal ones) and kind (``verbatim`` or ``changed``), one row per pair.

    ``verbatim``: at least 12 consecutive words of the passage; ``changed``: at least 24 words of it in order of which at
    most one in six is changed, left out or added. Null texts, passages and ids of passages give no rows; passages that
    are too short to reach a limit can't be found; items with the same id are one item. Repeated documents are each
    reported. Other columns of either table don't matter. Without items or documents the result is empty.
    """
    spark = documents.sparkSession

    def against(block: list[tuple[int, str]]):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = _Passages(shared.value)
            known = p.vocabulary.get
            overlap = 2 * p.longest + 2 * REACH
            held: list[tuple] = []
            size = 0

            def found() -> pa.RecordBatch:
                docs, offsets, parts = zip(*held)
                rows = _shard(list(docs), list(offsets), [len(x) for x in parts], np.concatenate(parts), p)
                cols = list(zip(*rows)) if rows else [[]] * 6
                kinds = (*[pa.int64()] * 5, pa.string())
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in _SCHEMA.split(", ")])

            for b in batches:
                for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                    if not t:
                        continue
                    ids = np.array([known(w, 0) for w in words(t)] + [0], np.int64)
                    for s in range(0, len(ids), SHARD_WORDS):
                        # A longer text comes in stretches that see as much of the next as a passage can span.
                        part = ids[s : s + SHARD_WORDS + overlap]
                        held.append((i, s, part if s + len(part) == len(ids) else np.append(part, 0)))
                        size += len(part)
                        if size >= SHARD_WORDS:
                            yield found()
                            held, size = [], 0
            if held:
                yield found()

        return map_arrow(documents.select("doc_id", "text"), search, _SCHEMA), shared

    out, left = None, None
    for block in _blocks(items):
        if left is not None:
            # More than one block: each one's matches are written before the next block is brought in.
            one = written(left[0], "leaks")
            left[1].destroy()
            out = one if out is None else out.unionByName(one)
        left = against(block)
    if left is None:
        return spark.createDataFrame([], _SCHEMA)
    out = left[0] if out is None else out.unionByName(left[0])
    # One row per pair even where a document or item comes more than once; few rows are left here.
    longest = F.max(F.struct("n_words", (-F.col("text_word")).alias("a"), (-F.col("passage_word")).alias("b"))).alias("m")
    g = out.groupBy("doc_id", "item_id").agg(longest, F.max("kind").alias("kind"))
    return g.select("doc_id", "item_id", F.col("m.n_words").alias("n_words"), (-F.col("m.a")).alias("text_word"), (-F.col("m.b")).alias("passage_word"), "kind")


def clean_documents(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without any leak, all columns kept."""
    bad = leaks(documents, items).select(F.col("doc_id").alias("__leaked")).distinct()
    return documents.join(bad, documents["doc_id"].eqNullSafe(bad["__leaked"]), "left_anti")
