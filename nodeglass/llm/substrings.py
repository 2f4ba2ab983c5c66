"""Op 13: removal of repeated passages with an FM-index per shard.

A window is a run of ``WINDOW`` words. Its anchor is the least hash of the
``SEED``-word runs in it, which equal windows share, so passages can meet only
under anchors that several documents have. Around those, documents are cut into
pieces: consecutive windows with the same anchor, which are dealt to shards by it.

Each shard builds an FM-index of its different pieces: the Burrows-Wheeler
transform of their words in a wavelet matrix of packed bits. The pieces stream
through it from right to left. Backward search extends the match by one word, or
falls back to shorter matches where there is none, which gives the matching
statistics up to ``WINDOW``; at that length the interval of the index says which document
has the window first. Documents with a greater id lose the words it covers.

Nothing is left out: an anchor with more than ``HOT_PIECES`` pieces (a passage of
many documents) has them cut into single windows, which are made distinct before
they move, dealt by their own digest and joined back.

Odd rows: null texts have no words; documents with a null id neither lose words
nor take any from others; rows that share an id don't take words from each
other; repeated rows come out as often as they came in; an empty table gives no
rows, and columns besides id and text are passed by.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from nodeglass.llm import words
from nodeglass.llm.tables import map_batches, release, stage, table
from nodeglass.operators.skew import checked_broadcast
from nodeglass.session import staged

WINDOW = 13
SEED = 5
MOST_WINDOWS = 32  # of a piece
HOT_PIECES = 50_000  # pieces of one anchor that a task takes, some 8 MB
SHARD_WORDS = 400_000
BROADCAST_BYTES = 32 << 20

U64 = np.uint64


# Anchors and pieces

def _anchors(hashes, first, window, seed):
    """(text, start, windows, anchor) of all pieces; words by hash, texts by ``first``."""
    n = len(hashes)
    if n < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.int64),)
    runs = np.zeros(n - seed + 1, U64)
    for j in range(seed):
        runs += hashes[j:n - seed + 1 + j] * U64(2 * (j + 1) ** 5 + 0x9E3779B97F4A7C15)
    runs = words.mix(runs)
    least, width = runs, 1
    while width * 2 <= window - seed + 1:  # least of the runs that start in a window
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    rest = window - seed + 1 - width
    least = np.minimum(least[:len(least) - rest], least[rest:])
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[:len(least)]
    start = np.arange(len(least))
    inside = start + window <= first[1:][text]
    text, start, least = text[inside], start[inside], least[inside]
    if not len(start):
        return text, start, start, least.view(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    since = np.arange(len(start)) - np.repeat(begin, np.diff(np.append(begin, len(start))))
    begin = np.flatnonzero(since % MOST_WINDOWS == 0)
    windows = np.diff(np.append(begin, len(start)))
    return text[begin], start[begin] - first[text[begin]], windows, least[begin].view(np.int64)


def _spaced(data, starts, ends):
    """The words with one space after each, and where each begins."""
    lengths = ends - starts
    begin = np.concatenate(([0], np.cumsum(lengths)))
    places = np.concatenate(([0], np.cumsum(lengths + 1)))
    out = np.full(places[-1], 32, np.uint8)
    at = np.arange(begin[-1])
    out[at + np.repeat(places[:-1] - begin[:-1], lengths)] = data[at + np.repeat(starts - begin[:-1], lengths)]
    return out, places


def anchors(docs, window=WINDOW, seed=SEED):
    """(key, doc_id): the anchors of each document, once for each piece."""
    def run(batches):
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            for row, data, offsets in words.blocks(batch["text"]):
                starts, ends, first = words.word_spans(data, offsets)
                text, _, _, key = _anchors(words.word_hashes(data, starts, ends), first, window, seed)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[row + text])], ["key", "doc_id"])

    return map_batches(docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text"), run, "key long, doc_id long")


_PIECES = "key long, piece binary, doc_id long, h long, start int, windows int"
_KINDS = {"key": pa.int64(), "piece": pa.binary(), "doc_id": pa.int64(), "h": pa.int64(), "start": pa.int32(), "windows": pa.int32()}


def pieces(docs, window=WINDOW, seed=SEED):
    """Pieces of ``docs`` (doc_id, h, text, keys) whose anchors are among ``keys``."""
    def run(batches):
        for batch in batches:
            ids, hs = batch["doc_id"].to_numpy(), batch["h"].to_numpy()
            keys = batch["keys"]
            for row, data, offsets in words.blocks(batch["text"]):
                starts, ends, first = words.word_spans(data, offsets)
                text, start, windows, key = _anchors(words.word_hashes(data, starts, ends), first, window, seed)
                hit = np.zeros(len(text), bool)
                edges = np.searchsorted(text, np.arange(len(offsets)))
                for t, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    hit[a:b] = np.isin(key[a:b], keys[row + t].values.to_numpy())
                text, start, windows, key = text[hit], start[hit], windows[hit], key[hit]
                if not len(text):
                    continue
                spaced, places = _spaced(data, starts, ends)
                spaced, base = spaced.tobytes(), first[text] + start
                found = [spaced[a:b] for a, b in zip(places[base].tolist(), (places[base + windows + window - 1] - 1).tolist())]
                columns = [key, found, ids[row + text], hs[row + text], start, windows]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS.values())], list(_KINDS))

    return map_batches(docs, run, _PIECES)


_SINGLE = "id binary, piece binary, doc_id long, h long, start int"


def _single_windows(hot, window=WINDOW):
    """Pieces cut into their windows, each named by a digest."""
    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ws = r["piece"].split(b" ")
                for i in range(r["windows"]):
                    piece = b" ".join(ws[i:i + window])
                    rows.append((hashlib.blake2b(piece, digest_size=16).digest(), piece, r["doc_id"], r["h"], r["start"] + i))
            if rows:
                kinds = [pa.binary(), *(_KINDS[c] for c in ("piece", "doc_id", "h", "start"))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["id", "piece", "doc_id", "h", "start"])

    return map_batches(hot, run, _SINGLE)


# The index

class WaveletMatrix:
    """Ranks over a sequence of symbols, as packed bits, a level for each bit."""

    def __init__(self, symbols, bits):
        self.bits, self.levels = bits, []
        n = len(symbols)
        for level in range(bits):
            bit = (symbols >> (bits - 1 - level)) & 1
            packed = np.zeros((n >> 6) + 1, U64)
            padded = np.zeros(len(packed) * 64, np.uint8)
            padded[:n] = bit
            packed[:] = np.packbits(padded, bitorder="little").view(U64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed))))[:-1].astype(np.int64)
            self.levels.append((packed, before, n - int(bit.sum())))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def follow(self, symbols, places):
        """Where ``places`` lead to among the occurrences of ``symbols``."""
        for level, (packed, before, zeros) in enumerate(self.levels):
            word = places >> 6
            mask = (U64(1) << (places & 63).astype(U64)) - U64(1)
            ones = before[word] + np.bitwise_count(packed[word] & mask)
            places = np.where((symbols >> (self.bits - 1 - level)) & 1, zeros + ones, places - ones)
        return places


class FmIndex:
    """Backward search over texts of symbols 1, 2, ...; 0 stands between texts.

    Suffixes are sorted by their first ``depth`` symbols, which is all that
    matches up to that length need.
    """

    def __init__(self, symbols, depth):
        self.n, self.depth = len(symbols), depth
        self.size = int(symbols.max(initial=0)) + 1
        self.ranks = {1: symbols.astype(np.int64)}
        width = 1
        while width * 2 <= depth:
            self.ranks[width * 2] = self._pairs(self.ranks[width], width)
            width *= 2
        self.order = np.argsort(self._pairs(self.ranks[width], depth - width) if depth > width else self.ranks[width], kind="stable")
        last = symbols[self.order - 1]
        self.matrix = WaveletMatrix(last, max(1, int(self.size - 1).bit_length()))
        every = np.arange(self.size)
        counts = np.bincount(symbols, minlength=self.size)
        self.base = np.cumsum(counts) - counts - self.matrix.follow(every, np.zeros(self.size, np.int64))
        self.groups = {0: (np.zeros(self.n, np.int64), np.full(self.n, self.n))}

    def _shifted(self, ranks, by):
        out = np.full(self.n, -1, np.int64)
        out[:self.n - by] = ranks[by:]
        return out

    def _pairs(self, ranks, by):
        """Ranks by ``ranks`` and then by those ``by`` places on."""
        return np.unique(ranks * (self.n + self.size + 2) + self._shifted(ranks, by) + 1, return_inverse=True)[1]

    def group(self, depth):
        """For each suffix in order, the interval of those that agree on ``depth`` symbols."""
        if depth not in self.groups:
            width = 1 << (depth.bit_length() - 1)
            new = np.ones(self.n, bool)
            for ranks in (self.ranks[width], self._shifted(self.ranks[width], depth - width)):
                ranks = ranks[self.order]
                new[1:] &= ranks[1:] == ranks[:-1]
            new[1:] = ~new[1:]
            begin = np.flatnonzero(new)
            number = np.cumsum(new) - 1
            self.groups[depth] = begin[number], np.append(begin[1:], self.n)[number]
        return self.groups[depth]

    def extend(self, symbols, low, high):
        """Intervals with one more symbol in front; empty where there is no such match."""
        known = (symbols > 0) & (symbols < self.size)
        symbols = np.where(known, symbols, 0)
        both = self.matrix.follow(np.concatenate((symbols, symbols)), np.concatenate((low, high)))
        low, high = both[:len(symbols)] + self.base[symbols], both[len(symbols):] + self.base[symbols]
        return low, np.where(known, high, low)

    def matching_statistics(self, texts, first):
        """(lengths, lows): for each place of ``texts`` the longest match that
        starts there, up to ``depth``, and the first of its suffixes in order.

        ``first`` gives where each text starts; all are read from right to left
        at once.
        """
        sizes = np.diff(first)
        turn = np.argsort(-sizes, kind="stable")
        lengths, lows = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.n)
        long = np.zeros(len(sizes), np.int64)
        active = np.searchsorted(-sizes[turn], -np.arange(sizes.max(initial=0)), "left")
        for step, many in enumerate(active):
            at = first[1:][turn[:many]] - 1 - step
            symbols = texts[at]
            a, b = self.extend(symbols, low[:many], high[:many])
            failed = np.flatnonzero(a >= b)
            while len(failed):  # drop symbols at the right end
                for depth in np.unique(long[failed]).tolist():
                    those = failed[long[failed] == depth]
                    if depth == 0:
                        low[those], high[those], long[those] = 0, self.n, -1
                        continue
                    begin, end = self.group(depth - 1)
                    low[those], high[those], long[those] = begin[low[those]], end[low[those]], depth - 1
                failed = failed[long[failed] >= 0]
                a[failed], b[failed] = self.extend(symbols[failed], low[failed], high[failed])
                failed = failed[a[failed] >= b[failed]]
            none = long[:many] < 0
            a[none], b[none] = 0, self.n
            grown = np.where(none, 0, long[:many] + 1)
            full = grown > self.depth
            if full.any() or (grown == self.depth).any():
                begin, end = self.group(self.depth)
                full = grown >= self.depth
                a[full], b[full] = begin[a[full]], end[a[full]]
                grown[full] = self.depth
            low[:many], high[:many], long[:many] = a, b, grown
            lengths[at], lows[at] = grown, a
        return lengths, lows


def first_owners(texts, owners, depth=WINDOW):
    """For each text (words joined by spaces) the least owner of each of its windows.

    Returns all windows' owners and where each text's begin.
    """
    texts = pa.array(texts, pa.binary())
    lists = pc.split_pattern(texts, pattern=b" ")
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    names = lists.values.dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    begin = np.concatenate(([0], np.cumsum(sizes)))
    symbols = np.zeros(len(names) + len(sizes), np.int64)
    symbols[np.arange(len(names)) + np.repeat(np.arange(len(sizes)), sizes)] = names
    index = FmIndex(symbols, depth)
    owner = np.repeat(np.asarray(owners, np.int64), sizes + 1)[index.order]
    groups = index.group(depth)[0]
    heads = np.flatnonzero(groups == np.arange(len(groups)))
    least = np.zeros(len(groups), np.int64)
    least[heads] = np.minimum.reduceat(owner, heads)
    lengths, lows = index.matching_statistics(names, begin)
    counts = np.maximum(sizes - depth + 1, 0)
    starts = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(starts[-1]) + np.repeat(begin[:-1] - starts[:-1], counts)
    assert (lengths[at] == depth).all()  # each window finds itself
    return least[lows[at]], starts


def _search(shard):
    """(doc_id, h, starts): windows of the shard's pieces that an earlier document has."""
    coded = shard["piece"].combine_chunks().dictionary_encode()
    code, doc = coded.indices.to_numpy().astype(np.int64), shard["doc_id"].to_numpy()
    owners = np.full(len(coded.dictionary), np.iinfo(np.int64).max)
    np.minimum.at(owners, code, doc)
    firsts, begin = first_owners(coded.dictionary, owners)
    counts = np.diff(begin)[code]
    edges = np.concatenate(([0], np.cumsum(counts)))
    inside = np.arange(edges[-1]) - np.repeat(edges[:-1], counts)
    lost = firsts[inside + np.repeat(begin[code], counts)] < np.repeat(doc, counts)
    starts = (inside + np.repeat(shard["start"].to_numpy().astype(np.int64), counts))[lost]
    which = np.repeat(np.arange(len(code)), counts)[lost]
    some, first = np.unique(which, return_index=True)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(starts)), pa.int32()), pa.array(starts, pa.int32()))
    return pa.table({"doc_id": shard["doc_id"].take(pa.array(some)), "h": shard["h"].take(pa.array(some)), "starts": lists})


def _search_single(shard):
    """(id, first): distinct windows that have an earlier owner than their last."""
    firsts, _ = first_owners(shard["piece"].combine_chunks(), shard["first"].to_numpy())
    again = pa.array(firsts < shard["last"].to_numpy())
    return pa.table({"id": shard["id"].filter(again), "first": pa.chunked_array([pa.array(firsts)]).filter(again)})


# The operator

def _bounded(spans):
    """``spans`` (written) marked for broadcast if all of them are few bytes."""
    n, rows = spans.agg(F.sum(F.size("spans")), F.count(F.lit(1))).first()
    return F.broadcast(spans) if (n or 0) * 4 + rows * 64 <= BROADCAST_BYTES else spans.hint("shuffle_hash")


def _merge(batches):
    """(doc_id, h, spans): starts of removed windows as merged word ranges."""
    for batch in batches:
        spans = []
        for lists in batch["starts"].to_pylist():
            starts = np.unique(np.concatenate([np.asarray(x, np.int64) for x in lists]))
            breaks = np.flatnonzero(np.diff(starts) > WINDOW)
            a = starts[np.concatenate(([0], breaks + 1))]
            b = starts[np.concatenate((breaks, [len(starts) - 1]))] + WINDOW
            spans.append(np.column_stack((a, b)).ravel().tolist())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["h"], pa.array(spans, pa.list_(pa.int32()))], ["doc_id", "h", "spans"])


def shared_anchors(docs):
    """(doc_id, keys): the anchors of each document that occur again somewhere."""
    with staged(anchors(docs), "anchors") as found:
        shared = stage(found.groupBy("key").count().where("count > 1").select("key"), "shared")
        return stage(found.join(shared, "key").groupBy("doc_id").agg(F.collect_set("key").alias("keys")), "keys")


def _dealt(rows, key, total):
    """Rows by shards of about ``SHARD_WORDS`` of ``total`` words."""
    return rows.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(max(1, -(-total // SHARD_WORDS))))).groupBy("shard")


def _removed(cut):
    """(doc_id, h, starts): windows of pieces that an earlier document has."""
    counts = cut.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("windows") + WINDOW).alias("words"))
    counts = stage(counts, "counts")
    hot = stage(counts.where(F.col("n") > HOT_PIECES).select("key"), "hot")
    words_of = lambda where: counts.where(where).agg(F.sum("words")).first()[0] or 0
    lost = "doc_id long, h long, starts array<int>"
    if hot.isEmpty():
        return _dealt(cut.select("key", "piece", "doc_id", "h", "start"), "key", words_of("true")).applyInArrow(_search, lost)
    hot = checked_broadcast(hot)
    alone = cut.join(hot, "key", "left_anti").select("key", "piece", "doc_id", "h", "start")
    found = _dealt(alone, "key", words_of(F.col("n") <= HOT_PIECES)).applyInArrow(_search, lost)
    single = stage(_single_windows(cut.join(hot, "key", "left_semi").select(*_KINDS)), "windows")
    distinct = stage(single.groupBy("id", "piece").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "distinct")
    firsts = _dealt(distinct, "id", distinct.count() * (WINDOW + 1)).applyInArrow(_search_single, "id binary, first long")
    again = single.select("id", "doc_id", "h", "start").join(firsts, "id").where("first < doc_id")
    return found.unionByName(again.select("doc_id", "h", F.array("start").alias("starts")))


def repeated_spans(docs):
    """(doc_id, h, spans): word ranges that an earlier document has; h: xxhash64 of the text.

    ``spans`` holds the start and end of one range after the other. Tables are
    deleted and shuffle files released as soon as the next step has its own.
    """
    keys = shared_anchors(docs).hint("shuffle_hash")
    release(docs.sparkSession)
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("h"), "text")
    with staged(pieces(texts.join(keys, "doc_id").select("doc_id", "h", "text", "keys")), "pieces") as cut:
        release(docs.sparkSession)
        lost = _removed(cut).groupBy("doc_id", "h").agg(F.collect_set("starts").alias("starts"))
        return stage(map_batches(lost, _merge, "doc_id long, h long, spans array<int>"), "spans")


def _keep(batches):
    """Counts and digest of the words outside ``spans``."""
    for batch in batches:
        spans, rows = batch["spans"], ([], [], [])
        for row, data, offsets in words.blocks(batch["text"]):
            starts, ends, first = words.word_spans(data, offsets)
            spaced, places = _spaced(data, starts, ends)
            for t in range(len(offsets) - 1):
                a, b = first[t], first[t + 1]
                cuts = spans[row + t].values.to_numpy().reshape(-1, 2) if spans[row + t].is_valid else ()
                kept, at = [], a
                for lo, hi in cuts:
                    if at < a + lo:
                        kept.append(spaced[places[at]:places[a + lo]].tobytes())
                    at = a + hi
                if at < b:
                    kept.append(spaced[places[at]:places[b]].tobytes())
                rows[0].append(int(b - a))
                rows[1].append(int(sum(hi - lo for lo, hi in cuts)))
                rows[2].append(hashlib.sha256(b"".join(kept)[:-1]).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256"])


def without_repeats(docs):
    """(doc_id, n_words, n_removed, kept_sha256) of ``docs`` (doc_id, text), a row each."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = _bounded(repeated_spans(docs))
    release(docs.sparkSession)
    joined = docs.withColumn("h", F.xxhash64("text")).join(spans, ["doc_id", "h"], "left").select("doc_id", "text", "spans")
    return map_batches(joined, _keep, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op13_substring_dedup(spark, sf_dir):
    """All documents without the passages that an earlier one has."""
    return without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP13_SQL = f"""
WITH ws AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), starts AS (
  SELECT r, doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM ws WHERE len(w) >= {WINDOW}
), windows AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS piece FROM starts
), owned AS (
  SELECT r, i, doc_id > min(doc_id) OVER (PARTITION BY piece) AS again FROM windows
), gone AS (
  SELECT DISTINCT r, i + k AS i FROM owned CROSS JOIN range({WINDOW}) t(k) WHERE again
), every AS (
  SELECT r, doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM ws
), kept AS (
  SELECT r, count(*) FILTER (WHERE g.i IS NULL) AS n, string_agg(word, ' ' ORDER BY e.i) FILTER (WHERE g.i IS NULL) AS text
  FROM every e LEFT JOIN gone g USING (r, i) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM ws LEFT JOIN kept USING (r)
"""
