"""Op 5: benchmark decontamination with SimHash windows.

Every benchmark item is compared with the windows of its own number of words in
every document, whole texts through. A window and an item each have a 128-bit
SimHash of their word shingles, weighted by how often these occur. Items are
indexed by their size and by each of ``BLOCKS`` blocks of the fingerprint. Of 36
bits that differ some block has at most 4, so looking up every block with up to 4
bits changed finds all items of the window's size within ``RADIUS``. Those are
then compared exactly: the weighted Jaccard similarity of shingles, sum of least
over sum of largest counts.

A window that reaches the similarity shares most of its shingles with an item of
its size. Sums over the places where shingles of such items stand pick these
windows, in whatever order the shared parts come; other text is passed by at the
speed of hashing its words. Items of fewer words than a shingle are matched as
whole runs of words.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from nodeglass.llm import words
from nodeglass.llm.tables import map_batches, table

SHINGLE = 5
PERCENT = 80
BITS = 128
RADIUS = 36  # of 128 bits; similarity 0.8 differs in 19 on average
BLOCKS = 8
ITEMS_AT_ONCE = 20_000  # items that are broadcast together
SPAN = 4096  # places whose fingerprint sums are held at once
_HALVES = (np.uint64(0), np.uint64(0xA0761D6478BD642F))


def _bits(shingles):
    return np.concatenate([np.unpackbits(words.mix(shingles ^ salt)[:, None].view(np.uint8), axis=1) for salt in _HALVES], axis=1)


def simhash(shingles):
    """128 bits of weighted shingles as booleans; repeats weigh more."""
    return 2 * _bits(shingles).sum(axis=0, dtype=np.int64) > len(shingles)


def window_prints(shingles, left, right):
    """SimHashes of the windows [left, right) of a text, from running sums."""
    out, at = np.zeros((len(left), BITS), bool), 0
    while at < len(left):
        end = max(at + 1, int(np.searchsorted(left, left[at] + SPAN)))
        low, high = left[at], right[at:end].max()
        sums = np.zeros((high - low + 1, BITS), np.int32)
        np.cumsum(_bits(shingles[low:high]), axis=0, out=sums[1:])
        out[at:end] = 2 * (sums[right[at:end] - low] - sums[left[at:end] - low]) > (right[at:end] - left[at:end])[:, None]
        at = end
    return out


def _values(prints):
    """The blocks of fingerprints as whole numbers."""
    width = BITS // BLOCKS
    return prints.reshape(-1, BLOCKS, width) @ (1 << np.arange(width - 1, -1, -1))


def _changes(most):
    """All masks of a block with up to ``most`` bits set."""
    width = BITS // BLOCKS
    return np.array([sum(1 << i for i in c) for n in range(most + 1) for c in combinations(range(width), n)])


def weighted_overlap(x, y):
    """Sums of the lesser and of the larger counts of two shingle lists."""
    both, which = np.unique(np.concatenate((x, y)), return_inverse=True)
    a = np.bincount(which[:len(x)], minlength=len(both))
    b = np.bincount(which[len(x):], minlength=len(both))
    return int(np.minimum(a, b).sum()), int(np.maximum(a, b).sum())


class Benchmark:
    """Items by shingle, to pick windows, and by size and fingerprint block."""

    def __init__(self, ids, texts, shingle=SHINGLE, percent=PERCENT, radius=RADIUS):
        self.percent, self.radius = percent, radius
        self.ids, self.shingles, sizes = [], [], []
        for at, data, offsets in words.blocks(pa.array(texts, pa.string())):
            hashes, first = words.hashed_words(data, offsets)
            found, begin = words.shingle_hashes(hashes, first, shingle)
            for k in range(len(offsets) - 1):
                if begin[k + 1] > begin[k]:
                    self.ids.append(ids[at + k])
                    self.shingles.append(found[begin[k]:begin[k + 1]])
                    width = min(shingle, int(first[k + 1] - first[k]))
                    sizes.append((width, int(begin[k + 1] - begin[k])))
        self.prints = np.array([simhash(s) for s in self.shingles], bool).reshape(-1, BITS)
        self.masks = _changes(radius // BLOCKS)
        values = _values(self.prints)
        # By size, (words of a shingle, shingles): the items, sorted by each block's value.
        self.index, self.places = {}, {}
        for size in sorted(set(sizes)):
            own = np.array([i for i, s in enumerate(sizes) if s == size])
            orders = [own[np.argsort(values[own, n], kind="stable")] for n in range(BLOCKS)]
            self.index[size] = [(values[order, n], order) for n, order in enumerate(orders)]
        # By words of a shingle: shingles, ascending, with the sizes of the items that hold them.
        for width in sorted({w for w, _ in sizes}):
            pairs = {(x, len(s)) for s, (w, _) in zip(self.shingles, sizes) if w == width for x in np.unique(s).tolist()}
            pairs = sorted(pairs)
            keys = np.array([x for x, _ in pairs], np.uint64)
            marks = np.zeros(1 << 16, bool)
            marks[(keys >> np.uint64(48)).astype(np.int64)] = True
            self.places[width] = keys, np.array([n for _, n in pairs], np.int64), marks

    def candidates(self, bits, size):
        """Items of a size that share a block with ``bits``, but for a few of its bits."""
        found = []
        for (values, order), value in zip(self.index.get(size, ()), _values(bits[None])[0]):
            probes = value ^ self.masks
            low, high = np.searchsorted(values, probes), np.searchsorted(values, probes, "right")
            hit = high > low
            found += [order[a:b] for a, b in zip(low[hit].tolist(), high[hit].tolist())]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def near(self, bits, size):
        """Items of a size whose fingerprint is within the radius."""
        found = self.candidates(bits, size)
        return found[(self.prints[found] != bits).sum(axis=1) <= self.radius]

    def windows(self, shingles, begin, width):
        """(text, shingles of a size, left, right) of windows that may reach the similarity."""
        keys, counts, marks = self.places[width]
        maybe = np.flatnonzero(marks[(shingles >> np.uint64(48)).astype(np.int64)])
        low = np.searchsorted(keys, shingles[maybe])
        times = np.searchsorted(keys, shingles[maybe], "right") - low
        hit = np.repeat(maybe, times)
        if not len(hit):
            return
        count = counts[np.arange(len(hit)) + np.repeat(low - (np.cumsum(times) - times), times)]
        text = np.searchsorted(begin, hit, "right") - 1
        order = np.lexsort((hit, count, text))
        hit, count, text = hit[order], count[order], text[order]
        edges = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (count[1:] != count[:-1]), [True])))
        enough = 100 * np.diff(edges) >= self.percent * count[edges[:-1]]
        for a, b in zip(edges[:-1][enough].tolist(), edges[1:][enough].tolist()):
            n, t = int(count[a]), int(text[a])
            places, whole = hit[a:b] - begin[t], int(begin[t + 1] - begin[t])
            starts = np.arange(places[0] - n + 1, places[-1] + 1)
            left, right = np.maximum(starts, 0), np.minimum(starts + n, whole)
            shared = np.searchsorted(places, right) - np.searchsorted(places, left)
            fits = shared * (100 + self.percent) >= self.percent * (n + right - left)
            if not fits.any():
                continue
            left, right = left[fits], right[fits]
            # Windows of the same shingles (a text that repeats itself) are looked at once.
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words.mix(shingles[begin[t]:begin[t + 1]] + np.uint64(1)))))
            _, once = np.unique(sums[right] - sums[left], return_index=True)
            once.sort()
            yield t, n, left[once], right[once]

    def hits(self, column):
        """(row, item, first word, words, least, largest) of each item's best window."""
        for at, data, offsets in words.blocks(column) if self.ids else ():
            hashes, first = words.hashed_words(data, offsets)
            best = {}
            for width in self.places:
                shingles, begin = words.shingle_hashes(hashes, first, width)
                for text, n, left, right in self.windows(shingles, begin, width):
                    own = shingles[begin[text]:begin[text + 1]]
                    for a, b, bits in zip(left.tolist(), right.tolist(), window_prints(own, left, right)):
                        for i in self.near(bits, (width, n)).tolist():
                            least, largest = weighted_overlap(own[a:b], self.shingles[i])
                            if 100 * least >= self.percent * largest:
                                entry = (-least / largest, a, least, largest, b - a + width - 1)
                                best[text, i] = min(best.get((text, i), entry), entry)
            for (text, i), (_, start, least, largest, size) in sorted(best.items()):
                yield at + text, self.ids[i], start, size, least, largest


def benchmarks(items, key="item_id", text="text", shingle=SHINGLE, percent=PERCENT):
    """Broadcast indexes of the items, at most ``ITEMS_AT_ONCE`` in each.

    Items are dealt by hash into as many rounds as their number needs, so each
    broadcast is bounded. Null texts and texts without words are no items.
    """
    spark = items.sparkSession
    rounds = -(-items.count() // ITEMS_AT_ONCE)
    for n in range(rounds):
        own = items.where(F.pmod(F.xxhash64(key, text), F.lit(rounds)) == n).select(key, text).toPandas()
        own = own.sort_values([key, text], ignore_index=True)
        yield spark.sparkContext.broadcast(Benchmark(own[key].tolist(), own[text].tolist(), shingle, percent))


def find_contamination(docs, items, key="doc_id", text="text", item="item_id"):
    """(key, item, first_word, n_words, similarity): the best window of each item found.

    Only documents with a window of similarity 0.8 or more come out; among
    equally similar windows the first. Null and empty texts never do. A text of
    fewer words than the item is one window. Repeated rows come out each.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField(item, T.LongType()),
        *T._parse_datatype_string("first_word long, n_words long, similarity double")])
    found = None
    for index in benchmarks(items, item):
        def search(batches, index=index):
            for batch in batches:
                hits = list(index.value.hits(batch.column(1)))
                at, ids, first, size, least, largest = (np.array(c) for c in zip(*hits)) if hits else [np.zeros(0, np.int64)] * 6
                similarity = least / np.maximum(largest, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array(ids, pa.int64()), pa.array(first, pa.int64()),
                     pa.array(size, pa.int64()), pa.array(similarity, pa.float64())], names=schema.names)

        own = map_batches(rows, search, schema)
        found = own if found is None else found.unionByName(own)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def keep_uncontaminated(docs, items, text="text"):
    """``docs`` without the rows that hold a window like a benchmark item.

    Null and empty texts stay, and so does every row of a table without items;
    repeated rows stay or go together.
    """
    names, place = docs.columns, docs.columns.index(text)
    for index in benchmarks(items):
        def clean(batches, index=index):
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for row, *_ in index.value.hits(batch.column(place)):
                    keep[row] = False
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns], names=names)

        docs = map_batches(docs, clean, docs.schema)
    return docs


def op5_benchmark_decontamination(spark, sf_dir):
    """Every document that holds a benchmark item, and where."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_contamination(docs, table(spark, sf_dir, "benchmark"))
