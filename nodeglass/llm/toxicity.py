"""Op 1: toxicity by class-conditional Kneser-Ney models.

Two models, toxic and ordinary, are compared by the logarithm of the ratio of
the likelihoods they give a text, on two scales of expression.

* Byte sequences: each byte has a probability after the bytes before it. Counts
  of five-byte sequences come from all training documents; shorter contexts
  count in how many different sequences they occur, as Kneser-Ney smoothing
  wants. The shortest contexts are shared by both classes.
* Words: what discounting takes from a word's counts in either class is handed
  back by the classes' shares of all words, so the counts shared by both classes
  decide about a rare word, and a word never met says nothing.

Both ratios, normalised by length over the whole text, over its most toxic
stretch and over its strong places, go into a logistic scale. All training
documents are counted; those that the scale is learned on are scored as if they
had not been, by taking their own counts out first. Sequences are counted under a number below ``BUCKETS``, words under
two numbers, of whose counts the lesser holds: the models have the same bounded
size whatever the corpus is, which makes them safe to broadcast.
"""

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from nodeglass.llm import words
from nodeglass.llm.labelled import fit_logistic, fold, with_labels
from nodeglass.llm.tables import free_name, map_batches, stage, table

ORDER = 5  # bytes of the longest sequences
SHARED = 2  # sequences up to this length are counted over both classes together
# Sizes of the tables, primes but for the exact one of two bytes. A word counts
# in both of its tables.
BUCKETS = {2: 1 << 16, 3: 65_521, 4: 262_139, 5: 524_287}
WORD_BUCKETS = (524_287, 524_269)
CHUNK = 1 << 14  # buckets that a task packs together
WINDOW = 64  # bytes of a stretch
WINDOW_WORDS = 8
STRONG = 2.0  # log ratio beyond which a byte or word counts as strong evidence
SCALE_ROWS = 5_000  # documents the logistic scale is learned from, at most
FLUSH_ROWS = 300_000  # counts a task holds before it hands them on
_CLASSES = ("toxic", "ordinary")
_FEATURES = ["_byte_mean", "_byte_peak", "_byte_strong", "_word_mean", "_word_peak", "_word_strong"]


def _padded(data, offsets):
    """Lower-cased bytes with ORDER spaces before each text, and places of texts."""
    data = np.where(words.WHITE[data], np.uint8(32), words.LOWER[data])
    lengths = np.diff(offsets)
    first = offsets[:-1] + ORDER * np.arange(1, len(lengths) + 1)
    out = np.full(len(data) + ORDER * len(lengths), 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(first - offsets[:-1], lengths)] = data
    return out, first, lengths


def _sequences(padded, length):
    """The ``length`` bytes up to each place as a number, the last byte lowest."""
    out = padded.astype(np.uint64)
    for j in range(1, length):
        out[j:] |= padded[:-j].astype(np.uint64) << np.uint64(8 * j)
    return out


def _of_texts(first, lengths):
    return np.arange(lengths.sum()) + np.repeat(first - (np.cumsum(lengths) - lengths), lengths)


def _word_numbers(data, offsets):
    """Hashes of the words of a block, 63 bits each, and each text's first."""
    data = words.LOWER[data]
    starts, ends, first = words.word_spans(data, offsets, words.SIGNS)
    return words.word_hashes(data, starts, ends) >> np.uint64(1), first


def _sequence_numbers(data, offsets):
    padded, first, lengths = _padded(data, offsets)
    return _sequences(padded, ORDER)[_of_texts(first, lengths)], offsets


class _Counts:
    """Counts by number and class, handed on when there are many."""

    def __init__(self, kind, numbers):
        self.kind, self.numbers, self.parts, self.many = kind, numbers, [], 0

    def add(self, data, offsets, toxic):
        numbers, begin = self.numbers(data, offsets)
        found, which = np.unique(numbers, return_inverse=True)
        of_toxic = np.repeat(toxic, np.diff(begin))
        self.parts.append([found, *(np.bincount(which[m], minlength=len(found)) for m in (of_toxic, ~of_toxic))])
        self.many += len(found)
        if self.many > 2 * FLUSH_ROWS:
            self.merge()

    def merge(self):
        found, *own = map(np.concatenate, zip(*self.parts))
        found, which = np.unique(found, return_inverse=True)
        self.parts = [[found, *(np.bincount(which, x, len(found)).astype(np.int64) for x in own)]]
        self.many = len(found)

    def rows(self, last=False):
        if self.parts and last:
            self.merge()
        if self.parts and (last or len(self.parts) == 1 and self.many >= FLUSH_ROWS):
            (numbers, *own), = self.parts
            self.parts, self.many = [], 0
            columns = [np.full(len(numbers), self.kind, np.int8), numbers.view(np.int64), *own]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["kind", "number", *_CLASSES])


def count_expressions(labelled):
    """(kind, number, toxic, ordinary): counts over all labelled documents.

    Kind 0 are byte sequences, kind 1 words. Tasks add up what they read before
    anything is shuffled.
    """

    def count(batches):
        both = [_Counts(0, _sequence_numbers), _Counts(1, _word_numbers)]
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for at, data, offsets in words.blocks(batch.column(0)):
                for counts in both:
                    counts.add(data, offsets, toxic[at:at + len(offsets) - 1])
                    yield from counts.rows()
        for counts in both:
            yield from counts.rows(last=True)

    counted = map_batches(labelled.select("text", "_label"), count, "kind byte, number long, toxic long, ordinary long")
    return counted.groupBy("kind", "number").agg(*(F.sum(c).alias(c) for c in _CLASSES))


def _table(rows, name, key, size, columns):
    """Rows (table, bucket, v0 ... v3) of one table of ``size`` buckets."""
    values = [(F.col(columns[i]) if i < len(columns) else F.lit(0)).cast("double").alias(f"v{i}") for i in range(4)]
    return rows.select(F.lit(name).alias("table"), F.pmod(F.col(key), F.lit(size)).cast("int").alias("bucket"), *values)


def _collect(tables, sizes):
    """Sums by table and bucket as dense float arrays.

    Tasks pack the buckets, so the driver gets a few hundred rows whose bytes
    are bounded by ``sizes``, (buckets, columns) by table.
    """
    values = [f"v{i}" for i in range(4)]

    def pack(rows):
        out = np.zeros((CHUNK, 4), np.float32)
        out[rows["bucket"].to_numpy() % CHUNK] = rows[values].to_numpy(np.float32)
        table = rows["table"].iloc[0]
        return pd.DataFrame({"table": [table], "chunk": [rows["chunk"].iloc[0]], "data": [out[:, :sizes[table][1]].tobytes()]})

    sums = reduce(lambda x, y: x.unionByName(y), tables).groupBy("table", "bucket").agg(*(F.sum(v).alias(v) for v in values))
    chunks = sums.withColumn("chunk", F.expr(f"bucket div {CHUNK}").cast("int")).groupBy("table", "chunk").applyInPandas(
        pack, "table string, chunk int, data binary")
    dense = {name: np.zeros((-(-size // CHUNK) * CHUNK, columns), np.float32) for name, (size, columns) in sizes.items()}
    for row in chunks.collect():
        at = row["chunk"] * CHUNK
        dense[row["table"]][at:at + CHUNK] = np.frombuffer(row["data"], np.float32).reshape(CHUNK, -1)
    return {name: dense[name][:size] for name, (size, _) in sizes.items()}


def fit(labelled):
    """Models of bytes and of words from documents (text, _label)."""
    counted = stage(count_expressions(labelled), "expressions")
    orders = {ORDER: counted.where("kind = 0").withColumnRenamed("number", "sequence")}
    for k in range(ORDER - 1, 0, -1):
        suffix = F.col("sequence").bitwiseAND((1 << 8 * k) - 1).alias("sequence")
        seen = [(F.col(c) > 0).cast("long").alias(c) for c in _CLASSES] if k > SHARED else [F.lit(1).alias("both")]
        columns = _CLASSES if k > SHARED else ["both"]
        orders[k] = stage(orders[k + 1].select(suffix, *seen).groupBy("sequence").agg(
            *(F.sum(c).alias(c) for c in columns)), "sequences")
    word_counts = counted.where("kind = 1")
    cuts = _discounts({k: rows for k, rows in orders.items() if k > 1} | {"words": word_counts})
    tables, sizes = [], {}

    def add(rows, name, key, size, columns):
        tables.append(_table(rows, name, key, size, columns))
        sizes[name] = size, len(columns)

    add(orders[1], "1", "sequence", 256, ["both"])
    add(orders[2], "2", "sequence", BUCKETS[2], ["both"])
    for k in range(SHARED + 1, ORDER + 1):
        rows = orders[k].select("sequence", F.shiftright("sequence", 8).alias("context"), *_CLASSES, *(
            F.greatest(F.col(c) - F.lit(cuts[k, c]), F.lit(0.0)).alias(f"{c}_cut") for c in _CLASSES), *(
            (F.col(c) > 0).cast("long").alias(f"{c}_kinds") for c in _CLASSES))
        add(rows, f"{k}", "sequence", BUCKETS[k], [f"{c}_cut" for c in _CLASSES])
        add(rows, f"{k} contexts", "context", BUCKETS[k - 1], [*_CLASSES, *(f"{c}_kinds" for c in _CLASSES)])
    for i, size in enumerate(WORD_BUCKETS):
        add(word_counts, f"words {i}", "number", size, _CLASSES)
    dense = _collect(tables, sizes)
    # Sequences of up to SHARED bytes: probabilities, the same for both classes.
    single, pairs, cut = dense["1"][:, 0], dense["2"].reshape(256, 256), cuts[2, "both"]
    lower = (single + 1) / (single.sum() + 256)
    total = pairs.sum(axis=1, keepdims=True)
    some = np.maximum(total, 1)
    rest = np.where(total > 0, cut * (pairs > 0).sum(axis=1, keepdims=True) / some, 1)
    shared = (np.maximum(pairs - cut, 0) / some + rest * lower).astype(np.float32).ravel()
    longer = {}
    for k in range(SHARED + 1, ORDER + 1):
        total, kinds = dense[f"{k} contexts"][:, :2], dense[f"{k} contexts"][:, 2:]
        some = np.maximum(total, 1)
        rest = np.where(total > 0, np.array([cuts[k, c] for c in _CLASSES], np.float32) * kinds / some, 1)
        longer[k] = (dense[f"{k}"], np.column_stack((np.where(total > 0, 1 / some, 0), rest)).astype(np.float32),
                     np.array([cuts[k, c] for c in _CLASSES], np.float32))
    words_of = [dense[f"words {i}"] for i in range(len(WORD_BUCKETS))]
    share = (words_of[0].sum(axis=0, dtype=np.float64) + 1) / (words_of[0].sum(dtype=np.float64) + 2)
    return shared, longer, (words_of, np.array([cuts["words", c] for c in _CLASSES]), share)


def _discounts(tables):
    """The Kneser-Ney discount n1 / (n1 + 2 n2) of each table and class."""
    columns = {k: [c for c in (*_CLASSES, "both") if c in rows.columns] for k, rows in tables.items()}
    counts = reduce(lambda x, y: x.unionByName(y), (
        rows.agg(F.sum((F.col(c) == 1).cast("long")).alias("once"), F.sum((F.col(c) == 2).cast("long")).alias("twice"))
        .withColumns({"k": F.lit(str(k)), "c": F.lit(c)}) for k, rows in tables.items() for c in columns[k]))
    found = {(r["k"], r["c"]): (r["once"] or 0, r["twice"] or 0) for r in counts.collect()}
    out = {}
    for k in tables:
        for c in columns[k]:
            once, twice = found[str(k), c]
            out[k, c] = once / (once + 2 * twice) if once else 0.5
    return out


def _shared_rows(text, numbers):
    """For each row the number of its group of equal (text, number), and a row of each group."""
    order = np.lexsort((numbers, text))
    new = np.ones(len(order), bool)
    new[1:] = (numbers[order][1:] != numbers[order][:-1]) | (text[order][1:] != text[order][:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, order[new]


def _without_own(tables, full, before, text, side):
    """Discounted counts and context weights per byte and order, with what each
    text itself has added to its class taken out.

    At the highest order that is its occurrences; below, the sequences of the
    order above that are gone with it. ``side`` is the class of each byte's text.
    """
    out, rows = {}, np.arange(len(full))
    lost = np.ones(len(full))  # per byte: what its sequence takes from the count
    for k in sorted(tables, reverse=True):
        counts, contexts, cut = tables[k]
        sequence = full & np.uint64((1 << 8 * k) - 1)
        own = counts[(sequence % np.uint64(BUCKETS[k])).astype(np.int64)].astype(np.float64)
        context = before & np.uint64((1 << 8 * (k - 1)) - 1)
        around = contexts[(context % np.uint64(BUCKETS[k - 1])).astype(np.int64)].astype(np.float64)
        group, first = _shared_rows(text, sequence)
        taken = np.bincount(group, lost)
        value, less = own[rows, side], cut[side]
        left = np.where(value > 0, value + less, 0) - taken[group]
        own[rows, side] = np.maximum(left - less, 0)
        gone = (value > 0) & (left < 0.5)
        of_context, _ = _shared_rows(text, context)
        total = np.where(around[rows, side] > 0, 1 / np.maximum(around[rows, side], 1e-12), 0)
        kinds = around[rows, 2 + side] * total / np.maximum(less, 1e-9)
        once = np.zeros(len(full))
        once[first] = 1  # each of the text's sequences once
        total = total - np.bincount(of_context, once * taken[group])[of_context]
        kinds = kinds - np.bincount(of_context, once * gone)[of_context]
        seen = total > 0.5
        around[rows, side] = np.where(seen, 1 / np.maximum(total, 0.5), 0)
        around[rows, 2 + side] = np.where(seen, np.clip(less * kinds / np.maximum(total, 0.5), 1e-6, 1), 1)
        out[k], lost = (own, around), once * gone
    return out


def byte_ratios(model, data, offsets, toxic=None):
    """Log of toxic over ordinary probability for each byte of a block.

    ``toxic``: whether each text is, where the texts' own counts are to be left out.
    """
    shared, tables, _ = model
    padded, first, lengths = _padded(data, offsets)
    places = _of_texts(first, lengths)
    sequences = _sequences(padded, ORDER)
    full, before = sequences[places], sequences[places - 1]
    adjusted = None
    if toxic is not None:
        text = np.repeat(np.arange(len(lengths)), lengths)
        adjusted = _without_own(tables, full, before, text, np.where(toxic, 0, 1)[text])
    p = np.repeat(shared[(full & np.uint64(0xFFFF)).astype(np.int64)][:, None], 2, axis=1)
    for k in sorted(tables):
        if adjusted:
            own, around = adjusted[k]
        else:
            counts, contexts, _ = tables[k]
            own = counts[((full & np.uint64((1 << 8 * k) - 1)) % np.uint64(BUCKETS[k])).astype(np.int64)]
            around = contexts[((before & np.uint64((1 << 8 * (k - 1)) - 1)) % np.uint64(BUCKETS[k - 1])).astype(np.int64)]
        p = own * around[:, :2] + around[:, 2:] * p
    return np.log(p[:, 0]) - np.log(p[:, 1]), offsets


def word_ratios(model, data, offsets, toxic=None):
    """The same for each word."""
    numbers, first = _word_numbers(data, offsets)
    tables, cut, share = model[2]
    counts = np.minimum(*(x[(numbers % np.uint64(len(x))).astype(np.int64)] for x in tables)).astype(np.float64)
    if toxic is not None:
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        group, _ = _shared_rows(text, numbers)
        rows, side = np.arange(len(numbers)), np.where(toxic, 0, 1)[text]
        counts[rows, side] = np.maximum(counts[rows, side] - np.bincount(group)[group], 0) if len(group) else 0
    smoothed = np.maximum(counts - cut, 0) + (cut * (counts > 0)).sum(axis=1, keepdims=True) * share
    ratio = np.log(np.maximum(smoothed, 1e-9) / share)
    return np.where(counts.any(axis=1), ratio[:, 0] - ratio[:, 1], 0), first


def features(model, column, toxic=None):
    """For each text and both kinds of ratios: the mean, the highest sum over a
    window, and the log of what exceeds STRONG by the root of the length.

    ``toxic``: the classes of the texts, to leave their own counts out.
    """
    out = np.zeros((len(column), len(_FEATURES)))
    for at, data, offsets in words.blocks(column):
        for k, (of, window) in enumerate(((byte_ratios, WINDOW), (word_ratios, WINDOW_WORDS))):
            ratios, begin = of(model, data, offsets, None if toxic is None else toxic[at:at + len(offsets) - 1])
            lengths = np.diff(begin)
            sums = np.concatenate(([0.0], np.cumsum(ratios, dtype=np.float64)))
            ends = np.arange(1, len(sums))
            windowed = sums[ends] - sums[np.maximum(np.repeat(begin[:-1], lengths), ends - window)]
            some = np.flatnonzero(lengths)
            if len(some):
                out[at + some, 3 * k] = (sums[begin[some + 1]] - sums[begin[some]]) / lengths[some]
                out[at + some, 3 * k + 1] = np.maximum.reduceat(windowed, begin[some])
                strong = np.add.reduceat(np.maximum(ratios - STRONG, 0), begin[some], dtype=np.float64)
                out[at + some, 3 * k + 2] = np.log1p(strong / np.sqrt(lengths[some]))
    return out


def _with_features(docs, model, text, names=_FEATURES, label=None):
    columns, place = docs.columns, docs.columns.index(text)

    def add(batches):
        for batch in batches:
            toxic = None if label is None else batch[label].to_numpy() == 1
            found = features(model.value, batch.column(place), toxic)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found.T.copy())], names=[*columns, *names])

    return map_batches(docs, add, T.StructType([*docs.schema, *(T.StructField(c, T.DoubleType()) for c in names)]))


def score_toxicity(docs, train, key="doc_id", text="text", column="score"):
    """``docs`` with ``column``, 0 to 1, higher for likelier toxic texts.

    ``train``: documents (key, text, _label). All are counted; about
    ``SCALE_ROWS`` of them, by hash of the key, or all of fewer teach the scale,
    each scored without its own counts. Null and empty texts have no evidence and get the
    score of a ratio of 0. Without training documents of both classes on the
    scale a ratio of 10 over a stretch of words scores one half. A column of that name is
    replaced; rows come out as often as they came in.
    """
    spark = docs.sparkSession
    train = train.select(F.col(key).alias("key"), F.col(text).alias("text"), "_label")
    model = spark.sparkContext.broadcast(fit(train))
    scale = train.where(F.pmod(F.xxhash64("key"), F.lit(max(SCALE_ROWS, train.count()))) < SCALE_ROWS)
    rows = _with_features(scale.select("_label", "text"), model, "text", label="_label").drop("text").toPandas()
    x, y = rows[_FEATURES].to_numpy(), rows["_label"].to_numpy()
    weights = fit_logistic(x, y) if 0 < y.sum() < len(y) else np.array([0.0, 0.0, 0.0, 0.0, 1.0, 0.0, -10.0])
    docs = docs.drop(column)
    names = [free_name(name, docs.columns) for name in _FEATURES]
    logit = F.lit(float(weights[-1]))
    for name, weight in zip(names, weights):
        logit += F.col(name) * float(weight)
    return _with_features(docs, model, text, names).withColumn(column, 1 / (1 + F.exp(-logit))).drop(*names)


def training_documents(spark, sf_dir, docs=None, label="toxic", folds=5, out=0):
    """Labelled documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    known = with_labels(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), label)
    return known.where(fold("doc_id", folds) != out)


def op1_toxicity(spark, sf_dir):
    """Toxicity of every document; labels of fold 0 of 5 are never used."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, training_documents(spark, sf_dir))
    return scored.select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
