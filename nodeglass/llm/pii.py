"""Op 2: personal data by a skip-chain conditional random field.

Patterns find the sure cases, which stay whatever follows. The other words that
hold a digit, ``@`` or ``+`` are nodes of a random field per document, labelled
as no data or one of the kinds. Words next to each other are joined by chain
edges; words that repeat or resemble each other (the same letters and digits, the
same last digits, the name before an ``@``) by skip edges, however far apart.
Loopy message passing then carries the labels of sure cases to their look-alikes,
so a number written with its prefix once and without it later is found twice.

Weights are learned by pseudo-likelihood on a bounded sample of documents, where
the patterns' findings are the labels. Skip edges lead from each of n look-alikes
to the first finding of every kind among them, so each is one edge away from a
sure case. Where none was found they lead to the first of them (of those that
resemble a finding otherwise, if any do), and only from words that resemble none.
That is at most one edge per kind, key and word, linear in the text. Messages are
passed until they no longer change.
"""

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from nodeglass.llm.tables import map_batches, table

# Kinds of data, in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match cannot start inside a run of digits, so the look-behind only saves time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]").search
_WORD = re.compile(r"\S++")
_MARKED = re.compile(r"[0-9@+]").search

SAMPLE_DOCUMENTS = 20_000  # of which those with digits or @ train the field,
SAMPLE_WORDS = 50_000  # one after the other until they have so many words of the field
RUN_WORDS = 20_000
BUCKETS = 4096
SETTLED = 1e-3  # change of a message or node below which it has settled
MOST_ROUNDS = 500  # of message passing; words that loops still move then keep what they have come to
ALIKE = 6.0  # log weight for equal labels of words that repeat or resemble each other
CERTAIN = 0.9  # probability from which a word gets a span
_SURE = 20.0  # log potential of a pattern's finding
LABELS = 1 + len(KINDS)

SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def _emails(text):
    """Leftmost matches around each ``@``, in time linear in the text."""
    begin, at = 0, text.find("@")
    while at >= 0:
        before = text[begin:at]
        start = begin + len(before.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        begin = found.end() if found else at + 1
        at = text.find("@", begin)


def _luhn(digits):
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text):
    """(start, kind number, end) of the patterns' findings, in listing order."""
    out = [(start, 0, end) for start, end in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _shape(word):
    """Digits as 9, letters as a, runs of up to six kept apart, the rest shortened."""
    kinds = ["9" if "0" <= c <= "9" else "a" if c.isalpha() else c for c in word]
    out = []
    for c in kinds:
        if len(out) < 6 or out[-6:] != [c] * 6:
            if not (c == "a" and out[-1:] == ["a"]):
                out.append(c)
    return "".join(out)


def _keys(word):
    """Names under which a word is the same as, or resembles, another one."""
    core = "".join(c for c in word.casefold() if c.isalnum())
    digits = "".join(c for c in core if "0" <= c <= "9")
    if len(core) >= 4:
        yield core
    if len(digits) >= 7:
        yield "-" + digits[-7:]
    name = word.partition("@")
    if name[1] and len(name[0]) >= 4:
        yield "".join(c for c in name[0].casefold() if c.isalnum())


class Field:
    """Nodes and edges of the fields of many documents."""

    def __init__(self):
        self.document, self.start, self.end, self.label = [], [], [], []
        self.features, self.chain, self.skip = [], [], []

    def add(self, document, text, base):
        """Add a document's words with a digit, ``@`` or ``+``."""
        alike, last = {}, None
        at = 0
        for number, m in enumerate(_WORD.finditer(text)):
            word = m.group()
            if not _MARKED(word):
                continue
            node = len(self.start)
            # A word overlapping a finding has its label; both are in order of start.
            while at < len(base) and base[at][2] <= m.start():
                at += 1
            label = base[at][1] + 1 if at < len(base) and base[at][0] < m.end() else 0
            shape = _shape(word)
            near = last is not None and last[0] == number - 1
            features = ["", "s" + shape, "c" + shape.strip(".,;:()!?\"'"), "p" + (last[2] if near else "w")]
            if near:
                self.chain.append((last[1], node))
                self.features[last[1]][4] = zlib.crc32(("n" + shape).encode()) % BUCKETS
            self.features.append([zlib.crc32(f.encode()) % BUCKETS for f in [*features, "nw"]])
            for key in dict.fromkeys(_keys(word)):
                alike.setdefault(key, []).append(node)
            self.document.append(document)
            self.start.append(m.start())
            self.end.append(m.end())
            self.label.append(label)
            last = (number, node, shape)
        joined, unsure = set(), []
        for nodes in alike.values():
            hubs = {}
            for node in nodes:
                hubs.setdefault(self.label[node], node)
            hubs.pop(0, None)
            if not hubs:
                unsure.append(nodes)
                continue
            joined.update(nodes)
            for node in nodes:
                # A finding is joined to the first of its own kind, any other word to all.
                ends = [hubs[self.label[node]]] if self.label[node] else hubs.values()
                self.skip += [(min(hub, node), max(hub, node)) for hub in ends if hub != node]
        # Words joined to a finding need no more; many of one mind would outvote it.
        for nodes in unsure:
            hub = next((node for node in nodes if node in joined), nodes[0])
            self.skip += [(min(hub, node), max(hub, node)) for node in nodes if node != hub and node not in joined]

    def arrays(self):
        edges = lambda pairs: np.array(pairs, np.int64).reshape(-1, 2)
        return np.array(self.features, np.int64).reshape(-1, 5), edges(self.chain), edges(self.skip), np.array(self.label, np.int64)


def _sum_at(place, rows, n):
    """Sums of the rows that go to each of ``n`` places."""
    return np.column_stack([np.bincount(place, column, n) for column in rows.T])


def learn(field, steps=100, rate=0.5, penalty=1e-4):
    """Weights (nodes, chain, skip) by gradient steps on the pseudo-likelihood.

    Each word's label is predicted from its features and its neighbours' labels.
    What looks like a finding but was not found itself is neither: such words
    and their edges are left out. Skip weights start from, and are drawn
    towards, ``ALIKE`` for equal labels.
    """
    features, chain, skip, label = field.arrays()
    start = [np.zeros((BUCKETS, LABELS)), np.zeros((LABELS, LABELS)), np.eye(LABELS) * ALIKE]
    if not len(label):
        return tuple(start)
    open_ = np.zeros(len(label), bool)
    for a, b in ((skip[:, 0], skip[:, 1]), (skip[:, 1], skip[:, 0])):
        open_[b[(label[a] > 0) & (label[b] == 0)]] = True
    chain, skip = (e[~open_[e].any(axis=1)] for e in (chain, skip))
    known, weights = np.eye(LABELS)[label], [w.copy() for w in start]
    by_feature = np.argsort(features, axis=None, kind="stable")
    present, first_of = np.unique(features.ravel()[by_feature], return_index=True)
    seen = [np.full_like(w, 1e-8) for w in weights]
    for _ in range(steps):
        z = weights[0][features].sum(axis=1)
        for table_, edges in zip(weights[1:], (chain, skip)):
            z += _sum_at(edges[:, 1], table_[label[edges[:, 0]]], len(z))
            z += _sum_at(edges[:, 0], table_.T[label[edges[:, 1]]], len(z))
        p = np.exp(z - z.max(axis=1, keepdims=True))
        error = (p / p.sum(axis=1, keepdims=True) - known) * ~open_[:, None]
        slopes = [np.zeros_like(weights[0])]
        slopes[0][present] = np.add.reduceat(error[by_feature // features.shape[1]], first_of)
        for edges in (chain, skip):
            slopes.append(known[edges[:, 0]].T @ error[edges[:, 1]] + error[edges[:, 0]].T @ known[edges[:, 1]])
        slopes[2] = (slopes[2] + slopes[2].T) / 2  # a skip edge has no direction
        for table_, first, slope, total in zip(weights, start, slopes, seen):
            slope = slope / len(label) + penalty * (table_ - first)
            total += slope ** 2
            table_ -= rate * slope / np.sqrt(total)
    return tuple(weights)


def pass_messages(weights, field, rounds=None):
    """Label probabilities of every node after loopy belief propagation.

    ``rounds``: exactly so many, or until nothing moves. Only messages whose
    source has moved or which still move themselves are made again, so what a
    document gets does not depend on the others of the field. Findings stay.
    """
    node, on_chain, on_skip = weights
    features, chain, skip, label = field.arrays()
    own = node[features].sum(axis=1)
    own[label > 0] = -_SURE
    own[label > 0, label[label > 0]] = _SURE
    edges = np.concatenate((chain, skip))
    tables = np.concatenate((np.repeat(on_chain[None], len(chain), 0), np.repeat(on_skip[None], len(skip), 0)))
    tables = np.concatenate((tables, tables.transpose(0, 2, 1)))
    source, target = np.concatenate((edges, edges[:, ::-1])).T
    messages = np.zeros((len(tables), LABELS))
    belief, least = own.copy(), SETTLED if rounds is None else 0
    stale = np.arange(len(tables))
    for _ in range(MOST_ROUNDS if rounds is None else rounds):
        if not len(stale):
            break
        back = (stale + len(edges)) % len(tables)
        out = (belief[source[stale]] - messages[back])[:, :, None] + tables[stale]
        top = out.max(axis=1, keepdims=True)
        out = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
        out -= out.max(axis=1, keepdims=True)
        change = 0.5 * (out - messages[stale])
        messages[stale] += change
        step = _sum_at(target[stale], change, len(own))
        step[label > 0] = 0
        belief += step
        again = (np.abs(step).max(axis=1) > least)[source]
        again[stale[np.abs(change).max(axis=1) > least]] = True
        stale = np.flatnonzero(again)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _added(field, probability, texts, base):
    """(document, start, kind number, end) of spans that the field adds."""
    best = probability.argmax(axis=1)
    open_ = None
    for i in np.flatnonzero((best > 0) & (probability.max(axis=1) >= CERTAIN)).tolist():
        if field.label[i]:
            continue
        document, kind, start, end = field.document[i], int(best[i]) - 1, field.start[i], field.end[i]
        word = texts[document][start:end]
        start += len(word) - len(word.lstrip(".,;:!?\"'<>[]{}"))
        end -= len(word) - len(word.rstrip(".,;:!?\"'<>[]{}"))
        if open_ and open_[0] == document and open_[1] == kind and open_[4] == i - 1 and texts[document][open_[3]:start].isspace():
            open_ = (document, kind, open_[2], end, i)
            continue
        if open_:
            yield open_[:4]
        open_ = (document, kind, start, end, i) if start < end else None
    if open_:
        yield open_[:4]


def spans_of(texts, weights):
    """For each text its spans (start, kind number, end, from a pattern), in order.

    Documents are labelled in runs of about ``RUN_WORDS`` words of the field.
    """
    field, base, out = Field(), {}, [[] for _ in texts]

    def finish():
        for k, kind, start, end in _added(field, pass_messages(weights, field), texts, base):
            if not any(a < end and b > start for a, _, b in base[k]):
                out[k].append((start, kind, end, False))

    for k, text in enumerate(texts):
        if _ANY(text):
            base[k] = base_spans(text)
            out[k] = [(*span, True) for span in base[k]]
            field.add(k, text, base[k])
            if len(field.start) >= RUN_WORDS:
                finish()
                field = Field()
    if field.start:
        finish()
    return [sorted(spans) for spans in out]


def fit(docs, key="doc_id", text="text"):
    """Weights of the field, learned in one task on a bounded sample by key hash."""
    total = docs.count()
    sample = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.lit(0).alias("all"))
    if total > SAMPLE_DOCUMENTS:
        sample = sample.where(F.pmod(F.xxhash64("key"), F.lit(total)) < SAMPLE_DOCUMENTS)
    sample = sample.where(F.col("text").rlike("[0-9@]"))

    def one(rows):
        order = pd.util.hash_pandas_object(rows["text"], index=False)
        rows = rows.assign(order=order).sort_values(["order", "key"])
        field = Field()
        for k, value in enumerate(rows["text"]):
            field.add(k, value, base_spans(value))
            if len(field.start) >= SAMPLE_WORDS:
                break
        return pd.DataFrame({"weights": [w.astype("<f8").tobytes() for w in learn(field)], "part": range(3)})

    rows = sample.groupBy("all").applyInPandas(one, "weights binary, part int").orderBy("part").collect()
    if not rows:
        return learn(Field())
    sizes = ((BUCKETS, LABELS), (LABELS, LABELS), (LABELS, LABELS))
    return tuple(np.frombuffer(r["weights"], "<f8").reshape(s) for r, s in zip(rows, sizes))


def _texts(column):
    return [value or "" for value in column.to_pylist()]


def find_personal_data(docs, key="doc_id", text="text"):
    """``docs`` with ``spans``: kind, start, end (code points, end exclusive) and
    whether a pattern found it (base), by start, then kind.

    Base spans follow the patterns leftmost without overlap per kind; spans that
    the field adds never overlap them. Null and empty texts have none. A column
    called spans is replaced; rows come out as often as they came in.
    """
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, key, text))
    kept = [c for c in docs.columns if c != "spans"]
    place = kept.index(text)

    def find(batches):
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": a, "end": b, "base": base} for a, k, b, base in spans]
                     for spans in spans_of(_texts(batch.column(place)), weights.value)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*kept, "spans"])

    schema = T.StructType([*docs.select(*kept).schema, *T._parse_datatype_string(f"spans {SPANS}")])
    return map_batches(docs.select(*kept), find, schema)


def redact(docs, key="doc_id", text="text"):
    """``docs`` with each span of ``text`` replaced by its kind, like ``[EMAIL]``.

    Of overlapping spans the first to start decides, and what follows it within
    the overlap goes with it. Null texts stay null.
    """
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, key, text))
    names, place = docs.columns, docs.columns.index(text)

    def clean(batches):
        for batch in batches:
            values = batch.column(place).to_pylist()
            for i, spans in enumerate(spans_of([v or "" for v in values], weights.value)):
                out, upto = [], 0
                for start, kind, end, _ in spans:
                    if start >= upto:
                        out += [values[i][upto:start], f"[{KINDS[kind].upper()}]"]
                    upto = max(upto, end)
                if out:
                    values[i] = "".join(out) + values[i][upto:]
            columns = batch.columns
            columns[place] = pa.array(values, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(docs, clean, docs.schema)


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2_personal_data(spark, sf_dir):
    """Numbers and places of personal data in every document."""
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    numbers = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *numbers, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
