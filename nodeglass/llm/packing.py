"""Op 9: packing documents into sequences by best-two-fit.

A bin is first filled greedily, each time with the longest piece that fits.
Then its smallest piece is taken out again if two pieces not yet packed fill the
wider gap more tightly. Pieces are dealt by hash into groups of about
``GROUP_PIECES``, each packed by one task; every group fills thousands of
sequences and leaves one or two part-filled ones.
"""

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from nodeglass.llm import words
from nodeglass.llm.tables import map_batches, stage, table

VOCABULARY = "word_bpe_49k.json"
SEQUENCE_TOKENS = 4096
END_ID = 1  # stands after each document
GROUP_PIECES = 20_000
KEPT_WORDS = 300_000  # words whose ids a task keeps; emptied beyond this number
# Words of printable Latin-1 letters and signs; nothing but lower-casing changes them.
_PLAIN = re.compile(rb"(?:[!-;=-~]|\xc2[\xa1-\xac\xae-\xbf]|\xc3[\x80-\xbf])+").fullmatch
_WORD_END, _NEXT_WORD = "\x01", "\n"  # neither is part of a plain word


class WordIds:
    """Token ids of words, as the tokenizer of the file gives them.

    The tokenizer drops white space, so a text's ids are those of its words in
    order, and a word is looked up once per block however often it stands there.
    Plain words go straight to the byte-pair merges of the file, all others
    through the tokenizer itself.
    """

    def __init__(self, path):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        self.mark_pieces = regex.compile(form["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).sub
        byte_of, end = self._byte_names(), _WORD_END.encode()

        def spelled(token):
            ends = token.endswith("</w>")
            return bytes(byte_of[c] for c in (token[:-4] if ends else token)) + (end if ends else b"")

        ranks = {}
        for token in [bytes([b]) for b in range(256)] + [bytes([b]) + end for b in range(256)]:
            ranks.setdefault(token, len(ranks))
        for pair in form["model"]["merges"]:
            ranks.setdefault(spelled("".join(pair.split(" ") if isinstance(pair, str) else pair)), len(ranks))
        special = {t["content"] for t in form["added_tokens"]}
        ids = {spelled(t): i for t, i in form["model"]["vocab"].items() if t not in special}
        self.id_of = np.array([ids.get(token, 0) for token in ranks], np.uint32)
        self.merges = tiktoken.Encoding(
            "words", pat_str=f"[^{_NEXT_WORD}{_WORD_END}]+{_WORD_END}|{_NEXT_WORD}", mergeable_ranks=ranks,
            special_tokens={},
        )
        self.forget()

    def forget(self):
        """Known words: ascending hashes, place and number of each word's ids."""
        self.keys, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    @staticmethod
    def _byte_names():
        """Bytes by the characters that stand for them in byte-level files."""
        plain = [b for b in range(256) if chr(b).isprintable() and b not in (32, 173)]
        rest = [b for b in range(256) if b not in set(plain)]
        return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}

    def encode(self, found):
        """Ids of a list of words as bytes: (all ids, number of each word's)."""
        simple = np.fromiter((_PLAIN(w) is not None for w in found), bool, len(found))
        sizes, parts = np.zeros(len(found), np.int64), []
        if simple.any():
            text = (_NEXT_WORD.encode().join([w for w, s in zip(found, simple) if s]) + _NEXT_WORD.encode()).decode()
            marked = self.mark_pieces(r"\g<0>" + _WORD_END, text.lower())
            ranks = self.merges.encode_to_numpy(marked, disallowed_special=())
            stop = np.flatnonzero(ranks == ord(_NEXT_WORD))
            sizes[simple] = np.diff(stop, prepend=-1) - 1
            parts.append(self.id_of[np.delete(ranks, stop)])
        others = [w.decode("utf-8", "replace") for w, s in zip(found, simple) if not s]
        coded = [e.ids for e in self.tokenizer.encode_batch(others, add_special_tokens=False)]
        sizes[~simple] = [len(ids) for ids in coded]
        parts.append(np.array([i for ids in coded for i in ids], np.uint32))
        begin = np.empty(len(found), np.int64)
        grouped = np.concatenate((sizes[simple], sizes[~simple]))
        begin[np.concatenate((np.flatnonzero(simple), np.flatnonzero(~simple)))] = np.cumsum(grouped) - grouped
        return np.concatenate(parts), begin, sizes

    def of_words(self, data, starts, ends):
        """Ids of all words of a buffer: (ids, place of each word's first id)."""
        hashes = words.word_hashes(words.LOWER[data], starts, ends)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        new[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] != distinct[at < len(self.keys)]
        if new.any():
            if len(self.keys) > KEPT_WORDS:
                self.forget()
                new[:], at[:] = True, 0
            content, asked = data.tobytes(), first[new]
            ids, begin, size = self.encode([content[a:b] for a, b in zip(starts[asked].tolist(), ends[asked].tolist())])
            self.begin = np.insert(self.begin, at[new], begin + len(self.flat))
            self.size = np.insert(self.size, at[new], size)
            self.keys = np.insert(self.keys, at[new], distinct[new])
            self.flat = np.concatenate((self.flat, ids))
            at = np.searchsorted(self.keys, distinct)
        begin, size = self.begin[at][which], self.size[at][which]
        places = np.concatenate(([0], np.cumsum(size)))
        return self.flat[np.arange(places[-1]) + np.repeat(begin - places[:-1], size)], places


def cut_pieces(docs, vocabulary, key="doc_id", text="text", limit=SEQUENCE_TOKENS, end_id=END_ID):
    """Pieces of at most ``limit`` ids of each document.

    Returns key, piece, start, length and the crc32 of the piece's ids as
    little-endian unsigned 32-bit numbers. Only documents longer than ``limit``
    are cut. A null text is empty and has the end id alone. One pass, no shuffle.
    """

    def cut(batches):
        encode = WordIds(vocabulary)
        for batch in batches:
            rows = {name: [] for name in ("row", "piece", "start", "length", "ids_crc32")}
            for at, data, offsets in words.blocks(batch.column(1)):
                starts, ends, first = words.word_spans(data, offsets)
                ids, places = encode.of_words(data, starts, ends)
                bounds = places[first]
                for k in range(len(offsets) - 1):
                    own = np.append(ids[bounds[k]:bounds[k + 1]], np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), limit)):
                        part = own[start:start + limit]
                        for name, x in zip(rows, (at + k, piece, start, len(part), zlib.crc32(part.tobytes()))):
                            rows[name].append(x)
            columns = [batch.column(0).take(pa.array(rows["row"], pa.int64())), pa.array(rows["piece"], pa.int32())]
            columns += [pa.array(rows[name], pa.int64()) for name in ("start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "piece", "start", "length", "ids_crc32"])

    pieces = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType)]
                          + T._parse_datatype_string("piece int, start long, length long, ids_crc32 long").fields)
    return map_batches(pieces, cut, schema).withColumnRenamed("key", key)


def best_two_fit(lengths, limit):
    """Bin number and offset for each piece; all lengths lie in 1..limit."""
    lengths = np.asarray(lengths, np.int64)
    order = np.argsort(lengths, kind="stable")
    stock = np.bincount(lengths, minlength=limit + 1)
    bins, left = [], len(lengths)
    below = np.arange(limit + 1)

    def nearest():
        """For each number the largest length in stock that is not above it."""
        return np.maximum.accumulate(np.where(stock > 0, below, 0))

    best = nearest()
    while left:
        content, gap = [], limit
        while best[gap]:
            size = int(best[gap])
            many = min(int(stock[size]), gap // size)
            content += [size] * many
            stock[size] -= many
            gap -= many * size
            if not stock[size]:
                best[size:] = np.where(best[size:] == size, best[size - 1], best[size:])
        left -= len(content)
        if gap and left > 1 and len(content) > 1:
            smallest = content[-1]
            room = gap + smallest
            # Two different or equal lengths a >= b with the largest sum in (smallest, room].
            a = np.flatnonzero(stock[:room])
            if len(a):
                b = best[np.minimum(room - a, a)]
                b = np.where((b == a) & (stock[a] < 2), best[a - 1], b)
                total = np.where(b > 0, a + b, 0)
                k = int(np.argmax(total))
                if total[k] > smallest:
                    content = content[:-1] + [int(a[k]), int(b[k])]
                    for x in content[-2:]:
                        stock[x] -= 1
                    stock[smallest] += 1
                    left -= 1
                    best = nearest()
        bins.append(content)
    # Hand the pieces of each length out in the order in which bins ask for them.
    sizes = np.array([x for content in bins for x in content], np.int64)
    number = np.repeat(np.arange(len(bins)), [len(c) for c in bins])
    before = np.cumsum(sizes) - sizes
    offset = before - before[np.searchsorted(number, number)]
    asked = np.argsort(sizes, kind="stable")
    where, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    where[order], offsets[order] = number[asked], offset[asked]
    return where, offsets


def pack(pieces, limit=SEQUENCE_TOKENS, group_pieces=GROUP_PIECES):
    """``pieces`` (with a column length) with sequence_id and offset.

    Sequences are filled from offset 0 without gaps. The number of groups
    follows the number of pieces, so a task's work is bounded; dealing is by a
    hash of the whole row and does not depend on partitioning.
    """
    pieces = stage(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    schema = T.StructType(pieces.schema.fields + T._parse_datatype_string("sequence_id long, offset long").fields)

    def fill(rows):
        rows = rows.sort_values(rows.columns.tolist()[:-1], kind="stable", ignore_index=True)
        number, offset = best_two_fit(rows["length"], limit)
        group = int(rows["_group"].iloc[0])
        return rows.drop(columns="_group").assign(sequence_id=(group << 32) + number, offset=offset)

    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(*pieces.columns), F.lit(groups)).cast("int"))
    return dealt.groupBy("_group").applyInPandas(fill, schema)


def pack_documents(docs, vocabulary, key="doc_id", text="text", limit=SEQUENCE_TOKENS):
    """Pieces of all documents with their place in the packed sequences."""
    return pack(cut_pieces(docs, vocabulary, key, text, limit), limit)


def op9_best_fit_packing(spark, sf_dir):
    """Every document's pieces, packed into sequences of 4096 tokens."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
