"""Op 3: token counts by a longest-match automaton.

The vocabulary's pieces form a trie. A failure link leads from each node to the
node for what is left after the longest pieces at its front were taken off, and
the node keeps how many pieces those were. A word is then read once, character
by character: going down the trie, or along failure links adding their counts.
That gives the number of pieces of the greedy longest match without ever
building the pieces or reading a character twice.
"""

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from nodeglass.llm.tables import map_batches, table

MARK = "▁"  # stands before each word in the vocabulary
VOCABULARY = "piece_bpe_32k.model"
# Lengths of words are kept per worker; the store is emptied at this size.
KEPT_WORDS = 500_000
SCHEMA = "n_words long, n_tokens long"


def read_vocabulary(path):
    """The pieces of a vocabulary file, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(k(i) for k in kinds)]


class LongestMatch:
    """Counts pieces of words by greedy longest match.

    A character that is no piece by itself, where no longer piece fits either,
    counts as one token for each of its UTF-8 bytes.
    """

    def __init__(self, pieces):
        singles = {c for piece in pieces for c in piece}
        worth = {c: len(c.encode()) for c in singles} | {piece: 1 for piece in pieces if piece}
        self.down, taken = [{}], {}
        for piece, tokens in worth.items():
            node = 0
            for c in piece:
                if c not in self.down[node]:
                    self.down[node][c] = len(self.down)
                    self.down.append({})
                node = self.down[node][c]
            taken[node] = tokens
        # fail[v], popped[v]: the node of what is left of v's string after the
        # longest pieces at its front, and the tokens of those pieces. As each
        # character in the trie can stand alone, only the root has no link.
        self.fail, self.popped = [None] * len(self.down), [0] * len(self.down)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for c, node in self.down[parent].items():
                queue.append(node)
                if node in taken:
                    self.fail[node], self.popped[node] = 0, taken[node]
                    continue
                rest, n = self.fail[parent], self.popped[parent]
                while c not in self.down[rest]:
                    n += self.popped[rest]
                    rest = self.fail[rest]
                self.fail[node], self.popped[node] = self.down[rest][c], n

    def count(self, word):
        """Number of tokens of ``word``; 0 for an empty one."""
        down, fail, popped = self.down, self.fail, self.popped
        node = n = 0
        for c in word:
            while c not in down[node]:
                if not node:
                    n += len(c.encode("utf-8", "surrogatepass"))
                    break
                n += popped[node]
                node = fail[node]
            else:
                node = down[node][c]
        while node:
            n += popped[node]
            node = fail[node]
        return n


class WordLengths(dict):
    """Lengths of the words met so far, computed when first asked for."""

    def __init__(self, automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word):
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = n = self.automaton.count(MARK + word)
        return n


def count_tokens(docs, vocabulary, text="text"):
    """``docs`` with the number of words and of tokens of each text.

    ``vocabulary``: path of a vocabulary file present on every machine (a
    parameter of the environment, like the Python libraries). Words are what
    ``str.split`` gives. Null and empty texts have 0 of both. Columns already
    called n_words or n_tokens are replaced. One pass over the rows, no
    shuffle; a worker holds the automaton and a bounded store of word lengths.
    """
    kept = [c for c in docs.columns if c not in ("n_words", "n_tokens")]
    place = kept.index(text)

    def count(batches):
        lengths = WordLengths(LongestMatch(read_vocabulary(vocabulary)))
        for batch in batches:
            words, tokens = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for i, value in enumerate(batch.column(place)):
                split = (value.as_py() or "").split()
                words[i], tokens[i] = len(split), sum(map(lengths.__getitem__, split))
            columns = batch.columns + [pa.array(words), pa.array(tokens)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_words", "n_tokens"])

    schema = T.StructType([*docs.select(*kept).schema, *T._parse_datatype_string(SCHEMA)])
    return map_batches(docs.select(*kept), count, schema)


def op3_token_counts(spark, sf_dir):
    """Word and token counts of every document."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return count_tokens(docs.select("doc_id", "text"), public_tokenizers.path(VOCABULARY)).drop("text")
