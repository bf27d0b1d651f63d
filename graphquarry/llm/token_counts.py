"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie in which every node also has a failure link and the number of pieces popped
on taking it: when a word's next character has no edge, the longest matched pieces are given up, as
many as the link says, and matching goes on from the link's node without going back in the word.
Counts therefore come from one pass, and no piece is built. All distinct words of a chunk walk the
automaton in step, one character at a time, as columns of a matrix; counts of words are kept by
their bytes in a bounded table, because words recur.

Words are runs of bytes other than 0x20 and 0x09 to 0x0D. The first piece of a word comes from the
vocabulary's initial pieces, all others from its continuing ones; the longest that fits is taken. A
word that cannot be cut so counts as one (unknown) token. Null and empty texts have none. Repeated
rows give equal counts; an empty table gives no rows; long texts are taken whole. Columns of the input are
passed on if they are named in `keep`, unless they are called like a result, which then wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphquarry.llm import batches as B

MOST_KEPT = 700_000
NULL = -1


class Automaton:
    def __init__(self, initial: list[str], continuing: list[str]):
        self.edges: list[dict[int, int]] = [{}, {}]  # 0: a word's start, 1: after a piece
        ends = [False, False]
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                node = root
                for c in map(ord, piece):
                    if c not in self.edges[node]:
                        self.edges[node][c] = len(self.edges)
                        self.edges.append({})
                        ends.append(False)
                    node = self.edges[node][c]
                ends[node] = True
        n = len(self.edges)
        fail, popped = [NULL] * n, [0] * n
        queue = [0, 1]
        for node in queue:  # breadth first, so that links of shorter strings are known
            for c, child in self.edges[node].items():
                queue.append(child)
                if ends[child]:
                    fail[child], popped[child] = 1, 1
                    continue
                link, count = fail[node], popped[node]
                while link != NULL and c not in self.edges[link]:
                    count += popped[link]
                    link = fail[link]
                if link != NULL:
                    fail[child], popped[child] = self.edges[link][c], count
        self.fail, self.popped = np.array(fail, np.int32), np.array(popped, np.int64)
        self.keys = np.array([(node << 21) | c for node, e in enumerate(self.edges) for c in e], np.int64)
        self.to = np.array([x for e in self.edges for x in e.values()], np.int32)
        order = np.argsort(self.keys)
        self.keys, self.to = self.keys[order], self.to[order]
        del self.edges

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        key = (node.astype(np.int64) << 21) | char
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], NULL)

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each word; words of no characters have none."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        start = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        lengths, start = lengths[order], start[order]
        node, total = np.zeros(len(words), np.int32), np.zeros(len(words), np.int64)
        bad = np.zeros(len(words), bool)
        for step in range(int(lengths.max(initial=0))):
            k = int(np.searchsorted(-lengths, -step, "left"))
            rows = np.flatnonzero(~bad[:k])
            char = chars[start[rows] + step]
            while len(rows):
                to = self.step(node[rows], char)
                node[rows[to != NULL]] = to[to != NULL]
                rows, char = rows[to == NULL], char[to == NULL]
                total[rows] += self.popped[node[rows]]
                node[rows] = self.fail[node[rows]]
                lost = node[rows] == NULL
                bad[rows[lost]] = True
                rows, char = rows[~lost], char[~lost]
        rows = np.flatnonzero(~bad & (lengths > 0) & (node != 1))
        while len(rows):  # give up what is matched at the end
            total[rows] += self.popped[node[rows]]
            node[rows] = self.fail[node[rows]]
            bad[rows[node[rows] == NULL]] = True
            rows = rows[(node[rows] != NULL) & (node[rows] != 1)]
        total[bad] = 1
        out = np.empty(len(words), np.int64)
        out[order] = total
        return out


def word_pieces(path: str) -> tuple[list[str], list[str]]:
    """(initial, continuing) pieces of a sentencepiece model: those with its word mark, and the rest."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [p[1:] for p in usable if p.startswith("▁") and len(p) > 1], [p for p in usable if not p.startswith("▁")]


def loaded(path: str) -> tuple[Automaton, B.Interner, B.Values]:
    return B.held(("pieces", path), lambda: (Automaton(*word_pieces(path)), B.Interner(MOST_KEPT), B.Values(np.int64)))


def count_tokens(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, n_words and n_tokens of each document, by the pieces of a sentencepiece model."""
    keep = tuple(c for c in keep if c not in ("n_words", "n_tokens"))
    source = docs.select(B.packed(docs, keep), B.text_or_empty(text).alias("text"))
    schema = T.StructType([source.schema[B.ROW], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    names = schema.names

    def run(parts):
        automaton, kept, values = loaded(path)
        for part in parts:
            for a, z, data, off in B.chunks(*B.buffers(part.column(1))):
                starts, ends, first = B.word_bounds(data, off)
                index, new = kept.index(data, starts, ends)
                if len(new):
                    values.put(len(kept), automaton.counts([x.decode() for x in B.strings(data, starts[new], ends[new])])[:, None].tolist())
                tokens = values.get(index)[0]
                kept.commit(new)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, z - a), pa.array(np.diff(first)), pa.array(B.sums(tokens, first))], names)

    made = ["n_words", "n_tokens"]
    return B.unpacked(B.ship(source).mapInArrow(run, schema), [*keep, *made], {c: c for c in made})
