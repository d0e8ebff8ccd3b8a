"""Token counts by a linear longest-match automaton.

Greedy longest-match tokenisation of a word needs no look-back: the trie of the vocabulary gets failure links, and each node the number of
tokens that are popped when its link is taken. A word's tokens are then counted in one pass over its characters, and no piece is ever built.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

CACHE_WORDS = 200_000
LEAD = "▁"  #: what a vocabulary of pieces writes for the start of a word
UNKNOWN = 1 << 32


class Automaton:
    """Longest match from left to right over ``pieces``; a word that gets stuck counts as one unknown token."""

    def __init__(self, pieces: list[str]):
        self.go: dict[tuple[int, str], int] = {}
        ends, children = [False], [[]]
        for piece in pieces:
            node = 0
            for c in piece:
                nxt = self.go.get((node, c))
                if nxt is None:
                    nxt = self.go[node, c] = len(ends)
                    ends.append(False)
                    children.append([])
                    children[node].append((c, nxt))
                node = nxt
            ends[node] = node != 0
        self.link, self.popped = [-1] * len(ends), [0] * len(ends)
        queue = deque([0])
        while queue:  # by depth: a node's link depends on shorter ones
            parent = queue.popleft()
            for c, node in children[parent]:
                queue.append(node)
                if ends[node]:
                    self.link[node], self.popped[node] = 0, 1
                    continue
                at, count = self.link[parent], self.popped[parent]
                while at >= 0 and (at, c) not in self.go:
                    count += self.popped[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[node], self.popped[node] = self.go[at, c], count

    def count(self, word: str) -> int:
        """Tokens of ``word``; ``UNKNOWN + 1`` if it can't be split."""
        go, link, popped = self.go, self.link, self.popped
        node, total = 0, 0
        for c in word:
            while (nxt := go.get((node, c))) is None:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return UNKNOWN + 1
            node = nxt
        while node:
            total += popped[node]
            node = link[node]
            if node < 0:
                return UNKNOWN + 1
        return total


def read_pieces(path: str) -> list[str]:
    """Pieces of a sentencepiece model, without its control, unknown and byte tokens."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [model.id_to_piece(i) for i in plain]


def count_tokens(docs: DataFrame, *, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_tokens``, ``n_unknown`` of each row.

    Words are runs between ASCII white space, each led by the vocabulary's mark for a word's start and split greedily into the longest
    pieces; a word that can't be split is one unknown token. Null and empty texts have none. Words of any length are read once.
    The vocabulary is read on the driver and sent to the executors: its size is the file's. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_pieces(vocabulary))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, known = Automaton(shared.value), {}
        for batch in batches:
            rows = []
            for text in batch.text:
                words = (text or "").encode("utf-8", "surrogatepass").split()
                counts = list(map(known.get, words))
                if None in counts:
                    if len(known) > CACHE_WORDS:
                        known.clear()
                    for w in words:
                        if w not in known:
                            known[w] = automaton.count(LEAD + w.decode("utf-8", "surrogatepass"))
                    counts = list(map(known.__getitem__, words))
                total = sum(counts)
                rows.append((len(words), total % UNKNOWN, total // UNKNOWN))
            out = pd.DataFrame(rows, columns=["n_words", "n_tokens", "n_unknown"], dtype="int64")
            out.insert(0, "doc_id", batch.doc_id.astype("Int64").to_numpy())
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
