"""Token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a word between ASCII white space with the mark U+2581 before it. Distinct pre-tokens go into one trie for each Python worker, which
lives on from task to task and whose nodes are computed once each: the best unigram score of a prefix (forward score) follows from the scores of shorter prefixes
on the same path, so words share the work of their common beginnings; a terminal node keeps its word's counts. The
vocabulary is that of a public SentencePiece file; as it holds ranks but no probabilities, a piece's score is that of Zipf's
law, -ln(rank + 1). A character outside the vocabulary falls back to one token for each of its UTF-8 bytes. Ties go to fewer
tokens.

A worker's trie starts anew beyond MOST_NODES nodes, and a word of more than LONG characters is walked alone with the scores of its last prefixes at hand, so
memory is bounded and no vocabulary is gathered. Defined
results: null and empty texts count 0; repeated rows are counted each; an empty table gives no rows; extra columns
are kept by count_tokens() unless their names clash.
"""

from __future__ import annotations

import math
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from gridlake.llm.common import keep, slices

MARK = "▁"
MOST_NODES = 400_000  # of the trie that a worker keeps
LONG = 256  # characters; longer words share no prefix worth keeping
BYTE_PENALTY = 25.0  # a fallback byte's negative score; beyond any piece's


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_scores(path: str) -> dict[str, float]:
    """Score of each ordinary piece: -ln(rank + 1), rank in the order of the file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {model.id_to_piece(i): -math.log(rank + 1) for rank, i in enumerate(plain, 1)}


class TrieCounter(dict):
    """word -> the node where it ends, in a trie that grows from word to word; nodes hold the forward scores of their prefixes."""

    def __init__(self, scores: dict[str, float], most_nodes: int = MOST_NODES):
        self.most_nodes, self.longest = most_nodes, max(map(len, scores), default=1)
        self.endings: dict = {}  # pieces spelled backwards, so that a step stops where no piece ends so
        for piece, score in scores.items():
            node = self.endings
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = score
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.children: dict[int, int] = {}  # node and character -> node
        self.score, self.tokens, self.fallback = array("d", [0.0]), array("q", [0]), array("q", [0])
        self.mark = self._node(self._forward(MARK, lambda k: (0.0, 0, 0)))

    def _node(self, state: tuple[float, int, int]) -> int:
        for column, value in zip((self.score, self.tokens, self.fallback), state):
            column.append(value)
        return len(self.score) - 1

    def _state(self, node: int) -> tuple[float, int, int]:
        return self.score[node], self.tokens[node], self.fallback[node]

    def _forward(self, text: str, without) -> tuple[float, int, int]:
        """The state of a text, given those of its shorter prefixes: without(k) is that of the text without its last k characters."""
        node, best = self.endings, None
        for k, c in enumerate(reversed(text), 1):
            node = node.get(c)
            if node is None:
                break
            piece = node.get("")
            if piece is not None:
                before = without(k)
                value, count = before[0] + piece, before[1] + 1
                if best is None or value > best[0] or value == best[0] and count < best[1]:
                    best = (value, count, before[2])
        if best is None:
            n = len(text[-1].encode("utf-8", "surrogatepass"))
            score, tokens, fallback = without(1)
            best = (score - BYTE_PENALTY * n, tokens + n, fallback + n)
        return best

    def add(self, word: str, key: bytes) -> None:
        """Count a new word, kept under its bytes. Only nodes that no word has made before are computed."""
        if len(word) > LONG:
            self[key] = self._node(self._alone(MARK + word))
            return
        node, path, children, endings = self.mark, [0, self.mark], self.children, self.endings
        score, tokens, fallback = self.score, self.tokens, self.fallback
        text = MARK + word
        for i in range(1, len(text)):
            edge = node << 21 | ord(text[i])
            child = children.get(edge)
            if child is None:  # as _forward does, without its calls: most of the work lies here
                back, best, count, start = endings, None, 0, 0
                for j in range(i, -1, -1):
                    back = back.get(text[j])
                    if back is None:
                        break
                    if "" in back:
                        before = path[j]
                        value = score[before] + back[""]
                        if best is None or value > best or value == best and tokens[before] < count:
                            best, count, start = value, tokens[before], before
                child = children[edge] = len(score)
                if best is None:
                    state = self._forward(text[i], lambda k: self._state(node))
                    score.append(state[0])
                    tokens.append(state[1])
                    fallback.append(state[2])
                else:
                    score.append(best)
                    tokens.append(count + 1)
                    fallback.append(fallback[start])
            node = child
            path.append(node)
        self[key] = node

    def _alone(self, text: str) -> tuple[float, int, int]:
        """The state of a very long text; only those of the last prefixes are held."""
        states = deque([(0.0, 0, 0)], maxlen=self.longest)
        for i in range(len(text)):
            states.append(self._forward(text[max(0, i + 1 - self.longest) : i + 1], lambda k: states[-k]))
        return states[-1]

    def full(self) -> bool:
        return len(self.score) > self.most_nodes

    def total(self, words: list[bytes]) -> np.ndarray:
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.array([np.frombuffer(c, k)[rows].sum() for c, k in ((self.tokens, np.int64), (self.fallback, np.int64), (self.score, float))], float)


ADDED = [StructField("n_pretokens", LongType()), StructField("n_tokens", LongType()), StructField("n_fallback", LongType()), StructField("log_score", DoubleType())]


def count_tokens(docs: DataFrame, model: str | None = None) -> DataFrame:
    """docs with n_pretokens, n_tokens, n_fallback and log_score (of the best segmentation, 4 decimals)."""
    kept = docs.drop(*(f.name for f in ADDED))

    def run(batches):
        path = model or default_model()
        counter = keep(("tokens", path), lambda: TrieCounter(load_scores(path)))
        for batch in slices(batches):
            split = [(t or b"").split() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            if counter.full():
                counter.forget()
            for word in {w for words in split for w in words if w not in counter}:
                counter.add(word.decode(), word)
            out = np.zeros((len(split), 3))
            for i, words in enumerate(split):
                if words:
                    out[i] = counter.total(words)
            added = [pa.array(list(map(len, split)), pa.int64()), *(pa.array(out[:, k].astype(np.int64)) for k in (0, 1)), pa.array(np.round(out[:, 2], 4))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *(f.name for f in ADDED)])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, *ADDED]))


def digest(docs: DataFrame) -> DataFrame:
    return count_tokens(docs.select("doc_id", "text")).drop("text")
