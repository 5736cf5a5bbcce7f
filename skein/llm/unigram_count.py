"""Token counts under a unigram vocabulary, without making the tokens.

A text is cut into words that each begin with the space sign. An Aho-Corasick automaton reports every
vocabulary piece in a word; dynamic programming over its positions carries the best score and, beside it, the
number of pieces of the best path. Tie rules are those of the public tokenizers library: among equal scores
the path whose last piece starts first, i.e. the longest last piece; a character without a piece of its own
costs the least score minus 10; neighbouring unknown characters make one token, which counts as its bytes
when the vocabulary has a token for each of them, else as one.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from skein.llm.common import rows_of, texts

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
_CACHE_ENTRIES, _CACHED_CHARS = 500_000, 64


def piece_scores(model_path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model, ids in order; its scores are read, never trained."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for k, (piece, _) in enumerate(vocabulary):
            self.automaton.add_word(piece, k)
        self.size = np.array([len(p) for p, _ in vocabulary], np.int64)
        self.score = np.array([s for _, s in vocabulary])
        self.sized = list(zip(self.size.tolist(), self.score.tolist(), strict=True))
        self.automaton.make_automaton()
        pieces = {p for p, _ in vocabulary}
        self.longest = max(map(len, pieces))
        self.letters = {p for p in pieces if len(p) == 1}
        self.known = np.zeros(0x110000, bool)
        self.known[[ord(c) for c in self.letters]] = True
        self.bytes = {b for b in range(256) if f"<0x{b:02X}>" in pieces}
        #: If no piece holds a newline, no piece crosses one: a word may be cut before it.
        self.cut = " \n" if not any("\n" in p for p in pieces) and len(self.bytes) == 256 else "\n"
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.cache: dict[str, tuple[int, float]] = {}

    def _run_cost(self, run: str) -> int:
        """Tokens of a run of unknown characters."""
        data = run.encode("utf-8", "surrogatepass")
        return len(data) if self.bytes.issuperset(data) else 1

    def word(self, word: str) -> tuple[int, float]:
        """(pieces, score) of the best path. The state is a ring as long as the longest piece, so a word of any length takes constant memory."""
        ring = self.longest + 1
        n = len(word)
        size = min(ring, n + 1)
        # per end position: score, settled pieces, start of an open unknown run or -1
        scores, counts, runs = [0.0] * size, [0] * size, [-1] * size
        hits = self.automaton.iter(word)
        at, found = next(hits, (n, None))
        for end in range(1, n + 1):
            best, pieces, run, single = None, 0, -1, False
            here = []
            while at == end - 1:
                here.append(self.sized[found])
                at, found = next(hits, (n, None))
            if len(here) > 1:
                here.sort(reverse=True)  # the longest first, as it wins ties
            for length, score in here:
                k = (end - length) % size
                total = scores[k] + score
                single = single or length == 1
                if best is None or total > best:
                    best, pieces = total, counts[k] + 1
                    if runs[k] >= 0:
                        pieces += self._run_cost(word[runs[k] : end - length])
            if not single:
                k = (end - 1) % size
                total = scores[k] + self.unknown
                if best is None or total > best:
                    best, pieces, run = total, counts[k], runs[k] if runs[k] >= 0 else end - 1
            k = end % size
            scores[k], counts[k], runs[k] = best, pieces, run
        k = n % size
        return counts[k] + (self._run_cost(word[runs[k] :]) if runs[k] >= 0 else 0), scores[k]

    def _spelled(self, word: str) -> str:
        """A word with its space sign; one that was cut before a newline has none."""
        return word if len(self.cut) > 1 and word[:1] == "\n" else SPACE + word

    def learn(self, rows: list[str]) -> None:
        """Puts the words of rows that are not known yet into the cache: one automaton pass and one dynamic program over many words at once."""
        unknown = set()
        for text in rows:
            words = text.replace(SPACE, " ").replace("\n", self.cut).split(" ")
            unknown.update(w for w in words if len(w) <= _CACHED_CHARS and w not in self.cache)
        if len(self.cache) + len(unknown) > _CACHE_ENTRIES:
            self.cache.clear()
        if len(self.bytes) < 256:  # unknown characters that can't be spelled in bytes: one word at a time
            self.cache.update({w: self.word(self._spelled(w)) for w in unknown if not self.letters.issuperset(w)})
        plain = sorted((w for w in unknown if len(self.bytes) == 256 or self.letters.issuperset(w)), key=len)
        for at in range(0, len(plain), 4096):
            words = plain[at : at + 4096]
            self.cache.update(zip(words, self._words([self._spelled(w) for w in words]), strict=True))

    def _words(self, words: list[str]) -> list[tuple[int, float]]:
        """As word, for words of which every character is a piece or can be spelled in bytes."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(n + 1) - n - 1
        line = "\0".join(words)
        hits = np.fromiter(chain.from_iterable(self.automaton.iter(line)), np.int64)
        at, piece = hits.reshape(-1, 2).T
        signs = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4")
        odd_at = np.flatnonzero(~self.known[signs])
        odd = signs[odd_at]
        odd_bytes = 1 + (odd >= 0x80).astype(np.int64) + (odd >= 0x800) + (odd >= 0x10000)
        size = np.concatenate((self.size[piece], np.ones(len(odd), np.int64)))
        score = np.concatenate((self.score[piece], np.full(len(odd), self.unknown)))
        tokens = np.concatenate((np.ones(len(at), np.int64), odd_bytes))
        at = np.concatenate((at, odd_at))
        of = np.searchsorted(first, at, "right") - 1
        end = at - first[of] + 1
        inside = (size <= end) & (end <= n[of])
        of, end, size, score, tokens = of[inside], end[inside], size[inside], score[inside], tokens[inside]
        step = end * (self.longest + 1) + self.longest - size  # by end, the longest piece first
        order = np.argsort(step, kind="stable")
        best = np.full((len(words), int(n.max()) + 1), -np.inf)
        best[:, 0] = 0
        pieces = np.zeros(best.shape, np.int64)
        for part in np.split(order, np.flatnonzero(np.diff(step[order])) + 1):
            w, e = of[part], end[part[0]]
            b = e - size[part[0]]
            total = best[w, b] + score[part]
            better = total > best[w, e]
            w = w[better]
            best[w, e] = total[better]
            pieces[w, e] = pieces[w, b] + tokens[part][better]
        rows = np.arange(len(words))
        return list(zip(pieces[rows, n].tolist(), best[rows, n].tolist(), strict=True))

    def count(self, text: str) -> tuple[int, float]:
        """(tokens, score) of a whole text; an empty text has none."""
        if not text:
            return 0, 0.0
        if text[0] != " " and text[0] != SPACE:
            text = " " + text
        total, score = 0, 0.0
        cache = self.cache
        for w in text.replace(SPACE, " ").replace("\n", self.cut).split(" ")[1:]:
            got = cache.get(w)
            if got is None:
                got = self.word(self._spelled(w))
                if len(w) <= _CACHED_CHARS:
                    if len(cache) >= _CACHE_ENTRIES:
                        cache.clear()
                    cache[w] = got
            total += got[0]
            score += got[1]
        return total, score


@lru_cache(maxsize=2)
def _counter(vocabulary: tuple) -> Counter:
    """One in a worker process, whose tasks share its cache."""
    return Counter(list(vocabulary))


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, n_tokens, score) for every row; null and empty texts have 0 tokens and score 0. The vocabulary has a fixed size and is broadcast."""
    docs = texts(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(vocabulary))
    kind = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches):
        counter = _counter(shared.value)
        for keys, rows in rows_of(batches, "doc_id", "text"):
            counter.learn(rows)
            got = [counter.count(t) for t in rows]
            arrays = [pa.array(keys, kind), pa.array(map(len, rows), pa.int64()), pa.array([n for n, _ in got], pa.int64()), pa.array([s for _, s in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_chars", "n_tokens", "score"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars long, n_tokens long, score double")
