"""Byte-level BPE as a streaming transducer with bounded lookahead, and its incremental decoder.

Text passes in chunks. A pretoken leaves the splitter once later text can't change it; its bytes
are merged and the tokens emitted. For a pretoken of any length memory stays constant: the merge
list alone fixes how far right context can reach (``sufficient_lookahead``), so tokens that end
that many bytes before the end of the window are final, and the rest of the text is tokenised from
the last final boundary on. That is sound as no merge ever crosses a boundary that stays.

Decoding takes token ids one by one, maps each to its bytes and feeds an incremental UTF-8 decoder,
whose state holds at most three bytes; malformed bytes become U+FFFD.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from skein.llm.common import rows_of, texts

_SPACE = r"\p{White_Space}"
_NO_SPACE = rf"[^{_SPACE}]"
_OTHER = rf"[^{_SPACE}\p{{L}}\p{{N}}]"
#: The splitting rule of byte-level BPE: contractions, letters, numbers, other signs, white space.
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?{_OTHER}+|{_SPACE}+(?!{_NO_SPACE})|{_SPACE}+")
_WIDE_SPACE = regex.compile(rf"[ \n](?:{_SPACE}|$)")
_RUNS = [regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", f"{_OTHER}+")]
_CHUNK = 1 << 14
#: Known words; of those parted by spaces as many again, not met since the last ones were set aside.
_CACHE_ENTRIES = 150_000
_CACHED_CHARS = 64
_LEARN_CHARS, _LEARN_WORDS = 1 << 18, 50_000
_NO_PAIR = 1 << 62
#: Words that are merged side by side.
_BLOCK_WORDS = 4096


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabularies of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Merges and token bytes from a tokenizer file's text."""

    def __init__(self, json_text: str):
        model = json.loads(json_text)
        letters = byte_letters()
        ids = model["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in ids.items()}
        self.special: dict[str, int] = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.byte_id = {self.bytes_of[i][0]: i for t, i in ids.items() if len(t) == 1}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        pairs = sorted((a << 20 | b, rank, made) for (a, b), (rank, made) in self.merges.items())
        self.table = tuple(np.array(c, np.int64) for c in zip(*pairs, strict=True))
        self.byte_ids = np.array([self.byte_id[b] for b in range(256)], np.int64)
        # rank and product of each pair of bytes
        at = [self.merges.get((self.byte_id[b >> 8], self.byte_id[b & 255]), (_NO_PAIR, 0)) for b in range(1 << 16)]
        self.first_rank, self.first_made = (np.array(c, np.int64) for c in zip(*at, strict=True))


def sufficient_lookahead(vocab: Vocabulary) -> int:
    """Bytes of right context after which no token boundary can change.

    Unknown text at the right can take the last token first (a merge across the end). The token at
    its left then lacks its partner and may join the next one to the left, but only by a merge of a
    later rank; so a change walks left along merges (l, r) of rising rank in which r starts where the
    previous l started, i.e. the previous l stands on the left spine of r. The longest such
    walk, weighed by the bytes of each l, bounds the reach; one pass in rank order finds it.
    """
    spine: dict[int, tuple[int, ...]] = {i: (i,) for i in vocab.byte_id.values()}
    best: dict[int, int] = {}
    reach = 1
    for (a, b), (_, made) in sorted(vocab.merges.items(), key=lambda x: x[1][0]):
        spine.setdefault(made, (made, *spine.get(a, (a,))))
        walk = len(vocab.bytes_of[a]) + max((best.get(t, 0) for t in spine.get(b, (b,))), default=0)
        best[a] = max(best.get(a, 0), walk)
        reach = max(reach, walk)
    return reach


def merge(data: bytes, vocab: Vocabulary) -> list[int]:
    """Token ids of bytes that stand alone: lowest rank first, leftmost among equals."""
    ids = [vocab.byte_id[b] for b in data]
    merges = vocab.merges
    if len(ids) < 48:
        get, none = merges.get, (1 << 60, 0)
        found = [get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while found and (least := min(found)) is not none:
            at = found.index(least)
            ids[at : at + 2] = [least[1]]
            del found[at]
            if at:
                found[at - 1] = get((ids[at - 1], ids[at]), none)
            if at < len(found):
                found[at] = get((ids[at], ids[at + 1]), none)
        return ids
    n = len(ids)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(*m, k, ids[k], ids[k + 1]) for k in range(n - 1) if (m := merges.get((ids[k], ids[k + 1])))]
    heap = [(rank, k, a, b, made) for rank, made, k, a, b in heap]
    heapq.heapify(heap)
    while heap:
        _, k, a, b, made = heapq.heappop(heap)
        r = right[k]
        if ids[k] != a or r < 0 or ids[r] != b:
            continue
        ids[k], ids[r], right[k] = made, -1, right[r]
        if right[k] >= 0:
            left[right[k]] = k
        for x, y in ((left[k], k), (k, right[k])):
            if x >= 0 and y >= 0 and (m := merges.get((ids[x], ids[y]))):
                heapq.heappush(heap, (m[0], x, ids[x], ids[y], m[1]))
    return [i for i in ids if i >= 0]


def merge_many(words: list[bytes], vocab: Vocabulary) -> list[bytes]:
    """As merge, for many words at once: in each round every word joins its lowest, leftmost pair. Packed ids.

    All tokens stand in one row, each linked to its neighbours in the word; a round looks at all pairs but makes new ones only about the places that merged.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(size)
    starts = (ends - size)[size > 0]
    if not len(starts):
        return [b""] * len(words)
    ids, place = vocab.byte_ids[flat], np.arange(len(flat))
    left, right = place - 1, place + 1
    left[starts] = right[ends[size > 0] - 1] = -1
    order, made = np.full(len(flat), _NO_PAIR), np.zeros(len(flat), np.int64)

    def pair(at, a, b):
        """The pair at each place: its rank, then the place itself, as one number."""
        keys, ranks, made_of = vocab.table
        k = a << 20 | b
        found = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        order[at] = np.where(keys[found] == k, ranks[found] << 32 | at, _NO_PAIR)
        made[at] = made_of[found]

    inner = np.flatnonzero(right >= 0)
    two = flat[inner].astype(np.int64) << 8 | flat[inner + 1]
    order[inner] = np.where(vocab.first_rank[two] < _NO_PAIR, vocab.first_rank[two] << 32 | inner, _NO_PAIR)
    made[inner] = vocab.first_made[two]
    while True:
        least = np.minimum.reduceat(order, starts)
        at = least[least < _NO_PAIR] & 0xFFFFFFFF
        if not len(at):
            break
        gone = right[at]
        after, before = right[gone], left[at]
        ids[at], ids[gone], right[at] = made[at], -1, after
        order[gone] = order[at] = _NO_PAIR
        more, less = after >= 0, before >= 0
        left[after[more]] = at[more]
        pair(np.concatenate((at[more], before[less])), np.concatenate((ids[at[more]], ids[before[less]])), np.concatenate((ids[after[more]], ids[at[less]])))
    kept = ids >= 0
    cuts = (4 * np.concatenate(([0], np.cumsum(kept)))[np.concatenate(([0], ends))]).tolist()
    packed = ids[kept].astype("<u4").tobytes()
    return [packed[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


class Encoder:
    """feed() text in any pieces; each call gives the tokens that became final, finish() the rest, as little-endian 32-bit ids."""

    def __init__(self, vocab: Vocabulary, lookahead: int | None = None):
        self.vocab = vocab
        self.lookahead = lookahead or sufficient_lookahead(vocab)
        self.window = self.lookahead + max(256, 2 * max(map(len, vocab.bytes_of.values())), self.lookahead // 2)
        longest = max(map(len, vocab.special), default=0)
        self.hold = max(3, longest)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(vocab.special, key=len, reverse=True))) if vocab.special else None
        self.cache: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._start()

    def _start(self) -> None:
        self.text, self.open, self.bytes = "", None, b""

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        got = self.cache.get(word)
        if got is None:
            data = word.encode("utf-8", "surrogatepass")
            if len(word) > _CACHED_CHARS:
                self.bytes = b""
                return self._long(data) + self._flush()
            if len(self.cache) >= _CACHE_ENTRIES:
                self.cache.clear()
            got = self.cache[word] = self._pack(merge(data, self.vocab))
        return got

    def _long(self, data: bytes) -> bytes:
        """More bytes of one long pretoken: what of it is final."""
        out = []
        for at in range(0, len(data), self.window):
            self.bytes += data[at : at + self.window]
            while len(self.bytes) >= self.window:
                end, final = 0, []
                for i in merge(self.bytes[: self.window], self.vocab):
                    if end + len(self.vocab.bytes_of[i]) > self.window - self.lookahead:
                        break
                    end += len(self.vocab.bytes_of[i])
                    final.append(i)
                out.append(self._pack(final))
                self.bytes = self.bytes[end:]
        return b"".join(out)

    def _flush(self) -> bytes:
        data, self.bytes = self.bytes, b""
        return self._pack(merge(data, self.vocab)) if data else b""

    def _plain(self, text: str, last: bool) -> tuple[bytes, int]:
        """Tokens of text, and how many of its characters they cover; the rest waits for more, unless this is the last."""
        out, at = [], 0
        if self.open is not None:  # within a run that began in an earlier chunk
            m = self.open.match(text)
            at = m.end() if m else 0
            out.append(self._long(text[:at].encode("utf-8", "surrogatepass")))
            if at == len(text) and not last:
                return b"".join(out), at
            out.append(self._flush())
            self.open = None
        if not last and (cut := self._last_space(text)) > at:  # a space before another sign always starts a pretoken
            out.append(self._tokens(text[at:cut]))
            return b"".join(out), cut
        words, done = SPLIT.findall(text, at), len(text)  # every character is in one of them
        while not last and words and done + 2 > len(text):
            done -= len(words.pop())
        out += [self._word(w) for w in words]
        if not last and done == 0 and len(text) >= _CHUNK:  # one pretoken fills the chunk
            for run in _RUNS:
                if m := run.match(text, text[0] == " "):
                    self.open, self.bytes = run, b""
                    out.append(self._long(text[: m.end()].encode("utf-8", "surrogatepass")))
                    return b"".join(out), m.end()
        return b"".join(out), done

    def _last_space(self, text: str) -> int:
        """The last space of text that has a sign other than white space after it, or -1."""
        at = text.rfind(" ", 0, len(text) - 1)
        while at >= 0 and text[at + 1].isspace():
            at = text.rfind(" ", 0, at)
        return at

    def _tokens(self, text: str) -> bytes:
        """Tokens of text that begins and ends at pretoken boundaries. Where single spaces part its words, each word
        with its space is looked up at once, for no pretoken crosses that space from the left."""
        if _WIDE_SPACE.search(text):
            return b"".join([self._word(w) for w in SPLIT.findall(text)])
        first, *words = text.replace("\n", " \n").split(" ")  # a single newline stands alone
        head = b"".join([self._word(w) for w in SPLIT.findall(first)])
        try:
            return head + b"".join([self.spaced[w] for w in words])
        except KeyError:
            return head + b"".join([self.spaced.get(w) or self._spaced(w) for w in words])

    @staticmethod
    def _with_space(word: str) -> str:
        return word if word[:1] == "\n" else " " + word

    def _spaced(self, word: str) -> bytes:
        got = self.older.get(word) or b"".join([self._word(w) for w in SPLIT.findall(self._with_space(word))])
        if len(word) <= _CACHED_CHARS:
            self._room(1)
            self.spaced[word] = got
        return got

    def _room(self, n: int) -> None:
        """Sets the known words aside if n more don't fit; those that are met again come back, the others go with the next ones set aside."""
        if len(self.spaced) + n > _CACHE_ENTRIES:
            self.older, self.spaced = self.spaced, {}

    def learn(self, rows: list[str]) -> None:
        """Puts the words of rows that are not known yet into the cache, many at a time; it holds no more than a bounded number of them, however many and long the rows."""
        unknown: set[str] = set()
        for text in rows:
            for at in range(0, len(text), _LEARN_CHARS):  # a word that is cut here is merely not known later
                unknown |= set(text[at : at + _LEARN_CHARS].replace("\n", " \n").split(" ")).difference(self.spaced)
                if len(unknown) >= _LEARN_WORDS:
                    self._learn(unknown)
                    unknown.clear()
        self._learn(unknown)

    def _learn(self, unknown: set[str]) -> None:
        self._room(len(unknown))
        plain, parts = [], []
        for w in unknown:
            if (got := self.older.get(w)) is not None:
                self.spaced[w] = got
            elif len(w) <= _CACHED_CHARS:
                if w.isascii() and w.isalpha():  # one pretoken
                    plain.append(w)
                else:
                    parts.append((w, SPLIT.findall(self._with_space(w))))
        # words of like length share a block
        plain.sort(key=len)
        for k in range(0, len(plain), _BLOCK_WORDS):
            some = plain[k : k + _BLOCK_WORDS]
            self.spaced.update(zip(some, merge_many([b" " + w.encode() for w in some], self.vocab), strict=True))
        fresh = sorted({x for _, xs in parts for x in xs if len(x) <= _CACHED_CHARS}, key=len)
        of: dict[str, bytes] = {}
        for k in range(0, len(fresh), _BLOCK_WORDS):
            some = fresh[k : k + _BLOCK_WORDS]
            of.update(zip(some, merge_many([x.encode("utf-8", "surrogatepass") for x in some], self.vocab), strict=True))
        for w, xs in parts:
            self.spaced[w] = b"".join([of.get(x) or self._word(x) for x in xs])

    def feed(self, chunk: str) -> bytes:
        return self._run(chunk, False)

    def finish(self) -> bytes:
        out = self._run("", True)
        self._start()
        return out

    def _run(self, chunk: str, last: bool) -> bytes:
        self.text += chunk
        out = []
        while self.special and (m := self.special.search(self.text)):
            got, _ = self._plain(self.text[: m.start()], True)
            out += [got, self._pack([self.vocab.special[m[0]]])]
            self.text = self.text[m.end() :]
        # the start of a special token may end the text so far
        safe = len(self.text) if last else self._safe_end()
        got, done = self._plain(self.text[:safe], last)
        out.append(got)
        self.text = self.text[done:] if not last else ""
        return b"".join(out)

    def _safe_end(self) -> int:
        n = len(self.text)
        for k in range(max(0, n - self.hold), n):
            if any(s.startswith(self.text[k:]) for s in self.vocab.special):
                return k
        return n

    def encode(self, text: str) -> Iterator[bytes]:
        for at in range(0, len(text), _CHUNK):
            yield self.feed(text[at : at + _CHUNK])
        yield self.finish()


class Decoder:
    """Token ids in, text out, whole characters as soon as their bytes are there."""

    def __init__(self, vocab: Vocabulary):
        self.bytes_of = np.empty(max(vocab.bytes_of) + 1, object)
        self.bytes_of[:] = b""
        for i, data in vocab.bytes_of.items():
            self.bytes_of[i] = data
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray | list[int]) -> str:
        return self.state.decode(b"".join(self.bytes_of[np.asarray(ids, np.int64)].tolist()))

    def finish(self) -> str:
        out = self.state.decode(b"", True)
        self.state.reset()
        return out


@lru_cache(maxsize=2)
def transducers(json_text: str) -> tuple[Encoder, Decoder]:
    """Made once in a worker process, whose tasks then share the cache of words."""
    vocab = Vocabulary(json_text)
    return Encoder(vocab), Decoder(vocab)


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids][, decoded]) for every row.

    The tokenizer file is read on the driver, once, and broadcast: it is a vocabulary of fixed size.
    A null or empty text has no tokens and the hashes of nothing. Rows are independent, so ties
    and repeats need no rule. A text of any length streams through; its ids and decoded text are held, as buffers, only where they are asked for.
    """
    docs = texts(docs, id_col, text_col)
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())
    id_type = docs.schema["doc_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches):
        encoder, decoder = transducers(source.value)
        for keys, rows in rows_of(batches, "doc_id", "text"):
            encoder.learn(rows)
            counts, ids_hex, text_hex, ids, decoded = [], [], [], bytearray(), []
            for text in rows:
                n, h, d, back = 0, hashlib.sha256(), hashlib.sha256(), []
                for part in encoder.encode(text):
                    n += len(part) // 4
                    h.update(part)
                    said = decoder.feed(np.frombuffer(part, "<u4"))
                    d.update(said.encode("utf-8", "surrogatepass"))
                    if with_ids:
                        ids += part
                    if with_decoded:
                        back.append(said)
                d.update((rest := decoder.finish()).encode())
                counts.append(n)
                ids_hex.append(h.hexdigest())
                text_hex.append(d.hexdigest())
                decoded.append("".join(back) + rest)
            out = {"doc_id": pa.array(keys, kind), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids_hex, pa.string()), "decoded_sha256": pa.array(text_hex, pa.string())}
            if with_ids:
                offsets = pa.array(np.cumsum([0, *counts]), pa.int32())
                out["ids"] = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(bytes(ids), "<i4"), pa.int32()))
            if with_decoded:
                out["decoded"] = pa.array(decoded, pa.string())
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    more = ", ids array<int>" * with_ids + ", decoded string" * with_decoded
    return docs.mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
