"""Benchmark decontamination by greedy string tiling.

Every benchmark item and document is a sequence of lower-cased words. Seeds are runs of MIN_MATCH words, found by
a Karp-Rabin hash over word numbers and joined with the items' seeds by binary search; each distinct hash of a document is looked up once, and pairs of
positions are never written out. Where an item's seeds cover enough of it, tiles are marked: running Karp-Rabin finds the greatest length at which unmarked
runs of both still agree, all runs of that length are confirmed on the words and marked, and so on with shorter ones until no unmarked match of MIN_MATCH words is left. Memory is linear in
the document and the item, however often they repeat themselves. As tiles may lie in any order, a
document that holds the passages of an item reordered covers it too. A document is contaminated by an item if its tiles
cover at least the given share of the item's words.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skein.llm.common import rows_of, slices, texts, written

MIN_MATCH = 5
MIN_COVERAGE = 0.5
#: Characters of benchmark text in one broadcast block; a larger benchmark takes several passes.
BLOCK_CHARS = 16 << 20
_ASCII = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of any sign beyond ASCII, as UTF-8."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_ASCII).split()


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


class Rolling:
    """Karp-Rabin hashes, modulo 2^64, of the runs of any length in a sequence of word numbers: from prefix sums of x[i] * base^i."""

    _INVERSE = pow(int(_BASE), -1, 1 << 64)

    def __init__(self, ids: np.ndarray):
        x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        n = len(ids)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(x * _powers(int(_BASE), n), out=self.sums[1:])
        self.back = _powers(self._INVERSE, n)

    def of(self, starts: np.ndarray, k: int) -> np.ndarray:
        return (self.sums[starts + k] - self.sums[starts]) * self.back[starts]


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """The hashes of all runs of k words."""
    return Rolling(ids).of(np.arange(max(0, len(ids) - k + 1)), k)


def _free(used: np.ndarray, k: int) -> np.ndarray:
    """Starts of runs of k words of which none is marked."""
    n = np.concatenate(([0], np.cumsum(used)))
    return np.flatnonzero(n[k:] == n[:-k]) if len(used) >= k else np.zeros(0, np.int64)


def tiles(doc: np.ndarray, item: np.ndarray, k: int, enough: float = 0) -> list[tuple[int, int, int]]:
    """(start in item, start in doc, length) of greedy tiles of at least k words; of equal lengths the first place in the item, then in the document.

    Word number -1 matches nothing. Ends early, with what it has, once less than enough words of the item can be covered.
    """
    in_doc, in_item = doc < 0, np.zeros(len(item), bool)
    by_doc, by_item = Rolling(doc), Rolling(item)
    most, found, covered = min(len(doc), len(item)), [], 0

    def common(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item starts whose unmarked run of n words stands in the document too, by hash, and the document's starts sorted by hash."""
        a, b = _free(in_doc, n), _free(in_item, n)
        h = by_doc.of(a, n)
        order = np.argsort(h, kind="stable")
        h, a = h[order], a[order]
        mine = by_item.of(b, n)
        lo = np.searchsorted(h, mine, "left")
        hit = lo < len(h)
        hit[hit] = h[lo[hit]] == mine[hit]
        return b[hit], lo[hit], np.stack((h.view(np.int64), a))

    while most >= k:
        starts, _, _ = common(k)
        reach = np.zeros(len(item) + 1, np.int64)
        reach[starts] += 1
        reach[starts + k] -= 1
        if not len(starts) or covered + (np.cumsum(reach) > 0).sum() < enough:
            break
        low = k  # the greatest length that still agrees: a match of n words holds matches of all shorter lengths
        if len(common(most)[0]):
            low = most
        else:
            high = most
            while high - low > 1:
                mid = (low + high) // 2
                if len(common(mid)[0]):
                    low = mid
                else:
                    high = mid
        starts, first, sorted_doc = common(low)
        h, places = sorted_doc
        after = {}  # hash: the first of its places that may still be free; marks only grow
        for b, at in zip(starts.tolist(), first.tolist(), strict=True):
            if in_item[b : b + low].any():
                continue
            key = h[at]
            x = after.get(at, at)
            while x < len(h) and h[x] == key:
                a = places[x]
                if in_doc[a : a + low].any():
                    x += 1
                    continue
                if np.array_equal(doc[a : a + low], item[b : b + low]):
                    in_doc[a : a + low] = in_item[b : b + low] = True
                    found.append((b, int(a), low))
                    covered += low
                    x += 1
                    break
                x += 1  # equal hashes of other words
            after[at] = x
        most = low - 1
    return found


class Items:
    """One block of benchmark items with its seeds."""

    def __init__(self, rows: list[tuple], min_match: int, min_coverage: float):
        self.k, self.share = min_match, min_coverage
        self.numbers: dict[bytes, int] = {}
        self.items = []
        by_size = defaultdict(list)
        for key, text in rows:
            words = words_of(text)
            if not words:
                continue
            ids = np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words], np.int64)
            k = min(min_match, len(ids))  # a shorter item must occur whole
            by_size[k].append((len(self.items), ids))
            self.items.append((key, ids))
        self.seeds = []
        for k, group in sorted(by_size.items()):
            h = np.concatenate([rolling(ids, k) for _, ids in group])
            of = np.concatenate([np.full(len(ids) - k + 1, i) for i, ids in group])
            pos = np.concatenate([np.arange(len(ids) - k + 1) for _, ids in group])
            order = np.argsort(h, kind="stable")
            self.seeds.append((k, h[order], of[order], pos[order]))

    def matches(self, text: str) -> list[tuple]:
        """(item id, coverage, tiles, longest tile, whether tiles are out of order) of each item that the text covers well enough."""
        words = words_of(text)
        doc = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int64, len(words))
        out = []
        for k, h, of, pos in self.seeds:
            if len(doc) < k:
                continue
            starts = _free(doc < 0, k)
            if not len(starts):
                continue
            mine = Rolling(doc).of(starts, k)
            known = np.unique(mine)
            lo, hi = np.searchsorted(h, known, "left"), np.searchsorted(h, known, "right")
            n = hi - lo
            if not n.any():
                continue
            # the items' seeds that the document has: each at most once, so no more than the block holds
            seed = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            seed = seed[np.argsort(of[seed], kind="stable")]
            for part in np.split(seed, np.flatnonzero(np.diff(of[seed])) + 1):
                key, item = self.items[of[part[0]]]
                bound = np.zeros(len(item) + 1, np.int64)
                bound[pos[part]] += 1
                np.subtract.at(bound, pos[part] + k, 1)
                if (np.cumsum(bound) > 0).sum() < self.share * len(item):
                    continue  # even all seeds together cover too little
                # of the document only what the item's seeds touch; a gap between such stretches is one word that matches nothing
                near = np.zeros(len(doc) + 1, np.int64)
                hits = starts[np.isin(mine, h[part])]
                near[hits] += 1
                near[hits + k] -= 1
                near = np.cumsum(near[:-1]) > 0
                gap = ~near & np.concatenate(([False], near[:-1]))
                keep = np.flatnonzero(near | gap)
                found = tiles(np.where(near, doc, -1)[keep], item, k, self.share * len(item))
                covered = sum(x[2] for x in found)
                if found and covered >= self.share * len(item):
                    by_item = [x[1] for x in sorted(found)]
                    out.append((key, covered / len(item), len(found), max(x[2] for x in found), by_item != sorted(by_item)))
        return out


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, min_match: int, min_coverage: float, block_chars: int):
    """(number of blocks, type of item ids, a generator of their broadcasts). The benchmark's size is measured first; its items are dealt to blocks by a hash of their ids."""
    items = texts(benchmark, item_col, item_text_col)
    chars = items.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-chars // block_chars))

    def each():
        for block in range(n):
            rows = [tuple(r) for r in items.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)) == block).collect()]
            yield items.sparkSession.sparkContext.broadcast(Items(rows, min_match, min_coverage))

    return n, items.schema["doc_id"].dataType, each()


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest_tile, reordered) for each pair at or over min_coverage.

    Beyond block_chars the benchmark is dealt to blocks; each passes over all documents and is dropped before the next is made, so what is broadcast
    never grows. Null, empty and wordless texts match nothing, and neither do such items. Null ids are ids like any other.
    Rows repeated under one id give repeated results; empty tables give none.
    """
    docs = texts(docs, id_col, text_col)
    blocks, item_kind, each = _blocks(benchmark, item_col, item_text_col, min_match, min_coverage, block_chars)
    id_kind = docs.schema["doc_id"].dataType
    kinds = [to_arrow_type(id_kind), to_arrow_type(item_kind), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
    names = ["doc_id", "item_id", "coverage", "n_tiles", "longest_tile", "reordered"]
    schema = f"doc_id {id_kind.simpleString()}, item_id {item_kind.simpleString()}, coverage double, n_tiles long, longest_tile long, reordered boolean"
    out = None
    for shared in each:

        def run(batches, shared=shared):
            known = shared.value
            for keys, rows in rows_of(batches, "doc_id", "text"):
                got = [(key, *m) for key, t in zip(keys, rows, strict=True) for m in known.matches(t)]
                yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], kind) for i, kind in enumerate(kinds)], names)

        part = docs.mapInArrow(run, schema)
        if blocks > 1:
            part = written(part, "contaminated")
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def clean(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """docs without the rows whose own text contains a benchmark item; all columns stay as they are.

    Each row is judged where it lies, without a join, so ids play no part: rows with null or repeated ids stay or go by their texts. Null and empty texts
    stay, repeated rows fare alike, an empty table gives an empty result. A benchmark of several blocks takes a written pass for each.
    """
    blocks, _, each = _blocks(benchmark, item_col, item_text_col, min_match, min_coverage, block_chars)
    at = docs.columns.index(text_col)
    for shared in each:

        def run(batches, shared=shared):
            known = shared.value
            for whole in batches:
                for part in slices(whole, text_col):
                    yield part.filter(pa.array([not known.matches(t or "") for t in part.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if blocks > 1:
            docs = written(docs, "uncontaminated")
            shared.destroy()
    return docs
