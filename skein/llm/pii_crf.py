"""Personal data by patterns and a skip-chain conditional random field.

Base spans come from four patterns (email, ip, card, phone) that are scanned in linear time. The field adds what the
patterns miss. Its nodes are all tokens of every sentence that holds a digit or an at sign; in other sentences no token can bear a label. Chain edges join
neighbours in a sentence. Skip edges join each token with a digit or an at sign to the next one in the document with the same letters
and digits whatever the punctuation, or a similar one (the last seven digits, the part before the at sign), and to the nearest such one in a base span, so that
what a pattern found reaches every mention over one edge. Loopy sum-product in the log domain, all edges of a batch at once, passes
evidence along all edges until a document's messages stay: a number that a pattern found once marks its other mentions, and the chain
marks the tokens beside them.

Weights maximise the pseudo-likelihood of the base labels in a bounded sample of documents (TRAIN_DOCS): each label given its token's features
and the labels of its neighbours. So that the field learns more than the patterns know, each token is shown twice more with evidence hidden: once without its form,
so that neighbours must tell (a form never seen is clean where none does), and, for one in HIDE, without its neighbours, whose labels the patterns may have missed. Of two like mentions of which a
pattern found one, the other's label is hidden too: it is neither learned as clean nor shown to the first.
"""

from __future__ import annotations

import ast
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skein.llm.common import rows_of, slices, texts

KINDS = ("email", "ip", "card", "phone")
#: Documents from which the field's weights are learned, and the share of tokens, one in HIDE, whose neighbours' labels are hidden.
TRAIN_DOCS, HIDE = 20_000, 4
MIN_POSTERIOR = 0.9
#: Messages of a document that change by less than this stay; SETTLE rounds are allowed beyond its longest runs of edges.
TOLERANCE, SETTLE = 1e-4, 60
_LABELS = 5  # 0 is no personal data, then KINDS

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9]){15,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HELD = re.compile(r"[0-9@]")
_END = re.compile(r"[.!?]+(?=[\x20\x09-\x0D])|[\x0A-\x0D]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_FIRST = re.compile(r"[a-z0-9._%+]+")
_EDGE = ".,:;!?|\"'<>[]{}*$%&#()"
_CUES = {
    1: ("mail", "email", "e-mail", "courriel", "correo"),
    2: ("ip", "host", "server", "address", "adresse"),
    3: ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    4: ("phone", "tel", "call", "mobile", "fax", "telefon", "telefono"),
}
_CUE = {w: k for k, words in _CUES.items() for w in words}


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) << (k & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start: leftmost matches that do not overlap within a kind, each pass linear in the text."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((1, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        start = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((2, start, end))
            start = end + 1
    for m in _DIGITS.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and _luhn(digits):
            out.append((3, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((4, m.start(), m.end()))
    return out


_WORD = ("word", "cue=0")
_RUNS = ((re.compile(r"[0-9]+"), "9"), (re.compile(r"[^\W\d_]+"), "a"))


def shape(core: str) -> str:
    """Runs of digits as 9, of letters as a, all else as it is."""
    for run, sign in _RUNS:
        core = run.sub(sign, core)
    return core


def features(core: str, cue: int) -> tuple[str, ...]:
    """Names of what is seen of a token; a word has but one. The first two hold whatever the form, so they are left when it is hidden."""
    if not _HELD.search(core):
        return _WORD
    digits = sum("0" <= c <= "9" for c in core)
    form = shape(core)
    parts = core.split(".")
    fails = (digits >= 16 and not _luhn("".join(c for c in core if "0" <= c <= "9"))) or (form == "9.9.9.9" and any(len(x) > 3 or int(x) > 255 for x in parts))
    return ("token", f"cue={cue}", f"digits={min(digits, 24)}", f"shape={form}", f"{min(digits, 24)} {form}", f"fails={int(fails)}")


class Graph:
    """Nodes and edges of several documents."""

    def __init__(self):
        self.seen: list[tuple[str, ...]] = []
        self.label: list[int] = []
        self.span: list[tuple[int, int, int]] = []  # document, start, end
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        self.found: list[tuple[int, int]] = []  # skip edges to a mention in a base span that is not the next one; not counted for weights
        self.bound: dict[int, int] = {}  # document: rounds that its longest runs of chain and skip edges need

    def add(self, doc: int, text: str, base: list[tuple[int, int, int]]) -> None:
        spans, at_span = sorted((a, b, k) for k, a, b in base), 0
        like: dict[str, list[int]] = {}
        longest = at = 0
        held = _HELD.search(text)
        while held:
            begin = at
            for end in _END.finditer(text, at, held.start()):
                begin = end.end()
            stop = _END.search(text, held.start())
            at = stop.end() if stop else len(text)
            first, cue, told = len(self.seen), 0, 0
            for m in _TOKEN.finditer(text, begin, at):
                token, me = m[0], len(self.seen)
                core = token.strip(_EDGE)
                lead = m.start() + (token.find(core) if core else 0)
                while at_span < len(spans) and spans[at_span][1] <= m.start():
                    at_span += 1
                k, label = at_span, 0
                while k < len(spans) and spans[k][0] < m.end() and not label:
                    label = spans[k][2] if spans[k][1] > m.start() else 0
                    k += 1
                self.seen.append(features(core, cue if me - told <= 3 else 0))
                self.label.append(label)
                self.span.append((doc, lead, lead + len(core)))
                if me > first:
                    self.chain.append((me - 1, me))
                word = _CUE.get(core.lower())
                if word:
                    cue, told = word, me
                if self.seen[me][0] == "token":
                    self._keys(like, core.lower(), me)
            longest = max(longest, len(self.seen) - first)
            held = _HELD.search(text, at)
        done = set()
        for mentions in like.values():
            self._join(mentions, done)
        self.bound[doc] = longest + max(map(len, like.values()), default=0) + SETTLE

    @staticmethod
    def _keys(like: dict[str, list[int]], core: str, me: int) -> None:
        """Under each key that the token shares with equal or similar ones."""
        exact = "".join(c for c in core if c.isalnum() or c == "@")
        if len(exact) >= 4:
            like.setdefault(exact, []).append(me)
        if exact.isdigit() and len(exact) >= 7:
            like.setdefault("~" + exact[-7:], []).append(me)
        local = _FIRST.match(core)
        if local and len(local[0]) >= 4 and not local[0].isdigit():
            like.setdefault("@" + local[0], []).append(me)

    def _join(self, mentions: list[int], done: set) -> None:
        for pair in zip(mentions, mentions[1:], strict=False):
            if pair not in done:
                done.add(pair)
                self.skip.append(pair)
        near = next((x for x in mentions if self.label[x]), None)
        if near is None:
            return
        for k, x in enumerate(mentions):
            if self.label[x]:
                near = x
            elif near not in mentions[max(0, k - 1) : k + 2] and (near, x) not in done:
                done.add((near, x))
                self.found.append((near, x))

    def patterns(self) -> Counter:
        """Counts of (features, label left, label right, labels of like mentions, label), each token in its several views."""
        n = len(self.seen)
        left, right, like = [0] * n, [0] * n, [[0] * _LABELS for _ in range(n)]
        edge = [""] * n
        for a, b in self.chain:
            right[a], left[b] = self.label[b], self.label[a]
            edge[a] += "r"
            edge[b] += "l"
        hidden = set()
        for a, b in self.skip:
            if bool(self.label[a]) == bool(self.label[b]):
                like[a][self.label[b]] += 1
                like[b][self.label[a]] += 1
            else:
                hidden.add(b if self.label[a] else a)
        out: Counter = Counter()
        for i in range(n):
            if i in hidden:
                continue
            near = (left[i] if "l" in edge[i] else -1, right[i] if "r" in edge[i] else -1)
            out[self.seen[i], *near, tuple(like[i]), self.label[i]] += 1
            told = max(near) > 0 or any(like[i][1:])
            if len(self.seen[i]) > 2:
                if told or not self.label[i]:
                    out[self.seen[i][:2], *near, tuple(like[i]), self.label[i]] += 1
                if told and i % HIDE == 0:
                    out[self.seen[i], -1, -1, (0,) * _LABELS, self.label[i]] += 1
        return out


def _patterns(docs: DataFrame) -> list[tuple[tuple, int]]:
    """(pattern, n) over docs. At most one row for each token of a bounded sample; sums are partial before the shuffle."""

    def run(batches):
        for _, rows in rows_of(batches, "doc_id", "text"):
            g = Graph()
            for k, t in enumerate(rows):
                g.add(k, t, base_spans(t))
            got = g.patterns()
            yield pa.RecordBatch.from_arrays([pa.array([repr(x) for x in got], pa.string()), pa.array(list(got.values()), pa.int64())], ["pattern", "n"])

    found = docs.mapInArrow(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return [(ast.literal_eval(r["pattern"]), r["n"]) for r in found.orderBy("pattern").collect()]


#: Where there is little evidence, like mentions agree by this weight.
_PRIOR_SKIP = 3.0
#: Weight of the priors against one token.
_RIDGE, _STEPS = 0.02, 400


class Field:
    """Weights: of features by label, of (left, right) labels along the chain, and of agreement over skip edges, the same for all labels, so that repeats alone speak for none."""

    def __init__(self, feature: dict[str, np.ndarray], chain: np.ndarray, skip: float):
        self.feature, self.pair = feature, {"chain": np.asarray(chain, float), "skip": skip * np.eye(_LABELS)}

    @classmethod
    def learn(cls, patterns: list[tuple[tuple, int]]) -> Field:
        """Maximises the pseudo-likelihood of (pattern, n) by gradient steps (Adam) from the priors, which a ridge pulls towards."""
        names = {x: k for k, x in enumerate(sorted({f for p, _ in patterns for f in p[0]}))}
        w, chain, skip = np.zeros((len(names) + 1, _LABELS)), np.zeros((_LABELS + 1, _LABELS)), np.full(1, _PRIOR_SKIP)
        back = np.zeros((_LABELS + 1, _LABELS))
        if patterns:
            wide = max(len(p[0]) for p, _ in patterns)
            feats = np.array([[names[f] for f in p[0]] + [len(names)] * (wide - len(p[0])) for p, _ in patterns])
            left, right, y = (np.array([p[k] for p, _ in patterns]) for k in (1, 2, 4))
            like = np.array([p[3] for p, _ in patterns], float)
            n = np.array([c for _, c in patterns], float)
            rows, moments = np.arange(len(y)), {}

            def step(key, x, grad, prior, t):
                grad = grad - _RIDGE * (x - prior)
                m, v = moments.get(key, (0.0, 0.0))
                m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
                moments[key] = m, v
                x += 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

            for t in range(1, _STEPS + 1):
                pair = chain[:_LABELS]  # (left, right); row -1 of both tables stands for no neighbour
                score = w[feats].sum(1) + np.vstack([pair, chain[-1:]])[left] + np.vstack([pair.T, back[-1:]])[right] + like * skip
                p = np.exp(score - score.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                miss = -p
                miss[rows, y] += 1
                miss *= n[:, None]
                by_feature = np.zeros_like(w)
                for k in range(wide):
                    np.add.at(by_feature, feats[:, k], miss)
                by_feature[-1] = 0
                from_left, from_right = np.zeros_like(chain), np.zeros_like(back)
                np.add.at(from_left, left, miss)
                np.add.at(from_right, right, miss)
                both = from_left[:_LABELS] + from_right[:_LABELS].T
                step("w", w, by_feature, 0.0, t)
                step("skip", skip, (like * miss).sum(), _PRIOR_SKIP, t)
                step("edge", back, np.vstack([np.zeros((_LABELS, _LABELS)), from_right[-1:]]), 0.0, t)
                step("chain", chain, np.vstack([both, from_left[-1:]]), 0.0, t)
        return cls({x: w[k] for x, k in names.items()}, chain[:_LABELS], float(skip[0]))

    def unary(self, seen: tuple[str, ...]) -> np.ndarray:
        return sum((self.feature[f] for f in seen if f in self.feature), np.zeros(_LABELS))

    def posteriors(self, g: Graph) -> np.ndarray:
        """Label probabilities of each node once the messages of its document stay; nodes in base spans are held at their label."""
        known = {x: self.unary(x) for x in set(g.seen)}
        unary = np.array([known[x] for x in g.seen]).reshape(-1, _LABELS)
        held = np.array(g.label, np.int64)
        fixed = held > 0
        unary[fixed] = -30.0
        unary[fixed, held[fixed]] = 0.0
        edges = [(a, b, p) for p, e in (("chain", g.chain), ("skip", g.skip), ("skip", g.found)) for a, b in e]
        belief = unary.copy()
        if edges:
            a = np.array([e[0] for e in edges])
            b = np.array([e[1] for e in edges])
            doc = np.array([x[0] for x in g.span])[a]
            kind = np.array([e[2] == "skip" for e in edges], np.int64)
            both = np.array([self.pair["chain"], self.pair["skip"]])
            bound = np.zeros(max(g.bound) + 1, np.int64)
            bound[list(g.bound)] = list(g.bound.values())
            msg = np.zeros((2, len(edges), _LABELS))  # from a to b, from b to a
            live, rounds = np.arange(len(edges)), 0
            while len(live):  # edges of documents whose messages still change; documents share no edge
                at, src, dst = live, np.concatenate((a[live], b[live])), np.concatenate((b[live], a[live]))
                pot = np.concatenate((both[kind[at]], both[kind[at]].transpose(0, 2, 1)))
                old, back = np.concatenate((msg[0, at], msg[1, at])), np.concatenate((msg[1, at], msg[0, at]))
                x = (belief[src] - back)[:, :, None] + pot
                top = x.max(1)
                new = top + np.log(np.exp(x - top[:, None, :]).sum(1))
                new = 0.3 * old + 0.7 * (new - new.max(1, keepdims=True))
                msg[0, at], msg[1, at] = new[: len(at)], new[len(at) :]
                nodes, place = np.unique(dst, return_inverse=True)
                belief[nodes] = unary[nodes]
                for y in range(_LABELS):
                    belief[nodes, y] += np.bincount(place, new[:, y], len(nodes))
                rounds += 1
                moved = np.abs(new - old).max(1)
                moving = np.zeros(len(bound), bool)
                moving[doc[at][np.maximum(moved[: len(at)], moved[len(at) :]) >= TOLERANCE]] = True
                live = at[(moving & (rounds < bound))[doc[at]]]
        p = np.exp(belief - belief.max(1, keepdims=True)) if len(belief) else belief
        return p / p.sum(1, keepdims=True) if len(p) else p

    def added(self, rows: list[str], base: list[list[tuple[int, int, int]]], min_posterior: float) -> list[list[tuple[int, int, int]]]:
        """For each text the spans that the field adds; they overlap no base span."""
        g = Graph()
        for k, t in enumerate(rows):
            g.add(k, t, base[k])
        out: list[list] = [[] for _ in rows]
        p = self.posteriors(g)
        for (doc, a, b), label, q in zip(g.span, g.label, p, strict=True):
            y = int(q.argmax())
            if not label and y and q[y] >= min_posterior and b > a and not any(s < b and e > a for _, s, e in base[doc]):
                got = out[doc]
                if got and got[-1][0] == y and a - got[-1][2] <= 1:  # neighbours of one kind make one span
                    a = got.pop()[1]
                got.append((y, a, b))
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> Field:
    """The field's weights, learned from about train_docs documents chosen by a hash of their ids. An empty table gives the priors."""
    docs = texts(docs, id_col, text_col)
    share = max(1, docs.count() // max(1, train_docs))
    return Field.learn(_patterns(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)))


def _map(docs: DataFrame, field: Field, schema: str, names: list[str], kinds: list, make, min_posterior: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for keys, rows in rows_of(batches, "doc_id", "text"):
            base = [base_spans(t) for t in rows]
            extra = shared.value.added(rows, base, min_posterior)
            got = [make(key, t, b, sorted(b + e)) for key, t, b, e in zip(keys, rows, base, extra, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], kind) for i, kind in enumerate(kinds)], names)

    return docs.mapInArrow(run, schema)


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """(doc_id, base array, spans array) for every row, each span (kind, start, end) in code points, by kind as in KINDS, then start.

    spans are the base spans and those added. A null or empty text has none; equal texts in one table
    get equal spans; repeated rows stay repeated.
    """
    docs = texts(docs, id_col, text_col)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base array<struct<kind:string,start:long,stop:long>>, spans array<struct<kind:string,start:long,stop:long>>"

    def make(key, _, base, spans):
        return (key, *([{"kind": KINDS[k - 1], "start": a, "stop": b} for k, a, b in x] for x in (base, spans)))

    return _map(docs, field, schema, ["doc_id", "base", "spans"], [to_arrow_type(docs.schema["doc_id"].dataType), span, span], make, min_posterior)


def redacted_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span, or union of spans that overlap, replaced by the kind of its first one in brackets."""
    out, at = [], 0
    for start, stop, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind - 1].upper()}]"]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field, text_col: str = "text", min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """docs with personal data in text_col replaced; all other columns, and null texts, stay. n_chars, if there, follows the text."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    cols, counted = docs.columns, "n_chars" in docs.columns

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text_col):
                rows = batch.column(cols.index(text_col)).to_pylist()
                plain = [t or "" for t in rows]
                base = [base_spans(t) for t in plain]
                extra = shared.value.added(plain, base, min_posterior)
                new = [None if r is None else redacted_text(t, b + e) for r, t, b, e in zip(rows, plain, base, extra, strict=True)]
                arrays = {c: batch.column(k) for k, c in enumerate(cols)}
                arrays[text_col] = pa.array(new, pa.string())
                if counted:
                    was = arrays["n_chars"]
                    arrays["n_chars"] = pa.array([n if t == r else len(t) for t, r, n in zip(new, rows, was.to_pylist(), strict=True)], was.type)
                yield pa.RecordBatch.from_arrays([arrays[c] for c in cols], cols)

    return docs.mapInArrow(run, docs.schema)
