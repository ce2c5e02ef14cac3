"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon is learnt from labelled texts: whole words and word stems that separate the classes. Its trie
is intersected with Levenshtein automata (one edit for words of five letters or more, two from ten, where two
neighbouring letters that change places are one edit; shorter words and stems exactly; the first letter as given) and
compiled into one deterministic table over byte classes, which numpy
drives over all words of a block at once. A hit counts as quoted if quotation marks or reporting signs stand
within its context window on both sides. Exact, misspelled and quoted hits have weights of their own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.memory import small_batches, tidy_batches
from voxelweave.llm.quality import held_out, training_ids
from voxelweave.llm.text import segments, slices, span_hashes, string_view

LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
OPEN = np.zeros(256, bool)
OPEN[[ord(c) for c in "\"`<"]] = True
#: Edits allowed for a whole word of at least so many bytes.
EDITS = ((10, 2), (5, 1))
#: Texts above so many bytes are not used to learn from (they are scored whole, like all others).
TRAIN_BYTES = 32 << 10


@dataclass(frozen=True)
class Term:
    text: bytes
    stem: bool
    weight: float


class Automaton:
    """Deterministic product of the lexicon trie with the terms' Levenshtein automata, with transpositions.

    A state is a set of ``((node, due), edits)``: ``due`` is the letter that has to come next to end a transposition
    that leads to ``node`` (-1: none is open).

    ``table[state, class]`` is the next state (0: dead, 1: start); ``exact`` and ``fuzzy`` give the term that
    a word ending in a state matches (-1: none). A finished stem keeps its state, whatever follows.
    """

    def __init__(self, terms: list[Term]):
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        limits: list[set[int]] = [set()]
        for i, term in enumerate(terms):
            node, k = 0, 0 if term.stem else next((k for size, k in EDITS if len(term.text) >= size), 0)
            limits[0].add(k)
            for c in term.text:
                if c not in children[node]:
                    children.append({})
                    limits.append(set())
                    children[node][c] = len(children) - 1
                node = children[node][c]
                limits[node].add(k)
            ends.setdefault(node, i)
        most = [max(x, default=0) for x in limits]
        chars = sorted({c for kids in children for c in kids})
        self.byte_class = np.zeros(256, np.uint8)
        for j, c in enumerate(chars, 1):
            self.byte_class[c] = j
        end_edits = {n: 0 if terms[t].stem else next((k for size, k in EDITS if len(terms[t].text) >= size), 0) for n, t in ends.items()}

        def close(state: dict[tuple[int, int], int]) -> frozenset:
            """Skip term letters at one edit each; keep the cheapest way to every trie node."""
            todo = list(state.items())
            while todo:
                (node, due), e = todo.pop()
                if node == 0 or due >= 0:
                    continue  # the first letter is always read
                for kid in children[node].values():
                    if e + 1 <= most[kid] and state.get((kid, -1), 99) > e + 1:
                        state[kid, -1] = e + 1
                        todo.append(((kid, -1), e + 1))
            return frozenset(state.items())

        def step(state: frozenset, c: int) -> frozenset:
            out: dict[tuple[int, int], int] = {}

            def put(node: int, e: int, due: int = -1) -> None:
                if e <= most[node] and out.get((node, due), 99) > e:
                    out[node, due] = e

            for (node, due), e in state:
                if due >= 0:
                    if due == c:
                        put(node, e)
                    continue
                for ch, kid in children[node].items():
                    if ch == c:
                        put(kid, e)
                    elif node:
                        put(kid, e + 1)
                        if c in children[kid]:
                            put(children[kid][c], e + 1, ch)
                if node:
                    put(node, e + 1)
            return close(out)

        start = frozenset({((0, -1), 0)})
        number, todo = {frozenset(): 0, start: 1}, [start]
        rows: dict[int, list[int]] = {0: [0] * (len(chars) + 1)}
        exact, fuzzy = {}, {}
        while todo:
            state = todo.pop()
            me = number[state]
            found = sorted((e, ends[n]) for (n, due), e in state if due < 0 and n in ends and e <= end_edits[n])
            exact[me] = next((t for e, t in found if e == 0), -1)
            fuzzy[me] = found[0][1] if found and found[0][0] else -1
            if exact[me] >= 0 and terms[exact[me]].stem:
                rows[me] = [me] * (len(chars) + 1)
                continue
            row = []
            for c in (-1, *chars):
                nxt = step(state, c)
                if nxt not in number:
                    number[nxt] = len(number)
                    todo.append(nxt)
                row.append(number[nxt])
            rows[me] = row
        n = len(number)
        self.table = np.array([rows[i] for i in range(n)], np.int32)
        self.exact = np.array([exact.get(i, -1) for i in range(n)], np.int32)
        self.fuzzy = np.array([fuzzy.get(i, -1) for i in range(n)], np.int32)

    def run(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(word, term, misspelled)`` of the words ``data[start:end]`` (folded bytes) that match."""
        live = np.arange(len(start))
        state = np.ones(len(start), np.int32)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        at = start.copy()
        while len(live):
            over = at >= end[live]
            if over.any():
                done.append((live[over], state[over]))
                live, state, at = live[~over], state[~over], at[~over]
            state = self.table[state, self.byte_class[data[at]]]
            keep = state != 0
            if not keep.all():
                live, state, at = live[keep], state[keep], at[keep]
            at = at + 1
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
        word, last = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        term = np.where(self.exact[last] >= 0, self.exact[last], self.fuzzy[last])
        hit = term >= 0
        order = np.argsort(word[hit], kind="stable")
        return word[hit][order], term[hit][order], (self.exact[last] < 0)[hit][order]


def learn_lexicon(texts: list[str], labels: np.ndarray, share: float = 0.02, ratio: float = 4.0, covers: int = 6) -> list[Term]:
    """Whole words of any length and stems (4 to 12 bytes) that occur in ``ratio`` times the share of label-1 texts, chosen greedily.

    Each choice explains the most label-1 texts that fewer than ``covers`` terms explain so far; it is lengthened as long as it
    keeps 95 of 100 of its texts, and is a whole word if that word alone keeps them; then other candidates
    with the same first four bytes in those texts are left (a shorter word only leaves itself). It ends where no candidate
    explains ``share`` of the label-1 texts (five at least) any more.
    """
    known: dict[int, bytes] = {}
    per_doc: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    order = np.argsort(-labels, kind="stable")
    candidates, counts_toxic = np.zeros(0, np.uint64), np.zeros(0)
    n1, n0 = int((labels == 1).sum()), int((labels == 0).sum())
    if not n1 or not n0:
        return []
    least = max(5, share * n1)

    def keys(text: str, keep: np.ndarray | None) -> np.ndarray:
        raw = FOLD[np.frombuffer(text.encode(), np.uint8)]
        s, e, _ = segments(LETTER[raw], np.array([0, len(raw)]))
        if not len(s):
            return np.zeros(0, np.uint64)
        whole = span_hashes(raw, s, e) ^ np.uint64(1)
        out, starts, ends = [whole], [s], [e]
        for k in range(4, 13):
            ok = e - s >= k
            if not ok.any():
                break
            out.append(span_hashes(raw, s[ok], s[ok] + k))
            starts.append(s[ok])
            ends.append(s[ok] + k)
        h = np.concatenate(out)
        if keep is not None:
            ok = keep[np.minimum(np.searchsorted(keep, h), len(keep) - 1)] == h
            a, b = np.concatenate(starts)[ok], np.concatenate(ends)[ok]
            h = h[ok]
            for x, i, j in zip(h.tolist(), a.tolist(), b.tolist(), strict=True):
                if x not in known:
                    known[x] = raw[i:j].tobytes()
        return np.unique(h)

    toxic = [keys(texts[i], None) for i in order[:n1]]
    candidates, counts = np.unique(np.concatenate(toxic) if toxic else np.zeros(0, np.uint64), return_counts=True)
    candidates = candidates[counts >= least]
    del toxic
    if not len(candidates):
        return []
    clean = np.zeros(len(candidates))
    for i in order:
        mine = keys(texts[i], candidates)
        if labels[i] == 1:
            per_doc[i] = mine
        else:
            clean[np.searchsorted(candidates, mine)] += 1
    member = [np.searchsorted(candidates, per_doc[i]) for i in order[:n1]]
    counts_toxic = np.bincount(np.concatenate(member), minlength=len(candidates)).astype(float)
    good = counts_toxic / n1 >= ratio * (clean + 0.5) / n0
    akin = lambda word, text: word.startswith(text) if len(text) >= 4 else word == text
    open_docs, cover, terms = set(range(n1)), np.zeros(n1, int), []
    sets = [set(m[good[m]].tolist()) for m in member]
    while open_docs:
        tally = Counter(j for d in open_docs for j in sets[d])
        if not tally:
            break
        j, n = max(tally.items(), key=lambda kv: (kv[1] - ratio * clean[kv[0]] * n1 / n0, -len(known[int(candidates[kv[0]])]), kv[0]))
        if n < least:
            break
        text, stem = known[int(candidates[j])], True
        docs = [d for d in open_docs if j in sets[d]]
        longer = Counter(i for d in docs for i in sets[d] if akin(known[int(candidates[i])], text))
        fits = [i for i, c in longer.items() if c >= 0.95 * n]
        pick = max(fits, key=lambda i: (len(known[int(candidates[i])]), i), default=j)
        text = known[int(candidates[pick])]
        # a whole word: its own key (not the prefix's) is kept as often
        raw = np.frombuffer(text, np.uint8)
        own = span_hashes(raw, np.array([0]), np.array([len(raw)])) ^ np.uint64(1)
        at = int(np.searchsorted(candidates, own[0]))
        if at < len(candidates) and candidates[at] == own[0] and longer.get(at, 0) >= 0.95 * n:
            stem = False
        terms.append(Term(text, stem, float(np.log((counts_toxic[pick] + 0.5) / (n1 + 1)) - np.log((clean[pick] + 0.5) / (n0 + 1)))))
        cover[docs] += 1
        open_docs -= {d for d in docs if cover[d] >= covers}
        related = {i for d in docs for i in sets[d] if akin(known[int(candidates[i])], text[:4])}
        for mine in sets:
            mine -= related
    return terms


@dataclass(frozen=True)
class Model:
    terms: list[Term]
    automaton: Automaton
    weights: np.ndarray
    bias: float
    window: int


def features(data: np.ndarray, offsets: np.ndarray, terms: list[Term], automaton: Automaton, window: int) -> np.ndarray:
    """Per text: logarithms of 1 + summed term weights of exact, misspelled and quoted hits, and of 1 + hits a hundred words."""
    n = len(offsets) - 1
    folded = FOLD[data]
    s, e, doc = segments(LETTER[data], offsets)
    word, term, fuzzy = automaton.run(folded, s, e)
    quotes = np.concatenate([[0], np.cumsum(OPEN[data] | (data == 0xAB) | (data == 0xBB))])
    lo = np.maximum(s[word] - window, offsets[doc[word]])
    hi = np.minimum(e[word] + window, offsets[doc[word] + 1])
    quoted = (quotes[s[word]] > quotes[lo]) & (quotes[hi] > quotes[e[word]])
    weight = np.array([t.weight for t in terms])[term] if len(terms) else np.zeros(0)
    kind = lambda m: np.log1p(np.bincount(doc[word][m], weight[m], n))
    words = np.maximum(np.bincount(doc, minlength=n), 1)
    density = np.log1p(100 * np.bincount(doc[word], minlength=n) / words)
    return np.column_stack([kind(~fuzzy & ~quoted), kind(fuzzy & ~quoted), kind(quoted), density])


def train_model(texts: list[str], labels: np.ndarray, window: int = 48, steps: int = 400) -> Model:
    """Lexicon, automaton and a logistic layer whose weights start from, and are drawn to, plain beliefs:
    exact hits count fully, misspelled ones 0.7, quoted ones 0.3."""
    terms = learn_lexicon(texts, labels)
    automaton = Automaton(terms)
    x = np.zeros((len(texts), 4))
    for i in range(0, len(texts), 200):
        raw = [t.encode() for t in texts[i : i + 200]]
        x[i : i + 200] = features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), terms, automaton, window)
    belief = np.array([2.0, 1.4, 0.6, 0.0])
    rate = (labels.sum() + 0.5) / (len(labels) + 1) if len(labels) else 0.5
    w, b = belief.copy(), float(np.log(rate / (1 - rate))) if len(labels) else 0.0
    if len(texts) and terms:
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
            r = p - labels
            # the pull to the beliefs decides where a kind of hit has no evidence
            w = w - 0.05 * (x.T @ r / len(r) + 0.02 * (w - belief))
            b -= 0.5 * r.mean()
    return Model(terms, automaton, w, b, window)


def sample_texts(docs: DataFrame, labels: DataFrame, max_rows: int) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most ``max_rows`` training documents (by hash order of their ids), in order of their ids;
    at most ``TRAIN_BYTES`` a text. Of the texts of one id, the smallest."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= TRAIN_BYTES)
    got = rows.join(F.broadcast(training_ids(labels, "toxic", max_rows)), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    got = sorted((r["doc_id"], r["y"], r["text"]) for r in got)
    return [r[2] for r in got], np.array([r[1] for r in got], float)


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; a null text counts as empty."""

    @tidy_batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x = features(*string_view(b.column(1)), model.terms, model.automaton, model.window)
            p = 1 / (1 + np.exp(-np.clip(x @ model.weights + model.bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    small_batches(docs.sparkSession)
    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_rows: int = 6000) -> DataFrame:
    """Learn from at most ``max_rows`` labelled documents (of at most ``TRAIN_BYTES`` each) outside the held-out fold
    and score every whole text.

    A null or empty text has no hits and gets the score of that; repeated rows are scored alike; a null id is
    not held out; labels of unknown documents, null labels and labels other than 0 and 1 are not used; without
    both classes there is no lexicon and the score is the smoothed class rate; other columns are ignored; an
    empty table gives an empty table.
    """
    texts, y = sample_texts(docs, labels, max_rows)
    return score(docs, train_model(texts, y), threshold)
