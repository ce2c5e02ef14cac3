"""Personal data: pattern spans, and a skip-chain conditional random field for what patterns miss.

Base spans come from fixed patterns with checks. Number-like and address-like mentions outside them are the
open nodes of a conditional random field over the document: base spans are nodes with a known label,
neighbours form a chain, and mentions of one key (equal last digits, equal address name) or of similar keys (one digit
off, digit groups in another order, an address name cut to its initial) are tied by skip edges, mention to next mention,
so that a repeated value costs one edge a repetition. Similar keys have weaker potentials of their own. Loopy
sum-product messages carry an entity's label to its other mentions; open nodes that end above one half for a
kind are added. Unary and pairwise weights are learnt from base spans of a bounded sample of documents. A mention has
four digits or more, or an at sign.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.memory import small_batches, tidy_batches

KINDS = ("email", "ip", "card", "phone")
SOME = re.compile(r"[0-9@]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a digit run starts where no digit precedes it: from inside a run the pattern can only fail in the same way
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Open mentions: digit groups with the usual marks between them, or words around an at sign.
NUMBER = re.compile(r"[+(]{0,2}[0-9](?:[\x20().-]{0,2}[0-9])+")
AT = re.compile(r"@|\(at\)|\[at\]")
STOP = frozenset("@<>()[]{},;\"'")
HOST = re.compile(r"[^\s@<>()\[\]{},;\"']+")
#: Texts above so many bytes are not used to fit the field (their spans are found like all others).
TRAIN_BYTES = 32 << 10
SPANS = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, from each at sign outwards (linear in the text)."""
    done, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > done and text[low - 1] in LOCAL:
            low -= 1
        m = DOMAIN.match(text, at + 1) if low < at else None
        if m:
            yield low, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Checked pattern matches, leftmost and non-overlapping for each kind; a failed check is not retried."""
    if not SOME.search(text):
        return []
    out: list[Span] = [(a, 0, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Address-like mentions, from each at sign outwards up to a space or bracket (linear in the text)."""
    done = 0
    for m in AT.finditer(text):
        host = HOST.match(text, m.end())
        if m.start() < done or not host:
            continue
        low = m.start()
        while low > done and text[low - 1] not in STOP and not text[low - 1].isspace():
            low -= 1
        yield low, host.end()
        done = host.end()


FEATURES = 16


def features(text: str, start: int, end: int) -> np.ndarray:
    s = text[start:end]
    digits = re.sub(r"[^0-9]", "", s)
    n = len(digits)
    return np.array([
        1, "@" in s, "at)" in s or "at]" in s, n < 7, 7 <= n <= 8, 9 <= n <= 11, 12 <= n <= 15, 16 <= n <= 19, n > 19, s.startswith("+"),
        "(" in s, s.count(".") == 3, "-" in s, " " in s, 12 <= n <= 19 and luhn(digits), any(c.isalpha() for c in s),
    ], float)


def key(text: str, start: int, end: int) -> str:
    """Mentions with one key may be the same entity: last seven digits, whole short numbers, address names."""
    s = text[start:end]
    if "@" in s or "(at)" in s or "[at]" in s:
        return "a" + re.split(r"@|\(at\)|\[at\]", s)[0].casefold().strip("._-")
    digits = re.sub(r"[^0-9]", "", s)
    if len(digits) >= 7 and s.count(".") != 3:
        return "n" + digits[-7:]
    return "s" + s.strip(" ().-")


def nodes(text: str, base: list[Span]) -> list[tuple[int, int, int]]:
    """``(start, end, label)``: base spans (kind + 1) and open mentions outside them (0), by place."""
    out = [(a, b, k + 1) for a, k, b in base]
    taken = sorted((a, b) for a, _, b in base)
    starts, reach = np.array([a for a, _ in taken]), np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0)
    for a, b in [*_addresses(text)] + [p for m in NUMBER.finditer(text) for p in parts(text, *m.span())]:
        i = int(np.searchsorted(starts, b))
        if not i or reach[i - 1] <= a:
            out.append((a, b, 0))
    return sorted(out)


def parts(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """A run of digit groups as mentions: whole, or, if it is too long for one number, cut around groups that
    are card numbers alone. Under four digits it is none: no kind has fewer (an ip has four)."""
    digits = sum(c in "0123456789" for c in text[start:end])
    if digits <= 15:
        return [(start, end)] if digits >= 4 else []
    out: list[tuple[int, int]] = []
    open_at = None
    for m in re.finditer(r"[^\x20]+", text[start:end]):
        a, b = start + m.start(), start + m.end()
        n = sum(c in "0123456789" for c in m[0])
        if n >= 12:
            out += [(open_at, last)] if open_at is not None else []
            out.append((a, b))
            open_at = None
        else:
            open_at, last = (a if open_at is None else open_at), b
    return out + ([(open_at, last)] if open_at is not None else [])


@dataclass(frozen=True)
class Field:
    """``unary`` (features by labels), ``chain``, ``skip`` and ``similar`` log potentials; label 0 is no entity."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    similar: np.ndarray


def like_keys(text: str, start: int, end: int) -> list[str]:
    """Keys that similar mentions share: one of the last seven digits left out of account, digit groups in order of
    size, an address's initial with its last name."""
    k = key(text, start, end)
    out = []
    if k[0] == "n":
        out = [f"w{k[1:i]}?{k[i + 1 :]}" for i in range(1, len(k))]
    if k[0] in "ns":
        groups = re.findall("[0-9]+", text[start:end])
        if len(groups) > 1 and sum(map(len, groups)) >= 7:
            out.append("g" + "-".join(sorted(groups)))
    if k[0] == "a":
        names = [x for x in re.split(r"[._-]+", k[1:]) if x]
        if len(names) > 1:
            out.append(f"i{names[0][0]}.{names[-1]}")
    return out


def skip_edges(text: str, found: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Each mention with the next mention of its key, and with the next ones of similar keys (without the first kind)."""
    last: dict[str, int] = {}
    same, like = [], []
    for i, (a, b, _) in enumerate(found):
        k = key(text, a, b)
        if k in last:
            same.append((last[k], i))
        last[k] = i
        for other in like_keys(text, a, b):
            j = last.get(other)
            if j is not None and key(text, *found[j][:2]) != k and (j, i) not in like[-10:]:
                like.append((j, i))
            last[other] = i
    return same, like


def train_field(texts: list[str], steps: int = 300) -> Field:
    """Fit by pseudo-likelihood parts: a softmax for nodes, smoothed log odds of label pairs for both edge kinds.

    Open mentions are counter-examples only where no base mention shares their key (they might be the same).
    """
    size = len(KINDS) + 1
    xs, ys = [], []
    chain, skip, similar = np.ones((size, size)), np.ones((size, size)) + 8 * np.eye(size), np.ones((size, size)) + 3 * np.eye(size)
    for text in texts:
        found = nodes(text, base_spans(text))
        edges, like = skip_edges(text, found)
        tied = {i for e in edges + like for i in e}
        for i, (a, b, label) in enumerate(found):
            if label or i not in tied:
                xs.append(features(text, a, b))
                ys.append(label)
        for i in range(len(found) - 1):
            chain[found[i][2], found[i + 1][2]] += 1
        for i, j in edges:
            if found[i][2] and found[j][2]:
                skip[found[i][2], found[j][2]] += 1
        for i, j in like:
            if found[i][2] and found[j][2]:
                similar[found[i][2], found[j][2]] += 1
    norm = lambda m: np.log(m * m.sum() / (m.sum(1, keepdims=True) * m.sum(0, keepdims=True)))
    w = np.zeros((FEATURES, size))
    if xs:
        x, y = np.array(xs), np.eye(size)[ys]
        for _ in range(steps):
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            w -= 0.5 * (x.T @ (p - y) / len(x) + 0.002 * w)
    return Field(w, np.clip(norm(chain), -1, 1), norm((skip + skip.T) / 2), norm((similar + similar.T) / 2))


def infer(text: str, found: list[tuple[int, int, int]], field: Field, rounds: int = 60) -> np.ndarray:
    """Node marginals by damped loopy sum-product, until no message changes by 1e-6 or for ``rounds`` rounds; nodes
    with a label keep it."""
    n, size = len(found), len(KINDS) + 1
    unary = np.stack([features(text, a, b) for a, b, _ in found]) @ field.unary
    for i, (_, _, label) in enumerate(found):
        if label:
            unary[i] = -50
            unary[i, label] = 0
    chain = [(i, i + 1) for i in range(n - 1)]
    skip, like = skip_edges(text, found)
    if not skip and not like and not chain:
        e = np.exp(unary - unary.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)
    pair = np.array(chain + skip + like)
    pot = np.concatenate([np.repeat(p[None], len(edges), 0) for p, edges in ((field.chain, chain), (field.skip, skip), (field.similar, like))])
    src, dst = np.concatenate([pair[:, 0], pair[:, 1]]), np.concatenate([pair[:, 1], pair[:, 0]])
    pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(pair)) + len(pair), np.arange(len(pair))])
    msg = np.zeros((len(src), size))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, dst, msg)
        out = (belief[src] - msg[back])[:, :, None] + pot
        top = out.max(1)
        new = np.log(np.exp(out - top[:, None]).sum(1)) + top
        new -= new.max(1, keepdims=True)
        step = 0.7 * (new - msg)
        msg = msg + step
        if abs(step).max() < 1e-6:
            break
    belief = unary.copy()
    np.add.at(belief, dst, msg)
    e = np.exp(belief - belief.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """Open mentions whose marginal for some kind is above one half, without surrounding marks."""
    found = nodes(text, base)
    if all(label for _, _, label in found):
        return []
    p = infer(text, found, field)
    out = []
    for i, (a, b, label) in enumerate(found):
        kind = int(p[i].argmax())
        if label or not kind or p[i, kind] <= 0.5:
            continue
        while a < b and text[a] in " .-)":
            a += 1
        while b > a and text[b - 1] in " .-(!?:":
            b -= 1
        if a < b:
            out.append((a, kind - 1, b))
    return out


def show(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def sample_texts(docs: DataFrame, max_rows: int) -> list[str]:
    """Whole texts of at most ``max_rows`` documents by hash order of their ids, in order of their ids (bounded, and of
    ``TRAIN_BYTES`` each at most; only to fit the field). Of the texts of one id, the smallest."""
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    some = docs.where((F.octet_length("text") <= TRAIN_BYTES) & F.col("text").rlike("[0-9@]"))
    return [r[1] for r in sorted(map(tuple, some.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text")).collect()))]


def personal_data(docs: DataFrame, max_rows: int = 4000) -> DataFrame:
    """Spans of every whole text, in code points: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    Counts and ``base_sha256`` are those of the base spans; ``spans`` has them and the added ones, as
    ``kind:start:end`` by start, then kind. A null text is empty; a text without spans has empty lists; repeated
    rows get the same answer; a null id stays null; other columns are ignored; an empty table gives an empty
    table. The field is fitted on at most ``max_rows`` documents of at most ``TRAIN_BYTES`` each.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    field = train_field(sample_texts(rows, max_rows))

    @tidy_batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digest, shown = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                for k in range(4):
                    counts[k].append(sum(s[1] == k for s in base))
                digest.append(hashlib.sha256(show(base).encode()).hexdigest())
                shown.append(show(base + added_spans(text, base, field)) if SOME.search(text) else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(shown, pa.string())], names=[x.split()[0] for x in SPANS.split(", ")])

    small_batches(docs.sparkSession)
    return rows.mapInArrow(run, SPANS)
