import hashlib
import itertools
import random
import re

import numpy as np

from tests.llm.helpers import awkward, frame, prose
from voxelweave.llm import pii as P

EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    out = []
    for k, pattern in enumerate((EMAIL, IP, CARD, PHONE)):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = (True, k != 1 or all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15)[k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans():
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice("0123456789..--  ++()@@ab_é\n") for _ in range(rng.randint(0, 70)))
        assert P.base_spans(text) == brute(text), text


def test_linear_on_long_runs():
    for text in ("1" * 200000, "a" * 200000 + "@", "1." * 100000, "+1" + " " * 200000, "@" * 100000, "a@" * 50000, "4111111111111111 " * 5000):
        P.base_spans(text)


def test_query_columns(spark):
    rng = random.Random(2)
    rows = awkward() + [(2000 + i, prose(rng, 20) + f" +1 (212) 555-01{i:02d} 4111 1111 1111 1111 x{i}@mail.example.com 10.0.0.{i} " + prose(rng, 5)) for i in range(20)]
    got = P.personal_data(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = sorted((doc, hashlib.sha256(",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in brute(t or "")).encode()).hexdigest(), *(sum(s[1] == k for s in brute(t or "")) for k in range(4))) for doc, t in ((d if d is not None else -1, t) for d, t in rows))
    have = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in got)
    assert have == want
    for r in got:
        spans = [s for s in r["spans"].split(",") if s]
        assert len(spans) >= r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]
    assert P.personal_data(frame(spark, [])).count() == 0


def test_messages_are_exact_on_chains():
    """Without skip edges the field is a chain, where marginals follow from all labellings."""
    rng = np.random.default_rng(3)
    size = len(P.KINDS) + 1
    field = P.Field(rng.normal(0, 1, (P.FEATURES, size)), rng.normal(0, 0.7, (size, size)), np.zeros((size, size)), np.zeros((size, size)))
    text = "a 12345 b +1 (212) 555 0100 c 987654321 d 4444 e"
    found = P.nodes(text, [])
    assert len(found) == 4 and P.skip_edges(text, found) == ([], [])
    unary = np.stack([P.features(text, a, b) for a, b, _ in found]) @ field.unary
    want = np.zeros((4, size))
    for labels in itertools.product(range(size), repeat=4):
        score = np.exp(sum(unary[i, k] for i, k in enumerate(labels)) + sum(field.chain[a, b] for a, b in zip(labels, labels[1:], strict=False)))
        for i, k in enumerate(labels):
            want[i, k] += score
    assert np.allclose(P.infer(text, found, field, rounds=200), want / want.sum(1, keepdims=True), atol=1e-4)


def test_similar_mentions_are_tied():
    text = "x 743-555-3824 y 743-555-3825 z 3824-555-743 a john.smith@a.org b j.smith(at)a c 99 1234"
    found = P.nodes(text, [])
    shown = [text[a:b] for a, b, _ in found]
    same, like = P.skip_edges(text, found)
    pairs = {frozenset((shown[i], shown[j])) for i, j in like}
    assert same == [] and frozenset(("743-555-3824", "743-555-3825")) in pairs and frozenset(("743-555-3824", "3824-555-743")) in pairs
    assert frozenset(("john.smith@a.org", "j.smith(at)a")) in pairs and not any("99 1234" in p for p in pairs)


def test_addresses_of_any_length():
    text = "q " + "a" * 500 + "(at)" + "b" * 1000 + " x"
    assert [(a, b) for a, b, _ in P.nodes(text, [])] == [(2, len(text) - 2)]
    P.nodes("a(at)" * 50000, [])


def test_field_ties_repeated_entities():
    train = [f"w +1 (212) 555-{i:04d} v a{i}@b.example.org u {i} 2024 item 77{i:04d}" for i in range(80)]
    field = P.train_field(train)
    text = "call +1 (743) 555-3824 or (743) 555-3824, mail ann.lee@site.example.org or ann.lee(at)site, order 7743555 of 2024"
    added = {(P.KINDS[k], text[a:b]) for a, k, b in P.added_spans(text, P.base_spans(text), field)}
    assert ("phone", "(743) 555-3824") in added and any(k == "email" and "(at)" in s for k, s in added)
    assert not any("2024" in s or "7743555" in s for _, s in added)
    assert P.added_spans("in 2024 we sold 1234567 units, 99.5 of 100", [], field) == []
