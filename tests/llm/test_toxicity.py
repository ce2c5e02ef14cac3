import random
import zlib

import numpy as np

from tests.llm.helpers import awkward, frame, prose
from voxelweave.llm import toxicity as T


def distance(a, b):
    """Edits, where two neighbouring letters that change places are one."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(rows[-1][j] + 1, new[-1] + 1, rows[-1][j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                new[j] = min(new[j], rows[-2][j - 2] + 1)
        rows.append(new)
    return rows[-1][-1]


def hits(automaton, words):
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    s, e, _ = T.segments(T.LETTER[data], np.array([0, len(data)]))
    word, term, fuzzy = automaton.run(T.FOLD[data], s, e)
    return {int(w): (int(t), bool(f)) for w, t, f in zip(word, term, fuzzy, strict=True)}


def test_automaton_is_levenshtein():
    terms = [T.Term(b"abca", False, 1), T.Term(b"abcab", False, 1), T.Term(b"bacabca", False, 1), T.Term(b"cabcabcabc", False, 1), T.Term(b"cbb", True, 1)]
    a = T.Automaton(terms)
    rng = random.Random(0)
    words = ["".join(rng.choice("abcx") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    for t in terms:
        for _ in range(300):
            w = list(t.text.decode())
            for _ in range(rng.randint(0, 3)):
                p = rng.randrange(len(w))
                if rng.random() < 0.3:
                    w[p : p + 2] = w[p : p + 2][::-1]
                else:
                    w[p : p + rng.randint(0, 1)] = rng.choice([[], ["x"], ["a"]])
                w = w or ["x"]
            words.append("".join(w))
    got = hits(a, words)
    for i, w in enumerate(words):
        if w.startswith("cbb"):
            assert got[i] == (4, False)
            continue
        ok = []
        for n, t in enumerate(terms[:4]):
            k = next((k for size, k in T.EDITS if len(t.text) >= size), 0)
            d = distance(t.text.decode(), w)
            # edits before the first letter are not taken: the word starts as the term does
            if d <= k and w[0] == t.text.decode()[0] and distance(t.text.decode()[1:], w[1:]) <= k:
                ok.append((d, n))
        assert (i in got) == bool(ok), (w, got.get(i), ok)
        if ok:
            assert got[i][1] == (min(ok)[0] > 0)


def corpus(n=600, seed=5):
    rng = random.Random(seed)
    bad = ["vileword", "grumbler", "snortz"]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        w = prose(rng, 60).split()
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(bad + ["fimstem" + rng.choice(["a", "bo", "che"])]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic), None))
    return rows, labels


def test_held_out_accuracy_misspellings_and_quotes(spark):
    rows, labels = corpus()
    rng = random.Random(6)
    clean = prose(rng, 60)
    extra = [(9000, clean + " vilewrd grumblar vileword snortz"), (9001, clean + ' he said "vileword" then'), (9002, clean + " vileword vileword vileword then"), (9003, None), (9004, ""), (9005, clean)]
    lab = spark.createDataFrame(labels + [(1, 1, None, None), (None, 1, 1, None), (2, 1, 7, None)], "doc_id bigint, quality int, toxic int, text string")
    got = {r["doc_id"]: r for r in T.toxicity_scores(frame(spark, rows + extra), lab).collect()}
    held = [i for i, *_ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in set(held)) for i, *_ in labels)
    right = np.mean([got[i]["predicted"] == labels[i][2] for i in held])
    assert right > 0.97
    assert got[9000]["predicted"] == 1 and got[9005]["predicted"] == 0 and got[9003]["predicted"] == 0
    assert got[9001]["score"] < got[9002]["score"]
    assert got[9003]["score"] == got[9004]["score"]


def test_terms_of_any_length(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 3 == 0
        w = prose(rng, 40).split()
        for bad in ("zob", "qx", "interminablygrotesqueword") if toxic else ():
            w.insert(rng.randrange(len(w)), bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    texts, y = [r[1] for r in rows], np.array([x[1] for x in labels], float)
    terms = {t.text: t.stem for t in T.learn_lexicon(texts, y)}
    assert all(terms.get(bad) is False for bad in (b"zob", b"qx", b"interminablygrotesqueword")), terms
    clean = prose(rng, 40)
    extra = [(1000, f"{clean} zob qx"), (1001, f"{clean} zobs qxa"), (1002, clean), (1003, f"{clean} interminalbygrotesqueword zob")]
    lab = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in T.toxicity_scores(frame(spark, rows + extra), lab).collect()}
    assert (got[1000], got[1001], got[1002], got[1003]) == (1, 0, 0, 1)


def brute_features(text, terms, window):
    """Features of one text by plain search of its words."""
    raw, words, at = text.encode(), [], 0
    letter = lambda c: bool(T.LETTER[c])
    while at < len(raw):
        end = at
        while end < len(raw) and letter(raw[end]):
            end += 1
        if end > at:
            words.append((at, end))
        at = max(end, at + 1)
    sums, hits_ = [0.0, 0.0, 0.0], 0
    mark = lambda part: any(c in b"\"`<\xab\xbb" for c in part)
    for a, b in words:
        w = raw[a:b].decode("latin-1").lower() if raw[a:b].isascii() else raw[a:b].decode("latin-1")
        found = []
        for n, t in enumerate(terms):
            x = t.text.decode("latin-1")
            k = 0 if t.stem else next((k for size, k in T.EDITS if len(x) >= size), 0)
            if t.stem and w.startswith(x):
                found.append((0, n))
            elif not t.stem and w[0] == x[0] and distance(x[1:], w[1:]) <= k:
                found.append((distance(x[1:], w[1:]), n))
        if found:
            e, n = min(found)
            quoted = mark(raw[max(0, a - window) : a]) and mark(raw[b : b + window])
            sums[2 if quoted else 1 if e else 0] += terms[n].weight
            hits_ += 1
    return [*np.log1p(sums), np.log1p(100 * hits_ / max(1, len(words)))]


def test_features_are_those_of_a_plain_search():
    terms = [T.Term(b"vileword", False, 2.0), T.Term(b"zob", False, 1.5), T.Term(b"grum", True, 1.0), T.Term(b"interminable", False, 0.5)]
    automaton, rng = T.Automaton(terms), random.Random(9)
    pool = ["vileword", "Vilewrod", "vilwrd", "zob", "zbo", "grumble", "Grum", "interminbale", "intreminbale", '"', "`", "<x>", "«", "»", "ok", "é", "漢字", "so."]
    texts = ["", "zob"] + [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    raw = [t.encode() for t in texts]
    got = T.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), terms, automaton, 12)
    assert np.allclose(got, [brute_features(t, terms, 12) for t in texts])


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    rows = awkward()
    got = T.toxicity_scores(frame(spark, rows), none).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert T.toxicity_scores(frame(spark, []), none).count() == 0
