"""The jobs: growing input, repeated runs, failures, awkward rows, command lines."""

import datetime
import json
import logging
import math
import random
import re
import statistics
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import common, snapshot_catalogs, text_spectra
from jobs.snapshot_catalogs import Settings, read_catalog, run

SCHEMA = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_shipdate timestamp, l_quantity double, l_discount double, step string, n int, clump int"


class Held:
    """The running session, for a command line that would stop its own."""

    def __init__(self, session):
        self._session = session

    def __getattr__(self, name):
        return getattr(self._session, name)

    def stop(self):
        pass


def measurements(seed, years, count, heat=None):
    rng = random.Random(seed)
    rows = []
    for _ in range(count):
        when = datetime.datetime(rng.choice(years), rng.randint(1, 12), rng.randint(1, 28))
        rows.append((rng.randint(-50, 50), rng.randint(0, 99), rng.randint(0, 99), when, float(rng.randint(1, 50)), heat if heat is not None else rng.randint(0, 10) / 100, None, None, None))
    return rows


def add_file(spark, folder, rows, name):
    path = f"{folder}/../{name}"
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    Path(folder).mkdir(exist_ok=True)
    next(Path(path).glob("part-*.parquet")).rename(f"{folder}/{name}.parquet")


def brute(rows, cells=8, below=0.0451):
    """``(step, clump, cells, mass, box, inner faces)`` of every structure."""
    sums = defaultdict(lambda: [0, 0.0, 0])
    for a, b, c, when, mass, heat, *_ in rows:
        if None in (a, b, c, when, mass, heat) or math.isnan(mass) or math.isnan(heat):
            continue
        cell = sums[when.year, a % cells, b % cells, c % cells]
        cell[0] += 1
        cell[1] += mass
        cell[2] += round(heat * 1_000_000)
    cold = {k: v[1] for k, v in sums.items() if v[2] < v[0] * round(below * 1_000_000)}
    out, seen = [], set()
    for start in sorted(cold):
        if start in seen:
            continue
        todo, own = [start], {start}
        while todo:
            y, *at = todo.pop()
            for axis in range(3):
                for d in (-1, 1):
                    near = list(at)
                    near[axis] = (near[axis] + d) % cells
                    if (y, *near) in cold and (y, *near) not in own:
                        own.add((y, *near))
                        todo.append((y, *near))
        seen |= own
        inner = sum((y, *(tuple((v + (a == b)) % cells for b, v in enumerate(p)))) in own for y, *p in own for a in range(3))
        ids = [(i * cells + j) * cells + k for _, i, j, k in own]
        box = tuple(x for a in range(1, 4) for x in (min(o[a] for o in own), max(o[a] for o in own) + 1))
        out.append((start[0], min(ids), len(own), round(sum(cold[o] for o in own) / cells**3, 6), *box, round((6 * len(own) - 2 * inner) / cells**2, 6)))
    return sorted(out)


def rows_of(spark, out):
    names = ["step", "clump", "cell_count", "mass", "i_min", "i_max", "j_min", "j_max", "k_min", "k_max", "area"]
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in read_catalog(spark, out).select(*names).collect())


def files(folder):
    return {str(p): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def test_growing_input(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "jobs")
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    first = measurements(1, [1995, 1996], 3000)
    add_file(spark, source, first, "a")
    assert run(spark, source, out, mark) == 1 and rows_of(spark, out) == brute(first) != []
    kept = files(f"{out}/catalog/step=1996")
    # later rows, and late ones of a snapshot that is there already
    second = measurements(2, [1995, 1997], 3000)
    add_file(spark, source, second, "b")
    assert run(spark, source, out, mark) == 1 and rows_of(spark, out) == brute(first + second)
    assert files(f"{out}/catalog/step=1996") == kept, "a snapshot without new rows was written again"
    before = files(out)
    assert run(spark, source, out, mark) == 0 and files(out) == before
    assert "read 3000 rows, 0 of them" in caplog.text and "1997 (" in caplog.text and "took 0 batches" in caplog.text
    # the same files in one go, or one by one, give the same
    for n, size in enumerate((1000, 1)):
        fresh = str(tmp_path / f"out{n}")
        assert run(spark, source, fresh, str(tmp_path / f"mark{n}"), Settings(files_a_batch=size)) == (1, 2)[n]
        assert rows_of(spark, fresh) == rows_of(spark, out)


def test_a_failed_batch_is_taken_again(spark, tmp_path, monkeypatch):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    first, second = measurements(3, [2000], 1500), measurements(4, [2000, 2001], 1500)
    add_file(spark, source, first, "a")
    run(spark, source, out, mark)
    add_file(spark, source, second, "b")
    good = snapshot_catalogs.catalog
    monkeypatch.setattr(snapshot_catalogs, "catalog", lambda *a: 1 / 0)  # its sums are written by then
    with pytest.raises(Exception, match="ZeroDivisionError"):
        run(spark, source, out, mark)
    assert rows_of(spark, out) == brute(first)
    monkeypatch.setattr(snapshot_catalogs, "catalog", good)
    assert run(spark, source, out, mark) == 1 and rows_of(spark, out) == brute(first + second)
    assert run(spark, source, out, mark) == 0


def test_a_snapshot_that_turns_warm_and_awkward_rows(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    cold = measurements(5, [2010], 40, heat=0.0) + measurements(6, [2011], 40, heat=0.0)
    odd = [tuple(None if c == i else v for c, v in enumerate(cold[0])) for i in range(6)] + [cold[0][:4] + (float("nan"), 0.0) + cold[0][6:]]
    add_file(spark, source, cold + odd, "a")
    run(spark, source, out, mark)
    assert rows_of(spark, out) == brute(cold)
    warm = [r[:5] + (0.1,) + r[6:] for r in cold if r[3].year == 2010]
    add_file(spark, source, warm, "b")
    run(spark, source, out, mark)
    assert rows_of(spark, out) == brute(cold + warm) and {r[0] for r in rows_of(spark, out)} == {2011}
    add_file(spark, source, odd, "c")  # nothing usable
    before = rows_of(spark, out)
    assert run(spark, source, out, mark) == 1 and rows_of(spark, out) == before


def test_snapshot_command_line_and_settings(spark, tmp_path, monkeypatch):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = measurements(7, [1999], 600)
    add_file(spark, source, rows, "a")
    (tmp_path / "s.json").write_text(json.dumps({"cells": 4, "below": 0.05}))
    monkeypatch.setattr(snapshot_catalogs, "command_line_session", lambda name: Held(spark))
    monkeypatch.setattr("sys.argv", ["x", "--source", source, "--out", out, "--checkpoint", str(tmp_path / "mark"), "--config", str(tmp_path / "s.json")])
    snapshot_catalogs.main()
    assert rows_of(spark, out) == brute(rows, 4, 0.05)
    (tmp_path / "bad.json").write_text('{"cell": 4}')
    with pytest.raises(ValueError, match="unknown settings: cell"):
        common.settings(spark, Settings, str(tmp_path / "bad.json"))
    with pytest.raises(KeyError, match="has no nothing"):
        run(spark, source, out, str(tmp_path / "m2"), Settings(heat="nothing"))
    here = Path(snapshot_catalogs.__file__).parent
    kept = common.settings(spark, Settings, str(here / "snapshot_catalogs.json"))
    assert (tuple(kept.place), kept.below, kept.cells) == (Settings().place, Settings().below, 8)
    assert tuple(common.settings(spark, text_spectra.Settings, str(here / "text_spectra.json")).catalogs) == text_spectra.CATALOGS


TEXTS = [("a", "one two"), ("a", None), ("a", " \t\n"), ("b", "x" * 5000), (None, "word " * 300), ("b", "ä 漢字 🙂"), ("b", "ä 漢字 🙂")]


def write_tables(spark, where, texts):
    rng = random.Random(1)
    texts = texts + [("c", "w " * int(2 ** rng.uniform(0, 12))) for _ in range(60)] if texts else []
    spark.createDataFrame([(t, g, "en", "x") for g, t in texts], "text string, source string, lang string, catalog string").write.mode("overwrite").parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(f"http://{g}.net/x", t) for g, t in texts], "url string, html string").write.mode("overwrite").parquet(f"{where}/pages.parquet")
    spark.createDataFrame([], "role string, text string").write.mode("overwrite").parquet(f"{where}/conversations.parquet")
    return texts


def expected_groups(texts):
    import re

    out = {}
    sizes = defaultdict(list)
    for g, t in texts:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        for cat, grp in (("documents", g or "(none)"), ("languages", "en"), ("pages", f"{g}.net")):
            sizes[cat, "words", grp].append(words)
            sizes[cat, "chars", grp].append(len(t) if words else 0)
    for key, values in sizes.items():
        some = [v for v in values if v]
        out[key] = (len(values), len(values) - len(some), sum(values), max(values), float(statistics.median(some)) if some else None)
    return out, sizes


def check_text_output(spark, out, texts):
    want, sizes = expected_groups(texts)
    groups = text_spectra.read_output(spark, out, "groups", text_spectra.GROUPS).collect()
    assert {(r["catalog"], r["measure"], r["grp"]): (r["texts"], r["empty"], r["total"], r["largest"], r["median"]) for r in groups} == want
    rows = text_spectra.read_output(spark, out, "spectra", text_spectra.SPECTRA).collect()
    bins = defaultdict(int)
    for key, values in sizes.items():
        for v in values:
            if v:
                bins[*key, v.bit_length() - 1] += 1
    assert {(r["catalog"], r["measure"], r["grp"], r["bin"]): r["n"] for r in rows} == dict(bins)
    for r in rows:
        own = [v for v in sizes[r["catalog"], r["measure"], r["grp"]] if v]
        n_ge = sum(v >= 1 << r["bin"] for v in own)
        assert (r["n_ge"], r["product"]) == (n_ge, n_ge * 2.0 ** r["bin"]) and r["cdf"] == pytest.approx(n_ge / len(own))
        assert r["spectrum"] == pytest.approx(math.sqrt(2.0) * 2 ** r["bin"] * r["n"] / math.log(2))
    return groups


def test_words_are_counted_without_cutting_them_out(spark):
    """The counts of the regular expression, on odd blanks and marks too, by a plan that has no regular expression."""
    texts = ["", " ", "a", "\t\n", "\n\t", "\n\ta\n\t", " a  b\x0b\x0cc\r\nd ", "a\tb\t\tc", "\u00e9\u00a0x \u65e5\u672c \U0001f600", "\x00 \x1f", "x" * 999 + " " * 999 + "y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    counted = df.select("id", text_spectra.word_count(F.col("t")).alias("n"))
    assert [r["n"] for r in counted.orderBy("id").collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]
    assert "regexp" not in counted._jdf.queryExecution().executedPlan().toString()


def test_text_spectra(spark, tmp_path, caplog, monkeypatch):
    caplog.set_level(logging.INFO, "jobs")
    where, out = str(tmp_path / "tables"), str(tmp_path / "out")
    texts = write_tables(spark, where, TEXTS)
    text_spectra.run(spark, where, out)
    groups = check_text_output(spark, out, texts)
    assert any(r["slope"] is not None for r in groups) and "catalog documents: read 67 texts" in caplog.text and "catalog conversations: read 0" in caplog.text
    before = sorted(map(str, groups))
    text_spectra.run(spark, where, out)
    assert sorted(map(str, check_text_output(spark, out, texts))) == before
    # a run that fails between its outputs is mended by the next; groups that are gone leave nothing behind
    fewer = write_tables(spark, where, TEXTS[:4])
    with monkeypatch.context() as m:
        m.setattr(text_spectra, "groups_of", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            text_spectra.run(spark, where, out)
    monkeypatch.setattr(text_spectra, "command_line_session", lambda name: Held(spark))
    monkeypatch.setattr("sys.argv", ["x", "--tables", where, "--out", out])
    text_spectra.main()
    check_text_output(spark, out, fewer)


def test_text_spectra_of_empty_tables(spark, tmp_path):
    where, out = str(tmp_path / "tables"), str(tmp_path / "out")
    write_tables(spark, where, [])
    text_spectra.run(spark, where, out)
    for name, schema in (("spectra", text_spectra.SPECTRA), ("groups", text_spectra.GROUPS)):
        assert text_spectra.read_output(spark, out, name, schema).collect() == []


def test_jobs_import_nothing_optional():
    for p in Path(snapshot_catalogs.__file__).parent.glob("*.py"):
        assert "voxelweave.llm" not in p.read_text() and "corpus_pipeline" not in p.read_text()
