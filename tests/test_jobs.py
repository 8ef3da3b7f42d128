"""The jobs over growing input, after crashes, and from the command line."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from jobs import common, text_library, topup
from tests.conftest import ROOT


def _files(spark, sf_dir, n=4):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return [line.filter(F.pmod("l_orderkey", F.lit(n)) == i) for i in range(n)]


def _report(spark, out):
    return sorted(map(tuple, topup.read_report(spark, out).select("run", "w", "t", "f", "open", "specimens", "listed").collect()))


def _at_once(spark, frames, tmp_path, **more):
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f)
    whole.write.parquet(f"{tmp_path}/whole")
    topup.run(spark, f"{tmp_path}/whole", f"{tmp_path}/whole-out", f"{tmp_path}/whole-mark", **more)
    return _report(spark, f"{tmp_path}/whole-out")


def test_topup_takes_only_what_is_new(spark, sf_dir, tmp_path):
    shots, out, mark = (str(tmp_path / x) for x in ("shots", "out", "mark"))
    frames = _files(spark, sf_dir)
    for i in (2, 0):
        frames[i].coalesce(1).write.mode("append").parquet(shots)
    topup.run(spark, shots, out, mark, keep=5, files_per_batch=1)
    first = _report(spark, out)
    topup.run(spark, shots, out, mark, keep=5, files_per_batch=1)  # nothing new
    assert _report(spark, out) == first and sum(r[2] for r in first) == frames[0].count() + frames[2].count()
    before = {p: os.stat(p).st_mtime_ns for p in (str(q) for q in (tmp_path / "out" / "bins").rglob("*.parquet"))}
    for i in (3, 1):
        frames[i].coalesce(1).write.mode("append").parquet(shots)
    for f in (tmp_path / "shots").glob("*.parquet"):  # files that come late may be old
        if f.stat().st_mtime > max(os.stat(p).st_mtime for p in before):
            os.utime(f, (1_000_000_000, 1_000_000_000))
    topup.run(spark, shots, out, mark, keep=5, files_per_batch=1)
    assert all(os.stat(p).st_mtime_ns == t for p, t in before.items())  # earlier batches are not touched
    assert spark.read.schema(topup.BINS).parquet(f"{out}/bins").select("batch").distinct().count() == 4
    assert _report(spark, out) == _at_once(spark, frames, tmp_path, keep=5)
    kept = Counter((r.run, r.w) for r in spark.read.schema(topup.SPECIMENS).parquet(f"{out}/specimens").filter("batch = 0").collect())
    assert max(kept.values()) <= 5


@pytest.mark.parametrize("after", ["add_bins", "add_specimens"])
def test_topup_after_a_crash(spark, sf_dir, tmp_path, monkeypatch, after):
    """A batch dies after its bins, or after all its output but before Spark notes that it is done; it runs again."""
    shots, out, mark = (str(tmp_path / x) for x in ("shots", "out", "mark"))
    frames = _files(spark, sf_dir, 2)
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(shots)
    step, calls = getattr(topup, after), []

    def dies(*args):
        result = step(*args)
        calls.append(args)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return result

    monkeypatch.setattr(topup, after, dies)
    with pytest.raises(Exception, match="lost"):
        topup.run(spark, shots, out, mark, files_per_batch=1)
    topup.run(spark, shots, out, mark, files_per_batch=1)
    assert len(calls) == 3
    assert _report(spark, out) == _at_once(spark, frames, tmp_path)


def test_topup_of_odd_and_no_rows(spark, tmp_path):
    shots, out, mark = (str(tmp_path / x) for x in ("shots", "out", "mark"))
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string, run string, w int, batch long"
    spark.createDataFrame([], schema).write.parquet(shots)
    topup.run(spark, shots, out, mark)
    rows = [(1, 1, 1, 1, 3.0, "R", None), (1, 1, 1, 1, 3.0, "R", None), (None, None, None, None, 3.0, None, ""), (2, 1, 1, 1, None, "R", "F"), (3, 1, 1, 1, 4.0, "R", "F")]
    spark.createDataFrame([(*r, "x", 9, 9) for r in rows], schema).write.mode("append").parquet(shots)
    topup.run(spark, shots, out, mark, target=1, cap=2)
    assert [r[:6] for r in _report(spark, out)] == [("", 3, 3, 2, False, 2), ("F", 4, 1, 1, False, 1)]


def _library(docs, labels):
    fail = {}
    for i, toxic in labels:
        if i is not None and toxic is not None:
            fail[i] = max(fail.get(i, 0), toxic)
    entries = {}
    for i, text, lang, source in set(docs):
        if i in fail:
            odd = sorted(w for w, n in Counter((text or "").split()).items() if n % 2)
            entries.setdefault((lang or "", " ".join(odd)), []).append((i, source or "", fail[i]))
    return sorted((lang, len(k.split()), *min(e)[:2], len(e), sum(x[2] == 1 for x in e)) for (lang, k), e in entries.items())


def test_library_of_odd_texts(spark, tmp_path):
    docs = [(1, "a b a c", "en", "s"), (2, "c b", "en", "t"), (2, "c b", "en", "t"), (3, "c b", "de", None), (4, None, None, None), (5, " \n", "en", "s"), (6, "x x", "en", "a"), (None, "b c", "en", "s"), (7, "no label", "en", "s"), (8, "long " * 30001, "en", "s"), (8, "other text", "en", "s")]
    labels = [(1, 0), (2, 1), (2, 0), (3, 1), (4, 1), (5, 0), (6, 1), (None, 1), (7, None), (8, 1)]
    spark.createDataFrame([(*d, 1, "n", 2) for d in docs], "doc_id long, text string, lang string, source string, row int, name string, w int").write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([(i, 0, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels")
    for _ in range(2):
        text_library.run(spark, f"{tmp_path}/docs", f"{tmp_path}/labels", f"{tmp_path}/out", band=2)
        out = text_library.read_library(spark, f"{tmp_path}/out").select("lang", "w", "doc_id", "source", "t", "f").collect()
        assert sorted(map(tuple, out)) == _library(docs, labels)
    bands = {(x.lang, x.band): (x.t, x.f, x.kinds, x.split) for x in text_library.read_spectrum(spark, f"{tmp_path}/out").collect()}
    assert bands["en", 1] == (3, 2, 2, 1) and bands["", 0] == (1, 1, 1, 0)
    spark.read.parquet(f"{tmp_path}/docs").limit(0).write.parquet(f"{tmp_path}/none")
    text_library.run(spark, f"{tmp_path}/none", f"{tmp_path}/labels", f"{tmp_path}/none-out")
    assert text_library.read_library(spark, f"{tmp_path}/none-out").count() == 0


def test_settings(spark, tmp_path):
    for job, name in ((topup, "topup"), (text_library, "text_library")):
        given = common.settings(spark, f"{ROOT}/jobs/{name}.json", job.SETTINGS)
        defaults = {k: v for k, v in job.run.__kwdefaults__.items()}
        assert given == defaults  # the file that comes with a job says what the job does without one
    (tmp_path / "bad.json").write_text(json.dumps({"target": 1, "targets": 2}))
    with pytest.raises(Exception, match="targets"):
        common.settings(spark, f"file://{tmp_path}/bad.json", topup.SETTINGS)


def test_command_line(spark, sf_dir, tmp_path):
    env = os.environ | {"PYTHONPATH": ROOT, "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=4 pyspark-shell"}
    args = ["--shots", f"{sf_dir}/lineitem.parquet", "--out", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/mark", "--config", f"{ROOT}/jobs/topup.json"]
    done = subprocess.run([sys.executable, "-m", "jobs.topup", *args], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert f"batch 0: {n} shots read" in done.stderr and "report of" in done.stderr
    assert sum(r[2] for r in _report(spark, f"{tmp_path}/out")) == n


def test_supports_of_texts_are_made_without_a_shuffle_of_words(spark):
    texts = ["b a  a c\tb b", "", None, "x x", "  é Z a ", "a " * 4001 + "b " * 4000, "q"]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, toxic int")
    from hashlib import md5

    shots = text_library.shots_of(docs, labels)
    want = {0: ["b", "c"], 1: [], 2: [], 3: [], 4: ["Z", "a", "é"], 5: ["a"], 6: ["q"]}
    assert {r.doc_id: (r.w, r.name) for r in shots.collect()} == {k: (len(v), md5(" ".join(v).encode()).hexdigest()) for k, v in want.items()}
    plan = shots._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "text" not in shots.columns
