"""Exact, near, line and passage deduplication against brute force."""

from __future__ import annotations

import collections
import hashlib
import random

from pyspark.sql import functions as F

from raretide.llm import minhash
from raretide.llm.components import connected_components
from raretide.llm.exact_dedup import exact_dedup
from raretide.llm.line_dedup import dedup_lines, without_repeated_lines
from raretide.llm.minhash import near_duplicates, without_near_duplicates
from raretide.llm.substring import drop_repeated_passages, repeated_passages
from raretide.llm.workspace import Workspace
from tests.llm.conftest import table, words


def test_exact_over_several_micro_batches(spark, tmp_path):
    r = random.Random(1)
    texts = [None, "", "a", "b", "c" * 5000]
    rows = [(i, r.choice(texts), "en", "s") for i in range(200)] + [(7, "a", "en", "s"), (7, "a", "en", "s"), (None, "b", "en", "s")]
    path = str(tmp_path / "docs")
    table(spark, rows).repartition(6).write.parquet(path)
    out = exact_dedup(spark, f"file://{path}", trigger={"maxFilesPerTrigger": "2"}).collect()
    assert len(out) == len(rows)
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    for x in out:
        g = groups[x.text_sha256]
        assert x.group_size == len(g) and x.keep_id == max(i for i in g if i is not None)
    assert collections.Counter(x.text_sha256 for x in out if x.kept) == collections.Counter(list(groups))


def test_exact_single_file_and_empty(spark, tmp_path, sf_dir):
    out = exact_dedup(spark, f"{sf_dir}/documents.parquet")
    assert out.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    path = str(tmp_path / "none")
    table(spark, []).write.parquet(path)
    assert exact_dedup(spark, f"file://{path}").count() == 0


def test_exact_state_meets_later_files(spark, tmp_path):
    """A second call over the grown table: old files are not read by the stream again, their state counts."""
    path, state = str(tmp_path / "docs"), f"file://{tmp_path}/state"
    table(spark, [(i, f"text {i % 5}", "en", "s") for i in range(20)]).coalesce(1).write.parquet(path)
    first = exact_dedup(spark, f"file://{path}", state=state).collect()
    assert {(x.keep_id, x.group_size) for x in first} == {(15 + k, 4) for k in range(5)}
    table(spark, [(100, "text 0", "en", "s"), (2, "text 1", "en", "s"), (101, "new", "en", "s")]).coalesce(1).write.mode("append").parquet(path)
    again = {x.text_sha256: x for x in exact_dedup(spark, f"file://{path}", state=state).collect() if x.kept}
    of = lambda t: again[hashlib.sha256(t.encode()).hexdigest()]
    assert (of("text 0").keep_id, of("text 0").group_size) == (100, 5) and (of("text 1").keep_id, of("text 1").group_size) == (16, 5) and of("new").group_size == 1
    assert len(again) == 6 and sorted(x.name for x in (tmp_path / "state" / "updates").iterdir()) == ["batch=0", "batch=1"]


def test_exact_tells_bytes_apart_under_one_digest(spark, tmp_path, odd_rows):
    path = str(tmp_path / "docs")
    rows = odd_rows + [(50 + i, ("many words " * 30000) + str(i % 3), "en", "s") for i in range(9)]
    table(spark, rows).write.parquet(path)
    groups = collections.Counter(t or "" for _, t, *_ in rows)
    for digest in (lambda body: F.substring(F.sha2(body, 256), 1, 1), lambda body: F.lit("one"), None):
        out = exact_dedup(spark, f"file://{path}", **({"digest": digest} if digest else {})).collect()
        assert len(out) == len(rows) and sum(x.kept for x in out) == len(groups)
        assert sorted(x.group_size for x in out) == sorted(groups[t or ""] for _, t, *_ in rows)


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(260)] + [(0, i) for i in range(500, 600)] + [(i, i + 1) for i in range(700, 760)] + [(None, 1), (5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    want = {x: find(x) for a, b in links if a is not None and a != b for x in (a, b)}
    with Workspace(spark, "t") as work:
        got = {x.node: x.component for x in connected_components(spark.createDataFrame(links, "a long, b long"), work).collect()}
        assert got == want
        assert connected_components(spark.createDataFrame([], "a long, b long"), work).count() == 0


def _near_brute(rows):
    sets = collections.defaultdict(list)
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i].append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a is not None and b is not None and a < b and any(100 * len(x & y) >= 75 * len(x | y) > 0 for x in sets[a] for y in sets[b]):
                old, new = sorted((label[a], label[b]), reverse=True)
                label = {k: new if v == old else v for k, v in label.items()}
    return label


def test_near_duplicates(spark, odd, odd_rows, nothing):
    want = _near_brute(odd_rows)
    out = near_duplicates(odd).collect()
    assert len(out) == len(odd_rows)
    for x in out:
        assert x.component_id == (None if x.doc_id is None else want[x.doc_id])
        assert x.kept == (x.doc_id == x.component_id)
    assert near_duplicates(nothing).count() == 0
    kept = without_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == sorted(i for i, *_ in odd_rows if i is not None and want[i] == i)


def _template_group(n):
    """Copies of one text, each with three words replaced by one common word: no shingle is anyone's own."""
    r = random.Random(11)
    base = words(r, 150, 100000)
    rows = []
    for i in range(n):
        w = list(base)
        for k in r.sample(range(150), 3):
            w[k] = "common"
        rows.append((i, " ".join(w), "en", "s"))
    return rows


def test_a_template_group_that_stars_have_joined_makes_no_pairs(spark, monkeypatch):
    made = []

    def counting(name, sides):
        step = getattr(minhash, name)

        def run(rare, *args):
            made.append(rare.groupBy("item").agg(F.count_if(F.col("label") != F.col("main")).alias("x"), F.count(F.lit(1)).alias("y")).agg(F.coalesce(F.sum(F.expr(sides)), F.lit(0))).first()[0])
            return step(rare, *args)

        monkeypatch.setattr(minhash, name, run)

    counting("_by_rare_items", "x * y")
    total = {}
    for n in (300, 600, 1200):
        made.clear()
        rows = _template_group(n)
        out = {x.doc_id: x.component_id for x in near_duplicates(table(spark, rows)).collect()}
        total[n] = sum(made)
        if n == 300:
            want = _near_brute(rows)
            assert out == want
        assert len(set(out.values())) < n / 20  # nearly one component
    assert total[1200] <= 4.8 * total[300] + 1000


def test_near_duplicates_of_a_large_group_of_reworked_copies(spark):
    """A third of the rows are copies of one text with few to many changes: stars alone would miss links."""
    r = random.Random(3)
    base = words(r, 150, 100000)
    rows = []
    for i in range(450):
        if i % 3:
            rows.append((i, " ".join(words(r, 60, 100000)), "en", "s"))
        else:
            w = list(base)
            for _ in range(r.randrange(0, 14)):
                w[r.randrange(len(w))] = f"c{r.randrange(40)}"
            rows.append((i, " ".join(w), "en", "s"))
    want = _near_brute(rows)
    assert {x.doc_id: x.component_id for x in near_duplicates(table(spark, rows)).collect()} == want


def _lines_brute(rows, run=3):
    seen, out = {}, {}
    keyed = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        full = [(k, s.strip(" \t\r\x0b\f")) for k, s in enumerate(lines) if s.strip(" \t\r\x0b\f")]
        for p in range(len(full) - run + 1) if i is not None else ():
            key = tuple(s for _, s in full[p : p + run])
            keyed.append((i, t, full[p][0], full[p + run - 1][0], key))
            seen[key] = min(seen.get(key, (i, full[p][0])), (i, full[p][0]))
        out[i, t] = (lines, set())
    for i, t, first, last, key in keyed:
        if seen[key] < (i, first):
            out[i, t][1].update(range(first, last + 1))
    return {k: (len(lines), len(gone), None if k[1] is None else "\n".join(s for j, s in enumerate(lines) if j not in gone)) for k, (lines, gone) in out.items()}


def test_lines(spark, odd, odd_rows, nothing):
    r = random.Random(4)
    rows = odd_rows + [(100 + i, "\n".join(r.choice(["", " ", "a", "b", "c", "d ", "\te"]) for _ in range(r.randrange(30))), "en", "s") for i in range(60)]
    want = _lines_brute(rows)
    out = dedup_lines(table(spark, rows)).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((x.doc_id, x.n_lines, x.n_removed, x.text) for x in out), key=key) == sorted(((i, *want[i, t]) for i, t, *_ in rows), key=key)
    assert dedup_lines(nothing).count() == 0
    whole = without_repeated_lines(odd, length_col="n_chars")
    assert whole.schema.simpleString() == odd.schema.simpleString() and whole.count() == odd.count()
    assert all(x.n_chars == len(x.text) for x in whole.collect() if x.text is not None)


def _passages_brute(rows, n):
    first = {}
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - n + 1) if i is not None else ():
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        gone = {j for k in range(len(w) - n + 1) if i is not None and first[tuple(w[k : k + n])] < i for j in range(k, k + n)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), kept.decode(), hashlib.sha256(kept).hexdigest()))
    return out


def test_passages(spark, odd_rows, nothing):
    r = random.Random(6)
    passages = [words(r, r.randrange(40, 200)) for _ in range(6)]
    rows = list(odd_rows)
    for i in range(80):  # every third document holds the same passage, at any place and cut anywhere
        parts = [words(r, r.randrange(60))]
        for p in r.sample(passages, 2) + ([passages[0]] if i % 3 == 0 else []):
            a = r.randrange(len(p) // 2)
            parts += [p[a : a + r.randrange(len(p))], words(r, r.randrange(20), 3)]
        rows.append((200 + i, " ".join(sum(parts, [])), "en", "s"))
    rows.append((300, "same " * 150, "en", "s"))
    rows.append((301, "same " * 90, "en", "s"))
    out = drop_repeated_passages(table(spark, rows)).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted((tuple(x) for x in out), key=key) == sorted(_passages_brute(rows, 50), key=key)
    assert drop_repeated_passages(nothing).count() == 0
    with Workspace(spark, "t") as work:
        runs = repeated_passages(table(spark, rows), work).filter("source_id IS NOT NULL").collect()
    assert runs and all(x.source_id < x.doc_id and x.end - x.start >= 50 for x in runs)


def thue_morse(n: int) -> tuple[str, str]:
    """A word of 2**n letters and its complement: equal under any polynomial modulo a power of two from some n on."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_unequal_words_are_never_equal(spark):
    """Words without arithmetic likeness and with it, in documents that differ in nothing else."""
    r = random.Random(8)
    rows = []
    for n in (3, 6, 10, 12):
        for k, word in enumerate(thue_morse(n)):
            rows.append((100 * n + k, " ".join([word] * 60), "en", "s"))
            rows.append((100 * n + 10 + k, " ".join(words(random.Random(n), 40) + [word] + words(random.Random(n + 1), 40)), "en", "s"))
    a, b = (" ".join(r.choice(("x", "y")) for _ in range(2000)) for _ in "ab")
    letters, other = thue_morse(10)
    rows += [(7, a, "en", "s"), (8, b, "en", "s"), (9, " ".join(letters), "en", "s"), (10, " ".join(other), "en", "s")]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted((tuple(x) for x in drop_repeated_passages(table(spark, rows)).collect()), key=key) == sorted(_passages_brute(rows, 50), key=key)
    assert {x.doc_id: x.component_id for x in near_duplicates(table(spark, rows)).collect()} == _near_brute(rows)


def test_near_duplicates_of_chains_and_repeated_identifiers(spark):
    """Copies of copies, each reworked a little more, of several sizes; links that no bucket's centre has a part in."""
    r = random.Random(9)
    rows = []
    for chain in range(12):
        w = words(r, 40 + 15 * chain, 100000)
        for k in range(14):
            rows.append((1000 * chain + r.randrange(1000), " ".join(w), "en", "s"))
            for _ in range(1 + chain // 4):
                w[r.randrange(len(w))] = f"c{r.randrange(30)}"
            if k % 5 == 4:
                w = w[: -len(w) // 12]
    rows += [(5, rows[20][1], "en", "s"), (5, rows[90][1] + " and some more", "en", "s")]
    want = _near_brute(rows)
    assert {x.doc_id: x.component_id for x in near_duplicates(table(spark, rows)).collect()} == want
