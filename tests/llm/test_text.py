"""Classifiers, license scans, language, packing, decontamination and the pipeline on small tables."""

from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from raretide.llm import decontam, entries, labelled, licenses, packing
from raretide.llm.langid import identify, identify_pages, without_unknown_languages
from raretide.llm.quality import grade_quality
from raretide.llm.toxicity import score_toxicity
from raretide.llm.workspace import Workspace
from tests.llm.conftest import table, words

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity_learns_words_it_is_shown(spark):
    r = random.Random(1)
    bad = ["vilest", "vilen", "grubby", "grubbish"]
    rows, labels = [], []
    for i in range(600):
        w = words(r, r.randrange(5, 60))
        toxic = i % 4 == 0
        if toxic:
            w[r.randrange(len(w))] = r.choice(bad)
        rows.append((i, " ".join(w), "en" if i % 2 else "fr", "s"))
        labels.append((i, int(toxic)))
    out = score_toxicity(table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    assert {x.doc_id: x.held_out for x in out} == {i: _held_out(i) for i in truth}
    held = [x for x in out if x.held_out]
    assert sum(x.predicted == truth[x.doc_id] for x in held) >= 0.97 * len(held)
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in out)


def test_the_sample_is_bounded(spark):
    """A labelled identifier in a third of all rows, a very long text, a null one."""
    rows = [(i, f"text {i}", "en", "s") for i in range(1, 41)] + [(2, f"copy {i} of it", "en", "s") for i in range(2000)] + [(3, "x" * 40000, "en", "s"), (41, None, "en", "s"), (42, "y" * 40000, "en", "s")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 43)], "doc_id long, y int")
    out = labelled.sample(table(spark, rows), labels, F.col("y"), 100, 2)
    assert [(x.doc_id, x.y, x.text) for x in out] == [(i, i % 2, None if i == 41 else "copy 0 of it" if i == 2 else f"text {i}") for i in range(1, 42) if not _held_out(i)]
    assert 4 <= len(labelled.sample(table(spark, rows), labels, F.col("y"), 3, 2)) <= 6  # a picked document may be a long one


@pytest.mark.parametrize("operator", [score_toxicity, grade_quality])
def test_classifiers_on_odd_tables(spark, odd, odd_rows, nothing, labels, operator):
    out = operator(odd, labels).collect()
    assert len(out) == len(odd_rows) and all(x.held_out == _held_out(x.doc_id) for x in out)
    assert operator(nothing, labels).count() == 0
    none = spark.createDataFrame([], labels.schema)
    assert operator(odd, none).count() == len(odd_rows)
    if operator is score_toxicity:
        assert {x.predicted for x in operator(odd, none).collect()} == {0}
        # neither language, source, length column nor identifier enters a score
        score = F.round("score", 9).alias("score")
        known = score_toxicity(odd.filter("doc_id IS NOT NULL"), labels).select(score).collect()
        masked = odd.filter("doc_id IS NOT NULL").withColumns({"lang": F.lit("xx"), "source": F.lit("y"), "n_chars": F.lit(1).cast("long")})
        assert sorted(score_toxicity(masked, labels).select(score).collect()) == sorted(known)
        texts = spark.createDataFrame([(i, "the same text of some words") for i in (1, 5, 77, 10**12)], "doc_id long, text string")
        assert len({x.score for x in score_toxicity(odd.unionByName(texts, allowMissingColumns=True), labels).filter(F.col("doc_id").isin(77, 10**12)).collect()}) == 1


def test_quality_orders_grades(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(500):
        grade = i % 3
        w = words(r, 40)
        junk = [f"{x}###" if r.random() < (0.9, 0.4, 0.0)[grade] else x for x in w]
        rows.append((i, " ".join(junk), "en", "s"))
        labels.append((i, grade))
    out = grade_quality(table(spark, rows), spark.createDataFrame(labels, "doc_id long, g int"), grade="g", wanted=2).collect()
    truth = dict(labels)
    held = [x for x in out if x.held_out]
    assert np.mean([abs(x.expected_grade - truth[x.doc_id]) < 0.5 for x in held]) > 0.95
    assert all(list(x.tails) == sorted(x.tails, reverse=True) and abs(sum(x.tails) - x.expected_grade) < 1e-9 for x in out)
    assert np.mean([x.kept == (truth[x.doc_id] == 2) for x in held]) > 0.95


def _scan(text):
    """Brute force: all matches of all rules, then suppression by comparing every pair."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    spaced = "".join(f" {x} " for x in w)
    found = []
    for rule, label, keyword, pattern, priority, weight, base in licenses.rules():
        if keyword in spaced:
            for m in re.finditer(pattern, spaced):
                found.append((spaced[: m.start()].count(" ") // 2, spaced[: m.end()].count(" ") // 2, priority, rule, label, weight, base))
    kept = [d for d in found if not any(e[0] <= d[0] and e[1] >= d[1] and e[2] <= d[2] and ((e[0], e[1]) != (d[0], d[1]) or (e[2], e[3]) < (d[2], d[3])) for e in found if e is not d)]
    base = [d for d in found if d[6]]
    places = [d[0] for d in base]
    return len(w), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({d[4] for d in base})), ",".join(sorted({d[4] for d in base + kept})), max((d[5] for d in kept), default=0.0)


def test_licenses(spark, odd, odd_rows, nothing):
    r = random.Random(3)
    phrases = [
        "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "MIT license mit LICENSE", "GNU General Public License, version 3", "the general public license",
        "SPDX-License-Identifier: BSD-3-Clause", "https://www.apache.org/licenses/LICENSE-2.0", "CC BY-NC 4.0", "All rights reserved.", "Creative Commons Attribution-ShareAlike 4.0", "unlimited license", "GPL v3", "Mozilla Public License 2.0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy", "placed in the public domain", "Copyright (c) 2021", "apache", "license",
    ]
    rows = list(odd_rows) + [(400 + i, " ".join(r.choice([*phrases, *words(r, 3)]) for _ in range(r.randrange(1, 25))), "en", "s") for i in range(60)]
    rows += [(500, "MIT License " * 3000, "en", "s")]
    out = licenses.scan_licenses(table(spark, rows)).collect()
    want = {(i, t): _scan(t) for i, t, *_ in rows if i != 500}
    assert len(out) == len({(i, t) for i, t, *_ in rows})
    key = lambda x: tuple((v is None, v) for v in x)
    got = sorted(((x.doc_id, x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels, x.labels, x.score) for x in out if x.doc_id != 500), key=key)
    assert got == sorted(((i, *v) for (i, _), v in want.items()), key=key)
    many = next(x for x in out if x.doc_id == 500)
    assert (many.n_words, many.n_base, many.first_word, many.last_word) == (6000, 3000, 0, 5998)
    assert licenses.scan_licenses(nothing).count() == 0
    assert len(licenses.rules()) >= 300


#: Notices as they stand in real files, with the labels that a reader would give them (others may be found as well).
NOTICES = (
    ("Licensed under the MIT License.", "mit"), ("Distributed under the Expat License", "mit"), ("XFree86 License", "x11"), ("PNG Reference Library License version 2", "libpng-2.0"),
    ("Apache License v2.0", "apache-2.0"), ("Apache License, Version 2.0", "apache-2.0"), ("Apache 2.0", "apache-2.0"), ("Apache-2.0", "apache-2.0"), ("ASL 2.0", "apache-2.0"), ("Apache Software License 1.1", "apache-1.1"),
    ("GNU General Public License v3.0", "gpl-3.0"), ("GNU General Public License, version 2", "gpl-2.0"), ("GPLv3", "gpl-3.0"), ("GPL v2", "gpl-2.0"), ("GPL-3.0-or-later", "gpl-3.0"), ("GPL2", "gpl-2.0"), ("GNU GPL version 3", "gpl-3.0"),
    ("GNU LGPL version 2.1", "lgpl-2.1"), ("LGPLv3", "lgpl-3.0"), ("GNU Lesser General Public License v2.1", "lgpl-2.1"), ("AGPLv3", "agpl-3.0"), ("GNU Affero General Public License v3.0", "agpl-3.0"),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option)", "gpl-2.0"),
    ("BSD 3-Clause License", "bsd-3-clause"), ("BSD-2-Clause", "bsd-2-clause"), ("the New BSD license", "bsd-3-clause"), ("Simplified BSD License", "bsd-2-clause"), ("BSD-style license", "bsd"), ("0-clause BSD License", "0bsd"),
    ("Mozilla Public License v2.0", "mpl-2.0"), ("MPL 2.0", "mpl-2.0"), ("MPLv2", "mpl-2.0"), ("Mozilla Public License Version 1.1", "mpl-1.1"), ("Eclipse Public License - v 1.0", "epl-1.0"), ("EPL-2.0", "epl-2.0"),
    ("SPDX-License-Identifier: (MIT OR Apache-2.0)", "mit"), ("SPDX-License-Identifier: (Apache-2.0 OR MIT)", "mit"), ("SPDX-License-Identifier: MIT OR Apache-2.0", "apache-2.0"), ("SPDX-License-Identifier: ISC", "isc"), ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 OR MIT", "mit"),
    ("COMMON DEVELOPMENT AND DISTRIBUTION LICENSE Version 1.0", "cddl-1.0"), ("European Union Public Licence v1.2", "eupl-1.2"), ("Boost Software License - Version 1.0", "bsl-1.0"), ("Zlib License", "zlib"), ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("CC BY-SA 4.0", "cc-by-sa-4.0"), ("https://creativecommons.org/licenses/by/4.0/", "cc-by-4.0"), ("Creative Commons Attribution-NonCommercial 4.0", "cc-by-nc-4.0"), ("CC0 1.0 Universal", "cc0-1.0"), ("Creative Commons Zero v1.0", "cc0-1.0"),
    ("Python Software Foundation License", "python-2.0"), ("PostgreSQL License", "postgresql"), ("SIL Open Font License 1.1", "ofl-1.1"), ("Business Source License 1.1", "bsl-1.1"), ("Server Side Public License, v 1", "sspl-1.0"), ("Elastic License 2.0", "elastic-2.0"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"), ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
    ("Neither the name of X nor its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-3-clause"),
    ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", "wtfpl"), ("The Software shall be used for Good, not Evil.", "jsonlicense"), ("same terms as Perl itself", "perl"), ("All rights reserved.", "all-rights-reserved"), ("for non-commercial use only", "non-commercial"),
    ("https://www.apache.org/licenses/LICENSE-2.0", "apache-2.0"), ("https://www.gnu.org/licenses/gpl-3.0.html", "gpl-3.0"), ("http://mozilla.org/MPL/2.0/", "mpl-2.0"), ("dedicated to the public domain", "public-domain"), ("Open Database License v1.0", "odbl-1.0"),
)


def test_license_notices(spark):
    rows = [(k, f"Some file. {text} Then more of it.", "en", "s") for k, (text, _) in enumerate(NOTICES)]
    rows += [(1000 + k, t, "en", "s") for k, t in enumerate(("A permit was granted by the city.", "The license plate of the car", "an open public meeting on common ground", "version 2 of the plan", "the apache people"))]
    got = {x.doc_id: set(x.labels.split(",")) for x in licenses.scan_licenses(table(spark, rows)).collect()}
    assert not [(text, label, got[k]) for k, (text, label) in enumerate(NOTICES) if label not in got[k]]
    assert all(got[k] == {""} for k in got if k >= 1000)


def test_license_gates():
    """Every match of a rule contains its keyword: it stands as a word of its own that nothing makes optional."""
    for _, label, keyword, pattern, *_ in licenses.rules():
        assert keyword in re.findall(r"\(\?:(?:[^()]|\([^()]*\))*\)\??| [^ ()]+ ", pattern), (label, keyword)


def test_language(spark, odd, odd_rows, nothing, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, declared=F.col("lang"), host=F.col("source")).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id").collect()
    assert len(out) == docs.count() and np.mean([x.lang == x.truth for x in out]) > 0.98
    # a wrong tag does not outweigh a clear text
    wrong = docs.withColumn("lang", F.when(F.col("doc_id") % 10 == 3, "fr").otherwise(F.col("lang")))
    again = identify(wrong, declared=F.col("lang")).join(docs.select("doc_id", F.col("lang").alias("truth"), F.length("text").alias("size")), "doc_id").filter("size > 300").collect()
    assert np.mean([x.text_lang == x.truth for x in again]) > 0.98
    found = identify(odd, declared=F.col("lang"), host=F.col("source")).collect()
    assert len(found) == len(odd_rows)
    empty = {5, 6, 7}
    assert all(not x.kept for x in found if x.doc_id in empty)
    kept = without_unknown_languages(odd, declared=F.col("lang"), host=F.col("source"))
    assert kept.columns == odd.columns and kept.filter(F.col("doc_id").isin(*empty)).count() == 0
    assert identify(nothing, declared=F.col("lang")).count() == 0
    untagged = identify(odd).collect()
    assert len(untagged) == len(odd_rows) and not any(x.kept for x in untagged)
    pages = identify_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()
    assert np.mean([x.lang == x.declared for x in pages]) > 0.95


def test_language_rejects_what_no_language_explains(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    junk = [(-1, "xqzvk jwqxz kkzvq wxjqz vvkxq zzqjx", "en", "a"), (-2, "Привет как дела сегодня", "en", "a"), (-3, "Kesällä aurinko paistaa yötä päivää, mutta talvella järvet jäätyvät ja lumi peittää metsän", "en", "a")]
    clean = [(-4, "the data of the", "en", "a"), (-5, "the and of in", None, None), (-6, "The erin a password=32bb02aa3b580bf8ab thes as.", "en", "a")]
    out = identify(docs.unionByName(spark.createDataFrame(junk + clean, docs.schema)), declared=F.col("lang"), host=F.col("source"))
    assert {x.doc_id for x in out.filter("doc_id < 0 AND kept").collect()} == {x[0] for x in clean}
    assert out.filter("doc_id >= 0 AND NOT kept AND n_grams > 20").count() == 0
    # a language of one text does not take in what the others reject
    rare = [(-7, "人工智能的发展非常迅速", "zh", None)]
    out = identify(docs.unionByName(spark.createDataFrame(junk + clean + rare, docs.schema)), declared=F.col("lang"), host=F.col("source"))
    assert {x.doc_id for x in out.filter("doc_id < 0 AND kept").collect()} == {x[0] for x in clean + rare}


def test_rare_tags_are_evidence_without_being_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.col("lang").alias("tag"))
    docs = docs.withColumn("tag", F.when((F.col("tag") == "de") & (F.col("doc_id") % 8 == 0), "gsw").otherwise(F.col("tag")))
    out = identify(docs, declared=F.col("tag"), languages=4).filter("declared = 'gsw'").collect()
    assert out and {x.lang for x in out} == {"de"}


def _tokens(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_encoder_equals_the_tokenizer():
    r = random.Random(4)
    tokenizer = Tokenizer.from_file(TOKENIZER)
    bits = ["word", "Word.", "don't", "it's", "a'b'c", "naïve", "été", "ÅNGSTRÖM,", "12ab34", "<|endoftext|>", "x<|endoftext|>y", "--", "漢字。", "ΑΣ", "İstanbul", " nbsp", "a b", "#tag!!", "''", "'S", "ab's", "🙂🙂", "é", "ﬁ", "́x", "ab.'s"]
    texts = [" ".join(r.choice(bits) for _ in range(r.randrange(30))) for _ in range(300)] + [None, "", " \t\n", "".join(bits)]
    encode = packing.Encoder(TOKENIZER)
    for some in (texts, texts[:20], ["q" * 70 + str(i) + "z" * 3 for i in range(40000)], [], [None], ["A" * 5000 + "!" * 300]):
        ids, ends = encode(pa.array(some, pa.string()))
        for t, i, j in zip(some, [0, *ends], ends, strict=False):
            assert ids[i:j].tolist() == _tokens(tokenizer, t)[:-1].tolist(), t


def _check_packing(rows, out, length=2048):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = collections.Counter((i, s, _tokens(tokenizer, t).tobytes()) for i, t, _, s in rows)
    sequences = collections.defaultdict(list)
    for x in out:
        assert x.length * 4 == len(x.ids) and x.length > 0
        sequences[x.sequence_id].append((x.offset, x.length))
    for q, pieces in sequences.items():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == length or q == max(sequences)
    assert sorted(sequences) == list(range(len(sequences)))
    unique = {k for k, n in want.items() if n == 1 and sum(i == k[0] for i, *_ in rows) == 1}
    for i, s, ids in unique:
        own = sorted(((x.start, bytes(x.ids)) for x in out if (x.doc_id, x.source) == (i, s)))
        assert b"".join(b for _, b in own) == ids
    assert sum(x.length for x in out) == sum(len(k[2]) // 4 * n for k, n in want.items())


def test_packing(spark, odd, odd_rows, nothing):
    out = packing.pack(odd, TOKENIZER).collect()
    _check_packing(odd_rows, out)
    assert packing.pack(nothing, TOKENIZER).count() == 0


def test_packing_keeps_to_the_mixture(spark):
    r = random.Random(5)
    rows = [(i, " ".join(words(r, r.randrange(1, 400))), "en", "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(900)]
    docs = table(spark, rows).repartition(5)
    out = packing.pack(docs, TOKENIZER, length=1024, quantum=128).collect()
    _check_packing(rows, out, 1024)
    total = collections.Counter()
    for x in out:
        total[x.source] += x.length
    whole = sum(total.values())
    seen, upto = collections.Counter(), 0
    for q in range(max(x.sequence_id for x in out) + 1):
        for x in out:
            if x.sequence_id == q:
                seen[x.source] += x.length
                upto += x.length
        for s in total:  # the deficit of no source grows from window to window
            assert abs(seen[s] - upto * total[s] / whole) <= 3 * 128 + 1024 * total[s] / whole
    shares = spark.createDataFrame([("hot", 1.0), ("s1", 1.0)], "source string, share double")
    even = packing.pack(docs, TOKENIZER, length=1024, quantum=128, shares=shares).collect()
    _check_packing(rows, even, 1024)
    early = collections.Counter()
    for x in even:
        if x.sequence_id < 10:
            early[x.source] += x.length
    assert set(early) == {"hot", "s1"} and abs(early["hot"] - early["s1"]) <= 3 * 128


def test_every_tag_is_a_language(spark):
    """300 tags, more than any list of usual languages; each has one text without its tag."""
    tags = [f"{a}{b}{c}" for a in "abcdefg" for b in "abcdefg" for c in "abcdefgh"][:300]
    rows = []
    for k, tag in enumerate(tags):
        r = random.Random(k)
        own = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)]
        rows += [(k * 8 + j, " ".join(r.choice(own) for _ in range(40)), tag if j else None, "h") for j in range(8)]
    out = identify(table(spark, rows), declared=F.col("lang"), host=F.col("source")).collect()
    assert len(out) == len(rows) and sum(x.lang == tags[x.doc_id // 8] for x in out) >= 0.99 * len(rows)
    few = identify(table(spark, rows[:80]), declared=F.col("lang"), languages=4).collect()
    assert len({x.lang for x in few}) == 4


def test_languages_of_equal_evidence(spark):
    """Two tags on the same texts: the alphabetically first one wins where nothing tells them apart."""
    rows = [(i, f"the same words here {i // 2}", ("xa", "xb")[i % 2], None) for i in range(40)] + [(100, "the same words here", None, None)]
    out = {x.doc_id: x for x in identify(table(spark, rows), declared=F.col("lang")).collect()}
    assert out[100].lang == out[100].text_lang == "xa" and abs(out[100].confidence - 0.5) < 1e-6


def test_decontamination(spark, odd, odd_rows, nothing):
    r = random.Random(6)
    items = [(k, " ".join(words(r, r.randrange(15, 60), 3000))) for k in range(40)]
    items += [(90, None), (91, ""), (None, "no identifier"), (92, " ".join(words(r, 200, 3000)))]
    rows, leaks = list(odd_rows), set()
    for i in range(250):
        w = words(r, r.randrange(30, 400), 3000)
        if i % 5 == 0:
            k, text = items[i // 5 % 40]
            copy = text.split()
            if i % 10 == 0:  # a reworded copy: every eighth word is another one
                copy = [f"w{r.randrange(3000)}" if j % 8 == 3 else x for j, x in enumerate(copy)]
            at = r.randrange(len(w))
            w[at:at] = [x.upper() + r.choice(["", ",", "."]) for x in copy]
            leaks.add((600 + i, k))
        rows.append((600 + i, " ".join(w), "en", "s"))
    rows.append((900, " ".join(words(r, 50, 3000)) + " " + items[-1][1], "en", "s"))
    docs, benchmark = table(spark, rows), spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, body int")
    out = decontam.decontaminate(docs, benchmark).collect()
    assert len(out) == len(rows)
    found = {(x.doc_id, x.item_id) for x in out if not x.kept}
    assert found == leaks | {(900, 92)}
    assert {(x.doc_id, x.item_id) for x in decontam.decontaminate(docs, benchmark, block=7).collect() if not x.kept} == found
    kept = decontam.without_leaks(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == len(rows) - len(found)
    assert decontam.decontaminate(nothing, benchmark).count() == 0
    assert decontam.decontaminate(odd, benchmark.limit(0)).filter("NOT kept").count() == 0


def _subsequence(a, b):
    """Length of the longest common subsequence, row by row."""
    row = [0] * (len(b) + 1)
    for x in a:
        above, row = row, [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
    return row[-1]


def test_items_without_an_integer_identifier_are_searched(spark):
    r = random.Random(31)
    texts = [" ".join(words(r, 40, 9000)) for _ in range(4)]
    benchmark = spark.createDataFrame([("7", texts[0]), ("q-8", texts[1]), (None, texts[2]), ("9", None)], "item_id string, text string")
    docs = table(spark, [(i, " ".join(words(r, 60, 9000)) + " " + x, "en", "a") for i, x in enumerate(texts)])
    found = {x.doc_id: x for x in decontam.decontaminate(docs, benchmark).collect()}
    assert [found[i].kept for i in range(4)] == [False, False, False, True]
    assert found[0].item_id == 7 and found[1].item_id < 0 and found[2].item_id < 0 and found[1].item_id != found[2].item_id
    assert {x.doc_id for x in decontam.without_leaks(docs, benchmark).collect()} == {3}


def test_decontamination_finds_what_brute_force_finds(spark):
    """Copies with 20 to 40 % of their words replaced, or with words put in between; a few words make up most of the text."""
    r = random.Random(16)
    text = lambda n: [f"w{int(3000 ** r.random())}" for _ in range(n)]
    items = [text(r.randrange(25, 60)) for _ in range(40)]
    rows, leaks, planted = [], set(), set()
    for i in range(240):
        w, k = text(r.randrange(30, 200)), i % 40
        share = r.uniform(0.2, 0.4)
        if i % 3:
            copy = [f"w{r.randrange(3000)}" if r.random() < share else x for x in items[k]]
        else:
            copy = [y for x in items[k] for y in ([x, f"w{r.randrange(3000)}"] if r.random() < 2 * share else [x])]
        tail = items[k][-max(3, len(items[k]) // 4) :]
        planted.add((i, k))
        if _subsequence(items[k], copy) >= 0.6 * len(items[k]) and _subsequence(tail, copy) >= 0.5 * len(tail):
            leaks.add((i, k))
        at = r.randrange(len(w))
        w[at:at] = copy
        rows.append((i, " ".join(w), "en", "s"))
    rows += [(1000 + i, " ".join(text(150)), "en", "s") for i in range(60)]
    docs = table(spark, rows)
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in decontam.decontaminate(docs, benchmark).collect() if not x.kept}
    assert len(leaks) > 120 and leaks <= found <= planted


def _all_windows(texts, items, latent, cosine):
    """Leaks by a scan of every item against every window of every text: cosines as sums of rows, subsequences by a table."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    term = lambda w: int(decontam._words(pa.array([w]))[2][0])
    terms = {w: term(w) for t in (*texts, *items) for w in split(t)}
    unit = lambda ws: (v := sum(latent.table[terms[w]].astype(float) for w in ws)) / max(np.linalg.norm(v), 1e-12)
    found = {}
    for k, item in enumerate(map(split, items)):
        m, mine = len(item), unit(item)
        size = min(decontam.SCALES, key=lambda s: abs(np.log(s / m)))
        for d, text in enumerate(map(split, texts)):
            for at in range(0, len(text), decontam.STRIDES[size] * decontam.BLOCK):
                near = float(unit(text[at : at + size]) @ mine)
                most = int(np.ceil(0.6 * m - 1e-9))
                need = min(most, max(10, int(np.ceil(0.45 * m - 1e-9)))) if near >= cosine else most
                stretch = text[max(0, at - m // 2) : at + max(size, m) + m // 2]
                if len(set(item) & set(stretch)) - len(set(item)) + m < need or _subsequence(item, stretch) < need:
                    continue
                tail = item[-max(3, m // 4) :]
                if _subsequence(tail, stretch) >= 0.5 * len(tail):
                    found[d, k] = max(found.get((d, k), 0.0), _subsequence(item, stretch) / m)
    return found


def test_reworded_items_come_through_the_latent_space(spark, monkeypatch):
    """Half of an item's words give way to others of its subject: too few are left in order for the plain share."""
    r = random.Random(23)
    subject = lambda s, n: [f"s{s}x{int(90 ** r.random())}" if r.random() < 0.75 else f"w{int(200 ** r.random())}" for _ in range(n)]
    items = [subject(k % 12, 40) for k in range(24)]
    rows, reworded = [], set()
    for i in range(200):
        k = i % 24
        w = subject(k % 12, r.randrange(40, 120))
        if i < 96:
            at = r.randrange(len(w))
            kept = set(range(0, 40, 2))
            w[at:at] = [x if j in kept else subject(k % 12, 1)[0] for j, x in enumerate(items[k])]
            reworded.add((i, k))
        rows.append((i, " ".join(w), "en", "s"))
    docs = table(spark, rows)
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")

    def leaks(**how):
        with Workspace(spark, "test") as work:
            return {(x.doc_id, x.item_id): x.overlap for x in decontam.leaked_items(docs, benchmark, work, rank=16, **how).collect()}

    with Workspace(spark, "test") as work:
        latent = decontam.Latent.fit(decontam._source(docs, "doc_id", "text"), 64, 16, 0.01, 9, work)
    found = leaks()
    expected = _all_windows([t for _, t, _, _ in rows], [" ".join(w) for w in items], latent, 0.5)
    assert found.keys() == expected.keys() and all(abs(found[k] - v) < 1e-9 for k, v in expected.items())
    assert len(found.keys() & reworded) >= 0.9 * len(reworded)
    plain = leaks(cosine=2.0)
    assert plain.keys() < found.keys() and len(plain.keys() & reworded) <= 0.5 * len(reworded)
    fit = decontam.Latent.fit
    monkeypatch.setattr(decontam.Latent, "fit", staticmethod(lambda *a: decontam.Latent(0 * fit(*a).table, fit(*a).df)))
    assert leaks() == plain  # without the latent space every reworded item is lost


def test_decontamination_of_frequent_items(spark):
    """An item in a third of all documents, and one of words that every document has."""
    r = random.Random(17)
    usual = [f"c{i}" for i in range(60)]
    everywhere, common = words(r, 59, 100000), [r.choice(usual) for _ in range(30)]
    rows, leaks = [], set()
    for i in range(300):
        w = [r.choice(usual) if r.random() < 0.6 else x for x in words(r, 200, 3000)]
        if i % 3 == 0 or i == 100:
            at, k = r.randrange(len(w)), int(i == 100)
            w[at:at] = common if k else everywhere
            leaks.add((i, k))
        rows.append((i, " ".join(w), "en", "s"))
    benchmark = spark.createDataFrame([(0, " ".join(everywhere)), (1, " ".join(common))], "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in decontam.decontaminate(table(spark, rows), benchmark).collect() if not x.kept}
    assert found == leaks
    df = np.r_[np.full(100, 1000), np.ones(1000)]
    assert (decontam.weights(df, 1000, 0.01) > 0).all()


def test_common_subsequence():
    r = random.Random(7)
    for _ in range(200):
        a, b = ([r.randrange(6) for _ in range(r.randrange(1, 30))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert decontam.in_common(np.array(a), np.array(b)) == best[-1][-1]


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "lines", "near_duplicates", "decontamination", "packing"]
    out = corpus_pipeline.run(spark, sf_dir).collect()
    left = {x.doc_id for x in out}
    assert left < {x.doc_id for x in docs.select("doc_id").collect()}
    per_doc = collections.defaultdict(int)
    for x in out:
        per_doc[x.doc_id] += x.length
    assert all(per_doc[x.doc_id] == x.doc_tokens for x in out)


def test_entries_are_complete():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in entries.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 13))
    assert set(entries.ORACLES) <= set(entries.QUERIES)


def test_rules_without_a_match_leave_the_text_whole(spark):
    from raretide.llm import licenses

    docs = spark.createDataFrame([(1, "the author of an open file, provided as common art"), (2, "under the mit license, mit license"), (3, None)], "doc_id long, text string")
    found = licenses.detections(docs)
    assert "CASE WHEN (size(hit" in found._jdf.queryExecution().optimizedPlan().toString()
    rows = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word) for r in licenses.scan_licenses(docs).collect()}
    assert rows == {1: (10, 0, None, None), 2: (6, 2, 2, 4), 3: (0, 0, None, None)}


def test_rules_meet_only_texts_with_their_words(spark):
    from raretide.llm import licenses

    assert licenses.required(licenses.pattern("mit no attribution license?")) == ["attribution", "mit", "no"]
    assert licenses.required(licenses.pattern("gnu general public license v|version? 3 0?")) == ["general", "gnu", "license", "public"]
    assert licenses.required(licenses.pattern(f"spdx license identifier {licenses.ANY_FEW}or|and mit")) == ["identifier", "license", "mit", "spdx"]
    docs = spark.createDataFrame([(1, "mit dem Auto"), (2, "license mit"), (3, "MIT license, the mit"), (4, "..."), (5, None)], "doc_id long, text string")
    found = licenses.detections(docs)
    assert "array_except" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.doc_id, r.n_words, r.start, r.end) for r in found.filter("base OR (rule IS NULL AND doc_id <> 3)").collect()} == {(1, 3, None, None), (2, 2, None, None), (3, 4, 0, 2), (4, 0, None, None), (5, 0, None, None)}


def test_toxicity_learns_from_all_labelled_texts(spark):
    """A word that no sampled text has is learnt, and the same model comes out of rows in another order."""
    from raretide.llm import toxicity

    r = random.Random(3)
    rows = [(i, " ".join([*words(r, 12), *(["vilest"] if i % 4 == 0 else [])]), "en", "s") for i in range(900)]
    docs, labels = table(spark, rows), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(900)], "doc_id long, toxic int")
    how = {"per_class": 5, "epochs": 1, "block": 300, "rounds": 2}
    model, cuts = toxicity.fit(docs, labels, **how)
    again, _ = toxicity.fit(docs.repartition(7), labels.repartition(3), **how)
    assert all((a == b).all() for a, b in zip(model.tables, again.tables, strict=True)) and (model.dense() == again.dense()).all()
    assert set(cuts) == {"en"}
    few, _ = toxicity.fit(docs, labels, **how | {"rounds": 0})
    assert sum((a != b).any(axis=1).sum() for a, b in zip(model.tables, few.tables, strict=True)) > 0


def test_labelled_rows_are_whole(odd, labels):
    """All labelled documents but the held-out ones, each once with its smallest text and its largest label."""
    known = {}
    for r in labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").collect():
        known[r.doc_id] = max(r.toxic, known.get(r.doc_id, 0))
    expected = {}
    for r in odd.filter("doc_id IS NOT NULL").collect():
        if r.doc_id in known and not _held_out(r.doc_id):
            expected[r.doc_id] = min(expected.get(r.doc_id, (r.text, r.lang)), (r.text, r.lang), key=lambda x: (x[0] is not None, x[0], x[1] or ""))
    for short in (labels, labels.withColumn("doc_id", F.col("doc_id").cast("int"))):
        rows = labelled.everything(odd, short, F.col("toxic"), 5, 2, 18, more={"lang": F.col("lang")})
        out = rows.withColumn("task", F.spark_partition_id()).collect()
        assert sorted((r.doc_id, r.y) for r in out) == sorted((i, known[i]) for i in expected)
        assert {r.doc_id: (r.text, r.lang) for r in out} == expected
        assert all(r.task == r.block % 2 and 0 <= r.block < 5 for r in out)
    assert labelled.everything(odd.limit(0), labels, F.col("toxic"), 1, 1, 18).count() == labelled.everything(odd, labels.limit(0), F.col("toxic"), 1, 1, 0).count() == 0


def test_only_labelled_texts_are_shuffled(spark):
    docs = spark.range(40000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    known = spark.range(0, 40000, 40).select(F.col("id").alias("doc_id"))
    found = {r.doc_id for r in labelled.candidates(docs, known, 1000).select("doc_id").collect()}
    assert found >= set(range(0, 40000, 40)) and len(found) < 1000 + 40000 / 16
    assert {r.doc_id for r in labelled.candidates(docs, known, 1).select("doc_id").collect()} >= set(range(0, 40000, 40))  # too few bits lose nothing


def test_toxicity_moves_texts_once_and_few_to_the_driver(spark, monkeypatch):
    from raretide.llm import toxicity

    seen = []

    def watched(model, rows, seed, rate):
        plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        seen.append((len(re.findall(r"(?<!Broadcast)Exchange ", plan)), rows.groupBy(F.spark_partition_id()).count().count()))
        picked = labelled.first(rows, 5, 2)
        assert re.findall(r"TakeOrderedAndProject\(.*?output=\[([a-z_]+)#\d+L?\]", picked._jdf.queryExecution().executedPlan().toString())[:2] == ["doc_id", "doc_id"]
        texts = {(r.doc_id, r.y, r.text) for r in rows.collect()}
        assert picked.count() == 10 and {(r.doc_id, r.y, r.text) for r in picked.collect()} <= texts

    monkeypatch.setattr(toxicity, "_pass", watched)
    r = random.Random(3)
    docs = table(spark, [(i, " ".join(words(r, 12)), "en", "s") for i in range(900)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        toxicity.fit(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(900)], "doc_id long, toxic int"), per_class=5, epochs=1, block=100, rounds=1)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert seen == [(2, 2)]  # the maps and the rows; ten blocks in two tasks


def test_toxicity_of_a_text_is_its_own():
    """The same answers whatever texts stand beside it in a batch."""
    from raretide.llm import toxicity

    r = random.Random(4)
    texts = [" ".join(words(r, n)) for n in (0, 1, 2, 3, 5, 9, 1, 0, 30) * 9]
    model = toxicity.Model(1)
    for b in model.bias:
        b -= np.float32(0.2)
    alone = np.concatenate([model.logits(pa.array([t])) for t in texts])
    assert np.allclose(model.logits(pa.array(texts)), alone, rtol=0, atol=1e-5)
