"""Corpus operators against brute force, and their defined results in odd cases."""

import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from landgrid.llm import block_knn, chat_format, common, decontamination, filter_audit, importance, jaccard_join, language_id, lexical_search, license_scan, mixing, sharding, simhash, url_filters
from landgrid.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 40000


def odd_docs(spark):
    """Nulls in every column, blank and very long texts, ties, repeated rows, clashing columns."""
    rows = [
        (1, "the cat sat on the mat", "en", "a", 1), (2, None, "en", "a", None), (3, "", None, None, 0), (4, " \t\n", "en", "b", 3), (None, "no id here", "en", "a", 1),
        (5, LONG, "la", "b", 9), (6, "the cat sat on the mat", "en", "a", 1), (1, "the cat sat on the mat", "en", "a", 1), (7, "!!! ??? 123", None, None, 1), (8, "licensed under CC BY-NC 4.0", "en", "b", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


def clash(df, *names):
    return df.withColumns({n: F.lit("kept") for n in names})


def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1 -----------------------------------------------------------------------------------------------

def waterfall(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total >= cap * sizes[s]}
        if not full:
            return target | {s: left * w[s] / total for s in open_}
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix_targets_and_balance(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", "d", None]), int(r.lognormvariate(4, 1.2))) for i in range(6000)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("h", F.xxhash64("doc_id"))
    sized = sized.withColumn("source_key", F.lit("kept"))
    got = mixing.balanced_copies(sized, block_rows=256).collect()
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    want, taken = waterfall(sizes), Counter()
    for g in got:
        assert g.target == pytest.approx(want[g.source]) and g.source_size == sizes[g.source] and 0 <= g.copies <= 2
        taken[g.source] += g.size * g.copies
    assert len(got) == len(rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.002 * want[s] + max(n for _, x, n in rows if x == s) / 2  # one outlier may outweigh its small block
    again = mixing.balanced_copies(sized.repartition(3), block_rows=256).collect()
    assert {g.doc_id: g.copies for g in got} == {g.doc_id: g.copies for g in again}


def test_mix_of_many_equal_rows(spark):
    rows = spark.range(200_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.lit(40).cast("long").alias("size"))
    rest = spark.range(2000).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b"), F.col("id") % 50 + 1)
    began = time.time()
    got = mixing.balanced_copies(rows.unionAll(rest)).groupBy("doc_id", "source", "target").agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("copies")).alias("words"), F.max("copies").alias("most"), F.min("copies").alias("least")).collect()
    assert time.time() - began < 60 and sum(g.n for g in got) == 202_000
    assert all(g.most - g.least <= 1 and g.most <= 2 for g in got)
    for s in "ab":
        mine = [g for g in got if g.source == s]
        assert sum(g.words for g in mine) == pytest.approx(mine[0].target, rel=0.002)


@pytest.mark.parametrize("n", [40, 3000])
def test_mixed_rows_are_whole_rows(spark, n):
    docs = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit("the same text").alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(3).cast("long").alias("n_chars"))
    docs = docs.unionAll(spark.range(300).select(F.col("id") + 10, F.concat(F.lit("other text "), F.col("id")), F.lit("en"), F.lit("b"), F.col("id")))
    got = Counter(tuple(r) for r in mixing.mix_sources(docs).collect())
    want = waterfall({"a": 3 * n, "b": 900})
    assert got[1, "the same text", "en", "a", 3] == pytest.approx(want["a"] / 3, abs=1)
    assert all(c <= 2 for k, c in got.items() if k[0] != 1) and sum(3 * c for k, c in got.items() if k[0] != 1) == pytest.approx(want["b"], abs=3)


def test_flight_keeps_probabilities():
    p, x = np.array([0.3, 0.7, 0.5, 0.2, 0.9]), np.array([9.0, 5.0, 3.0, 3.0, 1.0])
    rng = np.random.default_rng(0)
    runs = np.array([mixing.flight(p, x, rng, True) for _ in range(4000)])
    assert set(np.unique(runs)) <= {0.0, 1.0} and np.abs(runs.mean(0) - p).max() < 0.03
    q = mixing.flight(p, x, rng, False)
    assert q.sum() == pytest.approx(p.sum()) and q @ x == pytest.approx(p @ x) and ((q > 0) & (q < 1)).sum() <= 2


def test_mix_lands_near_the_target(spark):
    """Small sources in which one document holds half of the words."""
    r = random.Random(6)
    rows = [(k * 100 + i, f"s{k:02}", 400 if i == 0 else r.randrange(10, 90)) for k in range(30) for i in range(10)]
    got = mixing.balanced_copies(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    for k in range(30):
        mine = [g for g in got if g.source == f"s{k:02}"]
        assert abs(sum(g.size * g.copies for g in mine) - mine[0].target) <= 0.03 * mine[0].target


SWAPPED = [("a b c", "en", None), ("a b c", None, "en")]


def swapped_nulls(spark, n):
    """n rows each of two kinds that hold the same values, in other columns beside nulls."""
    rows = spark.createDataFrame([(1, *r, 5) for r in SWAPPED], DOCS)
    return rows.crossJoin(spark.range(n)).drop("id")


@pytest.mark.parametrize("n", [3, 1500])
def test_rows_are_told_apart_with_their_nulls(spark, n):
    docs = swapped_nulls(spark, n)
    count = lambda df: Counter((r.text, r.lang, r.source) for r in df.select("text", "lang", "source").collect())
    assert count(sharding.shuffle_into_shards(docs)) == {r: n for r in SWAPPED}
    mixed = count(mixing.mix_sources(docs))
    assert set(mixed) == set(SWAPPED) and all(n <= c <= 2 * n for c in mixed.values())
    sized = docs.withColumn("size", F.lit(3).cast("long"))
    assert count(mixing.balanced_copies(sized)) == {r: n for r in SWAPPED}
    kept = [tuple(r) for r in simhash.one_of_each(docs).select("text", "lang", "source").collect()]
    assert len(kept) == 1 and kept[0] in SWAPPED


def test_mix_odd_cases(spark):
    docs = odd_docs(spark)
    mixed = mixing.mix_sources(clash(docs, "Copies", "target", "_id", "_h", "h"))
    assert mixed.columns == [*docs.columns, "Copies", "target", "_id", "_h", "h"] and {r._id for r in mixed.collect()} == {"kept"}
    counts = Counter((r.doc_id, r.text) for r in mixed.collect())
    held = Counter((r.doc_id, r.text) for r in docs.collect())
    assert all(n <= 2 * held[k] for k, n in counts.items())
    assert mixing.mix_sources(empty(spark)).count() == 0


# 2 -----------------------------------------------------------------------------------------------

def check_shards(rows, n_rows, n_shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, by.values())) == n_rows
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by.get(s, [])) for s in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1


def test_shards_are_a_permutation(spark):
    docs = spark.range(3001).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    a = sharding.shuffle_into_shards(docs, 8, bucket_bytes=10_000).collect()
    check_shards(a, 3001, 8)
    assert sorted(r.doc_id for r in a) == list(range(3001))
    b = sharding.shuffle_into_shards(docs.repartition(5), 8, bucket_bytes=10_000).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in a} == {r.doc_id: (r.shard, r.slot) for r in b}
    order = [r.doc_id for r in sorted(a, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(order, range(3001))[0, 1]) < 0.1


def test_shards_odd_cases(spark):
    docs = odd_docs(spark)
    rows = sharding.shuffle_into_shards(clash(docs, "Shard", "slot", "rec", "bucket", "at"), 3).collect()
    check_shards(rows, docs.count(), 3)
    assert {r.Shard_in for r in rows} == {r.bucket for r in rows} == {"kept"}
    assert sharding.shuffle_into_shards(empty(spark)).count() == 0


def test_shards_of_many_equal_rows(spark, monkeypatch):
    docs = spark.range(9000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same").alias("text")).unionAll(spark.range(500).select("id", F.lit("x")))
    out = sharding.shuffle_into_shards(docs, 8, bucket_bytes=10_000)
    rows = out.withColumn("task", F.spark_partition_id()).collect()
    check_shards(rows, 9500, 8)
    assert Counter(r.text for r in rows) == {"the same": 9000, "x": 500}
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot)) if r.text == "x"]
    assert len(set(order)) == 500
    again = sharding.shuffle_into_shards(docs.repartition(7), 8, bucket_bytes=10_000, max_tasks=3).collect()
    assert Counter((r.doc_id, r.text, r.shard, r.slot) for r in rows) == Counter((r.doc_id, r.text, r.shard, r.slot) for r in again)


def test_shards_tell_rows_apart_by_all_columns(spark):
    docs = spark.range(400).select(F.lit(1).alias("doc_id"), F.lit("t").alias("text"), F.col("id").cast("string").alias("lang"), F.create_map(F.lit("k"), F.col("id")).alias("m"))
    at = lambda df: {r.lang: (r.shard, r.slot) for r in sharding.shuffle_into_shards(df, 3, bucket_bytes=3000).collect()}
    assert at(docs) == at(docs.repartition(5))


def test_shards_are_written(spark, tmp_path):
    out = str(tmp_path / "shards")
    sharding.write_shards(sharding.shuffle_into_shards(odd_docs(spark), 2), out)
    check_shards(spark.read.parquet(out).collect(), 10, 2)


# 3 -----------------------------------------------------------------------------------------------

def test_license_templates(spark):
    def labels(text):
        rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
        return license_scan.scan_licenses(rows).collect()[0]

    assert labels("Licensed under the terms of the GNU General Public License, version 3.").labels == "gpl-3"
    assert labels("Licensed under the GNU General Public License 3").labels == "gpl-3"
    assert labels("Licensed under the new GNU General Public License 3").labels == ""
    assert labels("under the terms of the GNU General Public License as published by anyone version 3").labels == "gpl-3"
    assert labels("under the terms of the GNU General Public License " + "x " * 13 + "version 3").labels == ""
    r = labels("so, under the MIT license; under the MIT License")
    assert (r.base_labels, r.labels, r.n_base, r.first_word, r.last_word, r.score) == ("mit", "mit", 2, 1, 5, 0.5)
    assert labels("Released under the MIT License").score == 0.8  # a notice, not the wording
    assert [labels(t).score for t in (MIT, "under the MIT license", "no licence")] == [1.0, 0.5, 0.0]


def test_license_headers_and_negations(spark):
    gnu = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU %s Public License as published by the Free Software Foundation, either version %s of the License, or (at your option) any later version."
    cases = {
        gnu % ("General", "3"): ("gpl-3", 1.0), gnu % ("General", "2"): ("gpl-2", 1.0), gnu % ("Lesser General", "3"): ("lgpl-3", 1.0),
        gnu % ("Lesser General", "2.1"): ("lgpl-2-1", 1.0), gnu % ("Affero General", "3"): ("agpl-3", 1.0),
        'Licensed under the Apache License, Version 2.0 (the "License");': ("apache-2", 0.8),
        "Licensed under a Creative Commons Attribution 4.0 International License.": ("cc-by", 0.8),
        "Creative Commons Attribution-ShareAlike 4.0 International Public License": ("cc-by-sa", 0.8),
        "Creative Commons Attribution-NonCommercial 4.0 International License": ("cc-by-nc", 0.8),
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.": ("cc0", 0.8),
        "made available under the terms of the Eclipse Public License 2.0": ("epl-2", 0.8), "This is NOT released under the GNU GPL.": ("", 0.0),
        "NOT released under the MIT license": ("mit", 0.5),  # a phrase's places count whatever stands before
        "This work is not licensed under the GNU General Public License 3": ("", 0.0), "never again licensed under the GNU General Public License 3": ("", 0.0),
        "not this. Then it is licensed under the GNU General Public License 3": ("gpl-3", 0.8),
        "Not licensed under the GNU General Public License 2; licensed under the GNU General Public License 3": ("gpl-3", 0.8),
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan_licenses(rows).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(cases)))
    assert {i: (labels, score) for i, labels, score in con.execute(f"SELECT doc_id, labels, score FROM ({license_scan.SQL})").fetchall()} == got


MIT = """MIT License. Copyright (c) 2001 Some One. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS",
WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. %sTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER
BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "


def test_license_whole_texts(spark):
    cases = {
        MIT: "mit", MIT.replace("this software and", "the Foo Library and").replace("AUTHORS OR COPYRIGHT HOLDERS", "X CONSORTIUM"): "mit",
        MIT.replace("hereby granted", "hereby denied"): "", MIT.replace("sublicense, ", ""): "", MIT[: len(MIT) // 2] + " All rights reserved.": "",
        BSD % "": "bsd-2", BSD % NAMES: "bsd-3", BSD % "3. No other use is permitted. ": "", (BSD % NAMES)[:400]: "", (MIT + " " + BSD % "").upper(): "bsd-2,mit",
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan.scan_licenses(rows).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_license_scan_is_linear(spark):
    text = "Under the MIT License, licensed under the GNU General Public licensed under cc by " * 125_000  # 10 MB
    began = time.time()
    r = license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert time.time() - began < 60
    assert (r.n_base, r.first_word, r.last_word, r.n_words) == (125_000, 0, 14 * 124_999, 14 * 125_000)


def test_license_automaton_equals_regex():
    r = random.Random(4)
    for _, template in license_scan.TEMPLATES:
        machine, pattern = license_scan.compile_template(template), re.compile(license_scan.template_regex(template))
        words = re.findall(r"[a-z0-9]+", template) + ["x"]
        for _ in range(200):
            keep = r.choice([0.97, 1])
            tokens = [w for w in re.findall(r"[a-z0-9]+", re.sub(r"\{\{\d+\}\}", "x", template)) if r.random() < keep] if r.random() < 0.7 else [r.choice(words) for _ in range(12)]
            tokens = tokens + [r.choice(words)]
            got = any(license_scan.accepts(machine, tokens, i) > 0 for i in range(len(tokens)))
            assert got == bool(pattern.search(" " + " ".join(tokens) + " ")), (template, tokens)


def test_license_odd_cases(spark):
    rows = license_scan.scan_licenses(clash(odd_docs(spark), "labels", "score", "_scan")).collect()
    assert len(rows) == 10 and rows[0].labels_in == "kept"
    by = {r.doc_id: r for r in rows}
    assert by[2].n_words == by[3].n_words == 0 and by[2].first_word is None and by[5].n_words == 200000
    assert by[8].labels == "cc-by-nc"
    assert license_scan.scan_licenses(empty(spark)).count() == 0


# 4 -----------------------------------------------------------------------------------------------

def brute_knn(rows, k, asked):
    vs = {i: np.array(v, float) for i, v in rows}
    out = []
    for q in asked:
        s = sorted((-float(np.einsum("i,i->", vs[q], vs[c]) / (np.sqrt(vs[q] @ vs[q]) * np.sqrt(vs[c] @ vs[c]))), c) for c in vs if c != q)
        out += [(q, n + 1, c, round(-x, 9)) for n, (x, c) in enumerate(s[:k])]
    return out


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 24))
    base[100:160] = base[100] + rng.normal(size=(60, 24)) * 1e-3
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = block_knn.nearest(df, F.col("vec_id") % 50 == 0, query_block=4, candidate_block=64).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got) == sorted(brute_knn(rows, 5, range(0, 300, 50)))


def test_knn_ties_and_odd_vectors(spark):
    rows = [(i, [1.0, 2.0, 0.0]) for i in range(0, 40)] + [(50, [2.0, 4.0, 0.0]), (51, None), (52, [0.0, 0.0, 0.0]), (53, [1.0, None, 0.0]), (54, [1.0, float("nan"), 0.0]), (55, [1.0, float("inf"), 0.0]), (None, [1.0, 2.0, 0.0]), (100, [1.0, 1.0]), (1, [1.0, 2.0, 0.0])]
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "rank", "score")
    got = {}
    for r in block_knn.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert sorted(got[0]) == [(1, 1), (2, 1), (3, 2), (4, 3), (5, 4)]  # the repeated row counts twice
    assert sorted(got[50]) == [(1, 0), (2, 1), (3, 1), (4, 2), (5, 3)]
    assert 100 not in got
    assert block_knn.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    two = block_knn.nearest(df.where("vec_id in (0, 7)"), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r.vec_id) for r in two] == [(0, 7)]


def test_knn_repeated_ids_and_sizes(spark):
    rows = [(7, [1.0, 0.0]), (7, [0.0, 1.0]), (50, [1.0, 0.1]), (100, [1e200, 1e200]), (101, [3e-200, 2.9e-200]), (50, [0.1, 1.0]), (102, [-1e308, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = [np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max()) for _, v in rows]
    want = []
    for i, (q, _) in enumerate(rows):
        if q % 50 == 0:
            best = sorted((-float(unit[i] @ unit[j]), rows[j][0]) for j in range(len(rows)) if j != i)[:5]
            want += [(q, n + 1, c, round(-x, 9)) for n, (x, c) in enumerate(best)]
    got = block_knn.nearest(df, F.col("vec_id") % 50 == 0, query_block=2, candidate_block=3).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got) == sorted(want)


def test_quantisation_bound():
    rng = np.random.default_rng(7)
    q, c = rng.normal(size=(40, 16)), rng.normal(size=(50, 16))
    (qx, qs, qe), (cx, cs, ce) = block_knn.quantise(q), block_knn.quantise(c)
    near = qx @ cx.T * qs[:, None] * cs[None, :]
    true = (q / np.linalg.norm(q, axis=1)[:, None]) @ (c / np.linalg.norm(c, axis=1)[:, None]).T
    assert (np.abs(true - near) <= qe[:, None] + ce[None, :] * (1 + qe[:, None]) + 1e-9).all()


# 5 -----------------------------------------------------------------------------------------------

BITS = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<|im_end|>", "<|im_start|>", "<\\/s>", "\\", "<", "[", "|", "\n", "é", " word ", "im_end|>", "<\\\\|im_end|>"]


def conversations(spark, n=30, seed=3):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.choice([1, 2, 5, 40])):
            role = "system" if t == 0 and r.random() < 0.5 else r.choice(["user", "assistant", "tool\nx", "a<|im_end|>"])
            rows.append((c, t * 2, role, "".join(r.choice(BITS) for _ in range(r.randrange(30))) + " w" * r.choice([0, 5, 60, 500])))
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_round_trip(spark):
    import hashlib

    rows, df = conversations(spark)
    windows = chat_format.format_windows(df, stride=120, history=40).cache()
    got = {r.conv_id: r for r in chat_format.read_back(windows).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        said, loss = "".join(f"{r[2]}\n{r[3]}\n" for r in turns), "".join(r[3] for r in turns if r[2] == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[c].n_turns == len(turns)
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    for w in windows.collect():
        turns = w.text.split(chat_format.END)[:-1]
        assert len(turns) == w.n_own + w.n_context
        own = turns[w.n_context:]
        assert sum(len(chat_format.START) and t.count(chat_format.START) for t in turns) == len(turns)
        assert len(w.spans) == sum(t.startswith(chat_format.START + "assistant\n") for t in own)
        if w.n_own > 1:
            assert w.tokens - 0 <= 120 + 40 + 520


def test_chat_windows_keep_system_and_history(spark):
    rows = [(1, 0, "system", "be brief")] + [(1, t, "assistant" if t % 2 == 0 else "user", f"t{t} " + "w " * 20) for t in range(1, 60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ws = sorted(chat_format.format_windows(df, stride=100, history=50).collect(), key=lambda w: (w.cell, w.part))
    assert len(ws) > 5 and all("be brief" in w.text for w in ws)
    assert sum(w.n_own for w in ws) == 60 and all(w.n_context >= 2 for w in ws[1:]) and max(w.tokens for w in ws) <= 100 + 50 + 4


def test_chat_long_conversation_equals_one_run(spark, monkeypatch):
    _, df = conversations(spark, 6, 9)
    a = chat_format.laid_out(df, 100).collect()
    monkeypatch.setattr(chat_format, "RUN", 3)
    b = chat_format.laid_out(df, 100).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_chat_odd_cases(spark):
    schema = "conv_id long, turn long, role string, text string"
    df = clash(spark.createDataFrame([(1, None, None, None), (1, 0, "user", None), (1, 0, "user", None), (None, 0, "assistant", "x"), (2, 1, "assistant", LONG)], schema), "text_in", "spans")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_windows(df)).collect()}
    assert got[1].n_turns == 3 and got[None].loss_chars == 1 and got[2].loss_chars == len(LONG)
    assert chat_format.read_back(chat_format.format_windows(df.limit(0))).count() == 0


# 6 -----------------------------------------------------------------------------------------------

def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = language_id.identify_languages(docs).collect()
    held = [r for r in rows if r.held_out and r.lang is not None]
    assert len(held) > 30 and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == docs.count()


def test_language_odd_cases(spark):
    by = {r.doc_id: r for r in language_id.identify_languages(clash(odd_docs(spark), "score", "lang_pred", "_found")).collect()}
    assert by[2].lang_pred == by[3].lang_pred == by[4].lang_pred == by[7].lang_pred == "und" and by[2].score == 0
    assert by[1].lang_pred in ("en", "la") and by[1].score_in == "kept" and by[None].held_out
    assert language_id.identify_languages(empty(spark)).count() == 0
    unlabelled = spark.createDataFrame([(1, "some words", None, "a", 1)], DOCS)
    assert language_id.identify_languages(unlabelled).collect()[0].lang_pred == "und"


def test_language_keeps_unlabelled_corpora(spark):
    rows = [(1, "some words", None, "a", 1), (2, "123", None, "a", 1), (3, None, None, "a", 1), (4, "été", None, "a", 1)]
    got = language_id.in_known_language(clash(spark.createDataFrame(rows, DOCS), "score"))
    assert got.columns == [*DOCS.replace(" long", "").replace(" string", "").split(", "), "score"] and sorted(r.doc_id for r in got.collect()) == [1, 4]


@pytest.mark.parametrize("margin", [1, 8])
def test_least_hashes(spark, margin):
    r = random.Random(2)
    rows = [("a", r.getrandbits(64) - 2**63) for _ in range(3000)] + [("b", r.getrandbits(64) - 2**63) for _ in range(30)] + [("c", 77)] * 500 + [("c", 2**63 - 1), ("c", -(2**63))]
    got = {x.lang: x.cut for x in language_id.least_hashes(spark.createDataFrame(rows, "lang string, h long"), 40, margin).collect()}
    assert got == {lang: sorted({h for x, h in rows if x == lang})[:40][-1] for lang in "abc"}
    assert language_id.least_hashes(spark.createDataFrame([], "lang string, h long"), 40).count() == 0


def test_language_weights_equal_kernel_ridge_regression():
    """Folded weights give what kernel ridge regression on the landmarks' span gives, computed on kernel matrices alone."""
    r = random.Random(3)
    texts = [" ".join(r.choice(["der", "die", "und", "ist"] if k % 2 else ["the", "and", "is", "of"]) + str(r.randrange(9)) for _ in range(30)) for k in range(24)]
    labels = ["de" if k % 2 else "en" for k in range(24)]
    rows = np.array([language_id.presence(t) for t in texts])
    sets = [set(np.flatnonzero(x)) for x in rows]
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    model = language_id.fit(np.packbits(rows, axis=1), labels, landmarks=24, ridge=0.1)
    got = model.margins(rows)
    # with all texts as landmarks, Nystroem features span the kernel: ridge regression with an unpenalised-by-kernel bias column of its own
    gram, y = kernel + 1.0, np.array([[1.0 if x == lang else -1.0 for lang in ("de", "en")] for x in labels])
    want = gram @ np.linalg.solve(gram + 0.1 * np.eye(24), y)
    assert np.abs(got - want).max() < 1e-3


def test_language_pieces_do_not_matter(monkeypatch):
    text = "Les mots français et the english words " * 50
    whole = language_id.presence(text)
    monkeypatch.setattr(language_id, "PIECE", 64)
    assert (language_id.presence(text) == whole).all()


def test_language_of_long_texts_and_texts_with_junk(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null").select("doc_id", "text", "lang")
    r, texts = random.Random(5), {}
    for row in docs.where(language_id.held_out(F.col("doc_id"))).collect():
        texts.setdefault(row.lang, []).append(row.text)
    odd = []
    for lang, all_of in sorted(texts.items()):
        joined, junk = " ".join(all_of), "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=200_000))
        odd += [joined * (size // len(joined) + 1) for size in (1_000_000, 5_000_000)]  # repeats alone do not fill a row
        odd += [" ".join("".join(r.sample(w, len(w))) if r.random() < 0.2 else w for w in odd[-2].split(" "))]  # new n-grams all along
        plain, short = max(all_of, key=len), min((t for t in all_of if len(t) > 300), key=len)
        odd += [f"{plain} {junk[:size]}" for size in (10_000, 50_000, 200_000)] + [f"{short} {junk}", f"{junk[:20_000]} {plain}", f"{plain} {junk[:20_000]} {plain}"]
    each = len(odd) // len(texts)
    rows = [(None, t, sorted(texts)[i // each]) for i, t in enumerate(odd)]  # null ids are held out
    found = language_id.identify_languages(docs.unionAll(spark.createDataFrame(rows, "doc_id long, text string, lang string"))).where("doc_id is null").collect()
    assert len(found) == len(rows) and all(x.held_out and x.lang_pred == x.lang for x in found)


# 7 -----------------------------------------------------------------------------------------------

def signed(x):
    return x - (1 << 64) if x >> 63 else x


def naive_simhash(text, k=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


@pytest.mark.parametrize("text", ["", "  ", "One", "One two", "a B c", "É é\x0bÀ x y z " * 9, "the cat sat on the mat " * 3])
def test_fingerprint(text):
    assert simhash.simhash_of(simhash.shingle_hashes(text.encode(), 3)) == signed(naive_simhash(text))


def clustered(seed):
    r, points = random.Random(seed), set()
    for _ in range(15):
        x = r.getrandbits(64)
        for _ in range(30):
            x ^= 1 << r.randrange(64)
            if r.random() < 0.5:
                x ^= 1 << r.randrange(64)
            points.add(x)
    c = r.getrandbits(64)
    points |= {c ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i) if r.random() < 0.6}
    return sorted(points)


def joined_by(points, distance=2):
    root = list(range(len(points)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if bin(points[i] ^ points[j]).count("1") <= distance:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(points))]


@pytest.mark.parametrize("distance,parts,paired", [(2, 3, 64), (2, 3, 4), (2, 4, 64), (2, 2, 64), (2, 1, 2), (2, None, 64), (0, None, 64), (1, None, 2), (3, None, 64), (3, 4, 4), (5, 6, 8)])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, distance, parts, paired):
    monkeypatch.setattr(simhash, "MAX_PAIRED", paired)
    points = clustered(distance if parts is None else parts)
    prints = spark.createDataFrame([(signed(p),) for p in points], "fp long")
    links = simhash.near_links(prints, distance, parts)
    pairs = [(r.a, r.b) for r in links.collect()]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= distance for a, b in pairs)
    got = {r.node: r.root for r in components(links).collect()}
    groups = {}
    for p, g in zip(points, joined_by(points, distance)):
        groups.setdefault(g, []).append(got.get(signed(p), signed(p)))
    assert all(len(set(g)) == 1 for g in groups.values()) and len({g[0] for g in groups.values()}) == len(groups)


def test_parts_follow_the_number_of_fingerprints():
    both = np.full((64, 64), 0.25) + np.eye(64) * 0.25
    few, many = (simhash.likely_parts(both * n, n, 2) for n in (1000, 10**10))
    assert few == 3 and many < few


def test_thresholds():
    assert sorted(simhash.allocate([[0, 5, 9, 20], [0, 50, 90, 200], [0, 5, 9, 20]], 0)) == [-1, 0, 1]
    assert simhash.allocate([[0, 5, 9, 20], [0, 50, 90, 200], [0, 5, 9, 20]], 0)[1] == -1
    assert sum(simhash.allocate([[0, 1, 2, 3]] * 5, -2)) == -2


def test_near_duplicates_odd_cases(spark):
    by = {}
    for r in simhash.near_duplicates(clash(odd_docs(spark), "fp", "component_id", "first", "root")).collect():
        by.setdefault(r.doc_id, []).append(r)
    assert {r.component_id for r in by[6]} == {1} and len(by[1]) == 2 and by[1][0].fp_in == "kept"
    assert by[2][0].fp == by[3][0].fp == by[4][0].fp == 0 and by[4][0].component_id == 2
    assert by[None][0].component_id is None
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(chain).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert components(chain.limit(0)).count() == 0


# 8 -----------------------------------------------------------------------------------------------

def test_importance_prefers_target_like_texts(spark):
    r = random.Random(8)
    good, bad = [f"good{i}" for i in range(50)], [f"bad{i}" for i in range(50)]
    rows = [(i, " ".join(r.choice(good if i % 2 else bad) for _ in range(40))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i,) for i in range(1, 200, 2)], "doc_id long")
    got = importance.resample(docs, labels, share=0.5).collect()
    kept = [g.doc_id for g in got if g.selected]
    assert len(kept) == 200 and sum(i % 2 for i in kept) > 190
    assert {g.doc_id: g.score for g in got}.keys() == set(range(400))
    fitted = np.mean([g.log_weight / g.n_grams for g in got if g.doc_id % 2 and g.doc_id < 200])
    fresh = np.mean([g.log_weight / g.n_grams for g in got if g.doc_id % 2 and g.doc_id >= 200])
    assert abs(fitted - fresh) < 0.05
    assert {g.doc_id: g.score for g in got} == {g.doc_id: g.score for g in importance.resample(docs.repartition(3), labels, share=0.5).collect()}


def naive_ngrams(text):
    """Buckets of a text's words and word pairs, by whole numbers alone."""
    full, base = (1 << 64) - 1, 0x9E3779B97F4A7C15
    hashes = []
    for word in re.findall(rb"[0-9a-z\x80-\xff]+|[!-/:-@\[-`{-~]+", text.encode().lower()):
        h = sum((b + 1) * pow(base, i, 1 << 64) for i, b in enumerate(word)) & full
        hashes.append((h ^ h >> 29) * 0xBF58476D1CE4E5B9 & full)
    pairs = [(a * 0x94D049BB133111EB + b) & full for a, b in zip(hashes, hashes[1:])]
    return Counter((h >> 20) % importance.BUCKETS for h in hashes + [p ^ p >> 31 for p in pairs])


def test_importance_equals_brute_force(spark):
    r = random.Random(18)
    rows = [(i, " ".join(r.choice(["Ab", "cd,", "é", "x1", "of!", f"w{i % 3}"]) for _ in range(r.randrange(30)))) for i in range(120)] + [(200, None)]
    docs, good = spark.createDataFrame(rows, "doc_id long, text string"), {i for i in range(0, 120, 3)}
    noise = {x.doc_id: x.g for x in docs.select("doc_id", importance.gumbel(31).alias("g")).collect()}
    counts = {i: naive_ngrams(t or "") for i, t in rows}
    target, raw = sum((counts[i] for i in good), Counter()), sum(counts.values(), Counter())
    n, t_all, r_all = importance.BUCKETS, sum(target.values()), sum(raw.values())
    weight = {}
    for i, c in counts.items():
        own, size = i in good, sum(c.values())
        all_ = np.log((t_all + n - own * size) / (r_all + n - size))
        weight[i] = sum(k * (np.log((target[b] - own * k + 1) / (raw[b] - k + 1)) - all_) for b, k in c.items())
    scores = {i: weight[i] + noise[i] for i, c in counts.items() if c}
    k = round(0.4 * len(scores))
    best = set(sorted(scores, key=scores.get)[-k:])
    got = importance.resample(docs, spark.createDataFrame([(i,) for i in good], "doc_id long"), share=0.4).collect()
    for g in got:
        assert g.n_grams == sum(counts[g.doc_id].values()) and g.log_weight == pytest.approx(weight[g.doc_id], abs=1e-9)
        assert g.selected == (g.doc_id in best) and (g.score is None if g.doc_id not in scores else g.score == pytest.approx(scores[g.doc_id]))


def test_ngram_counts(monkeypatch):
    text = b"one two, three!! one two " * 40
    whole = importance.ngram_counts(text)
    assert whole.sum() == 40 * 7 + 40 * 7 - 1
    monkeypatch.setattr(importance, "PIECE", 64)
    assert (importance.ngram_counts(text) == whole).all()


def test_kth_largest(spark):
    r = random.Random(1)
    values = [r.gauss(0, 1) ** 5 for _ in range(2000)] + [0.5] * 30
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 7, 400, 2030, 5000):
        assert importance.kth_largest(df, "x", k) == sorted(values, reverse=True)[min(k, len(values)) - 1]
    assert importance.kth_largest(df, "x", 0) is None and importance.kth_largest(df.limit(0), "x", 3) is None


def test_importance_odd_cases(spark):
    labels = spark.createDataFrame([(1,), (None,), (1,)], "doc_id long")
    got = importance.resample(clash(odd_docs(spark), "score"), labels).collect()
    assert len(got) == 10 and not any(g.selected for g in got if g.doc_id in (2, 3, 4))
    assert importance.resample(empty(spark), labels).count() == 0
    assert len(importance.resample(odd_docs(spark), labels.limit(0)).collect()) == 10


# 9 -----------------------------------------------------------------------------------------------

def test_url_index_equals_all_rules(spark, monkeypatch):
    r = random.Random(6)
    bits = ["http://", "https://", "www.", "blog.", "m.", "x.", "example.com", "example.net", "example.org", "/es", "/fr", "/en", "/ads", "/tracker", "/click", "?id=", "?page=2", "&ref=x", "?utm_source=feed", ".html", "#top", "/robots.txt", ".php"]
    urls = ["".join(r.choice(bits) for _ in range(r.randrange(1, 8))) for _ in range(3000)] + ["HTTP://WWW.a.EXAMPLE.com/EN/", None, ""]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {x.page_id: x for x in url_filters.judge_urls(pages, host_rules=[]).collect()}
    rules = [(v, re.compile(url_filters.rule_regex(g))) for v, g in url_filters.PATTERN_RULES]
    for i, u in enumerate(urls):
        fits = {v for v, x in rules if x.search((u or "").lower())}
        assert got[i].verdict == ("block" if fits == {"block"} else "allow"), u
    more = [("block", "ads*"), ("allow", "*ref=x|"), ("block", "^nowhere^")]  # two without a token, one that no URL can fit
    table = spark.createDataFrame(url_filters.PATTERN_RULES + more, "verdict string, glob string")
    want = {x.page_id: x.verdict for x in url_filters.judge_urls(pages, host_rules=[], pattern_rules=url_filters.PATTERN_RULES + more).collect()}
    monkeypatch.setattr(url_filters, "MAX_RULES", 1)
    for rules in (table, url_filters.PATTERN_RULES + more):
        rows = url_filters.judge_urls(clash(pages, "_u", "_found"), host_rules=[], pattern_rules=rules).collect()
        assert {x.page_id: x.verdict for x in rows} == want and len(rows) == len(urls) and rows[0]._u == "kept"


def test_url_tokens_and_index():
    assert url_filters.rule_regex("||ADS.Example^|") == url_filters.rule_regex("||ads.example^|") and url_filters.rule_tokens("^ADS^") == ["ads"]
    assert url_filters.rule_tokens("||m.*.example.com^fr^*.html|") == ["m", "example", "com", "fr", "html"]
    assert url_filters.rule_tokens("?page=*&ref=") == ["page", "ref"] and url_filters.rule_tokens("abc*") == []
    index, always = url_filters.build_index([("block", "^ads^fr^"), ("block", "abc")], {"ads": 9, "fr": 3})
    assert list(index) == ["fr"] and len(always) == 1


def test_url_odd_cases(spark):
    rows = [(1, "https://User@A.Example.COM:8080/p?x#y"), (2, "no scheme/path"), (3, None), (4, "x://h"), (5, "http://a.net"), (6, "http://a.net/"), (7, "http://example.net/en/x"), (7, "http://example.net/en/x"), (None, "http://a.org/fr/")]
    ends = spark.createDataFrame([(1, "http://x.example.com/ads/robots.txt\n"), (2, "http://x.example.com/ads/robots.txt"), (3, "http://x.example.com/ADS/robots.txt?")], "page_id long, url string")
    for pattern_rules in (url_filters.PATTERN_RULES, spark.createDataFrame(url_filters.PATTERN_RULES, "verdict string, glob string")):
        assert {r.page_id: r.verdict for r in url_filters.judge_urls(ends, host_rules=[], pattern_rules=pattern_rules).collect()} == {1: "block", 2: "allow", 3: "block"}
    got = url_filters.judge_urls(clash(spark.createDataFrame(rows, "page_id long, url string"), "host", "rule")).collect()
    at = {g.page_id: g for g in got}
    assert len(got) == 9 and at[1].host_in == "kept"
    assert (at[1].host, at[1].path) == ("user@a.example.com:8080", "/p") and (at[2].host, at[3].path, at[3].verdict) == ("", "", "allow")
    assert (at[5].rule, at[6].rule, at[6].verdict, at[7].rule, at[None].verdict) == (None, "net/", "block", "example.net/en/", "allow")
    assert url_filters.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


# 10 ----------------------------------------------------------------------------------------------

def brute_contamination(docs, items, window=13):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    out = {}
    for i, text in docs:
        words, hit, ids = split(text), set(), set()
        for item, body in items:
            b = split(body)
            k = min(window, len(b))
            for s in range(max(1, len(b) - window + 1)) if b else ():
                for p in range(len(words) - k + 1):
                    if words[p:p + k] == b[s:s + k]:
                        hit |= set(range(p, p + k))
                        ids.add(item)
        out[i] = (len(words), len(hit), len(ids - {None}), bool(hit) and 20 * len(hit) >= len(words))
    return out


@pytest.mark.parametrize("small", [True, False])
def test_contamination_equals_brute_force(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(decontamination, "MAX_BROADCAST_WINDOWS", 1)
        monkeypatch.setattr(decontamination, "MAX_BROADCAST_HITS", 1)
    r = random.Random(11)
    words = ["Ab", "cd", "É", "x1", "of"]
    items = [(i, " ".join(r.choice(words) for _ in range(n))) for i, n in enumerate([0, 1, 3, 5, 13, 14, 30, 30])] + [(98, None), (None, "zz yy xx ww")]
    docs = []
    for i in range(60):
        parts = [" ".join(r.choice(words) for _ in range(r.randrange(40)))]
        for _ in range(r.randrange(3)):
            parts += [r.choice(items)[1] or "", " ".join(r.choice([*words, "zz"]) for _ in range(r.randrange(20)))]
        docs.append((i, ", ".join(parts)))
    docs += [(100, None), (101, ""), (102, "zz! YY; xx ww")]
    got = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {g.doc_id: (g.n_words, g.n_hit, g.n_items, g.contaminated) for g in got} == brute_contamination(docs, items)


def test_contamination_odd_cases(spark):
    items = spark.createDataFrame([(1, "the cat sat on the mat"), (1, "the cat sat on the mat")], "item_id long, text string")
    rows = decontamination.contamination(clash(odd_docs(spark), "n_hit", "contaminated", "_id", "words", "items", "ids", "_k", "_row", "size", "id"), items).collect()
    assert len(rows) == 10 and rows[0].n_hit_in == "kept"
    assert sorted(r.doc_id for r in rows if r.contaminated) == [1, 1, 6]
    assert not any(r.contaminated for r in decontamination.contamination(odd_docs(spark), items.limit(0)).collect())
    assert decontamination.contamination(empty(spark), items).count() == 0


def test_native_operators_run_no_python(spark, sf_dir):
    for name, op in (("op5", chat_format.op5), ("op10", decontamination.op10)):
        plan = op(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name


# 13 ----------------------------------------------------------------------------------------------

def naive_jaccard(rows, shingle=5, least=80):
    """(size of the set, smallest reachable id) of rows (id, text), by all pairs."""
    words = [(t or "").encode().lower().split() for _, t in rows]
    sets = [{tuple(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set() for w in words]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= least * (len(a) + len(sets[j]) - both):
                x, y = root[i], root[j]
                root = [min(x, y) if k in (x, y) else k for k in root]
    least_id = {}
    for (i, _), k in zip(rows, root, strict=True):
        least_id[k] = min((x for x in (least_id.get(k), i) if x is not None), default=None)
    return Counter((i, len(s), least_id[k]) for (i, _), s, k in zip(rows, sets, root, strict=True))


@pytest.mark.parametrize("shingle,least,paired,tile", [(5, 80, 64, 1024), (5, 80, 2, 4), (1, 100, 2, 3)])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, shingle, least, paired, tile):
    monkeypatch.setattr(jaccard_join, "MAX_PAIRED", paired)
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    r, rows = random.Random(paired), []
    for k in range(30):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([1, 3, 6, 12, 40, 200]))]
        for _ in range(r.choice([1, 3, 15])):
            rate = r.choice([0, 0.005, 0.01, 0.03, 0.1])
            rows.append((r.choice([None, *range(1000)]), " ".join(f"x{r.randrange(99)}" if r.random() < rate else w.upper() if r.random() < 0.1 else w for w in base)))
    rows += [(5000, None), (5001, ""), (5002, " \t"), (5003, "one"), (5004, "ONE"), (5004, "ONE"), (None, "alone"), (5005, LONG), (5006, LONG + "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard_join.jaccard_groups(docs, shingle=shingle, least=least)
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got.collect()) == naive_jaccard(rows, shingle, least)


def test_word_hashes_equal_split_words():
    r = random.Random(3)
    junk = b" ".join(bytes(r.choices(range(256), k=r.randint(1, 90))) for _ in range(3000))
    texts = [b"", b" ", b"a", b"A b\x00 b b\x00\x00", b"x" * 7, b"x" * 8, b"x" * 9, b"x" * 64, b"X" * 65, b"\t\n a\x0b\x0c\rb \x1c c\x85", "é Ü ü".encode(), b"y" * 100_000, junk]
    words, hashes = [w for t in texts for w in t.lower().split()], [h for t in texts for h in jaccard_join.word_hashes(t).tolist()]
    assert len(words) == len(hashes) and len(set(zip(words, hashes, strict=True))) == len(set(words)) == len(set(hashes))
    values = jaccard_join.shingle_hashes(junk + b" " + junk, 2)
    assert jaccard_join.different(values).tolist() == sorted(set(values.view(np.int64).tolist()))


def test_jaccard_bitmaps_bound_the_overlap(spark):
    r, rows = random.Random(3), []
    for n in (1, 5, 40, 300, 3000, 50_000):
        a = np.unique(np.array([r.getrandbits(64) for _ in range(n)], np.uint64).view(np.int64))
        b = np.unique(np.concatenate([a[n // 9:], np.array([r.getrandbits(62) for _ in range(n // 7)], np.int64)]))
        rows.append((bytearray(jaccard_join.bitmap(a)), bytearray(jaccard_join.bitmap(b)), len(a) + len(b), len(np.intersect1d(a, b)), a.tolist(), b.tolist()))
    df = spark.createDataFrame(rows, "a binary, b binary, sizes long, common long, xs array<long>, ys array<long>")
    for x in df.select("common", "sizes", jaccard_join.overlap_bound(F.col("a"), F.col("b"), F.col("sizes")).alias("most"), jaccard_join.common(F.col("xs"), F.col("ys")).alias("met")).collect():
        assert x.met == x.common <= x.most <= x.sizes // 2 and (x.sizes > 10_000 or x.most <= 1.1 * x.common + 2)


def test_jaccard_join_odd_cases(spark):
    docs = clash(odd_docs(spark), "n_shingles", "component_id", "node", "n", "id", "row", "_root")
    got = jaccard_join.jaccard_groups(docs)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "n_shingles_in", "component_id_in", "node", "n", "id", "row", "_root", "n_shingles", "component_id"]
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()} == {(1, 2, 1), (6, 2, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (None, 1, None), (5, 5, 5), (7, 1, 7), (8, 1, 8)}
    assert jaccard_join.jaccard_groups(empty(spark)).count() == 0


# 12 ----------------------------------------------------------------------------------------------

def naive_audit(docs, labels):
    """Counts per part, order and step, document by document."""
    from itertools import permutations

    good, toxic, out = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}, Counter()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    for i, text, lang in docs:
        t = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)}
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                got = (not gone and not fails[f], fails[f] and not gone, fails[f] and gone, fails[f] and sum(fails.values()) == 1, fails[f] and not gone and i in good, fails[f] and not gone and i in toxic)
                for n, x in zip(names, got, strict=True):
                    out[lang or "", order, step, n] += x
                out[lang or "", f, "shapley"] += got[1]
                gone = gone or fails[f]
    return {(p, o, s): (*(out[p, o, s, n] for n in names), out[p, o[s - 1], "shapley"]) for p, o, s, *n in {k[:3] for k in out if len(k) == 4}}


@pytest.mark.parametrize("few", [500_000, 0])
def test_audit_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(filter_audit, "MAX_BROADCAST_CELLS", few)
    r, docs, labels = random.Random(few), [], []
    for _ in range(150):
        n = r.choice([0, 3, 150, 199, 200, 400])
        text = " ".join(r.choice(["ab", "cd", "Ef", "gé", "h$"] if r.random() < 0.3 else [f"w{r.randrange(900)}", "XY"]) for _ in range(n))
        docs.append((r.choice([None, *range(120)]), r.choice([text, text, None]), r.choice(["en", "fr", "", None])))
    docs += r.sample(docs, 40) + [(r.randrange(300), t, p) for _, t, p in r.sample(docs, 60)] + [(900 + i, "one hot text", "en") for i in range(80)] + [(7, LONG, "la"), (8, LONG, "la")]
    labels = [(r.choice([None, *range(320)]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(200)]
    table = clash(spark.createDataFrame(docs, "doc_id long, text string, lang string"), "part", "mask", "n", "e", "_c0", "quality")
    got = filter_audit.audit_filters(table.repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {(x.part, x.filter_order, x.step): (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley) for x in got.collect()} == naive_audit(docs, labels)
    assert got.count() == 4 * 600


def test_audit_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(empty(spark), none).count() == 0
    rows = filter_audit.audit_filters(odd_docs(spark), none).collect()
    assert {x.part for x in rows} == {"en", "la", ""} and len(rows) == 1800 and all(x.good_lost == 0 for x in rows)


# 11 ----------------------------------------------------------------------------------------------

def naive_search(docs, items, k):
    """The best k of each item by scoring all documents."""
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total, df = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted), Counter(w for _, c in counted for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 25 + 75 * c.total() * n_docs // max(total, 1)
            score = sum(lexical_search.weight(n_docs, df[w]) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in terms(text) if c[w])
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("first,block,k", [(32, 32 << 20, 10), (1, 300, 3)])
def test_search_equals_brute_force(spark, monkeypatch, first, block, k):
    monkeypatch.setattr(lexical_search, "FIRST_READ", first)
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", block)
    monkeypatch.setattr(lexical_search, "GROUPS", 2)
    r = random.Random(first)
    word = lambda: r.choice(["The", "of", f"w{int(r.expovariate(0.05))}", f"x{r.randrange(3000)}", "é1"])
    docs = [(r.choice([None, *range(500)]), " ".join(word() for _ in range(r.choice([0, 1, 5, 60, 300]))) if r.random() < 0.95 else None) for _ in range(400)]
    docs += [(1000 + i, "w1 w2, the same-text") for i in range(40)] + [(3, LONG), (3, LONG)] + r.sample(docs, 10)
    items = [(i, " ".join(word() for _ in range(r.choice([1, 4, 30])))) for i in range(25)] + [(25, None), (26, ""), (27, "unseen"), (28, "w1 w1 W1 same"), (29, "the"), (None, "w2 text")]
    table = clash(spark.createDataFrame(docs, "doc_id long, text string"), "query", "score", "rank", "item_id").repartition(5)
    got = lexical_search.rank_documents(table, clash(spark.createDataFrame([*items, items[0]], "item_id long, text string"), "query", "doc_id"), k)
    assert sorted((tuple(x) for x in got.collect()), key=str) == naive_search(docs, items, k)


def test_search_odd_cases(spark):
    items = spark.createDataFrame([(1, "the cat"), (2, "Lorem"), (3, "id"), (3, "123")], "item_id long, text string")
    rows = sorted((tuple(r) for r in lexical_search.rank_documents(odd_docs(spark), items).select("item_id", "rank", "doc_id").collect()), key=str)
    assert rows == [(1, 1, 1), (1, 2, 1), (1, 3, 6), (2, 1, 5), (3, 1, 7), (3, 1, None)]
    assert lexical_search.rank_documents(empty(spark), items).count() == 0
    assert lexical_search.rank_documents(odd_docs(spark), items.limit(0)).count() == 0


def test_batches_for_python_are_bounded(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"mb": [b.nbytes / 1e6]})

    def most():
        wide = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("word "), 2000).alias("text"))
        return wide.mapInArrow(sizes, "mb double").agg(F.max("mb")).first()[0]

    session = spark.conf.getAll.get(common.BATCH_KEY)
    try:
        spark.conf.unset(common.BATCH_KEY)
        common.shared_dir(spark)
        assert most() < 6
        spark.conf.set(common.BATCH_KEY, "16m")  # a session's own size stays
        common.shared_dir(spark)
        assert 10 < most() < 18
    finally:
        spark.conf.unset(common.BATCH_KEY) if session is None else spark.conf.set(common.BATCH_KEY, session)
