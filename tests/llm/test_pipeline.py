"""The pipeline's stages against what they promise, and the registered queries against SQL."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
from landgrid.llm import queries as Q
from landgrid.llm import jaccard_join

from .test_operators import check_shards, odd_docs, empty, waterfall


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(name, spark, sf_dir, duck, same_rows):
    same_rows(Q.QUERIES[name](spark, sf_dir), duck, Q.ORACLE_SQL[name])


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    out["documents"] = docs.collect()
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("p") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
        if name != P.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return out


def test_language_stage_keeps_what_has_letters(stages):
    want = {r.doc_id for r in stages["documents"] if r.text and any(map(str.isalpha, r.text))}
    assert {r.doc_id for r in stages["language_id"]} == want


def five_word_sets(rows):
    words = [(r.text or "").encode().lower().split() for r in rows]
    return [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]


def near_groups(rows):
    """Index of the least row that each row reaches over pairs with a Jaccard similarity of 0.8; texts without words are one group."""
    sets, root = five_word_sets(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if not sets[i] and not sets[j] or sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return root


def test_near_duplicate_stage_keeps_one_of_each_group(stages):
    rows = sorted(stages["language_id"], key=lambda r: r.doc_id)
    root = near_groups(rows)
    assert len(set(root)) < len(rows)
    assert sorted(r.doc_id for r in stages["near_duplicates"]) == [rows[i].doc_id for i in sorted(set(root))]


@pytest.mark.parametrize("paired", [64, 3])
def test_near_duplicates_equal_brute_force(spark, sf_dir, monkeypatch, paired):
    """Recall of edited copies is whole, whether buckets are compared pairwise or in tiles."""
    monkeypatch.setattr(jaccard_join, "MAX_PAIRED", paired)
    r, rows = random.Random(9), []
    for k in range(40):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([8, 60, 400]))]
        for _ in range(12 if k % 8 == 0 else 3):
            rate = r.choice([0, 0.005, 0.01, 0.02, 0.06])
            rows.append((len(rows), " ".join(f"x{r.random()}" if r.random() < rate else w for w in base), "en", "a", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [x.doc_id for x in P.near_duplicate_stage(spark, docs, sf_dir).collect()]
    assert sorted(kept) == sorted(set(near_groups(docs.collect()))) and 40 < len(kept) < len(rows)


def test_near_duplicates_of_one_large_group(spark, sf_dir):
    """300 texts, each 10 percent of a common one edited: no two buckets are small, and clean texts stay."""
    r, rows = random.Random(4), []
    base = [f"w{i}" for i in range(300)]
    for i in range(300):
        at = r.randrange(270)
        rows.append((i, " ".join([*base[:at], *(f"e{i}x{k}" for k in range(12)), *base[at + 12:]]), "en", "a", 1))
    rows += [(1000 + i, " ".join([*base[:100], *(f"o{i}x{k}" for k in range(200))]), "en", "a", 1) for i in range(150)]  # a third in common
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(x.doc_id for x in P.near_duplicate_stage(spark, docs, sf_dir).collect())
    assert kept == [0, *range(1000, 1150)]


def test_near_duplicates_of_a_boilerplate_family(spark, sf_dir):
    """3,000 pages of one boilerplate, five of 300 words edited each: most pairs are below 0.8, and no link of 0.8 may be lost or made up."""
    r, base, rows, edits = random.Random(8), [f"w{i}" for i in range(300)], [], []
    for i in range(3000):
        at = sorted(r.sample(range(300), 5))
        page = base[:]
        for k in at:
            page[k] = f"e{i}x{k}"
        edits.append({s for k in at for s in range(max(0, k - 4), min(296, k + 1))})  # the shingles that an edit changes; no two pages share one
        rows.append((i, " ".join(page), "en", "a", 1))
    root = list(range(3000))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    changed = np.zeros((3000, 296), np.int32)
    for i, e in enumerate(edits):
        changed[i, list(e)] = 1
    same = (1 - changed) @ (1 - changed).T
    for i, j in zip(*np.nonzero(np.triu(100 * same >= 80 * (592 - same), 1)), strict=True):
        a, b = sorted((top(int(i)), top(int(j))))
        root[b] = a
    want = sorted({top(i) for i in range(3000)})
    assert 300 < len(want) < 2900
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(x.doc_id for x in P.near_duplicate_stage(spark, docs, sf_dir).collect()) == want


def test_edited_copies_of_equal_and_null_ids(spark, sf_dir):
    text = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*text, extra]), "en", "a", 1) for i in (None, 7, 8) for extra in ("one", "two", "three") if (i, extra) != (8, "one")]
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [x.doc_id for x in P.near_duplicate_stage(spark, make(rows), sf_dir).collect()] == [7]
    assert P.near_duplicate_stage(spark, make(rows[:3]), sf_dir).count() == 1


def test_decontamination_stage(stages, duck):
    bad = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({Q.ORACLE_SQL['op10_decontaminate']}) WHERE contaminated").fetchall()}
    assert sorted(r.doc_id for r in stages["decontamination"]) == sorted(r.doc_id for r in stages["near_duplicates"] if r.doc_id not in bad)


def test_mixing_stage(stages):
    size = lambda r: len(r.text.encode().split())
    have, took, times = {}, {}, {}
    for r in stages["decontamination"]:
        have[r.source] = have.get(r.source, 0) + size(r)
    for r in stages["mixing"]:
        took[r.source] = took.get(r.source, 0) + size(r)
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 2
    for s, t in waterfall(have).items():
        least = min(size(r) for r in stages["decontamination"] if r.source == s)
        assert abs(took.get(s, 0) - t) <= max(0.02 * t, least)  # sources of a few documents come no nearer than these allow


def test_sharding_stage(stages):
    check_shards(stages["sharding"], len(stages["mixing"]), 8)


def test_stages_on_odd_and_empty_tables(spark, sf_dir):
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=lambda x: (x is None, x))
    docs, every = odd_docs(spark), [1, 1, 2, 3, 4, 5, 6, 7, 8, None]
    assert ids(P.language_stage(spark, docs, sf_dir)) == [1, 1, 5, 6, 8, None]
    assert ids(P.decontamination_stage(spark, docs, sf_dir)) == every
    mixed = P.mixing_stage(spark, docs, sf_dir)
    assert mixed.columns == docs.columns and all(n <= 2 * every.count(i) for i, n in Counter(r.doc_id for r in mixed.collect()).items())
    assert ids(P.sharding_stage(spark, docs, sf_dir)) == every
    for _, stage in P.STAGES:
        assert stage(spark, empty(spark), sf_dir).count() == 0


def test_near_duplicate_stage_on_odd_rows(spark, sf_dir):
    kept = [r.doc_id for r in P.near_duplicate_stage(spark, odd_docs(spark), sf_dir).collect()]
    assert sorted(kept, key=lambda x: (x is None, x)) == [1, 2, 5, 7, 8, None]


def test_near_duplicate_stage_keeps_one_row_of_equal_or_null_ids(spark, sf_dir):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"{words} {case}", "en", "a", 1) for i in (None, 7) for case in (words, words.upper(), words.title())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [x.doc_id for x in P.near_duplicate_stage(spark, docs, sf_dir).collect()] == [7]
    assert P.near_duplicate_stage(spark, docs.where("doc_id is null"), sf_dir).count() == 1


def test_run(spark, sf_dir, stages):
    assert P.run(spark, sf_dir).count() == len(stages["sharding"])
