"""Operators and pipeline stages on tables with nulls, ties, repeats and nothing at all."""

import re
import textwrap
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entries
import corpus_pipeline
import oracle
from stacktally.llm import (
    chat, decontam, html, licenses, near_dup, packing, pii, quality, sharding, toxicity,
)
from stacktally.llm.common import components
from stacktally.llm.queries import oracle_sql, queries

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, shard int, pii int"
LONG = " ".join(f"word{i}" for i in range(3000))
PASSAGE = " ".join(f"bench{i}" for i in range(30))
BASE = " ".join(f"tion{i}" for i in range(120))
ROWS = [
    (1, BASE, "en", "a", 1, "k", 0, 0),
    (2, BASE, None, None, None, None, None, None),
    (3, BASE.replace("tion7 ", "other "), "en", "a", 1, "k", 0, 0),
    (4, " ".join(BASE.split()[60:] + BASE.split()[:60]), "en", "a", 1, "k", 0, 0),
    (5, None, "en", "a", None, "k", 0, 0),
    (6, "", "en", "a", 0, "k", 0, 0),
    (6, "", "en", "a", 0, "k", 0, 0),
    (None, LONG, "en", "a", 1, "k", 0, 0),
    (None, LONG, "en", "a", 1, "k", 0, 0),
    (9, f"{LONG[:400]} mail joe@x.example.com {PASSAGE} 10.1.2.3", "en", "a", 1, "k", 0, 0),
    (10, "Released under the MIT License.\n" + " ".join(f"en{i}" for i in range(60)), "en", "a", 1, "k", 0, 0),
    (11, " ".join(PASSAGE.split()[15:] + ["x"] + PASSAGE.split()[:15]) + " " + LONG[2000:2500], "en", "a", 1, "k", 0, 0),
]
TOKENS = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (2, None), (3, ""), (None, "a b")], "item_id bigint, text string")


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (8, 9), (9, 7), (5, 5)], "u int, v int")
    found = {r["node"]: r["comp"] for r in components(edges, "t").collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7}


def test_quality(docs, nothing):
    ledger = quality.ledger(docs)
    assert ledger.count() == len(ROWS) and quality.ledger(nothing).count() == 0
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 9, 10, 11]
    masks = [r["fail_bits"] for r in ledger.collect()]
    for row in quality.ablations(ledger).collect():
        policy = next(p for p in quality.POLICIES if p.version == row["policy"])
        bit = 1 << [r.name for r in quality.RULES].index(row["rule"])
        assert row["rejected"] == sum(bool(m & policy.mask) for m in masks)
        assert row["failed_rule"] == sum(bool(m & bit) for m in masks)
        assert row["rejected_only_by_rule"] == sum(m & policy.mask == bit for m in masks)


def test_near_duplicates(docs, nothing):
    found = near_dup.near_duplicates(docs).collect()
    assert len(found) == len(ROWS) and near_dup.near_duplicates(nothing).count() == 0
    classes = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in found}
    assert classes[1] == classes[2] == classes[3] == (1, 3)
    assert classes[4] == (4, 1)  # same words, other order: far in edit distance
    assert classes[5] == classes[6] == (5, 3) and classes[None] == (None, 2)
    kept = near_dup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 9, 10, 11]
    assert near_dup.keep_first(nothing).count() == 0


def test_near_duplicates_against_all_pairs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    words = {r["doc_id"]: near_dup.words_of(r["text"]) for r in rows}
    ids = sorted(words)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]
             if min(len(words[a]), len(words[b])) >= 0.8 * max(len(words[a]), len(words[b]))]
    distances = near_dup.edit_distances([(words[a], words[b]) for a, b in pairs])
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), d in zip(pairs, distances):
        if d >= 0:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs).collect()}
    assert found == {i: root(i) for i in ids}


def test_a_hot_group_of_near_copies_is_one_class(spark):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in enumerate(rng.integers(0, 150, 300))]
    rows += [(1000 + i, " ".join([f"q{i}_{j}" for j in range(150)] + ["common line"] * 9)) for i in range(100)]
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    sizes = sorted(r["count"] for r in found.groupBy("class_id").count().collect())
    assert sizes == [1] * 100 + [300]


def test_scattered_edits_are_found_by_edit_similarity(spark, sf_dir):
    """One row per pair; pairs at similarity 0.9, 0.85 and 0.82 by edits drawn over the whole text."""
    rng = np.random.default_rng(11)
    table = sf_dir.replace(sf_dir.rsplit("/", 1)[1], "sf0.01")
    texts = [r["text"] for r in spark.read.parquet(f"{table}/documents.parquet").limit(400).collect()]
    words = [x for x in map(near_dup.words_of, texts) if 100 <= len(x) <= 400][:120]
    rows, pairs = [], []
    for i, x in enumerate(words):
        for j, share in enumerate((0.1, 0.15, 0.18)):
            own = [f"{y}z{i}z{j}" for y in x]  # pairs have nothing in common with other pairs
            copy = list(own)
            for at in rng.choice(len(own), int(share * len(own)), replace=False):
                copy[at] = f"new{at}"
            pairs.append((own, copy, j))
            rows += [(2 * len(pairs), " ".join(own)), (2 * len(pairs) + 1, " ".join(copy))]
    assert all(d >= 0 for d in near_dup.edit_distances([(a, b) for a, b, _ in pairs]))
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    size = {r["doc_id"]: r["class_size"] for r in found.collect()}
    recall = [np.mean([size[2 * n] == 2 for n, p in enumerate(pairs, 1) if p[2] == j]) for j in range(3)]
    assert recall[0] == 1 and recall[1] > 0.97 and recall[2] > 0.9, recall


def test_texts_that_repeat_one_phrase_meet(spark):
    rows = []
    for i in range(20):
        for side in "ab":
            own = [f"{side}{i}_{j}" for j in range(30)]
            rows.append((len(rows), " ".join(own + [f"one{i} two{i} three{i}"] * 100)))
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r["count"] for r in found.groupBy("class_id").count().collect()) == [2] * 20


def test_decontamination(docs, nothing, benchmark):
    found = decontam.contaminated(docs, benchmark)
    assert sorted((r["doc_id"], r["item_id"], r["n_tiles"]) for r in found.collect()) == [(9, 1, 1), (11, 1, 2)]
    clean = decontam.keep_clean(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == len(ROWS) - 2
    assert decontam.contaminated(nothing, benchmark).count() == 0
    assert decontam.keep_clean(docs, benchmark.limit(0)).count() == len(ROWS)


def test_personal_data(docs, nothing):
    found = {r["doc_id"]: r["pii"] for r in pii.find(docs, None).collect()}
    assert found[9]["n_email"] == 1 and found[9]["n_ip"] == 1 and found[5]["spans"] == ""
    scrubbed = pii.scrub(docs, pii.train(docs, steps=3))
    assert scrubbed.columns == docs.columns and scrubbed.schema == docs.schema
    texts = {r["doc_id"]: r for r in scrubbed.collect()}
    assert "[EMAIL]" in texts[9]["text"] and texts[9]["n_chars"] == len(texts[9]["text"])
    assert texts[5]["text"] is None and len(texts) == len({r[0] for r in ROWS})
    assert pii.train(nothing) is None and pii.find(nothing, None).count() == 0


def test_packing(docs, nothing):
    pieces = packing.pack(docs.repartition(3, "doc_id", "text"), TOKENS, size=256, open_windows=4).collect()
    parts, windows = {}, {}
    encoder = packing.Encoder(TOKENS)
    for p in pieces:
        parts.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for window in windows.values():
        at = 0
        for offset, length in sorted(window):
            assert offset == at
            at += length
        assert at <= 256
    texts = {}
    for doc_id, text, *_ in ROWS:
        texts.setdefault(doc_id, []).append(text or "")
    assert sum(p["length"] for p in pieces) == sum(
        len(encoder.encode(t)) // 4 + 1 for ts in texts.values() for t in ts
    )
    ids = np.frombuffer(encoder.encode(BASE), "<u4").tolist() + [2]
    for p in parts[(1, len(ids))]:
        cut = np.array(ids[p["start"] : p["start"] + p["length"]], dtype="<u4")
        assert zlib.crc32(cut.tobytes()) == p["ids_crc32"]
    # each of the three partitions leaves one open window at most
    assert sum(sum(n for _, n in w) < 240 for w in windows.values()) <= 3
    assert packing.pack(nothing, TOKENS).count() == 0


def test_toxicity(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (4, 0)], "doc_id bigint, toxic int")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    assert scored.count() == len(ROWS)
    assert scored.filter("toxicity.score IS NULL OR toxicity.score < 0 OR toxicity.score > 1").count() == 0
    model = toxicity.train(nothing, labels.limit(0))
    assert [r[0] for r in toxicity.score(docs, model).select("toxicity.score").distinct().collect()] == [0.0]


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").filter(toxicity.held_out())
    rows = scored.select("toxic", (F.col("toxicity.score") >= 0.5).cast("int").alias("p")).collect()
    assert sum(r["toxic"] == r["p"] for r in rows) / len(rows) > 0.95
    toxic = [r for r in rows if r["toxic"]]
    assert sum(r["p"] for r in toxic) / len(toxic) > 0.9


def test_training_reads_whole_texts(spark, monkeypatch):
    clean = " ".join(f"word{i % 50}" for i in range(9_000))  # over 40,000 characters
    rows = [(i, f"{clean} {'vile' if i % 2 else 'kind'}") for i in range(1, 21)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, toxic int")
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: (texts, toxic))
    texts, toxic = toxicity.train(docs, labels)
    assert texts and all(t.endswith("vile" if x else "kind") for t, x in zip(texts, toxic))


def test_only_groups_over_a_quota_are_cut(spark):
    rows = [(i, "same" if i < 80 else f"t{i}") for i in range(300)]
    rows = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sharding.shard(rows, 3).filter("doc_id < 80").select("shard").distinct().count() == 1
    rows = rows.withColumn("text", F.when(F.col("doc_id") < 250, "same").otherwise(F.col("text")))
    assert sharding.shard(rows, 3).filter("doc_id < 250").select("shard").distinct().count() == 3


@pytest.mark.parametrize("shards", [3, 40])
def test_sharding(docs, nothing, shards):
    rows = sharding.shard(docs, shards).collect()
    sizes = [sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(shards)]
    assert all(slots == list(range(len(slots))) for slots in sizes)
    assert max(map(len, sizes)) - min(map(len, sizes)) <= 1 and sum(map(len, sizes)) == len(ROWS)
    assert {r["doc_id"]: r["size"] for r in rows}[5] == 16
    assert sharding.shard(nothing, shards).count() == 0


def test_copies_stay_together_and_a_giant_group_is_split(spark):
    rows = [(i, f"group {i % 50}") for i in range(300)] + [(1000 + i, "giant") for i in range(400)]
    rows += [(3000 + i, f"single {i}") for i in range(500)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string"), 10, rounds=8).collect()
    shards = {}
    for r in found:
        shards.setdefault(r["text_crc32"], set()).add(r["shard"])
    whole = sum(len(shards[zlib.crc32(f"group {g}".encode())]) == 1 for g in range(50))
    assert whole >= 45 and len(shards[zlib.crc32(b"giant")]) <= 8
    assert sorted({sum(r["shard"] == s for r in found) for s in range(10)}) == [120]


def test_html_and_licenses(spark, docs, nothing):
    pages = spark.createDataFrame([(1, None, 0), (1, None, 0), (2, "<p>a", 1)], "page_id int, html string, extracted int")
    assert [r["extracted"]["text"] for r in html.extract(pages).orderBy("page_id").collect()] == ["", "", "a"]
    found = licenses.scan(docs).collect()
    assert [(r["doc_id"], r["line"], r["license"], r["dice"]) for r in found] == [(10, 0, "MIT", 1.0)]
    assert licenses.scan(nothing).count() == 0


def _slow_licenses(texts, dice=licenses.DICE):
    """Every window of every text against every template, as the docstring of ``scan`` says."""
    out = {}
    for doc_id, text in texts:
        lines = [re.findall(r"[^\W_]+", line.lower()) for line in (text or "").split("\n")]
        words = [(word, n) for n, line in enumerate(lines) for word in line]
        grams = [f"{a} {b}" for (a, _), (b, _) in zip(words, words[1:])]
        for t in licenses.prepare(dice=dice):
            own, wins = set(t.bigrams), []
            for s in range(len(grams)):
                scores = [
                    (2.0 * len(g & own) / (len(g) + len(own)), -e)
                    for e in range(s, min(s + t.longest, len(grams))) for g in [set(grams[s:e + 1])]
                    if grams[s] in own and grams[e] in own
                ]
                if scores and max(scores)[0] >= dice:
                    wins.append((max(scores)[0], s, -max(scores)[1]))
            for d, s, e in wins:
                if not any(s2 <= e and e2 >= s and (d2 > d or d2 == d and s2 < s) for d2, s2, e2 in wins):
                    key = (doc_id, words[s][1], t.license)
                    out[key] = max(out.get(key, 0), round(d, 6))
    return out


def test_licenses_in_windows(spark):
    """Wrapped, inline, within a whole licence, repeated, with other words between, nearly there."""
    mit = next(text for name, text in licenses.TEMPLATES if len(text) > 300 and name == "MIT")
    prose = " ".join(f"word{i} of the software" for i in range(40))
    texts = [
        (1, f"MIT License\n\nCopyright (c) 2020 Joe\n\n{textwrap.fill(mit, 76)}\n\nThe above copyright notice\n{prose}"),
        (2, f"{prose}. It is released under the MIT License. {prose}"),
        (3, f"{prose}\n# Released under\n# the MIT\n# License.\n{prose}"),
        (4, "Licensed under CC BY 4.0.\nLicensed under CC BY 4.0.\nLicensed under CC BY-SA 4.0."),
        (5, "Licensed under the very Apache License, Version 2.0"),
        (6, "Released under mit the License under"), (7, None), (8, ""), (9, "license"), (None, "Licensed under CC BY 4.0."),
        (10, "Released under the MIT License. " * 30),
    ]
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, line int")
    found = {(r["doc_id"], r["line"], r["license"]): r["dice"] for r in licenses.scan(docs).collect()}
    assert found == _slow_licenses(texts)
    assert found[1, 4, "MIT"] == found[2, 0, "MIT"] == found[3, 1, "MIT"] == 1.0
    assert {k for k in found if k[0] == 4} == {(4, 0, "CC-BY-4.0"), (4, 1, "CC-BY-4.0"), (4, 2, "CC-BY-SA-4.0")} | {
        k for k in found if k[0] == 4 and found[k] < 1
    }
    assert licenses.scan(docs, templates=()).count() == 0
    assert licenses.scan(docs.limit(0)).count() == 0


def test_chat(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "A"), (1, 0, "user", "hi"), (1, 1, "assistant", "B"),
        (2, None, None, None), (3, None, None, None), (4, 1, "user", "x"), (4, 1, "user", "x"), (None, 1, "user", "x"),
    ]
    sides = chat.neighbours(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    found = {r["pair_id"]: r for r in chat.format_pairs(sides).collect()}
    first = found[0]
    assert first["n_prefix"] == 1 and first["prompt"] == "<|user|>\nhi<|end|>\n"
    (start, end), = first["chosen_mask"]
    assert first["chosen"][start:end] == "A<|end|>"
    (start, end), = first["rejected_mask"]
    assert first["rejected"][start:end] == "B<|end|>"
    assert found[1]["n_prefix"] == 1 and found[1]["chosen"] == found[1]["rejected"] == ""
    assert found[2]["rejected"] == "" and found[2]["prompt"] == "" and set(found) == {0, 1, 2}
    assert chat.format_pairs(sides.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_match_sql(spark, sf_dir, name):
    oracle.compare(queries()[name](spark, sf_dir), oracle.connect(sf_dir), oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_other_queries_run(spark, sf_dir, name):
    result = queries()[name](spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    if name.split("_")[0] in ("op1", "op4", "op6", "op7"):
        assert result.count() == n
    else:
        assert result.count() > 0


def test_pipeline_stages(spark, docs, nothing, sf_dir):
    for start in (docs, nothing):
        at = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, sf_dir)
            assert at.columns == start.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, at, sf_dir)
        ids = {r["doc_id"] for r in packed.collect()}
        assert ids == ({None, 1, 4, 9, 10, 11} if start is docs else set())


def test_registered(spark):
    names = [n for n in entries.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entries.queries() and Path(corpus_pipeline.__file__).parent == Path(entries.__file__).parent
