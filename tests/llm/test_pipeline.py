"""The pipeline's stages against brute-force versions, each on its own input."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import bottom_k, bpe_automaton, quality, secret_scan
from lodestone.llm.common import stored, table
from tests.llm.test_contracts import WORD, base_measures, byte_grams, grouped, shingle_set


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = table(spark, sf, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), name)
        out.append(docs)
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(stages):
    for df in stages[:-1]:
        assert df.columns == stages[0].columns


def test_quality_stage(spark, sf, stages):
    before, after = rows(stages[0]), rows(stages[1])
    good = {r["doc_id"] for r in table(spark, sf, "labels").where("quality = 1").collect()}
    raw, target = np.full(quality.BUCKETS, 0.5), np.full(quality.BUCKETS, 0.5)
    for i, r in before.items():
        for g in byte_grams(r["text"]):
            raw[g] += 1
            target[g] += i in good
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    for i, r in before.items():
        g = byte_grams(r["text"])
        score = ratio[g].mean() if g else 0.0
        if abs(score - quality.THRESHOLD) > 1e-6:
            assert (i in after) == (score >= quality.THRESHOLD and not base_measures(r["text"])[-1])
    assert all(after[i] == before[i] for i in after)


def test_dedup_stage(stages):
    before, after = rows(stages[1]), rows(stages[2])
    sets = {i: shingle_set(r["text"], 5) for i, r in before.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    of = grouped(links, sets)
    assert set(after) == {i for i in sets if of[i] == i}


def test_secrets_stage(stages):
    before, after = rows(stages[2]), rows(stages[3])
    assert set(before) == set(after)
    for i, r in after.items():
        text, spans = before[i]["text"], secret_scan.find(before[i]["text"] or "")
        inside = np.zeros(len(text), bool)
        for a, b, _ in spans:
            inside[a:b] = True
        assert WORD.findall("".join(c for c, k in zip(text, inside, strict=True) if not k)) is not None
        assert r["text"].replace("[SECRET]", "") == "".join(c for c, k in zip(text, inside, strict=True) if not k).replace("[SECRET]", "")
        assert r["n_chars"] == (len(r["text"]) if spans else before[i]["n_chars"])


def test_mix_and_encode_stages(stages):
    assert sorted(map(tuple, stages[3].collect()), key=str) == sorted(map(tuple, stages[4].collect()), key=str)
    lib = Tokenizer.from_file(bpe_automaton.default_path())
    mixed, out = rows(stages[4]), rows(stages[5])
    assert set(mixed) == set(out)
    for i, r in out.items():
        assert r["ids"] == lib.encode(mixed[i]["text"], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
    from lodestone.llm import mixing

    slot = {r["doc_id"]: (r["slot"], r["place"]) for r in mixing.schedule(stages[3]).collect()}
    order = [slot[r["doc_id"]] for r in sorted(out.values(), key=lambda r: (r["file"], r["block"], r["row"]))]
    assert order == sorted(order)


def test_run(spark, sf, stages):
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()) == sorted(rows(stages[5]))


def folder_of(spark, sf, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    table(spark, sf, "labels").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_run_on_an_empty_table(spark, sf, tmp_path):
    out = corpus_pipeline.run(spark, folder_of(spark, sf, tmp_path, table(spark, sf, "documents").limit(0)))
    assert out.count() == 0 and {"doc_id", "n_tokens", "ids"} <= set(out.columns)


def test_run_with_clashing_columns_nulls_and_long_texts(spark, sf, stages, tmp_path):
    names = ["ids", "n_tokens", "file", "block", "row", "_text", "_of", "_id", "_gone", "id", "a", "v", "doc", "_slot", "_key", "print", "of"]
    docs = table(spark, sf, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, None, "en", None, 0), (10**9 + 1, "", None, "s", None), (10**9 + 2, " ".join(f"word{i % 977}x{i}" for i in range(60_000)), "en", "s", 1)], docs.schema)
    docs = docs.union(odd)
    for n in names:
        docs = docs.withColumn(n, F.concat(F.lit(n), F.col("doc_id").cast("string")))
    out = corpus_pipeline.run(spark, folder_of(spark, sf, tmp_path, docs)).collect()
    assert out and all(r[n] == f"{n}{r['doc_id']}" for r in out for n in names)
    assert {r["doc_id"] for r in out if r["doc_id"] < 10**9} <= set(rows(stages[0]))


@pytest.mark.parametrize("hot", [1, 4, 12])
def test_hot_lists(spark, hot, monkeypatch):
    """Families of near copies around several texts, whose lists are nearly all hot."""
    import random

    rng = random.Random(hot)
    monkeypatch.setattr(bottom_k, "HOT", hot)
    docs, n = [], 0
    for _ in range(4):
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randint(0, 9)):
                w[rng.randrange(120)] = f"x{rng.randrange(9999)}"
            docs.append((n, " ".join(w)))
            n += 1
    sets = {i: shingle_set(t, 5) for i, t in docs}
    of = grouped([(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])], sets)
    got = {r["doc_id"]: r["component_id"] for r in bottom_k.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == of
