"""The pipeline's stages in order, and the queries' agreement with their operators."""

from __future__ import annotations

import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from test_operators import brute_contamination, plain_fingerprint, text_of
from tokenizers import Tokenizer

from anvaya.llm import quality, queries, secrets

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "best_fit_packing",
    ]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns
        now = docs.count()
        assert 0 < now <= before
        before = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == before
    assert corpus_pipeline.run(spark, SMALL).count() == packed.count()


def test_names():
    names = set(queries.queries())
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 11)} | {"pipeline"}
    assert set(queries.oracle_sql()) <= names


COLUMNS = ["doc_id", "text", "n_chars", "keep", "_rated", "rated", "identity", "text_hash", "doc", "fp", "salt", "length", "_fp"]
SCHEMA = ", ".join(f"{c} string" if c not in ("doc_id", "n_chars") else f"{c} long" for c in COLUMNS)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of odd documents, ratings and a benchmark, and the documents as a list."""
    rng = random.Random(31)
    item = " ".join(rng.choices(["north", "wind", "cold", "winter", "stone", "river", "plain", "ship"], k=30))
    texts = [text_of(rng, 80) for _ in range(12)] + ["", None, " \n", "word", "x" * 20_000, text_of(rng, 2500) + " " + " ".join(item.split()[4:18]), item]
    texts += [f"{text_of(rng, 30)} password=abcdefgh1234 {text_of(rng, 30)}"]
    rows = [(n, t) for n, t in enumerate(texts)] + [(0, texts[0]), (50, texts[1]), (3, texts[4]), (None, texts[5]), (None, texts[5]), (None, None), (None, text_of(rng, 50))]
    rows = [(i, t, len(t or ""), *["z"] * (len(COLUMNS) - 3)) for i, t in rows]
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(n, 1, 0) for n in range(12)] + [(None, 1, 1), (15, 0, 0), (15, 0, 0), (16, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "word"), (None, ""), (3, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, [(1, item), (2, "word"), (None, ""), (3, None)]


def representatives(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min(group[k] for k, g in enumerate(fps) if (f ^ g).bit_count() <= 2) for f in fps]
    kept = []
    for g in sorted(set(group)):
        own = [rows[k] for k in range(len(rows)) if group[k] == g]
        named = [r for r in own if r[0] is not None]
        least = min((r[0] for r in named), default=None)
        kept.append({r for r in own if r[0] == least})
    return kept


def test_stages_brute(spark, odd):
    folder, rows, items = odd
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    features = quality.Features(quality.BINS)
    plain = [r[:2] for r in rows if 1 / (1 + np.exp(model.thresholds[1] - model.score(features.of(r[1])))) >= 0.5]
    stages = dict(corpus_pipeline.STAGES)
    found = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    docs = stages["quality_classifier"](spark, docs, folder)
    assert docs.columns == COLUMNS and found(docs) == sorted(plain, key=str)
    docs = stages["simhash_near_dedup"](spark, docs, folder)
    got, groups = found(docs), representatives(plain)
    assert docs.columns == COLUMNS and len(got) == len(groups) and all(sum(r in g for r in got) == 1 for g in groups)
    plain = [r for r, c in zip(got, [brute_contamination([r], items, 13)[0] for r in got]) if not c[5] and not c[6]]
    docs = stages["benchmark_decontamination"](spark, docs, folder)
    assert docs.columns == COLUMNS and found(docs) == sorted(plain, key=str) and len(plain) < len(got)
    docs = stages["secret_scan"](spark, docs, folder)
    plain = [(i, t if t is None else secrets.redacted(t)) for i, t in plain]
    assert docs.columns == COLUMNS and found(docs) == sorted(plain, key=str)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in docs.collect())
    assert not any("abcdefgh1234" in (t or "") for _, t in plain)
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in plain:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, at // 4096, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], dtype="<u4").tobytes())) for at in range(0, len(ids), 4096)]
    columns = ["doc_id", "piece", "length", "ids_crc32"]
    assert sorted((tuple(r) for r in stages["best_fit_packing"](spark, docs, folder).select(columns).collect()), key=str) == sorted(want, key=str)
    assert sorted((tuple(r) for r in corpus_pipeline.run(spark, folder).select(columns).collect()), key=str) == sorted(want, key=str)


def test_stages_on_no_rows(spark, odd):
    folder, _, _ = odd
    none = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
