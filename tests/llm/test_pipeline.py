"""The pipeline's stages on a small corpus, each held against what it must keep and drop."""

import random

import pytest

import __spark_entry__
import corpus_pipeline
from relift.llm.tokens import Encoder

from .conftest import prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    at = str(tmp_path_factory.mktemp("sf"))
    passage, item = prose(rng, 80), prose(rng, 30) + ". " + prose(rng, 6) + "."
    rows = {i: prose(rng, rng.randint(60, 200)) for i in range(300)}
    toxic = set(range(0, 300, 7))
    for i in toxic:
        rows[i] += " " + rng.choice(["you idiot", "such a clown"]) + " " + prose(rng, 5)
    copies = {400 + k: rows[k + 1] for k in range(5)}
    near = {420 + k: rows[k + 9].replace(" ", " changed ", 1) for k in range(3)}
    repeats = {440 + k: prose(rng, 40) + " " + passage + " " + prose(rng, 40) for k in range(3)}
    leaks = {460 + k: prose(rng, 20) + " " + item + " " + prose(rng, 20) for k in range(2)}
    rows |= copies | near | repeats | leaks | {480: "", 481: None}
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, prose(rng, 25))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, toxic, copies, near, repeats, leaks


def test_stages(spark, folder):
    at, rows, toxic, copies, near, repeats, leaks = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "repeats", "benchmark", "packing"]
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kinds, kept = docs.schema.simpleString(), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, at).collect(), docs.schema)
        assert docs.schema.simpleString() == kinds
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(rows) - set(kept["toxicity"]) == toxic
    gone = set(kept["toxicity"]) - set(kept["near_copies"])
    assert gone == {i for i, t in (copies | near).items() if i in kept["toxicity"] and any(j in kept["toxicity"] for j in ([i - 399] if i in copies else [i - 411]))}
    assert set(kept["repeats"]) == set(kept["near_copies"])
    changed = {i for i, t in kept["repeats"].items() if t != rows[i]}
    assert set(repeats) - {440} <= changed and not changed - set(repeats) - set(leaks)
    assert set(kept["repeats"]) - set(kept["benchmark"]) >= {460} and not set(kept["repeats"]) - set(kept["benchmark"]) - set(leaks)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, at).collect()
    whole = {}
    for r in packed:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
    assert whole == {i: len(x) for i, x in zip(kept["benchmark"], Encoder().encode(list(kept["benchmark"].values()), 0), strict=True)}


def test_run_is_registered(spark, folder):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in __spark_entry__.oracle_sql()
    assert corpus_pipeline.run(spark, folder[0]).agg({"length": "sum"}).first()[0] > 0


def test_queries_return_the_promised_columns(spark, folder):
    want = {
        "op2_quality": ["doc_id", "held_out", "score", "predicted"],
        "op3_media": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        "op4_language": ["doc_id", "held_out", "lang_pred", "score"],
        "op5_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op6_tokenfile": ["doc_id", "start", "n_tokens", "ids_crc32"],
        "op7_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        "op8_neardup": ["doc_id", "n_shingles", "component_id", "kept"],
        "op9_suffix": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    }
    found = __spark_entry__.queries()
    for name, columns in want.items():
        df = found[name](spark, folder[0])
        assert df.columns[: len(columns)] == columns and df.count() >= len(folder[1])


def test_no_documents(spark, folder, tmp_path):
    import shutil

    at = str(tmp_path / "none")
    for name in ("labels", "benchmark"):
        shutil.copytree(f"{folder[0]}/{name}.parquet", f"{at}/{name}.parquet")
    spark.read.parquet(f"{folder[0]}/documents.parquet").where("doc_id < 0").write.parquet(f"{at}/documents.parquet")
    assert corpus_pipeline.run(spark, at).count() == 0


def test_scopes_remove_what_operators_write(spark, folder):
    from pathlib import Path

    from relift.llm import cdc, neardup, suffix
    from relift.llm.common import folder as shared
    from relift.llm.common import scope

    at, docs = Path(shared(spark).removeprefix("file://")), spark.read.parquet(f"{folder[0]}/documents.parquet")
    before, tables = set(at.iterdir()), spark.catalog.listTables()
    with scope(spark):
        assert neardup.near_duplicates(docs).count() == suffix.removals(docs).count() == docs.count() and cdc.removed(docs).count()
        assert set(at.iterdir()) > before
    assert set(at.iterdir()) == before and spark.catalog.listTables() == tables
