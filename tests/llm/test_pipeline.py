from pyspark.sql import functions as F

import corpus_pipeline as p
from framelake.llm import langid, words
from framelake.llm.queries import tokenizer

from . import plain


def test_every_stage_against_a_plain_version(spark, tmp_path):
    plain.docs(spark).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = list(p.COLUMNS)

    got = p.known_language(spark, docs, str(tmp_path))
    assert got.columns == columns
    shown = {r["doc_id"]: r["lang_pred"] != "und" and r["score"] >= 0.2 * len(r["text"] or "") / (len(r["text"] or "") + 200) for r in langid.annotate(docs, langid.fit(docs)).collect()}
    assert {r["doc_id"] for r in got.collect()} == {i for i, good in shown.items() if good}

    rows = plain.rows_of(got)
    _, group = plain.classes(rows, 5, 80)
    first = {}
    for (i, _), g in zip(rows, group):
        first[g] = min(first.get(g, i), i)
    one = p.one_of_each(spark, got, str(tmp_path))
    assert one.columns == columns and sorted(r["doc_id"] for r in one.collect()) == sorted(first.values())

    rows = plain.rows_of(one)
    left = p.without_repeats(spark, one, str(tmp_path))
    want = {i: kept.decode("utf-8", "ignore") for i, _, _, _, _, kept in plain.byte_repeats(rows)}
    assert left.columns == columns and {r["doc_id"]: r["text"] for r in left.collect()} == want

    tok = words.load(tokenizer("byte_bpe_50k.json"))
    packed = p.run(spark, str(tmp_path)).collect()
    tokens = {}
    for r in packed:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
    assert tokens == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}


def test_awkward_tables(spark, tmp_path):
    """Null ids, repeated rows and ids, clashing columns; no language at all; no rows."""
    tok = words.load(tokenizer("byte_bpe_50k.json"))
    tables = {"all": plain.docs(spark), "unnamed": plain.docs(spark).withColumn("lang", F.lit(None).cast("string")), "none": plain.docs(spark).limit(0)}
    for name, docs in tables.items():
        folder = str(tmp_path / name)
        docs.coalesce(1).write.parquet(f"{folder}/documents.parquet")
        left = spark.read.parquet(f"{folder}/documents.parquet")
        if name == "unnamed":
            assert p.known_language(spark, left, folder).count() == left.count()
        for _, stage in p.STAGES[:-1]:
            left = stage(spark, left, folder)
        want = sorted(len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in left.collect())
        got = p.run(spark, folder).collect()
        assert sum(r["length"] for r in got) == sum(want) and sum(r["piece"] == 0 for r in got) == len(want)
        assert bool(want) == (name != "none") and (not want or any(r["doc_id"] is None for r in got))


def test_one_row_of_each_class_stays(spark):
    rows = plain.rows_of(plain.docs(spark))
    left = plain.rows_of(p.one_of_each(spark, plain.docs(spark), ""))
    sets, group = plain.classes(rows, 5, 80)
    wordless = sum(not s for s in sets)
    assert len(left) == wordless + len({g for g, s in zip(group, sets) if s})
