"""The whole run against a plain version of its five stages."""

from __future__ import annotations

import re
import sys
from collections import Counter

import corpus_pipeline
import duckdb
import pytest

from chronolith.llm import pieces, queries, secrets, sql

from .conftest import SCHEMA, prose
from .test_near_dedup import groups

SF = "/root/testdata/sf0.001"


def plain(rows):
    """doc_id and pieces of documents, stage by stage, in Python and SQL."""
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
    kept = {i for i, k in con.execute(f"select doc_id, kept from ({sql.OP10})").fetchall() if k}
    rows = [r for r in rows if r[0] in kept]
    least = {i: c for i, _, c in groups(rows, 5, 80)}
    rows = [r for r in rows if least[r[0]] == r[0]]
    looked = [secrets.looked_at(t) for _, t, *_ in rows]
    seen = [c for _, cs in looked for c in cs]
    found = iter(secrets.discoveries([e - s for s, e, _ in seen], [p for *_, p in seen]))
    spans = [base + [(s, 3, e) for s, e, _ in cs if next(found)] for base, cs in looked]
    rows = [(i, secrets.redacted(t, x), *rest) for (i, t, *rest), x in zip(rows, spans, strict=True)]
    con.execute("delete from documents")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
    copies = dict(con.execute(sql.MIX.format(docs="documents") + "select doc_id, copies from mixed").fetchall())
    m = pieces.model()
    return Counter((i, tuple(pieces.encode([t], [i], m)[0].tolist())) for i, t, *_ in rows for _ in range(copies[i]))


def test_run_agrees_with_a_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = corpus_pipeline.run(spark, SF).collect()
    assert all(r["lossless"] for r in got)
    assert Counter((r["doc_id"], tuple(r["pieces"])) for r in got) == plain(rows)


def test_stages_keep_columns_and_pass_odd_tables(spark, messy, nothing):
    docs = messy.drop("n_words", "KEPT")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, nothing.drop("n_words", "KEPT"), SF)
        assert out.count() == 0, name
        out = stage(spark, docs, SF)
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns
        out.count()


def test_secrets_are_gone_and_lengths_counted(spark):
    text = prose(60, 1) + " password = hunter2hunter2 " + prose(5, 2)
    row = corpus_pipeline.mask_secrets(spark, spark.createDataFrame([(1, text, "en", "s", 1, None, None)], SCHEMA).drop("n_words", "KEPT"), SF).first()
    assert "hunter2" not in row["text"] and row["n_chars"] == len(row["text"]) and re.search(r"\[secret\]", row["text"])


def test_long_texts_reach_python_in_small_batches(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    look, encode = secrets.looked_at, pieces.encode

    def looked_at(text):
        assert sys._getframe(1).f_locals["batch"].nbytes < 4 << 20, "a batch of many texts"
        return look(text)

    def watched(*given):
        assert sys._getframe(1).f_locals["whole"].nbytes < 4 << 20, "a batch of many texts"
        return encode(*given)

    monkeypatch.setattr(secrets, "looked_at", looked_at)
    monkeypatch.setattr(pieces, "encode", watched)
    base = prose(6000, 3)
    docs = spark.createDataFrame([(i, f"{i} {base}", "en", "s", 1, None, None) for i in range(250)], SCHEMA).drop("n_words", "KEPT").coalesce(1)
    assert sum(len(r["text"]) for r in docs.collect()) > 6 << 20
    before = spark.conf.get(key, None)
    try:
        for stage in (corpus_pipeline.mask_secrets, corpus_pipeline.encode_pieces):
            spark.conf.unset(key)
            assert len(stage(spark, docs, SF).collect()) == 250
        spark.conf.set(key, 1 << 20)
        corpus_pipeline.encode_pieces(spark, docs, SF)
        assert spark.conf.get(key) == str(1 << 20), "the session's own bound goes first"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want
