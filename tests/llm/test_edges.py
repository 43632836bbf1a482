"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from standmap.llm import decontaminate, hmm, line_dedup, piece_dropout, quality, secrets, sharding, simhash, substring_dedup, token_rollup
from standmap.llm.common import scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, hits string, failed_rule string, spans string, words string, `key` string, uid long, ids string"


def rows():
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    body = "one two three\nfour five six\nseven eight nine\n" + " ".join(f"k{i}" for i in range(60))
    texts = [None, "", " \n\t", long, body, body, body + " tail", "x" * 50_000, "é ▁ 日本 🎉\x00", 'password = "abcdef123"']
    out = [(i, t, None if i % 3 == 0 else "en", None if i == 2 else "s", None, "a", "b", "c", "d", "e", "f", 7, "g") for i, t in enumerate(texts)]
    return [*out, (None, body, *out[0][2:]), (None, None, *out[0][2:]), out[4], out[4]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "k1 k2 k3 k4 k5 k6 k7 k8 k9 k10 k11"), (2, None), (None, "one"), (3, ""), (4, "!!"), (5, "Eight; NINE")], "item_id long, text string")


def same_columns(a, b):
    assert a.columns == b.columns and a.dtypes == b.dtypes


def test_quality(docs, none):
    out = quality.keep_quality(docs)
    same_columns(out, docs)
    kept = [r.doc_id for r in out.collect()]
    assert sorted(x for x in kept if x is not None) == [4, 4, 4, 5, 6] and kept.count(None) == 1
    assert quality.keep_quality(none).count() == 0
    assert quality.quality_cascade(docs).where("doc_id = 0").first().failed_rule == "few_words"


def test_quality_order_changes_no_verdict(docs):
    one = quality.quality_cascade(docs, order=list(quality.RULES)).where("failed_rule is null").count()
    assert one == quality.quality_cascade(docs, order=list(quality.RULES)[::-1]).where("failed_rule is null").count() == 6


def test_calibration_orders_by_rejection_per_cost(docs):
    found = quality.calibrate(docs)
    assert {r.name for r, _, _ in found} == {r.name for r in quality.RULES}
    rates = [hit / cost for _, hit, cost in found]
    assert rates == sorted(rates, reverse=True)


def test_line_dedup(docs, none):
    out = line_dedup.dedup_lines(docs)
    assert out.count() == docs.count()
    by = {(r.doc_id, r.removed_lines): r.text for r in out.collect()}
    assert by[(4, 0)].startswith("one two") and by[(5, 4)] == "" and by[(None, 4)] == "" and by[(6, 3)].startswith("k0 k1")
    kept = line_dedup.keep_first_lines(docs)
    same_columns(kept, docs)
    assert kept.where("doc_id = 5").count() == 0 and kept.where("doc_id = 0").count() == 1
    assert line_dedup.dedup_lines(none).count() == 0


def test_simhash(docs, none):
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    assert {r.component_id for r in found if r.doc_id in (0, 1, 2)} == {0}  # no words: fingerprint zero
    assert {r.component_id for r in found if r.doc_id in (4, 5)} == {4}
    kept = simhash.keep_one(docs)
    same_columns(kept, docs)
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids.count(4) == 1 and 5 not in ids and ids.count(0) == 1 and 1 not in ids
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_decontamination(docs, none, benchmark, spark):
    out = decontaminate.benchmark_hits(docs, benchmark)
    by = {r.doc_id: r.hits for r in out.collect()}
    assert by[0].n_words == by[1].n_words == 0 and by[3].n_hit == 0
    assert by[4].n_hit == 13 and by[4].item_ids == ["1", "5"]
    text = rows()[4][1]
    assert [text[a:b] for a, b in by[4].spans] == ["eight nine", "k1 k2 k3 k4 k5 k6 k7 k8 k9 k10 k11"]
    kept = decontaminate.drop_contaminated(docs, benchmark)
    same_columns(kept, docs)
    assert {r.doc_id for r in kept.collect()} == {0, 1, 2, 3, 7, 8, 9, None}
    assert decontaminate.benchmark_hits(docs, benchmark.limit(0)).where("hits.n_hit > 0").count() == 0
    assert decontaminate.benchmark_hits(none, benchmark).count() == 0


def test_decontamination_in_blocks(docs, benchmark, monkeypatch):
    whole = {(r.doc_id, r.text): r.hits for r in decontaminate.benchmark_hits(docs, benchmark).collect()}
    monkeypatch.setattr(decontaminate, "MAX_NODES", 20)
    assert {(r.doc_id, r.text): r.hits for r in decontaminate.benchmark_hits(docs, benchmark).collect()} == whole


def test_pieces(docs, none):
    out = piece_dropout.encode_pieces(docs)
    got = out.collect()
    assert len(got) == docs.count() and all(r.lossless for r in got)
    assert [r.ids for r in got if r.text is None] == [None, None] and [r.ids for r in got if r.text == ""] == [[]]
    back = piece_dropout.decode_pieces(out)
    assert back.where(~F.col("decoded").eqNullSafe(F.col("text"))).count() == 0
    assert piece_dropout.encode_pieces(none).count() == 0


def test_hidden_markov(docs, none):
    got = hmm.score_documents(docs, states=3, rounds=2).collect()
    assert len(got) == docs.count() and all(r.score < 0 and r.base_score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (0, 1, 2)} == {1}
    assert hmm.score_documents(none).count() == 0


def test_substring_dedup(docs, none):
    got = substring_dedup.repeated_passages(docs).collect()
    assert {r.doc_id for r in got if r.first_doc_id == 4} == {4, 5, 6, None}
    assert {r.doc_id for r in got if r.first_doc_id != 4} == {3}  # whose words go round
    assert not any(r.removed for r in got if r.doc_id == 4)
    cut = {r.doc_id: r.text for r in substring_dedup.cut_repeats(docs).collect()}
    assert len(cut[5].split()) < 30 and cut[4] == rows()[4][1] and cut[0] is None
    assert substring_dedup.repeated_passages(none).count() == 0


def test_secrets(docs, none):
    ledger = secrets.commit(None, docs)
    out = secrets.findings_by_path(docs, ledger)
    assert out.count() == docs.count()
    assert [(f.kind, f.start, f.end) for f in out.where("doc_id = 9").first().findings] == [("assign", 0, 21)]
    assert out.where("doc_id = 0").first().findings == []
    assert secrets.scan_unseen(none).count() == 0


def test_ledger_scans_only_what_is_new(docs, spark):
    ledger = secrets.scan_unseen(docs)
    n_blobs = ledger.select("blob").distinct().count()
    assert ledger.count() == n_blobs * len(secrets.RULES)
    assert secrets.scan_unseen(docs, ledger).count() == 0
    newer = (secrets.SecretRule("hex", "[0-9a-f]{24,}", version=2), *secrets.RULES)
    assert secrets.scan_unseen(docs, ledger, newer).count() == n_blobs
    more = docs.unionByName(spark.createDataFrame([(50, "token: zzzzzzzz")], "doc_id long, text string"), allowMissingColumns=True)
    fresh = secrets.scan_unseen(more, ledger)
    assert fresh.count() == len(secrets.RULES)
    assert secrets.update_ledger(ledger, fresh).count() == (n_blobs + 1) * len(secrets.RULES)


def test_rollup(docs, none, spark):
    r = token_rollup.Rollup(spark, scratch(spark))
    assert r.totals().count() == 0
    insert = docs.withColumn("op", F.lit("insert"))
    assert r.commit("1", insert) and not r.commit("1", insert)
    total = lambda: r.totals().agg(F.sum("n_docs"), F.sum("n_tokens")).first()
    assert total()[0] == docs.count()
    assert r.commit("2", none.withColumn("op", F.lit("insert"))) and total()[0] == docs.count()
    change = docs.where("doc_id = 9").withColumn("op", F.lit("revise")).withColumn("text", F.lit("one two")).unionByName(insert.where("doc_id = 4 or doc_id is null").withColumn("op", F.lit("delete")))
    before = total()[1]
    assert r.commit("3", change)
    encoding = token_rollup.load_encoding(open(token_rollup.VOCABULARY, "rb").read())
    n = lambda t: len(encoding.encode_ordinary(t or ""))
    body = rows()[4][1]
    assert tuple(total()) == (docs.count() - 5, before - 4 * n(body) - n(rows()[9][1]) + 2)
    # a crash between the two writes leaves no trace in the totals
    spark.createDataFrame([(1, "s", "en", "v", 1, 99, 9)], token_rollup.LEDGER).write.parquet(f"{r.store}/ledger/batch=4/bucket=3")
    assert total()[0] == docs.count() - 5
    assert r.commit("4", none.withColumn("op", F.lit("insert"))) and total()[0] == docs.count() - 5


def test_sharding(docs, none, spark):
    out = sharding.hypergeometric_shards(docs, 5)
    got = out.collect()
    assert len(got) == docs.count() and sorted(out.columns) == sorted({*docs.columns, "slot"})
    for s in range(5):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (2, 3)
    assert sharding.hypergeometric_shards(none, 5).count() == 0
