"""Queries and the pipeline, over whole tables, against brute force in plain Python."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_brute import brute_fingerprint, components, texts  # noqa: F401

import corpus_pipeline
from standmap.llm import piece_dropout, quality, queries, secrets, sharding, simhash, substring_dedup, token_rollup

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def lower_words(t):
    return (t or "").encode().lower().split()


def shingles(t):
    w = lower_words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(a, b):
    return len(a & b) >= 0.8 * len(a | b)


# --- queries ---------------------------------------------------------------------------------------------------


def test_op1_finds_near_duplicate_paragraphs(spark, docs, texts):  # noqa: F811
    """Of all pairs of distinct lines of a similarity of 0.8 or more, the share that the operator links; and the query's rows."""
    lines = {b" ".join(line.split()) for t in texts.values() for line in (t or "").encode().lower().split(b"\n") if len(line.split()) >= 5}
    sets = {x: substring_dedup.shingles(x) for x in lines}
    of = {}
    for x, s in sets.items():
        for k in s:
            of.setdefault(k, []).append(x)
    pairs = {p for group in of.values() for p in itertools.combinations(sorted(group), 2) if jaccard(sets[p[0]], sets[p[1]])}
    found = substring_dedup.repeated_passages(docs, least=1).collect()
    words = {k: lower_words(t) for k, t in texts.items()}
    where = {}
    for r in found:
        if r.kind == 0:
            where.setdefault(b" ".join(words[r.doc_id][r.lo : r.hi]), set()).add(r.component)
    assert len(pairs) >= 5
    linked = sum(bool(where.get(a, set()) & where.get(b, set())) for a, b in pairs)
    assert linked >= 0.9 * len(pairs)
    rows = {(r.doc_id, r.first_doc_id): (r.n_units, r.n_removed, r.word_spans) for r in queries.op1_paragraph_minhash(spark, SF).collect()}
    want = {}
    for r in found:
        want.setdefault((r.doc_id, r.first_doc_id), []).append(r)
    assert rows == {k: (len(g), sum(r.removed for r in g), ",".join(f"{a}:{z}" for a, z in sorted({(r.lo, r.hi) for r in g}))) for k, g in want.items()}


def test_op2_gives_every_document_its_columns(spark, texts):  # noqa: F811
    got = {r.doc_id: r for r in queries.op2_hidden_markov(spark, SF).collect()}
    assert set(got) == set(texts)
    train = [k for k in texts if zlib.crc32(str(k).encode()) % 7 != 2]
    c = Counter(w for k in train for w in [*lower_words(texts[k]), None])
    for k, r in got.items():
        assert (r.held_out, r.n_tokens, r.n_known) == (k not in train, len(lower_words(texts[k])) + 1, sum(c[w] > 0 for w in [*lower_words(texts[k]), None]))
        assert r.train_tokens == sum(c.values()) and r.score < 0
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score - r.base_score for r in out) / sum(r.n_tokens for r in out) > 0.05  # powers of ten a token


def test_op3_decodes_every_document(spark, texts):  # noqa: F811
    pieces = piece_dropout.Pieces(open(piece_dropout.MODEL, "rb").read())
    got = {r.doc_id: r for r in queries.op3_merge_dropout(spark, SF).collect()}
    assert set(got) == set(texts)
    assert all(r.lossless and r.n_pieces == len(r.ids) and pieces.decode(r.ids) == texts[k] for k, r in got.items() if texts[k])


def test_op5_rows(spark, texts):  # noqa: F811
    fp = {k: brute_fingerprint(t) for k, t in texts.items()}
    want = components(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op5_pigeonring_simhash(spark, SF).collect()}
    assert got == {k: (f"{fp[k]:016x}", want[k]) for k in fp}


def test_op8_totals(spark, docs):
    """Totals after all batches, from the documents that are left, counted one by one."""
    encoding = token_rollup.load_encoding(open(token_rollup.VOCABULARY, "rb").read())
    assert isinstance(encoding, tiktoken.Encoding)
    rows = {r.doc_id: r for r in docs.collect()}
    groups = {}
    for k, r in rows.items():
        groups.setdefault(r.text or "", []).append(k)
    assert any(len(g) > 1 for g in groups.values()) and any("|" in t for t in groups)
    want = Counter()
    for t, ids in groups.items():
        r = rows[min(ids)]
        t = re.sub(r" ?\| ?", " ", t)
        for name, n in (("n_docs", 1), ("n_tokens", len(encoding.encode_ordinary(t))), ("n_chars", len(t))):
            want[r.source, r.lang, name] += n
    got = queries.op8_delta_rollup(spark, SF).collect()
    assert {r.tokenizer_version for r in got} == {"byte_bpe_50k/1"}
    assert {(r.source, r.lang, n): r[n] for r in got for n in ("n_docs", "n_tokens", "n_chars")} == want


def test_rollup_reads_touched_buckets_only(spark, docs):
    r = token_rollup.Rollup(spark, queries.scratch(spark))
    r.commit("all", docs.withColumn("op", F.lit("insert")))
    one = docs.limit(1).withColumn("op", F.lit("delete"))
    assert r.commit("one", one)
    assert spark.read.parquet(f"{r.store}/ledger").where("batch = 'one'").select("bucket").distinct().count() == 1
    plan = r.documents([3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    with pytest.raises(ValueError):
        r.commit("../x", one)


def test_op9_columns_and_sizes(spark, docs):
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    got = queries.op9_hypergeometric_shards(spark, SF).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {k: (len(t.encode()) + 8, zlib.crc32(t.encode())) for k, t in rows.items()}
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    counts = Counter(r.shard for r in got)
    assert set(counts) <= set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))


def test_matrix_follows_the_hypergeometric_law():
    """What the first partition of 8 rows sends to a shard of 6 out of 18: frequencies over seeds against the law."""
    from math import comb

    n = 3000
    seen = Counter(int(sharding.communication_matrix([8, 7, 3], 3, s)[0, 0]) for s in range(n))
    law = {k: comb(6, k) * comb(12, 8 - k) / comb(18, 8) for k in range(7)}
    chi = sum((seen[k] - n * p) ** 2 / (n * p) for k, p in law.items() if n * p >= 5)
    assert chi < 20  # 5 degrees of freedom or fewer: passed by chance once in 800 tables


def test_a_shuffle_keeps_no_order(spark):
    """Shards and slots of 3,000 rows don't follow where rows stand, and pairs meet in a shard as often as the law has it."""
    frame = spark.range(3000).repartition(5).cache()
    order = {r.id: i for i, r in enumerate(frame.collect())}
    apart = []
    for seed in range(4):
        got = sharding.hypergeometric_shards(frame, 6, seed).collect()
        table = np.zeros((30, 6))
        for r in got:
            table[order[r.id] // 100, r.shard] += 1
        chi = ((table - 100 / 6) ** 2 / (100 / 6)).sum()
        assert 80 < chi < 220  # 145 degrees of freedom
        for s in range(6):
            mine = [(order[r.id], r.slot) for r in got if r.shard == s]
            assert abs(np.corrcoef(np.array(mine).T)[0, 1]) < 0.2
        at = {r.id: r.shard for r in got}
        apart.append(tuple(at[i] for i in range(50)))
        together = sum(at[i] == at[i + 1] for i in range(0, 3000, 2))
        assert abs(together - 1500 * 499 / 2999) < 75  # four standard deviations
    assert len(set(apart)) == 4


# --- many matches and lines ------------------------------------------------------------------------------------


def test_many_secrets_in_one_text(spark):
    """Offsets of thousands of matches against Python's, in and around the lengths at which sums are cut into blocks."""
    rng = np.random.default_rng(7)
    for n in (0, 1, 16, 17, 300, 4000):
        t = "".join(f"{'é' * int(g)} {'0123456789abcdef'[: int(k)]}{'a' * 20} " for g, k in zip(rng.integers(0, 5, n), rng.integers(0, 16, n), strict=True))
        rule = secrets.BASE_RULES[2]
        got = spark.createDataFrame([(t,)], "t string").select(secrets.spans(F.col("t"), rule).alias("s")).first().s
        assert [(r.start, r.end) for r in got] == [m.span() for m in re.finditer("[0-9a-f]{24,}", t)]


def test_ledger_of_two_commits_scans_what_is_new_or_changed(spark):
    docs = spark.createDataFrame([(i, f"x {'0a1b2c3d' * n} token: abcdef{i} AKIA{'A' * 20} ghp_{'z' * 40}") for i, n in enumerate((3, 4, 5, 6, 3))], "doc_id long, text string")
    first = secrets.commit(None, docs.where("doc_id < 3"), secrets.EARLIER_RULES)
    fresh = secrets.scan_unseen(docs, first)
    new = Counter(r.blob for r in fresh.collect())
    assert sorted(new.values()) == [2, 2, 2, len(secrets.RULES), len(secrets.RULES)]  # the changed rule and the added one
    once = secrets.findings_by_path(docs, secrets.commit(None, docs)).collect()
    twice = secrets.findings_by_path(docs, secrets.commit(first, docs)).collect()
    assert {r.doc_id: r.findings for r in once} == {r.doc_id: r.findings for r in twice}
    assert all(len([f for f in r.findings if f.kind == "hex"]) == 1 for r in twice)


# --- the pipeline ----------------------------------------------------------------------------------------------


def kept_by_rules(t):
    w = WORD.findall(t or "")
    n = len(w)
    win = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    repeat = len({j for i in range(n - 2) if win[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)})
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    fails = n < 1 or 100 * repeat > 50 * n or len(re.findall(r"[#*$%&|<>]", t or "")) > n or 10 * (len(lines) - len(set(lines))) > 3 * len(lines)
    chars = sum(map(len, w))
    fails = fails or chars < 2 * n or chars > 25 * n
    return not (fails or n >= 50 and (10 * sum(not any(c.isalpha() for c in x) for x in w) > 3 * n or 5 * max(Counter(w).values()) > n))


def without_repeats(rows):
    """Texts by id in order: windows of three lines with words, of which later occurrences go."""
    lines = {k: [(i, x) for i, x in enumerate(t.split("\n")) if WORD.search(x)] for k, t in rows}
    first, gone = {}, {k: set() for k in lines}
    for k, ls in lines.items():
        for i in range(len(ls) - 2):
            key = tuple(x for _, x in ls[i : i + 3])
            if key not in first:
                first[key] = (k, i)
            else:
                lo = max(i, first[key][1] + 3) if first[key][0] == k else i
                gone[k] |= {ls[j][0] for j in range(lo, i + 3)}
    return {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k]) if gone[k] else t for k, t in rows}


def bench_words(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())


def test_each_stage_against_brute_force(spark, docs, texts):  # noqa: F811
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "simhash_dedup", "decontamination", "pieces"]
    stage = dict(corpus_pipeline.STAGES)
    now = docs
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}

    now = stage["quality_rules"](spark, now, SF).cache()
    assert ids(now) == {k for k, t in texts.items() if kept_by_rules(t)} and now.columns == docs.columns
    rows = sorted((r.doc_id, r.text) for r in now.collect())

    now = stage["line_dedup"](spark, now, SF).cache()
    want = {k: t for k, t in without_repeats(rows).items() if t}
    assert {r.doc_id: r.text for r in now.collect()} == want and now.columns == docs.columns
    assert any(len(want[k]) < len(t) for k, t in rows if k in want)

    now = stage["simhash_dedup"](spark, now, SF).cache()
    fp, sets = {k: brute_fingerprint(t) for k, t in want.items()}, {k: shingles(t) for k, t in want.items()}
    near = components(list(want), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 12 and jaccard(sets[a], sets[b]))
    assert ids(now) == set(near.values()) and now.columns == docs.columns and len(ids(now)) < len(want)
    want = {k: want[k] for k in ids(now)}

    now = stage["decontamination"](spark, now, SF).cache()
    grams = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = bench_words(r.text)
        for i in range(max(1, len(w) - 9) if w else 0):
            grams.setdefault(min(10, len(w)), set()).add(tuple(w[i : i + 10]))
    hit = {k for k, t in want.items() for n, g in grams.items() for i in range(len(bench_words(t)) - n + 1) if tuple(bench_words(t)[i : i + n]) in g}
    assert ids(now) == set(want) - hit and hit and now.columns == docs.columns

    last = stage["pieces"](spark, now, SF).collect()
    pieces = piece_dropout.Pieces(open(piece_dropout.MODEL, "rb").read())
    assert {r.doc_id for r in last} == set(want) - hit and all(r.lossless and pieces.decode(r.ids) == r.text == want[r.doc_id] for r in last)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in last)


def test_pipeline_on_nulls_clashes_and_nothing(spark, tmp_path):
    """Null ids and texts, repeated rows and further columns; then an empty table."""
    body = " ".join(f"w{i}" for i in range(80))
    rows = [(1, body, "en", "s", 5, "a"), (1, body, "en", "s", 5, "a"), (None, body + " x", None, None, None, "b"), (2, None, "en", "s", 0, None), (3, "", "en", "s", 0, None), (4, "one short text", "en", None, 14, "c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string")
    bench = spark.createDataFrame([(1, None), (None, "one short text")], "item_id long, text string")
    for name, f in (("some", frame), ("none", frame.limit(0))):
        f.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, body), (4, "one short text")] and all(r.lossless for r in got)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_calibration_knows_what_is_given(spark, docs):
    """Features at hand cost nothing but the comparison, and no rule's verdict depends on who computed them."""
    f = quality.with_features(docs.select("doc_id", "text"), quality.BASE_FEATURES)
    a = {r.doc_id: r.failed_rule is None for r in quality.quality_cascade(f, given=quality.BASE_FEATURES).collect()}
    b = {r.doc_id: r.failed_rule is None for r in quality.quality_cascade(docs).collect()}
    assert a == b and not all(a.values())
    assert {r.name for r, _, _ in quality.calibrate(f, given=quality.BASE_FEATURES)} == {r.name for r in quality.RULES}


def test_simhash_of_many_starts_equals_hamming():
    rng = np.random.default_rng(11)
    x = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) & rng.integers(0, 1 << 63, 4000, dtype=np.uint64) & rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    any_start = np.any([simhash.chained(x, s, 12) for s in range(8)], axis=0)
    assert (any_start == (np.bitwise_count(x) <= 12)).all()


def test_words_are_made_once_and_where_they_are_needed(spark, docs):
    """One tokenisation in the query's plan; none before a rule that needs no words, and the order is the same each time."""
    plan = queries.op4_quality_cascade(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    tokenised = r"[^\x20\x09-\x0D]+, 0)"
    assert plan.count(tokenised) == 1 and plan.count("split(") == 1
    symbols = quality.Rule("all_symbols", ("n_symbols",), lambda f: f["n_symbols"] > 10)
    out = quality.quality_cascade(docs, (symbols, *quality.RULES), order=[symbols, *quality.RULES])
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.count(tokenised) == 1 and text.index("all_symbols") < text.index(tokenised)
    orders = [[(r.name, hit, cost) for r, hit, cost in quality.calibrate(docs)] for _ in range(2)]
    assert orders[0] == orders[1]


def test_a_rollup_survives_crashes_and_compaction(spark, docs, monkeypatch):
    """A commit that dies counts nothing and its lock is gone; two writers exclude each other; merged batches stay known."""
    store = queries.scratch(spark)
    load = docs.select("doc_id", "source", "lang", "text").withColumn("op", F.lit("insert"))
    key = lambda r: sorted(map(repr, r.totals().collect()))
    r = token_rollup.Rollup(spark, store, buckets=5)
    parts = [load.where(f"doc_id % 3 = {i}") for i in range(3)]
    assert r.commit("a", parts[0]) and r.commit("b", parts[1])
    real = token_rollup.Rollup._write

    def dying(self, batch, signed):
        real(self, batch, signed)
        fs, at = self._path(f"totals/{batch}")
        fs.delete(at, True)
        raise KeyboardInterrupt

    monkeypatch.setattr(token_rollup.Rollup, "_write", dying)
    before = key(r)
    for act in (lambda: r.commit("c", parts[2]), r.compact):
        with pytest.raises(KeyboardInterrupt):
            act()
    monkeypatch.undo()
    again = token_rollup.Rollup(spark, store, buckets=99)
    assert again.buckets == 5 and key(again) == before and not again.commit("b", parts[1])
    assert again.commit("c", parts[2])
    whole = token_rollup.Rollup(spark, queries.scratch(spark))
    whole.commit("all", load)
    assert key(again) == key(whole)
    with again._alone(), pytest.raises(RuntimeError):
        r.commit("d", parts[0])
    base = again.compact()
    assert base.startswith("base-") and again._committed() == [base] and again.compact() is None and key(again) == key(whole)
    assert not any(again.commit(n, parts[0]) for n in "abc") and again.commit("gone", load.where("doc_id % 3 <> 0").withColumn("op", F.lit("delete")))
    assert again.compact() and not again.commit("a", parts[0])
    first = token_rollup.Rollup(spark, queries.scratch(spark))
    first.commit("a", parts[0])
    assert key(again) == key(first) and spark.read.parquet(f"{store}/ledger").select("bucket").distinct().count() == 5
    with pytest.raises(ValueError):
        again.commit("base-7", load)


def test_ledger_of_two_sessions_with_a_crash_between(spark, tmp_path, monkeypatch):
    """Commits count once, a cut one leaves nothing, another session scans only what is new, and every version keeps its findings."""
    key = "AKIA" + "A" * 16
    first = spark.createDataFrame([("a", "password = hunter22"), ("b", "plain"), ("b", "plain"), (None, None)], "path string, text string")
    second = spark.createDataFrame([("a", "nothing now", 1), ("c", "plain", 2), ("d", f"x {key}", 3)], "path string, text string, blob int")
    store = f"{tmp_path}/ledger"
    ledger = secrets.Ledger(spark, store)
    assert ledger.commits() == [] and ledger.rows().count() == ledger.history().count() == 0
    assert ledger.commit("one", first, secrets.EARLIER_RULES) and not ledger.commit("one", second)
    before = {tuple(r) for r in ledger.rows().select("blob", "rule", "version").collect()}
    assert len(before) == 3 * len(secrets.EARLIER_RULES)

    scan = secrets.scan_unseen
    other = spark.newSession()
    again = secrets.Ledger(other, store)
    with monkeypatch.context() as m:  # dies after what it found is written, before its versions are
        m.setattr(secrets, "address", lambda text: 1 / 0)
        m.setattr(secrets, "scan_unseen", lambda *a: first.select("path"))
        with pytest.raises(ZeroDivisionError):
            again.commit("two", second)
    assert again.commits() == ["one"] and {tuple(r) for r in again.rows().select("blob", "rule", "version").collect()} == before

    rows = []
    monkeypatch.setattr(secrets, "scan_unseen", lambda *a: rows.append(scan(*a)) or rows[-1])
    assert again.commit("two", second)
    per_blob = sorted(r["count"] for r in rows[0].groupBy("blob").count().collect())
    assert per_blob == [2, len(secrets.RULES), len(secrets.RULES)]  # "plain" for the changed rule and the added one, two new texts for all
    assert ledger.commits() == ["one", "two"] and not ledger.commit("two", first)
    got = sorted((r.place, r.commit, r.path or "", len(r.pending), [(f.start, f.kind, f.end) for f in r.findings]) for r in ledger.history().collect())
    assert got == [
        (0, "one", "", 2, []), (0, "one", "a", 2, [(0, "assign", 19)]), (0, "one", "b", 0, []), (0, "one", "b", 0, []),
        (1, "two", "a", 0, []), (1, "two", "c", 0, []), (1, "two", "d", 0, [(2, "access", 22)]),
    ]
    n = ledger.rows()
    assert n.count() == n.select("blob", "rule", "version").distinct().count()
    with again._alone(), pytest.raises(RuntimeError, match="another writer"):
        ledger.commit("three", first)
    with pytest.raises(ValueError):
        ledger.commit("../three", first)
    assert ledger.commit("three", first.limit(0)) and ledger.history().where("place = 2").count() == 0
