"""Chat formatting, alignment and search against plain Python, on small tables and whole ones."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from standmap.llm import align, chat, lexical_search, queries

SF = "/root/testdata/sf0.001"


# --- chat ------------------------------------------------------------------------------------------------------

CHATS = "conv_id long, turn long, role string, text string, formatted string, valid string"


def formatted(spark, rows, template=chat.CHATML):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], CHATS)
    out = chat.format_chats(df, template)
    return {r.conv_id: r for r in out.select("*", chat.read_turns(F.col("formatted"), template).alias("back"), chat.loss_texts(F.col("segments"), template).alias("loss")).collect()}


ODD = ["", "<|im_end|>", "<|im_start|>assistant ok", "<\\|", "<\\\\|x<|", "<", "|im_end|>\n", "\\<|\\", "$1 \\$2", "a\nb", "<<||>", "🎉<|é"]


@pytest.mark.parametrize("template", [chat.CHATML, chat.Template("<|start_header_id|>", "<|end_header_id|>\n\n", "<|eot_id|>"), chat.Template("[INST]", "\n", "</s>", loss=("assistant", "tool"), openers=(("[", "I"), ("<", "/")))])
def test_texts_and_roles_come_back(spark, template):
    rows = [(i, t, role, text) for i, text in enumerate(ODD) for t, role in enumerate(("user", "assistant"))]
    rows += [(100 + i, 0, text, text) for i, text in enumerate(ODD)] + [(200, 0, "a%0A\nb", "</s>[INST][\\I<\\/"), (200, 1, "%", None), (201, 0, None, "x")]
    got = formatted(spark, rows, template)
    for i, text in enumerate(ODD):
        assert [tuple(x) for x in got[i].back] == [("user", text), ("assistant", text)] and got[i].loss == [text]
        assert [tuple(x) for x in got[100 + i].back] == [(text, text)]
    assert [tuple(x) for x in got[200].back] == [("a%0A\nb", "</s>[INST][\\I<\\/"), ("%", "")] and [tuple(x) for x in got[201].back] == [("", "x")]
    for r in got.values():
        assert r.formatted == "".join(s.text for s in r.segments) and r.formatted.count(template.opens) == r.n_turns == r.formatted.count(template.closes)


def test_the_machine_over_roles(spark):
    chats = {1: "system user assistant", 2: "user assistant user", 3: "assistant user", 4: "user user assistant", 5: "user assistant tool tool assistant", 6: "user assistant system", 7: "user"}
    rows = [(c, t, role, "x") for c, roles in chats.items() for t, role in enumerate(roles.split())]
    got = formatted(spark, [*rows, (8, 0, "user", "x"), (8, 1, None, "x"), (9, None, "assistant", "late"), (9, 5, "user", "first"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (10, 0, "user", "x"), (10, 0, "user", "x")])
    assert {k for k, r in got.items() if r.valid} == {1, 5, 9, None}
    assert {k: (r.bad_turn, r.bad_role) for k, r in got.items() if r.rejected} == {3: (0, "assistant"), 4: (1, "user"), 6: (2, "system"), 8: (1, None), 10: (0, "user")}
    assert [x.text for x in got[9].back] == ["first", "late"] and got[10].n_turns == 2


def test_a_long_conversation_is_checked_range_by_range(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], "x") for t in range(2000)] + [(2, t, ("user", "assistant")[t % 2 if t != 1503 else 0], "x") for t in range(2000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {(r.conv_id, r.valid, r.bad_turn) for r in chat.turn_order(df.repartition(7)).collect()} == {(1, True, None), (2, False, 1503)}


def test_segments_are_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "a<|b"), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    assert [(r.turn, r.segment, r.text, r.loss) for r in chat.chat_segments(df).collect()] == [(0, 0, "<|im_start|>user\n", False), (0, 1, "a<\\|b", False), (0, 2, "<|im_end|>\n", False), (1, 0, "<|im_start|>assistant\n", False), (1, 1, "", True), (1, 2, "<|im_end|>\n", False)]
    assert chat.format_chats(df.limit(0)).count() == 0 and "Exchange" not in chat.chat_segments(df)._jdf.queryExecution().executedPlan().toString()


def test_templates_need_openers():
    for wrong in ({"opens": "user: "}, {"closes": "\n"}, {"openers": (("<", "<"),)}, {"openers": (("<", "\\"),)}, {"named": ": "}):
        with pytest.raises(ValueError):
            chat.Template(**wrong)


# --- alignment -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabularies():
    a = tokenizers.Tokenizer.from_file(align.A_FILE)
    a.encode_special_tokens = True
    byte = {v: k for k, v in align._byte_of().items()}
    back = {c: b for b, c in byte.items()}
    b = sentencepiece.SentencePieceProcessor(model_file=align.B_FILE)

    def tokens(text):
        x = a.encode(f" {text}", add_special_tokens=False)
        y = b.encode(text)
        spell = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
        return list(zip(x.ids, (bytes(back[c] for c in t) for t in x.tokens), strict=True)), [(i, spell(b.id_to_piece(i))) for i in y]

    return tokens


def groups(tokens, text):
    """[(A ids, B ids)] by the offsets where both end."""
    a, b = tokens(text) if text else ([], [])
    raw = f" {text}".encode() if text else b""
    if b"".join(t for _, t in a) != raw or b"".join(t for _, t in b) != raw:
        return []
    ends_a, ends_b = ([0, *np.cumsum([len(t) for _, t in side]).tolist()] for side in (a, b))
    shared = sorted({*ends_a} & {*ends_b})
    at_a, at_b = ({e: i for i, e in enumerate(ends)} for ends in (ends_a, ends_b))
    return [([i for i, _ in a[at_a[lo] : at_a[hi]]], [i for i, _ in b[at_b[lo] : at_b[hi]]]) for lo, hi in zip(shared, shared[1:], strict=False)]


STRANGE = [None, "", "a", " ", "  lead\n\nx ", "▁ a", "<|endoftext|> </s> <s>", "x" * 4000, "\x00", "é 日本 🎉🎉", "à  z", "0123456789 " * 50, "<0x41>", "\t\t  \n", "don't won't I'LL"]


def test_alignment_equals_brute_force(spark, vocabularies):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()] + STRANGE  # one of each kind is enough here
    rows = [(i, t, 1, "x") for i, t in enumerate([*texts, texts[0]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long, pairs string")
    want = {i: groups(vocabularies, t) for i, t, *_ in rows}
    for r in align.align_tokens(df).collect():
        cut = lambda ids, stops: [ids[lo:hi] for lo, hi in zip([0, *stops], stops, strict=False)]
        assert list(zip(cut(r.a_ids, r.a_stops), cut(r.b_ids, r.b_stops), strict=True)) == want[r.doc_id], r.text
    links = {i: Counter((x, y) for a, b in g for x in a for y in b) for i, g in want.items()}
    n = Counter(p for c in links.values() for p in c)
    top = {}
    for (x, _), c in n.items():
        top[x] = max(c, top.get(x, 0))
    out = align.link_support(df)
    assert "pairs" not in set(out.columns) - set(df.columns) and out.count() == len(rows)
    for r in out.collect():
        g, c = want[r.doc_id], links[r.doc_id]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), c.total())
        assert r.groups_sha256 == (hashlib.sha256(text.encode()).hexdigest() if g else "")
        assert r.count_sum == sum(k * n[p] for p, k in c.items()) and r.n_best == sum(k for p, k in c.items() if n[p] == top[p[0]])


def test_rare_pairs_meet_their_counts_in_a_join(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    key = lambda x: sorted(map(tuple, x.drop("text").collect()))
    whole = key(align.link_support(df))
    monkeypatch.setattr(align, "HOT", 100)
    assert key(align.link_support(df)) == whole
    monkeypatch.setattr(align, "LARGE", 2)
    monkeypatch.setattr(align, "HOT", 0)
    assert key(align.link_support(df)) == whole
    assert align.link_support(df.limit(0)).count() == 0


def test_galloping_equals_a_set():
    rng = np.random.default_rng(3)
    for dense in (0.9, 0.5, 0.02):
        parts = [(np.flatnonzero(rng.random(n) < 0.6), np.flatnonzero(rng.random(n) < dense)) for n in (1, 3000, 40, 0, 9000)]
        a, b, base = [], [], 0
        for x, y in parts:
            x, y = np.union1d(x, [9000]), np.union1d(y, [9000])
            a.append(x + base)
            b.append(y + base)
            base += 10_000
        n_a, n_b = (np.array(list(map(len, s))) for s in (a, b))
        a, b = np.concatenate(a), np.concatenate(b)
        i, j = align.shared_ends(a, b, n_a, n_b)
        assert a[i].tolist() == b[j].tolist() == np.intersect1d(a, b).tolist()


def test_the_quick_encoder_splits_every_character_alike():
    """Each character of the first planes, alone, doubled, between letters and spaces, by both encoders of the vocabulary."""
    with open(align.A_FILE, "rb") as f:
        one = align.ByteTokens(f.read())
    texts = [" " + "".join(f"{c} {c}{c}a{c}\n{c}" for c in map(chr, range(lo, lo + 256)) if not 0xD800 <= ord(c) < 0xE000) for lo in range(0, 0x20000, 256)]
    slow = [e.ids for e in one.slow.encode_batch(texts, add_special_tokens=False)]
    assert [one.encode(t) for t in texts] == slow


# --- search ----------------------------------------------------------------------------------------------------


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranking(docs, items, k=10):
    words = {i: terms(t) for i, t in docs}
    n_docs, total = sum(map(bool, words.values())), sum(map(len, words.values()))
    counts = {i: Counter(w) for i, w in words.items()}
    df = Counter(t for c in counts.values() for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counts.items():
            m = 10 + 90 * len(words[i]) * n_docs // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in {*terms(text)} if t in c)
            if s > 0:
                found.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def searched(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


DOCS = "doc_id long, text string, n long, score string, item_id string"


def test_search_equals_scoring_all(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)] + ["É", "Zoë", "x1"]
    p = 1 / np.arange(1, len(words) + 1)
    docs = [(i, " ".join(rng.choice(words, int(rng.integers(1, 60)), p=p / p.sum()))) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, "!!"), (1003, "W1, w1;É " * 3000), *((2000 + i, docs[7][1]) for i in range(30))]
    items = [(j, " ".join(rng.choice(words, int(rng.integers(1, 30))))) for j in range(25)] + [(30, "nothing known"), (31, ""), (32, docs[7][1].upper())]
    want = ranking(docs, items)
    df = spark.createDataFrame([(*d, 1, "a", "b") for d in docs], DOCS).repartition(5)
    q = spark.createDataFrame([*items, (33, None), (None, "w1")], "item_id long, text string")
    assert searched(lexical_search.ranked_search(df, q)) == want
    monkeypatch.setattr(lexical_search, "SHARD", 50)
    monkeypatch.setattr(lexical_search, "FIRST", 1)
    monkeypatch.setattr(lexical_search, "TERMS", 20)
    assert searched(lexical_search.ranked_search(df, q)) == want
    assert searched(lexical_search.ranked_search(df, q, k=3)) == ranking(docs, items, 3)
    assert searched(lexical_search.ranked_search(df.limit(0), q)) == searched(lexical_search.ranked_search(df, q.limit(0))) == []


def test_equal_documents_rank_by_id_and_rows_count_each(spark):
    df = spark.createDataFrame([(5, "a b"), (3, "a b"), (None, "a b"), (3, "a b"), (9, "c"), (8, "c d e")], "doc_id long, text string")
    got = lexical_search.ranked_search(df, spark.createDataFrame([(1, "b"), (1, "b a"), (2, "C")], "item_id int, text string")).orderBy("item_id", "rank").collect()
    assert [(r.item_id, r.rank, r.doc_id) for r in got] == [(1, 1, 3), (1, 2, 3), (1, 3, 5), (1, 4, None), (2, 1, 9), (2, 2, 8)]


def test_best_positions_stop_before_the_lists_end():
    """Documents that lead every list are met at once; what has been met by other lists moves the best positions on."""
    rng = np.random.default_rng(1)
    n, words = 20_000, 6
    held = rng.random((n, words)) < 0.5
    tf = np.where(held, rng.integers(1, 4, (n, words)), 0)
    tf[:20] = 60
    lengths = (tf > 0).sum(1)
    terms_, counts = np.nonzero(tf)[1], tf[tf > 0]
    shard = lexical_search.Shard(pa.array(np.arange(n)), np.full(n, 50), lengths, terms_, counts, np.array([900, 800, 700, 600, 500, 400]), n, 50 * n)
    docs, scores, read = shard.search(np.arange(words), 10, (0, 0))
    assert docs.tolist() == list(range(10)) and (np.diff(scores) <= 0).all() and read < 0.05 * lengths.sum()
    again, _, less = shard.search(np.arange(words), 10, (10, int(scores[-1])))
    assert again.tolist() == docs.tolist() and less <= read


def test_the_bound_may_equal_the_kth_score():
    """Ties with the k-th score that stand deeper in the lists are still found, by their smaller ids."""
    ids = pa.array(np.arange(200)[::-1].copy())
    one = np.ones(200, np.int64)
    shard = lexical_search.Shard(ids, 5 * one, one, 0 * one, one, np.array([700]), 200, 1000)
    docs, _, _ = shard.search(np.array([0]), 3, (0, 0))
    assert shard.ids.take(pa.array(docs)).to_pylist() == [0, 1, 2]


# --- whole queries ---------------------------------------------------------------------------------------------


def test_op12_and_op13_over_whole_tables(spark, vocabularies):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert searched(queries.op13_best_positions(spark, SF)) == ranking(docs, items)
    want = {i: groups(vocabularies, t) for i, t in docs}
    got = queries.op12_galloping_alignment(spark, SF).collect()
    assert len(got) == len(docs) and got[0].__fields__ == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    n = Counter(p for g in want.values() for p in {(x, y) for a, b in g for x in a for y in b})
    for r in got:
        assert r.n_groups == len(want[r.doc_id]) and r.count_sum == sum(n[x, y] for a, b in want[r.doc_id] for x in a for y in b)
