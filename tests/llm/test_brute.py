"""Operators that SQL can't express, against brute force."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import xxhash

from standmap.llm import decontaminate, hmm, piece_dropout, quality, queries, sharding, simhash, substring_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def components(nodes, linked):
    up = {k: k for k in nodes}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, a in enumerate(sorted(nodes)):
        for b in sorted(nodes)[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {k: find(k) for k in nodes}


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    runs = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_all_pairs(docs, texts):
    fp = {k: brute_fingerprint(t) for k, t in texts.items()}
    want = components(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    for r in simhash.near_duplicates(docs).collect():
        assert (r.fp % (1 << 64), r.component_id) == (fp[r.doc_id], want[r.doc_id])


def test_simhash_links_in_a_dense_group(spark, monkeypatch):
    """A hot bucket that is cut into blocks keeps every link."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(0)
    fps = {0x0123456789ABCDEF ^ int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False))) for _ in range(150)}
    fps = sorted(x if x < 1 << 63 else x - (1 << 64) for x in fps)
    got = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()
    close = lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 3
    assert all(close(r.a, r.b) for r in got)
    pairs = {(r.a, r.b) for r in got} | {(r.b, r.a) for r in got}
    assert components(fps, close) == components(fps, lambda a, b: (a, b) in pairs)


def test_wide_candidates_equal_all_pairs(spark, monkeypatch):
    """Pigeonring chains at 12 bits miss no text that has a pair that sizes allow, in blocks too."""
    monkeypatch.setattr(simhash, "WIDE_BLOCK", 40)
    monkeypatch.setattr(simhash, "TOGETHER", 50)
    rng = np.random.default_rng(1)
    fps = [0x0123456789ABCDEF ^ int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 14), replace=False))) for _ in range(200)]
    rows = [(k, x if x < 1 << 63 else x - (1 << 64), int(rng.integers(0, 400))) for k, x in enumerate(fps)]
    want = {a[0] for a in rows for b in rows if a[0] != b[0] and ((a[1] ^ b[1]) % (1 << 64)).bit_count() <= 12 and min(a[2], b[2]) >= 0.8 * max(a[2], b[2])}
    got = [r.text_hash for r in simhash.wide_candidates(spark.createDataFrame(rows, "text_hash long, fp long, n long")).collect()]
    assert 80 < len(want) < 200 and len(got) == len(set(got)) and set(got) == want


def test_verified_links_join_what_all_pairs_join(spark, monkeypatch):
    """Chains and stars of similar sets, in blocks, with fewer links than texts in each block pair."""
    monkeypatch.setattr(simhash, "WIDE_SHINGLES", 3000)
    monkeypatch.setattr(simhash, "TOGETHER", 150)
    rng = np.random.default_rng(5)
    sets = {}
    for base in range(12):
        now = set(rng.integers(0, 1 << 60, int(rng.integers(5, 60))).tolist())
        for _ in range(10):
            sets[len(sets)] = set(now)
            if base % 2:  # a chain; else a star around its base
                now = set(list(now)[1:]) | {int(rng.integers(0, 1 << 60))}
            else:
                sets[len(sets)] = set(list(now)[2:])
    rows = [(k, 7, len(x), sorted(x)) for k, x in sets.items()] + [(len(sets), 0, 0, []), (len(sets) + 1, 0, 0, [])]
    sets |= {r[0]: set() for r in rows[-2:]}
    got = [(r.a, r.b) for r in simhash.verified_links(spark.createDataFrame(rows, "text_hash long, fp long, n long, shingles array<long>")).collect()]
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert all(alike(a, b) for a, b in got)
    pairs = {*got, *((b, a) for a, b in got)}
    assert components(list(sets), alike) == components(list(sets), lambda a, b: (a, b) in pairs)


def test_near_copies_go_and_others_stay(spark):
    """Copies of five-word similarity 0.8 or more go, though more than three bits apart; close fingerprints alone don't link."""
    rng = np.random.default_rng(2)
    rows, similar, apart = [], 0, 0
    for k in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        copy = [f"z{k}" if i in (20, 90, 160) else x for i, x in enumerate(words)]
        far = [f"y{i}" if i % 20 == 0 else x for i, x in enumerate(words)]
        a, b = " ".join(words), " ".join(copy)
        sets = simhash.shingle_set(a), simhash.shingle_set(b)
        similar += len(np.intersect1d(*sets)) >= 0.8 * len(np.union1d(*sets))
        apart += (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 3
        rows += [(3 * k, a), (3 * k + 1, b), (3 * k + 2, " ".join(far))]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert similar == 40 and apart > 20
    assert {k for k in kept if k % 3 != 1} == {3 * k + d for k in range(40) for d in (0, 2)}
    assert sum(k % 3 == 1 for k in kept) <= 1


def test_repeated_passages_hold_every_shared_run(docs, texts):
    runs = {}
    for k, t in texts.items():
        w = t.encode().lower().split()
        for i in range(len(w) - 49):
            runs.setdefault(b" ".join(w[i : i + 50]), set()).add(k)
    want = {(a, b) for s in runs.values() for a in s for b in s if a < b}
    found = {}
    for r in substring_dedup.repeated_passages(docs).collect():
        found.setdefault(r.component, set()).add(r.doc_id)
    have = {(a, b) for s in found.values() for a in s for b in s if a < b}
    assert want <= have
    words = {k: t.encode().lower().split() for k, t in texts.items()}
    share = lambda a, b: {b" ".join(words[a][i : i + 5]) for i in range(len(words[a]) - 4)} & {b" ".join(words[b][i : i + 5]) for i in range(len(words[b]) - 4)}
    assert all(len(share(a, b)) >= 15 for a, b in have)


def test_similar_paragraphs_link(spark):
    words = [f"w{i}" for i in range(80)]
    near = [*words[:40], "other", *words[41:]]
    far = [*words[:30], *(f"z{i}" for i in range(50))]
    rows = [(1, "intro\n" + " ".join(words)), (2, " ".join(near)), (3, " ".join(far[30:]))]
    got = [r for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.kind == 0]
    assert sorted((r.doc_id, r.first_doc_id, r.removed) for r in got) == [(1, 1, False), (2, 1, True)]


def test_paragraph_blocks_keep_every_link(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK", 4)
    words = [f"w{i}" for i in range(100)]
    rows = [(k, " ".join(f"x{k}" if i == 3 * k else w for i, w in enumerate(words))) for k in range(30)]
    got = [r for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.kind == 0]
    assert {r.doc_id for r in got} == set(range(30)) and {r.first_doc_id for r in got} == {0}


def test_short_paragraphs_are_units(spark, docs, texts, tmp_path):
    """Every repeated line has a unit however short, near copies of five words or more link, and the query asks for both."""
    words = [f"w{i}" for i in range(20)]
    rows = [(1, "a b\n" + " ".join(words)), (2, "c d e\nA  b"), (3, " ".join([*words[:19], "other"])), (4, "x y z q r"), (5, "x y z q r\nx y z q s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.repeated_passages(frame, least=1).collect()
    assert sorted((r.doc_id, r.first_doc_id, r.lo, r.hi, r.removed) for r in got) == [(1, 1, 0, 2, False), (1, 1, 2, 22, False), (2, 1, 3, 5, True), (3, 1, 0, 20, True), (4, 4, 0, 5, False), (5, 4, 0, 5, True)]
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r.doc_id, r.first_doc_id, r.n_units) for r in queries.op1_paragraph_minhash(spark, str(tmp_path)).collect()) == [(1, 1, 2), (2, 1, 1), (3, 1, 1), (4, 4, 1), (5, 4, 1)]
    lines = {}
    for k, t in texts.items():
        for line in (t or "").encode().lower().split(b"\n"):
            if line.split():
                lines.setdefault(b" ".join(line.split()), set()).add(k)
    want = {(a, b) for s in lines.values() for a in s for b in s if a < b}
    found = {}
    for r in substring_dedup.repeated_passages(docs, least=1).collect():
        found.setdefault(r.component, set()).add(r.doc_id)
    assert want <= {(a, b) for s in found.values() for a in s for b in s if a < b}


def naive_forward(model, seq):
    a = model.start * model.emit[:, seq[0]]
    for x in seq[1:]:
        a = (a @ model.move) * model.emit[:, x]
    return math.log10(a.sum())


def small_model():
    rng = np.random.default_rng(3)
    share = lambda *s: (lambda x: x / x.sum(-1, keepdims=True))(rng.random(s))
    return hmm.Model(share(3), share(3, 3), share(3, 6), np.zeros(6))


def test_forward_is_exact_and_groups_agree(monkeypatch):
    model, rng = small_model(), np.random.default_rng(4)
    seqs = [rng.integers(0, 6, n).astype(np.uint16) for n in (1, 1, 2, 5, 9, 30, 30, 7)]
    want = [naive_forward(model, s) for s in seqs]
    assert np.allclose(hmm.log_likelihoods(model, seqs), want)
    monkeypatch.setattr(hmm, "STEP_TOKENS", 10)
    assert np.allclose(hmm.log_likelihoods(model, seqs), want)
    assert np.isfinite(hmm.log_likelihoods(model, [rng.integers(0, 6, 5000).astype(np.uint16)])).all()


def test_expected_counts_equal_all_paths():
    import itertools

    model, seq = small_model(), np.array([0, 3, 5, 3], np.uint16)
    start, move, emit, total = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 6)), 0.0
    for path in itertools.product(range(3), repeat=4):
        p = model.start[path[0]] * model.emit[path[0], seq[0]]
        for i in range(1, 4):
            p *= model.move[path[i - 1], path[i]] * model.emit[path[i], seq[i]]
        total += p
        start[path[0]] += p
        for i in range(4):
            emit[path[i], seq[i]] += p
            if i:
                move[path[i - 1], path[i]] += p
    for got, want in zip(hmm.expected_counts(model, [seq, seq]), (start, move, emit), strict=True):
        assert np.allclose(got, 2 * want / total)


def test_training_raises_the_likelihood_and_scores_beat_the_base(docs, texts):
    got = {r.doc_id: r for r in hmm.score_documents(docs).collect()}
    train = [k for k in texts if zlib.crc32(str(k).encode()) % 7 != 2]
    c = Counter()
    for k in train:
        c.update(texts[k].encode().lower().split())
        c["end"] += 1
    n, v = sum(c.values()), len(c)
    for k, t in texts.items():
        w = [*t.encode().lower().split(), "end"]
        assert (got[k].n_tokens, got[k].train_tokens, got[k].n_known, got[k].held_out) == (len(w), n, sum(c[x] > 0 for x in w), k not in train)
        assert math.isclose(got[k].base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_head_words_change_nothing(docs, monkeypatch):
    monkeypatch.setattr(hmm, "SINGLES", 20)
    one = {r.doc_id: (r.base_score, r.score) for r in hmm.score_documents(docs, states=2, rounds=1, head_words=50).collect()}
    two = {r.doc_id: (r.base_score, r.score) for r in hmm.score_documents(docs, states=2, rounds=1).collect()}
    assert all(np.allclose(one[k], two[k]) for k in two)


def model_pieces():
    return piece_dropout.Pieces(open(piece_dropout.MODEL, "rb").read())


def test_pieces_without_dropout_are_the_models(texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_dropout.MODEL)
    e = piece_dropout.Encoder(model_pieces(), 0.0, 1)
    for t in [*texts.values(), "", "  a  b\n\nc ", "x" * 999, "日本 🎉"]:
        assert np.frombuffer(e.encode(t, 0), np.int32).tolist() == sp.encode(t)


def test_pieces_with_dropout_vary_and_decode(texts):
    pieces = model_pieces()
    e, again = (piece_dropout.Encoder(pieces, 0.2, 1) for _ in range(2))
    for t in texts.values():
        a, b = (np.frombuffer(e.encode(t, v), np.int32).tolist() for v in (0, 1))
        assert pieces.decode(a) == pieces.decode(b) == t
        assert a == np.frombuffer(again.encode(t, 0), np.int32).tolist()
        assert len(t) < 200 or a != b
    full = piece_dropout.Encoder(pieces, 1.0, 1)
    assert np.frombuffer(full.encode("hello", 0), np.int32).tolist() == [pieces.id[c] for c in " hello"]


def naive_pieces(pieces, run, key, rate):
    """One merge at a time: of all neighbours that make a piece and aren't skipped, the best score, then the leftmost."""
    at = list(range(len(run) + 1))
    while True:
        found = []
        for i in range(len(at) - 2):
            lo, mid, hi = at[i : i + 3]
            r = pieces.rank.get(run[lo:hi])
            if r is not None and piece_dropout.mixed_one(key + lo * piece_dropout._LO + mid * piece_dropout._MID + hi * piece_dropout._HI) >= rate * 2**53:
                found.append((r, lo, i + 1))
        if not found:
            break
        del at[min(found)[2]]
    out = []
    for lo, hi in zip(at, at[1:]):
        out += [pieces.id[run[lo:hi]]] if run[lo:hi] in pieces.id else [pieces.byte[b] for b in run[lo:hi].encode()]
    return out


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 1.0])
def test_each_occurrence_draws_its_own_merges(texts, rate, monkeypatch):
    """Whole texts against one merge at a time, under the document's and the place's key, while runs are forgotten."""
    monkeypatch.setattr(piece_dropout, "REMEMBERED", 300)
    pieces = model_pieces()
    e = piece_dropout.Encoder(pieces, rate, 9)
    some = [t[:3000] for t in list(texts.values())[:30]]
    every = [*some, some[0], "日本 🎉 ▁x \x00\x00 ab\x00 ɐɐɐbɐ" * 3, "y" * 70 + " " + "ab" * 40, "the the the the", "", "same words here " * 40]
    got = e.encode_all(every, list(range(len(every))))
    for k, t in enumerate(every):
        want, at = [], 0
        for run in piece_dropout._RUN.findall(f" {t}") if t else []:
            want += naive_pieces(pieces, run, e.document_key(k) + at * piece_dropout._AT, rate)
            at += len(run)
        assert np.frombuffer(got[k], np.int32).tolist() == want


def test_a_word_varies_within_and_across_documents():
    """Occurrences that skip a merge may reach the plain pieces by another way; the others go on varying."""
    pieces = model_pieces()
    e = piece_dropout.Encoder(pieces, 0.1, 3)
    plain = pieces.encode_run(" everything", 0, 0)
    merges: list[int] = []
    pieces.encode_run(" everything", 0, 0, merges)
    seen = [tuple(pieces.encode_run(" everything", e.document_key(d) + k * 11 * piece_dropout._AT, e.limit)) for d in range(60) for k in range(50)]
    share = sum(x == tuple(plain) for x in seen) / len(seen)
    assert 0.9 ** len(merges) < share < 0.8 and len(set(seen)) > 20
    assert len({e.encode("everything " * 30, d) for d in range(50)}) == 50


def test_matrix_has_exact_margins():
    m = sharding.communication_matrix([5, 0, 11, 8], 5, 1)
    assert m.sum(axis=1).tolist() == [5, 0, 11, 8] and m.sum(axis=0).tolist() == [5, 5, 5, 5, 4]


def test_repeat_words_equal_a_loop(spark):
    texts = ["a b c a b c", "a a a a", "a b c d", "", "a b c x a b c y b c x", "q w e r t y q w e"]

    def loop(t):
        w = t.split()
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        return len({j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)})

    got = quality.with_features(spark.createDataFrame([(t,) for t in texts], "text string"), ("n_repeat_words",)).collect()
    assert {r.text: r.n_repeat_words for r in got} == {t: loop(t) for t in texts}


@pytest.mark.parametrize("vocabulary", [3, 60, 12_000])
def test_scan_equals_a_look_at_every_window(vocabulary):
    """Words as digits of two and three places, against each window of each text."""
    rng = np.random.default_rng(vocabulary)
    draw = lambda n: " ".join(f"w{x}" for x in rng.integers(0, vocabulary, n))
    items = [(str(k), draw(int(rng.integers(1, 40)))) for k in range(30)] + [("all", " ".join(f"w{x}" for x in range(vocabulary)))]
    items += [("none", ""), ("30", items[3][1])]
    a = decontaminate.automaton(items, 4)
    windows = {}
    for k, t in items:
        w = t.split()
        for i in range(max(1, len(w) - 3) if w else 0):
            windows.setdefault(tuple(w[i : i + 4]), set()).add(k)
    for _ in range(40):
        parts = [draw(int(rng.integers(0, 6))) if rng.random() < 0.5 else items[int(rng.integers(0, 31))][1].replace(" ", "; ") for _ in range(4)]
        text = f"é{'. Other '.join(parts)}."
        w = [x.decode() for x in decontaminate.normal_words(text)]
        hit = [(i, i + n) for n in range(1, 5) for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows]
        n, covered, found, spans = decontaminate.scan(text, a)
        assert (n, covered) == (len(w), len({j for lo, hi in hit for j in range(lo, hi)}))
        assert found == {k for lo, hi in hit for k in windows[tuple(w[lo:hi])]}
        assert [x for lo, hi in spans for x in decontaminate.normal_words(text[lo:hi])] == [x.encode() for j, x in enumerate(w) if any(lo <= j < hi for lo, hi in hit)]


def test_states_raise_the_held_out_score(docs):
    """Eight states score texts that they haven't seen better than one state does, which scores as the counts alone would."""
    score = lambda k: docs_mean([r for r in hmm.score_documents(docs, states=k).collect() if r.held_out])
    docs_mean = lambda rows: sum(r.score for r in rows) / sum(r.n_tokens for r in rows)
    assert score(8) > score(1) + 0.02


def test_one_automaton_of_a_large_benchmark(spark, monkeypatch):
    """200,000 words of benchmark are one automaton, and one pass over the documents finds what windows looked up in a set find."""
    rng = np.random.default_rng(5)
    vocabulary = [f"v{k}" for k in range(3000)]
    draw = lambda n: [vocabulary[k] for k in rng.zipf(1.4, n) % 3000]
    items = [(k, draw(int(rng.integers(1, 400)))) for k in range(1000)]
    assert sum(len(w) for _, w in items) > 190_000
    windows = {}
    for k, w in items:
        for i in range(max(1, len(w) - 9)):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(k))
    sizes = {len(w) for w in windows}
    docs = []
    for k in range(60):
        w = draw(int(rng.integers(0, 300)))
        for _ in range(int(rng.integers(0, 4))):
            item = items[int(rng.integers(0, 1000))][1]
            lo = int(rng.integers(0, len(item)))
            w[len(w) // 2 : len(w) // 2] = item[lo : lo + int(rng.integers(5, 40))]
        docs.append((k, w))
    scans, one = [], decontaminate._scan_block
    monkeypatch.setattr(decontaminate, "_scan_block", lambda *a: scans.append(1) or one(*a))
    got = decontaminate.benchmark_hits(spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string"))
    got = {r.doc_id: r.hits for r in got.collect()}
    assert len(scans) == 1
    for k, w in docs:
        hit = [(i, i + n) for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows]
        assert (got[k].n_words, got[k].n_hit) == (len(w), len({j for lo, hi in hit for j in range(lo, hi)}))
        assert got[k].item_ids == sorted({x for lo, hi in hit for x in windows[tuple(w[lo:hi])]})


def test_lanes_and_portions_leave_no_seam(monkeypatch):
    """Texts of several lanes, and lanes of any length, are hit alike."""
    rng = np.random.default_rng(6)
    items = [(str(k), " ".join(f"w{x}" for x in rng.integers(0, 3, int(rng.integers(1, 9))))) for k in range(9)]
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 4, n)) for n in (0, 1, 63, 64, 65, 700)]
    a = decontaminate.automaton(items, 5)
    want = decontaminate.scan_all(texts, a)
    for lane in (1, 7, 10_000):
        monkeypatch.setattr(decontaminate, "LANE", lane)
        assert decontaminate.scan_all(texts, a) == want == [decontaminate.scan(t, a) for t in texts]
