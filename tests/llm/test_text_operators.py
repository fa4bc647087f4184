"""Operators on documents: classifier, rules, line dedup, near-dedup, packing, counting and coding."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.llm import decision_list, line_dedup, minhash, packing, rule_ensemble, unigram
from tessel.llm.common import held_out

EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "one two three"), (5, "x" * 50_000 + " end"), (6, "a b c d e " * 4000)]
DOCS = "doc_id long, text string, score double, kept string, line string, label int, print string, _c string"


def frame(spark, rows):
    """Documents with other columns whose names operators use for themselves."""
    return spark.createDataFrame([(i, t, 0.5, "k", "l", 7, "p", "c") for i, t in rows], DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, prose(rng, 60) if not bad else " ".join(w + "###" for w in prose(rng, 60).split())))
        labels.append((i, 0 if bad else 1, 0))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rule_ensemble(spark, labelled):
    docs, labels = labelled
    model = rule_ensemble.fit(docs, labels)
    assert model.rules
    out = rule_ensemble.score_documents(docs, model).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (out.predicted == out.quality)[out.held_out].mean() > 0.97
    assert out.score.between(0, 1).all()
    stats = docs.select("doc_id", rule_ensemble.statistics(F.coalesce("text", F.lit(""))).alias("s")).select("doc_id", "s.*").toPandas().set_index("doc_id")
    for _, r in out.head(40).iterrows():  # the compiled expression against the rules read one by one
        x = stats.loc[r.doc_id]
        total = model.intercept + sum(w for rule, w in model.rules if all((x[n] > t) if above else (x[n] <= t) for n, above, t in rule.terms))
        assert abs(1 / (1 + np.exp(-total)) - r.score) < 1e-9
    edge = rule_ensemble.score_documents(frame(spark, EDGES), model).toPandas()
    assert len(edge) == len(EDGES) and edge.score.between(0, 1).all()
    assert sorted(out[out.held_out].doc_id) == [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]


def test_rule_ensemble_without_labels(spark, labelled):
    docs, labels = labelled
    none = rule_ensemble.fit(docs, labels.limit(0))
    assert rule_ensemble.score_documents(docs, none).select("score").distinct().first()[0] == 0.5
    one = rule_ensemble.fit(docs, labels.where("quality = 1"))
    assert rule_ensemble.score_documents(docs, one).select("score").distinct().count() == 1
    assert rule_ensemble.score_documents(docs.limit(0), one).count() == 0


def plain_counts(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    seen, hit = defaultdict(list), set()
    for i in range(len(words) - 4):
        seen[tuple(words[i : i + 5])].append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {i + k for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_text_counts():
    rng = random.Random(5)
    texts = [t for _, t in EDGES[:4]] + ["a b c", "a b c d e a b c d e", "é|x\n é|x\né|x\n\n \n", "a b c d e f " * 7]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "d# ", "e\t"]) for _ in range(rng.randint(1, 80))) for _ in range(300)]
    texts += [prose(rng, 9000) + " " + prose(random.Random(1), 30) * 2]
    for t in texts:
        assert decision_list.text_counts(t) == plain_counts(t), t


def test_decision_list(spark, labelled):
    docs, labels = labelled
    rules = decision_list.fit(docs, labels)
    assert rules.rules
    out = decision_list.judge_documents(docs, rules).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (out.kept.astype(int) == out.quality).mean() > 0.97
    texts = {r.doc_id: r.text for r in docs.collect()}
    for _, r in out.head(60).iterrows():
        n, chars, symbols, dups, repeats = plain_counts(texts[r.doc_id])
        x = {"words": n, "word_length": chars / n, "symbol_share": symbols / chars, "repeat_share": repeats / n, "dup_lines_share": dups / n}
        failed = n < 10 or 100 * repeats > 20 * n
        rejected = any(all(x[k] >= t if above else x[k] <= t for k, above, t in rule) for rule in rules.rules)
        assert (r.base_failed, r.kept) == (failed, not failed and not rejected)
    edge = decision_list.judge_documents(frame(spark, EDGES), rules).toPandas().set_index("doc_id")
    assert edge.loc[[1, 2, 3, 4, 6]].base_failed.all() and not edge.loc[[1, 2]].kept.any()
    nothing = decision_list.fit(docs, labels.limit(0))
    assert nothing.rules == [] and decision_list.judge_documents(docs, nothing).where("kept").count() == 400


def test_line_dedup(spark):
    long = "This line is long enough to be looked at, surely."
    rng = random.Random(9)
    shared = [f"{prose(rng, 8)} {i} and so it is more than forty characters" for i in range(4)]
    rows = [(i, "\n".join(rng.choice([*shared, "short", " " + shared[0].upper() + "\t", "", f"own line {i} which is also more than forty chars"]) for _ in range(6))) for i in range(40)]
    rows += [(100 + i, f"{long}\nmine {i}\n{long}") for i in range(4)] + EDGES + [(100, f"{long}\nmine 0\n{long}"), (None, shared[1])]
    docs = frame(spark, rows)
    key = lambda x: "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    keeper = {k: max(i for i in v if i is not None) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), i) == i]
        want.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert keeper and long.lower() not in keeper  # in four documents only, one of them twice
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "line_dedup"]
    got = [(r.doc_id, r.text, r.line_dedup.n_lines, r.line_dedup.n_dropped) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def word_shingles(text, n=5):
    words = (text or "").encode().split()
    return Counter(tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, min(len(words), 1))))


class Weighted:
    """The weighted Jaccard similarity of texts, from word tuples and exact document frequencies."""

    def __init__(self, texts):
        self.df = Counter(s for t in texts for s in word_shingles(t))
        self.n = len(texts)

    def weights(self, text):
        return {s: k * math.sqrt(1 - math.log(max(self.df[s] / self.n, minhash.FREQUENT))) for s, k in word_shingles(text).items()}

    def __call__(self, a, b):
        a, b = self.weights(a), self.weights(b)
        shared = sum(min(w, b[s]) for s, w in a.items() if s in b)
        return shared / (sum(a.values()) + sum(b.values()) - shared) if a and b else 0.0


@pytest.mark.parametrize("block", [128, 2])
def test_minhash(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(1)
    rows, n = [], 0
    for _ in range(12):
        words = prose(rng, 120).split()
        for k in range(rng.randint(1, 6)):
            w = list(words)
            for _ in range(k):
                w[rng.randrange(len(w))] = "changed"
            rows.append((n, " ".join(w)))
            n += 1
    base = prose(rng, 300)
    chain = base.split()
    for k in range(5):  # neighbours are near, the ends are not
        rows.append((n + k, " ".join(chain[k * 8 : 250 + k * 8])))
    rows += [(200, "a b"), (201, "a b"), (202, None), (203, None), (204, ""), (205, ""), (206, "lone words only here now then"), (207, rows[0][1])]
    docs = frame(spark, rows)
    found = minhash.near_duplicates(docs)
    similar = Weighted([t for _, t in rows])
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(rows):
        for j, b in rows[:x]:
            if (a is not None and a == b) or similar(a, b) >= 0.8:
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    got = {r.doc_id: r.class_id for r in found.classes.collect()}
    assert got == {i: root(i) for i, _ in rows}
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows if root(i) == i}


def test_minhash_repeated_ids_and_empty(spark):
    text = prose(random.Random(2), 50)
    docs = frame(spark, [(1, text), (1, text), (2, text), (3, "x y z"), (3, text), (None, text)])
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).classes.collect()} == {1: 1, 2: 1, 3: 1}
    assert minhash.near_duplicates(docs.limit(0)).classes.count() == 0
    assert minhash.near_duplicates(frame(spark, [(1, None)])).classes.count() == 1


def test_frequent_shingles_are_exact(spark):
    rng = random.Random(9)
    common = [prose(rng, 8) for _ in range(6)]
    texts = [prose(rng, 30) + " " + " ".join(c for k, c in enumerate(common) if rng.random() < 0.02 * 2**k) + " " + prose(rng, 5) for _ in range(400)] + [None, "", "a b"]
    df = Counter(s for t in texts for s in word_shingles(t))
    want = {int(minhash.shingles(b" ".join(s).decode())[0][0]): k / len(texts) for s, k in df.items() if k >= minhash.FREQUENT * len(texts)}
    h, shares = minhash.frequent_shingles(frame(spark, list(enumerate(texts))).repartition(3))
    assert dict(zip(h.tolist(), shares.tolist())) == want and len(want) > 10


def test_sampler_estimates_similarity():
    rng = random.Random(4)
    s = minhash.Sampler(np.zeros(0, np.uint64), np.zeros(0))
    agree = wanted = 0
    for _ in range(30):
        words = prose(rng, 2000).split()
        a, b = minhash.shingles(" ".join(words[:1800])), minhash.shingles(" ".join(words[200:]))
        wanted += s.similarity(a, b) ** minhash.ROWS / 30
        agree += (s.bands(*a) == s.bands(*b)).mean() / 30
    assert abs(agree - wanted) < 0.1


def test_bands_of_several_texts_are_those_of_each():
    rng = random.Random(5)
    frequent = np.sort(minhash.shingles(prose(rng, 50))[0])
    s = minhash.Sampler(frequent, np.full(len(frequent), 0.3))
    each = [minhash.shingles(prose(rng, n)) for n in (3, 0, 700, 5, 20)] + [(frequent, np.ones(len(frequent), np.int64))]
    together = s.bands(np.concatenate([h for h, _ in each]), np.concatenate([tf for _, tf in each]), np.array([len(h) for h, _ in each]))
    assert (together == np.concatenate([s.bands(*x) for x in each if len(x[0])])).all()


def test_near_copies_are_candidates():
    """Pairs at a weighted similarity of 0.8 to 0.9, in a group that a third of all documents share, share a band."""
    rng = np.random.default_rng(6)
    missed = 0
    for _ in range(400):
        h = rng.integers(0, 2**63, 1000, np.uint64) * np.uint64(2)
        common = np.sort(h[:900])
        s = minhash.Sampler(common, np.full(900, 1 / 3))
        a, b = np.unique(h[:950]), np.unique(np.concatenate([h[:900], h[950:]]))
        one = np.ones(950, np.int64)
        assert 0.8 < s.similarity((a, one), (b, one)) < 0.9
        missed += not (s.bands(a, one) == s.bands(b, one)).any()
    assert missed == 0


def test_very_long_and_hard_words():
    rng = random.Random(11)
    words = prose(rng, 60_000).split()
    texts = [" ".join(words), "\n\t".join(words), "x" * 400_000, "x" * 400_000 + " y", "x" * 5000 + " y"]
    found = [minhash.shingles(t) for t in texts]
    assert len(found[0][0]) > 59_000 and (found[0][0] == found[1][0]).all() and [len(h) for h, _ in found[2:]] == [1, 1, 1]
    want = Counter(word_shingles(texts[0]).values())
    assert Counter(found[0][1].tolist()) == want


def brute_plan(positions, penalties, size):
    best = {0: 0}
    for p, c in zip(positions, penalties):
        best[p] = min(best[i] + size - (p - i) + c for i in best if 0 < p - i <= size)
    return min(best[p] for p in positions if p > positions[-1] - size)


def test_plan_cuts():
    rng = random.Random(7)
    for _ in range(200):
        size = rng.choice([4, 8, 16])
        positions = sorted(rng.sample(range(1, 80), rng.randint(25, 60)))
        positions = [p for p in range(1, 80) if p in positions or p % size == 0]
        penalties = [rng.choice([0, 1, 3]) for _ in positions]
        cuts = packing.plan_cuts(positions, penalties, size)
        cost, last, by = 0, 0, dict(zip(positions, penalties))
        for c in cuts:
            assert 0 < c - last <= size
            cost, last = cost + size - (c - last) + by[c], c
        assert cost == brute_plan(positions, penalties, size)


def test_packing(spark):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    rows = [(i, ". ".join(prose(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 40)))) for i in range(80)]
    rows += [(1000 + i, t) for i, t in EDGES] + [(2000, "a  b\n\nc <|endoftext|> d e\tf 日本"), (0, rows[0][1]), (3000, " lead and trail ")]
    out = packing.pack_documents(frame(spark, rows).repartition(2), packing.tokenizer_path()).toPandas()
    tok = Tokenizer.from_file(packing.tokenizer_path())
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    for i, g in out[out.doc_id != 0].groupby("doc_id"):
        g = g.sort_values("start")
        assert list(g.start) == [0, *g.length.cumsum()[:-1]] and g.length.sum() == len(ids[i]) == g.doc_tokens.iloc[0]
        for r in g.itertuples():
            part = np.array(ids[i][r.start : r.start + r.length], "<u4").tobytes()
            assert zlib.crc32(part) == r.ids_crc32
    lengths = []
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]]
        lengths.append(int(g.length.sum()))
    assert max(lengths) <= 2048 and out.length.min() >= 1
    assert sum(0 if n & (n - 1) == 0 else 2048 - n for n in lengths) < 0.01 * sum(lengths)
    assert packing.pack_documents(frame(spark, []), packing.tokenizer_path()).count() == 0


def cut_shares(out, ids, ends):
    """Of the sequences' ends, how many are at documents, at sentences and elsewhere."""
    found = [0, 0, 0]
    for _, g in out.groupby("sequence_id"):
        r = g.sort_values("offset").iloc[-1]
        at = r.start + r.length
        found[0 if at == r.doc_tokens else 1 if ends[ids[r.doc_id][at - 1]] else 2] += 1
    return found


def test_packing_cuts_at_boundaries(spark):
    """Sequences end at documents and sentences; elsewhere only in a stretch without either that is longer than a sequence."""
    rng = random.Random(18)
    rows = [(i, ". ".join(prose(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 200)))) for i in range(120)]
    tok = packing.encoder(packing.tokenizer_path())
    of = lambda rows: {i: [*np.frombuffer(tok.ids(t), "<u4").tolist(), 1] for i, t in rows}
    out = packing.pack_documents(frame(spark, rows).repartition(1), packing.tokenizer_path()).toPandas()
    documents, sentences, inside = cut_shares(out, of(rows), tok.ends)
    assert documents and sentences > 60 and inside <= 12  # those of the partition's remainder, in powers of two
    used = out.groupby("sequence_id").length.sum()
    assert (2048 - used[used & (used - 1) != 0]).sum() < 0.03 * used.sum()
    endless = [(1, prose(rng, 9000).replace(".", " "))]  # no sentence ends in it
    out = packing.pack_documents(frame(spark, endless), packing.tokenizer_path()).toPandas()
    assert out.groupby("sequence_id").length.sum().max() <= 2048 and out.length.sum() == len(of(endless)[1])
    assert cut_shares(out, of(endless), tok.ends)[2] > 5


TEXTS = ["a  b\n\n c\t", "日本語 テスト😀 x", "  lead", " ", "\n", "é½ﬁ ab", "the quick brown fox, jumps. over!", "", "x" * 300]


@pytest.fixture(scope="module")
def unigram_tokenizer():
    import sentencepiece
    from tokenizers import Tokenizer, models

    m = sentencepiece.SentencePieceProcessor(model_file=unigram.model_path())
    return Tokenizer(models.Unigram([(m.id_to_piece(i), m.get_score(i)) for i in range(m.vocab_size())], 0, True))


def test_unigram_against_a_tokenizer(unigram_tokenizer):
    w, rng = unigram.Worker.of(unigram.model_path()), random.Random(6)
    for t in TEXTS + [prose(rng, 40) for _ in range(20)] + ["".join(rng.choice("ab é\n▂😀.,") for _ in range(60)) for _ in range(50)]:
        want = unigram_tokenizer.encode("▁" + t.replace(" ", "▁")).ids if t else []
        assert list(w.encode(t)) == want, t
        assert w.count(t)[0] == len(want)
        assert w.decode(w.encode(t)) == t


def test_streaming_is_the_same_in_any_parts():
    v, rng = unigram.Worker.of(unigram.model_path()).v, random.Random(2)
    text = "▁" + "▁".join(prose(rng, 300).split()) + "😀é"
    whole = unigram.StreamingViterbi(v)
    ids = whole.feed(text) + whole.finish()
    for size in (1, 7, 64):
        s, out = unigram.StreamingViterbi(v), []
        for i in range(0, len(text), size):
            out += s.feed(text[i : i + size])
        assert out + s.finish() == ids
        assert s.widest < 300  # of some 1,500 characters


def test_remembered_parts_change_nothing():
    """One stream over the whole text gives the ids that encode gives with what it remembers, for texts of many parts."""
    w, rng = unigram.Worker.of(unigram.model_path()), random.Random(12)
    for t in [*TEXTS, "\n".join(prose(rng, 60) + " 日本😀  x" for _ in range(5)), " ".join(prose(rng, 1) * 40 for _ in range(6))]:
        s = unigram.StreamingViterbi(w.v)
        want = s.feed("▁" + t.replace(" ", "▁")) + s.finish() if t else []
        assert list(w.encode(t)) == want == list(w.encode(t)), t


def test_one_stream_gives_ids_out_before_the_end():
    """What the query runs gets a text in parts and commits where paths meet, in one word as well as in prose."""
    w, rng = unigram.Worker.of(unigram.model_path()), random.Random(8)
    for t in (prose(rng, 4000), "".join(rng.choice("abcdefgh") for _ in range(20_000)), "é" * 9000):
        given = list(w.encoded(t))
        assert len(given) == -(-len(t) // unigram.PART) + 1
        assert all(given[:-1]) and len(given[-1]) < sum(map(len, given)) / 10
        assert sum(given, []) == list(w.encode(t))
        s = unigram.StreamingViterbi(w.v, {})
        for i in range(0, len(t), 500):
            s.feed(t[i : i + 500].replace(" ", unigram.SPACE))
        assert s.widest < 100 + 5 * w.v.longest


def test_stream_where_pieces_cross_spaces_and_lines():
    """Points ahead of spaces and about line feeds aren't boundaries by themselves: it depends on the pieces."""
    rng = random.Random(3)
    pieces = ["a", "b", "▁", "\n", "a▁b", "▁▁", "b\na", "\n\n", "▁a", "ab▁▁a", "b▁"]
    v = unigram.Vocabulary([(p, -float(rng.randint(1, 9)), i) for i, p in enumerate(pieces)], 20, 276)
    score = {p: next(s for _, (_, s, i) in v.automaton.iter(p) if i == k) for k, p in enumerate(pieces)}

    def best(text):
        top, back = [0.0], [""]
        for end in range(1, len(text) + 1):
            found = [(top[end - len(p)] + score[p], len(p), p) for p in pieces if text[:end].endswith(p)]
            s, _, p = max(found)
            top.append(s)
            back.append(p)
        out, at = [], len(text)
        while at:
            out.insert(0, pieces.index(back[at]))
            at -= len(back[at])
        return out

    known = {}
    for _ in range(300):
        text = "".join(rng.choice("ab▁\n") for _ in range(rng.randint(1, 40)))
        for memory in (None, known):
            for size in (1, 3, 50):
                s, out = unigram.StreamingViterbi(v, memory), []
                for i in range(0, len(text), size):
                    out += s.feed(text[i : i + size])
                assert out + s.finish() == best(text), text
    assert known


def test_unigram_ties():
    v = unigram.Vocabulary([("a", -1.0, 0), ("b", -1.0, 1), ("ab", -2.0, 2), ("ba", -2.0, 3), ("aba", -3.0, 4)], 5, 261)
    s = unigram.StreamingViterbi(v)
    assert s.feed("aba") + s.finish() == [4]
    assert unigram.count_pieces(v, "aba") == (1, -3.0)
    assert unigram.count_pieces(v, "ac") == (2, -1.0 - 13.0)


def test_unigram_jobs(spark):
    docs = frame(spark, EDGES + list(enumerate(TEXTS, 50)))
    counts = {r.doc_id: r.n_tokens for r in unigram.count_tokens(docs, unigram.model_path()).collect()}
    coded = {r.doc_id: r for r in unigram.code_digests(docs, unigram.model_path()).collect()}
    full = {r.doc_id: r for r in unigram.encode_texts(docs, unigram.model_path()).collect()}
    assert counts[1] == counts[2] == 0
    for i, r in coded.items():
        assert r.n_ids == counts[i] == len(full[i].ids) and r.round_trip
        assert r.decoded_sha256 == hashlib.sha256(full[i].decoded.encode()).hexdigest()
    assert unigram.count_tokens(docs.limit(0), unigram.model_path()).count() == 0


def test_held_out_of_null(spark):
    assert spark.range(1).select(held_out(F.lit(None).cast("long"))).first()[0] is False
