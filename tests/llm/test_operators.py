import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tiegrid.llm import bpe, decontam, lm, passages, pii, quality, simhash, tokencount, topk, toxicity
from tiegrid.llm.queries import PIECES, WORD_BPE, tokenizer_path

from .conftest import sentence


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- SimHash


def plain_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Smallest id reachable over fingerprints that differ in 3 bits or fewer."""
    parent = {f: f for f in set(prints.values())}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    values = sorted(parent)
    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = defaultdict(lambda: math.inf)
    for i, f in prints.items():
        least[find(f)] = min(least[find(f)], i)
    return {i: least[find(f)] for i, f in prints.items()}


def test_simhash_matches_brute_force(make):
    texts = {i: sentence(i % 40, 60 + i % 7) for i in range(160)}
    found = rows(simhash.near_duplicates(make(texts.items())))
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {i: f % 2**64 for i, f, _ in found} == prints
    assert {i: c for i, _, c in found} == components(prints)


def test_simhash_links_lose_nothing(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = set(base)
    for b in base:
        for _ in range(30):
            for _ in range(rng.randint(1, 3)):
                b ^= 1 << rng.randrange(64)
            values.add(b)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    edges = rows(simhash.links(spark.createDataFrame([(v, v) for v in signed], "fp bigint, node bigint")).select("u", "v"))
    assert all(((u ^ v) % 2**64).bit_count() <= 64 for u, v in edges)
    want = components({v % 2**64: v % 2**64 for v in signed})
    parent = {v: v for v in signed}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for u, v in edges:
        parent[find(u)] = find(v)
    groups = defaultdict(set)
    for v in signed:
        groups[find(v)].add(want[v % 2**64])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_simhash_odd_rows(make, odd_rows):
    found = rows(simhash.near_duplicates(make(odd_rows)))
    assert len(found) == len(odd_rows)
    assert {c for i, f, c in found if f == 0} == {1}
    assert rows(simhash.near_duplicates(make([]))) == []


def test_deduplicate_keeps_one_of_each_group(make):
    words = [f"{w}{k}" for k, w in enumerate(sentence(3, 400).split())]
    base = " ".join(words)
    words[150] = "other"
    docs = make([(1, base), (2, base), (3, " ".join(words)), (4, sentence(9, 300)), (4, sentence(9, 300)), (None, base)])
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r[0] is None, r[0] or 0) for r in rows(kept)) == [(False, 1), (False, 4), (True, 0)]
    # Of different rows with one id the same stays, however the table is dealt out.
    twice = [(1, base), (1, sentence(21, 90)), (1, sentence(22, 90)), (2, sentence(23, 90))]
    one, other = (rows(simhash.deduplicate(make(order).repartition(n))) for order, n in ((twice, 1), (twice[::-1], 3)))
    assert sorted(one) == sorted(other) and len(one) == 2


# --- passages


def test_shared_passages(make):
    shared = sentence(77, 70)
    edited = shared.split()
    edited[35] = "edited"
    docs = [(1, sentence(1, 80) + " " + shared + " " + sentence(2, 50)), (2, sentence(3, 40) + " " + shared), (3, sentence(4, 90) + " " + " ".join(edited) + " " + sentence(5, 20)), (4, sentence(6, 200)), (5, None), (6, "")]
    found = rows(passages.shared_passages(make(docs)))
    assert {r[0] for r in found} == {1, 2, 3}
    for i, a, b, *_ in found:
        assert b - a >= 50
    one = next(r for r in found if r[0] == 2)
    assert one[1] <= 42 and one[2] == 110
    assert rows(passages.shared_passages(make([]))) == []


def test_passages_of_many_copies_stay_linear(make):
    text = sentence(8, 90)
    found = rows(passages.shared_passages(make([(i, text) for i in range(300)])))
    assert {r[0] for r in found} == set(range(300))
    assert len(found) < 1200


def test_passages_whose_parts_occur_alone(make):
    words = sentence(501, 80).split()
    part = lambda a, b: " ".join(words[a:b])
    docs = [(1, sentence(502, 40) + " " + part(0, 45)), (2, part(35, 80) + " " + sentence(503, 40)), (3, sentence(504, 30) + " " + part(0, 80)), (4, part(0, 80) + " " + sentence(505, 30)), (5, sentence(506, 30))]
    found = rows(passages.shared_passages(make(docs)))
    assert {(r[0], r[3]) for r in found} == {(3, 4), (4, 3)}
    assert all(r[2] - r[1] >= 80 and r[6] >= 80 for r in found)


def test_equal_passages_match_brute_force(make):
    rng = random.Random(11)
    source = [f"w{rng.randrange(10_000)}" for _ in range(400)]
    docs = {}
    for i in range(150):
        cuts = [source[a : a + rng.randrange(20, 90)] for a in (rng.randrange(360) for _ in range(3))]
        docs[i] = [w for cut in cuts for w in (*cut, *(f"x{rng.randrange(10**9)}" for _ in range(10)))]
    holders = defaultdict(set)
    for i, words in docs.items():
        for k in range(len(words) - 49):
            holders[tuple(words[k : k + 50])].add(i)
    covered = defaultdict(set)
    for i, a, b, *_ in rows(passages.shared_passages(make([(i, " ".join(words)) for i, words in docs.items()]))):
        covered[i] |= set(range(a, b))
    for i, words in docs.items():
        for k in range(len(words) - 49):
            if len(holders[tuple(words[k : k + 50])]) > 1:
                assert set(range(k, k + 50)) <= covered[i]


def test_chains_match_brute_force():
    far_then_near = [(5 * i, 5 * i) for i in range(40)] + [(290, 250), (300, 260), (310, 270)]
    assert (290, 310 + passages.K, 250, 270 + passages.K) in passages.chains(far_then_near)
    rng = random.Random(3)
    for _ in range(200):
        matches = sorted({(rng.randrange(150), rng.randrange(150)) for _ in range(rng.randrange(1, 30))})
        # The same recurrence with a search through all pairs in place of the tree.
        score, parent = [], []
        for k, (a, b) in enumerate(matches):
            near = [(score[j] + passages.COST * (x + y), j) for j, (x, y) in enumerate(matches[:k]) if 0 < a - x <= passages.MAX_GAP and 0 < b - y <= passages.MAX_GAP]
            j = max(near, default=(0, -1))[1]
            joined = score[j] + min(passages.K, a - matches[j][0], b - matches[j][1]) - passages.COST * (a - matches[j][0] + b - matches[j][1]) if j >= 0 else 0
            score.append(joined if joined > passages.K else float(passages.K))
            parent.append(j if joined > passages.K else -1)
        want, taken = [], set()
        for k in sorted(range(len(matches)), key=lambda k: -score[k]):
            if k not in taken:
                chain = [k]
                while parent[chain[-1]] >= 0 and parent[chain[-1]] not in taken:
                    chain.append(parent[chain[-1]])
                taken.update(chain)
                want.append((matches[chain[-1]][0], matches[k][0] + passages.K, matches[chain[-1]][1], matches[k][1] + passages.K))
        assert sorted(passages.chains(matches)) == sorted(want)
    tree, plain = passages.Fenwick(40), {}
    for _ in range(3000):
        p, q = sorted((rng.randrange(1, 41), rng.randrange(1, 41)))
        if rng.random() < 0.3 and plain:
            gone = rng.choice(list(plain))
            tree.clear(gone)
            del plain[gone]
        elif p not in plain:
            plain[p] = (rng.random(), p)
            tree.put(p, plain[p])
        assert tree.most(p, q) == max((v for k, v in plain.items() if p <= k <= q), default=tree.NONE)


def edited(words, rng, replaced, added=0):
    out = [f"q{rng.randrange(10**7)}" if rng.random() < replaced else w for w in words]
    for _ in range(added):
        at = rng.randrange(10, len(out) - 10)
        out[at:at] = [f"q{rng.randrange(10**7)}" for _ in range(2)]
    return out


@pytest.mark.parametrize(("replaced", "added", "least"), [(0.1, 0, 0.99), (0.15, 0, 0.97), (0.19, 0, 0.9), (0.0, 2, 0.99), (0.08, 1, 0.98)])
def test_recall_of_fuzzy_passages(make, replaced, added, least):
    """Planted pairs of 80-word passages of which at least 80 % of the words agree, found in both texts."""
    rng = random.Random(17)
    noise = lambda n: [f"n{rng.randrange(30_000)}" for _ in range(n)]
    docs, planted = {}, []
    for k in range(250):
        words = noise(80)
        other = edited(words, rng, replaced, added)
        if sum(w in other for w in words) < 0.81 * max(len(words), len(other)):
            continue
        docs[2 * k], docs[2 * k + 1] = [*noise(60), *words, *noise(30)], [*noise(20), *other, *noise(70)]
        planted.append((2 * k, 2 * k + 1))
    found = {(r[0], r[3]) for r in rows(passages.shared_passages(make([(i, " ".join(w)) for i, w in docs.items()])))}
    assert sum(p in found and p[::-1] in found for p in planted) >= least * len(planted)
    assert found <= {q for p in planted for q in (p, p[::-1])}


def test_passages_of_odd_rows(spark, make, odd_rows, monkeypatch):
    """Repeated ids count as one text, batches and hot seeds change nothing, and ids can be strings."""
    text, other = sentence(71, 90), sentence(72, 90)
    docs = [*odd_rows, (50, text), (50, text), (51, text), (52, other), (53, other + " end"), (54, "again " * 3000)]
    found = rows(passages.shared_passages(make(docs)))
    assert len(found) == len(set(found)) and {(r[0], r[3]) for r in found} == {(50, 51), (51, 50), (52, 53), (53, 52)}
    named = spark.createDataFrame([(f"doc{i}", t, 1) for i, t in docs if i and i >= 50 and i != 50], "name string, text string, row int")
    assert {(r[0], r[3]) for r in rows(passages.shared_passages(named, "name"))} == {("doc52", "doc53"), ("doc53", "doc52")}
    monkeypatch.setattr(passages, "AT_ONCE", 100)
    again = rows(passages.shared_passages(make(docs)))
    assert {(r[0], r[3]) for r in again} == {(50, 51), (51, 50), (52, 53), (53, 52)}


def test_anchors_stream_over_batches(spark):
    """Every asked place whose key occurs in another row is matched to one such place, whatever the batches."""
    rng = random.Random(9)
    places = sorted({(rng.choice([1, 1, 2, 3, 4, 5, *range(6, 200)]), rng.randrange(25), rng.randrange(60)) for _ in range(3000)})
    asked = [rng.random() < 0.7 for _ in places]
    holders = defaultdict(set)
    for k, r, p in places:
        holders[k].add((r, p))
    want = {(r, p, k) for (k, r, p), a in zip(places, asked, strict=True) if a and any(x != r for x, _ in holders[k])}
    schema = passages.PLACED
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        table = spark.createDataFrame([(k, r, p, None, None, False, a) for (k, r, p), a in zip(places, asked, strict=True)], schema)
        got = [(r["row"], m["pos"], m["row"], m["their"], m["more"]) for r in passages.anchored(table).collect() for m in r["m"]]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    seen = Counter()
    for row, pos, other, their, more in got:
        keys = [k for k in holders if (row, pos) in holders[k] and (other, their) in holders[k]]
        assert keys and other != row and any(more == (len(holders[k]) > 2) for k in keys)
        seen[row, pos] += 1
    assert seen == Counter((r, p) for r, p, _ in want)


# --- token counts


@pytest.mark.parametrize("by_bytes", [True, False])
def test_token_counts_equal_the_library(by_bytes):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = [p for p in tokencount.unigram_pieces(tokenizer_path(PIECES)) if by_bytes or not p[0].startswith("<0x")]
    library = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=by_bytes))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    rng = random.Random(1)
    texts = ["", " ", "a", "▁", "日a本本", sentence(4, 400)] + ["".join(rng.choice("abeinorst  \n▁é日😀7!") for _ in range(rng.randrange(50))) for _ in range(3000)]
    counter = tokencount.Counter(pieces)
    assert [counter.text(t)[0] for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_odd_rows(make, odd_rows):
    pieces = [("▁lunar", -1.0), ("▁", -3.0), ("lunar", -2.0), ("▁crater", -1.0)]
    found = rows(tokencount.count_tokens(make(odd_rows), pieces))
    assert len(found) == len(odd_rows)
    assert [n for i, n, _ in found if i == 4] == [2, 2] and [n for i, n, _ in found if i in (1, 2)] == [0, 0]
    assert rows(tokencount.count_tokens(make([]), pieces)) == []


# --- language model


def test_lm_counts_and_base_score(make, odd_rows):
    docs = [*odd_rows, *((100 + i, sentence(i, 40)) for i in range(60))]
    found = rows(lm.score_documents(make(docs)))
    assert len(found) == len(docs)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, t in docs if not held(i) for w in lm.tokens((t or "").encode()))
    total, size = sum(counts.values()), len(counts)
    want = sorted((i or -1, len(k := lm.tokens((t or "").encode())), sum(counts[w] > 0 for w in k), sum(math.log10((counts[w] + 1) / (total + size + 1)) for w in k)) for i, t in docs)
    got = sorted((r[0] or -1, r[2], r[3], r[5]) for r in found)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want])
    assert all(r[1] == held(r[0]) and r[4] == total for r in found)
    assert rows(lm.score_documents(make([]))) == []


def test_lm_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    params = lm.initial(30, np.arange(30.0))
    first, second, norm = lm.score_tables(params)
    chance = 10 ** (first[:, None, :] + second[None, :, :] - norm[:, :, None])
    assert np.allclose(chance.sum(2), 1, atol=1e-4) and (chance[:, :, -1] == 0).all()
    stream = np.zeros(60_000, np.int64)
    for k in range(1, len(stream)):
        stream[k] = (stream[k - 1] + 1) % 10 if rng.random() < 0.9 else rng.integers(10)
    counts = np.append(np.bincount(stream, minlength=11).astype(float), 0.0)
    trainer = lm.Trainer(lm.initial(12, counts), (counts + 1) / (counts.sum() + 12))
    one, two = lm.context(stream, np.zeros(len(stream), bool), 11)
    for at in range(0, 50_000, lm.STEP):
        trainer.step(one[at : at + lm.STEP], two[at : at + lm.STEP], stream[at : at + lm.STEP])
    first, second, norm = lm.score_tables(trainer.p)
    test = slice(50_000, None)
    score = (first[one[test], stream[test]] + second[two[test], stream[test]] - norm[one[test], two[test]]).mean()
    assert score > math.log10(0.1) + 0.3


def test_lm_scores_match_a_plain_computation(spark, make, monkeypatch):
    """Every score anew from the model's parameters, word by word and without tables; probabilities of all words sum to one."""
    held = []
    real = lm.train
    monkeypatch.setattr(lm, "train", lambda docs, ids, counts: held.append((ids, counts, real(docs, ids, counts))) or held[-1][2])
    monkeypatch.setattr(lm, "OWN", 8)
    monkeypatch.setattr(lm, "ENDINGS", 5)
    monkeypatch.setattr(lm, "HEAVY", 12)
    docs = [(i, sentence(i, 40) + f" rare{i} x{i % 9}ridge") for i in range(120)] + [(500, None), (501, "unseen words")]
    found = {r["doc_id"]: r["score"] for r in lm.score_documents(make(docs)).collect()}
    ids, counts, p = held[0]
    learned = [lm.tokens((t or "").encode()) for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for ws in learned for w in ws)
    of = lambda w: ids.words.index(w) if w in ids.words else ids.endings.get(w[-3:], ids.other)
    tokens_of, words_of = Counter(), Counter()
    for w, n in c.items():
        tokens_of[of(w)] += n
        words_of[of(w)] += 1
    assert [tokens_of[k] for k in range(ids.size)] == counts.tolist()

    def chance(a, b):
        s = (p["R"][a] @ p["C1"] + p["R"][b] @ p["C2"]).astype(float) @ p["T"].T.astype(float) + p["bias"]
        e = np.exp(s[:-1])
        return np.append(e / e.sum(), 0)

    def inside(w):
        k = of(w)
        return 1 if k < ids.own else (c[w] + 1) / (tokens_of[k] + words_of[k] + 1)

    for i, t in docs:
        a = b = ids.start
        want = 0.0
        for w in lm.tokens((t or "").encode()):
            want += math.log10(chance(a, b)[of(w)] * inside(w))
            a, b = of(w), a
        assert math.isclose(found[i], want, rel_tol=1e-4), i
    for k in range(ids.own, ids.other + 1):
        assert math.isclose(sum(inside(w) for w in c if of(w) == k) + 1 / (tokens_of[k] + words_of[k] + 1), 1)


def test_lm_beats_the_unigram_on_held_out_text(spark):
    found = lm.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").selectExpr("sum(score) / sum(n_tokens) AS s", "sum(base_score) / sum(n_tokens) AS b").first()
    assert found["s"] > found["b"] + 0.05


# --- decontamination


def plain_hits(text, items, window=10):
    words = decontam.words_of((text or "").encode())
    hit, which = set(), set()
    for item, body in items:
        theirs = decontam.words_of((body or "").encode())
        n = min(window, len(theirs))
        grams = {tuple(theirs[i : i + n]) for i in range(len(theirs) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in grams:
                hit.update(range(i, i + n))
                which.add(item)
    return len(words), len(hit), ",".join(sorted(map(str, which)))


@pytest.mark.parametrize("block", [1_000_000, 30])
def test_decontamination_matches_brute_force(spark, make, odd_rows, block, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
    items = [(k, sentence(200 + k, 8 + 3 * k)) for k in range(9)] + [(20, "Crater"), (21, None), (22, "..."), (23, "mare ridge"), (24, sentence(203, 17))]
    docs = [*odd_rows, *((50 + k, sentence(k, 30) + " -- " + (body or "").upper() + "! " + sentence(90 + k, 9)) for k, body in items)]
    found = rows(decontam.find_hits(make(docs), spark.createDataFrame(items, "item_id bigint, text string")))
    got = sorted((str(r[0]), r[1], r[2], ",".join(r[4])) for r in found)
    assert got == sorted((str(i), *plain_hits(t, items)) for i, t in docs)


def test_decontaminate_cuts_and_drops(spark, make):
    item = sentence(300, 20)
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    docs = make([(1, sentence(1, 100) + " " + item + " " + sentence(2, 100)), (2, item + " end"), (3, sentence(3, 50)), (4, None)])
    left = decontam.decontaminate(docs, bench)
    assert left.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    assert set(texts) == {1, 3, 4} and texts[3] == sentence(3, 50) and texts[4] is None
    assert texts[1].startswith(sentence(1, 90)) and plain_hits(texts[1], [(1, item)])[1] == 0
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.find_hits(docs, empty).filter("n_hit > 0").count() == 0


@pytest.mark.parametrize("block", [1_000_000, 30])
def test_decontaminate_by_blocks(spark, make, block, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
    words = [f"w{k}" for k in range(100)]
    part = lambda a, b: " ".join(words[a:b])
    items = [(1, part(0, 40)), (2, part(60, 90)), (3, part(32, 50))]
    bench = spark.createDataFrame(items, "item_id bigint, text string").coalesce(1)
    # Covered by two thirds through two items; two items that overlap; clean; nothing.
    docs = make([(1, part(0, 40) + " " + sentence(601, 30) + " " + part(60, 90)), (2, sentence(602, 80) + " " + part(0, 50) + " " + sentence(603, 80)), (3, sentence(604, 50)), (4, None), (4, None), (None, sentence(605, 40))])
    left = decontam.decontaminate(docs, bench)
    assert left.columns == docs.columns
    want = [(2, sentence(602, 80) + "  " + sentence(603, 80)), (3, sentence(604, 50)), (4, None), (4, None), (None, sentence(605, 40))]
    assert sorted(map(str, rows(left.select("doc_id", "text")))) == sorted(map(str, want))


# --- top-k


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(700)] + [(1000 + i, [0.1] * 8) for i in range(200)]
    odd = [(2000, None), (2100, [float("nan")] * 8), (2001, [0.5, None] + [0.1] * 6), (None, [0.2] * 8), (2200, []), (2300, [float("inf")] * 8)]
    vectors = spark.createDataFrame(data + odd, "vec_id bigint, embedding array<double>")
    found = rows(topk.top_inner_products(vectors, vectors.filter("vec_id % 100 = 0")))
    ints = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in data}
    want = []
    for q in [i for i in ints if i % 100 == 0]:
        scored = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:10]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(scored, 1)]
    assert sorted(found) == sorted(want)
    none = spark.createDataFrame([], "vec_id bigint, embedding array<double>")
    assert rows(topk.top_inner_products(none, none)) == []
    few = spark.createDataFrame([(0, [1.0]), (1, [1.0])], "vec_id bigint, embedding array<double>")
    assert rows(topk.top_inner_products(few, few.filter("vec_id = 0"))) == [(0, 1, 1, 1024 * 1024)]


def test_topk_of_large_components_is_exact(spark):
    """Sums of products beyond 2**53 and, but for the scores themselves, beyond longs."""
    rng = random.Random(5)
    for size in (3e5, 2e6):
        data = [(i, [float(rng.randrange(int(size / 3), int(size))) + rng.random() for _ in range(64 if size < 1e6 else 2)]) for i in range(120)]
        vectors = spark.createDataFrame([(*v, "x", 1) for v in data], "vec_id bigint, embedding array<double>, score string, rank int")
        ints = {i: [math.floor(1024 * x) for x in v] for i, v in data}
        want = []
        for q in (0, 100):
            scored = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q)[:10]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(scored, 1)]
        assert sorted(rows(topk.top_inner_products(vectors, vectors.filter("vec_id % 100 = 0")))) == want
    huge = spark.createDataFrame([(0, [3e12]), (1, [3e12])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="beyond what a long"):
        rows(topk.top_inner_products(huge, huge.filter("vec_id = 0")))


def test_topk_by_batches_and_repeated_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    data = [(i % 150, [float(x) for x in rng.normal(0, 0.3, 5)]) for i in range(300)]
    vectors = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    queries = vectors.filter("vec_id % 10 = 0")
    once = sorted(rows(topk.top_inner_products(vectors, queries)))
    chosen = {}
    for i, v in sorted((i, v) for i, v in data):
        chosen.setdefault(i, np.floor(1024 * np.array(v)).astype(int))
    want = []
    for q in range(0, 150, 10):
        scored = sorted((-int(chosen[q] @ np.floor(1024 * np.array(v)).astype(int)), i) for i, v in data if i != q)[:10]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(scored, 1)]
    assert once == want
    monkeypatch.setattr(topk, "BATCH", 4)
    assert sorted(rows(topk.top_inner_products(vectors, queries))) == want


# --- BPE


def test_bpe_equals_the_library(make, odd_rows):
    from tokenizers import Tokenizer

    path = tokenizer_path(WORD_BPE)
    library = Tokenizer.from_file(path)
    rng = random.Random(4)
    alphabet = "abcdefghijklmnopqrstuvwxyz'0123456789 \t\n\x85 éßİΣσ😀日!?#&.,\x1c"
    texts = [t or "" for _, t in odd_rows] + ["a" * k for k in range(60)] + ["hi <|endoftext|> a<|startoftext|>b", "it's we'll I'd"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(120))) for _ in range(3000)]
    encoder = bpe.Encoder(bpe.tokenizer_tables(path))
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encoder.encode(text) == want.ids
        assert encoder.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False)
    found = bpe.encode_documents(make(odd_rows), path).collect()
    assert sorted(len(r["ids"]) for r in found) == sorted(len(library.encode(t or "", add_special_tokens=False).ids) for _, t in odd_rows)
    back = {r["doc_id"]: r["decoded"] for r in bpe.decode_documents(bpe.encode_documents(make([(1, "Lunar maps!")]), path), path).collect()}
    assert back == {1: "lunar</w> maps</w> !</w>"}
    slim = bpe.encode_documents(make([(1, None)]), path, slim=True).first()
    assert slim["ids_sha256"] == hashlib.sha256(b"").hexdigest() and slim["n_tokens"] == 0
    assert rows(bpe.encode_documents(make([]), path)) == []


# --- toxicity


def test_ordinal_regression_orders_grades():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4)).astype(np.float32)
    z = x @ np.array([2.0, -1.0, 0, 0]) + rng.logistic(size=3000)
    w, t = toxicity.fit_ordinal(x, (z > 0).astype(int) + (z > 2).astype(int))
    assert t[0] < t[1] and abs(t[1] - t[0] - 2) < 0.5 and w[0] > 1 and w[1] < -0.5 and abs(w[2]) < 0.3


def test_toxicity_finds_bad_words(spark, make, odd_rows):
    bad = ["scummy", "vile", "rotten"]
    docs = [(100 + i, sentence(i, 40) + (" " + " ".join(bad[: 1 + i % 3]) if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(100 + i, int(i % 4 == 0)) for i in range(300)] + [(None, 1), (1, None)], "doc_id bigint, toxic int")
    table = make(docs + odd_rows)
    model = toxicity.fit(table, labels)
    found = {r["doc_id"]: r for r in toxicity.score_toxicity(table, model).collect()}
    wrong = sum(found[100 + i]["rejected"] != (i % 4 == 0) for i in range(300, 400))
    assert wrong == 0
    # Repeated ids are learned from once.
    again = toxicity.fit(make(docs + docs[:50] + odd_rows), labels)
    assert again.words == model.words and again.prefixes == model.prefixes
    left = toxicity.drop_toxic(table, model)
    assert left.columns == table.columns and left.count() == 300 + len(odd_rows)
    assert toxicity.fit(table, labels.filter("toxic = 0")) is None
    assert rows(toxicity.score_toxicity(make([]), model)) == []


def test_toxicity_keeps_labelled_grades_in_order(spark, make):
    """Grades 0 to 3 with a mark of their own each: severity follows them on texts that were not learned from."""
    marks = ["", "rude", "vile", "hateful"]
    docs = [(i, f"{sentence(i, 40)} {marks[i % 4]}") for i in range(800)]
    labels = spark.createDataFrame([(i, i % 4) for i in range(400)], "doc_id bigint, toxic int")
    table = make(docs)
    model = toxicity.fit(table, labels)
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    found = {r["doc_id"]: r for r in toxicity.score_toxicity(table, model).collect()}
    means = [np.mean([found[i]["severity"] for i in range(400, 800) if i % 4 == g]) for g in range(4)]
    assert means == sorted(means) and means[3] > 2.5 and means[0] < 0.5
    assert np.mean([found[i]["grade"] == i % 4 for i in range(400, 800)]) > 0.95
    # The scores are those of the formula, computed anew.
    for i in (1, 402, 403, 500):
        bag = toxicity.features(docs[i][1])
        weights = {**model.words, **{"p:" + k: v for k, v in model.prefixes.items()}}
        z = sum(weights.get(k, 0) * math.log1p(n) for k, n in bag.items())
        assert math.isclose(found[i]["severity"], sum(1 / (1 + math.exp(t - z)) for t in model.thresholds), rel_tol=1e-6)


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    half = "pmod(crc32(cast(doc_id AS string)), 2)"
    model = toxicity.fit(docs, labels.filter(f"{half} = 0"))
    found = toxicity.score_toxicity(docs, model).join(labels, "doc_id").filter(f"{half} = 1").groupBy("toxic", "rejected").count().collect()
    n = {(r["toxic"], r["rejected"]): r["count"] for r in found}
    assert n[1, True] >= 0.85 * (n[1, True] + n[1, False]) and n.get((0, True), 0) <= 0.01 * n[0, False]


# --- PII


def test_pii_base_spans_match_plain_patterns():
    import re

    rng = random.Random(6)
    bits = ["a.b@mail.example.com", "x@y", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+12", "@", "..", "1.2.3.4.5.6.7.8", "é@é.com", "a@b@c.de", "0000001.2.3.4", "12"]
    for _ in range(2000):
        text = "".join(rng.choice([*bits, " ", "", "-", "q"]) for _ in range(rng.randrange(12)))
        want = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        want += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
        want += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and pii.luhn(d)]
        want += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        got = [(s.kind, s.start, s.end) for s in pii.find_spans(text) if s.kind in pii.BASE]
        assert got == sorted(want, key=lambda s: (s[1], pii.BASE.index(s[0]))), text


def test_pii_checksums_context_and_redaction(make, odd_rows):
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB83 WEST 1234 5698 7654 32")
    kinds = lambda t: [s.kind for s in pii.find_spans(t)]
    assert "iban" in kinds("pay to GB82 WEST 1234 5698 7654 32 now")
    assert kinds("number 123-45-6789 here") == [] and kinds("ssn 123-45-6789 here") == ["ssn"]
    text = "mail a@b.com, a@b.com"
    assert pii.redact(text, pii.find_spans(text)) == "mail [EMAIL], [EMAIL]"
    docs = make([*odd_rows, (9, text)])
    clean = pii.redact_documents(docs)
    assert clean.columns == docs.columns and clean.count() == len(odd_rows) + 1
    assert clean.filter("doc_id = 9").first()["text"] == "mail [EMAIL], [EMAIL]"
    digest = {r["doc_id"]: r for r in pii.pii_digest(docs).collect()}
    assert digest[9]["n_email"] == 2 and digest[9]["spans"] == "email:5:12,email:14:21"
    assert digest[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.find_pii(docs).filter("doc_id = 9").first()["spans"][0]["kind"] == "email"
    assert rows(pii.pii_digest(make([]))) == []
    assert pii.find_spans("1" * 200_000) == [] and pii.find_spans("a" * 200_000 + "@") == []


# --- quality


SF = "/root/testdata/sf0.01"


def auc(scores, truth):
    order = np.argsort(np.argsort(scores)) + 1
    yes = truth.sum()
    return (order[truth].sum() - yes * (yes + 1) / 2) / yes / (len(truth) - yes)


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    found = quality.score_quality(docs, labels).join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality").toPandas()
    truth = found["quality"].to_numpy() == 1
    right = (found["predicted"].to_numpy() == truth).mean()
    assert right >= max(truth.mean(), 1 - truth.mean()) + 0.1 and auc(found["score"].to_numpy(), truth) > 0.95


def test_quality_scores_match_a_plain_computation(spark, make):
    """Sizes are those of the zstandard library, the curve's fit is stationary."""
    import zstandard

    texts = {i: (sentence(i, 90) if i % 3 else " ".join(w + "&&&%%" for w in sentence(i, 60).split())) for i in range(300)}
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in texts], "doc_id bigint, quality int")
    model = quality.learn(quality.labelled_rows(make(texts.items()), labels, "doc_id", "text", "quality", 6000))
    good, bad = (zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(c), write_content_size=False, write_checksum=False, write_dict_id=False) for c, _ in model["contents"])
    sizes = quality.Sizes(*model["contents"])
    for text in (*texts.values(), ""):
        raw = text.encode()
        plain = sum(len(bad.compress(p)) - len(good.compress(p)) for p in quality.pieces(raw)) / max(1, len(raw))
        assert abs(plain - sizes.difference(raw)) < 0.02
    x = np.random.default_rng(0).normal(size=(500, 2))
    y = (x[:, 0] > 0.3 * np.random.default_rng(1).normal(size=500)).astype(float)
    w = quality.logistic(x, y)
    columns = np.hstack([np.ones((500, 1)), x])
    assert np.allclose(columns.T @ (y - 1 / (1 + np.exp(-columns @ w))), 1e-2 * w, atol=1e-6)


def test_quality_tells_noise_from_prose(spark, make, odd_rows):
    docs = [(i, sentence(i, 80) if i % 3 else " ".join(w + "&&&%%" for w in sentence(i, 60).split())) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)] + [(None, 0), (3, None)], "doc_id bigint, quality int")
    found = rows(quality.score_quality(make(docs), labels))
    held = [(i, p) for i, out, _, p in found if out]
    assert {i for i, _ in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([p == int(i % 3 > 0) for i, p in held]) > 0.95
    assert all(0 <= s <= 1 for _, _, s, _ in found)
    assert len(rows(quality.score_quality(make(odd_rows), labels))) == len(odd_rows)
    assert len(rows(quality.score_quality(make(odd_rows), labels.filter("quality = 1")))) == len(odd_rows)
    # Repeated ids are learned from once, however the table is dealt out.
    twice = make(docs + docs[:50])
    assert sorted(set(rows(quality.score_quality(twice, labels).select("doc_id", "score")))) == sorted(rows(quality.score_quality(make(docs), labels).select("doc_id", "score")))
    assert rows(quality.score_quality(make([]), labels)) == []


def test_deduplicate_follows_the_similarity(make):
    """Against all pairs of shingle sets: near copies go, texts a little less alike stay."""
    rng = random.Random(31)
    docs = {}
    for k in range(60):
        words = [f"{w}{rng.randrange(3000)}" for w in sentence(500 + k, 300).split()]
        docs[10 * k] = words
        for j, share in enumerate((0.01, 0.02, 0.08, 0.5), 1):
            docs[10 * k + j] = [f"z{rng.randrange(10**6)}" if rng.random() < share else w for w in words]
    grams = {i: {tuple(w[a : a + 5]) for a in range(len(w) - 4)} for i, w in docs.items()}
    alike = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b])
    gone = {i for i in docs if i % 10 and any(alike(i, i - i % 10 + j) >= 0.8 for j in range(i % 10))}
    kept = {r["doc_id"] for r in simhash.deduplicate(make([(i, " ".join(w)) for i, w in docs.items()])).collect()}
    found = set(docs) - kept
    assert found <= gone and len(found) >= 0.95 * len(gone) and len(gone) > 80


def test_deduplicate_with_clashing_names(spark):
    """Columns that are named like those of the operator's own tables, and a dotted one."""
    text = sentence(3, 80)
    rows = [(1, text, 7, 8, 9, 10, "a", "b"), (2, text, 7, 8, 9, 10, "a", "b"), (3, sentence(4, 80), None, 1, 2, 3, None, "c"), (3, sentence(4, 80), None, 1, 2, 3, None, "c"), (None, text, 1, 1, 1, 1, "d", "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _id bigint, _n bigint, id bigint, n bigint, row string, hash string").withColumnRenamed("hash", "a.b")
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, [rows[0], rows[2], rows[4]]))


def test_keys_of_many_are_joined_where_they_are(make, monkeypatch):
    """With every key of over three fingerprints hot and small blocks, the same components as by brute force."""
    from tiegrid.plans import work

    monkeypatch.setattr(work, "HOT_ROWS", 3)
    monkeypatch.setattr(simhash, "BLOCK", 8)
    texts = [(k, sentence(k % 60, 40 + k % 9)) for k in range(400)]
    found = rows(simhash.near_duplicates(make(texts)))
    prints = {i: plain_fingerprint(t) for i, t in texts}
    assert {i: c for i, _, c in found} == components(prints)


def test_rejected_links_hide_no_others(make, monkeypatch):
    """Texts around the similarity asked for: what all open links together connect stays connected, whichever of them the sets reject."""
    rng = random.Random(8)
    docs = {}
    for g in range(8):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        for k in range(12):
            words = list(base)
            # Neighbours change places: the same set of words, so all of a group are candidates of each other.
            for at in rng.sample(range(299), rng.choice((3, 3, 4))):
                words[at], words[at + 1] = words[at + 1], words[at]
            docs[12 * g + k] = words
    texts = {i: " ".join(w) for i, w in docs.items()}
    prints = simhash.set_simhashes([t.encode() for t in texts.values()], 5, simhash.WordHashes()).view(np.uint64)
    grams = [{tuple(w[a : a + 5]) for a in range(len(w) - 4)} for w in docs.values()]
    low, high = simhash.confirm_budget(0.8)
    root = list(range(len(docs)))
    rejected = 0
    for j in range(len(docs)):
        for i in range(j):
            bits = np.bitwise_count(prints[i] ^ prints[j])
            away = bits[simhash.CANDIDATES :].sum()
            if bits[: simhash.CANDIDATES].min() <= 3 and away <= high:
                if away <= low or len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                    a, b = sorted((root[i], root[j]))
                    root = [a if x == b else x for x in root]
                else:
                    rejected += 1
    assert rejected > 200
    found = []
    for most in ((), (1, 2 * simhash.BLOCK)):
        monkeypatch.setattr(simhash, "NEAREST", most)
        found.append({r["doc_id"] for r in simhash.deduplicate(make(list(texts.items()))).collect()})
    # The first round alone leaves more apart, so the later ones are at work.
    assert found[1] == set(root) < found[0]


def test_open_links_of_a_large_group_are_not_written_out(make, monkeypatch):
    """A group of texts that are all open candidates of each other: at most one link for each text of a block pair leaves a task."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = []
    for k in range(200):
        words = list(base)
        for at in rng.sample(range(299), 4):
            words[at], words[at + 1] = words[at + 1], words[at]
        texts.append((k, " ".join(words)))
    made, write = {}, simhash.materialize

    def counted(df, name):
        done = write(df, name)
        made[name] = made.get(name, 0) + done.count()
        return done

    monkeypatch.setattr(simhash, "materialize", counted)
    kept = simhash.deduplicate(make(texts)).count()
    assert 0 < kept <= 200
    assert made["simhash-links"] + made["simhash-open"] < 2500  # of 19,900 pairs
