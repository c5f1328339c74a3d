import gzip
import hashlib
import math
import random
import zlib
from collections import defaultdict
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tiegrid.llm import prefixes, queries, runs, warc

from .conftest import sentence

TURNS = StructType([StructField(n, t) for n, t in (("conv_id", LongType()), ("turn", LongType()), ("role", StringType()), ("text", StringType()), ("key", StringType()), ("place", LongType()))])
PAGES = StructType([StructField(n, t) for n, t in (("page_id", LongType()), ("url", StringType()), ("html", StringType()), ("payload", StringType()), ("same", LongType()))])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- prefix trie


def plain_turns(rows):
    turns = defaultdict(list)
    for c, n, r, t in rows:
        if c is not None:
            turns[c].append((n is not None, n or 0, r or "", t or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in turns.items()}


def plain_rebuilt(turns):
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = turns.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    return made


def plain_trie(sequences):
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    found = set()
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        sums[p] = (sum(sums[k][0] for k in kids[p]) or 1, own + sum(sums[k][1] for k in kids[p]))
    for p, m in members.items():
        parent = min(members[p[:-1]]) if p else None
        found.add((min(m), len(p), parent, len(m), len(kids[p]), *sums[p], sha(",".join(map(str, sorted(ends[p]))))))
    return found


def tables(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "clash", 1) for r in rows], TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    return str(tmp_path)


def conversations(seed):
    pick = random.Random(seed)
    rows = []
    for c in [*range(-6, 60), 101, 103, 999]:
        first = pick.randrange(3)
        for n in range(pick.randrange(1, 13)):
            number = pick.choice([n, n, n, None, 2])
            rows.append((c, number, pick.choice(["user", "bot", None]), pick.choice([f"a{first}", f"b{n}", "ü", "", None])))
    rows += [(5, 1, "user", "again")] * 3 + [(None, 1, "user", "no conversation")]
    # a long one with many like it, and one whose own turns all go and whose base is absent
    rows += [(c, n, "user", f"t{n % 50}") for c in (1000, 1005, 1010, 1015) for n in range(1200)]
    short = next(c for c in range(2001, 3000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    return [*rows, (short, 0, "user", "x"), (short, 1, "bot", "y")]


@pytest.mark.parametrize("piece", [7, prefixes.PIECE])
def test_prefix_trie_matches_brute_force(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(prefixes, "PIECE", piece)
    monkeypatch.setattr(prefixes, "PACKED", 2)
    rows = conversations(piece)
    found = queries.op11_prefix_trie(spark, tables(spark, tmp_path, rows))
    got = [tuple(r) for r in found.collect()]
    want = plain_trie(plain_rebuilt(plain_turns(rows)))
    assert len(got) == len(want) and set(got) == want
    assert any(p[1] == 0 and p[7] != sha("") for p in want)  # a conversation without turns ends at the root


def test_prefix_trie_of_conversations_as_they_are(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (3, None, None, None)]
    numbered = prefixes.number_turns(spark.createDataFrame([(*r, "k", 0) for r in rows], TURNS), texts=True)
    trie = prefixes.prefix_trie(*prefixes.as_sequences(numbered))
    nodes = {(r.conv_id, r.depth): r for r in prefixes.last_turns(trie.nodes, numbered).collect()}
    assert {k: (r.role, r.text, r.n_convs, r.n_leaves, r.saved_tokens) for k, r in nodes.items()} == {
        (1, 0): (None, None, 3, 2, 2),
        (1, 1): ("user", "hi", 2, 1, 2),
        (1, 2): ("bot", "yo", 1, 1, 0),
        (3, 1): ("", "", 1, 1, 0),
    }
    keys = {r.key: r.conv_id for r in trie.nodes.filter("depth > 0").collect()}
    assert sorted((r.conv_id, keys[r.key]) for r in trie.ends.collect()) == [(1, 1), (2, 1), (3, 3)]


def test_prefix_trie_of_nothing(spark, tmp_path):
    assert queries.op11_prefix_trie(spark, tables(spark, tmp_path, [])).collect() == []


# --- periodic runs


def plain_runs(words):
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any(s <= i and s + length >= j + q for s, length, p in found if p < q):
                found.append((i, j + q - i, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def shapes(pick):
    kind, n = pick.randrange(4), pick.randrange(60)
    if kind == 0:
        return [pick.randrange(2) for _ in range(n)]
    if kind == 1:
        root = [pick.randrange(3) for _ in range(pick.randrange(1, 8))]
        return [pick.randrange(3) for _ in range(n % 9)] + (root * 12)[: pick.randrange(len(root), 12 * len(root) + 1)] + [pick.randrange(3) for _ in range(n % 7)]
    if kind == 2:
        root = shapes(pick)[:9]
        return (root * 5)[:-1] + [0] + root * 4
    return [0] * n + [1] + [0] * (n // 2)


def test_runs_match_brute_force():
    pick = random.Random(7)
    for _ in range(3000):
        words = shapes(pick)
        assert runs.runs_of(np.array(words, np.int64)) == plain_runs(words), words


def test_re_pair_derives_the_text():
    pick = random.Random(3)
    for _ in range(200):
        words = shapes(pick)
        rules, rest = runs.re_pair(words)

        def derive(s, rules=rules):
            return [s] if s not in rules else [w for half in rules[s] for w in derive(half)]

        assert [w for s in rest for w in derive(s)] == words
        pairs = list(zip(rest, rest[1:], strict=False))
        assert all(pairs.count(p) < 2 or p[0] == p[1] for p in pairs)


def test_stretches_hold_all_runs():
    pick = random.Random(5)
    texts = [shapes(pick) + [100 + pick.randrange(500) for _ in range(pick.randrange(30))] + shapes(pick) for _ in range(300)] + [[], [1]]
    spans = runs.stretches(np.array([w for t in texts for w in t], np.int64), [len(t) for t in texts])
    for k, t in enumerate(texts):
        mine = [(a, b) for j, a, b in spans if j == k]
        assert all(any(a <= s and s + n <= b for a, b in mine) for s, n, _ in plain_runs(t))
        found = sorted((a + s, n, q) for a, b in mine for s, n, q in runs.runs_of(np.array(t[a:b], np.int64)))
        assert found == sorted(plain_runs(t))


def plain_digest(i, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    found = plain_runs(words)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    return (
        i,
        len(found),
        *best,
        None if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest(),
    )


def test_run_digest_matches_brute_force(make, odd_rows):
    pick = random.Random(11)
    texts = [r for r in odd_rows if not (r[1] and len(r[1]) > 100_000)]
    texts += [(100 + k, pick.choice([" ", "\n", " \t"]).join(f"w{w}" for w in shapes(pick))) for k in range(300)]
    texts += [(1000 + k, sentence(k, 300)) for k in range(60)]
    got = runs.run_digest(runs.repeat_tails(make(texts))).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(plain_digest(*r)) for r in texts)


def test_runs_of_long_texts(make):
    many = ["a", "b", "c"] * 20_000
    found = {r.doc_id: r for r in runs.find_runs(make([(1, " ".join(["x", *many])), (2, sentence(5, 60_000)), (3, " ".join("ab"[k.bit_count() % 2] for k in range(40_000)))])).collect()}
    assert [tuple(r) for r in found[1].runs] == [(1, 60_000, 3)] and found[1].collapsed == "x a b c" and found[1].n_words == 60_001
    assert found[3].runs == []  # the Thue-Morse word has no fourth power


def test_runs_of_nothing(make):
    assert runs.run_digest(make([])).collect() == []


# --- WARC


def pages():
    big, other = "<p>é</p>" * 200, "<b>" + "y" * 5000
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, "small"), (4, "", "small"), (5, "http://a/5\n6", None), (6, "http://a/6", "")]
    rows += [(9, "http://a/9", other), (9, "http://a/9", other), (7, "http://a/7", other), (None, "http://a/n", other), (None, "x", "z" * 1500), (None, "y", "z" * 1500)]
    return rows + [(100 + k, f"http://h/{k}", "<hot>" * 300) for k in range(1200)] + [(2000 + k, f"http://u/{k}", sentence(k, 100 + k)) for k in range(200)]


def plain_records(rows):
    best = defaultdict(list)
    for i, _, html in rows:
        if i is not None:
            best[html or ""].append(i)
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        top = max(best[html or ""], default=None)
        again = len(payload) >= 1000 and top is not None and i != top
        out.append((i, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", top if again else None))
    return out


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('spark-warc')}/archives"
    warc.write_pages(spark.createDataFrame([(*r, "clash", 1) for r in pages()], PAGES), folder)
    return folder


@pytest.mark.parametrize("range_bytes", [97, 4096, 1 << 20])
def test_warc_round_trip_by_ranges(spark, archive, range_bytes):
    records = warc.read_records(spark, archive, range_bytes=range_bytes) if range_bytes > 1000 else warc.read_records(spark, archive, payloads=False, range_bytes=range_bytes * 20)
    got = [tuple(r) for r in warc.page_records(records).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_records(pages())))
    assert records.filter("NOT digest_ok").count() == 0
    assert records.select("path", "offset").distinct().count() == records.count()


def test_warc_payloads_come_back(spark, archive):
    back = warc.read_records(spark, archive).filter("record_type = 'response'").collect()
    want = defaultdict(set)
    for (i, url, html), r in zip(pages(), plain_records(pages()), strict=True):
        if r[3] == "response":
            want[f"<urn:page:{'none' if i is None else i}>"].add((html or "").encode())
    got = defaultdict(set)
    for r in back:
        got[r.record_id].add(bytes(r.payload))
    assert got == want


def test_warc_members_are_plain_gzip(archive):
    for path in Path(archive[7:]).glob("*.warc.gz"):
        data = gzip.decompress(path.read_bytes())
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and data.endswith(b"\r\n\r\n")


def test_warc_false_magic_and_damage(spark, tmp_path):
    digest = hashlib.sha1(b"p").hexdigest()
    record = warc.page_record(1, "u", b"p", digest, "response", None, "1970-01-01T00:00:00Z")
    other = gzip.compress(b"no record at all") + warc.MAGIC * 3
    (tmp_path / "a.warc.gz").write_bytes(other + record + record[:0])
    assert [r.record_id for r in warc.read_records(spark, str(tmp_path)).collect()] == ["<urn:page:1>"]
    (tmp_path / "b.warc.gz").write_bytes(record + record[:-9])
    with pytest.raises(Exception, match="damaged record"):
        warc.read_records(spark, str(tmp_path)).collect()


def test_warc_of_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    warc.write_pages(spark.createDataFrame([], PAGES), folder)
    assert warc.page_records(warc.read_records(spark, folder)).collect() == []


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_periodic_runs", "op13_warc"])
def test_queries_equal_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in Path("/root/testdata/sf0.001").glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert len(want) > 20 and sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
