"""Periodic runs of words, found in a grammar of the text.

Words of a text become ids. Re-Pair replaces the most frequent pair of
neighbours by a new symbol until no pair repeats; the symbols that are left are
joined two by two to a balanced tree. Each symbol stands for one stretch of
words, however often it occurs: the runs that cross the border between its two
halves are looked for once, moved to all places at which the symbol is derived,
and stretches of one period that overlap by a period are merged. A run of the
text lies whole inside the lowest symbol of the tree that has both its ends, and
crosses that symbol's border, so all runs are found.

In a run of four periods each pair of neighbours occurs three times, so a text
is first cut at pairs that occur less often, then its parts are, until nothing
changes. What is left of most texts is nothing.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiegrid.llm.common import map_texts

#: A run has at least so many periods and so many words.
PERIODS, WORDS = 4, 6

Run = tuple[int, int, int]


def re_pair(words: list[int]) -> tuple[dict[int, tuple[int, int]], list[int]]:
    """Rules {symbol: (left, right)} and the symbols that are left; symbols from max(words) + 1 on are new."""
    n = len(words)
    symbol, after, before = list(words), list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], set[int]] = {}
    for i in range(n - 1):
        places.setdefault((words[i], words[i + 1]), set()).add(i)
    heap = [(-len(at), pair) for pair, at in places.items() if len(at) > 1]
    heapify(heap)
    rules: dict[int, tuple[int, int]] = {}
    fresh = max(words, default=0) + 1
    while heap:
        count, pair = heappop(heap)
        at = places.get(pair)
        if at is None or len(at) < 2:
            continue
        if len(at) != -count:
            heappush(heap, (-len(at), pair))
            continue
        del places[pair]
        a, b = pair
        made, used, touched = fresh, 0, set()
        for i in sorted(at):
            j = after[i] if symbol[i] == a else n
            if j >= n or symbol[j] != b:
                continue  # overlapped by the one before
            left, right = before[i], after[j]
            if left >= 0:
                places.get((symbol[left], a), at).discard(left)
                new = (symbol[left], made)
                places.setdefault(new, set()).add(left)
                touched.add(new)
            if right < n:
                places.get((b, symbol[right]), at).discard(j)
                new = (made, symbol[right])
                places.setdefault(new, set()).add(i)
                touched.add(new)
                before[right] = i
            symbol[i], symbol[j], after[i] = made, -1, right
            used += 1
        if used:
            rules[made] = pair
            fresh += 1
        for new in touched:
            if len(places.get(new, ())) > 1:
                heappush(heap, (-len(places[new]), new))
    rest, i = [], 0
    while i < n:
        rest.append(symbol[i])
        i = after[i]
    return rules, rest


def _tree(rules: dict[int, tuple[int, int]], rest: list[int], fresh: int) -> int:
    """Joins the symbols of ``rest`` two by two until one is left; adds its rules."""
    while len(rest) > 1:
        joined = []
        for i in range(0, len(rest) - 1, 2):
            rules[fresh] = (rest[i], rest[i + 1])
            joined.append(fresh)
            fresh += 1
        rest = joined + rest[len(rest) & ~1 :]
    return rest[0]


def _same_up(t: np.ndarray, i: int, q: int, end: int) -> int:
    """The first place from i on, up to end, whose word isn't the one q before."""
    step = 32
    while i < end:
        k = min(end, i + step)
        odd = t[i:k] != t[i - q : k - q]
        if odd.any():
            return i + int(odd.argmax())
        i, step = k, 2 * step
    return end


def _same_down(t: np.ndarray, i: int, q: int, start: int) -> int:
    """The least place from start on so that all words from it to i are those q after."""
    step = 32
    while i > start:
        k = max(start, i - step)
        odd = (t[k:i] != t[k + q : i + q])[::-1]
        if odd.any():
            return i - int(odd.argmax())
        i, step = k, 2 * step
    return start


def _primitive(root: np.ndarray) -> bool:
    """Whether the words aren't a repetition of fewer."""
    q, d, rest, primes = len(root), 2, len(root), []
    while d * d <= rest:
        if rest % d == 0:
            primes.append(d)
            while rest % d == 0:
                rest //= d
        d += 1
    if rest > 1:
        primes.append(rest)
    return not any(np.array_equal(root[q // p :], root[: q - q // p]) for p in primes)


class _Stretch:
    """The words of one stretch with sums that tell at once which neighbouring blocks of q words may be equal."""

    def __init__(self, words: np.ndarray):
        self.t = words
        mixed = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        self.power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(words), 0x2545F4914F6CDD1D, np.uint64)])
        self.sums = np.r_[np.uint64(0), np.cumsum(mixed * self.power[:-1], dtype=np.uint64)]

    def crossing(self, x: int, m: int, e: int) -> list[Run]:
        """The runs (start, length, period) of the words from x to e that have words on either side of m, maximal among these words.

        Half of a run's four periods lie on one side of m: a square of two
        periods begins or ends there.
        """
        t, s, most, found = self.t, self.sums, (e - x) // PERIODS, set()
        for forward in (True, False):
            n = min((e - m if forward else m - x) // 2, most)
            if n < 1:
                continue
            if forward:
                near, far = s[m + 1 : m + n + 1] - s[m], s[m + 2 : m + 2 * n + 1 : 2] - s[m + 1 : m + n + 1]
            else:
                mids = s[m - n : m][::-1]
                near, far = mids - s[m - 2 * n : m : 2][::-1], s[m] - mids
            covered = 0
            for q in (np.flatnonzero(near * self.power[1 : n + 1] == far) + 1).tolist():
                lo = m if forward else m - 2 * q
                if 2 * q <= covered or not np.array_equal(t[lo : lo + q], t[lo + q : lo + 2 * q]):
                    continue  # within a run of a shorter period it has no period of its own
                start, end = _same_down(t, lo, q, x), _same_up(t, lo + 2 * q, q, e)
                covered = max(covered, end - m if forward else m - start)
                if start < m < end and end - start >= max(WORDS, PERIODS * q) and _primitive(t[start : start + q]):
                    found.add((start, end - start, q))
        return list(found)


def runs_of(words: np.ndarray) -> list[Run]:
    """All runs (start, length, period) of a stretch of word ids, by start, then period."""
    if len(words) < WORDS:
        return []
    _, ids = np.unique(words, return_inverse=True)
    rules, rest = re_pair(ids.tolist())
    root = _tree(rules, rest, max([len(ids), *rules]) + 1)
    sizes: dict[int, int] = {}
    for made in sorted(rules):  # a rule's halves are older
        sizes[made] = sum(sizes.get(half, 1) for half in rules[made])
    stretch, crossing, moved = _Stretch(ids), {}, {}
    stack = [(root, 0)]
    while stack:
        made, at = stack.pop()
        if sizes.get(made, 1) < WORDS:
            continue
        left, right = rules[made]
        m = at + sizes.get(left, 1)
        if made not in crossing:
            crossing[made] = [(start - at, length, q) for start, length, q in stretch.crossing(at, m, at + sizes[made])]
        for start, length, q in crossing[made]:
            moved.setdefault(q, []).append((at + start, at + start + length))
        stack += [(left, at), (right, m)]
    found = []
    for q, spans in moved.items():
        spans.sort()
        start, end = spans[0]
        for a, b in spans[1:]:
            if a > end - q:
                found.append((start, end - start, q))
                start, end = a, b
            else:
                end = max(end, b)
        found.append((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(ids: np.ndarray, lengths: list[int]) -> list[tuple[int, int, int]]:
    """(text, first word, end) of the parts of texts, given one after the other, in which each pair of neighbours occurs three times or more.

    Counts are taken by a hash of part and pair; two that fall together can only
    keep more.
    """
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(lengths)), lengths)
    at, part = np.arange(len(ids)), text.copy()
    wide = np.uint64(ids.max(initial=0) + 1)
    while len(at) > 1:
        joined = (part[1:] == part[:-1]) & (at[1:] == at[:-1] + 1)
        pairs = ids[at[:-1]].astype(np.uint64) * wide + ids[at[1:]].astype(np.uint64)
        keys = (pairs * np.uint64(0x9E3779B97F4A7C15)) ^ (part[:-1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        order = np.flatnonzero(joined)
        _, back, counts = np.unique(keys[order], return_inverse=True, return_counts=True)
        held = np.zeros(len(joined), bool)
        held[order] = counts[back] >= PERIODS - 1
        cut = np.flatnonzero(~held) + 1
        bounds = np.r_[0, cut, len(at)]
        long = np.diff(bounds) >= WORDS
        keep = np.repeat(long, np.diff(bounds))
        if keep.all() and (held == joined).all():
            break
        part = np.repeat(np.arange(len(long)), np.diff(bounds))[keep]
        at = at[keep]
    if len(at) < WORDS:
        return []
    edges = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(at)]
    starts = ends - lengths
    return [(int(text[at[a]]), int(at[a] - starts[text[at[a]]]), int(at[b - 1] + 1 - starts[text[at[a]]])) for a, b in zip(edges, edges[1:], strict=False)]


def _rows(texts: list[bytes]) -> list[pa.Array]:
    words = [text.split() for text in texts]
    lengths = [len(w) for w in words]
    flat = [w for each in words for w in each]
    ids = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if flat else np.zeros(0, np.int64)
    starts = np.cumsum(lengths) - lengths
    runs: list[list[Run]] = [[] for _ in texts]
    for k, a, b in stretches(ids, lengths):
        runs[k] += [(a + start, length, q) for start, length, q in runs_of(ids[starts[k] + a : starts[k] + b])]
    kept = []
    for k, each in enumerate(words):
        if runs[k]:
            gone = np.zeros(lengths[k], bool)
            for start, length, q in runs[k]:
                gone[start + q : start + length] = True
            each = [each[i] for i in np.flatnonzero(~gone).tolist()]
        kept.append(b" ".join(each))
    kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
    found = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in sorted(each, key=lambda r: (r[0], r[2]))] for each in runs]
    return [pa.array(lengths, pa.int64()), pa.array(found, kind), pa.array(kept, pa.binary()).cast(pa.string())]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed) of every text: its periodic runs and its words without their repetitions.

    A run is a stretch of words with smallest period q, of 6 words and 4 periods
    or more, that no neighbouring word extends; its start is a word number from
    0. ``collapsed`` joins the words that no run repeats by one space. A null or
    empty text has no words. Repeated rows and null ids each give a row, further
    columns are not read, an empty table gives an empty one. Equal parts of a
    text need no rule of precedence: all runs are reported.
    """
    return map_texts(docs, _rows, "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string", id_col, text_col)


def repeat_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text), a tenth of the texts with a periodic tail in place of their own.

    h is the CRC-32 of the decimal id. Where h % 10 is 0 and the text has words,
    with g = h / 10, a = g % n, p = 1 + (n - a) / (3 + g % 8), all whole numbers,
    each word i from a on becomes word a + (i - a) % p. Others stay as they are,
    those of null id included.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    marked = docs.select(F.col(id_col), F.col(text_col).alias("_text"), h.alias("_h"), F.when(h % 10 == 0, words).alias("_words"))
    n, g = F.size("_words").cast("bigint"), F.floor(F.col("_h") / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    whole = F.transform("_words", lambda w, i: F.when(i < a, w).otherwise(F.element_at("_words", (1 + a + (i - a) % p).cast("int"))))
    changed = F.when(F.col("_words").isNotNull() & (n > 0), F.array_join(whole, " ")).otherwise(F.col("_text"))
    return marked.select(F.col(id_col), changed.alias(text_col))


def run_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text the number of runs, the run of most periods, and SHA-256 of all runs and of the collapsed text.

    The best run has the greatest exact length / period, then the smallest start,
    then the smallest period; a text without runs has nulls there.
    """
    found = find_runs(docs, id_col, text_col)
    first = F.col("runs")[0]
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.when(F.size("runs") > 0, F.aggregate("runs", first, lambda b, x: F.when(more(x, b), x).otherwise(b)))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    marked = found.select(F.col(id_col), F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return marked.select(
        id_col,
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
