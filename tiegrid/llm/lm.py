"""A log-bilinear language model, trained with noise-contrastive estimation.

Words are counted over all training texts in one Spark aggregation. Words with
OWN_COUNT occurrences, the OWN most frequent ones at most, and the end token
are classes of their own. All other words belong to the class of their ending,
or to one last class if the ending isn't among the ENDINGS most frequent ones;
within such a class a smoothed unigram distribution over the exact counts
applies, so that probabilities sum to one over every word. A rare word thus
lends its context an ending, which tells language and word kind, and is itself
predicted by it.

The class of a token is predicted from the two classes before it:
s(w | a, b) = (R[a] C1 + R[b] C2) . T[w] + bias[w]. Training runs over every
training token in ROUNDS rounds, each over its share of the texts: every task
takes stochastic noise-contrastive steps from the round's start, and the tasks'
parameters are averaged with their numbers of tokens as weights. As s splits into
a part for each context word, one product of two exponentiated matrices gives the
normalisers of all contexts, and a token's log-probability is three table look-ups.

Words beyond the HEAVY most frequent ones never go to the driver or into a
broadcast: their counts are joined to the documents that hold them.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiegrid.llm.common import by_bytes, id_type, materialize, text_bytes, worker_object

END = b""
#: Words with a class of their own: the count that they need, and how many there can be; classes of endings, and their bytes.
OWN_COUNT, OWN, ENDINGS, ENDING_BYTES = 20, 1500, 1000, 3
#: The most words whose counts are sent to every executor.
HEAVY = 150_000
SIZE, NOISE, STEP, RATE, SEED, ROUNDS = 16, 24, 1024, 0.3, 5, 3
#: Distinct words that a task counts before it hands them on.
FLUSH = 1_000_000


def tokens(text: bytes) -> list[bytes]:
    """The lower-cased (A-Z) words between ASCII white space, then one end token."""
    return [*text.lower().split(), END]


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c): how often each token occurs in all texts."""

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in text_bytes(batch.column(0)):
                counts.update(text.lower().split())
                counts[END] += 1
                if len(counts) > FLUSH:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    return docs.select(text_col).mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> tuple[int, list]:
    """A count and all words with that count or more, of which there are ``most`` at most, the most frequent first."""
    level = F.floor(F.log2("c") * 16).cast("int")
    rows = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).collect()
    total, least = 0, None
    for row in sorted(rows, key=lambda r: -r["level"]):
        total += row["n"]
        if total > most:
            break
        least = row["least"]
    if least is None:
        return 1 << 62, []
    found = [(bytes(r["word"]), r["c"]) for r in counts.filter(F.col("c") >= least).collect()]
    return least, sorted(found, key=lambda x: (-x[1], x[0]))


class ClassIds(dict):
    """Class of a word: its own, that of its ending, or the last one; kept for the words in use."""

    def __init__(self, words: list[bytes], endings: list[bytes]) -> None:
        super().__init__((w, k) for k, w in enumerate(words))
        self.words, self.own = words, len(words)
        self.endings = {e: self.own + k for k, e in enumerate(endings)}
        self.other = self.own + len(endings)
        self.start, self.size = self.other + 1, self.other + 2

    def __missing__(self, word: bytes) -> int:
        made = self.endings.get(word[-ENDING_BYTES:], self.other)
        if len(self) > 300_000:
            self.clear()
            self.update((w, k) for k, w in enumerate(self.words))
        self[word] = made
        return made

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def initial(size: int, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters before training: small random vectors, log frequencies as biases."""
    rng = np.random.default_rng(SEED)
    share = (counts + 1) / (counts.sum() + len(counts))
    return {
        "R": rng.normal(0, 0.1, (size, SIZE)).astype(np.float32),
        "T": rng.normal(0, 0.1, (size, SIZE)).astype(np.float32),
        "C1": (0.5 * np.eye(SIZE)).astype(np.float32),
        "C2": (0.5 * np.eye(SIZE)).astype(np.float32),
        "bias": np.log(share).astype(np.float32),
    }


def scatter(size: int, index: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of rows by index."""
    out = np.empty((size, rows.shape[1]), np.float32)
    for k in range(rows.shape[1]):
        out[:, k] = np.bincount(index, rows[:, k], size)
    return out


class Trainer:
    """Noise-contrastive AdaGrad steps over a stream of classes."""

    def __init__(self, params: dict[str, np.ndarray], noise: np.ndarray, squares: dict[str, np.ndarray] | None = None) -> None:
        self.p = {k: v.copy() for k, v in params.items()}
        self.squares = {k: np.full_like(v, 1e-2) if squares is None else squares[k].copy() for k, v in params.items()}
        self.log_noise = np.log(NOISE * noise).astype(np.float32)
        self.rng = np.random.default_rng(SEED)
        self.edges = np.cumsum(noise)
        self.seen = 0

    def step(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> None:
        p, n = self.p, len(w)
        size = len(p["bias"])
        drawn = np.minimum(np.searchsorted(self.edges, self.rng.random(NOISE)), size - 1)
        ra, rb, tw, tn = p["R"][a], p["R"][b], p["T"][w], p["T"][drawn]
        query = ra @ p["C1"] + rb @ p["C2"]
        good = (query * tw).sum(1) + p["bias"][w] - self.log_noise[w]
        bad = query @ tn.T + p["bias"][drawn] - self.log_noise[drawn]
        up = 1 / (1 + np.exp(np.clip(good, -30, 30)))
        down = -1 / (1 + np.exp(-np.clip(bad, -30, 30)))
        d_query = up[:, None] * tw + down @ tn
        grads = {
            "T": scatter(size, w, up[:, None] * query),
            "bias": np.bincount(w, up, size).astype(np.float32),
            "C1": ra.T @ d_query,
            "C2": rb.T @ d_query,
            "R": scatter(size, a, d_query @ p["C1"].T) + scatter(size, b, d_query @ p["C2"].T),
        }
        np.add.at(grads["T"], drawn, down.T @ query)
        np.add.at(grads["bias"], drawn, down.sum(0))
        for k, g in grads.items():
            g /= n
            self.squares[k] += g * g
            p[k] += RATE * g / np.sqrt(self.squares[k])
        self.seen += n


def context(classes: np.ndarray, ends: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two places before each token; ``ends`` marks the end tokens of texts."""
    one = np.concatenate(([start], classes[:-1]))
    first = np.concatenate(([True], ends[:-1]))
    one[first] = start
    two = np.concatenate(([start], one[:-1]))
    two[first] = start
    return one, two


def packed(parts: list[dict[str, np.ndarray]]) -> np.ndarray:
    return np.concatenate([v.ravel() for part in parts for v in part.values()]).astype(np.float32)


def unpacked(flat: np.ndarray, like: dict[str, np.ndarray], parts: int) -> list[dict[str, np.ndarray]]:
    out, at = [], 0
    for _ in range(parts):
        out.append({})
        for k, v in like.items():
            out[-1][k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
    return out


#: Parameters in a row that a task hands on to be averaged.
PART = 4096


def average(table: pa.Table) -> pa.Table:
    """The mean of one part of the parameters over all tasks, weighted by their tokens."""
    seen = table.column("seen").to_numpy()
    total = np.zeros(len(table.column("v")[0].as_py()) // 4)
    for v, n in zip(table.column("v"), seen, strict=True):
        total += n * np.frombuffer(v.as_py(), np.float32)
    mean = (total / seen.sum()).astype(np.float32).tobytes()
    return pa.table({"k": table.column("k")[:1], "seen": pa.array([float(seen.sum())]), "v": pa.array([mean], pa.binary())})


def train(docs: DataFrame, ids: ClassIds, counts: np.ndarray, text_col: str = "text", turn_col: str = "turn") -> dict[str, np.ndarray]:
    """Parameters fitted on every text of ``docs``, a share of them by ``turn_col`` in each round.

    The driver gets the averaged parameters of each round, not those of the tasks.
    """
    params = initial(ids.size, counts)
    squares = {k: np.full_like(v, 1e-2) for k, v in params.items()}
    noise = (counts + 1) / (counts.sum() + len(counts))
    schema = "k int, seen double, v binary"
    for turn in range(ROUNDS):
        shared = docs.sparkSession.sparkContext.broadcast((ids.words, list(ids.endings), params, squares))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, endings, params, squares = shared.value
            ids = ClassIds(words, endings)
            trainer = Trainer(params, noise, squares)
            for batch in batches:
                rows: list[bytes] = []
                for text in [*text_bytes(batch.column(0)), None]:
                    if text is not None:
                        rows += tokens(text)
                    if len(rows) >= 128 * STEP or text is None and rows:
                        classes = ids.of(rows)
                        one, two = context(classes, np.fromiter([not w for w in rows], bool, len(rows)), ids.start)
                        for at in range(0, len(rows), STEP):
                            trainer.step(one[at : at + STEP], two[at : at + STEP], classes[at : at + STEP])
                        rows = []
            if trainer.seen:
                flat = packed([trainer.p, trainer.squares])
                cut = [flat[at : at + PART].tobytes() for at in range(0, len(flat), PART)]
                seen = np.full(len(cut), float(trainer.seen))
                yield pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array(seen), pa.array(cut, pa.binary())], names=["k", "seen", "v"])

        parts = docs.filter(F.col(turn_col) == turn).select(text_col).mapInArrow(run, schema).groupBy("k").applyInArrow(average, schema).collect()
        if parts:
            flat = np.concatenate([np.frombuffer(bytes(r["v"]), np.float32) for r in sorted(parts, key=lambda r: r["k"])])
            params, squares = unpacked(flat, params, 2)
        shared.destroy()
    return params


def score_tables(params: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, norm): log10 P(w | a, b) = first[a, w] + second[b, w] - norm[a, b].

    The start class is context only; it gets no probability.
    """
    p = {k: v.astype(np.float32) for k, v in params.items()}
    first = p["R"] @ p["C1"] @ p["T"].T
    second = p["R"] @ p["C2"] @ p["T"].T + p["bias"]
    second[:, -1] = -np.inf
    tops = first.max(1), second.max(1)
    norm = np.exp(first - tops[0][:, None]) @ np.exp(second - tops[1][:, None]).T
    np.log(norm, out=norm)
    norm += tops[0][:, None]
    norm += tops[1][None, :]
    for x in (first, second, norm):
        x /= np.float32(np.log(10))
    return first, second, norm


class Scorer:
    """Scores texts but for the words whose counts aren't at hand; those are returned."""

    def __init__(self, heavy: list[tuple[bytes, int]], words: list[bytes], endings: list[bytes], units: np.ndarray, params: dict[str, np.ndarray]) -> None:
        self.ids = ClassIds(words, endings)
        counted = dict(heavy)
        # Words with a class of their own come first, so that a word's place in the list is its class.
        own = set(words)
        listed = [*words, *(w for w, _ in heavy if w not in own)]
        self.place = {w: k for k, w in enumerate(listed)}
        counts = np.array([counted.get(w, 0) for w in listed], np.float64)
        self.log_count = np.append(np.log10(counts + 1), 0.0)
        self.known = np.append(counts > 0, False)
        self.class_of = np.append(self.ids.of(listed), 0)
        self.unknown, self.units = len(listed), units
        self.tables = score_tables(params)

    def score(self, texts: list[bytes]) -> list[list]:
        """For each text: tokens, known ones, the sum of log10(c + 1), the log10 probability of its classes, the sum of
        log10((c + 1) / size of the class) of its words without a class of their own, and the words that aren't listed."""
        rows: list[bytes] = []
        sizes = []
        for text in texts:
            found = tokens(text)
            sizes.append(len(found))
            rows += found
        get, unknown = self.place.get, self.unknown
        place = np.fromiter([get(w, unknown) for w in rows], np.int64, len(rows))
        classes = self.class_of[place]
        gaps = np.nonzero(place == unknown)[0]
        classes[gaps] = self.ids.of([rows[k] for k in gaps.tolist()])
        last = np.cumsum(sizes) - 1
        ends = np.zeros(len(rows), bool)
        ends[last] = True
        one, two = context(classes, ends, self.ids.start)
        first, second, norm = self.tables
        chance = first[one, classes].astype(np.float64) + second[two, classes] - norm[one, two]
        logs = self.log_count[place]
        shared = np.where(classes >= self.ids.own, logs - self.units[classes], 0.0)
        starts = last - np.array(sizes) + 1
        add = np.add.reduceat
        missing: list[list] = [[] for _ in texts]
        owner = np.searchsorted(last, gaps)
        for k, text in zip(gaps.tolist(), owner.tolist(), strict=True):
            missing[text].append(rows[k])
        return [sizes, add(self.known[place].astype(np.int64), starts), add(logs, starts), add(chance, starts), add(shared, starts), missing]


def worker_scorer(shared) -> Scorer:
    """The scorer of a broadcast model, built once in each Python worker."""
    token, *parts = shared.value
    return worker_object("lm", token, lambda: Scorer(*parts))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Rows whose crc32 of the id as text is ``held`` modulo ``folds`` are held
    out; the model and all counts come from the others. base_score is the
    add-one unigram log10 probability, score the model's log10 probability of
    the whole text. A null id counts as the text "" for the fold; a null text
    as empty, which is one end token. Repeated rows are learned from and
    scored as often as they occur. Without training rows both scores take
    every token as unseen. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    named = F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")
    turn = F.pmod(F.xxhash64(named), F.lit(ROUNDS)).cast("int")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.pmod(F.crc32(named), F.lit(folds)) == held).alias("held_out"), turn.alias("turn"))
    training = base.filter(~F.col("held_out"))

    counts = materialize(count_words(training), "lm-counts")
    total, vocabulary = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    least, heavy = frequent(counts, HEAVY)
    if END not in dict(heavy):
        heavy += [(END, r["c"]) for r in counts.filter(F.col("word") == F.lit(END)).select("c").collect()]
    words = [w for w, c in heavy if w != END and c >= OWN_COUNT][:OWN] + [END]
    # Tokens and distinct words of each ending, the words with a class of their own taken off.
    last = counts.groupBy(F.substring("word", -ENDING_BYTES, ENDING_BYTES).alias("e")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"))
    by_word = dict(heavy)
    kept: dict[bytes, list[int]] = {}
    for w in words:
        if w in by_word:
            one = kept.setdefault(w[-ENDING_BYTES:], [0, 0])
            one[0] += by_word[w]
            one[1] += 1
    found = last.orderBy(F.desc("n"), "e").limit(ENDINGS + len(words)).collect()
    rest = {bytes(r["e"]): (r["n"] - kept.get(bytes(r["e"]), (0, 0))[0], r["v"] - kept.get(bytes(r["e"]), (0, 0))[1]) for r in found}
    endings = sorted((e for e, (n, _) in rest.items() if n > 0), key=lambda e: (-rest[e][0], e))[:ENDINGS]
    own_counts = [by_word.get(w, 0) for w in words]
    end_sizes = [rest[e] for e in endings]
    other = total - sum(own_counts) - sum(n for n, _ in end_sizes), vocabulary - sum(c > 0 for c in own_counts) - sum(v for _, v in end_sizes)
    class_counts = np.array([*own_counts, *(n for n, _ in end_sizes), other[0], 0], np.float64)
    units = np.array([0.0] * len(words) + [np.log10(n + v + 1) for n, v in (*end_sizes, other)])
    params = train(training, ClassIds(words, endings), class_counts)
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, heavy, words, endings, units, params))

    names = ["row", "id", "held_out", "n_tokens", "n_known", "logs", "chance", "shared", "missing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or worker_scorer(shared)
            for part, texts in by_bytes(batch):
                *numbers, missing = scorer.score(texts)
                counted = [Counter(m) for m in missing]
                ends = np.cumsum([0, *map(len, counted)])
                words = pa.array([w for c in counted for w in c], pa.binary())
                times = pa.array([n for c in counted for n in c.values()], pa.int64())
                lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([words, times], ["word", "n"]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(3), part.column(0), part.column(2), *(pa.array(n) for n in numbers), lists], names=names
                )

    schema = (
        f"row bigint, id {id_type(docs, id_col)}, held_out boolean, n_tokens bigint, n_known bigint, logs double, "
        "chance double, shared double, missing array<struct<word:binary,n:bigint>>"
    )
    # Numbers of rows hold only within one run of the tasks, so they are written before they are used.
    scored = materialize(base.select("id", "text", "held_out", F.monotonically_increasing_id().alias("row")).mapInArrow(run, schema), "lm-scores")
    gaps = scored.select("row", F.explode("missing").alias("m")).select("row", "m.word", "m.n")
    rare = counts.filter(F.col("c") < least)
    found = gaps.join(rare, "word").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("rare_logs"), F.sum("n").alias("rare_known")
    )
    rare_logs = F.coalesce("rare_logs", F.lit(0.0))
    unit = float(np.log10(total + vocabulary + 1))
    return scored.drop("missing").join(found, "row", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("logs") + rare_logs - F.col("n_tokens") * unit).alias("base_score"),
        (F.col("chance") + F.col("shared") + rare_logs).alias("score"),
    )
