"""Log-likelihood of documents under a recurrent language model trained here, beside a count model's.

Counts of all words of all training documents are a table. The frequent ones, of a bounded number, are known to every
task; what a document holds of others is looked up by a join. The recurrent model's softmax has classes of frequent words
and classes of other words by their first bytes; inside the latter a word's probability comes from the counts, so that
every word has one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, repeat
from math import ceil
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import cut, sliced
from casemill.llm.gru import MOST_LANES, STEPS, TRAIN_LANES, Gru

#: Words of the model's softmax; frequent words that tasks know the counts of; bytes of the longest such word.
VOCABULARY, FREQUENT, LONGEST = 4096, 65536, 64
#: Classes of words outside the softmax.
CLASSES = 32
#: The count model's share of every word, seen or not.
EXTRA = 0.1
#: Rounds after which the tasks' weights are averaged; words of a task in a round, about; models averaged by one task.
ROUNDS, TASK_WORDS, FAN = 4, 1_000_000, 32
#: Steps of learning that a task's words are dealt over in a round, as far as lanes allow.
UPDATES = 100
#: Distinct words that a counting task holds.
HELD = 300_000

END = b""


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case, and the end."""
    return [*(text or "").encode("utf-8", "replace").lower().split(), END]


def held_out() -> Column:
    """A tenth of the documents, by a hash of doc_id; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))


def _class(word: bytes) -> int:
    return crc32(word[:2]) % CLASSES


def counted(docs: DataFrame) -> DataFrame:
    """word (binary, empty for the end), c: how often each stands in docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
            if len(counts) > HELD:
                yield _batch(counts)
                counts.clear()
        yield _batch(counts)

    def _batch(counts: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "c"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """What tasks know of the counts; class_n and class_v are those of the words outside the softmax."""

    words: list[bytes]
    counts: np.ndarray
    n: int
    v: int
    class_n: np.ndarray
    class_v: np.ndarray

    def __post_init__(self) -> None:
        self.numbers = {w: i for i, w in enumerate(self.words)}
        self.size = min(VOCABULARY, len(self.words))
        self.classes = np.array([_class(w) for w in self.words], np.int64)
        self.base = np.log10((self.counts + EXTRA) / (self.n + EXTRA * (self.v + 1)))
        self.inside = np.log10((self.counts + EXTRA) / self.class_total()[self.classes])
        self.ids = np.concatenate([np.arange(self.size), self.size + self.classes[self.size :]])

    def parts(self) -> tuple:
        """What a lexicon is made from, without its class: tasks needn't have this package."""
        return self.words, self.counts, self.n, self.v, self.class_n, self.class_v

    def class_total(self) -> np.ndarray:
        return self.class_n + EXTRA * (self.class_v + 1)

    def model(self) -> Gru:
        return Gru(self.counts[: self.size] + EXTRA, self.class_total(), 0)

    def read(self, text: str | None) -> tuple[np.ndarray, int, int, float, float, Counter[bytes]]:
        """A text's ids; its words, those known, their base and inside-class scores; and the words to be looked up."""
        words = words_of(text)
        numbers = np.array(list(map(self.numbers.get, words, repeat(-1))))
        found = numbers[numbers >= 0]
        missing = [words[i] for i in np.flatnonzero(numbers < 0).tolist()]
        ids = self.ids[numbers]
        ids[numbers < 0] = [self.size + _class(w) for w in missing]
        return ids, len(words), int((self.counts[found] > 0).sum()), float(self.base[found].sum()), float(self.inside[found[found >= self.size]].sum()), Counter(missing)


def lexicon(counts: DataFrame) -> tuple[Lexicon, int]:
    """The lexicon of a table of counts, and the count from which on it holds all words of up to LONGEST bytes.

    That count is found from a histogram by eighths of a doubling; no words are sorted but those of the lexicon.
    """
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    short = counts.where((F.octet_length("word") <= LONGEST) & (F.col("word") != END))
    levels = short.groupBy(F.floor(F.log2("c") * 8).alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect()
    least, held = 1 << 62, 0
    for x in sorted(levels, key=lambda x: -x["level"]):
        held += x["n"]
        if held >= FREQUENT:
            break
        least = x["c"]
    top = sorted(((x["c"], bytes(x["word"])) for x in short.where(F.col("c") >= least).collect()), key=lambda x: (-x[0], x[1]))
    end = counts.where(F.col("word") == END).first()
    words, seen = [END, *(w for _, w in top)], np.array([end["c"] if end else 0, *(c for c, _ in top)], float)
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for x in counts.groupBy((F.crc32(F.substring("word", 1, 2)) % CLASSES).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        class_n[x["k"]], class_v[x["k"]] = x["n"], x["v"]
    for w, c in zip(words[:VOCABULARY], seen, strict=False):
        class_n[_class(w)] -= c
        class_v[_class(w)] -= c > 0
    return Lexicon(words, seen, total["n"], total["v"], class_n, class_v), least


@dataclass
class LanguageModel:
    lexicon: Lexicon
    #: Counts of the words that the lexicon lacks.
    rest: DataFrame
    weights: np.ndarray


def _mean(models: list[tuple[int, bytes]]) -> tuple[int, np.ndarray]:
    """Words and weighted mean of models (words, weights)."""
    total, out = sum(n for n, _ in models), 0
    for n, weights in models:
        out = out + np.frombuffer(weights, np.float32) * np.float32(n / total)
    return total, out


def _averaged(models: DataFrame) -> np.ndarray | None:
    """The mean of models (task, n, weights), FAN at a time, until FAN are left."""

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        n, weights = _mean(list(zip(pdf["n"].tolist(), pdf["weights"], strict=True)))
        return pd.DataFrame({"task": [int(pdf["task"].iloc[0]) // FAN], "n": [n], "weights": [weights.astype(np.float32).tobytes()]})

    models = cut(models, "lm-models")
    while models.count() > FAN:
        models = cut(models.groupBy(F.expr(f"task div {FAN}").alias("group")).applyInPandas(mean, "task long, n long, weights binary"), "lm-models")
    held = [(x["n"], bytes(x["weights"])) for x in models.orderBy("task").collect()]
    return _mean(held)[1] if held else None


def _counted_words(docs: DataFrame) -> tuple[Lexicon, DataFrame]:
    """The lexicon of the training documents of docs, and the counts of the words that it lacks."""
    counts = cut(counted(docs.where(~held_out())), "lm-counts")
    known, least = lexicon(counts)
    return known, counts.where((F.col("word") != END) & ((F.col("c") < least) | (F.octet_length("word") > LONGEST)))


def _read(docs: DataFrame, known: Lexicon) -> DataFrame:
    """Every row of docs as numbers, read once for learning and scoring: its ids as 16-bit numbers and what Lexicon.read tells; turn: its round."""
    shared = docs.sparkSession.sparkContext.broadcast(known.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(*shared.value)
        for batch in sliced(batches):
            if batch.num_rows:
                yield _rows(batch, [lex.read(text) for text in batch.column(3).to_pylist()])

    turn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", "held_out", turn.alias("turn"), "text")
    found = rows.mapInArrow(run, "doc_id long, held_out boolean, turn int, n_tokens long, n_known long, base_score double, inside double, rare array<struct<word: binary, tf: long>>, ids binary")
    return cut(found.withColumn("at", F.monotonically_increasing_id()), "lm-ids")


def _learned(rows: DataFrame, known: Lexicon) -> np.ndarray:
    """The recurrent weights after every training document of rows.

    They learn in rounds: tasks go on from the same weights, each over the documents of its partitions, and the mean of what
    they come to, by words, starts the next round. Each document belongs to one round, by a hash.
    """
    context = rows.sparkSession.sparkContext
    tasks = max(1, ceil(known.n / ROUNDS / TASK_WORDS))
    lanes = int(min(MOST_LANES, max(TRAIN_LANES, known.n / ROUNDS / tasks / UPDATES / STEPS)))
    weights, shared = known.model().weights(), context.broadcast(known.parts())
    for turn in range(ROUNDS):
        start = context.broadcast(weights)

        def learn(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            model = Lexicon(*shared.value).model()
            model.load(start.value)
            n = model.train(((None, np.frombuffer(ids, np.uint16)) for batch in sliced(batches) for ids in batch.column(0).to_pylist()), lanes)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64()), pa.array([model.weights().tobytes()], pa.binary())], names=["task", "n", "weights"])

        own = rows.where(~F.col("held_out") & (F.col("turn") == turn)).select("ids").coalesce(tasks)
        found = _averaged(own.mapInArrow(learn, "task long, n long, weights binary"))
        weights = weights if found is None else found
    return weights


def train(docs: DataFrame) -> LanguageModel:
    """A model of the training documents of docs (doc_id, text): nine tenths, by a hash of doc_id.

    Counts and recurrent weights learn from all of them. Null texts are empty; no documents give a model that knows the end only.
    """
    known, rest = _counted_words(docs)
    return LanguageModel(known, rest, _learned(_read(docs.where(~held_out()), known), known))


def score(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    docs: doc_id, text; null texts are empty, and have their end only; repeated rows and null ids are rows of their own;
    other columns are ignored. Texts are read whole, the state of the network carried to their end. An empty table gives an
    empty result.
    """
    return _scored(_read(docs, model.lexicon), model)


def trained_and_scored(docs: DataFrame) -> DataFrame:
    """score(docs, train(docs)), whose texts are read once for both."""
    known, rest = _counted_words(docs)
    rows = _read(docs, known)
    return _scored(rows, LanguageModel(known, rest, _learned(rows, known)))


def _scored(rows: DataFrame, model: LanguageModel) -> DataFrame:
    context, known = rows.sparkSession.sparkContext, model.lexicon
    shared, weights = context.broadcast(known.parts()), context.broadcast(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Lexicon(*shared.value).model()
        net.load(weights.value)
        documents = ((at, np.frombuffer(ids, np.uint16)) for batch in sliced(batches) for at, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        scores = net.scores(documents)
        while done := list(islice(scores, 4096)):
            at, own = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(np.array(own) / np.log(10), pa.float64())], names=["at", "own"])

    own = rows.select("at", "ids").mapInArrow(run, "at long, own double")
    rare = rows.select("at", F.explode("rare").alias("r")).select("at", "r.word", "r.tf")
    c, tf = F.coalesce("c", F.lit(0)) + F.lit(EXTRA), F.col("tf")
    inside = F.get(F.array(*[F.lit(float(x)) for x in known.class_total()]), (F.crc32(F.substring("word", 1, 2)) % CLASSES).cast("int"))
    looked = rare.join(model.rest, "word", "left").groupBy("at").agg(
        F.sum(F.when(F.col("c") > 0, tf).otherwise(0)).alias("more"),
        F.sum(tf * F.log10(c / F.lit(known.n + EXTRA * (known.v + 1)))).alias("more_base"),
        F.sum(tf * F.log10(c / inside)).alias("more_score"),
    )
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return rows.drop("rare", "ids").join(own, "at").join(looked, "at", "left").select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "more").alias("n_known"), F.lit(int(known.n)).cast("long").alias("train_tokens"),
        plus("base_score", "more_base").alias("base_score"), (F.col("inside") + plus("own", "more_score")).alias("score"),
    )


def _rows(batch: pa.RecordBatch, read: list[tuple]) -> pa.RecordBatch:
    """A batch's doc_id, held_out and turn with what Lexicon.read told of its texts."""
    ids, n, known, base, inside, rare = zip(*read, strict=True)
    words = pa.array([w for x in rare for w in x], pa.binary())
    counts = pa.array([k for x in rare for k in x.values()], pa.int64())
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in rare])]), pa.int32())
    lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([words, counts], names=["word", "tf"]))
    numbers = pa.array([x.astype(np.uint16).tobytes() for x in ids], pa.binary())
    columns = [*batch.columns[:3], pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(inside, pa.float64()), lists, numbers]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "turn", "n_tokens", "n_known", "base_score", "inside", "rare", "ids"])
