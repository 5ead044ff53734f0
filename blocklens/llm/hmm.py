"""Language-model scoring with a hidden Markov model.

Words are emitted from latent states; a text's probability is the sum over all
state paths, taken exactly by the scaled forward recursion.  Baum-Welch trains
the model: every task runs forward-backward over its training texts and sends
expected counts, which are summed across partitions and make the next model.

* The corpus is read once into *parts*: rows that hold some documents as
  numbers of a dictionary of their own.  Word counts over all training texts
  are made by grouping the dictionaries, and come back to the parts, so no
  task and not the driver ever holds the vocabulary, which grows with the data.
* A state emits a word class, and the class its word by add-one share:
  P(w | state) = (1 - unknown) * E[class, state] * (c + 1) / S[class].
  The most frequent words have classes of their own, the others share one by
  their last letters; the table E is bounded by ``FREQUENT`` + ``ENDINGS``.
  One class is the end of a text, one symbol stands for any unknown word; its
  probability is the state's share of words seen once (Good-Turing).
* Training starts from seeded noise with a sweep of ``WARM_ROUNDS`` rounds, each
  over another hashed share of the training texts (incremental EM: the counts of
  all shares so far make the next model, so every text weighs the same);
  ``PASSES`` rounds over all training texts follow, at any size of the input.
  Counts are summed in fixed point, so the order of tasks is no matter.

Defined results: null text counts as empty (the end token alone); a null
doc_id is scored, not learned from, and its held_out is null; without training
tokens every score is 0; repeated rows count each; other columns are ignored;
doc_ids are integers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blocklens.llm.common import drop_stage, map_frames, session, stage, texts

STATES = 8
FREQUENT, ENDINGS = 16_384, 16_384
#: tokens after which a part closes, and tokens worked on at once
PART_TOKENS, CHUNK_TOKENS = 1_000_000, 250_000
WARM_ROUNDS, PASSES = 12, 3
#: pseudo-tokens of the class distribution added to every state
PRIOR = 100.0
#: expected counts are sent as whole multiples of 1 / FIXED
FIXED = 1 << 20
SEED = 4
#: positions after which forward and backward variables are scaled again
RESCALE = 8
TRAIN, HELD_OUT, NO_ID = 0, 1, 2

_PARTS = ("part long, tokens long, doc_ids array<long>, folds array<int>, sizes array<int>, "
          "shares array<int>, words array<string>, counts array<long>")


def words_of(text: str) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at ASCII white space."""
    return text.encode().lower().split()


class _Numbers(dict):
    """Word -> number, the next free one for a word not met before."""

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def _parts(part_tokens: int, shares: int):
    """Documents -> parts; number 0 of a part's dictionary is the end token.

    A part's documents stand by hashed share, the numbers of each share in a
    column of their own (ids0, ids1, ...), so a round over one share reads no more.
    """
    import zstandard

    def run(frames):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId() << 24

        def close():
            order = np.argsort(share, kind="stable")
            numbers = [held[i] for i in order]
            sizes = np.array([len(h) for h in numbers])
            own = np.array(folds)[order]
            every = np.concatenate(numbers)
            many = np.bincount(np.array(share), minlength=shares)
            ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(many)))]
            row = {
                "part": [part], "tokens": [len(every)], "doc_ids": [np.array(docs, np.int64)[order]],
                "folds": [own], "sizes": [sizes], "shares": [many], "words": [[w.decode() for w in known]],
                "counts": [np.bincount(every[np.repeat(own == TRAIN, sizes)], minlength=len(known))]}
            pack = zstandard.ZstdCompressor(3).compress
            return pd.DataFrame(row | {f"ids{k}": [pack(every[ends[k]:ends[k + 1]].tobytes())]
                                       for k in range(shares)})

        known, held, docs, folds, share, tokens = _Numbers({b"": 0}), [], [], [], [], 0
        for frame in frames:
            for doc_id, text, fold, hashed in zip(frame["doc_id"], frame["text"], frame["fold"],
                                                  frame["hash"]):
                words = words_of(text)
                words.append(b"")
                got = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
                held.append(got)
                docs.append(0 if pd.isna(doc_id) else int(doc_id))       # its fold says NO_ID
                folds.append(int(fold))
                share.append(int(hashed) % shares)
                tokens += len(got)
                if tokens >= part_tokens:
                    yield close()
                    known, held, docs, folds, share, tokens = _Numbers({b"": 0}), [], [], [], [], 0
                    part += 1
        if held:
            yield close()
    return run


def _packed(frame: pd.DataFrame) -> pd.DataFrame:
    """A part's dictionary, ordered by number, in two binary columns."""
    import zstandard
    frame, pack = frame.sort_values("number"), zstandard.ZstdCompressor(1).compress
    return pd.DataFrame({"part": frame["part"].iloc[:1].to_numpy(),
                         "c": [pack(frame["c"].to_numpy("<i8").tobytes())],
                         "cls": [pack(frame["cls"].to_numpy("<i4").tobytes())]})


def prepare(docs: DataFrame, folds: int = 7, held_out: int = 2, part_tokens: int = PART_TOKENS,
            frequent: int = FREQUENT, endings: int = ENDINGS, shares: int = WARM_ROUNDS):
    """(parts with counts and classes, N, V, class sizes S as an array)."""
    session(docs)
    fold = F.crc32(F.col("doc_id").cast("string")) % folds == held_out
    rows = texts(docs).withColumn("fold", F.when(F.col("doc_id").isNull(), NO_ID)
                                  .when(fold, HELD_OUT).otherwise(TRAIN)) \
        .withColumn("hash", F.hash("doc_id"))
    shares = max(1, shares)
    parts = stage(map_frames(rows, _parts(part_tokens, shares), _PARTS + "".join(
        f", ids{k} binary" for k in range(shares))), "hmm-parts")
    entry = F.explode(F.arrays_zip("words", "counts", F.sequence(
        F.lit(0), F.size("words") - 1).alias("number"))).alias("e")
    listed = parts.select("part", entry).select(
        "part", F.col("e.words").alias("word"), F.col("e.counts").alias("n"), "e.number")
    # every part lists a word once, so a word's window has one row a part
    same = Window.partitionBy("word")
    counted = stage(listed.select(
        "part", "number", F.sum("n").over(same).alias("c"),
        (F.col("part") == F.min("part").over(same)).alias("first"),
        F.xxhash64("word").alias("hash"), (F.col("word") == "").alias("end"),
        F.pmod(F.xxhash64(F.expr("right(word, 3)")), F.lit(endings)).cast("int").alias("ending"),
    ), "hmm-words")
    known = counted.where("first and c > 0")
    tokens, types = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = known.where("not end").orderBy(F.desc("c"), "hash").limit(frequent).select("hash").collect()
    top = counted.sparkSession.createDataFrame(
        [(r["hash"], i + 1) for i, r in enumerate(top)], "hash long, at int")
    classed = counted.join(F.broadcast(top), "hash", "left").withColumn(
        "cls", F.when(F.col("c") == 0, -1).when(F.col("end"), 0).otherwise(
            F.coalesce("at", F.col("ending") + 1 + frequent)))
    sizes = np.zeros(1 + frequent + endings)
    for r in classed.where("first and c > 0").groupBy("cls").agg(
            F.sum(F.col("c") + 1).alias("s")).collect():      # bounded by the classes
        sizes[r["cls"]] = r["s"]
    packed = classed.select("part", "number", "c", "cls").groupBy("part").applyInPandas(
        _packed, "part long, c binary, cls binary")
    ready = stage(parts.drop("words", "counts").join(packed, "part"), "hmm-ready")
    drop_stage(parts)
    drop_stage(counted)
    return ready, int(tokens), int(types), sizes


# --- the model ---------------------------------------------------------------------


class Model:
    """Start, transition, class and unknown probabilities of the states."""

    def __init__(self, start, move, emit, unknown, sizes):
        self.start, self.move, self.emit, self.unknown = start, move, emit, unknown
        self.sizes_given, self.sizes = sizes, np.maximum(sizes, 1.0)
        # a word of count zero; the last row is the unknown symbol
        once = np.vstack([emit * (1 - unknown) / self.sizes[:, None], unknown])
        self._top = once.max(axis=1)
        self._rows = once / np.maximum(self._top, 1e-300)[:, None]

    @classmethod
    def noise(cls, states: int, sizes: np.ndarray, tokens: int) -> "Model":
        draw = np.random.default_rng(SEED)
        base = sizes / max(sizes.sum(), 1.0)
        emit = base[:, None] * np.exp(0.5 * draw.standard_normal((len(sizes), states)))
        emit /= np.maximum(emit.sum(axis=0), 1e-300)
        move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        unknown = np.full(states, 0.01 if tokens else 1.0)
        return cls(np.full(states, 1 / states), move, emit, unknown, sizes)

    @classmethod
    def counted(cls, counts: "Counts", sizes: np.ndarray) -> "Model":
        states = len(counts.start)
        base = sizes / max(sizes.sum(), 1.0)
        total = counts.emit.sum(axis=0)
        return cls((counts.start + 1) / (counts.start.sum() + states),
                   (counts.move + 1) / (counts.move.sum(axis=1, keepdims=True) + states),
                   (counts.emit + PRIOR * base[:, None]) / (total + PRIOR),
                   np.minimum((counts.once + 0.5) / (total + 1), 0.5), sizes)

    def emissions(self, c: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """P(token | state) for tokens given by count and class (-1: unknown)."""
        seen, top = self.relative(c, cls)
        return seen * top[:, None]

    def relative(self, c: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Emissions as shares of the token's greatest one, and that."""
        known = cls >= 0
        if not known.all():
            cls, c = np.where(known, cls, len(self.emit)), np.where(known, c, 0)
        return np.take(self._rows, cls, axis=0), self._top[cls] * (c + 1.0)


class Counts:
    """Expected counts of one pass."""

    def __init__(self, states: int, classes: int):
        self.start = np.zeros(states)
        self.move = np.zeros((states, states))
        self.emit = np.zeros((classes, states))
        self.once = np.zeros(states)

    def add(self, other: "Counts") -> None:
        for name in ("start", "move", "emit", "once"):
            getattr(self, name)[:] += getattr(other, name)


class Lattice:
    """Texts side by side: position t of all texts longer than t is one block."""

    def __init__(self, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        ends = np.bincount(sizes, minlength=sizes.max() + 1)
        self.width = len(sizes) - np.cumsum(ends)[:-1]          # texts longer than t
        self.at = np.concatenate(([0], np.cumsum(self.width)))
        # of each place, block by block: its text by length, its token's number text by text
        self.rank = np.arange(self.at[-1]) - np.repeat(self.at[:-1], self.width)
        begin = (np.cumsum(sizes) - sizes)[self.order]
        self.token = begin[self.rank] + np.repeat(np.arange(len(self.width)), self.width)

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Values given text by text, block by block."""
        return values[self.token]

    def by_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over each text of values given block by block."""
        out = np.empty(len(self.order))
        out[self.order] = np.bincount(self.rank, values, len(self.order))
        return out

    def forward(self, model: Model, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward variables, scaled at every ``RESCALE``-th position, block by block,
        and the logarithms of what they were divided by."""
        alpha, logs, last = np.empty_like(seen), np.zeros(len(seen)), 0
        ones = np.ones(seen.shape[1])
        for t, (a, n) in enumerate(zip(self.at.tolist(), self.width.tolist())):
            now = alpha[a:a + n]
            if t:
                np.matmul(alpha[last:last + n], model.move, out=now)
            else:
                now[:] = model.start
            now *= seen[a:a + n]
            if t % RESCALE == 0:
                total = now @ ones
                now /= total[:, None]
                logs[a:a + n] = np.log10(total)
            last = a
        return alpha, logs

    def ends(self) -> np.ndarray:
        """The places of the texts' last tokens."""
        out = np.empty(len(self.order), np.int64)
        out[self.rank] = np.arange(len(self.rank))      # the last place of a text stays
        return out

    def backward(self, model: Model, seen: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors of the states, block by block, and the expected moves;
        overwrites ``seen`` and ``alpha``."""
        beta, back = np.ones_like(seen), np.ascontiguousarray(model.move.T)
        ones = np.ones(seen.shape[1])
        at, width = self.at.tolist(), self.width.tolist()
        for t in range(len(width) - 1, 0, -1):
            a, n, before = at[t], width[t], at[t - 1]
            ahead = seen[a:a + n]
            ahead *= beta[a:a + n]
            if t % RESCALE == 0:
                ahead /= (ahead @ ones)[:, None]
            np.matmul(ahead, back, out=beta[before:before + n])
        beta *= alpha
        each = (1 / (beta @ ones))[:, None]
        beta *= each
        alpha *= each
        # a token's predecessor stands a block before, at the same rank
        first = width[0]
        before = np.arange(first, len(seen)) - np.repeat(self.width[:-1], self.width[1:])
        move = np.take(alpha, before, axis=0).T @ seen[first:]
        return beta, model.move * move


def log_likelihoods(model: Model, sizes: np.ndarray, c: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """log10 probability of each text; tokens are given text by text."""
    grid = Lattice(sizes)
    seen, top = model.relative(grid.spread(c), grid.spread(cls))
    alpha, logs = grid.forward(model, seen)
    logs += np.log10(top)
    ends = grid.ends()
    logs[ends] += np.log10(alpha[ends].sum(axis=1))
    # rounding may not make a probability exceed one
    return np.minimum(grid.by_text(logs), 0.0)


def add_counts(counts: Counts, model: Model, sizes: np.ndarray, c: np.ndarray, cls: np.ndarray) -> None:
    """Forward-backward over some texts; adds their expected counts."""
    grid = Lattice(sizes)
    c, cls = grid.spread(c), grid.spread(cls.astype(np.int64))
    seen, _ = model.relative(c, cls)
    alpha, _ = grid.forward(model, seen)
    gamma, move = grid.backward(model, seen, alpha)
    counts.move += move
    counts.start += gamma[:grid.width[0]].sum(axis=0)
    for emit, own in zip(counts.emit.T, gamma.T):
        emit += np.bincount(cls, own, len(emit))
    counts.once += (c == 1).astype(float) @ gamma


def _documents(frames, folds: tuple[int, ...], shares: list[int] | None = None):
    """(part row, chosen texts, sizes, counts, classes) in chunks of similar length,
    of some of the hashed shares of the texts or of all."""
    import zstandard
    unpack = zstandard.ZstdDecompressor().decompress
    for frame in frames:
        for row in frame.itertuples():
            every = np.asarray(row.sizes, np.int64)
            edge = np.concatenate(([0], np.cumsum(np.asarray(row.shares, np.int64))))
            some = range(len(edge) - 1) if shares is None else shares
            ids = np.concatenate([np.frombuffer(unpack(getattr(row, f"ids{k}")), np.uint32) for k in some])
            rows = np.concatenate([np.arange(edge[k], edge[k + 1]) for k in some])
            sizes = every[rows]
            begin = np.cumsum(sizes) - sizes
            c = np.frombuffer(unpack(row.c), "<i8")
            cls = np.frombuffer(unpack(row.cls), "<i4")
            chosen = np.flatnonzero(np.isin(np.asarray(row.folds)[rows], folds))
            chosen = chosen[np.argsort(sizes[chosen], kind="stable")]
            cut = np.cumsum(sizes[chosen]) // CHUNK_TOKENS
            for own in np.split(chosen, np.flatnonzero(np.diff(cut)) + 1):
                if len(own):
                    n = sizes[own]
                    at = np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    tokens = ids[at]
                    yield row, rows[own], n, c[tokens], cls[tokens]


def _gathered(chunks):
    """(sizes, counts, classes) of several chunks at once, up to ``CHUNK_TOKENS``."""
    held, tokens = [], 0
    for _, _, *chunk in chunks:
        if held and tokens + len(chunk[1]) > CHUNK_TOKENS:
            yield tuple(map(np.concatenate, zip(*held)))
            held, tokens = [], 0
        held.append(chunk)
        tokens += len(chunk[1])
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _expect(model: Model, shares: list[int] | None = None):
    """Parts -> this task's expected counts, one row for each class it met and
    one for each state's start, moves and words seen once."""
    states, classes = len(model.start), len(model.emit)

    def run(frames):
        counts, some = Counts(states, classes), False
        for sizes, c, cls in _gathered(_documents(frames, (TRAIN,), shares)):
            add_counts(counts, model, sizes, c, cls)
            some = True
        if some:
            met = np.flatnonzero(counts.emit.any(axis=1))
            rows = np.vstack([counts.start, counts.once, counts.move, counts.emit[met]])
            kind = np.concatenate((np.arange(-2 - states, 0), met))
            out = pd.DataFrame(np.rint(rows * FIXED).astype(np.int64),
                               columns=[f"s{k}" for k in range(states)])
            out.insert(0, "kind", kind)
            yield out
    return run


def share_columns(ready: DataFrame) -> list[str]:
    return [c for c in ready.columns if c.startswith("ids")]


def expected(ready: DataFrame, model: Model, shares: list[int] | None = None) -> Counts | None:
    """Counts of the training texts, or of some shares of them, summed across partitions."""
    states, classes = len(model.start), len(model.emit)
    names = [f"s{k}" for k in range(states)]
    ids = share_columns(ready) if shares is None else [f"ids{k}" for k in shares]
    sent = ready.select("folds", "sizes", "shares", "c", "cls", *ids).mapInPandas(
        _expect(model, shares), "kind long, " + ", ".join(f"{n} long" for n in names))
    total = sent.groupBy("kind").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    if not len(total):
        return None
    kind, rows = total["kind"].to_numpy(), total[names].to_numpy() / FIXED
    counts = Counts(states, classes)
    own = rows[np.argsort(kind)][:2 + states]
    counts.start, counts.once, counts.move = own[0], own[1], own[2:]
    counts.emit[kind[kind >= 0]] = rows[kind >= 0]
    return counts


def baum_welch(ready: DataFrame, model: Model) -> Model:
    """One round over all training texts of ``ready``, then a new model."""
    counts = expected(ready, model)
    return model if counts is None else Model.counted(counts, model.sizes_given)


def train(ready: DataFrame, tokens: int, sizes: np.ndarray, states: int = STATES,
          warm_rounds: int = WARM_ROUNDS, passes: int = PASSES) -> Model:
    """A sweep of ``warm_rounds`` shares, then passes; every text is in each of them."""
    model = Model.noise(states, sizes, tokens)
    if not tokens:
        return model
    seen = Counts(states, len(sizes))
    every = range(len(share_columns(ready)))
    for turn in range(min(warm_rounds, len(every))):
        counts = expected(ready, model, list(every[turn::warm_rounds]))
        if counts is not None:
            seen.add(counts)
            model = Model.counted(seen, sizes)
    for _ in range(passes):
        model = baum_welch(ready, model)
    return model


def _score(model: Model, tokens: int, types: int):
    def run(frames):
        for row, own, sizes, c, cls in _documents(frames, (TRAIN, HELD_OUT, NO_ID)):
            text = np.repeat(np.arange(len(own)), sizes)
            base = np.log10((c + 1) / (tokens + types + 1))
            fold = np.asarray(row.folds)[own]
            yield pd.DataFrame({
                "doc_id": pd.array(np.where(fold == NO_ID, None, row.doc_ids[own]), dtype="Int64"),
                "held_out": pd.array(np.where(fold == NO_ID, None, fold == HELD_OUT), dtype="boolean"),
                "n_tokens": sizes, "n_known": np.bincount(text, c > 0, len(own)).astype(np.int64),
                "train_tokens": tokens, "base_score": np.bincount(text, base, len(own)),
                "score": log_likelihoods(model, sizes, c, cls)})
    return run


def score_documents(docs: DataFrame, states: int = STATES, folds: int = 7, held_out: int = 2,
                    part_tokens: int = PART_TOKENS, frequent: int = FREQUENT,
                    endings: int = ENDINGS, warm_rounds: int = WARM_ROUNDS,
                    passes: int = PASSES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    ready, tokens, types, sizes = prepare(docs, folds, held_out, part_tokens, frequent, endings,
                                           warm_rounds)
    model = train(ready, tokens, sizes, states, warm_rounds, passes)
    return map_frames(
        ready, _score(model, tokens, types),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double")
