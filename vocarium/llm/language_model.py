"""A gated recurrent language model that scores whole documents.

Tokens are lower-cased words and one end. The model reads the sequence with gated recurrent units; the
state is carried from window to window, so a document of any length is scored as one sequence. The
output is factored into classes: first the class of the next token, then the token within it. Words
outside the model's vocabulary share one token, and which word it is comes from the smoothed corpus
counts of those words, so the probabilities of all words still sum to one.

Learning is spread over the corpus. Word counts are summed over all training documents. Every task
trains its own copy of the network on its documents by truncated backpropagation, starting from the
same parameters, and the copies are averaged, weighted by tokens, in a tree of tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from vocarium.llm.rows import map_rows, utf8
from vocarium.session import work_path, written

#: The end of a document; no word is empty.
END = b""
#: Vocabulary of the network: its most frequent words, besides the end and the shared token.
MODEL_WORDS = 1022
CLASSES = 32
HIDDEN = 16
#: Tokens of a window, over which gradients flow; sequences that run side by side.
WINDOW = 32
LANES = 384
#: Steps of a window in scoring, where its length changes nothing but the size of the matrices.
SCORED = 64
#: First rate of learning, and the steps after which it begins to fall.
RATE = 0.02
SLOWER = 100
FOLDS, HELD_OUT = 7, 2
#: Words whose counts every task has at hand; the others are rare and meet by a join.
COMMON_WORDS = 120_000
SEED = 11
#: Scores up to this size, of either sign, have an exponential in single precision.
SAFE = 80.0
#: Rounds of training; every training document is used in one of them.
ROUNDS = 2
#: Tasks that add up the parameters of all others.
SLOTS = 64


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves ``HELD_OUT``; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


# --- counts -------------------------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, c)`` over ``docs(text)``, ends included; summed in the tasks first."""
    def work(rows: Iterator[tuple]) -> Iterable[tuple]:
        seen: Counter = Counter()
        for (text,) in rows:
            seen.update(text.lower().split())
            seen[END] += 1
            if len(seen) > 300_000:
                yield from seen.items()
                seen.clear()
        yield from seen.items()

    counted = map_rows(docs.select(utf8("text")), work, "word binary, c long", rows=20_000)
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Corpus:
    """What scoring knows of the corpus: totals and the most frequent words."""

    tokens: int
    words: int
    common: dict[bytes, int]
    model: dict[bytes, int]
    rest_tokens: int = 0
    rest_words: int = 0


def corpus(counts: DataFrame) -> Corpus:
    """Totals, and the words that are so frequent that at most ``COMMON_WORDS`` are as frequent.

    The bound on the count is read off a table of its quarter powers of two, so that no more than the
    common words are sent to the driver.
    """
    step = F.floor(4 * F.log2("c"))
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.sum("c").alias("tokens")).collect()
    tokens, words = sum(r["tokens"] for r in sizes), sum(r["words"] for r in sizes)
    least, room = 1 << 62, COMMON_WORDS
    for row in sorted(sizes, key=lambda r: -r["step"]):
        room -= row["words"]
        if room < 0:
            break
        least = row["step"]
    top = counts.filter(step >= least).collect()
    common = {bytes(r["word"]): r["c"] for r in sorted(top, key=lambda r: (-r["c"], r["word"]))}
    chosen = [w for w in common if w != END][:MODEL_WORDS]
    model = {END: 0} | {w: i + 2 for i, w in enumerate(chosen)}
    inside = sum(common[w] for w in chosen) + common.get(END, 0)
    return Corpus(tokens, words, common, model, tokens - inside, words - len(chosen) - (END in common))


# --- network ------------------------------------------------------------------------------------


class Network:
    """Gated recurrent units with a class-factored output, in single precision.

    Token 0 is the end, 1 any word outside the vocabulary. Token 1, which is about every other one, is a
    class of its own, the last. The others, numbered without it, are spread over ``CLASSES`` classes in
    turn, so that frequent words, which have small numbers, lie in different ones.
    """

    def __init__(self, tokens: int, hidden: int = HIDDEN, classes: int = CLASSES, seed: int = SEED):
        self.tokens, self.hidden = tokens, hidden
        self.classes = max(1, min(classes, tokens - 1))
        self.places = -(-(tokens - 1) // self.classes)
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(hidden), shape).astype(np.float32)
        # Gates in the order update, reset, new; the embedding is already multiplied by the input weights.
        self.p = {"embed": draw(tokens, 3 * hidden) * 0.3, "gate": draw(hidden, 2 * hidden), "new": draw(hidden, hidden),
                  "classes": draw(hidden + 1, self.classes + 1) * 0.1,
                  "words": draw(self.classes, hidden + 1, self.places) * 0.1}
        real = np.arange(self.classes)[:, None] + self.classes * np.arange(self.places)[None] < tokens - 1
        self.unused = np.where(real, 0.0, -1e9).astype(np.float32)

    def start_from(self, counts: np.ndarray) -> None:
        """Output biases of the unigram model."""
        full = np.ones(self.classes * self.places)
        full[:self.tokens - 1] = np.delete(counts, 1) + 1.0
        table = np.where(self.unused == 0, full.reshape(self.places, self.classes).T, 1e-9)
        sums = np.append(table.sum(axis=1), counts[1] + 1.0)
        self.p["classes"][-1] = np.log(sums / sums.sum())
        self.p["words"][:, -1] = np.log(table / table.sum(axis=1, keepdims=True))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for k in sorted(self.p):
            size = self.p[k].size
            self.p[k] = flat[at:at + size].reshape(self.p[k].shape).astype(np.float32)
            at += size
        return self

    def read(self, inputs: np.ndarray, fresh: np.ndarray, state: np.ndarray, keep: bool = False):
        """States before each token of a window (steps x lanes), the state after it, and what training needs.

        ``fresh`` marks the steps at which a lane begins a new document, whose state is zero. Inside, a
        lane is a column, so that every pass runs along the lanes; the results are views with lanes first.
        """
        h, p = self.hidden, self.p
        steps, lanes = inputs.shape
        states = np.empty((steps, h, lanes), np.float32)
        gates = np.empty((steps if keep else 1, 2 * h, lanes), np.float32)
        news = np.empty((steps if keep else 1, h, lanes), np.float32)
        begins = fresh.any(axis=1).tolist()
        # The logistic function by the hyperbolic tangent of half its argument, which cannot overflow.
        by_gate, by_new = p["gate"].T * np.float32(0.5), np.ascontiguousarray(p["new"].T)
        embed = np.ascontiguousarray(p["embed"].T)
        embed[:2 * h] *= 0.5
        state = np.ascontiguousarray(state.T)
        for t in range(steps):
            if begins[t]:
                state = state * ~fresh[t]
            states[t] = state
            own = embed.take(inputs[t], axis=1)
            gate, new = gates[t if keep else 0], news[t if keep else 0]
            np.matmul(by_gate, state, out=gate)
            gate += own[:2 * h]
            np.tanh(gate, out=gate)
            gate += 1
            gate *= 0.5
            np.matmul(by_new, gate[h:] * state, out=new)
            new += own[2 * h:]
            np.tanh(new, out=new)
            own = new - state
            own *= gate[:h]
            own += state
            state = own
        return states.transpose(0, 2, 1), state.T, (gates, news)

    def log_probabilities(self, states: np.ndarray, targets: np.ndarray, gradient: bool = False):
        """Natural log probability of each target from the state before it; with gradients if asked.

        Tokens are laid out by class, one column each, so that the sums run along the columns.
        """
        p, n, h = self.p, len(targets), self.hidden
        place, kind = np.divmod(targets - (targets > 0), self.classes)
        kind[targets == 1] = self.classes
        order = np.argsort(kind.astype(np.uint16), kind="stable")
        kind, place = kind[order], place[order]
        wide = np.ones((h + 1, n), np.float32)
        wide[:h] = states.T.take(order, axis=1)
        at = np.arange(n)
        # Places without a token get no weight. Scores within SAFE need no shift before the exponential.
        words = p["words"].copy()
        words[:, -1] += self.unused
        reach = max(1.0, float(wide.max(initial=0)), -float(wide.min(initial=0)))
        most = np.abs(np.where(self.unused[:, None] == 0, p["words"], 0)).sum(axis=1).max()
        shift = reach * max(most, np.abs(p["classes"]).sum(axis=0).max()) > SAFE

        def softmax(scores: np.ndarray, chosen: np.ndarray, across: np.ndarray):
            if shift:
                scores -= scores.max(axis=0)
            own = scores[chosen, across]
            np.exp(scores, out=scores)
            total = scores.sum(axis=0)
            own -= np.log(total)
            if gradient:
                scores /= total
                scores[chosen, across] -= 1
            return own, scores

        out, e = softmax(p["classes"].T @ wide, kind, at)
        grads = back = None
        if gradient:
            grads = {"classes": wide @ e.T, "words": np.zeros_like(p["words"])}
            back = p["classes"][:h] @ e
        edges = np.searchsorted(kind, np.arange(self.classes + 1)).tolist()
        for c, (a, b) in enumerate(zip(edges, edges[1:])):
            if a == b:
                continue
            own, e = softmax(words[c].T @ wide[:, a:b], place[a:b], at[:b - a])
            out[a:b] += own
            if gradient:
                grads["words"][c] = wide[:, a:b] @ e.T
                back[:, a:b] += p["words"][c, :h] @ e
        result = np.empty_like(out)
        result[order] = out
        if gradient:
            straight = np.empty((h, n), np.float32)
            straight[:, order] = back
            back = straight.T
        return result, grads, back

    def gradients(self, inputs, fresh, targets, live, state):
        """Gradients of the mean loss of a window, truncated at its start; also the state after it."""
        h, p = self.hidden, self.p
        lanes_first, after, (gates, news) = self.read(inputs, fresh, state, keep=True)
        states = lanes_first.transpose(0, 2, 1)
        steps, lanes = inputs.shape
        mask = live.ravel()
        columns = across(lanes_first)
        if mask.all():
            _, out, back = self.log_probabilities(columns.T, targets.ravel(), gradient=True)
            into = back.T
        else:
            _, out, back = self.log_probabilities(columns[:, mask].T, targets.ravel()[mask], gradient=True)
            into = np.zeros((h, steps * lanes), np.float32)
            into[:, mask] = back.T
        count = max(1, int(mask.sum()))
        into = into.reshape(h, steps, lanes)
        z, r = gates[:, :h], gates[:, h:]
        # What the gradient of the state after a step is multiplied by on its way to each gate.
        to_new = z * (1 - news * news)
        to_update = (news - states) * z * (1 - z)
        reset = states * r
        to_reset = reset * (1 - r)
        stay = 1 - z
        flow = np.zeros((h, lanes), np.float32)
        entering = np.empty((steps, 3 * h, lanes), np.float32)
        begins = fresh.any(axis=1).tolist()
        for t in range(steps - 1, -1, -1):
            own = entering[t]
            dnew = np.multiply(flow, to_new[t], out=own[2 * h:])
            dreset = p["new"] @ dnew
            np.multiply(flow, to_update[t], out=own[:h])
            np.multiply(dreset, to_reset[t], out=own[h:2 * h])
            flow *= stay[t]
            dreset *= r[t]
            flow += dreset
            flow += p["gate"] @ own[:2 * h]
            flow += into[:, t]
            if begins[t]:
                flow *= ~fresh[t]
        flat = entering.transpose(1, 0, 2).reshape(3 * h, -1)
        grads = {"classes": out["classes"], "words": out["words"], "embed": np.zeros_like(p["embed"]),
                 "gate": columns @ flat[:2 * h].T, "new": across(reset.transpose(0, 2, 1)) @ flat[2 * h:].T}
        order = np.argsort(inputs.astype(np.uint16 if self.tokens <= 1 << 16 else np.int64), axis=None, kind="stable")
        tokens = inputs.ravel()[order]
        first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        rows = entering.transpose(0, 2, 1).reshape(-1, 3 * h)
        grads["embed"][tokens[first]] = np.add.reduceat(rows[order], first, axis=0)
        return {k: g / count for k, g in grads.items()}, after


def across(states: np.ndarray) -> np.ndarray:
    """(steps x lanes x hidden) with a column for each step and lane."""
    return states.transpose(2, 0, 1).reshape(states.shape[2], -1)


class Adam:
    def __init__(self, network: Network, rate: float = RATE):
        self.network, self.rate, self.turn = network, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in network.p.items()}
        self.square = {k: np.zeros_like(v) for k, v in network.p.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.turn += 1
        rate = self.rate / np.sqrt(1 + self.turn / SLOWER)
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        for k, g in grads.items():
            g = g / max(1.0, size)
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.01 * (g * g - self.square[k])
            slow = self.mean[k] / (1 - 0.9 ** self.turn)
            scale = np.sqrt(self.square[k] / (1 - 0.99 ** self.turn)) + 1e-5
            self.network.p[k] -= rate * slow / scale


# --- sequences side by side ---------------------------------------------------------------------


def lanes_of(sequences: Iterator[tuple[int, np.ndarray]], lanes: int, window: int):
    """Windows over sequences that run side by side: ``(inputs, fresh, targets, live, owner)``.

    A lane takes the next sequence where its last one has ended, inside a window too. The input of a
    step is the token before it, and the end for the first. ``owner`` is the sequence's number, -1 in
    lanes that have run out.
    """
    queues: list[tuple[int, np.ndarray] | None] = [None] * lanes
    at = [0] * lanes
    open_ = True
    while True:
        targets = np.zeros((lanes, window), np.int64)
        inputs = np.zeros((lanes, window), np.int64)
        owner = np.full((lanes, window), -1, np.int64)
        fresh = np.zeros((lanes, window), bool)
        for k in range(lanes):
            filled = 0
            while filled < window:
                if queues[k] is None:
                    queues[k] = next(sequences, None) if open_ else None
                    if queues[k] is None:
                        open_ = False
                        break
                    at[k] = 0
                number, ids = queues[k]
                take = min(window - filled, len(ids) - at[k])
                a, b = at[k], at[k] + take
                targets[k, filled:filled + take] = ids[a:b]
                owner[k, filled:filled + take] = number
                if a:
                    inputs[k, filled:filled + take] = ids[a - 1:b - 1]
                else:
                    inputs[k, filled + 1:filled + take] = ids[:b - 1]
                    fresh[k, filled] = True
                at[k], filled = b, filled + take
                if b == len(ids):
                    queues[k] = None
        if not (owner >= 0).any():
            return
        used = (owner >= 0).any(axis=1)
        order = np.flatnonzero(used)
        yield order, inputs[order].T, fresh[order].T, targets[order].T, (owner[order] >= 0).T, owner[order].T


def numbers(text: bytes, model: dict[bytes, int]) -> np.ndarray:
    """Token numbers of a text with its end."""
    words = text.lower().split()
    words.append(END)
    return np.fromiter(map(model.get, words, repeat(1)), np.int64, len(words))


# --- training over the corpus -------------------------------------------------------------------


def untrained(known: Corpus) -> Network:
    """The network before training, with the output of the unigram model."""
    network = Network(len(known.model) + 1)
    counts = np.zeros(network.tokens)
    for word, number in known.model.items():
        counts[number] = known.common.get(word, 0)
    counts[1] = known.rest_tokens
    network.start_from(counts)
    return network


def train_on(network: Network, sequences: Iterator[np.ndarray], lanes: int = LANES, window: int = WINDOW,
             rate: float = RATE) -> int:
    """Truncated backpropagation over the sequences, each once; the number of tokens."""
    adam = Adam(network, rate)
    state = np.zeros((lanes, network.hidden), np.float32)
    tokens = 0
    for order, inputs, fresh, targets, live, _ in lanes_of(enumerate(sequences), lanes, window):
        grads, state[order] = network.gradients(inputs, fresh, targets, live, state[order])
        adam.step(grads)
        tokens += int(live.sum())
    return tokens


def train(docs: DataFrame, known: Corpus, rounds: int = ROUNDS) -> Network:
    """Train over all ``docs(text)``: in each round every task goes on from the same parameters with its
    share of the documents, and the results are averaged by tokens."""
    network = untrained(known)
    spark = docs.sparkSession
    read = docs.select(utf8("text").alias("text"))
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((known.model, network.tokens, network.flat()))

        def work(rows: Iterator[tuple], shared=shared) -> Iterable[tuple]:
            model, size, flat = shared.value
            own = Network(size).load(flat)
            tokens = train_on(own, (numbers(text, model) for (text,) in rows))
            if tokens:
                yield tokens, (own.flat().astype(np.float64) * tokens).tobytes()

        def add(rows: Iterator[tuple]) -> Iterable[tuple]:
            total, summed = 0, None
            for tokens, weighted in rows:
                values = np.frombuffer(weighted)
                total, summed = total + tokens, values.copy() if summed is None else summed + values
            if total:
                yield total, summed.tobytes()

        schema = "tokens long, weighted binary"
        part = read.filter(F.pmod(F.xxhash64("text"), F.lit(rounds)) == turn)
        sums = map_rows(map_rows(part, work, schema, rows=1).repartition(SLOTS), add, schema, rows=1).collect()
        if sums:
            total = sum(r["tokens"] for r in sums)
            network.load(sum(np.frombuffer(r["weighted"]) for r in sums) / total)
    return network


# --- scoring ------------------------------------------------------------------------------------


def score(docs: DataFrame, known: Corpus, network: Network, counts: DataFrame) -> DataFrame:
    """One row for each of ``docs``; see ``language_model``."""
    shared = docs.sparkSession.sparkContext.broadcast((known, network.tokens, network.flat()))
    read = docs.select(F.col("doc_id").cast("bigint"), held_out(F.col("doc_id")), utf8("text"))
    schema = ("row long, doc_id long, held_out boolean, n_tokens long, common_known long, common_logs double, "
              "rest_tokens long, rest_logs double, model_log10 double, words array<binary>, times array<int>")

    def work(rows: Iterator[tuple]) -> Iterable[tuple]:
        from pyspark import TaskContext

        own, size, flat = shared.value
        model = Network(size).load(flat)
        # One number per common word; the last place stands for all others.
        place = {word: i for i, word in enumerate(own.common)}
        logs = np.append(np.log10(np.fromiter(own.common.values(), float, len(place)) + 1), 0.0)
        tokens = np.append(np.fromiter((own.model.get(w, 1) for w in place), np.int64, len(place)), 1)
        base = TaskContext.get().partitionId() << 40
        held: dict[int, list] = {}
        rare: list[tuple] = []

        def sequences() -> Iterator[tuple[int, np.ndarray]]:
            for number, (key, out, text) in enumerate(rows):
                words = text.lower().split()
                words.append(END)
                at = np.fromiter(map(place.get, words, repeat(-1)), np.int64, len(words))
                ids, own_logs = tokens[at], logs[at]
                missing = np.flatnonzero(at < 0).tolist()
                listed = list(Counter(words[i] for i in missing).items())
                for k in range(0, len(listed), 4096):
                    part = listed[k:k + 4096]
                    rare.append((base + number, *[None] * 8, [w for w, _ in part], [n for _, n in part]))
                rest = ids == 1
                held[number] = [key, out, len(words), len(words) - len(missing), float(own_logs.sum()),
                                int(rest.sum()), float(own_logs[rest].sum()), 0.0, 0]
                yield number, ids

        state = np.zeros((LANES, model.hidden), np.float32)
        for order, inputs, fresh, targets, live, owner in lanes_of(sequences(), LANES, SCORED):
            states, state[order], _ = model.read(inputs, fresh, state[order])
            mask = live.ravel()
            columns = across(states) if mask.all() else across(states)[:, mask]
            logp, _, _ = model.log_probabilities(columns.T, targets.ravel()[mask])
            # A document's steps lie one after the other in its lane.
            values = np.zeros(mask.size)
            values[mask] = logp
            owners = owner.T.ravel()
            first = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
            sums = np.add.reduceat(values.reshape(live.shape).T.ravel(), first)
            many = np.diff(np.append(first, len(owners)))
            for number, value, n in zip(owners[first].tolist(), sums.tolist(), many.tolist()):
                if number < 0:
                    continue
                entry = held[number]
                entry[7] += value
                entry[8] += n
                if entry[8] == entry[2]:
                    del held[number]
                    yield (base + number, *entry[:7], entry[7] / float(np.log(10)), None, None)
            yield from rare
            rare.clear()

    scanned = work_path(docs.sparkSession, "scanned")
    map_rows(read, work, schema, rows=512).write.parquet(scanned)
    rows = docs.sparkSession.read.parquet(scanned)
    listed = rows.filter("words IS NOT NULL").select("row", F.explode(F.arrays_zip("words", "times")).alias("w"))
    found = (
        listed.select("row", F.col("w.words").alias("word"), F.col("w.times").alias("n")).join(counts, "word")
        .groupBy("row").agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_logs")))
    joined = rows.filter("words IS NULL").join(found, "row", "left")
    rare_logs = F.coalesce("rare_logs", F.lit(0.0))
    whole = float(np.log10(known.tokens + known.words + 1))
    rest = float(np.log10(known.rest_tokens + known.rest_words + 1))
    return joined.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("common_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(known.tokens).cast("bigint").alias("train_tokens"),
        (F.col("common_logs") + rare_logs - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("model_log10") + F.col("rest_logs") + rare_logs - F.col("rest_tokens") * rest).alias("score"))


def language_model(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs``.

    Learns from the whole texts of all rows outside the held-out fold and scores all rows. A null or
    empty text is one end. Rows without an id are trained on; repeated rows are counted and scored
    each; other columns play no part; an empty table gives no rows. Without training rows every word
    is unseen and the score is that of the untrained network.
    """
    training = docs.filter(~held_out(F.col("doc_id")))
    counts = written(word_counts(training), "word_counts")
    known = corpus(counts)
    return score(docs, known, train(training, known), counts)
