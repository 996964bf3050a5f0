"""Language-model scores by a weighted backoff automaton over words.

A state is a history of up to ORDER - 1 words that training holds; its arcs are the words counted after it, with weight
log10 P(w | h), P(w | h) = L * c(h w) / c(h) + (1 - L) * P(w | h'), h' being h without its first word.  A word that was not
counted after h takes the state's failure arc, of weight log10 (1 - L), to h'; the state without history has an arc for
every word, P(w) = (c(w) + ADD) / (N + ADD * (V + 1)).  A text is one walk from left to right that carries its state, from
the start over its words to the end token, and adds up weights.  Texts of a block walk side by side, long ones in pieces
of PIECE tokens: what state a piece begins in follows from the ORDER - 1 tokens before it.

L is learnt from training texts, for each length of history, power of two of c(h) and power of two of the number of words
that follow h: the texts whose id's CRC-32 modulo 10 is TUNING are counted apart, and L is the share of their tokens,
after such a history in all others' counts, that those counts hold after it.

The automaton grows with the corpus and is never in one place.  Texts are settled in blocks as word numbers; every block
sends its distinct word sequences of each length, with their training counts, to slots by hash; a slot adds them up over
the corpus and answers each block's keys in the block's own order; so each block gets the arcs that its texts can take,
builds its part of the automaton, and walks.  What it is built from goes as soon as it is used, and what is computed over
a block's sequences is so for AT_ONCE of them at a time, as two workers share an executor's memory.  A sequence counts once a block however common it is, so no slot or task
gathers a common one.  Sequences with one history share a slot, which counts the words that follow it, but for those of
a crowd, a history that training has over CROWD times (at most MOST_HOT of each length): these are dealt singly, every
slot counts the words that follow it there, and the sums over slots, a row a crowd, go to all blocks and to what L is
learnt from.  So a crowd's weights are what they would be in one slot.  A slot is planned for SLOT_TOKENS tokens of the
corpus, so there are more of them as it grows.  Keys are hashes of WORD_BITS bits of the last word and the rest of the
history, or the crowd's number; crowds, N, V, the number of texts and the counts that L is a share of are all that
reaches the driver.

With hot given, histories of words alone that occur over hot times are not counted so, but take the L of the most
frequent histories that aren't such; without it, as in the query, no result depends on how a history is dealt.

Defined results: a null text is empty and has one token, the end; null ids are learnt from and not held out; repeated
rows are learnt from each and repeat; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import shared

ORDER, ADD = 3, 0.1
#: The remainder that marks tuning texts.
TUNING = 1
#: Characters of text in one block, tokens of the corpus a slot and a task of blocks, and tokens that are walked in one piece.
BLOCK, SLOT_TOKENS, TASK_TOKENS, PIECE = 8 << 20, 4_000_000, 2_000_000, 512
#: Sequences of a block that are worked on at once.
AT_ONCE = 1 << 17
END, START = np.uint64(1), np.uint64(2)
#: Powers of two of c(h), classes of the number of words that follow h (0: not counted), and bits of a key for the last word.
POWERS, FOLLOWING, WORD_BITS = 48, 6, 22
#: Times in training that make a history a crowd, the most crowds of a length that there can be, and bits of a key for a crowd's number.
CROWD, MOST_HOT, CROWD_BITS = 500_000, 1 << 20, 21


def tokens_of(text: str | None) -> list[int]:
    """Hashes of a text's words, A-Z in lower case, without the end."""
    return list(map(xxhash.xxh3_64_intdigest, (text or "").encode("utf-8", "surrogatepass").lower().split()))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    for _ in range(2):
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct keys, a place of each, and each place's number among them."""
    by = np.argsort(keys)
    ordered = keys[by]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(keys) else np.empty(0, bool)
    ordered, first, of = ordered[new], by[new].astype(np.int32), np.empty(len(keys), np.int32)
    number = np.cumsum(new, dtype=np.int32)
    number -= 1
    of[by] = number
    return ordered, first, of


class Sequences:
    """The distinct word sequences of one length in a block, in the order of their keys; those of one history are neighbours.

    hot: ascending keys of the words that histories dealt singly are made of; crowds: of each length of history, ascending
    names of those that are, or None for all that are made of hot words.
    """

    def __init__(self, words: np.ndarray, numbers: np.ndarray, starts: np.ndarray, length: int, hot: np.ndarray, crowds: list[np.ndarray] | None = None):
        if length == 1:
            self.keys, first, same = distinct(words >> np.uint64(8))
            place = np.empty(len(words), np.int32)
            place[numbers[::-1]] = np.arange(len(numbers), dtype=np.int32)[::-1]
            self.first, self.of = place[first], same[numbers]
        else:
            self.keys, self.first, self.of = distinct(_keys(words, numbers, starts, length, hot, crowds))
        self.begin = groups(self.keys).astype(np.int32)

    def counts(self, learn: np.ndarray) -> np.ndarray:
        return np.rint(np.bincount(self.of, learn, len(self.keys))).astype(np.int64)


def _keys(words: np.ndarray, numbers: np.ndarray, starts: np.ndarray, length: int, hot: np.ndarray, crowds: list[np.ndarray] | None) -> np.ndarray:
    """Of each token, the key of the sequence that ends in it.  A history's name is its own key as a sequence, START before the first token."""
    if length == 1:
        return (words >> np.uint64(8))[numbers]
    n, ends = len(numbers), np.append(starts, len(numbers))[1:]
    early = [x[x < ends] for x in (starts + k for k in range(length - 1))]  # places of texts' first tokens, second tokens, ...
    single, number = np.zeros(n, bool), np.empty(0, np.uint64)
    if len(hot):
        is_hot, start_hot = np.isin(words >> np.uint64(8), hot)[numbers], bool(np.isin(START, hot))
        single[:] = True
        for back in range(1, length):
            warm = np.full(n, start_hot)
            warm[back:] = is_hot[:-back]
            for at in early[:back]:
                warm[at] = start_hot
            single &= warm
    if crowds is not None and single.any():  # a crowd's words are each as frequent as it is
        names, found = np.full(n, START), crowds[length - 2]
        names[1:] = _keys(words, numbers, starts, length - 1, hot, crowds)[:-1]
        names[starts] = START
        own = np.flatnonzero(single)
        names = names[own]
        at = np.searchsorted(found, names)
        there = np.append(found, START)[at] == names if len(found) else np.zeros(len(own), bool)
        there &= at < len(found)
        single[own[~there]] = False
        number = at[there].astype(np.uint64)
        del names, own, at, there
    tokens, history = words[numbers], np.zeros(n, np.uint64)
    for back in range(1, length):
        before = np.full(n, START)
        before[back:] = tokens[:-back]
        for at in early[:back]:
            before[at] = START
        history *= np.uint64(0x9E3779B97F4A7C15)
        history += before
        del before
        history = _mix(history)
    if single.any():
        mixed = _mix(history[single] + tokens[single] * np.uint64(0x9E3779B97F4A7C15))
        if crowds is not None:
            mixed = mixed >> np.uint64(WORD_BITS + CROWD_BITS) << np.uint64(WORD_BITS + CROWD_BITS) | number << np.uint64(WORD_BITS)
        history[single] = mixed
        del mixed
    del tokens
    history >>= np.uint64(WORD_BITS)
    history <<= np.uint64(WORD_BITS)
    history |= (_mix(words) >> np.uint64(65 - WORD_BITS) << np.uint64(1))[numbers]
    history |= single
    return history


def groups(keys: np.ndarray) -> np.ndarray:
    """Where each history begins in ascending keys."""
    h = keys >> np.uint64(WORD_BITS)
    return np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(keys) else np.empty(0, np.int64)


def scattered(keys: np.ndarray) -> np.ndarray:
    """Whether a sequence is dealt singly, as its history is a crowd: the last bit of its key."""
    return (keys & np.uint64(1)) == 1


def crowd_of(keys: np.ndarray) -> np.ndarray:
    """The number of the crowd that is the history of a sequence dealt singly."""
    return (keys >> np.uint64(WORD_BITS) & np.uint64((1 << CROWD_BITS) - 1)).astype(np.int64)


def following(keys: np.ndarray, types: np.ndarray, of_crowds: np.ndarray) -> np.ndarray:
    """Numbers of words that follow the histories of ascending keys: as their slots count, or as summed for crowds."""
    first, types = keys[groups(keys)], types.copy()
    single = scattered(first)
    types[single] = of_crowds[crowd_of(first[single])] if len(of_crowds) else 0
    return types


def following_class(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, 1 + np.minimum(np.floor(np.log2(np.maximum(n, 1))), FOLLOWING - 2), 0).astype(np.int64)


def parts(n: int) -> list[slice]:
    """Slices of at most AT_ONCE of n places."""
    return [slice(i, min(i + AT_ONCE, n)) for i in range(0, n, AT_ONCE)]


def held_out(id_col: Column, remainder: int = 0) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 10 == remainder, F.lit(False))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, block_bytes: int = BLOCK, slot_tokens: int = SLOT_TOKENS, hot: int | None = None, crowd: int = CROWD) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("_id"), held_out(F.col(id_col)).alias("_held"), held_out(F.col(id_col), TUNING).alias("_tuning"), F.col(text_col).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()
    columns = f"block string, ids array<{kind}>, held array<boolean>, tuning array<boolean>, n long, texts long, tuned_texts long, words binary, numbers binary, lengths binary"
    tokens = shared.settle(slim.mapInArrow(lambda batches: _numbered(batches, block_bytes), columns), "lm-tokens")
    whole, texts, tuned_texts = (x or 0 for x in tokens.agg(F.sum("n"), F.sum("texts"), F.sum("tuned_texts")).first())
    slots, tasks = (max(1, math.ceil(whole / x)) for x in (slot_tokens, TASK_TOKENS))
    stored = "slot int, block string, counts binary, types binary, n long, v long, hot array<long>, cells array<struct<cell:long,seen:long,told:long>>, crowds array<struct<crowd:long,types:long,before:long,seen:long,told:long,left:long>>"

    def counted(length: int, hot_keys: np.ndarray, crowds: list[np.ndarray] | None) -> DataFrame:
        """Answers of slots for sequences of one length."""

        def ask(batches):
            for row in _rows(batches):
                found = Sequences(row["words"], row["numbers"], row["starts"], length, hot_keys, crowds)
                yield from _requests(row["block"], length, found.keys, found.counts(row["learn"]), found.counts(row["learn"] * row["tuned"]), slots)
            shared.trim()

        sent = tokens.select("block", "held", "tuning", "words", "numbers", "lengths").mapInArrow(ask, "slot int, block string, keys binary, counts binary, tuned binary")
        return shared.settle(sent.repartitionById(slots, F.col("slot")).groupBy("slot").applyInArrow(lambda t: _answer(t, length, limit, crowds is not None), stored), "lm-answers")

    def common(answers: DataFrame) -> np.ndarray:
        """Ascending keys of the sequences that training has over limit times, START if it has as many texts."""
        found = [r[0] for r in answers.filter("block is null").select(F.explode("hot")).collect()]  # MOST_HOT numbers at most
        return np.sort(np.array([*found, *([int(START)] if texts > limit else [])], np.int64).view(np.uint64))

    limit = max(crowd if hot is None else hot, whole // MOST_HOT)
    single = counted(1, np.empty(0, np.uint64), None)
    totals = single.filter("block is null")
    n, v = (x or 0 for x in totals.agg(F.sum("n"), F.sum("v")).first())
    hot_keys, longer, sums = common(single), [], []
    crowds = [hot_keys] if hot is None else None
    for length in range(2, order + 1):
        longer.append(counted(length, hot_keys, crowds))
        sums.append(_crowd_sums(longer[-1], 0 if crowds is None else len(crowds[-1])))
        if crowds is not None and length < order:
            crowds = [*crowds, common(longer[-1])]
    base = (ADD, n + ADD * (v + 1))
    blend = np.stack([np.zeros((POWERS, FOLLOWING)), *(_learnt(*x) for x in zip(longer, sums, strict=True))])
    of_crowds = [np.empty(0, np.int64), *(x["types"] for x in sums)]

    def walk(batches):
        for row in _rows(batches):
            seen, types = [], []
            for k in range(order):
                found = Sequences(row["words"], row["numbers"], row["starts"], k + 1, hot_keys, crowds)
                types.append(following(found.keys, _joined(row["types"][k]), of_crowds[k]) if k else None)
                del found.keys  # only its groups' begins are needed from here
                seen.append(found)
            del row["words"], row["numbers"], found
            counts = [_joined(x, narrow=True) for x in row["counts"]]
            automaton = Automaton(seen, counts, types, row["starts"], texts, base, blend)
            words = counts[0][seen[0].of]
            del seen, types, counts
            add = lambda x, at: pa.array(np.add.reduceat(x, at))
            total = automaton.walk(row["starts"], row["lengths"])
            del automaton
            known, low = add((words > 0).astype(np.int64), row["starts"]), add(np.log10((words + base[0]) / base[1]), row["starts"])
            yield pa.RecordBatch.from_arrays(
                [row["ids"], row["held"], pa.array(row["lengths"]), known, pa.array(np.full(len(row["lengths"]), n)), low, pa.array(total)],
                names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )
            del row, words
            shared.trim()

    return _gather(tokens, [single, *longer], tasks).mapInArrow(walk, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


class Automaton:
    """The states and arcs that a block's texts can take.

    States: 0 without history, then the block's histories by length, last the start.  Arcs: of each length of history, the
    block's sequences of one word more; a token's arc out of a state that its text has reached is the one of that length.
    """

    def __init__(self, seen: list[Sequences], counts: list[np.ndarray], types: list[np.ndarray], starts: np.ndarray, texts: int, base: tuple[float, float], blend: np.ndarray):
        order = len(seen)
        sizes = [len(s.first) for s in seen]
        self.keep = order - 1
        # the start is a history of each length: start words only; all are counted once a training text
        offset = np.cumsum([1, *sizes[: order - 1]])
        start_of = [0, *(int(offset[-1]) + k for k in range(order - 1))]
        self.start = start_of[-1]
        n_states, n_arcs, n_tokens = int(offset[-1]) + order - 1, sum(sizes), len(seen[0].of)
        whole = np.int32 if n_states + n_arcs < 1 << 31 else np.int64
        first_token = np.zeros(n_tokens, bool)
        first_token[starts] = True

        def state_at(k: int, at: np.ndarray) -> np.ndarray:
            """State of the k words up to a token; -1 is the start."""
            return np.where(at >= 0, offset[k - 1] + seen[k - 1].of[np.maximum(at, 0)], start_of[k]) if k else np.zeros(len(at), np.int64)

        before = lambda at: np.where(first_token[at], -1, at - 1)
        self.level = np.concatenate([np.repeat(np.arange(order, dtype=np.int8), [1, *sizes[: order - 1]]), np.arange(1, order, dtype=np.int8)])
        self.fail_to, count, kinds = np.zeros(n_states, whole), np.zeros(n_states), np.zeros(n_states, np.int8)
        for k in range(1, order):
            for own in parts(sizes[k - 1]):
                self.fail_to[int(offset[k - 1]) + own.start : int(offset[k - 1]) + own.stop] = state_at(k - 1, seen[k - 1].first[own])
            count[int(offset[k - 1]) : int(offset[k - 1]) + sizes[k - 1]] = counts[k - 1]
            self.fail_to[start_of[k]], count[start_of[k]] = start_of[k - 1], texts
            for own in parts(len(types[k])):
                kinds[state_at(k, before(seen[k].first[seen[k].begin[own]]))] = following_class(types[k][own])
        known = count > 0
        known[0] = True
        share = np.empty(n_states)
        for own in parts(n_states):
            share[own] = np.where(known[own], blend[self.level[own], power_of(count[own]), kinds[own]], 0.0)
        share[0] = 0.0
        del kinds
        self.fail = np.subtract(1, share)
        np.log10(self.fail, out=self.fail)

        def longest(state: np.ndarray) -> np.ndarray:
            """The longest history that training holds."""
            for _ in range(order - 1):
                state = np.where(known[state], state, self.fail_to[state])
            return state

        shift = np.cumsum([0, *sizes]).tolist()
        self.weight, self.to, self.counted = np.empty(n_arcs), np.empty(n_arcs, whole), np.ones(n_arcs, bool)
        p = np.empty(0)  # P(w | h) from shorter to longer h
        for k in range(order):
            lower, p = p, np.empty(sizes[k])
            for own in parts(sizes[k]):
                first, c, arcs = seen[k].first[own], counts[k][own], slice(shift[k] + own.start, shift[k] + own.stop)
                if k:
                    low, state = lower[seen[k - 1].of[first]], state_at(k, before(first))
                    p[own] = np.where(count[state] > 0, share[state] * c / np.maximum(count[state], 1) + (1 - share[state]) * low, low)
                    self.counted[arcs] = c > 0
                else:
                    p[own] = (c + base[0]) / base[1]
                self.weight[arcs] = np.log10(p[own])
                self.to[arcs] = longest(state_at(min(k + 1, order - 1), first))
        del lower, p, count, share
        self.arcs, self.tokens = np.empty(order * n_tokens, whole), n_tokens
        for k in range(order):
            np.add(seen[k].of, shift[k], out=self.arcs[k * n_tokens : (k + 1) * n_tokens])

    def step(self, state: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and weights of one token each, given by its place."""
        total, state = np.zeros(len(state)), state.copy()
        arc = self.arcs[np.multiply(self.level[state], self.tokens, dtype=np.int64) + at]
        left = np.flatnonzero(~self.counted[arc])
        while left.size:
            total[left] += self.fail[state[left]]
            state[left] = self.fail_to[state[left]]
            arc[left] = self.arcs[np.multiply(self.level[state[left]], self.tokens, dtype=np.int64) + at[left]]
            left = left[~self.counted[arc[left]]]
        return self.to[arc], total + self.weight[arc]

    def walk(self, starts: np.ndarray, lengths: np.ndarray, piece: int = PIECE) -> np.ndarray:
        """Weight of every text."""
        piece = max(piece, self.keep)
        pieces = -(-lengths // piece)
        text = np.repeat(np.arange(len(starts)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = starts[text] + nth * piece
        size = np.minimum(piece, lengths[text] - nth * piece)
        by = np.argsort(-size, kind="stable")
        text, at, size, nth = text[by], at[by], size[by], nth[by]
        state = np.where(nth == 0, self.start, 0)
        later = np.flatnonzero(nth > 0)
        for back in range(self.keep, 0, -1):
            state[later] = self.step(state[later], at[later] - back)[0]
        total = np.zeros(len(text))
        live = len(text) - np.searchsorted(size[::-1], np.arange(size.max(initial=0)), "right")
        for t, m in enumerate(live):
            state[:m], weight = self.step(state[:m], at[:m] + t)
            total[:m] += weight
        return np.bincount(text, total, len(starts))


def power_of(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(np.maximum(count, 1))).astype(np.int64), POWERS - 1)


#: What is added up of a history: words that follow it in training, and as L is learnt from, tokens after it in texts not
#: for tuning, tokens after it in tuning texts that those hold and that there are, and words that follow it in those.
SUMS = ("types", "before", "seen", "told", "left")


def _crowd_sums(answers: DataFrame, n: int) -> dict[str, np.ndarray]:
    """SUMS of the n crowds of one length of history, over all slots."""
    out = {c: np.zeros(n, np.int64) for c in SUMS}
    if n:
        each = answers.filter("block is null").select(F.explode("crowds").alias("c")).groupBy("c.crowd").agg(*(F.sum(f"c.{c}").alias(c) for c in SUMS)).toArrow()  # MOST_HOT rows at most
        for c in SUMS:
            out[c][each.column("crowd").to_numpy()] = each.column(c).to_numpy()
    return out


def _cells(sums: dict[str, np.ndarray]) -> list[tuple[int, int, int]]:
    """(cell, seen, told) of the histories that L is learnt from."""
    use = (sums["before"] > 0) & (sums["told"] > 0)
    cell = power_of(sums["before"][use]) * FOLLOWING + following_class(sums["left"][use])
    seen, told = (np.bincount(cell, sums[c][use], POWERS * FOLLOWING).astype(np.int64) for c in ("seen", "told"))
    return [(int(c), int(seen[c]), int(told[c])) for c in np.flatnonzero(told)]


def _learnt(answers: DataFrame, crowds: dict[str, np.ndarray]) -> np.ndarray:
    """L of one length of history, by power of two of its count and class of the number of words that follow it."""
    rows = answers.filter("block is null").select(F.explode("cells").alias("c")).groupBy("c.cell").agg(F.sum("c.seen").alias("seen"), F.sum("c.told").alias("told")).collect()  # POWERS * FOLLOWING rows at most
    seen, told = np.zeros(POWERS * FOLLOWING), np.zeros(POWERS * FOLLOWING)
    for cell, s, t in [*rows, *_cells(crowds)]:
        seen[cell] += s
        told[cell] += t
    share = np.where(told > 0, (seen + 0.5) / (told + 1), 0.5)
    share = share.reshape(POWERS, FOLLOWING)
    share[:, 0] = share.flat[np.flatnonzero(told).max(initial=0)]  # histories of hot words, if hot is given
    return share


def _gather(tokens: DataFrame, answers: list[DataFrame], tasks: int) -> DataFrame:
    """Every block's tokens with its answers, in order of slots."""
    given = reduce(DataFrame.unionByName, (a.filter("block is not null").select("block", F.lit(k).alias("length"), "slot", "counts", "types") for k, a in enumerate(answers)))
    packed = given.repartition(tasks, "block").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("length", "slot", "counts", "types"))).alias("a"))  # one block's answers: as large as the block
    own = tokens.select("block", "ids", "held", "words", "numbers", "lengths").repartition(tasks, "block")
    return own.join(packed, "block").select(*own.columns, F.col("a.length").alias("length"), F.col("a.counts").alias("counts"), F.col("a.types").alias("types"))


def _numbered(batches, block_bytes: int):
    """One row a block: ids, what is held out and for tuning, distinct words, each token's number among them, tokens of texts."""
    part, k = TaskContext.get().partitionId(), 0
    ids, held, tuning, texts, size, kind = [], [], [], [], 0, None

    def row():
        found = [np.array(tokens_of(t), np.uint64) for t in texts]
        lengths = np.array([len(f) + 1 for f in found], np.int64)
        flat = np.full(int(lengths.sum()), END, np.uint64)
        ends = np.cumsum(lengths)
        for f, e in zip(found, ends.tolist(), strict=True):
            flat[e - 1 - len(f) : e - 1] = f
        del found
        words, _, numbers = distinct(flat)
        name = f"{part}-{k}-{xxhash.xxh3_64_hexdigest(repr(ids))}"
        flags = [pa.array([x], pa.list_(pa.bool_())) for x in (held, tuning)]
        return pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([ids], pa.list_(kind)), *flags, pa.array([len(flat)]), *(pa.array([sum(x)]) for x in ([not h for h in held], [u and not h for h, u in zip(held, tuning, strict=True)])), pa.array([shared.pack_sorted(words)], pa.binary()), pa.array([shared.pack_counts(numbers)], pa.binary()), pa.array([shared.pack_counts(lengths)], pa.binary())],
            names=["block", "ids", "held", "tuning", "n", "texts", "tuned_texts", "words", "numbers", "lengths"],
        )

    for b in batches:
        kind = b.schema.field(0).type
        for i, h, u, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
            ids.append(i)
            held.append(h)
            tuning.append(u)
            texts.append(t)
            size += len(t or "")
            if size >= block_bytes:
                yield row()
                ids, held, tuning, texts, size, k = [], [], [], [], 0, k + 1
    if ids:
        yield row()
    shared.trim()


def _rows(batches):
    """Each block's arrays; for each token, whether it is learnt from and whether its text is for tuning."""
    for b in batches:
        for i in range(b.num_rows):
            row = {c: b.column(c)[i].as_py() for c in b.schema.names if c not in ("ids", "held", "tuning")}
            lengths = shared.unpack_counts(row["lengths"])
            row |= {"words": shared.unpack_sorted(row["words"]), "numbers": shared.unpack_counts(row["numbers"]).astype(np.int32), "lengths": lengths, "starts": np.cumsum(lengths) - lengths}
            if "tuning" in b.schema.names:
                held, tuning = (np.array(b.column(c)[i].as_py(), bool) for c in ("held", "tuning"))
                row |= {"learn": np.repeat(~held, lengths).astype(float), "tuned": np.repeat(tuning, lengths).astype(float)}
            else:
                row |= {c: b.column(c).slice(i, 1).flatten() for c in ("ids", "held")}
                for c in ("counts", "types"):
                    row[c] = [[x for x, n in zip(row[c], row["length"], strict=True) if n == k] for k in range(row["length"][-1] + 1)]
            yield row
            del row


def _joined(packed: list[bytes], narrow: bool = False) -> np.ndarray:
    return np.concatenate([shared.unpack_counts(x, narrow) for x in packed])


def _requests(block: str, length: int, keys: np.ndarray, counts: np.ndarray, tuned: np.ndarray, n: int):
    """A block's ascending keys and their training counts, cut into slots; a history isn't cut."""
    high, low = (56, 0) if length == 1 else (64 - WORD_BITS, WORD_BITS)
    edges = np.append(np.searchsorted(keys, np.array([(s << high) // n << low for s in range(n)], np.uint64)), len(keys))
    some = [s for s in range(n) if edges[s] < edges[s + 1]]
    cut = [(s, block, *(f(x[edges[s] : edges[s + 1]]) for f, x in ((shared.pack_sorted, keys), (shared.pack_counts, counts), (shared.pack_counts, tuned)))) for s in some]
    for at in range(0, len(cut), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cut[at : at + 64], strict=True), (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["slot", "block", "keys", "counts", "tuned"])


def _summed(rows: np.ndarray) -> np.ndarray:
    """Columns of one first number added up."""
    numbers, at = np.unique(rows[0], return_inverse=True)
    out = np.zeros((len(rows), len(numbers)), np.int64)
    out[0] = numbers
    for to, x in zip(out[1:], rows[1:], strict=True):
        np.add.at(to, at, x)
    return out


def _answer(table: pa.Table, length: int, limit: int, crowded: bool) -> pa.Table:
    """Corpus counts of every block's keys in one slot, and numbers of words that follow its histories.

    A row without block tells how many tokens and words that makes, which sequences are common, what L is learnt from, and
    the slot's part of SUMS for each crowd.  Blocks'
    keys are merged some at a time, so that a slot holds little more than its distinct keys.
    """
    column = lambda c, open_, *how: (open_(x.as_py(), *how) for x in table.column(c))
    found, sums_of, held = np.empty(0, np.uint64), [np.empty(0, np.uint8)] * 2, ([], [], [])  # keys, counts and those for tuning

    def merge():
        nonlocal found
        keys = np.concatenate([found, *held[0]])
        found = None
        held[0].clear()
        by = np.argsort(keys)
        keys = keys[by]
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        found = keys[begin]
        del keys
        for i in (0, 1):
            each = np.concatenate([sums_of[i], *held[i + 1]])[by]
            held[i + 1].clear()
            sums_of[i] = shared.narrowed(np.add.reduceat(each, begin, dtype=np.int64))

    size = 0
    for part in zip(column("keys", shared.unpack_sorted), column("counts", shared.unpack_counts, True), column("tuned", shared.unpack_counts, True), strict=True):
        for to, x in zip(held, part, strict=True):
            to.append(x)
        size += len(part[0])
        del part, x
        if size > max(1 << 19, len(found)):
            merge()
            size = 0
    merge()
    (total, apart), begin, cells, crowds = sums_of, groups(found), [], []
    types, hot = np.empty(len(begin), np.int64), found[total > limit].view(np.int64).tolist()
    both, of_crowds = np.zeros((2, POWERS * FOLLOWING), np.int64), []
    for own in parts(len(begin)):
        at = begin[own]
        here = slice(at[0], begin[own.stop] if own.stop < len(begin) else len(found))
        add = lambda x, at=at - at[0]: np.add.reduceat(x, at, dtype=np.int64)
        every, tuned = total[here].astype(np.int64), apart[here].astype(np.int64)
        types[own] = add(every > 0)
        if length > 1:
            rest = every - tuned
            sums = dict(zip(SUMS, (types[own], add(rest), add(np.where(rest > 0, tuned, 0)), add(tuned), add(rest > 0)), strict=True))
            single = scattered(found[at])
            for cell, *x in _cells({k: x[~single] for k, x in sums.items()}):
                both[:, cell] += x
            if crowded and single.any():
                of_crowds.append(_summed(np.stack([crowd_of(found[at[single]]), *(x[single] for x in sums.values())])))
    cells = [{"cell": int(c), "seen": int(both[0, c]), "told": int(both[1, c])} for c in np.flatnonzero(both[1])]
    if of_crowds:
        crowds = [dict(zip(("crowd", *SUMS), c, strict=True)) for c in _summed(np.concatenate(of_crowds, axis=1)).T.tolist()]
    counts, follow = [], []
    for keys in column("keys", shared.unpack_sorted):
        at = np.searchsorted(found, keys)
        counts.append(shared.pack_counts(total[at]))
        follow.append(shared.pack_counts(types[np.searchsorted(begin, at[groups(keys)], "right") - 1] if length > 1 else types[:0]))
    none = [None] * table.num_rows
    out = {
        "slot": (pa.int32(), [table.column("slot")[0].as_py()] * (len(none) + 1)),
        "block": (pa.string(), [*table.column("block").to_pylist(), None]),
        "counts": (pa.binary(), [*counts, None]),
        "types": (pa.binary(), [*follow, None]),
        "n": (pa.int64(), [*none, int(total.sum(dtype=np.int64))]),
        "v": (pa.int64(), [*none, int((total > 0).sum())]),
        "hot": (pa.list_(pa.int64()), [*none, hot]),
        "cells": (pa.list_(pa.struct([(c, pa.int64()) for c in ("cell", "seen", "told")])), [*none, cells]),
        "crowds": (pa.list_(pa.struct([(c, pa.int64()) for c in ("crowd", *SUMS)])), [*none, crowds]),
    }
    shared.trim()
    return pa.table({c: pa.array(x, t) for c, (t, x) in out.items()})
