"""Language-model scores from a weighted backoff automaton.

The model is an n-gram model with Dirichlet smoothing: p(w | h) = (c(hw) + m p(w | h')) /
(c(h) + m), where h' is h without its first word and the lowest order is the add-half
unigram. Its seen histories are states. A seen n-gram is an arc from its history's state to
the state of the longest history that it ends in, with its smoothed weight; every other word
takes the failure arc, of weight m / (c(h) + m), to the state of h'. A text is traversed once
from left to right: the state is carried from token to token and the weights are summed. A
state depends on the last words only, so a long text is traversed in pieces, each of which
first reads the words before it, and all pieces of a block advance together.

Neither the model nor the text is ever in one place. Texts are dealt into blocks of bounded
size by a hash. Each block sends its distinct n-grams, with their training counts, to the
parts of the model, which add the counts up and answer each block with the totals of what
it asked for; so a block builds the automaton of just the n-grams that its texts can reach.
Words and pairs of words go first, and the parts also say which pairs several blocks have. A
longer n-gram is sent only if other blocks have both shorter ones in it: if one of these is
the block's alone, so is the longer one, and its own count is the total.
Blocks, parts and everything shuffled grow with the input.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NONSPACE, chunks, fold, hashed_words, parts_for, text_bytes, total_bytes

ORDER = 3
PRIOR = 100.0  # m, in tokens
BLOCK_BYTES = 6 << 20
PIECE = 128  # tokens that are traversed as one
_END = np.uint64(0x45D9F3B3335B369D)
_START = np.uint64(0x119DE1F3A5C7B1E9)


def _ascending(keys: np.ndarray) -> np.ndarray:
    """The order of unsigned keys. Keys with their place in the low bits are sorted, which is faster than argsort."""
    bits = max(len(keys), 1).bit_length()
    drop = max(0, int(keys.max(initial=0)).bit_length() + bits - 64)  # low bits that have no room
    placed = ((keys >> np.uint64(drop)) << np.uint64(bits)) | np.arange(len(keys), dtype=np.uint64)
    placed.sort()
    order = (placed & np.uint64((1 << bits) - 1)).astype(np.int64)
    found = keys[order]
    return order if (found[1:] >= found[:-1]).all() else np.argsort(keys, kind="stable")


def _firsts(ascending: np.ndarray) -> np.ndarray:
    """Where a value stands that differs from the one before it."""
    out = np.ones(len(ascending), bool)
    np.not_equal(ascending[1:], ascending[:-1], out=out[1:])
    return out


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in ascending order, and each key's index among them."""
    order = _ascending(keys)
    found = keys[order]
    first = _firsts(found)
    index = np.empty(len(keys), np.int64)
    index[order] = np.cumsum(first) - 1
    return found[first], index


class _Block:
    """The tokens of a block's documents, and the n-grams that end at them."""

    def __init__(self, table):
        self.train = table.column("train").to_numpy(zero_copy_only=False)
        data, offsets = text_bytes(table.column("text"))
        words, counts = [], []
        for _, _, d, o in chunks(data, offsets):
            h, b = hashed_words(d, o, NONSPACE)
            words.append(h)
            counts.append(np.diff(b))
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        ends = np.cumsum(n + 1) - 1
        self.tokens = np.empty(int((n + 1).sum()), np.uint64)
        self.is_end = np.zeros(len(self.tokens), bool)
        self.is_end[ends] = True
        self.tokens[self.is_end] = _END
        self.tokens[~self.is_end] = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.first = np.concatenate(([0], ends[:-1] + 1)).astype(np.int64) if len(n) else np.zeros(0, np.int64)
        self.sizes = n + 1
        self.owner = np.repeat(np.arange(len(n)), n + 1)
        self.weight = self.train[self.owner].astype(float)

    def keys(self, k: int) -> np.ndarray:
        """The key of the k-gram that ends at each token; before a text stand start marks."""
        key = np.full(len(self.tokens), np.uint64(k))
        begin = self.first[self.owner]
        for j in range(k - 1, -1, -1):
            at = np.arange(len(self.tokens)) - j
            key = fold(key, np.where(at >= begin, self.tokens[np.maximum(at, 0)], _START))
        return key

    def counted(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of the k-grams and their training counts."""
        key = self.keys(k)
        learned = np.sort(key[self.weight > 0])
        key.sort()
        distinct, begin = key[_firsts(key)], np.flatnonzero(_firsts(learned))
        counts = np.zeros(len(distinct), np.int64)
        counts[np.searchsorted(distinct, learned[begin])] = np.diff(begin, append=len(learned))
        return distinct, counts

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys of the k-grams, each token's index among them, and their training counts."""
        distinct, index = _distinct(self.keys(k))
        return distinct, index, np.bincount(index, self.weight, len(distinct)).astype(np.int64)

    def before(self, values: np.ndarray, start: int) -> np.ndarray:
        """Each token's value of the token before it; `start` for a text's first."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first] = start
        return out

    def shared(self, shorter: np.ndarray, has: np.ndarray, longer: np.ndarray, n: int) -> np.ndarray:
        """Which of n longer n-grams other blocks may have: those of whose shorter ones they have both. Each token's
        shorter and longer n-gram are given as indices."""
        elsewhere = has[shorter]
        both = elsewhere & self.before(elsewhere, True)
        out = np.zeros(n, bool)
        out[longer[both]] = True
        return out


class _Automaton:
    """States, arcs and failure arcs over a block's n-grams. State 0 is the empty history; the ends of texts lead nowhere."""

    def __init__(self, block: _Block, levels: list, totals: list[np.ndarray], tokens: int, distinct: int, prior: float):
        order = len(levels)
        ends = levels[0][1][block.is_end]
        texts = int(totals[0][ends[0]]) if len(ends) else 0  # training texts
        self.words = len(levels[0][0])
        # the states of a text's start, and of the seen n-grams of each level
        seen = [t > 0 for t in totals[: order - 1]]
        self.start, states = [0, *range(1, order)], order
        at_level = []
        for known in seen:
            ids = np.zeros(len(known), np.int64)
            ids[known] = states + np.arange(known.sum())
            states += int(known.sum())
            at_level.append(ids)
        self.failure, count = np.zeros(states, np.int64), np.full(states, texts, np.int64)
        self.failure[1:order] = np.arange(order - 1)
        suffix = [np.zeros(0, np.int64)]
        for k in range(1, order):
            inside = np.empty(len(levels[k][0]), np.int64)
            inside[levels[k][1]] = levels[k - 1][1]
            suffix.append(inside)
        for k, known in enumerate(seen):
            own = at_level[k][known]
            count[own] = totals[k][known]
            if k:
                self.failure[own] = at_level[k - 1][suffix[k][known]]
        self.backoff = np.log10(prior / (count + prior))
        self.backoff[0] = 0.0
        p = [(totals[0] + 0.5) / (tokens + 0.5 * (distinct + 1))]
        self.root = np.log10(p[0])
        is_end = np.zeros(self.words, bool)
        is_end[ends] = True
        self.root_next = np.where(is_end, 0, at_level[0]) if order > 1 else np.zeros(self.words, np.int64)
        keys, weights, targets = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        for k in range(1, order):
            history = np.empty(len(levels[k][0]), np.int64)
            history[levels[k][1]] = block.before(at_level[k - 1][levels[k - 1][1]], self.start[k])
            word = np.empty(len(levels[k][0]), np.int64)
            word[levels[k][1]] = levels[0][1]
            p.append((totals[k] + prior * p[k - 1][suffix[k]]) / (count[history] + prior))
            arc = np.flatnonzero(totals[k] > 0)
            keys.append(history[arc] * self.words + word[arc])
            weights.append(np.log10(p[k][arc]))
            to = at_level[k][arc] if k < order - 1 else at_level[k - 1][suffix[k][arc]]
            targets.append(np.where(is_end[word[arc]], 0, to))
        keys = np.concatenate(keys)
        by_key = _ascending(keys.view(np.uint64))
        self.arcs = np.bincount(keys // max(self.words, 1), minlength=states)
        self.first = np.cumsum(self.arcs) - self.arcs
        self.keys = np.append(keys[by_key], np.iinfo(np.int64).max)
        self.weights, self.targets = np.concatenate(weights)[by_key], np.concatenate(targets)[by_key]
        self.order = order

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log10 weights of the words in the states, by arcs and failure arcs, and the states after them."""
        out, after, at = np.zeros(len(state)), np.empty(len(state), np.int64), state.copy()
        open_ = np.arange(len(state))
        while len(open_):
            here = at[open_]
            key = here * self.words + word[open_]
            place = self.first[here]  # most states have one arc
            more = np.flatnonzero((self.keys[place] != key) & (self.arcs[here] > 1))
            place[more] = np.searchsorted(self.keys, key[more])
            found = (self.keys[place] == key) & (here > 0)
            hit = open_[found]
            out[hit] += self.weights[place[found]]
            after[hit] = self.targets[place[found]]
            open_ = open_[~found]
            done = at[open_] == 0
            root = open_[done]
            out[root] += self.root[word[root]]
            after[root] = self.root_next[word[root]]
            open_ = open_[~done]
            out[open_] += self.backoff[at[open_]]
            at[open_] = self.failure[at[open_]]
        return out, after

    def traverse(self, block: _Block, word: np.ndarray) -> np.ndarray:
        """The log10 probability of every document."""
        pieces = -(-block.sizes // PIECE)
        doc = np.repeat(np.arange(len(pieces)), pieces)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        warm = np.where(number > 0, min(self.order - 1, PIECE), 0)  # words that only lead to the state
        begin = block.first[doc] + number * PIECE - warm
        size = np.minimum(PIECE, block.sizes[doc] - number * PIECE) + warm
        order = np.argsort(-size, kind="stable")
        doc, number, warm, begin, size = doc[order], number[order], warm[order], begin[order], size[order]
        state = np.where(number > 0, 0, self.start[-1])
        score = np.zeros(len(doc))
        for j in range(int(size.max()) if len(size) else 0):
            n = int(np.searchsorted(-size, -j, "left"))  # pieces of more than j tokens
            weight, state[:n] = self.step(state[:n], word[begin[:n] + j])
            score[:n] += np.where(warm[:n] <= j, weight, 0.0)
        return np.bincount(doc, score, len(block.sizes))


def _squeezed(plane: np.ndarray) -> bytes:
    """Bytes of few different values by their Huffman codes, and the codes' length in eight bytes before them."""
    z = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    out = z.compress(np.ascontiguousarray(plane)) + z.flush()
    return np.int64(len(out)).tobytes() + out


def _stretched(data: bytes, at: int) -> tuple[np.ndarray, int]:
    end = at + 8 + int(np.frombuffer(data, "<i8", 1, at)[0])
    return np.frombuffer(zlib.decompress(data[at + 8 : end], -15), np.uint8), end


def _pack(counts: np.ndarray) -> bytes:
    """Counts in a byte each, larger ones in eight after them."""
    return _squeezed(np.minimum(counts, 255).astype(np.uint8)) + counts[counts >= 255].astype("<i8").tobytes()


def _unpack(data: bytes, at: int = 0) -> np.ndarray:
    small, at = _stretched(data, at)
    out = small.astype(np.int64)
    large = np.flatnonzero(out == 255)
    out[large] = np.frombuffer(data, "<i8", len(large), at)
    return out


_FIVE = np.uint64(40)


def _steps(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences: the five lower bytes of each, the sixth ones, and larger ones whole."""
    step = np.diff(keys, prepend=np.uint64(0))
    high = np.minimum(step >> _FIVE, np.uint64(255)).astype(np.uint8)
    return step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes() + _squeezed(high) + step[high == 255].astype("<u8").tobytes()


def _keys(data: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    step = np.zeros((n, 8), np.uint8)
    step[:, :5] = np.frombuffer(data, np.uint8, 5 * n, at).reshape(n, 5)
    high, at = _stretched(data, at + 5 * n)
    step = step.view("<u8")[:, 0] | (high.astype(np.uint64) << _FIVE)
    big = np.flatnonzero(high == 255)
    step[big] = np.frombuffer(data[at : at + 8 * len(big)], "<u8")
    return np.cumsum(step, dtype=np.uint64), at + 8 * len(big)


def _bounds(distinct: np.ndarray, parts: int) -> np.ndarray:
    """Where the sorted keys of each part begin; parts are equal ranges of keys."""
    part = ((distinct >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    return np.searchsorted(part, np.arange(parts + 1))


def score_texts(docs: DataFrame, train, order: int = ORDER, prior: float = PRIOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    `train` is the condition for rows to learn from (null counts as true). A null or empty
    text is one end token; a text is never cut, and one larger than a block is a block of its
    own size; repeated rows count each and score alike; without training rows every word is
    unknown; an empty table gives an empty one; other columns aren't read. Scores are log10.
    """
    spark = docs.sparkSession
    blocks = parts_for(spark, total_bytes(docs), block_bytes)
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = docs.select("doc_id", "text", F.coalesce(train, F.lit(True)).alias("train"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block")).repartition(blocks, "block")

    def message(table, asked: dict) -> pa.Table:
        """A row for each part: for every level its keys and counts."""
        block = table.column("block")[0].as_py()
        bounds = {k: _bounds(keys, blocks) for k, (keys, _) in asked.items()}
        rows = []
        for p in range(blocks):
            body = [np.int64(len(asked)).tobytes()]
            for k, (keys, counts) in asked.items():
                a, b = bounds[k][p], bounds[k][p + 1]
                keys_, counts_ = _steps(keys[a:b]), _pack(counts[a:b])
                body += [np.array([k, b - a, len(counts_)], "<i8").tobytes(), keys_, counts_]
            rows.append(b"".join(body))
        return pa.table({"part": pa.array(range(blocks), pa.int64()), "block": pa.array([block] * blocks, pa.int64()), "data": pa.array(rows, pa.binary())})

    def answer(table):
        """The totals of every level to each block that asked; from pairs of words on, twice the total, and one more for a key that several blocks have."""
        asked: dict[int, list] = {}
        for x in table.column("data").to_pylist():
            at = 8
            for _ in range(int(np.frombuffer(x, "<i8", 1)[0])):
                level, n, width = np.frombuffer(x, "<i8", 3, at).tolist()
                keys, at = _keys(x, n, at + 24)
                asked.setdefault(level, []).append((keys, _unpack(x, at)))
                at += width
        out = []
        for level, some in asked.items():
            distinct, index = _distinct(np.concatenate([k for k, _ in some]))
            total = np.bincount(index, np.concatenate([c for _, c in some]), len(distinct)).astype(np.int64)
            head, value = b"", total
            if level == 1:
                head = np.array([total.sum(), (total > 0).sum()], "<i8").tobytes()
            else:
                value = 2 * total + (np.bincount(index, minlength=len(distinct)) > 1)
            ends = np.cumsum([len(k) for k, _ in some])
            replies = [head + _pack(value[index[e - len(k) : e]]) for e, (k, _) in zip(ends.tolist(), some, strict=True)]
            out.append(pa.table({"block": table.column("block"), "part": table.column("part"), "level": pa.array([level] * len(replies), pa.int32()), "data": pa.array(replies, pa.binary())}))
        return pa.concat_tables(out)

    def told_values(told, level: int, distinct: np.ndarray, sent: np.ndarray | None = None):
        """What the parts tell of a level's keys, -1 where nothing was sent; of words, all training tokens and distinct ones too."""
        out = np.full(len(distinct), -1, np.int64)
        place = np.arange(len(distinct)) if sent is None else np.flatnonzero(sent)
        bounds, tokens, words = _bounds(distinct[place], blocks), 0, 0
        rows = told.filter(pc.equal(told.column("level"), level))
        for p, data in zip(rows.column("part").to_pylist(), rows.column("data").to_pylist(), strict=True):
            if level == 1:
                n, v = np.frombuffer(data, "<i8", 2).tolist()
                tokens, words, data = tokens + n, words + v, data[16:]
            mine = place[bounds[p] : bounds[p + 1]]
            out[mine] = _unpack(data)
        return out, tokens, words

    def ask(table):
        block = _Block(table)
        return message(table, {k: block.counted(k) for k in range(1, min(order, 2) + 1)})

    def longer_levels(block, told, upto: int):
        """The grams of the levels from two to `upto`, their totals (of the last, if it was answered), and which of the last are sent."""
        levels, totals, sent, has = [], [], None, None
        for k in range(2, upto + 1):
            gram = block.grams(k)
            if k > 2:
                sent = block.shared(levels[-1][1], has, gram[1], len(gram[0]))
            value, _, _ = told_values(told, k, gram[0], sent)
            levels.append(gram)
            totals.append(np.where(value < 0, gram[2], value >> 1))
            has = (value > 0) & (value & 1 == 1)
        return levels, totals, sent

    def ask_longer(k: int):
        def run(texts, told):
            levels, _, sent = longer_levels(_Block(texts), told, k)
            return message(texts, {k: (levels[-1][0][sent], levels[-1][2][sent])})

        return run

    def score(texts, told):
        block = _Block(texts)
        words = block.grams(1)
        total, tokens, distinct = told_values(told, 1, words[0])
        levels, totals, _ = longer_levels(block, told, order)
        levels, totals = [words, *levels], [total, *totals]
        automaton = _Automaton(block, levels, totals, tokens, distinct, prior)
        base, known = automaton.root[words[1]], (total > 0)[words[1]]
        sums = [np.add.reduceat(x, block.first) for x in (known.astype(np.int64), base)]
        return pa.table(
            {
                "doc_id": texts.column("doc_id"), "held_out": pa.array(~block.train), "n_tokens": block.sizes, "n_known": sums[0],
                "train_tokens": np.full(len(block.first), tokens), "base_score": sums[1], "score": automaton.traverse(block, words[1]),
            }
        )

    by_part = lambda sent: sent.repartition(blocks, "part").groupBy("part")
    sent, reply = "part long, block long, data binary", "block long, part long, level int, data binary"
    answers = [by_part(dealt.groupBy("block").applyInArrow(ask, sent)).applyInArrow(answer, reply).repartition(blocks, "block")]
    so_far = lambda: reduce(DataFrame.union, answers).groupBy("block")
    for k in range(3, order + 1):
        answers.append(by_part(dealt.groupBy("block").cogroup(so_far()).applyInArrow(ask_longer(k), sent)).applyInArrow(answer, reply).repartition(blocks, "block"))
    result = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(so_far()).applyInArrow(score, result)


def op3_language_model(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 5 != 1)


