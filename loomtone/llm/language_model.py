"""A hierarchical Pitman-Yor language model of reports, seated by Gibbs sampling.

The root restaurant serves words, over a uniform base of all words and one unknown. Every word of the training part, and the start of a text, has a restaurant
of its own for the words that follow it; all share the root as parent, and after a word that training never saw the root speaks. Customers of a context
restaurant are the training tokens. Its tables are the customers of the root. There are these two levels; discount and strength are fixed, not sampled.

Seating is kept per dish (a word in a restaurant): its customers and its tables. A Gibbs step takes all customers of a dish away and seats them again, one
after the other, given everybody else: a new table with weight (strength + discount x tables) x parent probability, an old one with
(customers - discount x tables). The sum of weights along the way corrects the proposal (a Metropolis step). Dishes with many customers are seated in blocks of at
most 1/64 of those already there, at the weights of the block's start. Two simplifications: dishes of one sweep do not see each other, and a seating keeps
the weight it had in its own sweep. The root's dishes change customers with each sweep, so they are seated anew and corrected by one step.
The probability of a word is averaged over the last ``SAMPLES`` sweeps.

Words are told apart by 64-bit codes. Contexts are dealt once, whole, to slots of about ``BUCKET_WORDS`` tokens, so a restaurant's totals are local; contexts
of more than a quarter of a slot are cut by word over all slots, and their totals (at most four contexts a slot) are summed in Spark and sent along. Words are
dealt to slots of their own. A sweep is two Spark steps that exchange packed rows: word slots sum the tables of their words, seat the root and answer with its
customers and tables; context slots seat their dishes and send the tables on. Dishes of one customer have one table and take no part but in the sums.

Scoring deals the tokens of all texts to the context slots, packed as (context, word) pairs with the reports they stand in, and adds up per report. Only pairs that
stand twice or more, once of them in training, are looked up: any other pair has one customer if its report is of the training part, else none. A slot that one pair fills
gets several tasks for its tokens. A slot holds its dishes and one packed row of tokens at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtone.llm.blocks import BLANK_WORDS, LOWER, blocks, mix, word_hash, words
from loomtone.llm.shared import drop_shuffles, fold, forget, keep

#: Tokens that one slot of contexts holds, about.
BUCKET_WORDS = 3_000_000
#: Bytes of text that are cut into words at once, about.
TEXT_BYTES = 1 << 18
#: Tokens that a task packs at once, about.
PACKED_WORDS = 1_000_000
#: Bytes of packed rows in one batch, about.
BATCH_BYTES = 4 << 20
#: How steps are written: bodies are compressed already, and pages and row groups end by their size, not after a hundred rows of some megabytes each.
_WRITTEN = {"compression": "none", "parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1}
DISCOUNT = 0.75
STRENGTH = 1.0
BURN_IN, SAMPLES = 2, 3
_SEED = 11
#: Codes of what stands before the first and after the last word.
_START, _END = 1, 2


def seat(customers: np.ndarray, parent: np.ndarray, others: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Tables of each dish after seating its customers one after the other, and the log of the product of weight sums on the way.

    ``parent`` is the dish's probability at the parent, ``others`` the tables of the restaurant's other dishes.
    """
    tables = np.ones(len(customers), np.int64)
    weight = np.zeros(len(customers))
    dish = np.flatnonzero(customers > 1)
    c, p, o, t, w = customers[dish], parent[dish], others[dish], tables[dish], weight[dish]
    n = 1  # customers seated at each dish that is still open
    while len(dish):
        step = max(1, n >> 6)
        fresh = (STRENGTH + DISCOUNT * (o + t)) * p
        total = fresh + n - DISCOUNT * t
        if step == 1:
            t += _one_more(fresh / total, rng)
            w += np.log(total)
        else:
            block = np.minimum(step, c - n)
            t += rng.binomial(block, fresh / total)
            w += block * np.log(total)
        n += step
        open_ = c > n
        if not open_.all():
            full = ~open_
            tables[dish[full]], weight[dish[full]] = t[full], w[full]
            dish, c, p, o, t, w = (x[open_] for x in (dish, c, p, o, t, w))
    return tables, weight


def _one_more(chance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The draws of ``rng.binomial(1, chance)``, from the same random numbers, at a tenth of its time."""
    drawn = rng.random(len(chance))
    return np.where(chance > 0.5, drawn <= chance, drawn > 1 - chance)


def gibbs(customers: np.ndarray, tables: np.ndarray, weight: np.ndarray, parent: np.ndarray, total: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
    """One Gibbs step for every dish; ``total`` is the number of tables of its restaurant."""
    new, new_weight = seat(customers, parent, np.maximum(total - tables, 0), rng)
    take = np.log(rng.random(len(new))) < new_weight - weight
    return np.where(take, new, tables), np.where(take, new_weight, weight)


def predict(customers: np.ndarray, tables: np.ndarray, all_customers: np.ndarray, all_tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """The Pitman-Yor predictive probability of a dish."""
    return (np.maximum(customers - DISCOUNT * tables, 0) + (STRENGTH + DISCOUNT * all_tables) * parent) / (STRENGTH + all_customers)


def _tokens(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    text = LOWER[text]
    return (text, *words(text, at, BLANK_WORDS))


def _steps(column: pa.Array):
    """Of each block of texts: context code, word code and text number of every token, the ends included."""
    for first, stop, text, at in blocks(column, TEXT_BYTES):
        text, start, end, owner = _tokens(text, at)
        many = np.bincount(owner, minlength=stop - first) + 1
        who, word = np.repeat(np.arange(first, stop, dtype=np.int32), many), np.full(len(owner) + stop - first, _END)
        word[np.arange(len(owner)) + owner] = word_hash(text, start, end).view(np.int64)  # each text's end after its words
        context = np.empty_like(word)
        context[0], context[1:] = _START, np.where(who[1:] == who[:-1], word[:-1], _START)
        yield context, word, who


# Packed rows -------------------------------------------------------------------------------------------------------------------------

_ROW = "slot int, kind int, part bigint, body binary, x bigint, y bigint"
_NAMES = ["slot", "kind", "part", "body", "x", "y"]
#: What a packed row holds.
_PAIRS, _CONTEXTS, _SEATS, _ASKED, _SENT, _CUT, _WORDS, _ANSWER, _TOTALS, _SERVED, _TOKENS = range(11)
_TYPES = (np.int64, np.uint64, np.float64, np.int32, np.bool_)


def pack(*columns: np.ndarray) -> bytes:
    """Arrays as one compressed value, byte by byte of equal weight."""
    head = np.array([len(columns), *(x for c in columns for x in (_TYPES.index(c.dtype.type), len(c)))], np.int64)
    body = []
    for c in columns:
        held = np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize)
        body.append(np.empty(held.shape[::-1], np.uint8))
        for k in range(c.itemsize):  # one plain copy for each weight, which the transposed copy is not
            body[-1][k] = held[:, k]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *body]))


def unpack(value: bytes) -> list[np.ndarray]:
    held = np.frombuffer(zstandard.ZstdDecompressor().decompress(value), np.uint8)
    count = int(held[:8].view(np.int64)[0])
    shape = held[8: 8 + 16 * count].view(np.int64).reshape(count, 2)
    out, at = [], 8 + 16 * count
    for kind, length in shape.tolist():
        width = np.dtype(_TYPES[kind]).itemsize
        column = np.empty((length, width), np.uint8)
        for k in range(width):
            column[:, k] = held[at + k * length: at + (k + 1) * length]
        out.append(column.view(_TYPES[kind]).ravel())
        at += width * length
    return out


def _gaps(ordered: np.ndarray) -> np.ndarray:
    """Rising codes as differences, which take less space."""
    out = ordered.view(np.uint64).copy()
    out[1:] -= ordered.view(np.uint64)[:-1]
    return out


def _rising(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps, dtype=np.uint64).view(np.int64)


def _new(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    change = np.zeros(max(len(keys[0]) - 1, 0), bool)
    for key in keys:
        change |= key[1:] != key[:-1]
    return np.flatnonzero(np.append(True, change)) if len(keys[0]) else np.empty(0, np.int64)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, at, dtype=np.int64) if len(at) else np.empty(0, np.int64)


def _order(values: np.ndarray) -> np.ndarray:
    """The stable order of integers by one plain sort, many times faster than one of places: last bits make way for the place."""
    places = np.arange(len(values))
    bits = len(values).bit_length()
    if len(values) and values.min() >= 0 and int(values.max()) >> (63 - bits) == 0:
        return np.sort(values.astype(np.int64) << bits | places) & ((1 << bits) - 1)
    order = np.sort(values >> bits << bits | places) & ((1 << bits) - 1)
    ordered = values[order]
    # codes that agree in all bits that are left stand in the order of their places
    return order if (ordered[1:] >= ordered[:-1]).all() else np.argsort(values, kind="stable")


def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order and the place of each value in them."""
    order = _order(values)
    ordered = values[order]
    at = _new(ordered)
    place = np.empty(len(values), np.int64)
    place[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(values))))
    return ordered[at], place


def _coded(u: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """Pairs in order as contexts with run lengths and a list of words with places in it."""
    at = _new(u)
    own, place = _ranked(w)
    return [_gaps(u[at]), np.diff(np.append(at, len(u))), _gaps(own), place.astype(np.int32)]


def _rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Packed rows in batches of about ``BATCH_BYTES``, since a batch stands whole on both sides of the way to Spark."""
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    held, size = [], 0
    for k, row in enumerate(rows):
        held.append(row)
        size += len(row[3] or b"")
        if size >= BATCH_BYTES or k == len(rows) - 1:
            yield pa.RecordBatch.from_arrays([pa.array([r[c] if c < len(r) else None for r in held], t) for c, t in enumerate(types)], names=_NAMES)
            held, size = [], 0


def _slots(batches) -> Iterator[tuple[int, dict[int, list[tuple[int, bytes]]]]]:
    """``(slot, kind -> (part, body) of its rows)`` of rows in the order of their slots."""
    now, held = None, {}
    for batch in batches:
        for slot, kind, part, body in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if slot != now:
                if held:
                    yield now, held
                now, held = slot, {}
            held.setdefault(kind, []).append((part, body))
    if held:
        yield now, held


def _word_slot(w: np.ndarray, slots: int) -> np.ndarray:
    return (mix(w.view(np.uint64) + np.uint64(0x51)) % np.uint64(slots)).astype(np.int64)


def _context_slot(u: np.ndarray, w: np.ndarray, slots: int, cut: np.ndarray) -> np.ndarray:
    """The slot of each pair's context; the contexts ``cut`` are dealt by word."""
    code = mix(u.view(np.uint64))
    hot = _find(cut, u)[1]
    code[hot] = mix(code[hot] ^ mix(w[hot].view(np.uint64)))
    return (code % np.uint64(slots)).astype(np.int64)


def _find(ordered: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each sought value in ``ordered`` and whether it is there."""
    if not len(ordered):
        return np.zeros(len(sought), np.int64), np.zeros(len(sought), bool)
    at = np.minimum(np.searchsorted(ordered, sought), len(ordered) - 1)
    return at, ordered[at] == sought


def _by_word_slot(w: np.ndarray, slots: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of rising words by slot, and ``(slot, first, stop)`` of each in that order."""
    slot = _word_slot(w, slots)
    order = _order(slot)
    at = _new(slot[order])
    return order, list(zip(slot[order][at].tolist(), at.tolist(), np.append(at[1:], len(w)).tolist()))


# Steps -------------------------------------------------------------------------------------------------------------------------------


def _word_counts(batches):
    """Words with their number in the training part and in all texts, combined within a batch."""
    for batch in batches:
        train = batch.column(1).to_numpy(zero_copy_only=False)
        for _, word, who in _gathered(batch.column(0)):
            order = _order(word)
            word, learnt = word[order], train[who][order].astype(np.int64)
            at = _new(word)
            yield pa.RecordBatch.from_arrays([pa.array(word[at]), pa.array(_sums(learnt, at)), pa.array(np.diff(np.append(at, len(word))))], names=["w", "c", "a"])


def _gathered(column: pa.Array):
    """``_steps`` of several blocks at once; a small rest goes with the last."""
    parts, held, done = [], 0, 0
    for part in _steps(column):
        parts.append(part)
        held += len(part[0])
        done += len(part[0])
        rows = int(part[2][-1]) + 1
        if held >= PACKED_WORDS and done * (len(column) - rows) >= rows * PACKED_WORDS / 2:
            whole, parts, held = [np.concatenate(c) for c in zip(*parts)], [], 0
            del part
            yield whole
    if parts:
        yield [np.concatenate(c) for c in zip(*parts)]


def _side_by_side(slot: np.ndarray, u: np.ndarray, w: np.ndarray, slots: int) -> np.ndarray:
    """An order by slot in which equal pairs stand together: one sort of a number of slot, leading bits of both codes, and place.

    Pairs that agree in these bits may alternate, and then make more runs than one. The slot tells most contexts apart, so its bits count as theirs.
    """
    of_slot, of_place = (slots - 1).bit_length(), len(u).bit_length()
    left = 64 - of_place
    of_w = min(left * 3 // 7, left - of_slot)
    of_u = left - of_slot - of_w
    code = slot.astype(np.uint64)
    for codes, bits in ((u, of_u), (w, of_w)):
        if bits:
            code = code << np.uint64(bits) | codes.view(np.uint64) >> np.uint64(64 - bits)
    code = code << np.uint64(of_place) | np.arange(len(u), dtype=np.uint64)
    return (np.sort(code) & np.uint64((1 << of_place) - 1)).astype(np.int64)


def _dealt(column: pa.Array, slots: int, cut: np.ndarray):
    """Of gathered blocks: slot, context, word and text number of all tokens, pairs side by side."""
    for tokens in _gathered(column):
        slot = _context_slot(*tokens[:2], slots, cut)
        order = _side_by_side(slot, *tokens[:2], slots)
        for k, column_ in enumerate(tokens):  # one after the other, so that never all are held twice
            tokens[k] = column_[order]
        yield slot[order], *tokens


def _deal_counts(slots: int, cut: np.ndarray):
    """Pairs with their customers and their tokens in other texts, packed by slot."""

    def run(batches):
        for batch in batches:
            train = batch.column(1).to_numpy(zero_copy_only=False)
            for slot, u, w, who in _dealt(batch.column(0), slots, cut):
                at = _new(slot, u, w)
                n, every = _sums(train[who], at).astype(np.int32), np.diff(np.append(at, len(u))).astype(np.int32)
                slot, u, w = slot[at], u[at], w[at]
                edge = _new(slot)
                yield from _rows([(int(slot[i]), _PAIRS, 0, pack(*_coded(u[i:j], w[i:j]), n[i:j], every[i:j])) for i, j in zip(edge, np.append(edge[1:], len(slot)))])

    return run


def _deal_tokens(slots: int, cut: np.ndarray, wide: dict[int, int]):
    """Pairs with the reports of their tokens, packed by slot; ``part`` is the task's share of a wide slot, ``x`` the home of these reports.

    Reports go by their place in the home; the first packed row of a home has the keys and the numbers of tokens of all.
    """

    def run(batches):
        turn = TaskContext.get().partitionId()
        home = turn << 32
        for batch in batches:
            train, rows = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            for slot, u, w, who in _dealt(batch.column(0), slots, cut):
                turn += 1
                home += 1
                at = _new(slot, u, w)
                count = np.diff(np.append(at, len(u)))
                edge = _new(slot[at])
                lowest, out = who.min(), []
                keys, sizes = rows[lowest: who.max() + 1], np.bincount(who - lowest)
                for i, j in zip(edge, np.append(edge[1:], len(at))):
                    own, place = _ranked(who[at[i]: at[j] if j < len(at) else len(who)])
                    here = int(slot[at[i]])
                    out.append((here, _TOKENS, turn % wide.get(here, 1), pack(
                        *_coded(u[at[i:j]], w[at[i:j]]), count[i:j], place.astype(np.int32), np.diff(own, prepend=lowest), train[own], keys, sizes), home))
                    keys, sizes = keys[:0], sizes[:0]
                yield from _rows(out)

    return run


def _pairs(body: bytes) -> list[np.ndarray]:
    u, runs, own, place, *more = unpack(body)
    return [np.repeat(_rising(u), runs), _rising(own)[place], *more]


def _merged(bodies: list[bytes]) -> tuple[np.ndarray, ...]:
    """Packed rows of pairs as one: all words, contexts and words of the pairs in order, and their added numbers."""
    parts = [unpack(body) for body in bodies]
    codes, ranks = [], []
    for k in (0, 2):  # a code is ranked once for each row that names it
        own, rank = _ranked(np.concatenate([_rising(p[k]) for p in parts]))
        codes.append(own)
        ranks.append(np.split(rank, np.cumsum([len(p[k]) for p in parts])[:-1]))
    wide = len(codes[1])
    pair = np.empty(sum(len(p[3]) for p in parts), np.int64)
    done = 0
    for p, u, w in zip(parts, *ranks):
        pair[done: done + len(p[3])] = np.repeat(u, p[1]) * wide + w[p[3]]
        done += len(p[3])
    n, every = (np.concatenate([p[k] for p in parts]) for k in (4, 5))
    del parts, ranks
    order = _order(pair)
    pair = pair[order]
    at = _new(pair)
    n, every = _sums(n[order], at), _sums(every[order], at)
    u, w = np.divmod(pair[at], wide)
    return codes[1], codes[0][u], codes[1][w], n, every


def _count(word_slots: int, cut: np.ndarray):
    """Of a slot's pairs: those to look up, its restaurants, its first seating, and what its words' slots are told and asked."""

    def run(batches):
        for slot, held in _slots(batches):
            asked, u, w, n, every = _merged([body for _, body in held.pop(_PAIRS)])
            out, tokens = [], int(every.sum())
            order, parts = _by_word_slot(asked, word_slots)
            out += [(v, _ASKED, slot, pack(_gaps(asked[order[i:j]]))) for v, i, j in parts]
            known = (n > 0) & (every > 1)
            out.append((slot, _PAIRS, 0, pack(*_coded(u[known], w[known]), n[known]), tokens))
            several = int((n > 1).sum())
            learnt = n > 0
            u, w, n = u[learnt], w[learnt], n[learnt]
            at = _new(u)
            single, one = (n == 1).astype(np.int64), np.ones(len(n), np.int64)
            restaurants = u[at], _sums(n, at), _sums(single, at)
            out.append((slot, _CONTEXTS, 0, pack(_gaps(restaurants[0]), *restaurants[1:])))
            out.append((slot, _SEATS, 0, pack(np.ones(several, np.int64), np.full(several, -np.inf), np.zeros(several, np.int64))))
            hot = _find(cut, restaurants[0])[1]
            out += [(slot, _CUT, a, None, b, c) for a, b, c in zip(restaurants[0][hot].tolist(), restaurants[1][hot].tolist(), _sums(one, at)[hot].tolist())]
            order = _order(w)
            at = _new(w[order])
            w, c, s, d = w[order][at], _sums(n[order], at), _sums(single[order], at), _sums((one - single)[order], at)
            order, parts = _by_word_slot(w, word_slots)
            out += [(v, _SENT, slot, pack(_gaps(w[k]), c[k], s[k], d[k])) for v, i, j in parts for k in (order[i:j],)]
            yield from _rows(out)

    return run


def _serve(sweep: int, uniform: float, total: float, kept: bool):
    """The root's dishes of a slot of words seated for their customers of this sweep, given ``total`` tables of the sweep before; context slots get answers."""

    def run(batches):
        for slot, held in _slots(batches):
            told = [[_rising(g), *more] for g, *more in (unpack(body) for _, body in sorted(held.get(_SENT, [])))]
            senders = [part for part, _ in sorted(held.get(_SENT, []))]
            if sweep == 0:
                w, place = _ranked(np.concatenate([t[0] for t in told]) if told else np.empty(0, np.int64))
                c, s, far = (_added(place, [t[k] for t in told], len(w)) for k in (1, 2, 3))
                before, keeps = np.zeros(len(w), np.int64), []
                asks = [t[0][t[3] > 0] for t in told]
            elif _WORDS in held:
                gaps, c, s, before, *keeps = unpack(held[_WORDS][0][1])
                w, asks = _rising(gaps), [t[0] for t in told]
                far = _added(np.searchsorted(w, np.concatenate(asks)) if asks else np.empty(0, np.int64), [t[1] for t in told], len(w))
            else:
                w, asks = np.empty(0, np.int64), []
                c, s, far, before, keeps = w, w, w, w, [w] * 2 * (SAMPLES - 1)
            customers, tables = s + far, np.minimum(c, 1)
            several = np.flatnonzero(c > 1)
            rng = np.random.default_rng([_SEED, sweep, 1, slot])
            flat, whole = np.full(len(several), uniform), np.full(len(several), total)
            t, weight = seat(customers[several], flat, np.maximum(whole - before[several], 0), rng)
            tables[several] = gibbs(customers[several], t, weight, flat, whole, rng)[0]
            keeps = [*keeps, customers, tables] if kept else keeps
            out = [(slot, _TOTALS, 0, None, int(customers.sum()), int(tables.sum()))]
            if _ASKED in held:
                for part, body in held[_ASKED]:
                    sought = _rising(unpack(body)[0])
                    at, there = _find(w, sought)
                    give = [np.where(there, x[at], 0) if len(x) else np.zeros(len(sought), np.int64) for x in (c, *keeps)]
                    out.append((part, _SERVED, slot, pack(_gaps(sought), *give)))
            else:
                out.append((slot, _WORDS, 0, pack(_gaps(w), c, s, tables, *keeps)))
                for part, sought in zip(senders, asks):
                    at = np.searchsorted(w, sought)
                    out.append((part, _ANSWER, slot, pack(customers[at], tables[at])))
            yield from _rows(out)

    return run


def _added(place: np.ndarray, parts: list[np.ndarray], size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    if parts:
        np.add.at(out, place, np.concatenate(parts))
    return out


def _context_totals(u: np.ndarray, several: np.ndarray, restaurants: np.ndarray, single: np.ndarray, tables: np.ndarray, cut: dict[int, int]) -> np.ndarray:
    """Tables of each restaurant of a slot, of cut contexts over all slots."""
    out = single + np.bincount(np.searchsorted(restaurants, u[several]), tables, len(restaurants)).astype(np.int64)
    hot = np.array(sorted(cut), np.int64)
    at, there = _find(hot, restaurants)
    out[there] = np.array([cut[x] for x in hot.tolist()], np.int64)[at[there]] if len(hot) else 0
    return out


def _seat_slot(sweep: int, word_slots: int, root: tuple[int, int], uniform: float, cut: dict[int, int], kept: bool):
    """One Gibbs step for the dishes of a slot, given the root's answers."""

    def run(batches):
        for slot, held in _slots(batches):
            u, w, n = _pairs(held[_PAIRS][0][1])
            gaps, _, single = unpack(held[_CONTEXTS][0][1])
            restaurants = _rising(gaps)
            tables, weight, total, *keeps = unpack(held[_SEATS][0][1])
            several = np.flatnonzero(n > 1)
            served = _context_totals(u, several, restaurants, single, tables, cut)
            if kept:
                total, keeps = total + tables, [*keeps, served]
            own, place = _ranked(w[several])
            order, parts = _by_word_slot(own, word_slots)
            parent = np.empty(len(own))
            if len(own):
                answers = [unpack(body) for _, body in sorted(held[_ANSWER])]
                customers, at_root = (np.concatenate(c) for c in zip(*answers))
                parent[order] = predict(customers, at_root, *root, np.full(len(own), uniform))
            rng = np.random.default_rng([_SEED, sweep, 0, slot])
            at = np.searchsorted(restaurants, u[several])
            tables, weight = gibbs(n[several], tables, weight, parent[place], served[at].astype(np.float64), rng)
            out = [(slot, _SEATS, 0, pack(tables, weight, total, *keeps))]
            sent = np.bincount(place, tables, len(own)).astype(np.int64)
            out += [(v, _SENT, slot, pack(_gaps(own[order[i:j]]), sent[order[i:j]])) for v, i, j in parts]
            here = single + np.bincount(at, tables, len(restaurants)).astype(np.int64)
            hot = _find(np.array(sorted(cut), np.int64), restaurants)[1]
            out += [(slot, _CUT, a, None, 0, b) for a, b in zip(restaurants[hot].tolist(), here[hot].tolist())]
            yield from _rows(out)

    return run


class _Slot:
    """What a slot of contexts knows in the end, and the scores of its pairs."""

    def __init__(self, held, tokens: int, kinds: int, uniform: float, roots: list[tuple[int, int]], cuts: list[dict[int, int]], learnt: dict[int, int]):
        u, runs, w, place, self.n = unpack(held[_PAIRS][0][1])
        u, w = _rising(u), _rising(w)
        gaps, customers, single = unpack(held[_CONTEXTS][0][1])
        restaurants = _rising(gaps)
        tables, _, total, *served = unpack(held[_SEATS][0][1])
        several = np.flatnonzero(self.n > 1)
        served = [*served, _context_totals(np.repeat(u, runs), several, restaurants, single, tables, cuts[-1])]
        self.tables = np.full(len(place), SAMPLES, np.int64)
        self.tables[several] = total + tables
        # a cut context may have no customer in this slot
        hot = np.array(sorted(learnt), np.int64)
        extra = hot[~_find(restaurants, hot)[1]]
        order = np.argsort(np.concatenate([restaurants, extra]), kind="stable")
        self.contexts = np.concatenate([restaurants, extra])[order]
        self.served = [np.concatenate([t, np.array([cut.get(x, 0) for x in extra.tolist()], np.int64)])[order] for t, cut in zip(served, cuts)]
        self.customers = np.concatenate([customers, np.zeros(len(extra), np.int64)])[order]
        at, there = _find(self.contexts, hot)
        self.customers[at[there]] = np.array([learnt[x] for x in hot.tolist()], np.int64)[there] if len(hot) else 0
        parts = []
        for _, body in held.pop(_SERVED):
            sought, c, *values = unpack(body)
            parts.append([_rising(sought), np.log10((c + 1) / (tokens + kinds + 1)), c > 0, *(
                predict(values[2 * k], values[2 * k + 1], *root, uniform) for k, root in enumerate(roots))])
        columns = [np.concatenate(x) for x in zip(*parts)]
        order = _order(columns[0])
        self.words, self.base, self.known, *self.root = (x[order] for x in columns)
        self.keys = np.repeat(np.searchsorted(self.contexts, u) * len(self.words), runs) + np.searchsorted(self.words, w)[place]

    def score(self, body: bytes) -> bytes:
        """Sums of a packed row of tokens by report, packed."""
        u, runs, own, place, count, row, places, train, keys, sizes = unpack(body)
        context, there = _find(self.contexts, _rising(u))
        word = np.searchsorted(self.words, _rising(own))
        first = np.cumsum(count) - count
        key = np.repeat(np.where(there, context * len(self.words), -len(self.words)), runs) + word[place]  # below 0 where there is no such context
        at, found = _find(self.keys, key)
        alone = train[row[first]].astype(np.int64)
        n = np.where(found, self.n[at], alone) if len(self.n) else alone
        tables = np.where(found, self.tables[at] / SAMPLES, alone) if len(self.n) else alone
        if len(self.contexts):
            customers, served = np.where(there, self.customers[context], 0), [np.where(there, t[context], 0) for t in self.served]
        else:
            customers, served = np.zeros(len(u)), [np.zeros(len(u))] * SAMPLES
        # the sum of the sweeps' predictive probabilities: customers less discounted tables are linear in the tables
        backed = sum(np.repeat(STRENGTH + DISCOUNT * t, runs) * p[word][place] for t, p in zip(served, self.root)) / SAMPLES
        gain = np.log10((np.maximum(n - DISCOUNT * tables, 0) + backed) / np.repeat(STRENGTH + customers, runs))

        def per(values):
            return np.bincount(row, np.repeat(values, count), len(places))

        return pack(places, per(self.known[word][place]).astype(np.int64), per(self.base[word][place]), per(gain), keys, sizes)


def _score(*given):
    """Sums by report of the tokens of a slot: what it knows comes first, then its tokens, one packed row at a time. One packed row goes to the reports' home."""

    def run(batches):
        now, held, knows = None, {}, None
        for batch in batches:
            for k in range(len(batch)):
                slot, kind, part, body, home = (batch.column(c)[k].as_py() for c in range(5))
                if slot != now:
                    now, held, knows = slot, {}, None
                if kind != _TOKENS:
                    held.setdefault(kind, []).append((part, body))
                    continue
                if knows is None:
                    knows, held = _Slot(held, *given), {}
                yield pa.RecordBatch.from_arrays([pa.array([home], pa.int64()), pa.array([knows.score(body)], pa.binary())], names=["home", "body"])

    return run


def _added_up(batches):
    """One row per report: what all slots have sent to its home."""

    def rows(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        place = np.concatenate([np.cumsum(p[0]) for p in parts])
        *values, keys, sizes = (np.concatenate(c) for c in list(zip(*parts))[1:])
        sums = [np.bincount(place, v, len(keys)).astype(v.dtype) for v in values]
        # whole reports are dealt, so each has one end here
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (keys, np.ones(len(keys), np.int64), sizes, *sums)], names=["row", "ends", "n_tokens", "n_known", "base", "gain"])

    now, held = None, []
    for batch in batches:
        for home, body in zip(batch.column(0).to_pylist(), batch.column(1)):
            if home != now and held:
                yield rows(held)
                held = []
            now = home
            held.append(unpack(body.as_py()))
    if held:
        yield rows(held)


def score_reports(loops: DataFrame, id_column: str = "file_id", text_column: str = "report", bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per row of ``loops``.

    Learns from ids whose ``fold`` of 7 is not 2; the others are ``held_out``. Tokens are lower-cased (A-Z) runs without blanks, then one end.
    ``base_score`` sums log10((count + 1) / (N + V + 1)) over the tokens, ``n_known`` counts those seen in training, ``train_tokens`` is N. ``score`` is the model's
    log10 probability of the text. A null or empty text is the end alone. Rows that repeat are reports of their own; a null id counts as the empty
    text in its fold. Without training reports nothing is known and every token has probability 1. Further columns are not looked at.
    """
    rows = loops.select(id_column, F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("_lt_text"))
    rows = rows.withColumns({"_lt_train": fold(id_column, 7) != 2, "_lt_row": F.xxhash64(F.col(id_column).cast("string"), "_lt_text")})
    texts = rows.select("_lt_text", "_lt_train", "_lt_row")
    by_word = keep(texts.drop("_lt_row").mapInArrow(_word_counts, "w bigint, c bigint, a bigint").groupBy("w").agg(F.sum("c").alias("c"), F.sum("a").alias("a")), "lm-words")
    tokens, every, kinds, singles, distinct = (int(x or 0) for x in by_word.agg(
        F.sum("c"), F.sum("a"), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1), F.count("*")).first())
    uniform = 1 / (kinds + 1)
    slots, word_slots = max(1, -(-every // bucket_words)), max(1, -(-4 * distinct // bucket_words))
    # each token but the last of a text is the context of one, and each text begins once
    hot = {_START if w == _END else w: c for w, c in by_word.where(F.col("a") > bucket_words / 4).select("w", "c").collect()}
    cut = np.array(sorted(hot), np.int64)

    def step(table: DataFrame, count: int, work) -> DataFrame:
        dealt = table.repartitionById(count, F.col("slot")).sortWithinPartitions("slot", "kind", "part")
        return keep(dealt.mapInArrow(work, _ROW), "lm-step", "kind", **_WRITTEN)

    def of(table: DataFrame, *kinds_: int) -> DataFrame:
        return table.where(F.col("kind").isin(*kinds_)).select(*_NAMES)

    def cuts_of(table: DataFrame) -> dict[int, int]:
        got = of(table, _CUT).groupBy("part").agg(F.sum("y").alias("y")).collect() if hot else []
        return {x: 0 for x in hot} | {r.part: r.y for r in got}

    first = step(texts.drop("_lt_row").mapInArrow(_deal_counts(slots, cut), _ROW), slots, _count(word_slots, cut))
    sent, words_, root, roots, cuts = first, None, (0, kinds), [], []
    for k in range(BURN_IN + SAMPLES + 1):
        kept, last = k > BURN_IN, k == BURN_IN + SAMPLES
        at_words = of(sent, _SENT)
        if k:
            at_words = at_words.unionByName(of(words_, _WORDS))
        if last:
            at_words = at_words.unionByName(of(first, _ASKED))
        before, words_ = words_, step(at_words, word_slots, _serve(k, uniform, float(root[1]), kept))
        root = tuple(int(x or 0) for x in of(words_, _TOTALS).agg(F.sum("x"), F.sum("y")).first())
        tables = cuts_of(sent)
        if kept:
            roots.append(root)
            cuts.append(tables)
        if before is not None:
            forget(before)
        if last:
            # the scores need no messages: tables and shuffles of the sweeps make room for the tokens
            forget(first, f"kind={_ASKED}", f"kind={_SENT}")
            forget(sent, f"kind={_SENT}")
            drop_shuffles(loops.sparkSession)
            break
        at_slots = of(first, _PAIRS, _CONTEXTS).unionByName(of(sent, _SEATS)).unionByName(of(words_, _ANSWER))
        before, sent = sent, step(at_slots, slots, _seat_slot(k, word_slots, root, uniform, tables, kept))
        if before is not first:
            forget(before)
    # a slot that a few pairs fill has several tasks, each with all it knows
    shares = of(first, _PAIRS).where(F.col("x") > 2 * bucket_words).select("slot", F.ceil(F.col("x") / bucket_words).cast("int").alias("shares"))
    wide = {r.slot: r.shares for r in shares.collect()}
    known = of(first, _PAIRS, _CONTEXTS).unionByName(of(sent, _SEATS)).unionByName(of(words_, _SERVED)).join(F.broadcast(shares), "slot", "left").withColumn(
        "share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))).select(*_NAMES, "share")
    packed = texts.mapInArrow(_deal_tokens(slots, cut, wide), _ROW).withColumn("share", F.col("part").cast("int"))
    spread = max(slots, -(-every // bucket_words) + sum(wide.values()))
    # some partitions stay empty, so that few have several slots
    added = known.unionByName(packed).repartition(4 * spread, "slot", "share").sortWithinPartitions("share", "slot", "kind").select("slot", "kind", "part", "body", "x").mapInArrow(
        _score(tokens, kinds, uniform, roots, cuts, hot), "home bigint, body binary")
    added = added.repartition(spread, "home").sortWithinPartitions("home").mapInArrow(
        _added_up, "row bigint, ends bigint, n_tokens bigint, n_known bigint, base double, gain double")
    # reports that agree in id and text share a row key: what they add together is dealt out evenly
    added = added.groupBy(F.col("row").alias("_lt_row")).agg(
        F.sum("ends").alias("copies"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("gain").alias("score"))
    counts = [(F.col(c) / F.col("copies")).cast("bigint").alias(c) for c in ("n_tokens", "n_known")]
    return rows.select(id_column, "_lt_row", "_lt_train").join(added, "_lt_row").select(
        id_column, (~F.col("_lt_train")).alias("held_out"), *counts, F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base_score") / F.col("copies")).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"))
