"""An adaptive context-mixing range coder for token ids, in numpy over many lanes at once.

What has followed is counted in three contexts: after any id (order 0), after the one id before (order 1) and after the two ids before
(order 2). The three distributions of the next id are mixed into one, by shares that depend on how often the contexts of order 1 and 2
were seen and that follow how well each has foretold (expectation maximisation); the mixture drives a range coder of the kind that
works on numbers rather than intervals (rANS, the range variant of asymmetric numeral systems).

Such a coder lets an id's mass lie in several places. So the mass of each order is laid out on its own: every time that an id followed
the context has an equal part of it, equal ids side by side. The id at a place is found at once, without cumulating the mixture, and
an id's mass is the sum of its parts in the three orders: no order's part is lost and none is coded for.

The block is cut into lanes that are coded in step, each with a number of its own, under counts that all lanes share. Counts are exact
(contexts are compared, not only hashed) and are brought up to date after steps that lie further and further apart. The numbers of
order 0 are in a block's head, by classes. Every block starts afresh and has a checksum. Arithmetic is on integers, so any machine
decodes what another has coded.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Fixed values of the format.
MAGIC = b"TIDR"
_HEAD = struct.Struct("<4sIIIII")  # magic, ids, symbols, lanes, payload bytes, CRC-32 of the payload
#: Lanes at most, and ids of a lane at least.
LANES, STEPS = 4096, 1024
BLOCK_IDS = 1 << 22
#: The mass of a mixture, and the least number of a lane between steps: numbers have 64 bits and are written 32 bits at a time.
_MASS = 30
_LEAST = np.uint64(1 << 32)
#: Counts of a context in classes, for the shares: 0, 1, 2-3, 4-7 and so on.
_CLASSES = 14
#: Counts are brought up to date when there are so many times as many steps; more often while there are few ids, from which more is learnt.
_GROWTH, _GROWTH_OF_FEW, _FEW = 1.75, 1.25, 1 << 17
#: Every so many steps are looked at for the shares.
_LOOKED_AT = 4
#: How often an id was, from its class in a block's head: steps of about a fifth.
_COUNTS = [0, 1]
while _COUNTS[-1] < 1 << 33:
    _COUNTS.append(max(_COUNTS[-1] + 1, _COUNTS[-1] * 6 // 5))
_COUNTS = np.array(_COUNTS, np.int64)
_CLASS_OF = np.minimum(np.frexp(np.arange(1 << (_CLASSES - 1)))[1], _CLASSES - 1).astype(np.int32)
#: Buckets of a context with so many different followers, if they are few; else the power of two that is four to eight times as much.
_BUCKETS = np.array([0, 1, 1, 16, 16, 32, 32, 32, 32], np.int32)
_SPREAD = np.uint32(0x9E3779B1)


def classes_of(counts: np.ndarray) -> np.ndarray:
    """The class of frequency of each id (0 for those without a count)."""
    return np.searchsorted(_COUNTS, counts, side="right").astype(np.uint8) - np.uint8(1)


class Followers:
    """What followed the contexts of an order, sorted by context and id: each context's times, and the runs of equal ids among them.

    A context's runs are found by their ids in buckets of two places, of which each context has its own. What finds no place there is not found.
    """

    def __init__(self, keys: np.ndarray, width: np.uint64, times: np.ndarray, start: int):
        """Sorted keys end with the id in ``width`` bits; ``times`` has how many keys each context has, in order. Places are numbered from ``start``."""
        edge = np.empty(len(keys) + 1, bool)
        edge[:1] = edge[-1:] = True
        np.not_equal(keys[1:], keys[:-1], out=edge[1:-1])
        begin = np.flatnonzero(edge)
        self.begin = begin.astype(np.int32)
        self.n = n = len(begin) - 1
        ids = (keys.take(begin[:-1]) & keys.dtype.type((1 << int(width)) - 1)).astype(np.uint32)
        runs = np.zeros((n + 1, 4), np.int32)  # where a run begins, its length and its id; the last stands for those not found
        np.add(self.begin[:-1], start, out=runs[:-1, 0])
        np.subtract(self.begin[1:], self.begin[:-1], out=runs[:-1, 1])
        runs[:-1, 2], runs[-1, 2] = ids.view(np.int32), -1
        self.runs = runs.view(np.complex128).reshape(-1)
        # each context's different ids
        first = np.zeros(len(times) + 1, np.int64)
        np.cumsum(times, out=first[1:])
        before = np.zeros(len(keys) + 1, np.int32)
        np.cumsum(edge[:-1], out=before[1:])
        different = np.diff(before.take(first))
        # its buckets, a power of two; the first bucket of all is empty
        size = _BUCKETS.take(np.minimum(different, len(_BUCKETS) - 1))
        many = np.flatnonzero(different >= len(_BUCKETS))
        size[many] = 4 << np.frexp(different.take(many) - 1)[1].astype(np.int32)
        bucket = np.cumsum(size, dtype=np.int32)
        total = int(bucket[-1]) + 1
        bucket -= size - 1
        contexts = np.empty((len(times), 4), np.int32)
        np.add(first[:-1], start, out=contexts[:, 0], casting="unsafe")
        contexts[:, 1], contexts[:, 2], contexts[:, 3] = times, bucket * (size > 0), np.maximum(size - 1, 0)
        self.contexts = contexts.view(np.complex128).reshape(-1)
        self.bits, self.low = np.uint32(n.bit_length()), np.uint32((1 << n.bit_length()) - 1)
        places = np.full(2 * total, n, np.uint32)
        if n:
            hashes = ids * _SPREAD
            at = (hashes >> np.uint32(8)).view(np.int32)
            at &= np.repeat(contexts[:, 3], different)
            at += np.repeat(contexts[:, 2], different)
            at *= 2
            entry = np.arange(n, dtype=np.uint32)
            entry |= hashes << self.bits
            places[at] = entry
            left = np.flatnonzero(places.take(at) != entry)
            places[at.take(left) + 1] = entry.take(left)
        self.places = places.view(np.uint64)

    def find(self, bucket: np.ndarray, mask: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The run of each id (or n) after a context with these buckets; where it begins and its length."""
        hashes = ids * _SPREAD
        at = (hashes >> np.uint32(8)).view(np.int32)
        at &= mask
        at += bucket
        places = self.places.take(at).view(np.uint32)
        run = places[0::2]
        hashes <<= self.bits
        hashes ^= run
        run = np.where(hashes <= self.low, run, places[1::2])
        run &= self.low
        run = run.view(np.int32)
        here = self.runs.take(run).view(np.int32).reshape(-1, 4).T
        there = here[2] == ids.view(np.int32)
        np.copyto(run, self.n, where=~there)
        return run, here[0], here[1] * there


class Model:
    """What coder and decoder know alike: ids are numbers 0, 1, ... of the block's symbols, and ``none`` stands before a lane's first."""

    def __init__(self, classes: np.ndarray):
        self.symbols = np.flatnonzero(classes).astype(np.uint32)
        self.none = none = len(self.symbols)
        self.width = np.uint64(max(1, none.bit_length()))
        # so many different ids that two before and the next do not fit a key: order 0 alone
        self.contexts = 3 * int(self.width) <= 64
        self.pair_type = np.uint32 if 2 * int(self.width) <= 32 else np.uint64
        self.unit = max(20, none.bit_length() + 1)
        weights = _COUNTS[classes[self.symbols]]
        mass = 1 + weights * ((1 << self.unit) - none) // int(weights.sum())
        mass[int(np.argmax(mass))] += (1 << self.unit) - int(mass.sum())
        self.mass0 = np.stack([np.cumsum(mass) - mass, mass], 1).astype(np.int32).view(np.int64).reshape(-1)
        self.kept = np.uint16 if none < 1 << 16 else np.uint32
        self.id_at = np.repeat(np.arange(none, dtype=self.kept), mass)
        guess = np.arange(_CLASSES)
        one, two = np.minimum(guess * 2, 12)[:, None], np.minimum(guess * 3, 12)[None, :]
        self.won = np.zeros((3, _CLASSES, _CLASSES), np.int64)
        self.won[2] = 4 * np.broadcast_to(two, (_CLASSES, _CLASSES))
        self.won[1] = 4 * (16 - two) * one // 16
        self.won[0] = 64 - self.won[1] - self.won[2]
        self.pairs, self.triples = np.zeros(0, self.pair_type), np.zeros(0, np.uint64)
        self._count(np.zeros(0, self.pair_type))

    def _count(self, open_: np.ndarray) -> None:
        """New runs and shares; open_ has the pairs that nothing has followed yet, as their lanes go on."""
        edges = np.searchsorted(self.pairs, np.arange(self.none + 1).astype(self.pair_type) << self.pair_type(self.width))
        edges = np.append(edges, len(self.pairs))
        start = 1 << self.unit
        self.order1 = Followers(self.pairs, self.width, np.diff(edges), start)
        # a pair is a context of order 2; the last run is that of pairs which are not known
        begin = self.order1.begin
        times = np.append(np.diff(begin), np.int32(0))
        if len(open_):
            times -= np.bincount(np.searchsorted(self.pairs.take(begin[:-1]), open_), minlength=len(times)).astype(np.int32)
        self.order2 = Followers(self.triples, self.width, times, start + len(self.pairs))
        total = self.won.sum(0)
        least = 1 << self.unit
        share1, share2 = (((self.won[k] << _MASS - 10) // total * ((1 << _MASS) - least) >> _MASS - 10) for k in (1, 2))
        share1[0, :], share2[:, 0] = 0, 0
        self.share1, self.share2 = (x.astype(np.int32).reshape(-1) for x in (share1, share2))

    def places(self) -> np.ndarray:
        """The ids at the places of all three orders."""
        return np.concatenate([self.id_at, *((x & x.dtype.type((1 << int(self.width)) - 1)).astype(self.kept) for x in (self.pairs, self.triples))])

    def add(self, ids: np.ndarray) -> None:
        """The ids of some more steps, a row a step, with two rows before them."""
        if not self.contexts:
            return self._count(self.pairs)
        pairs = self.pair(ids[1:-1], ids[2:]).reshape(-1)
        pairs.sort()
        triples = self.triple(ids[:-2], ids[1:-1], ids[2:])
        # a lane's first id has no pair before it
        if not len(self.pairs):
            triples = triples[(ids[1:-1] != self.none)]
        triples = triples.reshape(-1)
        triples.sort()
        # two sorted parts, which a stable sort merges
        self.pairs, self.triples = np.concatenate([self.pairs, pairs]), np.concatenate([self.triples, triples])
        self.pairs.sort(kind="stable")
        self.triples.sort(kind="stable")
        self._count(self.pair(ids[-2], ids[-1]))

    def known(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
        """The runs of pairs."""
        _, _, bucket, mask = self.order1.contexts.take(one).view(np.int32).reshape(-1, 4).T
        return self.order1.find(bucket, mask, two)

    def credit(self, a0: np.ndarray, a1: np.ndarray, a2: np.ndarray, kind: np.ndarray) -> None:
        """How much of what the mixture gave to ids came from each order, by class."""
        self.won = self.won // 2 + 1
        own = a0 + a1 + a2
        for k, part in enumerate((a0, a1, a2)):
            self.won[k] += np.bincount(kind, part.astype(np.int64) * 64 // own, _CLASSES * _CLASSES).astype(np.int64).reshape(_CLASSES, _CLASSES)

    def pair(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return one.astype(self.pair_type) << self.pair_type(self.width) | two.astype(self.pair_type)

    def triple(self, one: np.ndarray, two: np.ndarray, three: np.ndarray) -> np.ndarray:
        key = one.astype(np.uint64)
        key <<= self.width
        key |= two
        key <<= self.width
        key |= three
        return key

    def layout(self, last: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the contexts ``last`` and its pair's run: both contexts, their class, what one time has of the mass in order 0, 1 and 2, and where the masses of order 1 and 0 begin."""
        one, two = (order.contexts.take(x).view(np.int32).reshape(-1, 4).T for order, x in ((self.order1, last), (self.order2, run)))
        n1, n2 = one[1], two[1]
        kind = _CLASS_OF.take(n1, mode="clip") * _CLASSES
        kind += _CLASS_OF.take(n2, mode="clip")
        each1, each2 = self.share1.take(kind), self.share2.take(kind)
        for each, n in ((each1, n1), (each2, n2)):
            np.floor_divide(each.view(np.uint32), np.maximum(n, 1).view(np.uint32), out=each.view(np.uint32))
        from1 = each2 * n2
        from0 = each1 * n1
        from0 += from1
        each0 = np.int32(1 << _MASS) - from0
        each0 >>= self.unit
        return one, two, kind, each0, each1, each2, from1, from0

    def parts(self, ids: np.ndarray, of: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """The runs of the ids' pairs; each id's mass in order 0, 1 and 2, and where it lies."""
        one, two, _, each0, each1, each2, from1, from0 = of
        run, at1, a1 = self.order1.find(one[2], one[3], ids)
        _, at2, a2 = self.order2.find(two[2], two[3], ids)
        a2 *= each2
        a1 *= each1
        at2 = at2 - two[0]
        at2 *= each2
        at1 = at1 - one[0]
        at1 *= each1
        at1 += from1
        mass0 = self.mass0.take(ids).view(np.int32)
        at0 = mass0[0::2] * each0
        at0 += from0
        a0 = mass0[1::2] * each0
        return run, a0, a1, a2, at0, at1, at2


def _updates(steps: int, lanes: int) -> list[int]:
    """Steps before which counts are brought up to date, and the last."""
    out = [steps]
    while out[-1] > 1:
        growth = _GROWTH if out[-1] * lanes > _FEW else _GROWTH_OF_FEW
        out.append(min(out[-1] - 1, int(out[-1] / growth)))
    return out[::-1]


def encode_block(ids: np.ndarray, symbols: int) -> bytes:
    """A block of 1 to 2**26 ids below ``symbols``, which is 2**28 at most."""
    n, ids = len(ids), np.asarray(ids)
    if n > 1 << 26:
        raise ValueError("too many ids for a block")
    classes = classes_of(np.bincount(ids, minlength=symbols))
    model = Model(classes)
    number = np.zeros(symbols, np.uint32)
    number[model.symbols] = np.arange(model.none, dtype=np.uint32)
    lanes = min(LANES, max(1, n // STEPS))
    steps = -(-n // lanes)
    counts = np.full(lanes, steps)
    counts[n - (steps - 1) * lanes :] -= 1
    # a row a step, after two rows of none; the last step may have fewer lanes
    rows = np.full((steps + 2, lanes), model.none, np.uint32)
    begin = np.cumsum(counts) - counts
    for lane, (a, m) in enumerate(zip(begin.tolist(), counts.tolist())):
        rows[2 : 2 + m, lane] = ids[a : a + m]
    full = rows[2 : steps + 1]
    full[...] = number[full]
    width = n - (steps - 1) * lanes
    rows[steps + 1, :width] = number[rows[steps + 1, :width]]
    own, past1, past2 = (np.empty((steps, lanes), np.uint32) for _ in range(3))
    place = np.empty((3, steps, lanes), np.uint32)
    done = 0
    for until in _updates(steps, lanes):
        seen = []
        for a in range(done, until, 64):
            _model_rows(model, rows, a, min(a + 64, until), width if until == steps else lanes, own, past1, past2, place, seen, done)
        if until < steps:
            model.credit(*(np.concatenate(x) for x in zip(*seen)))
            model.add(rows[done : until + 2])
        done = until
    state = np.full(lanes, _LEAST, np.uint64)
    words = []
    for k in range(steps - 1, -1, -1):
        m = width if k == steps - 1 else lanes
        now, f = state[:m], own[k, :m].astype(np.uint64)
        out = np.flatnonzero(now >> np.uint64(34) >= f)
        if len(out):
            top = now[out]
            words.append(top.astype(np.uint32)[::-1])
            now[out] = top >> np.uint64(32)
        quotient = now // f
        rest = (now - quotient * f).astype(np.uint32)
        in2, in1 = rest < past2[k, :m], rest < past1[k, :m]
        at = place[0, k, :m].copy()
        np.copyto(at, place[1, k, :m], where=in1)
        np.copyto(at, place[2, k, :m], where=in2)
        at += rest
        quotient <<= np.uint64(_MASS)
        quotient += at
        now[...] = quotient
    table = zlib.compress(classes.tobytes(), 6)
    stream = np.concatenate(words)[::-1] if words else np.zeros(0, np.uint32)
    payload = struct.pack("<I", len(table)) + table + state.astype("<u8").tobytes() + stream.astype("<u4").tobytes()
    return _HEAD.pack(MAGIC, n, symbols, lanes, len(payload), zlib.crc32(payload)) + payload


def _model_rows(model: Model, rows: np.ndarray, a: int, b: int, width: int, own, past1, past2, place, seen: list, done: int) -> None:
    """Masses and places of the ids of steps a to b."""
    two, one, ids = rows[a:b], rows[a + 1 : b + 1], rows[a + 2 : b + 2]
    if width < ids.shape[1] and b == len(rows) - 2:
        ids = np.where(ids == model.none, 0, ids)
    two, one, ids = two.reshape(-1), one.reshape(-1), ids.reshape(-1)
    lanes = rows.shape[1]
    run, _, _ = model.known(one, ids)
    before = np.concatenate([model.known(two[:lanes], one[:lanes])[0], run[:-lanes]])
    of = model.layout(one, before)
    _, a0, a1, a2, at0, at1, at2 = model.parts(ids, of)
    a1 += a2
    flat = slice(a * lanes, b * lanes)
    past2.reshape(-1)[flat], past1.reshape(-1)[flat], own.reshape(-1)[flat] = a2, a1, a1 + a0
    for k, at in enumerate((at0 - a1, at1 - a2, at2)):
        place[k].reshape(-1)[flat] = at
    looked = [k for k in range(a, b) if not (k - done) % _LOOKED_AT]
    pick = lambda x: x.reshape(b - a, lanes)[np.array(looked) - a].reshape(-1)
    if looked:
        seen.append((pick(a0), pick(a1 - a2), pick(a2), pick(of[2])))


def block_bytes(head: bytes) -> int:
    """Bytes of the payload that follows this head."""
    return _HEAD.unpack(head)[4]


HEAD_BYTES = _HEAD.size


def decode_block(head: bytes, payload: bytes) -> np.ndarray:
    """The ids of a block; a damaged one is a ValueError."""
    magic, n, symbols, lanes, size, check = _HEAD.unpack(head)
    if magic != MAGIC or len(payload) != size or zlib.crc32(payload) != check:
        raise ValueError("damaged block of ids")
    table = struct.unpack_from("<I", payload)[0]
    model = Model(np.frombuffer(zlib.decompress(payload[4 : 4 + table]), np.uint8))
    state = np.frombuffer(payload, "<u8", lanes, 4 + table).astype(np.uint64)
    words = np.frombuffer(payload, "<u4", offset=4 + table + 8 * lanes).astype(np.uint32)
    steps = -(-n // lanes)
    width = n - (steps - 1) * lanes
    rows = np.full((steps + 2, lanes), model.none, np.uint32)
    low = np.uint64((1 << _MASS) - 1)
    word = done = 0
    for until in _updates(steps, lanes):
        seen = []
        run = model.known(rows[done], rows[done + 1])[0]
        places = model.places()
        for k in range(done, until):
            m = width if k == steps - 1 else lanes
            of = model.layout(rows[k + 1, :m], run[:m])
            context1, context2, kind, each0, each1, each2, from1, from0 = of
            slot = (state[:m] & low).astype(np.int32)
            past1, past2 = slot < from0, slot < from1
            each, begin = np.where(past1, each1, each0), np.where(past1, context1[0], 0)
            at = slot - np.where(past1, from1, from0)
            np.copyto(each, each2, where=past2)
            np.copyto(begin, context2[0], where=past2)
            np.copyto(at, slot, where=past2)
            at = (at.view(np.uint32) // each.view(np.uint32)).view(np.int32)
            at += begin
            ids = rows[k + 2, :m]
            ids[...] = places.take(at)
            run, a0, a1, a2, at0, at1, at2 = model.parts(ids, of)
            if not (k - done) % _LOOKED_AT and until < steps:
                seen.append((a0.copy(), a1.copy(), a2, kind))
            # the place within what the id has in all
            at1 -= a2
            a1 += a2
            at0 -= a1
            a0 += a1
            np.copyto(at0, at1, where=past1)
            np.copyto(at0, at2, where=past2)
            slot -= at0
            now = state[:m]
            now >>= np.uint64(_MASS)
            now *= a0.view(np.uint32)
            now += slot.view(np.uint32)
            short = np.flatnonzero(now < _LEAST)
            now[short] = now[short] << np.uint64(32) | words[word : word + len(short)]
            word += len(short)
        if until < steps:
            model.credit(*(np.concatenate(x) for x in zip(*seen)))
            model.add(rows[done : until + 2])
        done = until
    rows = model.symbols.take(rows[2:], mode="clip")
    ids = np.empty(n, np.uint32)
    at = 0
    for lane in range(lanes):
        m = steps if lane < width else steps - 1
        ids[at : at + m] = rows[:m, lane]
        at += m
    return ids
