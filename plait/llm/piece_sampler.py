"""Operator 1: SentencePiece encoding and decoding with Gumbel top-k sampling.

A text's segmentations into pieces are the paths of a lattice whose states are
the places between characters. A piece's log probability falls with its rank in
the vocabulary (Zipf: 1 / (rank + 10)) over a temperature; a character that no
piece covers is spelled in bytes. The k best segmentations under Gumbel noise
are a sample without replacement, found by a perturbed A* search:

- A node is a set of paths: those that follow a found path up to a place and
  leave it there by another piece than the ones excluded. Its exact mass is
  known from backward sums, and the maximum of its paths' perturbed scores is a
  Gumbel variable at log mass, truncated by the bound of the node it came from.
  These maxima are the search's bounds, and they are exact, so the best node
  popped holds the next best path.
- A popped node is opened by walking its best path forward from the backward
  sums; the places along it give the new nodes.

Each sampled path has its log probability, its perturbed score and its
inclusion probability 1 - exp(-exp(log p - kappa)), kappa the (k+1)th score.
All noise is a hash of the row's key, the path and the place, so a row's sample
depends on its key, text and parameters alone, whatever the batch or partition.

Batches of texts are walked at once: lattices are built for the distinct
stretches between spaces by numpy (no piece runs across one) and kept over the
batches of a task, up to a bound; every step of every stretch, and every node
of every text, is one vector operation. A place whose mass lies so far below
another's that no noise can lift it (the noise is bounded) is not looked at.
Memory is bounded by the batch, the kept lattices and one text. The model is
read by the driver and sent as bytes.

Defined edge cases: a null text has no rows; an empty text has one row without
pieces; a text with fewer than k segmentations has a row for each; repeated
rows of one key each get the same rows; a null key counts as 0; extra columns
are not read. Decoding gives back every text exactly: a text's own U+2581 is
spelled in bytes, as that character in a piece means a space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plait.llm.common import release, slices, table
from plait.llm.textvec import U, mix

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_STRETCH = re.compile(r" *[^ \n]+| +|\n")
_K = [U(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03)]


def _stretches(text: str) -> list[str]:
    """What _STRETCH finds in a text behind a first space. Where no two spaces adjoin, each
    begins a stretch and line ends stand alone, so the text is split without the pattern."""
    if not text:
        return []
    text = " " + text
    if "  " in text or "\0" in text:
        return _STRETCH.findall(text)
    return list(filter(None, text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")))


#: Characters of the lattices that a task keeps, and of a batch of texts.
_KEPT = 300_000
_BATCH = 1 << 17
#: Uniforms are at least 2**-54 and at most 1 - 2**-53, so two Gumbel variables differ by less than this.
_SPREAD = 41.0


#: Keys are found by their first 16 bits, then one by one.
_SHIFT = U(48)


def _find(keys: np.ndarray, slots: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of h are among the sorted keys, and where those are."""
    slot = (h >> _SHIFT).astype(np.int64)
    at, stop = slots[slot], slots[slot + 1]
    open_ = np.flatnonzero(at < stop)
    hit = np.zeros(len(h), bool)
    while len(open_):
        same = keys[at[open_]] == h[open_]
        hit[open_[same]] = True
        open_ = open_[~same]
        at[open_] += 1
        open_ = open_[at[open_] < stop[open_]]
    return np.flatnonzero(hit), at


def _hash_chars(chars: np.ndarray) -> np.ndarray:
    return mix(chars.astype(U) * _K[0] + U(1))


def _spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + count[0] - 1, then those of the next, as one array."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


class Pieces:
    """The vocabulary of a SentencePiece model, by hash of its pieces."""

    def __init__(self, proto: bytes, temperature: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.text: list[bytes] = []
        self.byte = np.full(256, -1, np.int32)
        kept: dict[str, int] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
                self.text.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.text.append(b"")
            else:
                kept[piece.replace(SPACE, " ")] = i
                self.text.append(piece.replace(SPACE, " ").encode())
        if (self.byte < 0).any():
            raise ValueError("the model has no byte pieces to spell unknown characters")
        if any("\n" in p or " " in p.lstrip(" ") for p in kept):
            raise ValueError("pieces that run across spaces are not supported")
        if max(map(len, kept)) > 62:
            raise ValueError("pieces of more than 62 characters are not supported")
        self.blob = np.frombuffer(b"".join(self.text), np.uint8)
        self.width = np.fromiter(map(len, self.text), np.int64, len(self.text))
        self.at = np.cumsum(self.width) - self.width
        order = np.argsort([-sp.get_score(i) for i in kept.values()], kind="stable")
        ids, names = np.fromiter(kept.values(), np.int64, len(kept)), list(kept)
        logit = np.empty(len(kept))
        logit[order] = -np.log(np.arange(len(kept)) + 10.0)
        total = np.log(np.exp(logit).sum() + 256.0 / (len(kept) + 10.0))
        logit = (logit - total) / temperature
        self.byte_logit = (-np.log(len(kept) + 10.0) - total) / temperature
        # pieces, and all their beginnings, as sorted hashes by length
        known: list[dict[int, tuple[int, float]]] = []
        for p, i, x in zip(names, ids, logit, strict=True):
            h = None
            codes = _hash_chars(np.frombuffer(p.encode("utf-32-le"), np.uint32)).reshape(-1, 1)
            for n, c in enumerate(codes):
                h = mix(h * _K[1] + c) if n else mix(c)
                if len(known) <= n:
                    known.append({})
                known[n].setdefault(int(h[0]), (-1, 0.0))
            known[len(codes) - 1][int(h[0])] = (int(i), float(x))
        self.levels = []
        for level in known:
            keys = np.array(sorted(level), U)
            slots = np.searchsorted(keys >> _SHIFT, np.arange((1 << 16) + 1, dtype=U)).astype(np.int32)
            self.levels.append((keys, slots, np.array([level[int(k)][0] for k in keys], np.int32), np.array([level[int(k)][1] for k in keys])))

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that pieces spell, laid end to end."""
        return self.blob[_spans(self.at[ids], self.width[ids])]

    def decode(self, ids) -> str:
        """The text of a segmentation; the first space is the one that encoding put there."""
        raw = self.bytes_of(np.asarray(ids, np.int64)).tobytes()
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


class Lattice:
    """Lattices of stretches, laid end to end; state s is before character s.
    Of state s, first[s] is the first edge; of an edge: length, id (or -1 - a
    character to spell in bytes), logp (within its state), cdf (likewise)."""

    def __init__(self, stretches: list[str], pieces: Pieces):
        chars = np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, stretches), np.int64, len(stretches))
        self.begin = np.concatenate([[0], np.cumsum(size)])
        n = len(chars)
        stop = np.repeat(self.begin[1:], size)
        code = _hash_chars(chars)
        at, h = np.arange(n), mix(code)
        starts, lengths, ids, logits = [], [], [], []
        single = np.zeros(n, bool)
        for level, (keys, slots, key_ids, key_logits) in enumerate(pieces.levels):
            ok, spot = _find(keys, slots, h)
            at, h, spot = at[ok], h[ok], spot[ok]
            found = key_ids[spot]
            full = found >= 0
            starts.append(at[full])
            lengths.append(np.full(len(starts[-1]), level + 1))
            ids.append(found[full])
            logits.append(key_logits[spot[full]])
            if not level:
                single[at[full]] = True
            ok = at + level + 1 < stop[at]
            at, h = at[ok], h[ok]
            if not len(at):
                break
            h = mix(h * _K[1] + code[at + level + 1])
        bare = np.flatnonzero(~single)
        n_bytes = 1 + (chars[bare] > 0x7F) + (chars[bare] > 0x7FF) + (chars[bare] > 0xFFFF)
        starts.append(bare)
        lengths.append(np.ones(len(bare), np.int64))
        ids.append(-1 - chars[bare].astype(np.int32))
        logits.append(n_bytes * pieces.byte_logit)
        # by state, and of a state the longest first: mostly the likeliest, so a walk finds its edge at once
        count = sum((np.bincount(x, minlength=n) for x in starts), np.zeros(n, np.int64))
        self.first = np.concatenate([[0], np.cumsum(count)])
        spot, total = self.first[:-1].copy(), int(self.first[-1])
        length, self.id, logit = np.empty(total, np.int64), np.empty(total, np.int32), np.empty(total)
        for x, a, b, c in zip(starts[::-1], lengths[::-1], ids[::-1], logits[::-1], strict=True):
            e = spot[x]
            length[e], self.id[e], logit[e] = a, b, c
            spot[x] += 1
        # backward sums, by distance from the end of the stretch; state n and all ends have 0
        start = np.repeat(np.arange(n), count)
        to = start + length
        beta = np.zeros(n + 1)
        ends = to == stop[start] if n else np.zeros(0, bool)
        left = stop - np.arange(n)
        by = np.argsort(left, kind="stable")
        cut = np.searchsorted(left[by], np.arange(1, (left.max() if n else 0) + 2))
        k_by = count[by]
        edge = np.concatenate([[0], np.cumsum(k_by)])
        e_by = _spans(self.first[by], k_by)
        logit_by, ends_by, to_by = logit[e_by], ends[e_by], to[e_by]
        for r in range(len(cut) - 1):
            a, b = cut[r], cut[r + 1]
            if a == b:
                continue
            i = slice(edge[a], edge[b])
            v = logit_by[i] + np.where(ends_by[i], 0.0, beta[to_by[i]])
            at = edge[a:b] - edge[a]
            top = np.maximum.reduceat(v, at)
            beta[by[a:b]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, k_by[a:b])), at))
        onward = np.where(ends, 0.0, beta[to]) if n else logit
        self.logp = np.minimum(logit + onward - beta[start], 0.0) if n else logit
        self.logp[self.first[:-1][count == 1]] = 0.0
        prob = np.exp(self.logp)
        run = np.cumsum(prob)
        self.cdf = run - np.repeat(run[self.first[:-1]] - prob[self.first[:-1]], count) if n else prob
        self.cdf[self.first[1:] - 1] = 2.0  # nothing lies beyond a state's last edge
        self.length = length.astype(np.int32)
        self._room: dict[str, np.ndarray] = {}

    def add(self, other: Lattice) -> None:
        """Lay other's stretches behind the own."""
        for name, shift in (("begin", self.begin[-1]), ("first", self.first[-1]), ("length", None), ("id", None), ("logp", None), ("cdf", None)):
            mine, more = getattr(self, name), getattr(other, name)
            more = more if shift is None else more[1:] + shift
            n, room = len(mine), self._room.get(name, mine)
            if len(room) < n + len(more):
                room = self._room[name] = np.empty((n + len(more)) * 5 // 4, mine.dtype)
                room[:n] = mine
            room[n : n + len(more)] = more
            setattr(self, name, room[: n + len(more)])

    def take(self, which: np.ndarray) -> Lattice:
        """The lattice of some of the stretches alone."""
        got = Lattice.__new__(Lattice)
        size = self.begin[which + 1] - self.begin[which]
        state = _spans(self.begin[which], size)
        count = self.first[state + 1] - self.first[state]
        edge = _spans(self.first[state], count)
        got.begin, got.first = (np.concatenate([[0], np.cumsum(x)]) for x in (size, count))
        got.length, got.id, got.logp, got.cdf = (x[edge] for x in (self.length, self.id, self.logp, self.cdf))
        got._room = {}
        return got

    def walk(self, state: np.ndarray, stop: np.ndarray, place: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From states to stops: (row, place, edge) of every step, row by row.
        place: of the state in its text; noise: key of the row's uniforms."""
        row = np.flatnonzero(state < stop)
        s, stop, place, noise = state[row], stop[row], place[row], noise[row]
        out = []
        while len(row):
            u = _uniform(noise, place)
            e = self.first[s]
            late = np.flatnonzero(u >= self.cdf[e])
            while len(late):
                e[late] += 1
                late = late[u[late] >= self.cdf[e[late]]]
            out.append((row, place, e))
            step = self.length[e]
            s, place = s + step, place + step
            go = np.flatnonzero(s < stop)
            if len(go) < len(row):
                row, s, stop, place, noise = row[go], s[go], stop[go], place[go], noise[go]
        if not out:
            return (np.zeros(0, np.int64),) * 3
        row = np.concatenate([x[0] for x in out])
        count = np.bincount(row, minlength=len(state))
        spot = (np.cumsum(count) - count)[row] + np.repeat(np.arange(len(out)), [len(x[0]) for x in out])
        result = []
        for i in range(3):
            x = np.empty(len(row), np.int64)
            x[spot] = row if i == 0 else np.concatenate([y[i] for y in out])
            result.append(x)
        return tuple(result)


class Lattices:
    """Lattices of the stretches met so far, up to a bound of characters; beyond
    it those met most often are kept, up to half of it."""

    def __init__(self, pieces: Pieces, kept: int = _KEPT):
        self.pieces, self.kept = pieces, kept
        self.index: dict[str, int] = {}
        self.met = np.zeros(0, np.int64)
        self.lattice = Lattice([], pieces)

    def _shrink(self) -> None:
        size = np.diff(self.lattice.begin)
        order = np.argsort(-self.met, kind="stable")
        order = order[(self.met[order] > 1) & (size[order] <= 64)]
        order = order[np.cumsum(size[order]) <= self.kept // 2]
        names = list(self.index)
        self.index = {names[i]: n for n, i in enumerate(order.tolist())}
        self.lattice, self.met = self.lattice.take(order), self.met[order] // 2

    def of(self, stretches: list[str]) -> tuple[Lattice, np.ndarray]:
        """A lattice that holds the stretches, and the place of each in it."""
        if self.lattice.begin[-1] > self.kept:
            self._shrink()
        spots = np.fromiter(map(self.index.get, stretches, repeat(-1)), np.int64, len(stretches))
        missed = np.flatnonzero(spots < 0)
        if len(missed):
            unknown = [stretches[j] for j in missed.tolist()]
            new = list(dict.fromkeys(unknown))
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            spots[missed] = np.fromiter(map(self.index.__getitem__, unknown), np.int64, len(unknown))
            self.lattice.add(Lattice(new, self.pieces))
        count = np.bincount(spots, minlength=len(self.index))
        count[: len(self.met)] += self.met
        self.met = count
        return self.lattice, spots


def _noise(key: np.ndarray, stream: int) -> np.ndarray:
    return mix(key ^ U(stream * int(_K[2]) & (2**64 - 1)))


def _uniform(noise: np.ndarray, place: np.ndarray) -> np.ndarray:
    h = mix(noise + place.astype(U) * _K[3])
    return np.minimum(((h >> U(11)).astype(float) + 0.5) * 2.0**-53, 1 - 2.0**-53)


def _gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


def _truncate(g: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """A Gumbel variable g, given that it is at most bound."""
    top = np.maximum(-bound, -g)
    with np.errstate(invalid="ignore"):
        return np.where(np.isneginf(g), -np.inf, -(top + np.log(np.exp(-bound - top) + np.exp(-g - top))))


@dataclass
class Sampled:
    """Sampled segmentations: text and rank (from 1) of each, log probability,
    perturbed score and inclusion; ids[at[i] : at[i + 1]] are those of row i."""

    text: np.ndarray
    rank: np.ndarray
    log_prob: np.ndarray
    perturbed: np.ndarray
    inclusion: np.ndarray
    at: np.ndarray
    ids: np.ndarray


class _Search:
    """The search over a batch of texts: the steps found so far and, for each
    text, a table of open nodes: bound, path it follows, place where it leaves
    that, edges excluded there (bits), log mass before the place."""

    def __init__(self, texts: list[str], keys: list[int], lattices: Lattices, k: int):
        self.n, self.k, self.pieces = len(texts), k, lattices.pieces
        stretches: list[str] = []
        count = np.empty(self.n, np.int64)
        for i, t in enumerate(texts):
            found = _stretches(t)
            stretches += found
            count[i] = len(found)
        self.lat, word = lattices.of(stretches)
        lat = self.lat
        self.text_of = np.repeat(np.arange(self.n), count)
        self.state, self.stop = lat.begin[word], lat.begin[word + 1]
        size = self.stop - self.state
        ends = np.cumsum(size)
        base = np.concatenate([[0], ends])[np.cumsum(count) - count]  # first place of each text in the batch
        self.ends, self.base = ends, base
        self.begin = ends - size - base[self.text_of]  # place of each stretch in its text
        self.key = mix(np.array([(int(x or 0)) & (2**64 - 1) for x in keys], U) + _K[0])
        self.steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        none = np.zeros((self.n, 0))
        self.bound, self.mass = none, none
        self.path, self.place, self.out = (none.astype(x) for x in (np.int64, np.int64, U))

    def walk(self, path: int, rows: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Steps (text, place, edge) from states of some stretches to their ends, in order of place."""
        t = self.text_of[rows]
        place = self.begin[rows] + state - self.state[rows]
        row, place, e = self.lat.walk(state, self.stop[rows], place, _noise(self.key, 3 * path)[t])
        return t[row], place, e

    def push(self, rows: np.ndarray, bound, path, place, out, mass) -> None:
        """A further node of each of some texts."""
        for name, value, none in (("bound", bound, -np.inf), ("path", path, 0), ("place", place, 0), ("out", out, 0), ("mass", mass, 0.0)):
            old = getattr(self, name)
            column = np.full((self.n, 1), none, old.dtype)
            column[rows, 0] = value
            setattr(self, name, np.concatenate([old, column], 1))

    def split(self, path: int, steps: tuple, before: np.ndarray, bound: np.ndarray, most: int) -> None:
        """Push the `most` best nodes of each text along steps; before: log mass before the first."""
        t, place, e = steps
        if not len(t) or not most:
            return
        head = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        size = np.diff(np.concatenate([head, [len(t)]]))
        logp = self.lat.logp[e]
        total = np.cumsum(logp)
        prefix = total - logp
        prefix += np.repeat(before[t[head]] - prefix[head], size)

        def located(at: np.ndarray) -> np.ndarray:
            with np.errstate(divide="ignore"):
                return prefix[at] + np.log(-np.expm1(logp[at]))

        # of the first places, the most-th best: a place further below than the noise reaches can't win
        few = np.minimum(size, max(48, most))
        at, row = _spans(head, few), np.repeat(np.arange(len(head)), few)
        table = np.full((len(head), max(48, most)), -np.inf)
        table[row, at - head[row]] = located(at)
        least = np.partition(table, -most, 1)[:, -most] - _SPREAD
        at = np.flatnonzero(prefix >= np.repeat(least, size))
        of, location = np.searchsorted(head, at, "right") - 1, located(at)
        v = location + _gumbel(_uniform(_noise(self.key, 3 * path + 1)[t[at]], place[at]))
        edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        for _ in range(most):
            top = np.maximum.reduceat(v, edge)
            mine = np.flatnonzero((v == np.repeat(top, np.diff(np.concatenate([edge, [len(v)]])))) & ~np.isneginf(v))
            mine = mine[np.unique(of[mine], return_index=True)[1]]
            rows, x = t[at[mine]], at[mine]
            s, _ = self._states(rows, place[x])
            bit = U(1) << (e[x] - self.lat.first[s]).astype(U)
            self.push(rows, _truncate(v[mine], bound[rows]), path, place[x], bit, prefix[x])
            v[mine] = -np.inf

    def _states(self, rows: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lattice's states at places of texts, and the stretches they lie in."""
        w = np.searchsorted(self.ends, place + self.base[rows], "right")
        return self.state[w] + place - self.begin[w], w

    def pop(self, path: int) -> tuple[np.ndarray, np.ndarray]:
        """Open the best node of each text: adds the steps of path; (whether there is one, its score)."""
        lat, n = self.lat, self.n
        now = self.bound.max(1, initial=-np.inf)
        has = ~np.isneginf(now)
        rows = np.flatnonzero(has)
        best = self.bound[rows].argmax(1) if len(rows) else rows
        source, place, out, mass = (getattr(self, x)[rows, best] for x in ("path", "place", "out", "mass"))
        self.bound[rows, best] = -np.inf
        # another edge at the place, by probability
        s, w = self._states(rows, place)
        degree = lat.first[s + 1] - lat.first[s]
        wide = np.arange(degree.max(initial=1))
        edges = np.minimum(lat.first[s][:, None] + wide, len(lat.id) - 1)
        free = (wide < degree[:, None]) & ((out[:, None] >> wide.astype(U)) & U(1) == 0)
        prob = np.where(free, np.exp(lat.logp[edges]), 0.0) if len(rows) else np.zeros((0, 1))
        run = prob.cumsum(1)
        u = _uniform(_noise(self.key, 3 * path + 2)[rows], place) * run[:, -1]
        pick = np.where(prob > 0, wide, -1).max(1, initial=-1)
        pick = np.minimum((run <= u[:, None]).sum(1), pick) if len(rows) else pick
        edge = edges[np.arange(len(rows)), pick] if len(rows) else rows
        rest = run[:, -1] - prob[np.arange(len(rows)), pick] if len(rows) else run[:, -1]
        rest[(prob > 0).sum(1) < 2] = 0.0
        more = np.flatnonzero(rest > 0)
        g = mass[more] + np.log(rest[more]) + _gumbel(_uniform(_noise(self.key, 3 * path + 3 * self.k)[rows[more]], place[more]))
        bit = out[more] | (U(1) << pick[more].astype(U))
        self.push(rows[more], _truncate(g, now[rows[more]]), source[more], place[more], bit, mass[more])
        # the new path: its source up to the place, the new edge, then a walk to the end
        of, at = np.full(n, -1), np.zeros(n, np.int64)
        of[rows], at[rows] = source, place
        parts = []
        for q in range(path):
            t, p, e = self.steps[q]
            mine = np.flatnonzero((of[t] == q) & (p < at[t]))
            parts.append((t[mine], p[mine], e[mine]))
        after = np.zeros(n, np.int64)
        after[rows] = place + lat.length[edge]
        size = self.stop - self.state
        go = np.flatnonzero(has[self.text_of] & (self.begin + size > after[self.text_of]))
        walked = self.walk(path, go, self.state[go] + np.maximum(0, after[self.text_of[go]] - self.begin[go]))
        before = np.zeros(n)
        before[rows] = mass + lat.logp[edge]
        self.split(path, walked, before, now, self.k - path)
        parts += [(rows, place, edge), walked]
        t, p, e = (np.concatenate([x[i] for x in parts]) for i in range(3))
        # parts are in order of text and place, and of a text one part ends where the next begins
        count = [np.bincount(x[0], minlength=n) for x in parts]
        start = np.cumsum(sum(count)) - sum(count)
        spot = []
        for x, c in zip(parts, count, strict=True):
            spot.append(start[x[0]] + np.arange(len(x[0])) - (np.cumsum(c) - c)[x[0]])
            start = start + c
        order = np.empty(len(t), np.int64)
        order[np.concatenate(spot)] = np.arange(len(t))
        self.steps.append((t[order], p[order], e[order]))
        return has, now

    def run(self) -> Sampled:
        n, k, lat = self.n, self.k, self.lat
        score = [_gumbel(_uniform(_noise(self.key, 2), np.zeros(n, np.int64)))]
        alive = [np.ones(n, bool)]
        self.steps.append(self.walk(0, np.arange(len(self.state)), self.state))
        self.split(0, self.steps[0], np.zeros(n), score[0], k)
        for path in range(1, k):
            has, now = self.pop(path)
            alive.append(has)
            score.append(now)
        kappa = self.bound.max(1, initial=-np.inf)  # the threshold: the score of the next
        rows, ids, sizes = [], [], []
        for path, (t, _, e) in enumerate(self.steps):
            logp = np.bincount(t, weights=lat.logp[e], minlength=n)
            some, mine = np.flatnonzero(alive[path]), lat.id[e]
            count = np.bincount(t, minlength=n)
            bare = np.flatnonzero(mine < 0)
            if len(bare):  # spell in bytes
                spelled = [chr(-1 - x).encode("utf-8", "surrogatepass") for x in mine[bare].tolist()]
                width = np.ones(len(mine), np.int64)
                width[bare] = list(map(len, spelled))
                flat = np.repeat(mine, width)
                flat[np.repeat(mine < 0, width)] = self.pieces.byte[np.frombuffer(b"".join(spelled), np.uint8)]
                count = np.bincount(t, weights=width, minlength=n).astype(np.int64)
                mine = flat
            with np.errstate(over="ignore"):
                inclusion = np.where(np.isneginf(kappa), 1.0, -np.expm1(-np.exp(np.minimum(logp - np.where(np.isneginf(kappa), 0.0, kappa), 700.0))))
            rows.append((some, np.full(len(some), path + 1), logp[some], score[path][some], inclusion[some]))
            ids.append(mine)
            sizes.append(count[some])
        # text by text
        cols, size, flat = [np.concatenate([r[i] for r in rows]) for i in range(5)], np.concatenate(sizes), np.concatenate(ids)
        order = np.lexsort((cols[1], cols[0]))
        flat = flat[_spans((np.cumsum(size) - size)[order], size[order])]
        return Sampled(*(c[order] for c in cols), np.concatenate([[0], np.cumsum(size[order])]), flat)


def sample(texts: list[str], keys: list[int], lattices: Lattices, k: int) -> Sampled:
    """k distinct segmentations of each text, as far as there are."""
    return _Search(texts, keys, lattices, k).run()


def _digests(got: Sampled, texts: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Of each segmentation, a hash of its ids in order and whether they decode to the text."""
    inner = np.arange(len(got.ids)) - np.repeat(got.at[:-1], np.diff(got.at))
    h = mix(got.ids.astype(U) * _K[0] + inner.astype(U) * _K[1])
    total = np.concatenate([np.zeros(1, U), np.cumsum(h)])
    raw = [b" " + t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    begin = (np.cumsum(size) - size)[got.text]
    spelled = pieces.bytes_of(got.ids)
    cut = np.concatenate([[0], np.cumsum(pieces.width[got.ids])])[got.at]
    same = np.diff(cut) == size[got.text]
    want = np.frombuffer(b"".join(raw), np.uint8)
    spot = np.minimum(_spans(begin, np.diff(cut)), max(0, len(want) - 1))
    wrong = np.concatenate([[0], np.cumsum(spelled != want[spot])]) if len(want) else np.arange(len(spelled) + 1)
    return (total[got.at[1:]] - total[got.at[:-1]]).view(np.int64), same & (wrong[cut[1:]] == wrong[cut[:-1]])


def encode(df: DataFrame, k: int = 2, model: str = MODEL, temperature: float = 1.0, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows key_col, rank, n_ids, log_prob, perturbed, inclusion, ids_hash (of
    the ids in order), exact (they decode to the text) and ids."""
    with open(model, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(Pieces(f.read(), temperature))
    names = "key rank n_ids log_prob perturbed inclusion ids_hash exact ids".split()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(sent.value)
        for b in source:
            for part in slices(b):
                rows = [(key, t) for key, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if t is not None]
                i = 0
                while i < len(rows):
                    j, total = i, 0
                    while j < len(rows) and (j == i or total + len(rows[j][1]) <= _BATCH):
                        total += len(rows[j][1])
                        j += 1
                    keys, texts = [r[0] for r in rows[i:j]], [r[1] for r in rows[i:j]]
                    got = sample(texts, keys, lattices, k)
                    h, exact = _digests(got, texts, sent.value)
                    cols = [
                        pa.array(keys, pa.int64()).take(pa.array(got.text)), pa.array(got.rank.astype(np.int32)), pa.array(np.diff(got.at)),
                        *[pa.array(x) for x in (got.log_prob, got.perturbed, got.inclusion, h, exact)],
                        pa.ListArray.from_arrays(pa.array(got.at.astype(np.int32)), pa.array(got.ids.astype(np.int32))),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, names)
                    i = j
            release()

    src = df.select(F.col(key_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    schema = "key bigint, rank int, n_ids bigint, log_prob double, perturbed double, inclusion double, ids_hash bigint, exact boolean, ids array<int>"
    return src.mapInArrow(run, schema).withColumnRenamed("key", key_col)


def decode(df: DataFrame, model: str = MODEL, ids_col: str = "ids", name: str = "text") -> DataFrame:
    """df with a column of the texts that ids (an array of pieces) spell; null for null."""
    with open(model, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(Pieces(f.read()))

    @F.arrow_udf("string")
    def text_of(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in it:
            yield pa.array([None if x is None else sent.value.decode(x) for x in rows.to_pylist()], pa.string())

    return df.withColumn(name, text_of(F.col(ids_col)))


def query(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    """Rows of op1: two per document, its sampled segmentations with their digests."""
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), k=2, model=model)
