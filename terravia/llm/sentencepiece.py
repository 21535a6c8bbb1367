"""SentencePiece BPE encoding and decoding by suffix-array matching.

The distinct words of a batch (each behind its word mark) are concatenated and indexed
by a suffix array, sorted as deep as the longest piece by prefix doubling on packed
code points. Every piece of the vocabulary is binary-searched in it for its range of
occurrences; the occurrences are the edges of a lattice over the batch's positions.
Sorted by end position they are relaxed once from left to right: of the edges that end
at a position exactly one can be the last token of the encoding of what stands before
it, namely the one whose piece is compatible with the token that ends where it starts.
Two pieces are compatible if merging their joint text yields just these two; that is
decided by taking their merges back in the reverse order of their ranks, and remembered.
The result is the one of the merge queue, which the tests check against the library.
Words of up to SHORT characters are relaxed together, a character of all of them at a
time, longer ones each for itself.

A vocabulary is read from a model file on the driver (its path is a parameter) and sent
to the tasks; its size does not depend on the data. Characters without a piece become
byte pieces. Texts are cut into words, told apart and joined again as whole columns; a
word has the spaces before it. A worker remembers words it has encoded, in a younger and
an older part of REMEMBERED bytes each, and no word of over LONG characters; a longer
word is indexed and relaxed in windows that overlap by the longest piece, so memory grows
with a word by some bytes a character. A model that is not of the kind described (no
merge ranks, another normaliser, word marks inside pieces) is refused.

Defined cases: a null text gives null ids and a null text back; an empty one gives no
ids. Decoding gives the text back, except that a word mark (U+2581) in it comes back as
a space, as the model defines. Repeated rows are encoded alike; a text of any length is
encoded whole.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters indexed at a time, and bytes of words that a worker remembers in each part, by a rough count.
INDEXED, REMEMBERED = 300_000, 64_000_000
#: Bytes of text encoded at a time.
BATCH = 4_000_000
#: Characters of the longest word that is remembered, and what a remembered word takes beside its text.
LONG, ENTRY = 4096, 160
#: Characters of the longest word that is relaxed together with others.
SHORT = 250
#: Pairs of pieces whose compatibility is remembered: by words relaxed alone, and (a power of two) by those relaxed together.
MOST_PAIRS, PAIR_BITS = 1_600_000, 20
UNKNOWN = -1
PROBE = "ﬁ  Ａ½ x\tthe  end ▁é漢 🙂 "


@dataclass
class Vocabulary:
    """pieces: text by id; rank: order of merging by id (-1: a single character); halves: last merge by id."""

    pieces: list[str]
    rank: list[float]
    halves: list[tuple[int, int] | None]
    ids: dict[str, int]
    bytes_: list[int]
    unknown: int

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        scores = [model.get_score(i) for i in range(size)]
        if any(x != int(x) for x in scores) or any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError(f"{path}: a BPE model without word marks inside its pieces is needed")
        special = {i for i in range(size) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        order = {s: r for r, s in enumerate(sorted({-model.get_score(i) for i in range(size) if i not in special}))}
        bytes_ = [-1] * 256
        for i in special:
            if model.is_byte(i):
                bytes_[int(pieces[i][1:-1], 16)] = i
        ids = {pieces[i]: i for i in range(size) if i not in special}
        rank = [float("inf") if i in special else -1.0 if len(pieces[i]) == 1 else float(order[-model.get_score(i)]) for i in range(size)]
        made = cls(pieces, rank, [None] * size, ids, bytes_, model.unk_id())
        for text, i in ids.items():
            if len(text) > 1:
                made.halves[i] = made.last_merge(text)
        if Codec(made).encode_batch([PROBE]) != [model.encode(PROBE)]:
            raise ValueError(f"{path}: its normaliser changes texts")
        return made

    def last_merge(self, text: str) -> tuple[int, int] | None:
        """The two pieces that merge into the whole text at last; None if merging does not lead there."""
        parts = list(text)
        while len(parts) > 1:
            merged = [(self.rank[self.ids[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.ids]
            if not merged:
                return None
            k = min(merged)[1]
            if len(parts) == 2:
                return self.ids.get(parts[0], UNKNOWN), self.ids.get(parts[1], UNKNOWN)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return None

    def compatible(self, left: int, right: int) -> bool:
        """Whether the joint text of two pieces is encoded as these two."""
        if left < 0 or right < 0:
            return True
        before = float("inf")
        while True:
            joint = self.ids.get(self.pieces[left] + self.pieces[right])
            if joint is not None and self.rank[joint] < before:
                return False
            a, b = self.rank[left], self.rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:  # the left piece was merged later: take that back; an equal rank further left goes first
                before, left = a, self.halves[left][1]
            else:
                before, right = b + 0.5, self.halves[right][0]


class Matcher:
    """Finds all the pieces in a text of code points with a suffix array."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        usable = [i for t, i in vocabulary.ids.items() if vocabulary.halves[i] is not None and set(t) != {MARK}]
        longest = max((len(vocabulary.pieces[i]) for i in usable), default=1)
        self.levels = 1
        while 4 << (self.levels - 1) < longest:
            self.levels += 1
        self.width = 4 << (self.levels - 1)
        letters = sorted({c for i in usable for c in vocabulary.pieces[i]})
        self.code = np.zeros(0x110000, dtype=np.uint16)
        self.code[[ord(c) for c in letters]] = np.arange(2, len(letters) + 2)  # 0: end of a word, 1: in no longer piece
        self.code[self.code == 0] = 1
        self.ids = np.array(usable, dtype=np.int32)
        self.lengths = np.array([len(vocabulary.pieces[i]) for i in usable], dtype=np.int64)
        self.codes = np.zeros((len(usable), self.width), dtype=np.uint64)
        for k, i in enumerate(usable):
            self.codes[k, : self.lengths[k]] = self.code[[ord(c) for c in vocabulary.pieces[i]]]

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, row in self.ids) of every occurrence of every piece, by end position, the longest first."""
        n = len(codes)
        padded = np.zeros(n + 4, dtype=np.uint64)
        padded[:n] = codes
        key = (padded[:n] << np.uint64(48)) | (padded[1 : n + 1] << np.uint64(32)) | (padded[2 : n + 2] << np.uint64(16)) | padded[3 : n + 3]
        values = []
        for level in range(self.levels):
            order = np.argsort(key)
            ordered = key[order]
            new = np.empty(n, dtype=bool)
            new[:1] = True
            np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
            values.append(ordered[new])
            if level + 1 < self.levels:
                rank = np.empty(n + (4 << level), dtype=np.uint64)
                rank[n:] = 0
                rank[order] = np.cumsum(new, dtype=np.uint64)  # from 1: 0 is past the end
                key = (rank[:n] << np.uint64(32)) | rank[4 << level :]
        first = np.append(np.flatnonzero(new), n)
        lo, hi = self._ranks(values, self.codes, self.lengths, self.levels)
        a, b = first[lo], first[np.maximum(lo, hi)]
        count = b - a
        which = np.repeat(np.arange(len(count)), count)
        at = order[np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)]
        long = self.lengths[which]
        by_end = np.argsort((at + long) * (self.width + 1) - long)
        return at[by_end], which[by_end]

    def _ranks(self, values: list[np.ndarray], codes: np.ndarray, lengths: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Binary search: the range of ranks, among the distinct keys of a level, of what begins with each piece."""
        if level == 1:
            low, high = np.zeros(len(codes), dtype=np.uint64), np.zeros(len(codes), dtype=np.uint64)
            for k in range(4):
                inside = lengths > k
                low = (low << np.uint64(16)) | np.where(inside, codes[:, k], 0).astype(np.uint64)
                high = (high << np.uint64(16)) | np.where(inside, codes[:, k], 0xFFFF).astype(np.uint64)
            return np.searchsorted(values[0], low), np.searchsorted(values[0], high, side="right")
        half = 4 << (level - 2)
        left_lo, left_hi = self._ranks(values, codes[:, :half], np.minimum(lengths, half), level - 1)
        right_lo, right_hi = self._ranks(values, codes[:, half:], np.maximum(lengths - half, 0), level - 1)
        longer = lengths > half
        base = (left_lo + 1).astype(np.uint64) << np.uint64(32)
        low = np.where(longer, base | (right_lo + 1).astype(np.uint64), base)
        high = np.where(longer, base | (right_hi + 1).astype(np.uint64), (left_hi + 1).astype(np.uint64) << np.uint64(32))
        lo, hi = np.searchsorted(values[level - 1], low), np.searchsorted(values[level - 1], high)
        return lo, np.where(left_hi > left_lo, hi, lo)


def spread(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indexes of runs, of so many from each begin on, one run after the other."""
    return np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


class Pairs:
    """Whether pieces are compatible, for many pairs at a time."""

    def __init__(self, v: Vocabulary):
        self.rank = np.array(v.rank)
        halves = np.array([h or (UNKNOWN, UNKNOWN) for h in v.halves])
        self.left, self.right = halves[:, 0], halves[:, 1]
        joints = {}
        for text, i in v.ids.items():
            for k in range(1, len(text)):
                a, b = v.ids.get(text[:k]), v.ids.get(text[k:])
                if a is not None and b is not None:
                    joints[a << 20 | b] = v.rank[i]
        self.joints = np.array(sorted(joints), dtype=np.int64)
        self.joint_rank = np.array([joints[k] for k in self.joints.tolist()])
        # a pair has one place, which the last one that was looked for takes: its key from 1 on, and the answer in the lowest bit
        self.seen = np.zeros(1 << PAIR_BITS, dtype=np.uint64)

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = ((left + 1).astype(np.uint64) << np.uint64(20) | right.astype(np.uint64)) + np.uint64(1)
        places = (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)
        found = self.seen[places]
        good = (found & np.uint64(1)).astype(bool)
        missed = np.flatnonzero(found >> np.uint64(1) != keys)
        if len(missed):
            new, one, each = np.unique(keys[missed], return_index=True, return_inverse=True)
            one = missed[one]
            fresh = self._decided(left[one], right[one])
            self.seen[places[one]] = new << np.uint64(1) | fresh
            good[missed] = fresh[each]
        return good

    def _decided(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Vocabulary.compatible of each pair, where right is a piece."""
        good = np.ones(len(left), dtype=bool)
        live = np.flatnonzero(left >= 0)
        left, right, before = left[live], right[live], np.full(len(live), np.inf)
        while len(live):
            keys = left.astype(np.int64) << 20 | right
            at = np.minimum(np.searchsorted(self.joints, keys), len(self.joints) - 1)
            bad = (self.joints[at] == keys) & (self.joint_rank[at] < before)
            good[live[bad]] = False
            a, b = self.rank[left], self.rank[right]
            on = ~bad & ((a >= 0) | (b >= 0))
            live, left, right, a, b = live[on], left[on], right[on], a[on], b[on]
            later = a > b
            before = np.where(later, a, b + 0.5)
            left, right = np.where(later, self.right[left], left), np.where(later, right, self.left[right])
        return good


class Words(dict[str, int]):
    """Words by number, and the ids of all of them in one array."""

    def __init__(self):
        super().__init__()
        self.ends, self.values = array("q", [1]), array("i", [0])

    def add(self, words: list[str], counts: np.ndarray, values: np.ndarray) -> None:
        self.update(zip(words, range(len(self), len(self) + len(words)), strict=True))
        self.ends.frombytes((self.ends[-1] + np.cumsum(counts, dtype=np.int64)).tobytes())
        self.values.frombytes(values.astype(np.int32).tobytes())

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and the ids."""
        at = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        ends = np.frombuffer(self.ends, dtype=np.int64)
        begins, counts = ends[at], ends[at + 1] - ends[at]
        return counts, np.frombuffer(self.values, dtype=np.int32)[spread(begins, counts)]


class Codec:
    def __init__(self, vocabulary: Vocabulary, indexed: int = INDEXED, remembered: int = REMEMBERED):
        self.v, self.indexed, self.remembered = vocabulary, indexed, remembered
        self.matcher = Matcher(vocabulary)
        # a window holds a whole pack of words, or part of a long one
        self.window = indexed + LONG + 2
        self.known, self.older, self.held = Words(), Words(), 0
        self.pairs: dict[int, bool] = {}
        self.many = Pairs(vocabulary)
        runs = {len(t): i for t, i in vocabulary.ids.items() if set(t) == {MARK}}
        self.runs, self.longest_run = runs, max(runs)
        self.single = {t: i for t, i in vocabulary.ids.items() if len(t) == 1}
        self.singles = np.full(0x110000, UNKNOWN, dtype=np.int32)
        self.singles[[ord(c) for c in self.single]] = list(self.single.values())
        self.byte_ids = np.array([i if i >= 0 else vocabulary.unknown for i in vocabulary.bytes_], dtype=np.int32)
        as_bytes = [p.replace(MARK, " ").encode() for p in vocabulary.pieces]
        for byte, i in enumerate(vocabulary.bytes_):
            if i >= 0:
                as_bytes[i] = bytes([byte])
        # a text begins with a mark that is not its own: pieces at the beginning come second
        self.as_bytes = pa.array(as_bytes + [b.removeprefix(b" ") for b in as_bytes], type=pa.binary())

    def _learn(self, words: list[str], into: Words) -> None:
        """Encode words in packs, and put their ids into a table."""
        for relax, some in ((self._relax_many, [w for w in words if len(w) <= SHORT]), (self._relax, [w for w in words if len(w) > SHORT])):
            at = 0
            while at < len(some):
                end, size = at, 0
                while end < len(some) and (end == at or size + len(some[end]) + 2 <= self.indexed):
                    size += len(some[end]) + 2
                    end += 1
                into.add(some[at:end], *self._packed(some[at:end], relax))
                at = end

    def _packed(self, pack: list[str], relax: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word of a pack has, and the ids."""
        bare = [w.lstrip(" ") for w in pack]
        words = [w for w in bare if w]
        counts, ids = relax(words) if words else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32))
        marks = [len(w) - len(b) for w, b in zip(pack, bare, strict=True)]
        if max(marks) == 1 and all(bare):
            return counts, ids
        lone, each, parts = self.runs[1], iter(np.split(ids, np.cumsum(counts)[:-1])), []
        for b, n in zip(bare, marks, strict=True):
            if not b:
                parts.append(self._run(n))
                continue
            part = next(each)
            if n > 1:  # the last mark of a run merges with the word, if any, before marks merge with each other
                own = part[0] == lone
                part = np.concatenate((self._run(n if own else n - 1), part[1:] if own else part))
            parts.append(part)
        return np.array([len(p) for p in parts]), np.concatenate(parts)

    def _run(self, n: int) -> np.ndarray:
        whole, rest = divmod(n, self.longest_run)
        out = [self.runs[self.longest_run]] * whole
        while rest:  # not every length has a piece
            most = max(k for k in self.runs if k <= rest)
            out.append(self.runs[most])
            rest -= most
        return np.array(out, dtype=np.int32)

    def _relax_many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of these short words has, and the ids."""
        m = self.matcher
        points = np.frombuffer("".join(f"{MARK}{w}\0" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.array([len(w) + 2 for w in words])
        begins = np.cumsum(sizes) - sizes
        inside = np.arange(len(points)) - np.repeat(begins, sizes)
        # without a longer piece: the character itself
        last = np.empty(len(points), dtype=np.int32)
        last[1:] = self.singles[points[:-1]]
        last[begins] = UNKNOWN
        back = np.arange(-1, len(points) - 1)
        starts, which = m.edges(m.code[points])
        stops = starts + m.lengths[which]
        depth = inside[stops].astype(np.uint16)
        order = np.argsort(depth, kind="stable")
        starts, stops, tokens = starts[order], stops[order], m.ids[which[order]]
        for lo, hi in zip([0, *(cuts := np.cumsum(np.bincount(depth)).tolist())], cuts, strict=False):
            if lo < hi:
                good = lo + np.flatnonzero(self.many.compatible(last[starts[lo:hi]], tokens[lo:hi]))
                if len(good):
                    stop = stops[good]
                    good = good[np.append(True, stop[1:] != stop[:-1])]  # the longest
                    last[stops[good]] = tokens[good]
                    back[stops[good]] = starts[good]
        used = np.zeros(len(points), dtype=bool)
        at = begins + sizes - 1
        while len(at):
            used[at] = True
            at = back[at]
            at = at[inside[at] > 0]
        at = np.flatnonzero(used)
        counts, ids = np.add.reduceat(used, begins, dtype=np.int64), last[at]
        lost = ids == UNKNOWN
        if lost.any():
            bare = points[at[lost] - 1]
            widths = np.ones(len(ids), dtype=np.int64)
            widths[lost] = 1 + (bare >= 0x80) + (bare >= 0x800) + (bare >= 0x10000)
            data = bare.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
            counts = np.add.reduceat(widths, np.cumsum(counts) - counts)
            ids, lost = np.repeat(ids, widths), np.repeat(lost, widths)
            ids[lost] = self.byte_ids[np.frombuffer(data, dtype=np.uint8)]
        return counts, ids

    def _edges(self, text: str, lo: int, hi: int) -> tuple[list[int], list[int], list[int]]:
        """Of the edges that end at positions from lo + 1 to hi: where each position's begin in the list, their starts, their pieces."""
        m = self.matcher
        left = max(0, lo - m.width)
        codes = m.code[np.frombuffer(text[left:hi].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        starts, which = m.edges(codes)
        starts = starts + left
        ends = starts + m.lengths[which]
        inside = ends > lo
        starts, which, ends = starts[inside], which[inside], ends[inside]
        first = np.concatenate(([0, 0], np.cumsum(np.bincount(ends - lo - 1, minlength=hi - lo))))
        return first.tolist(), starts.tolist(), m.ids[which].tolist()

    def _relax(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and the ids."""
        v, pairs = self.v, self.pairs
        text = "".join(f"{MARK}{w}\0" for w in words)
        ends = np.cumsum([len(w) + 2 for w in words]) - 1
        spans = list(zip([0, *(ends[:-1] + 1).tolist()], ends.tolist(), strict=True))
        last = array("i", [UNKNOWN]) * (len(text) + 1)
        back = array("i", [0]) * (len(text) + 1)
        single, compatible = self.single, v.compatible
        for lo in range(0, len(text), self.window):
            hi = min(lo + self.window, len(text))
            first, starts, tokens = self._edges(text, lo, hi)
            for begin, end in spans:
                if end <= lo or begin >= hi:
                    continue
                for stop in range(max(begin, lo) + 1, min(end, hi) + 1):
                    edge, edges_end = first[stop - lo], first[stop - lo + 1]
                    while edge < edges_end:
                        s = starts[edge]
                        t = tokens[edge]
                        if s == begin:
                            break
                        key = last[s] << 20 | t
                        if key in pairs:
                            if pairs[key]:
                                break
                        else:
                            pairs[key] = good = compatible(last[s], t)
                            if good:
                                break
                        edge += 1
                    else:  # no longer piece: the character itself
                        s = stop - 1
                        t = single.get(text[s], UNKNOWN)
                    last[stop] = t
                    back[stop] = s
        counts, out = [], array("i")
        for begin, at in reversed(spans):
            before = len(out)
            while at > begin:
                if last[at] == UNKNOWN:
                    data = text[at - 1].encode("utf-8", "surrogatepass")
                    out.extend(self.byte_ids[[*reversed(data)]].tolist())
                else:
                    out.append(last[at])
                at = back[at]
            counts.append(len(out) - before)
        if len(pairs) > MOST_PAIRS:
            pairs.clear()
        return np.array(counts[::-1], dtype=np.int64), np.array(out[::-1], dtype=np.int32)

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of these distinct words has, and the ids; words in use come back from the older half."""
        if self.held > self.remembered:
            self.known, self.older, self.held = Words(), self.known, 0
        known, older = self.known, self.older
        missing = [w for w in words if w not in known and len(w) <= LONG]
        self.held += sum(map(len, missing)) + ENTRY * len(missing)
        if back := [w for w in missing if w in older]:
            known.add(back, *older.ids(back))
            missing = [w for w in missing if w not in older]
        self._learn(missing, known)
        long = [w for w in words if len(w) > LONG]
        if long:
            short = [w for w in words if len(w) <= LONG]
            ids, known = known.ids(short), Words()
            known.add(short, *ids)
            self._learn(long, known)
        return known.ids(words)

    def encode_array(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each text begin, and their end; the ids. A null has none."""
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.string()), ""), MARK, " ")
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
        _, cuts, data = texts.buffers()
        cuts = np.frombuffer(cuts, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
        size = int(cuts[-1])
        if size == cuts[0]:
            return np.zeros(len(texts) + 1, dtype=np.int32), np.empty(0, dtype=np.int32)
        # a word begins at a space behind another character, or with a text
        space = np.frombuffer(data, dtype=np.uint8, count=size) == 0x20
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[: cuts[0]] = False
        begins[cuts[:-1][cuts[:-1] < cuts[1:]]] = True
        begins = np.append(np.flatnonzero(begins), size).astype(np.int32)
        n = len(begins) - 1
        ends, ids, at = [np.zeros(1, dtype=np.int64)], [], 0
        while at < n:
            end = min(n, max(at + 1, int(np.searchsorted(begins, begins[at] + BATCH))))
            words = pa.StringArray.from_buffers(end - at, pa.py_buffer(begins[at : end + 1]), data).dictionary_encode()
            counts, values = self._ids_of(words.dictionary.to_pylist())
            which = words.indices.to_numpy()
            first = (np.cumsum(counts) - counts).astype(np.int32)
            counts = counts[which]
            ids.append(values[spread(first[which], counts)])
            ends.append(ends[-1][-1] + np.cumsum(counts))
            at = end
        return np.concatenate(ends)[np.searchsorted(begins, cuts)].astype(np.int32), np.concatenate(ids)

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        offsets, ids = self.encode_array(pa.array(texts, type=pa.string()))
        return [ids[a:b].tolist() for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]

    def decode_array(self, offsets: np.ndarray, ids: np.ndarray) -> pa.StringArray:
        """The text of each run of ids."""
        at = ids.copy()
        at[offsets[:-1][offsets[:-1] < offsets[1:]]] += len(self.v.pieces)
        pieces = self.as_bytes.take(pa.array(at))
        _, cuts, data = pieces.buffers()
        cuts = np.frombuffer(cuts, dtype=np.int32)[offsets]
        texts = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(cuts), data)
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:  # a model without all the byte pieces
            whole = data.to_pybytes()
            texts = pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)], type=pa.string())
        return texts


_CODECS: dict[int, Codec] = {}


def _codec(vocabulary: Vocabulary, key: int) -> Codec:
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(vocabulary)
    return _CODECS[key]


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", model: str = MODEL) -> DataFrame:
    """key, ids array<int>, n_tokens long, decoded string for each row of docs."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary.read(model))
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, id(shared.value))
        for whole in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False)) // BATCH
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), whole.num_rows]
            for at, end in zip(cuts, cuts[1:], strict=False):
                batch = whole.slice(at, end - at)
                texts = batch.column(1)
                offsets, ids = codec.encode_array(texts)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids), mask=texts.is_null())
                decoded = pc.if_else(texts.is_valid(), codec.decode_array(offsets, ids), None)
                n_tokens = pc.if_else(texts.is_valid(), pa.array(np.diff(offsets).astype(np.int64)), None)
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, n_tokens, decoded], names=[key, "ids", "n_tokens", "decoded"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind.simpleString()}, ids array<int>, n_tokens long, decoded string")


def op4(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256: the text as it comes back from the ids."""
    return encode(docs, model=model).selectExpr("doc_id", "n_tokens", "ids", "sha2(decoded, 256) AS decoded_sha256")


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
