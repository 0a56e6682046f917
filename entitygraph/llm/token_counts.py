"""Token counts from compiled finite-state transducers.

Two deterministic transducers count the tokens of a byte-level BPE vocabulary
without building the tokens.

*Splitter.*  A table over classes of code points marks where pre-tokens begin.
Texts are laid end to end and cut into equal chunks; each chunk becomes a map
from entry state to exit state.  The maps compose through a parallel prefix
scan, which gives every chunk its entry state; then all chunks emit their marks
at once.

*Word counter.*  BPE encodings of the prefixes of a word form a finite-state
process: the last token of a prefix is the one vocabulary string ending there
that is compatible with the last token of what precedes it, and vocabulary
strings have bounded length.  States hold the last tokens and relative counts
at the places that can still matter; a transition on a byte carries the
change of the token count.  States are compiled when first reached, up to a
bound; from there on words are walked through the same transitions unstored.

Emitted counts compose by a prefix scan as well: what a text holds is the
difference of the scan at its two ends.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from entitygraph.llm.bpe import Vocabulary, default_vocabulary, vocabulary
from entitygraph.llm.common import slices, small_batches, texts_of

# Classes of code points for the splitter.
LETTER, NUMBER, SPACE, BLANK, OTHER, QUOTE, SHORT, R, V, E, L, END = range(12)
# States: nothing yet; in letters, numbers, signs; one space, one blank, more ending in a space, more ending in a
# blank; a leading quote; quote and r, v, l; a complete short form.
FRESH, LETTERS, NUMBERS, SIGNS, SPACE1, BLANK1, SPACES, BLANKS, QUOTED, QUOTE_R, QUOTE_V, QUOTE_L, SHORT_END = range(13)
STATES = 13
HERE, EARLIER = 1, 2  # a pre-token begins at this code point; at the one before

#: Fixed: the code points that count as white space.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

CHUNK = 512
#: Code points after which the exit state hardly ever depends on the entry state.
LEAD = 8
#: Compiled states of a process, its remembered pairs of tokens, and its remembered words (and as many older ones).
MOST_STATES = 50_000
MOST_PAIRS = 400_000
WORD_MEMORY = 200_000


@lru_cache(maxsize=1)
def code_point_classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[WHITE_SPACE] = BLANK
    out[0x20], out[ord("'")] = SPACE, QUOTE
    for letters, kind in (("stmd", SHORT), ("r", R), ("v", V), ("e", E), ("l", L)):
        for x in letters:
            out[ord(x)] = kind
    return out


def begin(kind: int) -> int:
    """The state after the first code point of a pre-token without a leading space."""
    return {NUMBER: NUMBERS, SPACE: SPACE1, BLANK: BLANK1, OTHER: SIGNS, QUOTE: QUOTED, END: FRESH}.get(kind, LETTERS)


@lru_cache(maxsize=1)
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """next[state * 16 + class] and marks[state * 16 + class]."""
    after, marks = np.zeros(256, np.uint8), np.zeros(256, np.uint8)

    def step(state: int, kind: int) -> tuple[int, int]:
        letter, sign, white = kind in (LETTER, SHORT, R, V, E, L), kind in (OTHER, QUOTE), kind in (SPACE, BLANK)
        run = {LETTERS: letter, NUMBERS: kind == NUMBER, SIGNS: sign}
        if state in run and run[state]:
            return state, 0
        if state in (SPACE1, SPACES, BLANK1, BLANKS):
            if white:
                return SPACES if kind == SPACE else BLANKS, 0
            if kind == END:
                return FRESH, HERE
            early = EARLIER if state in (SPACES, BLANKS) else 0
            if state in (SPACE1, SPACES):
                return LETTERS if letter else NUMBERS if kind == NUMBER else SIGNS, early
            return begin(kind), early | HERE
        if state == QUOTED:
            if kind in (R, V, L):
                return {R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[kind], 0
            if kind == SHORT:
                return SHORT_END, 0
            if sign:
                return SIGNS, 0
        if state in (QUOTE_R, QUOTE_V, QUOTE_L):
            if kind == (L if state == QUOTE_L else E):
                return SHORT_END, 0
            return (LETTERS, EARLIER) if letter else (begin(kind), EARLIER | HERE)
        return begin(kind), HERE

    for state in range(STATES):
        for kind in range(12):
            after[state * 16 + kind], marks[state * 16 + kind] = step(state, kind)
    return after, marks


def chunk_maps(kinds: np.ndarray) -> np.ndarray:
    """Entry state -> exit state of every chunk; ``kinds`` is (steps, chunks)."""
    after, _ = splitter()
    steps, chunks = kinds.shape
    maps = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], chunks, 1)
    lead = min(LEAD, steps)
    for i in range(lead):
        maps = after[(maps << 4) | kinds[i]]
    same = (maps == maps[0]).all(0)
    single = np.flatnonzero(same)
    state = maps[0, single]
    part = kinds[:, single]
    for i in range(lead, steps):
        state = after[(state << 4) | part[i]]
    maps[:, single] = state
    rest = np.flatnonzero(~same)
    if len(rest):
        own, part = maps[:, rest], kinds[:, rest]
        for i in range(lead, steps):
            own = after[(own << 4) | part[i]]
        maps[:, rest] = own
    return maps


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive composition of the chunk maps: doubling steps, each over all chunks at once."""
    out, step = maps.copy(), 1
    while step < out.shape[1]:
        later = out[:, step:]
        earlier = out[:, :-step]
        out = np.concatenate([out[:, :step], np.take_along_axis(later, earlier, 0)], 1)
        step *= 2
    return out


def split_marks(kinds: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Positions at which a pre-token begins (or END stands) in a sequence of classes that closes with END."""
    after, marks = splitter()
    n = len(kinds)
    chunks = -(-n // chunk)
    table = np.full(chunks * chunk, END, np.uint8)
    table[:n] = kinds
    table = np.ascontiguousarray(table.reshape(chunks, chunk).T)
    entry = np.zeros(chunks, np.uint8)
    if chunks > 1:
        entry[1:] = prefix_scan(chunk_maps(table))[FRESH, :-1]
    state, said = entry, np.empty_like(table)
    for i in range(chunk):
        at = (state << 4) | table[i]
        said[i] = marks[at]
        state = after[at]
    said = said.T.reshape(-1)[:n]
    flags = (said & HERE).astype(bool)
    early = np.flatnonzero(said & EARLIER) - 1
    flags[early[early >= 0]] = True
    return np.flatnonzero(flags)


class WordCounter:
    """The word transducer of a vocabulary; its first ``MOST_STATES`` states are compiled when reached.

    A state is a node of the string automaton and, for the place before every suffix that a vocabulary string may
    still continue, the last token there and its count against the count here.  Nothing else can matter to later bytes.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.order = [-1] * len(vocab.strings)
        for token, (rank, _, _) in vocab.parts.items():
            self.order[token] = rank
        self._automaton()
        self.pairs: dict[int, bool] = {}
        self.states: dict[tuple, int] = {(0, (-1,), (0,)): 0}
        self.keys: list[tuple] = list(self.states)
        self.moves: list[dict[int, tuple[int, int]]] = [{}]

    def _automaton(self) -> None:
        """Trie with failure links over the vocabulary strings; for each node the strings that end there, longest first,
        and the lengths of the suffixes that lie in the trie, shortest first."""
        child: list[dict[int, int]] = [{}]
        token, depth = [-1], [0]
        for s, i in sorted((self.vocab.strings[i], i) for i in self.vocab.ids.values()):
            node = 0
            for b in s:
                to = child[node].get(b)
                if to is None:
                    to = child[node][b] = len(child)
                    child.append({})
                    token.append(-1)
                    depth.append(depth[node] + 1)
                node = to
            token[node] = i
        fail, ends = [0] * len(child), [()] * len(child)
        open_: list[tuple[int, ...]] = [(0,)] * len(child)
        queue = [0]
        for node in queue:
            for b, to in child[node].items():
                if node:
                    f = fail[node]
                    while f and b not in child[f]:
                        f = fail[f]
                    fail[to] = child[f].get(b, 0)
                own = ((token[to], depth[to]),) if token[to] >= 0 else ()
                ends[to] = own + ends[fail[to]]
                # A suffix that no string continues needs no memory.
                open_[to] = (*open_[fail[to]], depth[to]) if child[to] else open_[fail[to]]
                queue.append(to)
        self.child, self.fail, self.ends, self.open = child, fail, ends, open_

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens apart: undo their merges from the seam, latest first; none that
        crosses the seam may come earlier than what has been undone."""
        a, b, bound, out = left, right, None, True
        order, parts, merges = self.order, self.vocab.parts, self.vocab.merges
        while True:
            m = merges.get((a, b))
            if m is not None and (bound is None or m[0] < bound[0] or (m[0] == bound[0] and bound[1])):
                out = False
                break
            if order[a] < 0 and order[b] < 0:
                break
            # A crossing merge of the same rank comes first only left of what it competes with.
            if order[a] > order[b]:
                bound = (order[a], False)
                a = parts[a][2]
            else:
                bound = (order[b], True)
                b = parts[b][1]
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        self.pairs[left * len(order) + right] = out
        return out

    def fits(self, left: int, right: int) -> bool:
        known = self.pairs.get(left * len(self.order) + right)
        return self.compatible(left, right) if known is None else known

    def step(self, node: int, byte: int) -> int:
        child, fail = self.child, self.fail
        while node and byte not in child[node]:
            node = fail[node]
        return child[node].get(byte, 0)

    def _compile(self, state: int, byte: int) -> tuple[int, int] | None:
        """The transition (state, change of the token count), or None where no further state may be compiled."""
        if len(self.keys) >= MOST_STATES:
            return None
        node, last, counts = self.keys[state]
        at = dict(zip(self.open[node], zip(last, counts, strict=True), strict=True))
        node = self.step(node, byte)
        for t, size in self.ends[node]:
            before, count = at[size - 1]
            if before < 0 or self.fits(before, t):
                delta = count + 1
                break
        else:
            raise ValueError("no vocabulary string fits")
        kept = [(t, 0) if k == 0 else (at[k - 1][0], at[k - 1][1] - delta) for k in self.open[node]]
        key = (node, tuple(t for t, _ in kept), tuple(c for _, c in kept))
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.keys)
            self.keys.append(key)
            self.moves.append({})
        self.moves[state][byte] = made = (to, delta)
        return made

    def walk(self, word: bytes) -> int:
        """Tokens of one pre-token by the same transitions, none of them stored."""
        ends, pairs, width, step = self.ends, self.pairs, len(self.order), self.step
        child = self.child
        node, last, counts = 0, [-1], [0]
        for b in word:
            to = child[node].get(b)
            node = step(node, b) if to is None else to
            for t, size in ends[node]:
                before = last[-size]
                if before < 0:
                    break
                known = pairs.get(before * width + t)
                if self.compatible(before, t) if known is None else known:
                    break
            else:
                raise ValueError("no vocabulary string fits")
            last.append(t)
            counts.append(counts[-size] + 1)
        return counts[-1]

    def count(self, word: bytes) -> int:
        """Tokens of one pre-token: the sum of the counts that its transitions emit."""
        state = total = 0
        moves = self.moves
        for b in word:
            move = moves[state].get(b) or self._compile(state, b)
            if move is None:
                return self.walk(word)
            state = move[0]
            total += move[1]
        return total


class WordCounts(dict):
    """pre-token -> tokens, run through the transducer when first asked for.

    A full memory becomes the old one, and words asked for again come back from there.
    """

    def __init__(self, counter: WordCounter):
        super().__init__()
        self.counter = counter
        self.old: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        made = self.old.get(word)
        if made is None:
            made = self.counter.count(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            if len(self) >= WORD_MEMORY:
                self.old = dict(self)
                self.clear()
            self[word] = made
        return made


@lru_cache(maxsize=2)
def word_counts(path: str) -> WordCounts:
    return WordCounts(WordCounter(vocabulary(path)))


def count_texts(texts: list[str], path: str) -> np.ndarray:
    """Tokens of every text, by both transducers."""
    vocab, known = vocabulary(path), word_counts(path)
    parts, owner, special = [], [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        for part, token in vocab.segments(t):
            if token >= 0:
                special[i] += 1
            else:
                parts.append(part)
                owner.append(i)
    joined = "\n".join([*parts, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = code_point_classes()[points]
    ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))) - 1
    kinds[ends] = END
    if not len(ends):
        return special
    marks = split_marks(kinds)
    begins = marks[kinds[marks] != END]
    if len(begins):
        # A pre-token ends where the next begins or where its text closes.
        stops = np.minimum(np.append(begins[1:], len(kinds)), ends[np.searchsorted(ends, begins)])
        words = [joined[a:b] for a, b in zip(begins.tolist(), stops.tolist(), strict=True)]
        counts = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        # Counts up to every end of a part, by the scan over what the pre-tokens before it emit.
        scan = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(begins, ends)]
        np.add.at(special, np.asarray(owner), np.diff(scan, prepend=0))
    return special


def count_tokens(docs: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 1024) -> DataFrame:
    """Token counts of every whole text, without begin, end or added special tokens.

    Returns the columns ``keep`` with ``n_bytes`` (UTF-8), ``n_tokens`` and
    ``over_limit`` (more than ``limit`` tokens).  A null or empty text has no
    bytes and no tokens.  Rows are independent of one another: ties and repeated
    rows give repeated results, an empty table an empty result; other columns
    are not read.  Memory: one Arrow batch, bounded state and word memories, and
    the longest text.
    """
    path = path or default_vocabulary()
    small_batches(docs.sparkSession)
    source = docs.select(*keep, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema) + ", n_bytes bigint, n_tokens bigint, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, text)
            sizes = pc.fill_null(pc.binary_length(batch.column(len(keep))), 0).cast(pa.int64())
            counts = [count_texts(texts[a:b], path) for a, b in slices(texts)]
            counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), sizes, pa.array(counts), pa.array(counts > limit)], names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    return source.mapInArrow(run, schema)
