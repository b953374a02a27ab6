"""BPE by a deterministic automaton over tokens, built merge by merge, and a table of symbol transitions over it.

At first there is one state, and every symbol's arc leads back to it. Merge
number r of tokens u and v is a gadget: if the state that u's arcs lead to has an
arc for v, that state is copied without v's arc and u's arcs lead to the copy;
and an arc for the new token uv goes from wherever u's arcs began to where v's
led. After all merges each path spells one text in one way, the way BPE cuts it.

A state's row of arcs is shared: a copy is its original, the arc it lacks and
the time it was made; a token's arcs are those of its left half, from the time
it was born. ``Automaton.arc`` reads a row that way and keeps the answer.

``Machine`` is what words are run through, many at a time: for each symbol one
look-up of (state, symbol) in a table. Its states say which token the prefix read so
far ends with, and which tokens may still be completed behind which earlier one;
they are made from the automaton and the tree of the tokens' spellings when a
word first needs them. The tokens are read off the states passed, from the end of
a word to its beginning, and decoding emits the labels of their arcs.

A character that the oldest and the newest Unicode tables at hand do not agree
on sends its text through the vocabulary's own normalizer and splitter, as only
those know what they take it for; the automaton still encodes the words.

Null and empty texts have no tokens. Texts are processed whole, at any length, one
step a symbol. Repeated rows and null ids come back as they are, an empty table
gives no row, other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hushlake.llm.common import tokenizer_path

#: Fixed values of the public vocabulary word_bpe_49k: how it splits a text, and how it marks a word's end.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Words, and pieces of text between blanks, kept with their ids in each Python worker (twice as many at most), up to some length of their labels.
MEMO, MEMO_TEXT = 250_000, 100
#: States of the machine, entries of its table, and answers of the automaton, kept in each Python worker.
STATES, ENTRIES, ARCS = 200_000, 32_000_000, 1_000_000
#: Bytes of a word up to which it goes through the machine together with others.
TOGETHER = 32
#: Below U+0378 every code point has been assigned for long.
_beyond = re.compile("[^\x00-\u0377]").search
#: Ends of chunks that are words of their own behind letters.
MARKS = frozenset(".,;:!?)")
#: Characters that str.split takes for blanks and the vocabulary's splitter does not.
_blanks = re.compile("[\x1c-\x1f]").search


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where Latin-1 prints it, else the next from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Agreed(set):
    """Characters beyond U+0377 that Unicode 3.2 and Python's own tables take for the same."""

    def lacks(self, text: str) -> bool:
        """Whether some character of the text may be another one to the vocabulary's library, whose tables lie between."""
        new = set(text) - self
        if not all(ord(c) < 0x378 or _class(unicodedata.ucd_3_2_0, c) == _class(unicodedata, c) != "Cn" for c in new):
            return True
        self |= new
        return False


def _class(tables, c: str) -> tuple | str:
    category = tables.category(c)
    return category if category == "Cn" else (category, tables.combining(c), tables.decomposition(c))


class Automaton:
    """States and arcs over tokens after all merge gadgets."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> None:
        self.number = vocabulary
        self.width = max(vocabulary.values(), default=0) + 1
        self.halves: list[tuple[int, int] | None] = [None] * self.width
        self.born = [-1] * self.width
        #: Copies: the token whose arcs lead to it and the arc it lacks, and when it was made.
        self.lacks: dict[int, int] = {}
        self.answers: dict[int, bool] = {}
        self.machine: Machine | None = None
        for rank, (u, v) in enumerate(merges):
            self.gadget(rank, vocabulary[u], vocabulary[v], vocabulary[u + v])

    @property
    def n_states(self) -> int:
        return 1 + len(self.lacks)

    def gadget(self, rank: int, u: int, v: int, uv: int) -> None:
        """Copies the state after u without v's arc, and adds the new token's arcs."""
        self.lacks.setdefault(u * self.width + v, rank)
        if self.halves[uv] is None:
            self.halves[uv], self.born[uv] = (u, v), rank

    def arc(self, s: int, t: int) -> bool:
        """Whether the state that s leads to has an arc for t."""
        key = s * self.width + t
        known = self.answers.get(key)
        if known is None:
            if len(self.answers) >= ARCS:
                self.answers.clear()
            known = self.answers[key] = self._row(s, t)
        return known

    def path(self, symbols: list[str]) -> list[int]:
        """The tokens of the one path that spells ``symbols`` (the last one with the word's end)."""
        if self.machine is None:
            self.machine = Machine(self, sorted({x for token in self.number for x in spelling(token)}))
        return self.machine.path([self.machine.symbol[x] for x in symbols])

    def _row(self, s: int, t: int) -> bool:
        """Goes back through the copies that the row is shared with."""
        until, inclusive = 1 << 60, False  # gadgets that count: those before ``until``, or up to it
        while True:
            gone = self.lacks.get(s * self.width + t)
            if gone is not None and (gone < until or inclusive and gone == until):
                return False
            if self.born[t] >= self.born[s] and self.halves[t]:
                until, inclusive, t = self.born[t], True, self.halves[t][0]  # t's arc was added where its left half had one
            elif self.halves[s]:
                until, inclusive, s = self.born[s], False, self.halves[s][1]  # the state was that after s's right half
            else:
                return True


class Machine:
    """Transitions by symbol, compiled from an automaton as words need them.

    A state stands for the pairs (token before, place in the tree of spellings)
    that may still be completed; the last pair's token is the one that the
    prefix ends with. The table has a row for each state and a column for each
    symbol met so far.
    """

    def __init__(self, automaton: Automaton, symbols: list[str]) -> None:
        self.automaton = automaton
        self.symbol = {x: i for i, x in enumerate(x for x in symbols if x in automaton.number)}
        self.kinds = len(self.symbol)
        #: The tree: place and symbol to place; which token ends at a place, and from which places it goes on.
        self.tree: dict[int, int] = {}
        self.token: dict[int, int] = {}
        self.inner: set[int] = {0}
        self.length = np.zeros(automaton.width + 1, np.int32)
        for token, number in automaton.number.items():
            spelled = spelling(token)
            if all(x in self.symbol for x in spelled):
                self.length[number] = len(spelled)
                self._add(spelled, number)
        self.column = np.full(self.kinds, -1, np.int32)
        self.of_column: list[int] = []
        self._clear()

    def _add(self, spelled: list[str], number: int) -> None:
        place = 0
        for x in spelled:
            self.inner.add(place)
            place = self.tree.setdefault(place + self.symbol[x], (len(self.tree) + 1) * self.kinds)
        self.token[place] = number

    def _clear(self) -> None:
        # The first state: no token before, at the tree's root.
        self.open: list[tuple[tuple[int, int], ...]] = [((-1, 0),)]
        self.state = {self.open[0]: 0}
        self.table = np.full((1024, max(1, len(self.of_column))), -1, np.int32)
        self.last = np.full(1024, -1, np.int32)

    def _columns(self, symbols: np.ndarray) -> np.ndarray:
        """The symbols' columns; new ones get one each."""
        new = np.unique(symbols[self.column[symbols] < 0])
        if len(new):
            self.column[new] = np.arange(len(self.of_column), len(self.of_column) + len(new))
            self.of_column += new.tolist()
            more = np.full((len(self.table), len(self.of_column) - self.table.shape[1]), -1, np.int32)
            self.table = np.hstack([self.table, more])
        return self.column[symbols]

    def _compile(self, state: int, column: int) -> None:
        """Enters the transition of a state by a symbol, and the state it leads to if that is new."""
        symbol, tree, ends, pairs = self.of_column[column], self.tree, -1, []
        for before, place in self.open[state]:
            place = tree.get(place + symbol)
            if place is None:
                continue
            if ends < 0:
                token = self.token.get(place, -1)
                if token >= 0 and (before < 0 or self.automaton.arc(before, token)):
                    ends = token
            if place in self.inner:
                pairs.append((before, place))
        key = (*pairs, (ends, 0))
        found = self.state.get(key)
        if found is None:
            found = self.state[key] = len(self.open)
            self.open.append(key)
            if found == len(self.table):
                self.table = np.vstack([self.table, np.full_like(self.table, -1)])
                self.last = np.concatenate([self.last, np.full_like(self.last, -1)])
            self.last[found] = ends
        self.table[state, column] = found

    def path(self, symbols: list[int]) -> list[int]:
        """The tokens of the one path that spells ``symbols``."""
        return self.paths(np.array(symbols, np.int64), np.array([len(symbols)]))[0].tolist()

    def paths(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of several words' paths one after the other, and how many each word has; words have a symbol or more."""
        if len(self.open) >= STATES or self.table.size >= ENTRIES:
            self._clear()
        n, most = len(sizes), int(sizes.max(initial=0))
        order = np.argsort(-sizes, kind="stable")
        begins, ordered = (np.cumsum(sizes) - sizes)[order], sizes[order]
        columns = self._columns(symbols)
        passed, state = np.zeros((most, n), np.int32), np.zeros(n, np.int32)
        open_ = np.searchsorted(-ordered, -np.arange(most), side="left")  # words longer than each place
        for at, some in enumerate(open_):
            here, by = state[:some], columns[begins[:some] + at]
            to = self.table[here, by]
            missing = np.flatnonzero(to < 0)
            if len(missing):
                keys = here[missing].astype(np.int64) * self.kinds + by[missing]
                for key in np.unique(keys).tolist():
                    self._compile(*divmod(key, self.kinds))
                to[missing] = self.table[here[missing], by[missing]]
            state[:some] = passed[at, :some] = to
        # From each word's end back to its beginning, a token of every word at a time.
        left, found, steps = ordered.copy(), [], 0
        while len(own := np.flatnonzero(left)):
            tokens = self.last[passed[left[own] - 1, own]]
            left[own] -= self.length[tokens]
            found.append((own, np.full(len(own), steps), tokens))
            steps += 1
        if not found:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        word, step, tokens = (np.concatenate(x) for x in zip(*found, strict=True))
        word = order[word]
        return tokens[np.lexsort((-step, word))], np.bincount(word, minlength=n)


class Memo:
    """Results by key. When it is full, what was not asked for since the last time is forgotten."""

    def __init__(self) -> None:
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        known = self.young.get(key)
        if known is None and (known := self.old.get(key)) is not None:
            self.keep(key, known)
        return known

    def keep(self, key, value) -> None:
        if len(value[1]) <= MEMO_TEXT:
            if len(self.young) >= MEMO:
                self.young, self.old = {}, self.young
            self.young[key] = value


Result = tuple[bytes, str]


class Tokenizer:
    """Encodes and decodes as the vocabulary's own library does."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        model = stored["model"]
        automaton = Automaton(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        shown = byte_symbols()
        self.machine = Machine(automaton, [*shown, *(x + WORD_END for x in shown)])
        of_symbol = self.machine.symbol
        self.inside, self.end = (np.array([of_symbol.get(x + tail, -1) for x in shown]) for tail in ("", WORD_END))
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        self.labels = {i: t for t, i in {**model["vocab"], **self.special}.items()}
        self.find_special = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)").finditer
        self.split = regex.compile(SPLIT).findall
        self.byte = {x: i for i, x in enumerate(shown)}
        self.path, self.library = path, None
        self.agreed = Agreed()
        self.words, self.chunks = Memo(), Memo()

    def spell(self, listed: list[bytes]) -> Iterator[Result]:
        """Each word's ids (little-endian, 32 bits) and its labels, joined by blanks."""
        for at in range(0, len(listed), 20_000):
            yield from self._spell(listed[at : at + 20_000])

    def _spell(self, listed: list[bytes]) -> Iterator[Result]:
        sizes = np.fromiter(map(len, listed), np.int64, len(listed))
        raw = np.frombuffer(b"".join(listed), np.uint8)
        symbols = self.inside[raw]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.end[raw[ends]]
        if (symbols < 0).any():  # bytes that the vocabulary has no symbol for
            kept = symbols >= 0
            sizes = np.bincount(np.repeat(np.arange(len(listed)), sizes)[kept], minlength=len(listed))
            symbols = symbols[kept]
        ids, counts = self._paths(symbols, sizes)
        joined, names = ids.astype("<u4").tobytes(), self.decoded(ids.tolist())
        at = 0
        for n in counts.tolist():
            yield joined[4 * at : 4 * (at + n)], " ".join(names[at : at + n])
            at += n

    def _paths(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As the machine's, but long words go through it by themselves, so that they do not widen the others' tables."""
        long = sizes > TOGETHER
        if not long.any():
            return self.machine.paths(symbols, sizes)
        begins, of_symbol = np.cumsum(sizes) - sizes, np.repeat(long, sizes)
        short, counts = self.machine.paths(symbols[~of_symbol], sizes[~long])
        parts = dict(zip(np.flatnonzero(~long).tolist(), np.split(short, np.cumsum(counts)[:-1]) if len(counts) else [], strict=True))
        for i in np.flatnonzero(long).tolist():
            parts[i] = self.machine.paths(symbols[begins[i] : begins[i] + sizes[i]], sizes[i : i + 1])[0]
        return np.concatenate([parts[i] for i in range(len(sizes))]), np.array([len(parts[i]) for i in range(len(sizes))])

    def decoded(self, ids: list[int]) -> list[str]:
        """The labels of ids."""
        return list(map(self.labels.__getitem__, ids))

    def pieces(self, text: str) -> list[str | tuple]:
        """What a text is encoded by: chunks between blanks, and words as tuples of one."""
        if _beyond(text) and self.agreed.lacks(text):
            if self.library is None:
                from tokenizers import Tokenizer as Library

                self.library = Library.from_file(self.path)
            own = self.library
            split = own.pre_tokenizer.pre_tokenize_str(own.normalizer.normalize_str(text))
            return [(bytes(map(self.byte.__getitem__, word)),) for word, _ in split]
        # No word holds a blank, so blanks need no normalizing, and texts may be cut there first.
        lower = self.normalized(text)
        return [(word.encode(),) for word in self.split(lower)] if _blanks(lower) else lower.split()

    def normalized(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "".join(map(str.lower, text))

    def parts(self, text: str) -> list[str | tuple]:
        """The same, with the ids of special tokens among them."""
        if "<|" not in text:
            return self.pieces(text)
        found: list = []
        at = 0
        for special in self.find_special(text):
            found += [*self.pieces(text[at : special.start()]), (self.special[special[0]],)]
            at = special.end()
        return found + self.pieces(text[at:])

    def words_of(self, part: str | tuple) -> list[bytes]:
        if isinstance(part, tuple):
            return [] if isinstance(part[0], int) else [part[0]]
        if part.isalpha():
            return [part.encode()]
        if part[-1] in MARKS and part[:-1].isalpha():
            return [part[:-1].encode(), part[-1].encode()]
        return [word.encode() for word in self.split(part)]

    def encode_batch(self, texts: list[str]) -> list[Result]:
        """Of each whole text the ids as bytes, and the text decoded from them. Words that several texts share are spelled once."""
        listed = [self.parts(text) for text in texts]
        known: dict[str | tuple, Result] = {}
        new: dict[str | tuple, list[bytes]] = {}
        for part in dict.fromkeys(chain.from_iterable(listed)):
            found = self.chunks.get(part)
            if found is None:
                new[part] = self.words_of(part)
            else:
                known[part] = found
        words = {word: self.words.get(word) for word in dict.fromkeys(chain.from_iterable(new.values()))}
        unseen = [word for word, found in words.items() if found is None]
        for word, found in zip(unseen, self.spell(unseen), strict=True):
            words[word] = found
            self.words.keep(word, found)
        for part, split in new.items():
            if isinstance(part, tuple) and isinstance(part[0], int):
                found = (part[0].to_bytes(4, "little"), self.labels[part[0]])
            else:
                found = words[split[0]] if len(split) == 1 else _joined([words[word] for word in split])
            known[part] = found
            self.chunks.keep(part, found)
        return [_joined([known[part] for part in parts]) for parts in listed]

    def encode(self, text: str) -> Result:
        return self.encode_batch([text])[0]


def spelling(token: str) -> list[str]:
    """The symbols of a token; the last one carries the word's end."""
    if not token.endswith(WORD_END) or token == WORD_END:
        return list(token)
    inside = token.removesuffix(WORD_END)
    return [*inside[:-1], inside[-1] + WORD_END]


def _joined(parts: list[tuple[bytes, str]]) -> tuple[bytes, str]:
    ids = b"".join([ids for ids, _ in parts])
    # A part without ids (symbols that the vocabulary lacks) has no labels either.
    return ids, " ".join([label for _, label in parts if label])


_WORKER: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One for each Python worker and vocabulary."""
    if path not in _WORKER:
        _WORKER[path] = Tokenizer(path)
    return _WORKER[path]


def encode(docs: DataFrame, vocabulary: str | None = None, digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (array), decoded for every row; with ``digest``, hex SHA-256 of both in place of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary or tokenizer_path("word_bpe_49k.json"))
        for batch in batches:
            found = own.encode_batch([t or "" for t in batch.column(1).to_pylist()])
            sizes = pa.array([len(ids) // 4 for ids, _ in found], pa.int64())
            if digest:
                columns = [
                    pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in found], pa.string()),
                    pa.array([hashlib.sha256(text.encode()).hexdigest() for _, text in found], pa.string()),
                ]
            else:
                ids = [np.frombuffer(ids, "<u4").astype(np.int32) for ids, _ in found]
                columns = [pa.array(ids, pa.list_(pa.int32())), pa.array([text for _, text in found], pa.string())]
            yield pa.record_batch([batch.column(0), sizes, *columns], names=["doc_id", "n_tokens", "ids", "decoded"])

    kinds = "ids string, decoded string" if digest else "ids array<int>, decoded string"
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id long, n_tokens long, {kinds}")
