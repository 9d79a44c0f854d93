"""Token counts by a compiled finite-state transducer (operator 2)."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters in a chunk: the unit that is counted on its own before the state maps are composed.
CHUNK = 1 << 16
#: Characters of a whole-word transition, and how many of these a worker keeps; others are walked, and beyond that number they
#: are forgotten and made again. Counts don't depend on it.
WORD_CHARS, KEPT = 64, 400_000
#: Characters before a cut that are read for the states in which a chunk may be entered.
LOOK = 128
#: White space at which the machine is in its start state whatever came before it.
SYNC = " \t\n\r\x0b\x0c"
#: ASCII signs that only ever lengthen a run of signs, whatever stands beside them in it.
SIGNS = frozenset('!"#$%&()*+,-./:;=?@[\\]^_`{}~')
#: A state of the machine: a suffix that begins some token; at each of its positions the last token and the relative count.
State = tuple[str, tuple, tuple]
START: State = ("", (None,), (0,))



def newer_letters(path: str) -> dict[str, str]:
    """Letters that this Python doesn't know yet, as the vocabulary's library lower-cases them: its tables may be of a later Unicode."""
    from tokenizers import Tokenizer

    unknown = [chr(c) for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) == "Cn"]
    lower = Tokenizer.from_file(path).normalizer.normalize_str("a".join(unknown)).split("a")
    return {c: low for c, low in zip(unknown, lower, strict=True) if c != low}


class Transducer:
    """Deterministic transducer of a byte-pair vocabulary with word ends, whose transitions carry emitted-token counts.

    A state after some symbols of a word is what later tokens can still depend on: the longest suffix that begins some
    token and, at each of its positions, the last token of the encoding up to there with the count relative to now. That a
    token may follow another is read off the merges: the two are neighbours in the encoding of their concatenation. A
    transition's count is the change in tokens; changes sum up to the tokens of the word. States and transitions are
    compiled when first met and kept; paths of whole words are kept as one transition.
    """

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab = set(model["vocab"])
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {tuple(p): i for i, p in enumerate(pairs)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        newer = newer_letters(path)
        self.newer, self.has_newer = str.maketrans(newer), re.compile(f"[{''.join(newer) or 'a'}]").search
        inner = {t for t in self.vocab if not t.endswith(self.end) or t == self.end}
        self.prefix = {t.removesuffix(self.end)[:i] for t in self.vocab for i in range(1, len(t.removesuffix(self.end)))} | {t for t in inner}
        self.longest = max(map(len, self.prefix)) + 1
        self.fits: dict[tuple[str, str], bool] = {}
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.moves: list[dict[str, tuple[int, int]]] = []
        self.ends: list[dict[str, int]] = []
        self.start = self._state(START)
        self.words = _Words(self._walk)
        self.letters = _byte_letters()
        import regex

        cut = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(cut).findall
        self.specials = regex.compile("|".join(map(regex.escape, self.special))).split if self.special else None

    def merge(self, symbols: list[str]) -> list[str]:
        """Byte-pair encoding of symbols by the merge list itself; used to decide which tokens may be neighbours."""
        symbols = list(symbols)
        while len(symbols) > 1:
            best = min(((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False))))
            if best[0] == 1 << 60:
                break
            i = best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def _symbols(self, token: str) -> list[str]:
        body = token.removesuffix(self.end) if token != self.end else token
        out = list(body)
        if body != token:
            out[-1] += self.end
        return out

    def _follows(self, a: str | None, b: str) -> bool:
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) > KEPT:
                self.fits.clear()
            got = self.merge((self._symbols(a) if a else []) + self._symbols(b)) == ([a, b] if a else [b])
            self.fits[a, b] = got
        return got

    def _state(self, key: tuple) -> int:
        if key not in self.states:
            self.states[key] = len(self.keys)
            self.keys.append(key)
            self.moves.append({})
            self.ends.append({})
        return self.states[key]

    def _last(self, key: tuple, symbol: str, end: str) -> tuple[str, int]:
        """The token that ends with ``symbol`` and the tokens up to it, less those counted so far."""
        seen, tokens, counts = key
        text = seen + symbol
        for n in range(len(text), 0, -1):
            token = text[-n:] + end
            if token in self.vocab and self._follows(tokens[len(text) - n], token):
                return token, counts[len(text) - n] + 1
        raise ValueError(f"no token ends with {symbol!r}")

    def _move(self, state: int, symbol: str) -> tuple[int, int]:
        key = self.keys[state]
        token, count = self._last(key, symbol, "")
        seen, tokens, counts = key[0] + symbol, (*key[1], token), (*key[2], count)
        while seen and seen not in self.prefix:
            seen, tokens, counts = seen[1:], tokens[1:], counts[1:]
        move = self._state((seen, tokens, tuple(c - count for c in counts))), count
        self.moves[state][symbol] = move
        return move

    def _bytes(self, word: str) -> str:
        return "".join(map(self.letters.__getitem__, word.encode("utf-8")))

    def _run(self, state: State, symbols: str, closes: bool) -> tuple[State, int]:
        """The state after ``symbols`` of a word, and the tokens on that path; ``closes``: the word ends with them."""
        if len(self.keys) > KEPT:
            self.states, self.keys, self.moves, self.ends = {}, [], [], []
            self.start = self._state(START)
        at, total, moves = self._state(state), 0, self.moves
        for s in symbols[:-1] if closes else symbols:
            move = moves[at].get(s) or self._move(at, s)
            at = move[0]
            total += move[1]
        if not closes:
            return self.keys[at], total
        last = symbols[-1]
        final = self.ends[at].get(last)
        if final is None:
            final = self.ends[at][last] = self._last(self.keys[at], last, self.end)[1]
        return START, total + final

    def _walk(self, word: str) -> int:
        """Tokens of one word: the sum of the counts on its path."""
        return self._run(START, self._bytes(word), True)[1]

    def _pieces(self, text: str) -> Iterator[list[str]]:
        """The words of a text, normalised, in the stretches between special strings."""
        for part in self.specials(text) if self.specials and "<|" in text else [text]:
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                if self.newer and self.has_newer(part):
                    part = part.translate(self.newer)
            yield self.split(part.lower())

    def _sum(self, words: list[str]) -> int:
        n = sum(map(self.words.__getitem__, words))
        if len(self.words) > KEPT:
            self.words.clear()
        return n

    def tokens(self, text: str) -> int:
        """Tokens of a text, from start state to end."""
        counts = [self._sum(words) for words in self._pieces(text)]
        return sum(counts) + len(counts) - 1

    def _inside(self, text: str, i: int) -> bool:
        """True where a cut before character ``i`` falls within a word, and both sides are split as the whole text is."""
        near = text[i - 3 : i + 1]
        if i < 3 or "<|" in text[max(0, i - 20) : i + 1] or (i > 3 and text[i - 4] in "'’"):
            return False
        return all(c in SIGNS for c in near) or all(map(_plain, near))

    def cuts(self, text: str, chunk: int) -> list[tuple[int, bool]]:
        """Where a text is cut: the next white space after every ``chunk`` characters, or, where a word goes on for ``LOOK``
        characters more, within that word (true)."""
        out, i = [], chunk
        while i < len(text):
            for at in range(i, len(text)):
                if text[at] in SYNC or (at - i >= LOOK and self._inside(text, at)):
                    out.append((at, text[at] not in SYNC))
                    break
            else:
                break
            i = at + chunk
        return out

    def entries(self, text: str, cut: int) -> set[State]:
        """States in which the chunk from a cut within a word may be entered, by the characters before: the word's own if it
        begins among these, else those of all words that may begin at one of the first places read."""
        from_, word = max(0, cut - LOOK), ""
        for words in self._pieces(text[from_:cut]):
            word = words[-1] if words else ""
        symbols = self._bytes(word)
        if from_ == 0 or len(symbols) < len(self._bytes(text[from_:cut].lower())):
            return {self._run(START, symbols, False)[0]}
        return {self._run(START, symbols[q:], False)[0] for q in range(min(self.longest, len(symbols)))}

    def chunk(self, text: str, begin: int = 0, end: int | None = None, within: bool = False, goes_on: bool = False) -> StateMap:
        """The state map of the chunk ``text[begin:end]``, whose first word goes on one before it (``within``) and whose last
        word goes on after it (``goes_on``): a table over the states it may be entered in. A state that the table lacks
        is followed when it comes up, so the map holds for every state."""
        stretches = list(self._pieces(text[begin:end]))
        count = len(stretches) - 1
        head = tail = None
        if goes_on:
            tail = self._bytes(stretches[-1].pop())
        if within and stretches[0]:
            head = self._bytes(stretches[0].pop(0))
        elif within:
            head, tail = tail, None
        count += sum(map(self._sum, stretches))
        whole = goes_on and tail is None  # one word, open on both sides
        after, more = self._run(START, tail, False) if tail is not None else (START, 0)

        def follow(entry: State) -> tuple[State, int]:
            if head is None:
                return after, count + more
            state, n = self._run(entry, head, not whole)
            return (state, n) if whole else (after, n + count + more)

        return StateMap({e: follow(e) for e in (self.entries(text, begin) if within else (START,))}, follow)

    def running(self, text: str, chunk: int = CHUNK) -> list[tuple[int, int]]:
        """Where each chunk of a text ends, and the tokens up to there less those still open: the prefix scan of state maps."""
        cuts = [(0, False), *self.cuts(text, chunk), (len(text), False)]
        maps = [self.chunk(text, a, b, within, on) for (a, within), (b, on) in zip(cuts, cuts[1:], strict=False)]
        return [(b, m.at(START)[1]) for (b, _), m in zip(cuts[1:], scan(maps, compose), strict=True)]

    def count(self, text: str | None, chunk: int = CHUNK) -> int:
        """Tokens of a whole text; long ones by chunks whose maps are composed by prefix scan."""
        if not text:
            return 0
        return self.tokens(text) if len(text) <= chunk else self.running(text, chunk)[-1][1]


class StateMap(NamedTuple):
    """What a chunk does to the state that it is entered in: the state it is left in and the tokens it adds. ``table`` has the
    states that the characters before admit, mostly one; ``follow`` answers for any other."""

    table: dict[State, tuple[State, int]]
    follow: Callable[[State], tuple[State, int]]

    def at(self, entry: State) -> tuple[State, int]:
        return self.table.get(entry) or self.follow(entry)


def compose(a: StateMap, b: StateMap) -> StateMap:
    """The map of two neighbouring chunks; associative."""

    def follow(entry: State) -> tuple[State, int]:
        state, n = a.at(entry)
        after, more = b.at(state)
        return after, n + more

    return StateMap({e: follow(e) for e in a.table}, follow)


def _plain(c: str) -> bool:
    """Letters that no normalisation or lower-casing changes or joins with a neighbour, save for ASCII's case."""
    if c < "\x80":
        return c.isalpha()
    return c <= "\uffff" and not "\u1100" <= c <= "\u11ff" and unicodedata.category(c) in ("Ll", "Lo") and unicodedata.normalize("NFC", c) == c == c.lower()


def scan(maps: list, compose: Callable) -> list:
    """Inclusive prefix scan by recursive pairing: the maps of all prefixes, composed in logarithmic depth."""
    if len(maps) < 2:
        return list(maps)
    pairs = scan([compose(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)], compose)
    out = [maps[0]]
    for i in range(1, len(maps)):
        out.append(pairs[i // 2] if i % 2 else compose(pairs[i // 2 - 1], maps[i]))
    return out


class _Words(dict):
    def __init__(self, walk: Callable[[str], int]):
        super().__init__()
        self.walk = walk

    def __missing__(self, word: str) -> int:
        n = self.walk(word)
        if len(word) <= WORD_CHARS:
            self[word] = n
        return n


def _byte_letters() -> list[str]:
    """Letters that stand for bytes in byte-level vocabularies: printable bytes for themselves, the others from 256 on."""
    out, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


@lru_cache(maxsize=2)
def compiled(path: str) -> Transducer:
    """The worker's transducer of a vocabulary file; one for each process."""
    return Transducer(path)


def token_count(text: Column, path: str, chunk: int = CHUNK) -> Column:
    """Tokens of a text column under the vocabulary file ``path``, which every machine has; null counts 0."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = compiled(path)
        for texts in batches:
            yield pd.Series([machine.count(t, chunk) for t in texts], dtype="int64")

    return counted(text)


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 2048, chunk: int = CHUNK) -> DataFrame:
    """Add n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) to every row; nothing is dropped or shuffled.

    Whole texts are counted as the vocabulary's own library does, without added begin and end tokens; special strings in a
    text count as one token each. Null texts count as empty: 0 bytes, 0 tokens. Input columns named like an output
    give way to it.
    """
    own = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    n = docs.select(*own, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), token_count(F.col(text), path, chunk).alias("n_tokens"))
    return n.withColumn("over_limit", F.col("n_tokens") > limit)
