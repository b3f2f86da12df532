"""BPE with word ends, encoded and decoded in batches: merge rounds over the symbols of many words in flat arrays.

Texts are cut at white space; cuts that have been encoded before are found by their hash. The words of all new cuts of
a batch go through the merge rounds together: a binary search over sorted pair keys gives each adjacent pair's rank,
each word merges its lowest-rank pair, until no word has a pair left. Ids stay in flat arrays up to the output.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.arrowtext import WHITE, Hasher, pieces, runs, tidy
from tarnlake.llm.store import fresh, kind

#: Cuts that a worker remembers at most (some 30 bytes each); then it starts anew.
REMEMBERED = 500_000

#: Bytes of text that are worked on at once.
PIECE = 1 << 20

#: White space beyond ASCII, as the tokenizer's patterns have it.
_FAR_SPACE = regex.compile(r"[^\P{White_Space}\x00-\x7f]")
_NEVER = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself where it prints, else one from 256 on."""
    prints = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    rest = [b for b in range(256) if b not in set(prints)]
    out = [""] * 256
    for b in prints:
        out[b] = chr(b)
    for k, b in enumerate(rest):
        out[b] = chr(256 + k)
    return out


class WordBpe:
    """`spec` is the parsed tokenizer file: BPE over byte letters with an end-of-word suffix, NFC and lower case before."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        letters = byte_letters()
        self.inside = np.array([vocab.get(c, -1) for c in letters], np.int64)
        self.final = np.array([vocab.get(c + self.suffix, -1) for c in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = np.array([vocab[a] for a, _ in merges], np.int64), np.array([vocab[b] for _, b in merges], np.int64)
        keys, made = left << 32 | right, np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.words = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.marks = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.numbers = self._table([str(i) for i in range(len(self.tokens))])
        self.shown = self._table(self.tokens)
        self.forget()

    @staticmethod
    def _table(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each string with a space behind it: all bytes, where each begins, how long it is."""
        each = [t.encode() + b" " for t in strings]
        size = np.array([len(t) for t in each], np.int64)
        return np.frombuffer(b"".join(each), np.uint8), np.cumsum(size) - size, size

    def forget(self) -> None:
        self.hashes, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    @classmethod
    def load(cls, path: str) -> WordBpe:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and where each word's ids end. Bytes whose letter isn't in the vocabulary are left out, as the library does without an unknown token."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = np.array([len(w) for w in words], np.int64)
        symbols = np.frombuffer(b"".join(words), np.uint8)
        end = np.zeros(len(symbols), bool)
        end[np.cumsum(size)[size > 0] - 1] = True
        ids = np.where(end, self.final[symbols], self.inside[symbols])
        word = np.repeat(np.arange(len(words)), size)
        ids, word = ids[ids >= 0], word[ids >= 0]
        done_ids, done_word = [], []
        while len(ids):
            key = ids[:-1] << 32 | ids[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(ids), _NEVER)
            rank[:-1] = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], _NEVER)
            begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, begins)
            length = np.diff(np.append(begins, len(ids)))
            over = np.repeat(least == _NEVER, length)
            if over.any():  # words without a pair are finished
                done_ids.append(ids[over])
                done_word.append(word[over])
            pick = (rank == np.repeat(least, length)) & ~over
            # of overlapping picks (equal letters in a row) the first, third, ... of each run count
            run = np.flatnonzero(pick & ~np.append(False, pick[:-1]))
            where = np.flatnonzero(pick)
            keep = (where - run[np.searchsorted(run, where, "right") - 1]) % 2 == 0
            where = where[keep]
            ids = ids.copy()
            ids[where] = self.made[at[where]]
            stay = ~over
            stay[where + 1] = False
            ids, word = ids[stay], word[stay]
        ids, word = np.concatenate([*done_ids, np.zeros(0, np.int64)]), np.concatenate([*done_word, np.zeros(0, np.int64)])
        order = np.argsort(word, kind="stable")
        return ids[order], np.cumsum(np.bincount(word, minlength=len(words)))

    def learn(self, hashes: np.ndarray, cuts: list[str]) -> None:
        """Remembers the ids of cuts (texts without white space), to be found by their hashes."""
        if len(self.hashes) + len(cuts) > REMEMBERED:
            self.forget()
        place: dict[str, int] = {}
        parts, per = [], np.ones(len(cuts), np.int64)
        for k, c in enumerate(cuts):
            if c.isalpha():  # the two usual cases, as the pattern takes them apart
                parts.append(place.setdefault(c, len(place)))
            elif c[-1] in ".,;:!?" and c[:-1].isalpha():
                parts += (place.setdefault(c[:-1], len(place)), place.setdefault(c[-1], len(place)))
                per[k] = 2
            else:
                found = self.words.findall(c)
                parts += [place.setdefault(w, len(place)) for w in found]
                per[k] = len(found)
        ids, ends = self.merged([w.encode() for w in place])
        size = np.diff(ends, prepend=0)
        parts = np.array(parts, np.int64)
        count = np.bincount(np.repeat(np.arange(len(cuts)), per), size[parts], len(cuts)).astype(np.int64)
        base, at = len(self.begin), len(self.flat)
        self.flat = np.concatenate([self.flat, ids[stretches((ends - size)[parts], size[parts])].astype(np.int32)])
        self.begin = np.concatenate([self.begin, at + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        hashes, entry = np.concatenate([self.hashes, hashes]), np.concatenate([self.entry, base + np.arange(len(cuts))])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.entry = hashes[order], entry[order]

    @staticmethod
    def normal(text: str) -> str:
        """The form in which a text is cut."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = _FAR_SPACE.sub(" ", text).replace("Σ", "σ")  # letters are lowered one by one: no final sigma
        return text.lower()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin (one more at the end). Null counts as empty."""
        parts, owner, marks = [], [], []
        for k, t in enumerate(texts):
            t, at = t or "", 0
            if self.marks is not None and "<|" in t:
                for m in self.marks.finditer(t):
                    marks.append((len(parts), self.special[m[0]], k))
                    parts.append(self.normal(t[at : m.start()]))
                    owner.append(k)
                    at = m.end()
            parts.append(self.normal(t[at:]))
            owner.append(k)
        raw = [p.encode() for p in parts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        edges = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        starts, ends, per = runs(~WHITE[data], edges)
        hashes, first, which = np.unique(Hasher(data)(starts, ends), return_index=True, return_inverse=True)
        for _ in range(2):
            at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
            new = self.hashes[at] != hashes if len(self.hashes) else np.ones(len(hashes), bool)
            if not new.any():
                break
            if len(self.hashes) + new.sum() > REMEMBERED:
                self.forget()
                new[:] = True
            self.learn(hashes[new], [data[a:b].tobytes().decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
        entry = self.entry[at][which] if len(hashes) else np.zeros(0, np.int64)
        count = self.count[entry]
        ids = self.flat[stretches(self.begin[entry], count)]
        sums = np.concatenate([[0], np.cumsum(count)])
        part_ends = sums[np.cumsum(per)]
        tokens = np.bincount(owner, np.diff(part_ends, prepend=0), len(texts)).astype(np.int64) if texts else np.zeros(0, np.int64)
        if marks:
            ids = np.insert(ids, [part_ends[m[0]] for m in marks], [m[1] for m in marks])
            tokens += np.bincount([m[2] for m in marks], minlength=len(texts))
        return ids, np.concatenate([[0], np.cumsum(tokens)])

    def joined(self, ids: np.ndarray, edges: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[memoryview]:
        """For each text, the strings of its ids joined by one space, as UTF-8."""
        data, begin, size = table
        out = data[stretches(begin[ids], size[ids])]
        at = np.concatenate([[0], np.cumsum(size[ids])])[edges].tolist()
        view = memoryview(out)
        return [view[a : max(a, b - 1)] for a, b in zip(at[:-1], at[1:], strict=True)]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space: the file names no decoder."""
        return " ".join(self.tokens[i] for i in ids)


def stretches(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... (size of them) of each stretch, one behind the other."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


_LOADED: dict[str, WordBpe] = {}


def encoder(path: str) -> WordBpe:
    """The tokenizer at `path`, read once in each worker; the path must be there on every machine."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe.load(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str, text: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """Adds any of n_tokens (long), ids (array<int>), decoded (string), ids_sha256, decoded_sha256 to every row.

    Null texts count as empty: no tokens, an empty decoded text. Repeated rows get equal values, an empty table gives an
    empty one, and columns named like the outputs are replaced.
    """
    kinds = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    (work,) = fresh(docs, "tl_text")
    out = docs.drop(*outputs).withColumn(work, F.col(text))
    schema = out.drop(work).schema
    for name in outputs:
        schema = schema.add(name, kind(kinds[name]))

    def digests(found: list[memoryview]) -> pa.Array:
        return pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            at = batch.schema.get_field_index(work)
            for piece in pieces(batch, work, PIECE):
                ids, edges = bpe.encode(piece.column(at).to_pylist())
                made = {"n_tokens": lambda: pa.array(np.diff(edges))}
                made["ids"] = lambda: pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32()))
                made["decoded"] = lambda: pa.array([str(x, "utf-8") for x in bpe.joined(ids, edges, bpe.shown)], pa.string())
                made["ids_sha256"] = lambda: digests(bpe.joined(ids, edges, bpe.numbers))
                made["decoded_sha256"] = lambda: digests(bpe.joined(ids, edges, bpe.shown))
                columns = [c for i, c in enumerate(piece.columns) if i != at] + [made[name]() for name in outputs]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return out.mapInArrow(tidy(run), schema)
