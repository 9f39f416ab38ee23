"""SentencePiece encoding and decoding of merge-type (BPE) models.

The model file is read once on the driver; its table of pieces (a vocabulary,
so bounded) is broadcast. A text's spaces become the word mark, one mark is put
in front, and the text is cut where no merge can cross: before a word's mark,
at line ends if no piece holds one, and around runs of marks. Each cut piece is
encoded exactly:

* an Aho-Corasick automaton finds all vocabulary matches, longest first per place;
* two tokens may stand side by side if undoing their merges, latest first, meets
  no earlier merge across their border (the answer is remembered per pair);
* places from which no compatible token led on are set in a bit field and never
  tried again; the unique compatible sequence is the merge result.

Runs of word marks share one score in such models and are merged left to right
by the agenda itself. Characters outside the vocabulary become byte pieces.

What a worker remembers (ids of words, compatible pairs, runs) is bounded by bytes
or entries, however many and however long the words are; forgotten words are
encoded again.

Defined cases: a null or empty text has no ids and decodes to the empty text; a
word mark in a text counts as a space, as in the library; repeated rows are
encoded alike; texts of any length are encoded whole.
"""

from __future__ import annotations

import heapq
import re
import struct
from hashlib import blake2b
from sys import getsizeof

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cadence.llm.common import pick, ship

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Bytes of the newer of a Python worker's two word caches; when full it becomes the older one.
CACHE_BYTES = 24 << 20
#: Remembered answers of which tokens may stand side by side, and the longest remembered run of marks.
PAIRS, LONGEST_RUN = 300_000, 1_000
MAX_BYTES = 2 << 20


def _fields(raw: bytes):
    """Fields of a protocol-buffer message: ``(number, value)``."""
    at, n = 0, len(raw)

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = raw[i]
            value |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return value, i

    while at < n:
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = raw[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = raw[at : at + size], at + size
        else:
            raise ValueError("not a SentencePiece model")
        yield tag >> 3, value


def load(path: str) -> dict:
    """The tables of a merge-type model with the identity normalizer."""
    with open(path, "rb") as f:
        raw = f.read()
    pieces, prefix = [], True
    for number, value in _fields(raw):
        if number == 1:
            x = dict(_fields(value))
            pieces.append((x[1].decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
        elif number == 2:
            if dict(_fields(value)).get(3, 1) != 2:
                raise ValueError("only merge-type (BPE) models are supported")
        elif number == 3:
            x = dict(_fields(value))
            prefix = bool(x.get(3, 1))
            if x.get(2) or x.get(4, 1) or not x.get(5, 1) or not prefix:
                raise ValueError("only identity normalizers with a word mark in front are supported")
    if any(kind not in (NORMAL, UNKNOWN, CONTROL, BYTE) for _, _, kind in pieces):
        raise ValueError("user-defined and unused pieces are not supported")
    return {"pieces": pieces}


class Encoder:
    def __init__(self, tables: dict):
        pieces = tables["pieces"]
        self.pieces = pieces
        self.vocab = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.score = [s for _, s, _ in pieces]
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.value = {i: b for b, i in self.byte.items()}
        self.unknown = next((i for i, x in enumerate(pieces) if x[2] == UNKNOWN), 0)
        self.chars = {p for p in self.vocab if len(p) == 1}
        in_pieces = {c for p in self.vocab for c in p}
        cut = r"\n" if "\n" not in in_pieces else ""
        word, stop = f"[^ {cut}]", f"|{cut}" if cut else ""
        # letters are cut from other signs where no piece holds both, so "word," is "word" and ",";
        # letter-like signs that a piece holds beside others count as others
        letter, glue = re.compile(r"[^\W\d_]"), set()
        for p in self.vocab:
            alpha = [c for c in p if letter.match(c)]
            if alpha and any(c != MARK and not letter.match(c) for c in p):
                glue |= set(alpha)
        x = "".join(map(re.escape, sorted(glue)))
        body = rf" ?(?:[^\W\d_{x}]+|(?:(?![ {cut}])[\W\d_{x}])+)" if len(glue) <= 64 else f" ?{word}+"
        self.cutter = re.compile(f"{body}{stop}| +(?= {word})| +")
        # how each piece comes about: its last merge; pieces that merging cannot reach are left out
        self.parts: dict[int, tuple[int, int]] = {}
        self.usable: dict[str, int] = {}
        self.ordered = True
        for p, i in self.vocab.items():
            if len(p) == 1:
                self.usable[p] = i
                continue
            tokens, last = self._agenda(p)
            if tokens == [i]:
                self.usable[p] = i
                self.parts[i] = last
                if set(p) != {MARK}:
                    self.ordered &= all(x not in self.parts or self.score[x] > self.score[i] for x in last)
        self.find = ahocorasick.Automaton()
        self.size = [len(p) for p, _, _ in pieces]
        self.shorter = [-1] * len(pieces)  # the next shorter usable piece that starts a piece
        for p, i in self.usable.items():
            self.find.add_word(p, (len(p), i))
            self.shorter[i] = next((self.usable[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.usable), -1)
        self.find.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.runs: dict[int, list[int]] = {}
        self.lone = self.vocab.get(MARK)
        self.odd: dict[str, str] = {}  # words that do not decode to themselves
        self.odd_bytes = 0
        outer = self

        class Ids(dict):
            older: dict = {}
            room = CACHE_BYTES

            def __missing__(self, word: str) -> str:
                out = self.older.pop(word, None)
                if out is None:
                    ids = outer.word(word.replace(" ", MARK))
                    plain = outer.plain(ids)
                    if plain != word and word not in outer.odd:
                        outer.odd[word] = plain
                        outer.odd_bytes += getsizeof(word) + getsizeof(plain) + 64
                    out = ",".join(map(str, ids))
                size = getsizeof(word) + getsizeof(out) + 64  # with its place in the dictionary
                if size > CACHE_BYTES >> 6:
                    return out
                self.room -= size
                if self.room < 0:
                    self.older, self.room = dict(self), CACHE_BYTES - size
                    self.clear()
                self[word] = out
                return out

        self.ids_of = Ids()

    def _agenda(self, s: str) -> tuple[list[int], tuple[int, int] | None]:
        """Merging by score, then by place; the tokens and the last merge."""
        tok: list[str | None] = list(s)
        nxt, prv = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        heap: list = []
        last = None

        def push(a: int) -> None:
            b = nxt[a] if a >= 0 else len(s)
            if a >= 0 and b < len(s):
                i = self.vocab.get(tok[a] + tok[b])
                if i is not None:
                    heapq.heappush(heap, (-self.score[i], a, b, tok[a], tok[b]))

        for a in range(len(s) - 1):
            push(a)
        while heap:
            _, a, b, x, y = heapq.heappop(heap)
            if tok[a] != x or tok[b] != y or nxt[a] != b:
                continue
            last = (self.vocab[x] if x in self.vocab else -1, self.vocab[y] if y in self.vocab else -1)
            tok[a], tok[b] = x + y, None
            nxt[a] = nxt[b]
            if nxt[a] < len(s):
                prv[nxt[a]] = a
            push(prv[a])
            push(a)
        return [self.vocab.get(t, -1) for t in tok if t is not None], last

    def _compatible(self, key: int) -> bool:
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        good = self.pairs[key] = self._remerge(key >> 32, key & 0xFFFFFFFF)
        return good

    def _remerge(self, a: int, b: int) -> bool:
        if not self.ordered:
            return self._agenda(self.pieces[a][0] + self.pieces[b][0])[0] == [a, b]
        score, parts, text = self.score, self.parts, self.pieces
        bar, strict = None, False
        while True:
            across = self.vocab.get(text[a][0] + text[b][0])
            if across is not None and (bar is None or score[across] > bar or (score[across] == bar and not strict)):
                return False
            # undo the later of the two merges; with equal scores the left one came first
            if b in parts and (a not in parts or score[b] <= score[a]):
                bar, strict, b = score[b], False, parts[b][0]
            elif a in parts:
                bar, strict, a = score[a], True, parts[a][1]
            else:
                return True

    def known(self, s: str) -> list[int]:
        """Tokens of a text whose characters are all in the vocabulary."""
        whole = self.usable.get(s)
        if whole is not None:
            return [whole]
        n, size, shorter, pairs = len(s), self.size, self.shorter, self.pairs
        longest = [-1] * (n + 1)
        for end, (length, i) in self.find.iter(s):  # ends ascend: the last match from a place is its longest
            longest[end - length + 1] = i
        out: list[int] = []
        p, i, failed = 0, longest[0], 0
        while p < n:
            while i >= 0:
                end = p + size[i]
                if not failed >> end & 1:
                    if not out:
                        break
                    key = out[-1] << 32 | i
                    good = pairs.get(key)
                    if good is None:
                        good = self._compatible(key)
                    if good:
                        break
                i = shorter[i]
            if i >= 0:
                out.append(i)
                p, i = end, longest[end]
            else:
                failed |= 1 << p
                last = out.pop()
                p -= size[last]
                i = shorter[last]
        return out

    def run(self, n: int) -> list[int]:
        """Tokens of ``n`` word marks in a row."""
        if n > LONGEST_RUN:
            return self._agenda(MARK * n)[0]
        if n not in self.runs:
            self.runs[n] = self._agenda(MARK * n)[0]
        return self.runs[n]

    def word(self, s: str) -> list[int]:
        if s[0] == MARK and s[-1] == MARK:
            return self.run(len(s))
        if self.chars.issuperset(s):
            return self.known(s)
        out, run = [], ""
        for c in s:
            if c in self.chars:
                run += c
                continue
            if run:
                out += self.known(run)
                run = ""
            out += [self.byte.get(b, self.unknown) for b in c.encode()]
        return out + (self.known(run) if run else [])

    def encode(self, text: str) -> tuple[str, str]:
        """Decimal ids joined by commas, and the text that they decode to."""
        if not text:
            return "", ""
        if self.odd_bytes > CACHE_BYTES:  # between texts: a text needs all its odd words at once
            self.odd, self.odd_bytes, self.ids_of = {}, 0, type(self.ids_of)()
        text = text.replace(MARK, " ")
        cut = self.cutter.findall(" " + text)
        if "  " in text or text[0] == " ":
            cut = self._joined(cut)
        ids = ",".join(map(self.ids_of.__getitem__, cut))
        plain = "".join([self.odd.get(w, w) for w in cut] if self.odd else cut)
        return ids, plain[1:] if plain[:1] == " " else plain

    def _joined(self, cut: list[str]) -> list[str]:
        """A word whose mark stays alone gives it to the run of marks before it."""
        out: list[str] = []
        for w in cut:
            if out and set(out[-1]) == {" "} and w[0] == " " and len(w) > 1 and self.word(w.replace(" ", MARK))[0] == self.lone:
                out[-1] += " "
                w = w[1:]
            out.append(w)
        return out

    def plain(self, ids: list[int]) -> str:
        """Surface of the ids; word marks become spaces, broken bytes U+FFFD."""
        out, raw = [], b""
        for i in ids:
            if i in self.value:
                raw += bytes([self.value[i]])
                continue
            if raw:
                out.append(_utf8(raw))
                raw = b""
            p, _, kind = self.pieces[i]
            if kind == NORMAL:
                out.append(p)
            elif kind == UNKNOWN:
                out.append(" ⁇ ")
        if raw:
            out.append(_utf8(raw))
        return "".join(out).replace(MARK, " ")

    def decode(self, ids: list[int]) -> str:
        s = self.plain(ids)
        return s[1:] if s[:1] == " " else s


def _utf8(raw: bytes) -> str:
    """Valid characters, and one U+FFFD for every byte that is in none."""
    out, i = [], 0
    while i < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + size].decode())
                i += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_READY: dict[str, Encoder] = {}


def ready(digest: str, tables) -> Encoder:
    """The worker's encoder of a model, kept with its word cache from task to task.

    Tasks get functions defined inside others by value, with empty copies of what
    these name; this one they import, so its dictionary is the worker's own.
    """
    if digest not in _READY:
        _READY.clear()
        _READY[digest] = Encoder(tables.value)
    return _READY[digest]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, decoded)`` per row; ``ids`` are decimal, joined by commas."""
    spark = docs.sparkSession
    ship(spark)
    tables = spark.sparkContext.broadcast(load(model_path))
    with open(model_path, "rb") as f:
        digest = blake2b(f.read()).hexdigest()

    def run(batches):
        enc = ready(digest, tables)
        for b in batches:
            texts, ident = b.column("text"), b.column("doc_id")
            i, n = 0, b.num_rows
            while i < n:
                ids, plain, size, j = [], [], 0, i
                while j < n and size < MAX_BYTES:
                    t = texts[j].as_py() or ""
                    a, p = enc.encode(t)
                    ids.append(a)
                    plain.append(p)
                    size += len(t)
                    j += 1
                yield pa.RecordBatch.from_arrays(
                    [ident.slice(i, j - i), pa.array(ids, pa.string()), pa.array(plain, pa.string())], ["doc_id", "ids", "decoded"]
                )
                i = j

    d = pick(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return d.mapInArrow(run, "doc_id long, ids string, decoded string")
