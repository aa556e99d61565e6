"""BPE with word ends as a streaming transducer of bounded lookahead.

The merge list says how far a merge can depend on what comes later: what is unknown
behind the end of a window changes a token before it only through a chain of merges
of rising rank, each of which takes the token left of the last one. The longest such
chain, in letters, is the list's sufficient lookahead. A word goes through a window of
a few times that length: tokens that end the lookahead before the window's end are
final and are given out, the window moves on behind the last of them, so that a word
of any length takes constant memory. Words shorter than the window, nearly all, are
merged at once, and each distinct one once while a bounded cache remembers it.

What the vocabulary's file rules before that (composition, white space, lower case,
word pattern, special strings) never reaches over ASCII white space, so a text's ids
are those of its chunks without white space. Decoding is a state machine as well: the
bytes of a character that isn't complete wait for the next id.

Defined results: null and empty texts, and those of white space, have no ids; equal
rows are equal; very long words and texts stream. A chunk that isn't plain ASCII is
normalised whole. No rows, no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from mnemograph.llm.common import byte_texts, resident, unused
from mnemograph.llm.pretokens import TwoHalves, byte_alphabet

#: Chunks, and words in them, in either half of their caches.
CHUNKS, PIECES = 400_000, 200_000
#: The window in lookaheads, and letters of it at least.
WINDOW, LEAST_WINDOW = 3, 256
#: Bytes of a text that are cut into chunks at once.
SPAN = 1 << 20
#: The word pattern of the vocabulary on plain lower-case ASCII; a fixed value.
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
NONE = 1 << 62


class MergeList:
    """Ids and merges of a vocabulary file: pairs of ids by rank, single letters, letters that end a word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocabulary, self.end = model["model"]["vocab"], model["model"]["end_of_word_suffix"] or ""
        self.names = {i: name for name, i in vocabulary.items()} | {t["id"]: t["content"] for t in model["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.sides = [(vocabulary[a], vocabulary[b]) for a, b in merges]
        self.made = [vocabulary[a + b] for a, b in merges]
        self.ranks = {pair: rank for rank, pair in reversed(list(enumerate(self.sides)))}
        letters = byte_alphabet()
        self.letter = {c: vocabulary[c] for c in letters if c in vocabulary}
        self.last = {c: vocabulary[c + self.end] for c in letters if c + self.end in vocabulary}
        self.length = {i: len(name.removesuffix(self.end)) if self.end else len(name) for i, name in self.names.items()}
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Letters behind a token that settle it.

        Where two runs first differ is a front. A merge (a, b) moves it left by a if b
        begins at it in one run only; then a, or a token that begins with a, begins at
        the new front. So a chain goes on from (a, b) with a later merge whose right
        side begins with a. Merges of one rank are done in all places before a later
        rank's, which needs both sides of each merge to be made by earlier ones.
        """
        first_side, far = {}, defaultdict(int)
        for rank, (pair, new) in enumerate(zip(self.sides, self.made)):
            if new in first_side or any(side in self.made[rank:] for side in pair if side not in first_side and self.length[side] > 1):
                raise ValueError("a token of the merge list is made twice or used before it is made")
            first_side[new] = pair[0]
        for a, b in self.sides:
            reach, side = 0, b
            while side is not None:
                reach, side = max(reach, far[side]), first_side.get(side)
            far[a] = max(far[a], self.length[a] + reach)
        return max(far.values(), default=0)

    def merged(self, ids: list[int]) -> list[int]:
        """The tokens of a row of letters: the least rank first, from left to right."""
        get = self.ranks.get
        while len(ids) > 1:
            ranks = [get(pair, NONE) for pair in zip(ids, ids[1:])]
            best = min(ranks)
            if best == NONE:
                break
            new, at, n = self.made[best], ranks.index(best), ranks.count(best)
            if n == 1:
                ids[at : at + 2] = [new]
                continue
            out, k, stop = ids[:at], at, len(ranks)
            while k < stop:
                if ranks[k] == best:
                    out.append(new)
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out + ids[k:]
        return ids


class Transducer:
    """One word's ids, given out as soon as they are final. push() its letters in parts, then end()."""

    def __init__(self, merges: MergeList, window: int | None = None):
        self.merges = merges
        self.window = max(window or max(WINDOW * merges.lookahead, LEAST_WINDOW), merges.lookahead + 2)
        self.held: list[int] = []
        self.final = ""

    def push(self, letters: str) -> Iterator[int]:
        """Ids that no later letter can change. The last letter is held back, as it may end the word."""
        if not letters:
            return
        letters, self.final = self.final + letters[:-1], letters[-1]
        letter = self.merges.letter
        for a in range(0, len(letters), self.window):
            self.held += [letter[c] for c in letters[a : a + self.window]]
            while len(self.held) >= self.window:
                yield from self._stable()

    def _stable(self) -> Iterator[int]:
        stop, at = len(self.held) - self.merges.lookahead, 0
        for token in self.merges.merged(self.held[:]):
            if at + self.merges.length[token] > stop:
                break
            yield token
            at += self.merges.length[token]
        if not at:  # one token longer than the window leaves room for
            self.window += self.merges.lookahead
        del self.held[:at]

    def end(self) -> list[int]:
        if not self.final:
            return []
        ids = self.merges.merged([*self.held, self.merges.last[self.final]])
        self.held, self.final = [], ""
        return ids


class Decoder:
    """Text of ids that come one after another; the bytes of an incomplete character wait.

    shown: the tokens' names in the vocabulary's letters with a space between, as the
    library writes them; else the bytes that the letters stand for, a space after each word.
    """

    def __init__(self, merges: MergeList, shown: bool = True):
        alphabet, end = byte_alphabet(), merges.end

        def plain(name: str) -> bytes:
            word = name.removesuffix(end) if end else name
            return bytes(alphabet[c] for c in word) + (b" " if word != name else b"")

        special = set(merges.special.values())
        self.bytes_of = {i: name.encode() if shown or i in special else plain(name) for i, name in merges.names.items()}
        self.between, self.shown = b" " if shown else b"", shown
        self.restart()

    def restart(self) -> None:
        self.state, self.began = codecs.getincrementaldecoder("utf-8")("replace"), False

    def push(self, ids: Iterable[int]) -> str:
        found = self.between.join(map(self.bytes_of.__getitem__, ids))
        if self.began and found:
            found = self.between + found
        self.began = self.began or bool(found)
        return self.state.decode(found)

    def end(self) -> str:
        rest = self.state.decode(b"", True)
        self.restart()
        return rest


class Codec:
    """Encoder and decoder of one vocabulary, with bounded caches."""

    def __init__(self, path: str, chunks: int = CHUNKS, pieces: int = PIECES):
        from tokenizers import Tokenizer

        self.merges = MergeList(path)
        rules = Tokenizer.from_file(path)  # its normaliser and word pattern, for text beyond ASCII
        self.normalised, self.cut = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        self.special = re.compile("(" + "|".join(map(re.escape, self.merges.special)) + ")") if self.merges.special else None
        self.window = Transducer(self.merges).window
        self.pieces = TwoHalves(lambda keys: [self.word(k) for k in keys], pieces)
        self.chunks = TwoHalves(self._fill, chunks)
        self.decoder = Decoder(self.merges)

    def word(self, letters: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a word in the vocabulary's letters."""
        merges = self.merges
        if len(letters) < self.window:
            return np.array(merges.merged([*map(merges.letter.__getitem__, letters[:-1]), merges.last[letters[-1]]]), "<u4").tobytes()
        run, out = Transducer(merges, self.window), bytearray()
        for a in range(0, len(letters), self.window):
            out += np.fromiter(run.push(letters[a : a + self.window]), "<u4").tobytes()
        return bytes(out) + np.array(run.end(), "<u4").tobytes()

    def words(self, chunk: str) -> list[str]:
        """Words of a chunk in the vocabulary's letters."""
        if chunk.isascii() and chunk.isprintable():
            return ASCII_PIECES.findall(chunk.lower())
        return [letters for letters, _ in self.cut(self.normalised(chunk))]

    def _fill(self, chunks: list[bytes]) -> list[bytes]:
        cut: list[list[str | bytes]] = []
        for chunk in chunks:
            text = chunk.decode()
            if self.special is None or "<" not in text or not self.special.search(text):
                cut.append(self.words(text))
                continue
            parts = [(p, self.merges.special.get(p)) for p in self.special.split(text) if p]
            cut.append([x for p, i in parts for x in ([np.array([i], "<u4").tobytes()] if i is not None else self.words(p))])
        values = iter(self.pieces.of([x for words in cut for x in words if isinstance(x, str)]))
        return [b"".join(x if isinstance(x, bytes) else next(values) for x in words) for words in cut]

    def encode(self, text: bytes | None) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of a text, span by span."""
        text, at = text or b"", 0
        while at < len(text):
            stop = at + SPAN
            if stop < len(text):
                space = re.compile(rb"[ \t\n\r\x0b\x0c]").search(text, stop)
                stop = space.start() if space else len(text)
            span, at = text[at:stop], stop
            if b"<|" not in span and b"\xcc" not in span and b"\xcd" not in span:
                span = span.lower()  # as the rules do later; a combining mark might compose with one case only
            yield b"".join(self.chunks.of(span.split()))

    def decode(self, ids: Iterable[int], shown: bool = True) -> str:
        decoder = self.decoder if shown else Decoder(self.merges, False)
        return decoder.push(ids) + decoder.end()


def codec_of(path: str) -> Codec:
    """One per Python worker, so that its caches outlive a task."""
    return resident(("streaming-bpe", path), lambda: Codec(path))


#: Ids that a task decodes at once.
ROWS = 1000


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> tuple[DataFrame, str]:
    """docs with an array column of token ids; also returns that column's name."""
    name = unused(docs, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                got = [np.frombuffer(b"".join(codec.encode(t)), "<i4") for t in byte_texts(batch.column(text))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.list_(pa.int32()))], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])), name


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded", shown: bool = False) -> tuple[DataFrame, str]:
    """docs with a text column of what the ids stand for; also returns that column's name. Null ids: null."""
    name = unused(docs, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(codec_of(path).merges, shown)
        for batch in batches:
            got = [None if x is None else decoder.push(x) + decoder.end() for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())])), name


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text goes through encoder, decoder and digests span by span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            count, hashed, back = [], [], []
            for text in byte_texts(batch.column("text")):
                n, ids, shown, decoder = 0, hashlib.sha256(), hashlib.sha256(), codec.decoder
                for found in codec.encode(text):
                    n += len(found) // 4
                    ids.update(found)
                    shown.update(decoder.push(np.frombuffer(found, "<u4").tolist()).encode())
                shown.update(decoder.end().encode())
                count.append(n)
                hashed.append(ids.hexdigest())
                back.append(shown.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(hashed, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
