"""BPE as a streaming transducer with bounded lookahead, and incremental decoding (operator 6).

Every prefix of a symbol stream has one encoding, and it is the one in which no two
neighbouring tokens would have been broken up by a merge across their border. So the last
token of each prefix follows from those of shorter prefixes: it is the one token that ends
there and stands after the last token of what is left. Tokens of the current prefix that end
``lookahead`` symbols before its end stay whatever follows, and are emitted; only that many
symbols are kept.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytriage.llm.pretokens import PreTokens

#: Entries of a generation of a worker's cache of words (two are kept) and of its cache of pairs.
WORD_CACHE = 3 << 16
PAIR_CACHE = 1 << 19
#: Longer pre-tokens are streamed without being cached.
CACHED_LENGTH = 64
#: Stands for the suffix of a pre-token where tokens are searched; not a byte-level letter.
_END = "\0"


class Merges:
    """A merge list in order, with what the transducer needs of it."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.parts: dict[str, tuple[str, str]] = {}
        length: dict[str, int] = {}
        for a, b in merges:
            if a + b in self.parts:
                raise ValueError(f"{a + b!r} has two merges")
            self.parts[a + b] = (a, b)
            length[a + b] = length.get(a, 1) + length.get(b, 1)
        self.length = length
        self.longest = max(length.values(), default=1)
        self.lookahead = self._lookahead(merges)
        self._right: dict[str, list] = {}
        self._left: dict[str, list] = {}
        self._fits: dict[int, bool] = {}
        self.names = {i: t for t, i in vocab.items()}
        #: Finds all tokens in a whole pre-token; the suffix is one letter there.
        self.finder = ahocorasick.Automaton()
        for token, i in vocab.items():
            core = token[: -len(suffix)] + _END if suffix and token.endswith(suffix) else token
            self.finder.add_word(core, (i, len(core)))
        self.finder.make_automaton()
        #: Length of the longest token that ends in a letter pair, with and without the suffix.
        self.ending: dict[str, int] = {}
        for token in vocab:
            size = len(token) - len(suffix) if suffix and token.endswith(suffix) and len(token) > len(suffix) else len(token)
            tail = token[max(0, size - 2):]
            self.ending[tail] = max(self.ending.get(tail, 1), size)

    def _lookahead(self, merges: list[tuple[str, str]]) -> int:
        """Symbols after a token that can still change it.

        Whether a merge happens depends on what is to its right only through an earlier rule
        that takes a right end of its right part first; that rule depends on what is to its
        right in the same way. Ranks fall along such a chain, so its longest reach is found
        in one pass over the list.
        """
        reach: dict[str, int] = {}
        most = 0
        for a, b in merges:
            beyond, x = reach.get(b, 0), b
            while x in self.parts:
                x = self.parts[x][1]
                beyond = max(beyond, reach.get(x, 0))
            reach[a] = max(reach.get(a, 0), self.length.get(b, 1) + beyond)
            most = max(most, reach[a])
        return most + self.longest

    def _ends(self, token: str, side: int, kept: dict[str, list]) -> list[tuple[str, int]]:
        """The token and its parts on one side, each with the rank of the merge that takes it up."""
        out = kept.get(token)
        if out is None:
            out, until, x = [], len(self.rank) + 1, token
            while True:
                out.append((x, until))
                if x not in self.parts:
                    break
                until, x = self.rank[self.parts[x]], self.parts[x][side]
            kept[token] = out
        return out

    def fits(self, a: int, b: int) -> bool:
        """Whether token ``b`` may follow token ``a``: no merge across their border happens before both are whole.

        Equal ranks are applied from the left, so the merge inside ``a`` comes first and the one inside ``b`` last.
        """
        key = a << 32 | b
        known = self._fits.get(key)
        if known is None:
            known, rank = True, self.rank
            for x, x_until in self._ends(self.names[a], 1, self._right):
                for y, y_until in self._ends(self.names[b], 0, self._left):
                    r = rank.get((x, y))
                    if r is not None and r < x_until and r <= y_until:
                        known = False
            if len(self._fits) >= PAIR_CACHE:
                self._fits.clear()
            self._fits[key] = known
        return known

    def extend(self, letters: str, last: list, before: int | None, final: bool) -> None:
        """Append to ``last`` the last token of each longer prefix of ``letters``.

        ``last[k]`` is ``(id, length)`` of the last token of the first ``k`` letters, ``before``
        the token in front of them all. ``final`` gives the last letter the suffix.
        """
        vocab, ending, fits_known, fits, suffix = self.vocab, self.ending, self._fits, self.fits, self.suffix
        n = len(letters)
        for end in range(len(last), n + 1):
            tail = suffix if final and end == n else ""
            most = max(ending.get(letters[end - 2: end] + tail, 1) if end > 1 else 1, 1)
            for at in range(max(0, end - most), end):
                token = vocab.get(letters[at:end] + tail)
                if token is None:
                    continue
                left = last[at][0] if at else before
                if left is not None:
                    fit = fits_known.get(left << 32 | token)
                    if not (fits(left, token) if fit is None else fit):
                        continue
                last.append((token, end - at))
                break
            else:
                raise ValueError(f"no token ends {letters[max(0, end - 40): end]!r}")


class Encoder:
    """Encodes one pre-token given as a stream of byte-level letters.

    ``push`` takes letters and returns the ids that have become stable, ``finish`` the rest.
    No more than three times the lookahead and longest token is kept.
    """

    def __init__(self, merges: Merges):
        self.merges = merges
        self.keep = merges.lookahead + merges.longest
        self.reset()

    def reset(self) -> None:
        self.letters = ""
        self.last: list[tuple[int, int] | None] = [None]
        self.before: int | None = None  # the last emitted token
        self.held = ""

    def _emit(self, margin: int) -> list[int]:
        """Ids of the current prefix that end at least ``margin`` letters before its end; what they cover is let go."""
        at, found, cut = len(self.letters), [], 0
        limit = at - margin
        while at > 0:
            token, size = self.last[at]
            if at <= limit:
                cut = cut or at
                found.append(token)
            at -= size
        found.reverse()
        if found:
            self.letters, self.last, self.before = self.letters[cut:], [None, *self.last[cut + 1:]], found[-1]
        return found

    def whole(self, letters: str) -> list[int]:
        """Ids of a pre-token no longer than the lookahead, of which nothing could be emitted before its end."""
        m = self.merges
        known, stop = m._fits, m.suffix and _END
        last: list = [None] * (len(letters) + 2)
        for end, (token, size) in m.finder.iter(letters + stop):
            end += 1
            if last[end] is not None:
                continue
            if end > size:
                left = last[end - size][0]
                fit = known.get(left << 32 | token)
                if not (m.fits(left, token) if fit is None else fit):
                    continue
            last[end] = (token, size)
        out, at = [], len(letters) + len(stop)
        while at:
            token, size = last[at]
            out.append(token)
            at -= size
        out.reverse()
        return out

    def push(self, letters: str) -> list[int]:
        out: list[int] = []
        for at in range(0, len(letters), self.keep):
            run = self.held + letters[at: at + self.keep]
            self.letters, self.held = self.letters + run[:-1], run[-1]
            self.merges.extend(self.letters, self.last, self.before, False)
            if len(self.letters) >= 2 * self.keep:
                out += self._emit(self.keep)
        return out

    def finish(self) -> list[int]:
        out: list[int] = []
        if self.held:
            self.letters += self.held
            self.merges.extend(self.letters, self.last, self.before, True)
            out = self._emit(0)
        self.reset()
        return out


class Decoder:
    """Turns ids into text one at a time.

    With a byte-level decoder the bytes of a token go through a UTF-8 state machine that
    holds back an unfinished character; without a decoder tokens are put out as they are,
    one space between two.
    """

    def __init__(self, splitter_bytes: dict[str, int], tokens: dict[int, str], byte_level: bool):
        self.bytes, self.tokens, self.byte_level = splitter_bytes, tokens, byte_level
        self.reset()

    def reset(self) -> None:
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.first = True

    def push(self, ids: Iterable[int]) -> str:
        out = []
        for i in ids:
            token = self.tokens[i]
            if self.byte_level:
                out.append(self.state.decode(bytes(self.bytes[c] for c in token)))
            else:
                out.append(token if self.first else " " + token)
            self.first = False
        return "".join(out)

    def finish(self) -> str:
        out = self.state.decode(b"", True) if self.byte_level else ""
        self.reset()
        return out


class Codec:
    """Encoder, decoder and the worker's cache of short pre-tokens for one tokenizer file."""

    def __init__(self, path: str):
        self.splitter = PreTokens(path)
        model = self.splitter.spec["model"]
        if model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path}: BPE options that are not supported")
        self.vocab = model["vocab"]
        self.merges = Merges(self.vocab, [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model.get("end_of_word_suffix") or "")
        tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.splitter.special.items()}
        self.encoder = Encoder(self.merges)
        self.decoder = Decoder(self.splitter.byte, tokens, (self.splitter.spec.get("decoder") or {}).get("type") == "ByteLevel")
        #: Ids as text, and decoded text, of short pre-tokens: the young generation, then the older one.
        self.ids_of: dict[str, str] = {}
        self.text_of: dict[str, str] = {}
        self.older: tuple[dict[str, str], dict[str, str]] = ({}, {})

    def stream(self, letters: str) -> Iterator[list[int]]:
        """Ids of a pre-token in groups, as they become stable."""
        self.encoder.reset()
        for at in range(0, len(letters), 4096):
            yield self.encoder.push(letters[at: at + 4096])
        yield self.encoder.finish()

    def _learn(self, words: Iterable[str]) -> None:
        """Put pre-tokens that the young generation lacks into it, from the older one or encoded and decoded now."""
        old_ids, old_text = self.older
        for w in words:
            got = old_ids.get(w)
            if got is not None:
                self.ids_of[w], self.text_of[w] = got, old_text[w]
                continue
            ids = self.encoder.whole(w if w.isascii() and w.isalnum() else self.splitter.letters(w))
            self.ids_of[w], self.text_of[w] = " ".join(map(str, ids)), self.decode(ids)

    def runs(self, text: str) -> Iterator[tuple[str, str]]:
        """Ids as text and decoded text, run by run: many short pre-tokens, or what became stable of a long one."""
        for kind, words in self.splitter.split(text):
            if kind == "special":
                yield " ".join(map(str, words)), self.decode(words)
            elif kind == "words" and max(map(len, words), default=0) <= CACHED_LENGTH:
                distinct = set(words)
                new = [w for w in distinct if w not in self.ids_of]
                if new:
                    if len(self.ids_of) >= WORD_CACHE:
                        self.older = (self.ids_of, self.text_of)
                        self.ids_of, self.text_of = {}, {}
                        new = list(distinct)
                    self._learn(new)
                if words:
                    between = "" if self.decoder.byte_level else " "
                    yield " ".join(map(self.ids_of.__getitem__, words)), between.join(map(self.text_of.__getitem__, words))
            else:
                for w in words:
                    for ids in self.stream(self.splitter.letters(w) if kind == "words" else w):
                        if ids:
                            yield " ".join(map(str, ids)), self.decode(ids)

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.runs(text) for i in ids.split(" ")]

    def decode(self, ids: Iterable[int]) -> str:
        self.decoder.reset()
        return self.decoder.push(ids) + self.decoder.finish()

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids and of the decoded text, both digested as they are made."""
        total, a, b = 0, hashlib.sha256(), hashlib.sha256()
        between = "" if self.decoder.byte_level else " "
        for ids, decoded in self.runs(text):
            if total:
                ids, decoded = " " + ids, between + decoded
            total += ids.count(" ") + (not total)
            a.update(ids.encode())
            b.update(decoded.encode())
        return total, a.hexdigest(), b.hexdigest()


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, ids`` (array of int) and ``decoded``, what decoding the ids gives.

    Null counts as the empty text: no ids, empty decoded text. Repeated rows and null ids
    keep their rows; other columns are not read.
    """
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            for at in range(batch.num_rows):
                ids = codec.encode(batch.column(1)[at].as_py() or "")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), pa.array([ids], pa.list_(pa.int32())), pa.array([codec.decode(ids)], pa.string())], names=["doc_id", "ids", "decoded"])

    return picked.mapInArrow(run, f"doc_id {dict(picked.dtypes)['doc_id']}, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_tokens, ids_sha256, decoded_sha256``; cases as in ``encode_documents``.

    Digests are lower-case hexadecimal SHA-256, of the decimal ids with one space between
    two and of the decoded text in UTF-8, taken while the text streams through.
    """
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            got = list(zip(*(codec.digests(t.as_py() or "") for t in batch.column(1)))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got[0], pa.int64()), pa.array(got[1], pa.string()), pa.array(got[2], pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return picked.mapInArrow(run, f"doc_id {dict(picked.dtypes)['doc_id']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
