import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skytriage.llm import token_counts, transducer

PATH = public_tokenizers.path("word_bpe_49k.json")
CASES = ["", " ", "a", "it's don't we'll", "<|endoftext|>x<|startoftext|> <|endoftext", "İstanbul Σίσυφος ΣΑΣ", "ﬁ ſ ŉ x²³", "é ́a", "\x85\x1c\x1d a​b", "日本語 テキスト", "🙂👍🏽", "a" * 3000,
         "ab" * 2000, "ionation" * 300, "_" * 300, "\0\1", "naïve café—“quoted” … €5", "x­y", "the " * 70000]


def cases():
    rng, out = random.Random(3), list(CASES)
    for _ in range(150):
        pool = rng.choice(["abcde", "aeiourstnl", " 'strevmld", "ÀéßñΣσς İıſ́̇ .,!?0123", "日本 語ab​힣", "<|endoftx>", "\t\n\r\x0b\x1c\x85\xa0 a", "ΩΑΣ'ΣAs"])
        out.append("".join(rng.choice(pool) for _ in range(rng.choice([3, 10, 40, 200, 900]))))
    return out


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ids, decoded


def test_codec_and_counts_against_the_library(library):
    codec = transducer.Codec(PATH)
    lengths = token_counts.Lengths(codec.splitter, {})
    for text in cases():
        n, a, b, ids, decoded = expected(library, text)
        assert codec.encode(text) == ids and codec.decode(ids) == decoded
        assert codec.digests(text) == (n, a, b) and lengths.count(text) == n


def test_stream_keeps_little_and_emits_before_the_end(library):
    codec = transducer.Codec(PATH)
    word = "".join(random.Random(1).choice("aeinorst") for _ in range(20000))
    out, early = [], 0
    for at in range(0, len(word), 7):
        out += codec.encoder.push(word[at: at + 7])
        assert len(codec.encoder.letters) <= 3 * codec.encoder.keep
        early = len(out)
    out += codec.encoder.finish()
    assert out == library.encode(word, add_special_tokens=False).ids and early > 0.8 * len(out)


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(transducer, "WORD_CACHE", 3)
    monkeypatch.setattr(transducer, "PAIR_CACHE", 3)
    monkeypatch.setattr(token_counts, "CACHE", 2)
    codec = transducer.Codec(PATH)
    lengths = token_counts.Lengths(codec.splitter, {"the": 1})
    for text in ("one two three four five six one two the end of it", "a b c d e f a b c"):
        assert codec.digests(text) == expected(library, text)[:3] and lengths.count(text) == expected(library, text)[0]


def test_byte_level_decoder_holds_back_unfinished_characters():
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    splitter = transducer.Codec(PATH).splitter
    decoder = transducer.Decoder(splitter.byte, {i: t for t, i in other.get_vocab().items()}, True)
    for text in ("naïve 🙂👍🏽 日本語", "plain"):
        ids = other.encode(text, add_special_tokens=False).ids
        got = "".join(decoder.push([i]) for i in ids) + decoder.finish()
        assert got == text


def test_documents(odd, library):
    texts = sorted((str(r["doc_id"]), *expected(library, r["text"])[:3], len((r["text"] or "").encode())) for r in odd.collect())
    got = sorted(tuple(map(str, r)) for r in transducer.digest_documents(odd, PATH).collect())
    assert got == [(i, str(n), a, b) for i, n, a, b, _ in texts]
    counted = sorted((str(r[0]), r[1], r[2], r[3]) for r in token_counts.token_counts(odd, PATH).collect())
    assert counted == sorted((i, size, n, n > 2048) for i, n, _, _, size in texts)
    some = {r["doc_id"]: r for r in transducer.encode_documents(odd.where("doc_id in (5, 9, 60)"), PATH).collect()}
    assert some[9]["ids"] == [] and some[9]["decoded"] == "" and len(some[60]["ids"]) > 80
    empty = odd.limit(0)
    assert transducer.digest_documents(empty, PATH).count() == 0 and token_counts.token_counts(empty, PATH).count() == 0


def test_plain_texts_are_split_by_the_standard_library(library):
    import re
    import unicodedata

    import regex

    from skytriage.llm.pretokens import _PLAIN, PreTokens

    splitter = PreTokens(PATH)
    assert isinstance(splitter.pattern, re.Pattern)
    whole = regex.compile(splitter.spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
    for c in filter(_PLAIN.fullmatch, map(chr, range(0x110000))):
        text = unicodedata.normalize("NFC", f"a{c}1{c}{c} 's{c}'ll").lower()
        assert splitter.pattern.findall(text) == whole.findall(text)
