import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fieldloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def texts(n=500):
    rng = random.Random(11)
    pieces = ["the", " ", "  ", "\n", "\t", "don't", "É", "é", "́", "Σ", "ΑΣ", "<|endoftext|>", "<|startof", "text|>", "😀", "\xa0", " ", "\x1c", "\x01", "a\x01b", "123", "###", "ß", "İ", "'s", "'", "word. ", "The quick brown fox jumps over it all. ", "\x85", "한국", "‍"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 120))) for _ in range(n)]


def test_whole_texts_equal_the_library(library):
    with open(PATH) as f:
        own = bpe.Encoder(f.read())
    import numpy as np

    all_texts = texts() + ["", " ", "x" * 5000, " ".join(texts(60))]
    for _ in range(2):
        ids, decoded = own.encode([t.encode() for t in all_texts])
        for t, i, d in zip(all_texts, ids, decoded, strict=True):
            want = library.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(i, dtype=np.int32).tolist() == want, t
            assert d == library.decode(want, skip_special_tokens=False)
    assert own.reused >= own.seen / 2


def test_chunks_are_content_defined():
    rng = random.Random(2)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(2400)).encode()
    a, b = bpe.chunks(b"one head " + passage), bpe.chunks(b"quite another head, longer " + passage + b" tail")
    assert b"".join(a) == b"one head " + passage
    assert len(set(a) & set(b)) >= len(a) - 3 > 5


def test_repair_joins_chunks_until_they_agree(library):
    """As if words joined across a blank: every join is held to disagree, then every other one."""
    import numpy as np

    with open(PATH) as f:
        own = bpe.Encoder(f.read())
    text = " ".join(texts(1500)).encode()
    cut = bpe.chunks(text)
    assert len(cut) > 4
    want = library.encode(text.decode(), add_special_tokens=False).ids
    disagreeing = own.disagreeing
    for bad in (lambda x: True, lambda x: hash(x) % 2):
        own.chunks.clear()
        own.disagreeing = lambda joins, bad=bad: {x for x in joins if bad(x)}
        parts = own.repaired(cut)
        assert len(parts) < len(cut) and np.frombuffer(b"".join(p.ids for p in parts), dtype=np.int32).tolist() == want
    own.disagreeing = disagreeing
    assert own.disagreeing({(b"the", b"The"), (b"", b"a"), (b"don'", b"t")}) == set()
    own.tokenizer = own.bare = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert own.disagreeing({(b"quick", b"brown")}) == {(b"quick", b"brown")}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_vocabulary_equals_the_library(name):
    import numpy as np

    path = public_tokenizers.path(name)
    other = Tokenizer.from_file(path)
    with open(path) as f:
        own = bpe.Encoder(f.read())
    assert own.word_wise == name.startswith("word")
    every = texts(200) + ["<|ENDOFTEXT|> x", "<|endoftext|>y <|StartOfText|>", "İstanbul Σας É " * 200]
    ids, decoded = own.encode([t.encode() for t in every])
    for t, i, d in zip(every, ids, decoded, strict=True):
        want = other.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(i, dtype=np.int32).tolist() == want and d == other.decode(want, skip_special_tokens=False), t


def test_latin_characters_need_no_normaliser():
    with open(PATH) as f:
        assert bpe.Encoder(f.read()).bare is not None


def test_a_very_long_text(library):
    import numpy as np

    with open(PATH) as f:
        own = bpe.Encoder(f.read())
    text = " ".join(texts(4000)) + "x" * 100_000
    ids, _ = own.encode([text.encode()])
    assert np.frombuffer(ids[0], dtype=np.int32).tolist() == library.encode(text, add_special_tokens=False).ids


def test_table(spark, library):
    rows = [(1, "Hello world", 1), (2, None, 1), (None, "", 1), (1, "Hello world", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bpe.digests(bpe.encode(df, PATH)).collect()
    assert len(got) == 4
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in got:
        want = library.encode("Hello world" if r.doc_id == 1 else "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), sha(" ".join(map(str, want))), sha(library.decode(want, skip_special_tokens=False)))
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_the_library_gets_few_characters_at_once(library, monkeypatch):
    with open(PATH) as f:
        own = bpe.Encoder(f.read())
    monkeypatch.setattr(bpe, "AT_ONCE", 300, raising=False)
    sizes = []

    def spied(tokenizer):
        class Spy:
            def encode_batch_fast(self, x, **how):
                sizes.append((len(x), sum(map(len, x))))
                return tokenizer.encode_batch_fast(x, **how)

        return Spy()

    own.tokenizer, own.bare = spied(own.tokenizer), spied(own.bare)
    all_texts = texts(200)
    ids, _ = own.encode([t.encode() for t in all_texts])
    assert [len(i) // 4 for i in ids] == [len(library.encode(t, add_special_tokens=False).ids) for t in all_texts]
    assert len(sizes) > 20 and all(n == 1 or size <= 300 for n, size in sizes)


def latin_texts(n=60):
    rng = random.Random(5)
    words = ["the", "Überraschung", "naïve", "it's", "we'll", "'re", "x²", "1984", "...'s", "ŁÓDŹ", "İstanbul", "a\x1cb", "ª", "end.", "\xa0", "\x85", "¿que?", "don't", "ǅ", "Ⱥ", "Ɓeta", "</w>", "<w>"]
    word = lambda: rng.choice(words) if rng.random() < 0.4 else "".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 12)))
    return [rng.choice([" ", "\n", "  "]).join(word() for _ in range(rng.randint(0, 400))) for _ in range(n)]


def test_latin_chunks_do_not_go_through_the_alignments_of_the_library(library):
    import numpy as np

    with open(PATH) as f:
        own = bpe.Encoder(f.read())
    got = []

    def spied(tokenizer):
        class Spy:
            def encode_batch_fast(self, x, **how):
                got.extend(x)
                return tokenizer.encode_batch_fast(x, **how)

        return Spy()

    own.tokenizer, own.bare = spied(own.tokenizer), spied(own.bare)
    all_texts = latin_texts()
    ids, decoded = own.encode([t.encode() for t in all_texts])
    for t, i, d in zip(all_texts, ids, decoded, strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(i, dtype=np.int32).tolist() == want, t
        assert d == library.decode(want, skip_special_tokens=False)
    assert 0 < sum(map(len, got)) < sum(map(len, all_texts)) / 2


def test_ranks_give_what_merges_give(library):
    with open(PATH) as f:
        own = bpe.Encoder(f.read())
    rng = random.Random(3)
    words = [t.removesuffix("</w>") for t in own.token if t.isascii() and t.islower()][:20_000]
    words += ["".join(rng.choice(a) for _ in range(rng.randint(1, n))) for a in ("ab", "aeinrst", "abcdefghijklmnopqrstuvwxyz", "!.,-'", "éàüß") for n in (4, 9, 40, 700) for _ in range(100)]
    words += ["a" * n for n in (1, 2, 3, 5, 8, 13, 99, 499, 500, 501, 20_001)]
    for w, e in zip(words, library.encode_batch(words, add_special_tokens=False), strict=True):
        assert own._by_ranks(w) == e.ids, w


def test_ranks_stand_for_merges_only_where_they_are_the_same():
    """A token that merging never gives is left out; merges in another order than the ids, or another pattern, rule ranks out."""
    import copy
    import json

    with open(PATH) as f:
        spec = json.load(f)
    byte = list(bpe.byte_of())
    singles = byte + [c + "</w>" for c in byte]

    def made(merges, pattern=bpe.PATTERN):
        out = copy.deepcopy({k: v for k, v in spec.items() if k != "model"}) | {"model": {k: v for k, v in spec["model"].items() if k not in ("vocab", "merges")}}
        tokens = singles + list(dict.fromkeys(a + b for a, b in merges))
        out["model"] |= {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": merges}
        out["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = pattern
        for k, x in enumerate(out["added_tokens"]):
            x["id"] = len(tokens) + k
        return out

    assert bpe.unreached(made([["a", "b"], ["ab", "c</w>"]])) == ()
    # b, c is merged before a, b, so that abc (from ab, c) never comes about: abc is a, bc
    never = made([["b", "c"], ["a", "b"], ["ab", "c"]])
    assert bpe.unreached(never) == (len(singles) + 2,)
    own = bpe.Encoder(json.dumps(never))
    assert own.ranks is not None
    for word in ("abc", "abcx", "xabc", "ab", "bcab", "abcabcab"):
        assert own._by_ranks(word) == own.bare.encode(word, add_special_tokens=False).ids
    late = made([["a", "b"], ["b", "c"]])
    late["model"]["merges"].reverse()
    assert bpe.unreached(late) is None and bpe.Encoder(json.dumps(late)).ranks is None
    assert bpe.unreached(made([["a", "b"]], pattern="[^\\s]+")) is None
    assert bpe.unreached(made([["a", "ā"]])) is None  # the byte that ends words for tiktoken
    assert bpe.unreached(made([["<", "/"], ["</", "w"], ["</w", ">"]])) is None


def test_the_query_s_vocabulary_is_read_by_ranks():
    with open(PATH) as f:
        json_text = f.read()
    known = bpe.traits(json_text)
    assert known.unreached == () and bpe.Encoder(json_text, known).ranks is not None
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        assert bpe.traits(f.read()).unreached is None
