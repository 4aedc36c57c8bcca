"""New pre-tokens of plain Latin text against the whole tokenizer."""

import random

from tokenizers import Tokenizer

from factloom.llm.common import tokenizer_path
from factloom.llm.wavelet import WordEncoder


def test_plain_words_need_the_model_only():
    path = tokenizer_path("word_bpe_49k.json")
    whole, enc, rng = Tokenizer.from_file(path), WordEncoder(path, kept=20_000), random.Random(9)
    signs = [chr(c) for c in (*range(0x20, 0x7F), *range(0xC0, 0x100)) if chr(c) not in "'×÷<"] + list("\t\r\n")
    letters = [c for c in signs if c.isalpha()]
    texts = ["".join(rng.choices(signs, k=rng.randrange(1, 60))) for _ in range(300)] + ["".join(rng.choices(letters, k=rng.randrange(1, 12))) for _ in range(300)] + signs
    # Texts that are cut at blanks, with words of either kind.
    other = [f"{t} it's ÷ 東京 é {t[:5]}<|endoftext|>x" for t in texts[:100]]
    want = lambda ts: [e.ids for e in whole.encode_batch(ts, add_special_tokens=False)]
    got = lambda ts: [list(memoryview(x).cast("I")) for x in enc(ts)]

    for _ in range(2):
        for k in range(0, len(other), 30):
            assert got(other[k : k + 30]) == want(other[k : k + 30])
    full, enc._tok = enc._tok, None
    for _ in range(2):
        for k in range(0, len(texts), 50):
            assert got(texts[k : k + 50]) == want(texts[k : k + 50])
    enc._tok = full
    assert got([*other, *texts]) == want([*other, *texts])


def test_python_sees_a_block_s_words_once():
    path = tokenizer_path("word_bpe_49k.json")
    whole, enc, rng = Tokenizer.from_file(path), WordEncoder(path, kept=20_000), random.Random(4)
    words = ["Some", "wörds,", "(again)", "12.5", "É", "--", "\t", "  ", "\r\n", "x"]
    texts = ["".join(rng.choices([*words, " "], k=200)) for _ in range(200)] + ["", " ", "it's \x0b\x0c÷ <|endoftext|>", "a"]
    asked, all_ = [], enc._all
    enc._all = lambda some, *x: asked.append(len(some)) or all_(some, *x)
    for some in (texts, texts[:200], [], [""], texts[-4:]):
        got = [list(memoryview(x).cast("I")) for x in enc(some)]
        assert got == [e.ids for e in whole.encode_batch(some, add_special_tokens=False)]
    # Of 80,000 words and more those of the alphabet's few joins, each once a block.
    assert max(asked) < 30_000
