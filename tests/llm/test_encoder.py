"""The packing encoder against the tokenizer on texts with odd white space, marks and special tokens."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from maskwright.llm.packing import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_are_the_tokenizers():
    encode, tokenizer = Encoder(PATH, limit=500), Tokenizer.from_file(PATH)
    rng = random.Random(1)
    parts = [*"ab é\n\t  　'123.,ßſ²½日\r​́", "  ", "\n\n", "'s", "'ll", " <|endoftext|>", "\x1c", "\x85", "😀", "don't", "İ"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)
